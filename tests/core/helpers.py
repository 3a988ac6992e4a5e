"""Small word-processing packages."""

import io
import zipfile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(*runs: str) -> str:
    return "<w:p>" + "".join(f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"


def table(rows: list[tuple[str, ...]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def package(body: str, **parts: bytes | str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>')
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()
