import io
import json
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.operators import recognizers, verify
from veilspan.plans import cli
from veilspan.plans.redaction import Config, RedactionJob, emails_only, keyed, redact
from veilspan.sources import annotations, images, ooxml, pixels, synthetic
from veilspan.streaming import detect

from .helpers import package, paragraph, table

SF = "/root/testdata/sf0.001"

BODY = (
    paragraph("Write to asha.b", "irch@issuer.example", ".org today")
    + table([("Term", "Description"), ("Zenith", "Zenith Harbour Holdings Limited"), ("IST", "Indian Standard Time")])
    + paragraph("Zenith Harbour Holdings Limited", " pays; Zenith signs. Order No. 481920 stays. Card 4539 5787 6362 1486.")
    + '<w:p><w:r><w:instrText> HYPERLINK "mailto:hidden@issuer.example.org" </w:instrText></w:r></w:p>'
    + '<w:p><w:r><w:t>outer </w:t></w:r><w:txbxContent><w:p><w:r><w:t>inner box</w:t></w:r></w:p></w:txbxContent></w:p>'
)
RELS = b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" TargetMode="External" Target="mailto:asha.birch@issuer.example.org"/><Relationship Id="r2" Target="header1.xml"/></Relationships>'
CORE = b'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Zenith</dc:creator></cp:coreProperties>'


LOGO = pixels.encoded(np.arange(20 * 30 * 3, dtype=np.uint8).reshape(20, 30, 3))


@pytest.fixture
def folder(tmp_path):
    content = package(BODY, **{"word/_rels/document.xml.rels": RELS, "docProps/core.xml": CORE, "word/media/a.png": LOGO, "word/media/b.png": b"pixels"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(content)
    (tmp_path / "in/empty.docx").write_bytes(package(""))
    (tmp_path / "in/broken.docx").write_bytes(b"no zip")
    return tmp_path


def test_blocks(spark, folder):
    found = ooxml.blocks(ooxml.packages(spark, f"{folder}/in/a.docx")).orderBy("block_no").collect()
    by = {}
    for r in found:
        by.setdefault(r.kind, []).append(r)
    texts = [r.text for r in by["paragraph"]]
    assert texts[0] == "Write to asha.birch@issuer.example.org today"
    assert texts[-2:] == ["outer ", "inner box"] and sum("inner box" in x for x in texts) == 1
    assert [r.cells for r in by["row"]][1] == ["Zenith", "Zenith Harbour Holdings Limited"]
    assert "hidden@" in by["field_code"][0].text and by["media"][0].payload == LOGO
    joined = ooxml.joined_text(ooxml.blocks(ooxml.packages(spark, f"{folder}/in"))).collect()
    assert len(joined) == 1 and joined[0].text.startswith("Write to") and "HYPERLINK" in joined[0].text.split("\n")[-1]


def test_command_line(spark, folder):
    assert cli.main([f"{folder}/missing.docx"]) == 2
    (folder / "x.txt").write_text("x")
    assert cli.main([f"{folder}/x.txt"]) == 2
    truth = {"document": "a.docx", "note": "", "region": {"start": 0, "end": 50}, "annotations": [{"type": "EMAIL_ADDRESS", "start": 9, "end": 38, "length": 29}]}
    (folder / "truth.json").write_text(json.dumps(truth))
    assert cli.main([f"{folder}/in", f"{folder}/out", "--names", "--report", f"{folder}/r.md", "--ground-truth", f"{folder}/truth.json", "--mapping", f"{folder}/map"]) == 0
    with zipfile.ZipFile(folder / "in/a.docx") as a, zipfile.ZipFile(folder / "out/a.docx") as b:
        assert a.namelist() == b.namelist()
        old, new = (z.read("word/document.xml").decode() for z in (a, b))
        every = "".join(b.read(n).decode(errors="replace") for n in b.namelist())
    for gone in ("asha.b", "issuer.example", "Zenith", "4539 5787"):
        assert gone not in every, gone
    for kept in ("Order No. 481920", "Indian Standard Time", "inner box"):
        assert kept in new
    for tag in ("<w:p>", "<w:r>", "<w:b", "<w:tr>", "<w:tc>"):
        assert old.count(tag) == new.count(tag), tag
    report = (folder / "r.md").read_text()
    score = report.split("## Micro, strict")[1].split("##")[0]
    assert "| 1 | 0 | 0 | 1.000 | 1.000 | 1.000 | 1.000 |" in score, score
    for part in ("Totals", "Replacements by container", "| links |", "| metadata |", "| field_codes |", "Images", "word/media/a.png", "Missed", "Too much, by kind"):
        assert part in report, part
    assert sorted(x.name for x in (folder / "out").iterdir()) == ["a.docx", "empty.docx"]
    with zipfile.ZipFile(folder / "out/a.docx") as z:
        assert z.read("word/media/b.png") == b"pixels" and z.read("word/media/a.png") == pixels.blank(LOGO)
    packages = [ooxml.packages(spark, f"{folder}/{x}/a.docx") for x in ("in", "out")]
    before, after = ({r.element: r.n for r in ooxml.structure(x).collect()} for x in packages)
    assert before == after and before["runs"] > 5 and before["cells"] == 6 and before["rows"] == 3
    targets = ("hidden@issuer.example.org", "asha.birch@issuer.example.org")
    assert {r.target for r in ooxml.remaining(packages[0], targets).collect()} == set(targets) and ooxml.remaining(packages[1], targets).count() == 0
    assert [tuple(r)[1:] for r in ooxml.structure(ooxml.packages(spark, f"{folder}/in/broken.docx")).collect()] == [("unreadable", 1)]
    blocks = [ooxml.blocks(ooxml.packages(spark, f"{folder}/{x}/a.docx")).where("kind <> 'media'") for x in ("in", "out")]
    assert verify.same_structure(*(verify.structure(x, ()) for x in blocks)).count() == 0


def test_short_and_full_name_share_a_surrogate(spark, folder):
    found = ooxml.blocks(ooxml.packages(spark, f"{folder}/in/a.docx"))
    rows = found.where("kind = 'row'").select("doc_id", F.col("block_no").alias("row_no"), "cells")
    job = RedactionJob(Config(recognizers=(*recognizers.DEFAULT, *recognizers.NAME_RULES)))
    out = job.run(ooxml.joined_text(found), rows)
    names = {r.key: r.surrogate for r in out.mapping.collect()}
    assert names["zenith"] == names["zenith harbour holdings limited"]
    assert {r.entity_type for r in out.detections.collect()} >= {"EMAIL_ADDRESS", "CREDIT_CARD", "ORGANIZATION"}


@pytest.mark.parametrize("text", [None, "", "   \n ", "Nothing private here.", "a@b.example.org"])
def test_degenerate_texts(spark, text):
    got = redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.text == text) == (text != "a@b.example.org")
    assert got.replacements == int(text == "a@b.example.org")


def test_models_plug_in_and_undetected_mentions_are_replaced(spark):
    texts = spark.createDataFrame([(1, "Asha Birch came. ASHA  BIRCH left.")], "doc_id long, text string")
    model = lambda t: t.select("doc_id", F.lit("PERSON").alias("entity_type"), F.lit(0).alias("start"), F.lit(10).alias("end"), F.lit(0.9).alias("score"), F.substring("text", 1, 10).alias("text"))
    got = RedactionJob(Config(models=[model])).run(texts).texts.first()
    assert got.replacements == 2 and "irch" not in got.text.lower().replace("birch", "", 0) or "asha birch" not in got.text.lower()


def test_corpus_scope(spark):
    texts = spark.createDataFrame([(1, "x@a.example.org"), (2, "again X@a.example.org")], "doc_id long, text string")
    out = RedactionJob(Config(corpus_scope=True)).run(texts)
    assert out.mapping.count() == 1
    a, b = (r.text for r in out.texts.orderBy("doc_id").collect())
    assert b == "again " + a


def test_annotations_and_values(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"document": "d", "region": {"start": 1, "end": 9}, "annotations": [{"type": "PERSON", "start": 2, "end": 5, "text": "Ann"}]}, indent=1))
    marks, regions = annotations.read_annotations(spark, f"{tmp_path}/t.json")
    assert [tuple(r) for r in marks.collect()] == [("d", "PERSON", 2, 5, "Ann")] and tuple(regions.first()) == ("d", 1, 9)
    annotations.write_annotations(marks, f"{tmp_path}/out")
    assert "Ann" not in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    (tmp_path / "v.json").write_text(json.dumps({"known_pii": {"PERSON": ["Ann", "Bo"]}, "variants": {"PERSON": ["Bo"]}}))
    assert annotations.read_values(spark, f"{tmp_path}/v.json").count() == 2


def test_images(spark):
    words = [("government", 0, 0, 40, 5), ("of", 41, 0, 45, 5), ("india", 46, 0, 60, 5), ("father", 0, 10, 20, 15), ("tall", 0, 0, 5, 90)]
    tools = images.ImageTools(read=lambda x: [{"block": 0, "par": 0, "line": 0, "word_no": i, "text": w, "conf": 90.0, "l": a, "t": b, "r": c, "b": d, "width": 1000, "height": 100} for i, (w, a, b, c, d) in enumerate(words)], detect={"code": lambda x: [(0, 0, 5, 5), (3, 3, 9, 9), (50, 50, 60, 60)]})
    media = spark.createDataFrame([("d", "a.png", bytearray(b"x"))], "doc_id string, part string, payload binary")
    found = images.plausible(images.words(media, tools))
    assert {r.text for r in found.collect()} == {w for w, *_ in words if w != "tall"}
    text = images.image_text(found)
    row = text.first()
    assert row.text == "government of india father" and [row.text[w.start : w.end] for w in row.words] == row.text.split()
    assert images.cards(text).count() == 1 and images.card_spans(text).count() == 0
    spans = spark.createDataFrame([("d", "a.png", 12, 15, "ORGANIZATION")], "doc_id string, name string, start int, end int, entity_type string")
    assert {(r.l, r.r) for r in images.sensitive_words(text, spans).collect()} == {(41, 45), (46, 60)}
    boxes = images.merge_boxes(images.objects(media, tools)).collect()
    assert {(r.l, r.t, r.r, r.b) for r in boxes} == {(0, 0, 9, 9), (50, 50, 60, 60)}
    assert images.objects(media, images.ImageTools()).count() == images.words(media, images.ImageTools()).count() == 0
    assert images.line_bands(found).first().b == 15
    assert images.is_logo(b"", images.ImageTools(size=lambda x: (10, 10))) and not images.is_logo(b"", images.ImageTools())


def test_images_are_redacted_in_the_job(spark, folder):
    """A card is covered line by line, a code by noise, a private word alone; --no-images leaves all as it is."""
    page = np.full((100, 400, 3), 255, np.uint8)
    page[10:18, 10:140:2] = 0
    card, plain = pixels.encoded(page), pixels.encoded(page[:, :399])
    word = lambda t, n, line, a, b: {"block": 0, "par": 0, "line": line, "word_no": n, "text": t, "conf": 90.0, "l": a, "t": b, "r": a + 30, "b": b + 8, "width": 400, "height": 100}
    seen = {card: [word("UIDAI", 0, 0, 10, 10), word("father", 1, 0, 50, 10), word("x", 0, 1, 10, 60)], plain: [word("see", 0, 0, 10, 60), word("a@corp.example.org", 1, 0, 50, 60)]}
    tools = images.ImageTools(read=lambda x: seen.get(x, []), detect={"code": lambda x: [(300, 50, 340, 90)] if x == plain else []})
    media = spark.createDataFrame([("d", "card", bytearray(card)), ("d", "plain", bytearray(plain)), ("d", "logo", bytearray(LOGO)), ("d", "junk", bytearray(b"?"))], "doc_id string, part string, payload binary")
    out = {r.part: pixels.decoded(bytes(r.payload)) for r in images.redacted_media(media, tools).collect()}
    assert set(out) == {"card", "plain", "logo"}
    assert (out["card"][11:17, 12:137] == 0).all() and (out["card"][60:68, 10:40] == 0).all()
    assert (out["plain"][60:68, 50:80] == 0).all() and (out["plain"][60:68, 10:40] == 255).all()
    assert len(np.unique(out["plain"][50:90, 300:340])) > 100
    assert set(r.part for r in images.redacted_media(media, images.ImageTools(), logos=False).collect()) == set()
    texts = images.image_text(images.plausible(images.words(media, tools)))
    assert [tuple(r) for r in verify.legible_secrets(texts, ("A@Corp.example.org", "nothing", " ")).collect()] == [("d", "plain", "a@corp.example.org")]
    assert cli.main([f"{folder}/in/a.docx", f"{folder}/plain", "--no-images"]) == 0
    with zipfile.ZipFile(folder / "plain/a.docx") as z:
        assert z.read("word/media/a.png") == LOGO


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_pixels_go_round(channels):
    draw = np.random.default_rng(channels)
    want = draw.integers(0, 256, (7, 9, channels), dtype=np.uint8)
    payload = pixels.encoded(want)
    assert pixels.size(payload) == (9, 7) and (pixels.decoded(payload) == want).all()
    assert pixels.size(pixels.blank(payload)) == (9, 7) and pixels.decoded(payload[:-30]) is None
    for kind in range(5):  # every row filter of the format
        rows, above = [], np.zeros(9 * channels, np.int64)
        for line in want.reshape(7, -1).astype(np.int64):
            left, corner = (np.r_[np.zeros(channels, np.int64), x[:-channels]] for x in (line, above))
            near = left + above - corner
            guesses = np.stack([left, above, corner])
            paeth = guesses[np.abs(near - guesses).argmin(0), np.arange(len(line))]
            rows.append([kind, *((line - (0, left, above, (left + above) // 2, paeth)[kind]) % 256)])
            above = line
        found = pixels._unfiltered(np.array(rows, np.uint8), channels)
        assert (found.reshape(want.shape) == want).all(), kind


def test_sizes_from_headers():
    assert pixels.size(b"GIF89a" + bytes([5, 0, 7, 0])) == (5, 7)
    assert pixels.size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x07\x00\x05\x01" + bytes(9)) == (5, 7)
    assert pixels.size(b"") is None and pixels.size(b"\xff\xd8\xff") is None and pixels.blank(b"?") is None and pixels.painted(b"?", []) is None


def test_text_regions_are_lines_of_print():
    page = np.full((200, 300), 255, np.uint8)
    for x in range(40, 160, 6):
        page[50:62, x : x + 3] = 0  # a line of strokes
    page[120:190, 200:290] = 0  # a block, too tall
    page[100:104, 20:24] = 0  # a speck
    found = pixels.text_regions(pixels.encoded(page[:, :, None]), images.MAX_HEIGHT, images.MAX_AREA)
    assert len(found) == 1
    left, top, right, bottom = found[0]
    assert abs(left - 40) < 4 and abs(right - 157) < 4 and abs(top - 50) < 4 and abs(bottom - 62) < 4


def test_code_regions_are_dense_squares(spark):
    page = np.full((200, 300), 230, np.uint8)
    cells = np.random.default_rng(4).integers(0, 2, (20, 20), dtype=np.uint8) * 255
    page[60:120, 100:160] = np.kron(cells, np.ones((3, 3), np.uint8))
    page[150:160, 20:200:7] = 0  # a line of strokes is no square
    payload = pixels.encoded(page[:, :, None])
    found = pixels.code_regions(payload)
    assert len(found) == 1 and all(abs(a - b) <= 8 for a, b in zip(found[0], (100, 60, 160, 120)))
    media = spark.createDataFrame([("d", "p", bytearray(payload))], "doc_id string, part string, payload binary")
    out = pixels.decoded(bytes(images.redacted_media(media, images.ImageTools()).first().payload))[:, :, 0]
    assert (out[60:120, 100:160] != page[60:120, 100:160]).mean() > 0.9 and (out[:40] == 230).all()
    assert pixels.code_regions(pixels.encoded(np.full((50, 50, 1), 9, np.uint8))) == [] == pixels.code_regions(b"?")


def test_streams(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.expr("timestamp_seconds(doc_id * 60)").alias("ts"))
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("spans", detect.detected(stream, wanted=("EMAIL_ADDRESS",)), "append"), ("windows", detect.counted(stream, "ts", wanted=("EMAIL_ADDRESS",)), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.processAllAvailable()
        query.stop()
    want = recognizers.detect(docs, wanted=("EMAIL_ADDRESS",)).count()
    assert spark.table("spans").count() == want and spark.table("windows").agg(F.sum("spans")).first()[0] == want


def test_rewrite_keeps_runs_and_bytes_of_untouched_parts():
    content = package(paragraph("Ann ", "Lee", " stays"), **{"word/styles.xml": b"<x/>"})
    new, hits = ooxml.rewritten(content, {"ann lee": "Bo"})
    assert hits == {"body": 1}
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.read("word/styles.xml") == b"<x/>"
        xml = z.read("word/document.xml").decode()
    assert xml.count("<w:r>") == 3 and xml.count("<w:b") >= 3 and ">Bo<" in xml and " stays" in xml
    same, none = ooxml.rewritten(content, {})
    assert none == {} and zipfile.ZipFile(io.BytesIO(same)).read("word/document.xml") == zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")


def test_names_in_capitals_are_read_in_title_case(spark):
    text = "TABLE OF CONTENTS LIMITED\nissued by ZENITH HARBOUR CEDAR LIMITED today\nTABLE OF CONTENTS LIMITED"
    job = RedactionJob(Config(recognizers=recognizers.NAME_RULES))
    found = job.detect(keyed(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert {(r.entity_type, r.text) for r in found} == {("ORGANIZATION", "ZENITH HARBOUR CEDAR LIMITED")}
    assert all(text[r.start : r.end] == r.text for r in found)


def test_synthetic_documents_are_exact(spark):
    docs = synthetic.documents(spark, 20, seed=3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = synthetic.annotations(docs).collect()
    assert len(marks) == 20 * len(synthetic.PLANTED) and all(texts[r.doc_id][r.start : r.end] == r.text for r in marks)
    out = RedactionJob().run(docs.select("doc_id", "text"))
    clean = {r.doc_id: r.text for r in out.texts.collect()}
    assert all(r.text not in clean[r.doc_id] for r in marks)
    assert all(synthetic.DECOYS.split(",")[0] in x for x in clean.values())


def test_painting_is_a_plug_in(spark):
    media = spark.createDataFrame([("d", "a", bytearray(b"x")), ("d", "b", bytearray(b"y"))], "doc_id string, part string, payload binary")
    boxes = spark.createDataFrame([("d", "a", 1, 2, 3, 4)], "doc_id string, name string, l int, t int, r int, b int")
    out = images.painted(media, boxes, images.ImageTools(paint=lambda x, b: x + repr(b).encode())).collect()
    assert [(r.part, bytes(r.payload)) for r in out] == [("a", b"x[(1, 2, 3, 4)]")]


#: Null, repeated and textual ids; repeated rows; null and empty texts.
MIXED = [
    (None, "write to bob@corp.example.org"),
    ("1", "first a@b.example.org row"),
    ("2", "one cara@x.example.org here"),
    ("2", "a much longer second row with cara@x.example.org and dan@y.example.org in it"),
    ("2", "one cara@x.example.org here"),
    ("a/7", "no address"),
    (None, "write to bob@corp.example.org"),
    (None, None),
    ("3", ""),
]


@pytest.mark.parametrize("job", [emails_only, redact, lambda t: redact(t, Config(corpus_scope=True))])
def test_rows_keep_their_own_spans_whatever_their_ids(spark, job):
    from veilspan.operators.recognizers import SWEEPS

    mail = re.compile(next(r.pattern for r in SWEEPS if r.entity_type == "EMAIL_ADDRESS"))
    got = job(spark.createDataFrame(MIXED, "doc_id string, text string").repartition(3)).collect()
    assert len(got) == len(MIXED)
    names = {}
    want = sorted((d or "-", mail.sub("@", x or "-"), len(mail.findall(x or ""))) for d, x in MIXED)
    assert sorted((r.doc_id or "-", mail.sub("@", r.text or "-"), r.replacements) for r in got) == want
    text = " ".join(r.text or "" for r in got)
    for gone in ("bob", "a@b", "cara", "dan@"):
        assert gone not in text
    for d, x in MIXED:
        for r in got:
            if r.doc_id == d and x and r.text and mail.sub("@", r.text) == mail.sub("@", x):
                for old, new in zip(mail.findall(x), mail.findall(r.text), strict=True):
                    names.setdefault(old, set()).add(new)
    assert all(len(v) == 1 for v in names.values()) and len(names) == 4


def test_rows_of_one_document_share_its_mapping_and_vocabulary(spark):
    rows = [(5, "Glossary\nBoard Lot means a fixed number"), (5, "met Mr. Asha Birch"), (6, "met Mr. Asha Birch")]
    out = RedactionJob(Config(recognizers=recognizers.NAME_RULES)).run(spark.createDataFrame(rows, "doc_id long, text string"))
    mapped = out.mapping.collect()
    assert sorted(r.doc_id for r in mapped) == [5, 6] and len({r.surrogate for r in mapped}) == 1
    assert {r.doc_id for r in out.detections.collect()} == {5, 6} and out.detections.select("row").distinct().count() == 2
