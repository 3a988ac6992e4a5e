"""Pixels without an image library: sizes, PNG reading and writing, painting, blanking, text regions.

PNG with 8 bits a channel and no interlacing is read and written here; other formats only
by Pillow, where it is installed. What can't be read has no pixels (None), so callers leave it as it is.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections import defaultdict

import numpy as np

try:
    from PIL import Image
except ImportError:  # an optional library
    Image = None

# The format, what a line of print and a matrix code look like, and the colours of an empty image.
PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
GRADIENT, CLOSING = (3, 3), (18, 3)  # width, height of the kernels
LEAST_WIDTH, LEAST_HEIGHT, LEAST_ASPECT, LEAST_INK = 18, 8, 1.2, 0.08
CODE_KERNEL, CODE_STEP, CODE_SIDE, CODE_SHARE, CODE_ASPECT, CODE_AREA, CODE_DENSITY = (11, 11), 50, 24, 0.06, (0.80, 1.25), 0.30, 0.18
GREY, FRAME = 235, 170


def size(payload: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, BMP or JPEG."""
    if payload[:8] == PNG and len(payload) >= 24:
        return struct.unpack(">II", payload[16:24])
    if payload[:4] == b"GIF8" and len(payload) >= 10:
        return struct.unpack("<HH", payload[6:10])
    if payload[:2] == b"BM" and len(payload) >= 26:
        width, height = struct.unpack("<ii", payload[18:26])
        return width, abs(height)
    at = 2 if payload[:2] == b"\xff\xd8" else len(payload)
    while at + 9 <= len(payload):
        kind, length = payload[at + 1], int.from_bytes(payload[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", payload[at + 5 : at + 9])
            return width, height
        at += 2 + length
    return None


def _chunks(payload: bytes):
    at = 8
    while at + 8 <= len(payload):
        n = int.from_bytes(payload[at : at + 4], "big")
        yield payload[at + 4 : at + 8], payload[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(data: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG without their filters; data: rows x (1 + bytes)."""
    out = np.zeros((len(data), data.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, row in enumerate(data):
        kind, line = row[0], row[1:].copy()
        if kind == 2:
            line += above
        elif kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind:
            for x in range(len(line)):
                left = int(line[x - step]) if x >= step else 0
                up, corner = int(above[x]), int(above[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    near = left + up - corner
                    guess = min((abs(near - left), 0, left), (abs(near - up), 1, up), (abs(near - corner), 2, corner))[2]
                line[x] = (int(line[x]) + guess) & 255
        out[y] = above = line
    return out


def decoded(payload: bytes) -> np.ndarray | None:
    """height x width x channels (1 grey, 2 with alpha, 3 colour, 4 with alpha), or None."""
    if payload[:8] != PNG:
        if Image is None:
            return None
        try:
            return np.asarray(Image.open(io.BytesIO(payload)).convert("RGB")).copy()
        except OSError:
            return None
    palette, parts, shape = None, [], None
    for name, body in _chunks(payload):
        if name == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            parts.append(body)
    if shape is None or shape[2] != 8 or shape[6] or shape[3] not in CHANNELS:
        return None
    width, height, step = shape[0], shape[1], CHANNELS[shape[3]]
    try:
        data = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * step)
    except (zlib.error, ValueError):
        return None
    out = _unfiltered(data, step).reshape(height, width, step)
    return palette[out[:, :, 0]] if shape[3] == 3 and palette is not None else out


def encoded(pixels: np.ndarray, like: bytes = PNG) -> bytes | None:
    """A PNG, or the format of like by Pillow; None where that is not at hand."""
    if like[:8] != PNG:
        if Image is None:
            return None
        out = io.BytesIO()
        Image.fromarray(pixels).save(out, format=Image.open(io.BytesIO(like)).format)
        return out.getvalue()
    height, width, step = pixels.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[step]

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * step)], 1)
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def blank(payload: bytes) -> bytes | None:
    """A framed grey image of the same size and format."""
    shape = size(payload)
    if shape is None:
        return None
    out = np.full((shape[1], shape[0], 3), GREY, np.uint8)
    out[[0, -1]] = out[:, [0, -1]] = FRAME
    return encoded(out, payload)


def painted(payload: bytes, boxes: list[tuple], margin: int = 2) -> bytes | None:
    """Boxes (l, t, r, b, kind) covered: codes by noise, which leaves nothing to correct, all else by black."""
    pixels = decoded(payload)
    if pixels is None:
        return None
    height, width, step = pixels.shape
    noise = np.random.default_rng(zlib.crc32(payload))
    for left, top, right, bottom, *kind in boxes:
        part = pixels[max(0, top - margin) : min(height, bottom + margin), max(0, left - margin) : min(width, right + margin)]
        if kind and kind[0] == "code":
            part[:] = noise.integers(0, 256, part.shape[:2])[:, :, None]
        else:
            part[:] = 0
        if step in (2, 4):
            part[:, :, -1] = 255
    return encoded(pixels, payload)


def _spread(x: np.ndarray, kernel: tuple[int, int], how: np.ufunc, edge: int) -> np.ndarray:
    """how over a window of width x height around each pixel."""
    for axis, n in ((1, kernel[0]), (0, kernel[1])):
        before = n // 2
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before, n - 1 - before)
        x = how.reduce(np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, constant_values=edge), n, axis=axis), axis=2)
    return x


def _threshold(grey: np.ndarray) -> int:
    """The level that parts dark and light with the largest variance between them."""
    counts = np.bincount(grey.reshape(-1), minlength=256).astype(float)
    below, total = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (total / below - (total[-1] - total) / above) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def _blobs(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of the connected (also by corners) parts of a mask, from its runs in each row."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    runs, before = [], []
    for y, row in enumerate(np.pad(mask, [(0, 0), (1, 1)]).astype(np.int8)):
        step, now = np.diff(row), []
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            i = len(parent)
            parent.append(i)
            for c, d, j in before:
                if a <= d and c <= b:
                    parent[root(i)] = root(j)
            now.append((a, b, i))
            runs.append((a, b, y, i))
        before = now
    boxes: dict[int, list[int]] = defaultdict(lambda: [1 << 30, 1 << 30, 0, 0])
    for a, b, y, i in runs:
        box = boxes[root(i)]
        box[:] = min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y + 1)
    return sorted(tuple(x) for x in boxes.values())


def _grey(pixels: np.ndarray) -> np.ndarray:
    return pixels[:, :, 0] if pixels.shape[2] < 3 else (pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def code_regions(payload: bytes) -> list[tuple[int, int, int, int]]:
    """Boxes of square, densely modulated blocks, as matrix codes are, whether or not they can be decoded."""
    pixels = decoded(payload)
    if pixels is None or not pixels.size:
        return []
    grey = _grey(pixels).astype(np.int16)
    height, width = grey.shape
    edges = np.zeros(grey.shape, bool)
    edges[:, 1:] = np.abs(np.diff(grey, axis=1)) >= CODE_STEP
    edges[1:] |= np.abs(np.diff(grey, axis=0)) >= CODE_STEP
    closed = _spread(_spread(edges, CODE_KERNEL, np.logical_or, 0), CODE_KERNEL, np.logical_and, 1)
    side, out = max(CODE_SIDE, int(min(height, width) * CODE_SHARE)), []
    for left, top, right, bottom in _blobs(_spread(closed, CODE_KERNEL, np.logical_or, 0)):
        w, h = right - left, bottom - top
        if w >= side and h >= side and CODE_ASPECT[0] * h <= w <= CODE_ASPECT[1] * h and w * h <= CODE_AREA * height * width and edges[top:bottom, left:right].mean() >= CODE_DENSITY:
            out.append((left, top, right, bottom))
    return out


def text_regions(payload: bytes, max_height: float, max_area: float) -> list[tuple[int, int, int, int]]:
    """Boxes of lines of print by their shape, in any script: strokes have steep gradients, and a wide closing joins a line's letters."""
    pixels = decoded(payload)
    if pixels is None or not pixels.size:
        return []
    grey = _grey(pixels)
    steep = _spread(grey, GRADIENT, np.maximum, 0) - _spread(grey, GRADIENT, np.minimum, 255)
    ink = steep > _threshold(steep)
    joined = _spread(_spread(ink, CLOSING, np.logical_or, 0), (CLOSING[0], CLOSING[1]), np.logical_and, 1)
    height, width = grey.shape
    out = []
    for left, top, right, bottom in _blobs(joined):
        w, h = right - left, bottom - top
        if w >= LEAST_WIDTH and LEAST_HEIGHT <= h <= max_height * height and w * h <= max_area * width * height and w >= LEAST_ASPECT * h and ink[top:bottom, left:right].mean() >= LEAST_INK:
            out.append((left, top, right, bottom))
    return out
