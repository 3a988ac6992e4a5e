"""Images: the relational parts, and the interface for readers, detectors and painters.

Character recognition and code and face detection need libraries that may be absent; they are plugged
in as functions. Sizes, painting, blanking and text regions come from `pixels` unless something else is plugged in. What is relational about images (line bands, plausibility, card
markers, spans to words, merging of boxes) is done in DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions import spans
from veilspan.operators import policy
from veilspan.operators import recognizers as rec
from veilspan.sources import pixels

MIN_CONFIDENCE = 30
MAX_HEIGHT, MAX_AREA = 0.12, 0.05  # of the image: larger "words" are artefacts
CARD_MARKERS_NEEDED = 2
# Words on identity cards, and the fields printed on them.
CARD_MARKERS = (
    "aadhaar", "aadhar", "uidai", "unique identification", "income tax department", "permanent account number",
    "govt. of india", "government of india", "भारत सरकार", "आधार", "आयकर", "पहचान", "date of birth", "father", "जन्म",
    "पिता",
)
CARD_FIELDS = (
    r"(?<![A-Za-z0-9_])[2-9]\d{3}\s?\d{4}\s?\d{4}(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])[A-Z]{5}\d{4}[A-Z](?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}(?![A-Za-z0-9_])",
    r"(?i)(?:name|father|पिता|नाम)\s*[:\-]?\s*.{2,40}",
    r"(?i)(?:dob|date of birth|जन्म)\s*[:\-]?\s*\S+",
    r"(?i)(?:address|पता)\s*[:\-]?\s*.{2,80}",
    r"(?<![A-Za-z0-9_])\d{6}(?![A-Za-z0-9_])",
)
WORDS = "doc_id string, name string, block int, par int, line int, word_no int, text string, conf double, l int, t int, r int, b int, width int, height int"
FINDINGS = "doc_id string, name string, kind string, l int, t int, r int, b int, detail string"


@dataclass
class ImageTools:
    """Plug-ins. read: words; detect: by kind (`code`, `face`), boxes; without them nothing is found. paint: new bytes
    from boxes (l, t, r, b, kind), None if it can't; size: width and height, None if unknown; blank: an empty image.
    """

    read: Callable[[bytes], list[dict]] | None = None
    detect: dict[str, Callable[[bytes], list[tuple[int, int, int, int]]]] = field(default_factory=dict)
    paint: Callable[[bytes, list[tuple]], bytes | None] = pixels.painted
    size: Callable[[bytes], tuple[int, int] | None] = pixels.size
    blank: Callable[[bytes], bytes | None] = pixels.blank


def words(media: DataFrame, tools: ImageTools) -> DataFrame:
    """One row per recognised word of media (doc_id, part, payload)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in WORDS.split(", ")]
        for batch in batches:
            rows = [{"doc_id": d, "name": p, **w} for d, p, x in zip(batch["doc_id"], batch["part"], batch["payload"], strict=True) for w in (tools.read(x) if tools.read else [])]
            yield pd.DataFrame(rows, columns=names)

    return media.select("doc_id", "part", "payload").mapInPandas(run, WORDS)


def plausible(found: DataFrame) -> DataFrame:
    h, area = F.col("b") - F.col("t"), (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))
    return found.where((h > 0) & (F.col("r") > F.col("l")) & (F.col("conf") >= MIN_CONFIDENCE) & (h <= MAX_HEIGHT * F.col("height")) & (area <= MAX_AREA * F.col("width") * F.col("height")))


def line_bands(found: DataFrame) -> DataFrame:
    keys = ["doc_id", "name", "block", "par", "line"]
    return found.groupBy(*keys).agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))


def image_text(found: DataFrame) -> DataFrame:
    """doc_id, name, text and words with their offsets in it, for the span operators."""
    order = F.sort_array(F.collect_list(F.struct("block", "par", "line", "word_no", "text", "l", "t", "r", "b")))
    lists = found.groupBy("doc_id", "name").agg(order.alias("w"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,l:int,t:int,r:int,b:int>>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["text"]) + 1).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("start"), (s["at"] + F.length(x["text"])).alias("end"), x["l"], x["t"], x["r"], x["b"]).cast("struct<start:int,end:int,l:int,t:int,r:int,b:int>")).alias("out"))
    return lists.select("doc_id", "name", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), F.aggregate("w", zero, step)["out"].alias("words"))


def cards(texts: DataFrame) -> DataFrame:
    """doc_id, name of images with enough identity-card markers."""
    hits = F.size(F.filter(F.array(*[F.lit(m) for m in CARD_MARKERS]), lambda m: F.contains(F.lower("text"), m)))
    return texts.where(hits >= CARD_MARKERS_NEEDED).select("doc_id", "name")


def card_spans(texts: DataFrame) -> DataFrame:
    """doc_id, name, start, end, entity_type of the printed fields of identity cards."""
    on_cards = texts.join(cards(texts), ["doc_id", "name"], "left_semi")
    every = F.concat(*[spans.scan(F.col("text"), p) for p in CARD_FIELDS])
    return on_cards.select("doc_id", "name", F.explode(every).alias("s")).select("doc_id", "name", "s.start", "s.end", F.lit("CARD_FIELD").alias("entity_type"))


def sensitive_words(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Boxes of the words that a span (doc_id, name, start, end, entity_type) meets."""
    w = texts.select("doc_id", "name", F.explode("words").alias("w"))
    s = found.select("doc_id", "name", F.col("start").alias("_a"), F.col("end").alias("_b"), "entity_type")
    met = w.join(s, ["doc_id", "name"]).where((F.col("w.start") < F.col("_b")) & (F.col("w.end") > F.col("_a")))
    return met.select("doc_id", "name", F.lit("text").alias("kind"), "w.l", "w.t", "w.r", "w.b", F.col("entity_type").alias("detail"))


def merged_boxes(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Boxes that overlap become their bounding box, until none do."""
    out = sorted(set(boxes))
    while True:
        for i, a in enumerate(out):
            j = next((j for j in range(i + 1, len(out)) if a[0] < out[j][2] and out[j][0] < a[2] and a[1] < out[j][3] and out[j][1] < a[3]), None)
            if j is not None:
                b = out.pop(j)
                out[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                break
        else:
            return out


def merge_boxes(findings: DataFrame) -> DataFrame:
    """doc_id, name, l, t, r, b: disjoint boxes of each image."""

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        boxes = merged_boxes(list(rows[["l", "t", "r", "b"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(*keys, *x) for x in boxes], columns=["doc_id", "name", "l", "t", "r", "b"])

    return findings.groupBy("doc_id", "name").applyInPandas(run, "doc_id string, name string, l int, t int, r int, b int")


def objects(media: DataFrame, tools: ImageTools) -> DataFrame:
    """Findings of the plugged-in detectors (codes, faces)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FINDINGS.split(", ")]
        for batch in batches:
            rows = [(d, p, kind, *box, "") for d, p, x in zip(batch["doc_id"], batch["part"], batch["payload"], strict=True) for kind, f in tools.detect.items() for box in f(x)]
            yield pd.DataFrame(rows, columns=names)

    return media.select("doc_id", "part", "payload").mapInPandas(run, FINDINGS)


def _shapes(media: DataFrame, kind: str, detail: str, find: Callable[[bytes], list[tuple[int, int, int, int]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FINDINGS.split(", ")]
        for batch in batches:
            rows = [(d, p, kind, *box, detail) for d, p, x in zip(batch["doc_id"], batch["part"], batch["payload"], strict=True) for box in find(x)]
            yield pd.DataFrame(rows, columns=names)

    return media.select("doc_id", "part", "payload").mapInPandas(run, FINDINGS)


def text_regions(media: DataFrame) -> DataFrame:
    """Findings of lines of print by shape, whether or not they can be read."""
    return _shapes(media, "text", "unread", lambda x: pixels.text_regions(x, MAX_HEIGHT, MAX_AREA))


def code_regions(media: DataFrame) -> DataFrame:
    """Findings of matrix codes by shape, whether or not they can be decoded (I8)."""
    return _shapes(media, "code", "by shape", pixels.code_regions)


def findings(media: DataFrame, tools: ImageTools, recognizers: tuple = rec.DEFAULT) -> DataFrame:
    """doc_id, name, kind, l, t, r, b, detail: what to cover in each image, in the order text, codes, faces.

    Words of private spans are covered; on identity cards the printed fields, every line and every region of print.
    """
    keys, box = ("doc_id", "name"), ("l", "t", "r", "b")
    found = plausible(words(media, tools))
    texts = image_text(found)
    spotted = rec.detect(texts, keys=keys, recognizers=recognizers)
    private = spotted.where(policy.decision(F.col("entity_type"), F.col("text")).isNull()).select(*keys, "start", "end", "entity_type")
    on_words = sensitive_words(texts, private.unionByName(card_spans(texts)))
    owned = cards(texts)
    bands = line_bands(found).join(owned, list(keys), "left_semi").select(*keys, F.lit("text").alias("kind"), *box, F.lit("card").alias("detail"))
    regions = text_regions(media.join(owned.withColumnRenamed("name", "part"), ["doc_id", "part"], "left_semi")).select(*on_words.columns)
    shaped = code_regions(media).select(*on_words.columns)
    return on_words.unionByName(bands).unionByName(regions).unionByName(shaped).unionByName(objects(media, tools).select(*on_words.columns))


def redacted_media(media: DataFrame, tools: ImageTools, logos: bool = True, recognizers: tuple = rec.DEFAULT) -> DataFrame:
    """doc_id, part, payload, regions: the images that change. media: doc_id, part, payload.

    An image with findings is painted over; of the others a small graphic is blanked as a probable logo (with
    logos). An image that can't be painted or blanked here stays as it is and is not returned.
    """
    found = findings(media, tools, recognizers)
    lists = found.groupBy("doc_id", F.col("name").alias("part")).agg(F.collect_set(F.struct("l", "t", "r", "b", "kind")).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, p, x, boxes in zip(batch["doc_id"], batch["part"], batch["payload"], batch["boxes"], strict=True):
                if boxes is not None and len(boxes):
                    by_kind = {k: merged_boxes([tuple(int(b[c]) for c in ("l", "t", "r", "b")) for b in boxes if (b["kind"] == "code") == (k == "code")]) for k in ("text", "code")}
                    new, n = tools.paint(x, [(*b, k) for k, v in by_kind.items() for b in v]), len(boxes)
                else:
                    new, n = tools.blank(x) if logos and is_logo(x, tools) else None, 1
                if new is not None:
                    out.append((d, p, new, n))
            yield pd.DataFrame(out, columns=["doc_id", "part", "payload", "regions"])

    both = media.select("doc_id", "part", "payload").join(lists, ["doc_id", "part"], "left")
    return both.mapInPandas(run, "doc_id string, part string, payload binary, regions int")


def painted(media: DataFrame, boxes: DataFrame, tools: ImageTools) -> DataFrame:
    """doc_id, part, payload of the images that have boxes, painted over by the plug-in."""
    lists = boxes.groupBy("doc_id", F.col("name").alias("part")).agg(F.collect_list(F.array("l", "t", "r", "b")).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = [y if (y := tools.paint(x, [tuple(map(int, z)) for z in b])) is not None else x for x, b in zip(batch["payload"], batch["boxes"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "part": batch["part"], "payload": new})

    return media.join(lists, ["doc_id", "part"]).select("doc_id", "part", "payload", "boxes").mapInPandas(run, "doc_id string, part string, payload binary")


def is_logo(payload: bytes, tools: ImageTools, max_pixels: int = 400_000) -> bool:
    """A small graphic; an image of unknown size is none."""
    shape = tools.size(payload)
    return shape is not None and shape[0] * shape[1] <= max_pixels
