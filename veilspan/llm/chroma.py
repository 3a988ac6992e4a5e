"""Media columns: chroma fingerprints of audio, and alignment of recordings.

Audio (WAV, PCM of 8 or 16 bits, any channels) becomes frames of twelve pitch classes. Over their integral image
16 rectangular filters compare areas; each answer is cut at three levels into two
Gray-coded bits, so every frame gives one packed 32-bit integer. The levels are the
quartiles of the answers to a seeded random melody, a rule rather than a trained table.

Two recordings are aligned by the histogram of offsets between equal integers (a run of
one integer counts at its start). Every offset with MIN_VOTES, or with as many as the
recording with fewer runs can give, is then judged by the share of different bits over the
overlap, and the best one stands: the fullest may be a false one where recordings loop.

Recordings with equal fingerprints are one class. Matches are between classes, and every
row names its class, so copies are never expanded into pairs.

A null, broken or too short recording has no integers and matches nothing; it is a class
with the others of its kind. Repeated rows repeat; an empty table gives an empty one. A row
with a null id gets its class and, if it is asked, its matches; a recording that only such
rows hold has no class to be named by, and is no match of others.
"""

from __future__ import annotations

import functools
import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.tables import staged, table

RATE = 8000
FRAME = 1024
HOP = 256
NOTE = 512  # samples
LOW_HZ, HIGH_HZ = 80.0, 2000.0
FILTERS = tuple((i % 4, (5 * i) % 12, 2 + 2 * (i % 3), 2 + 2 * (i // 4)) for i in range(16))  # kind, lowest class, classes, frames
SPAN = max(w for *_, w in FILTERS)
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
MIN_VOTES = 3
MIN_OVERLAP = 16
MAX_BIT_ERROR = 0.25
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """Mono samples from -1 to 1 as a 16-bit WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def samples_of(media: bytes | None) -> np.ndarray:
    """Mono samples at RATE; none for what is no such WAV."""
    try:
        with wave.open(io.BytesIO(media or b""), "rb") as f:
            width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
            content = f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0)
    if width not in (1, 2):
        return np.zeros(0)
    x = (np.frombuffer(content, np.uint8) - 128.0) / 128 if width == 1 else np.frombuffer(content[: len(content) // 2 * 2], "<i2") / 32768
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1) if len(x) >= channels else np.zeros(0)
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)
    return x


@functools.cache
def _classes() -> np.ndarray:
    """Spectrum bins x pitch classes."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12))
    use = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    out[np.flatnonzero(use), np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12, smoothed over five frames, each of length one or silent."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    energy = power @ _classes()
    smooth = np.apply_along_axis(np.convolve, 0, energy, SMOOTH, "same") if n >= len(SMOOTH) else energy
    size = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(size > 1e-6, smooth / np.maximum(size, 1e-12), 0.0)


def answers(frames: np.ndarray) -> np.ndarray:
    """Answer of each filter at each frame that a whole span follows."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros((0, len(FILTERS)))
    area = np.zeros((len(frames) + 1, 25))
    area[1:, 1:] = np.cumsum(np.cumsum(np.tile(frames, 2), 0), 1)  # pitch classes go round
    t = np.arange(n)

    def box(t0: np.ndarray, t1: np.ndarray, y0: int, y1: int) -> np.ndarray:
        return area[t1, y1] - area[t0, y1] - area[t1, y0] + area[t0, y0]

    out = []
    for kind, y, h, w in FILTERS:
        mid, half = t + w // 2, y + h // 2
        whole = box(t, t + w, y, y + h)
        if kind == 0:
            a, b = whole, box(t, t + w, y + h, y + 12)
        elif kind == 1:
            a = box(t, t + w, y, half)
            b = whole - a
        elif kind == 2:
            a = box(t, mid, y, y + h)
            b = whole - a
        else:
            a = box(t, mid, y, half) + box(mid, t + w, half, y + h)
            b = whole - a
        out.append(np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0))))
    return np.stack(out, 1)


def melody(pitches: np.ndarray, note: int = NOTE, base: float = 220.0) -> np.ndarray:
    """Samples of one note after another, given in semitones over base."""
    hz = base * 2.0 ** (np.asarray(pitches) / 12)
    phase = np.cumsum(np.repeat(2 * np.pi * hz / RATE, note))
    return 0.5 * np.sin(phase) + 0.2 * np.sin(2 * phase)


@functools.cache
def _levels() -> np.ndarray:
    rng = np.random.default_rng(2012)
    return np.quantile(answers(chroma(melody(rng.integers(0, 24, 3000)))), (0.25, 0.5, 0.75), axis=0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    found = answers(chroma(samples))
    code = _GRAY[(found[None] > _levels()[:, None]).sum(0)]
    return (code << (2 * np.arange(len(FILTERS), dtype=np.uint32))).sum(1, dtype=np.uint32)


def fingerprints(df: DataFrame, id_column: str, media_column: str, to_media: Callable[[object], bytes | None] = lambda x: x) -> DataFrame:
    """id_column and print (array<long> of unsigned 32-bit integers) of each row.

    to_media makes the WAV bytes from the column's value, for columns that hold a recipe.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = batch.slice(at, 1000)
                found = [fingerprint(samples_of(to_media(x))).astype(np.int64) for x in rows.column(1).to_pylist()]
                edge = np.cumsum([0, *map(len, found)])
                prints = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
                yield pa.RecordBatch.from_arrays([rows.column(0), prints], [id_column, "print"])

    kind = dict(df.dtypes)[id_column]
    return df.select(id_column, media_column).mapInArrow(run, f"`{id_column}` {kind}, print array<long>")


def _postings(df: DataFrame, name: str) -> DataFrame:
    """class, value and place of every start of a run, and the recording's number of runs."""
    starts = F.filter(
        F.transform("print", lambda x, i: F.struct(x.alias("value"), i.alias("place"), ((i == 0) | (F.get("print", i - 1) != x)).alias("fresh"))),
        lambda x: x["fresh"],
    )
    rows = df.where("class_id IS NOT NULL").select(F.col("class_id").alias(name), starts.alias("starts")).select(name, F.size("starts").alias(f"{name}_runs"), F.explode("starts").alias("x"))
    return rows.select(name, f"{name}_runs", "x.value", F.col("x.place").alias(f"{name}_place"))


def _bit_error(a: Column, b: Column, offset: Column) -> Column:
    """Share of different bits where b, moved by offset, overlaps a."""
    n = F.least(F.size(a) - F.greatest(offset, F.lit(0)), F.size(b) + F.least(offset, F.lit(0)))
    x = F.slice(a, F.greatest(offset, F.lit(0)) + 1, n)
    y = F.slice(b, F.greatest(-offset, F.lit(0)) + 1, n)
    bits = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, z: s + z)
    return F.when(n >= MIN_OVERLAP, bits / (32.0 * n))


def matches(prints: DataFrame, is_query: Column, id_column: str) -> DataFrame:
    """Every row with its class, and a line for each class that a query row's recording aligns with.

    Columns: id_column, class_id (smallest id with an equal fingerprint), is_query,
    match_class, offset (frames by which the match starts later in the query), votes,
    bit_error. Rows without a match have nulls there.
    """
    rows = staged(prints.select(id_column, "print", F.xxhash64("print").alias("key_a"), F.hash("print").alias("key_b"), F.coalesce(is_query, F.lit(False)).alias("is_query")), "prints")
    keys = ["key_a", "key_b"]
    classes = staged(rows.groupBy(*keys).agg(F.min(id_column).alias("class_id"), F.first("print").alias("print"), F.max("is_query").alias("asked")), "recordings")
    named = rows.join(classes.select(*keys, "class_id"), keys)
    asked, every = classes.where("asked"), classes
    votes = _postings(asked, "q").join(_postings(every, "m"), "value").where("q != m")
    enough = F.least(F.lit(MIN_VOTES), F.min("q_runs"), F.min("m_runs"))
    votes = votes.groupBy("q", "m", (F.col("q_place") - F.col("m_place")).alias("offset")).agg(F.count("*").alias("votes"), enough.alias("enough"))
    top = votes.where("votes >= enough").drop("enough")
    for x in "qm":
        top = top.join(classes.select(F.col("class_id").alias(x), F.col("print").alias(f"print_{x}")), x)
    found = top.withColumn("bit_error", _bit_error(F.col("print_q"), F.col("print_m"), F.col("offset"))).where(F.col("bit_error") <= MAX_BIT_ERROR)
    best = Window.partitionBy("q", "m").orderBy("bit_error", F.desc("votes"), "offset")
    found = found.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    found = found.select(F.col("q").alias("class_id"), F.col("m").alias("match_class"), "offset", "votes", "bit_error", F.lit(True).alias("is_query"))
    return named.select(id_column, "class_id", "is_query").join(found, ["class_id", "is_query"], "left").select(id_column, "class_id", "is_query", "match_class", "offset", "votes", "bit_error")


def played(vector: list[float] | None) -> bytes | None:
    """A recording with a note for each number of a vector, higher for larger numbers."""
    if vector is None:
        return None
    x = np.nan_to_num(np.array([0.0 if v is None else v for v in vector]))
    return wav(melody(np.floor((np.clip(x, -1, 1) + 1) * 48) % 24))


def op9_chroma_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings played from `embeddings`; rows whose vec_id is divisible by 100 are asked against all."""
    prints = fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", played)
    return matches(prints, F.col("vec_id") % 100 == 0, "vec_id")


QUERIES = {"op9_chroma_match": op9_chroma_match}
ORACLE: dict[str, str] = {}
