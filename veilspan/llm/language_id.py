"""Language identification with error-correcting output codes.

Every language gets a codeword of +-1; each of its places is a binary problem (languages
with +1 against those with -1) for a classifier over hashed byte trigrams. Up to five languages get
the exhaustive code (all splits), more get seeded random words of CODE_BITS or more places.
A text's bits are decoded by loss: the language whose codeword has the least weighted
logistic loss wins, a place weighing as its classifier does on the training sample. If the
two best languages are closer than AMBIGUOUS the row is flagged.

Training uses at most SAMPLE documents of a language (those with the smallest seeded
hashes, by a threshold from their count), with whole texts. Trigrams see A-Z lower-cased,
upper-case Latin-1 letters lower-cased, and all other ASCII as one separator, so symbols,
digits and spacing do not matter.

Prediction never reads language, source or id. A text that is null or has no letter (in the Unicode
sense) is `und` with score 0. Rows repeat as in the input; an empty table gives an empty
one; with no labelled row everything is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.tables import table
from veilspan.llm.words import slices

SAMPLE = 5_000
MAX_LANGS = 512
DIMS = 1 << 15
CODE_BITS = 15
AMBIGUOUS = 0.1
TRAIN_PARTITIONS = 16
SHARPNESS = 3.0  # of a document's mean log-odds before the logistic loss
_FOLD = np.full(128, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD = np.concatenate([_FOLD, np.arange(128, 256, dtype=np.uint8)])
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, and where each text's start and the last end."""
    x = _FOLD[data]
    capital = np.zeros(len(x), bool)
    if len(x):
        capital[1:] = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)
        x = np.where(capital, x + 32, x).astype(np.uint32)
    n = len(x)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    use = np.ones(n - 2, bool)
    inner = bounds[1:-1]
    for back in (1, 2):
        at = inner - back
        use[at[(at >= 0) & (at < n - 2)]] = False
    use &= ~((x[:-2] == 32) & (x[1:-1] == 32))  # separators count once
    count = np.concatenate([[0], np.cumsum(use)])
    return h[use].astype(np.int64) % DIMS, count[np.minimum(bounds, n - 2)]


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n distinct codewords of +-1 in rows; no place is the same for all."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 5:
        return np.array([[1] * n] if n < 2 else [[1 if i == 0 or not (m >> (i - 1)) & 1 else -1 for i in range(n)] for m in range(1, 1 << (n - 1))]).T.astype(float)
    rng, bits = np.random.default_rng(seed), max(CODE_BITS, int(np.ceil(10 * np.log2(n))))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x places
    weights: np.ndarray  # places x DIMS
    trust: np.ndarray  # of each place

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share in the softmax of negative losses, and whether it is ambiguous."""
        loss = np.stack([np.logaddexp(0, -margins * c) @ self.trust for c in self.code], 1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, 1)
        near = order[:, -1] - order[:, -2] < AMBIGUOUS if share.shape[1] > 1 else np.zeros(len(share), bool)
        return loss.argmin(1), share.max(1), near

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        grams, edge = trigrams(data, bounds)
        out, n = np.zeros((len(bounds) - 1, len(self.weights))), np.diff(edge)
        some = n > 0
        for k, w in enumerate(self.weights):
            if some.any():
                out[some, k] = np.add.reduceat(w[grams], edge[:-1][some]) / n[some]
        return out * SHARPNESS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for rows, data, bounds in slices(batch):
            grams, edge = trigrams(data, bounds)
            for i, lang in enumerate(rows.column(0).to_pylist()):
                found = total.setdefault(lang, np.zeros(DIMS, np.int64))
                found += np.bincount(grams[edge[i] : edge[i + 1]], minlength=DIMS)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lang", "counts"])


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist())
    return pa.table([rows.column("lang").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["lang", "counts"])


def fit(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows of df that have a language.

    More than MAX_LANGS different values are no languages: they raise, so neither they nor their counts flood the driver.
    """
    rows = df.where(F.col(lang_column).isNotNull()).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.col(id_column).alias("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}  # a row for each language
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"{lang_column} has more than {MAX_LANGS} different values")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros((0, DIMS)), np.zeros(0))
    share = F.create_map(*[F.lit(y) for x in langs for y in (x, min(1.0, sample / sizes[x]))])
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(11), "id"), 11) / F.lit(float(1 << 53))
    some = rows.where(unit < share[F.col("lang")]).select("lang", "text").repartition(TRAIN_PARTITIONS)
    found = some.mapInArrow(_counted, "lang string, counts binary").groupBy("lang").applyInArrow(_added, "lang string, counts binary").collect()
    counts = {r["lang"]: np.frombuffer(r["counts"], np.int64).astype(float) for r in found}
    p = np.stack([(x := counts.get(k, np.zeros(DIMS)) + 0.5) / x.sum() for k in langs])
    code = codewords(len(langs))
    weights, trust = np.zeros((code.shape[1], DIMS), np.float32), np.zeros(code.shape[1])
    for k in range(code.shape[1]):
        up, down = p[code[:, k] > 0].mean(0), p[code[:, k] < 0].mean(0)
        weights[k] = np.log(up / down)
        mean = p @ weights[k] * code[:, k]  # expected margin of each language, on its own side
        trust[k] = 1 / (1 + np.exp(-SHARPNESS * mean)).mean() if (mean > 0).all() else 0.5
    return Model(langs, code, weights, trust / max(trust.sum(), 1e-9) * len(trust))


def _lettered(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts have a letter."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = seen[bounds[1:]] > seen[bounds[:-1]]
    for i in np.flatnonzero(~out & (np.diff(bounds) > 0)):
        out[i] = any(c.isalpha() for c in data[bounds[i] : bounds[i + 1]].tobytes().decode())
    return out


def predictions(model: Model, data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    if not model.langs:
        n = len(bounds) - 1
        return ["und"] * n, np.zeros(n), np.zeros(n, bool)
    best, score, near = model.decode(model.margins(data, bounds))
    some = _lettered(data, bounds)
    return [model.langs[k] if ok else "und" for k, ok in zip(best, some)], np.where(some, score, 0.0), near & some


def identify(df: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The named columns of each row, then lang_pred, score and ambiguous."""
    kinds = dict(df.dtypes)
    read = text_column if text_column in columns else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, read):
                lang, score, near = predictions(model, data, bounds)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], pa.array(lang, pa.string()), pa.array(score), pa.array(near)], [*columns, "lang_pred", "score", "ambiguous"])

    shape = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", lang_pred string, score double, ambiguous boolean"
    return df.select(*columns, *([] if text_column in columns else [F.col(text_column).alias("_text")])).mapInArrow(run, shape)


def held_out(id_column: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op10_language_id": op10_language_id}
ORACLE: dict[str, str] = {}
