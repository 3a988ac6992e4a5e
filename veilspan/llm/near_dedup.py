"""Near-duplicate documents: MinHash, an inverted join on signature coordinates, exact links.

A document's set holds its distinct five-word shingles (lower-cased A-Z); with fewer words
its whole word sequence is the one shingle; without words the set is empty and linked with
nothing. Two documents are linked if 100 * |intersection| >= percent * |union|.

1. Every document gets its set's size, a 128-bit key of the set and K signature
   coordinates. Documents with equal sets are one class, kept by its smallest id.
2. Classes are posted under their coordinate values. Linked sets share at least T of K
   values but with probability MISS at most, so two such classes also meet in the K - T + 1
   rarest values of either: each class skips its T - 1 longest lists (prefix and skip
   merging), and classes with fewer than T shared values post nothing.
3. Collisions of a pair are counted on whole signatures; pairs with T or more, and sizes
   and sketches (the least hash of each of BINS ranges) that allow a link, are confirmed on
   full sets.
4. No list is ever expanded into its pairs. First each member meets the list's smallest
   one, which joins most of a group of copies; while comparing what is left would cost more than the
   lists are long, members meet one of their list's last component, STARS times at most. Lists that still hold several components are
   compared block by block, blocks being bounded in members and in shingles: a first pass keeps the members with a candidate in another
   component, a second holds those members' full sets side by side and returns only the
   links that join components. Together the passes see all candidates, so no link
   between different components is missed.

Nulls: a null text has the empty set; a row with a null id gets component null and is kept.
Rows that share an id are one document of the graph. An empty table gives an empty one.
Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.tables import partitions, small_batches, staged, table
from veilspan.llm.words import Words, mix, slices

WORDS = 5
K = 16
MISS = 1e-7  # most probable loss of a pair at the threshold itself
BLOCK = 1024  # members of a list that one task compares with as many others
BLOCK_SHINGLES = 1 << 20  # in the sets of a block's members, on average
STARS = 4
FILTER_BITS = 8  # of a filter over ids, for each id
MAX_FILTER = 1 << 27  # bits; more ids than it serves are joined instead
BINS = 256  # of a sketch, one byte each
SKETCH_MISS = 1e-9
_U = np.uint64
_SALT = mix(np.arange(K, dtype=_U) + _U(0x51ED))


def needed(k: int, similarity: float) -> int:
    """The most coordinate matches that linked sets reach but with probability MISS."""
    below, t = 0.0, 0
    while below + (p := math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)) <= MISS:
        below, t = below + p, t + 1
    return max(1, t)


def sketch_needed(similarity: float) -> np.ndarray:
    """By number of bins that either of two linked sets fills: equal ones they have but with SKETCH_MISS."""
    out = np.zeros(BINS + 1, np.int64)
    for n in range(1, BINS + 1):
        below, t = 0.0, 0
        while below + (p := math.comb(n, t) * similarity**t * (1 - similarity) ** (n - t)) <= SKETCH_MISS:
            below, t = below + p, t + 1
        out[n] = t
    return out


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's start and the last end."""
    words = Words(data, bounds, lower=True)
    h = words.hashes()
    grams, at = words.grams(n, hashes=h)
    edge = np.searchsorted(words.text[at], np.arange(len(bounds)))
    sets = []
    for i, count in enumerate(words.count.tolist()):
        if count >= n:
            sets.append(np.unique(grams[edge[i] : edge[i + 1]]))
        elif count:
            a = words.first[i]
            own = h[a : a + count] * (mix(np.arange(count, dtype=_U) + _U(99)) | _U(1))
            sets.append(mix(own.sum(dtype=_U, keepdims=True) + _U(count)))
        else:
            sets.append(grams[:0])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else grams[:0], np.concatenate([[0], np.cumsum(sizes)])


def _totals(values: np.ndarray, how: np.ufunc, edge: np.ndarray) -> np.ndarray:
    """how over each non-empty row of a flat array."""
    starts = edge[:-1][np.diff(edge) > 0]
    return how.reduceat(values, starts) if len(starts) else values[:0]


def signatures(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n, key_a, key_b (of the set), coords (null for an empty set) and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, text_column):
                flat, edge = shingle_sets(data, bounds)
                sizes = np.diff(edge)
                full = sizes > 0
                keys = np.zeros((2, len(sizes)), _U)
                for k in range(2):
                    keys[k, full] = _totals(mix(flat ^ _U(0xABCD << 16 * k)), np.add, edge)
                coords = np.zeros((len(sizes), K), _U)
                for k in range(K):
                    x = (flat ^ _SALT[k]) * _U(0xD6E8FEB86659FD93)
                    x ^= x >> _U(32)
                    x *= _U(0xCA5A826395121157)
                    coords[full, k] = _totals(x, np.minimum, edge) ^ _SALT[k]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * K, pa.int32()), pa.array(coords.reshape(-1).view(np.int64)))
                lists = pa.compute.if_else(pa.array(full), lists, pa.scalar(None, lists.type))
                text, bins = np.repeat(np.arange(len(sizes)), sizes), (flat >> _U(56)).astype(np.int64)
                least = np.r_[True, (text[1:] != text[:-1]) | (bins[1:] != bins[:-1])] if len(flat) else np.zeros(0, bool)
                sketch = np.zeros((len(sizes), BINS), np.uint8)
                sketch[text[least], bins[least]] = (flat[least] & _U(0xFFFF)) % _U(255) + _U(1)
                sketches = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS), len(sizes), [None, pa.py_buffer(sketch)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes), *(pa.array(x.view(np.int64)) for x in keys), lists, sketches], ["doc_id", "n", "key_a", "key_b", "coords", "sketch"])

    return df.select(id_column, text_column).mapInArrow(run, "doc_id long, n long, key_a long, key_b long, coords array<long>, sketch binary")


def shingle_rows(df: DataFrame, ids: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id and full set of the documents that ids (distinct ids) holds.

    A bitmap of hashed ids, up to 16 MB, keeps most other texts from being read into sets and moved; with more ids
    than that serves, the texts themselves are joined with them first.
    """
    n = ids.count()
    bits = 1 << max(16, (FILTER_BITS * n - 1).bit_length())
    if bits > MAX_FILTER:
        some = df.join(ids.withColumnRenamed("id", "_wanted"), F.col(id_column).cast("long") == F.col("_wanted"), "left_semi")
        return _filtered_sets(some, np.full(1 << 10, ~_U(0)), id_column, text_column)
    return _filtered_sets(df, bit_filter(ids, "id", bits), id_column, text_column).join(ids, "id", "left_semi")


def _filtered_sets(df: DataFrame, wanted: np.ndarray, id_column: str, text_column: str) -> DataFrame:
    """id and full set of the documents whose bit is set in wanted; some others pass too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy()
            some = batch.filter(pa.array((wanted[bit >> 6] >> (bit & 63).astype(_U)) & _U(1) == 1))
            for rows, data, bounds in slices(some, text_column):
                flat, edge = shingle_sets(data, bounds)
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["id", "shingles"])

    bits = df.select(id_column, text_column, F.pmod(F.xxhash64(F.col(id_column).cast("long")), F.lit(64 * len(wanted))).alias("bit"))
    return bits.mapInArrow(run, "id long, shingles array<long>")


def bit_filter(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap over hashed ids: what isn't in it isn't in ids."""
    bit = F.pmod(F.xxhash64(column), F.lit(bits))
    words = ids.select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64({column}), {bits}L), 64) as int))").alias("mask"))
    found = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out.view(_U)


def _fits(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids that are linked, by their full sets."""
    left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return both.where(shared * 100 >= union * percent).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes but the smallest of each component, by alternating large and small stars."""
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    mark = lambda x: tuple(x.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        if (now := mark(e)) == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _by_cell(handle: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """handle for each whole cell of rows sorted by key, lo, hi (the first three columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            if not len(batch):
                continue
            change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys])) + 1
            if rest and any(rest[-1].column(i)[-1].as_py() != keys[i][0] for i in range(3)):
                change = np.r_[0, change]
            at = 0
            for to in change.tolist():
                rest.append(batch.slice(at, to - at))
                if (out := handle(pa.concat_batches(rest))) is not None:
                    yield out
                rest, at = [], to
            rest.append(batch.slice(at))
        if rest and (out := handle(pa.concat_batches(rest))) is not None:
            yield out

    return run


def _candidates(t: int, percent: int):
    """For one cell: the members that have a candidate in another component.

    A pair that meets in several lists counts in the first of its common coordinates.
    """
    enough = sketch_needed(percent / 100)

    def alike(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs have sketches that allow a link."""
        ok = np.zeros(len(a), bool)
        for i in range(0, len(a), 50_000):
            x, y = sketch[a[i : i + 50_000]], sketch[b[i : i + 50_000]]
            ok[i : i + 50_000] = ((x == y) & (x > 0)).sum(1) >= enough[((x | y) > 0).sum(1)]
        return ok

    def handle(cell: pa.RecordBatch) -> pa.RecordBatch | None:
        if len(cell) < 2:
            return None
        side, comp, n, posted = (cell.column(i).to_numpy() for i in (3, 5, 6, 7))
        own = cell.column(8).flatten().to_numpy().reshape(len(cell), K)
        sketch = np.frombuffer(b"".join(cell.column(9).to_pylist()), np.uint8).reshape(len(cell), BINS)
        key, single = cell.column(0)[0].as_py(), cell.column(1)[0] == cell.column(2)[0]
        place = int(np.flatnonzero(own[0] == key)[0])
        rows, cols = (np.arange(len(cell)),) * 2 if single else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        keep = np.zeros(len(cell), bool)
        for a in range(0, len(rows), 256):
            r = rows[a : a + 256]
            same, earlier = np.zeros((len(r), len(cols)), np.uint8), np.zeros((len(r), len(cols)), bool)
            for k in range(K):
                equal = own[r, k][:, None] == own[cols, k][None, :]
                same += equal
                if k < place:
                    earlier |= equal & ((posted[r] >> k) & 1 == 1)[:, None] & ((posted[cols] >> k) & 1 == 1)[None, :]
            ok = (same >= t) & ~earlier & (comp[r][:, None] != comp[cols][None, :])
            ok &= (n[r][:, None] * 100 >= n[cols][None, :] * percent) & (n[cols][None, :] * 100 >= n[r][:, None] * percent)
            at, to = np.nonzero(ok)
            fit = alike(sketch, r[at], cols[to])
            keep[r[at[fit]]] = keep[cols[to[fit]]] = True
        if not keep.any():
            return None
        some = cell.filter(pa.array(keep))
        return pa.RecordBatch.from_arrays([some.column(i) for i in range(6)], ["key", "lo", "hi", "side", "rep", "comp"])

    return handle


def _joining_links(percent: int):
    """For one cell with full sets: links between components, until none joins two more."""

    def handle(cell: pa.RecordBatch) -> pa.RecordBatch | None:
        member, (_, comp) = cell.column(4).to_numpy(), np.unique(cell.column(5).to_numpy(), return_inverse=True)
        sizes = pa.compute.list_value_length(cell.column(6)).to_numpy()
        _, flat = np.unique(cell.column(6).flatten().to_numpy(), return_inverse=True)
        edge, mark = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(flat) + 1, np.int32)
        found = []
        for a in range(len(member)):
            if (comp == comp[a]).all():
                continue
            mark[flat[edge[a] : edge[a + 1]]] = 1
            shared = np.add.reduceat(mark[flat], edge[:-1])
            mark[flat[edge[a] : edge[a + 1]]] = 0
            linked = shared * 100 >= (sizes + sizes[a] - shared) * percent
            for b in np.flatnonzero(linked & (comp != comp[a])):
                if comp[b] != comp[a]:
                    found.append((member[a], member[b]))
                    comp[comp == comp[b]] = comp[a]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"]) if found else None

    return handle


def near_duplicates(df: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest linked id, itself included), kept."""
    with small_batches(df.sparkSession):
        return _near_duplicates(df, percent, id_column, text_column)


def _near_duplicates(df: DataFrame, percent: int, id_column: str, text_column: str) -> DataFrame:
    spark = df.sparkSession
    t = needed(K, percent / 100)
    signed = staged(signatures(df, id_column, text_column), "signatures")
    full = signed.where("n > 0 and doc_id is not null")
    classes = staged(full.groupBy("key_a", "key_b", "n").agg(F.min("doc_id").alias("rep"), F.first("coords").alias("coords"), F.first("sketch").alias("sketch")), "classes")

    posted = classes.select("rep", "n", F.posexplode("coords").alias("place", "key"))
    lengths = posted.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    shared = posted.join(lengths, "key").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("length", "key", "place"))).alias("lists"))
    shared = shared.where(F.size("lists") >= t).select("rep", "n", F.slice("lists", 1, F.size("lists") - (t - 1)).alias("lists"))
    places = F.aggregate("lists", F.lit(0), lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1), x["place"])))
    lists = staged(shared.withColumn("posted", places).select("rep", "n", "posted", F.explode("lists").alias("list")).select("list.key", "rep", "n", "posted"), "lists")
    sets = staged(shingle_rows(df, lists.select(F.col("rep").alias("id")).distinct(), id_column, text_column), "sets")

    info = classes.select("rep", "n", "coords", "sketch")
    heads = lists.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("length")).where("length > 1")

    def linked(star: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked, of those that share a list."""
        for x in "ab":
            star = star.join(info.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("coords").alias(f"coords_{x}")), x)
        matches = F.size(F.filter(F.zip_with("coords_a", "coords_b", lambda p, q: p == q), lambda z: z))
        return confirmed(star.where(_fits(F.col("n_a"), F.col("n_b"), percent) & (matches >= t)).select("a", "b"), sets, percent)

    star = lists.join(heads, "key").where("rep != head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    found = components(linked(star))
    for turn in range(STARS):
        placed = lists.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "posted", F.coalesce("component", "rep").alias("comp"))
        placed = staged(placed, "placed")
        sums = (F.count("*").alias("length"), F.sum("n").alias("shingles"), F.min("comp").alias("low"), F.max(F.struct("comp", "rep")).alias("high"))
        blocks = F.ceil(F.greatest(F.col("length") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
        open_ = staged(placed.groupBy("key").agg(*sums).where("low != high.comp").select("key", "high", "length", blocks), "open")
        rows, cost = open_.agg(F.sum("length"), F.sum(F.col("length") * F.col("blocks"))).first()
        if turn == STARS - 1 or not rows or cost < 2 * rows:
            break
        others = placed.join(open_.where("blocks > 1").select("key", "high"), "key").where("comp != high.comp")
        star = others.select(F.col("high.rep").alias("a"), F.col("rep").alias("b")).distinct()
        found = staged(_joined(found, linked(star)), "components")
    cells = placed.drop("n").join(open_.select("key", "blocks"), "key").join(info, "rep")
    cells = cells.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "comp", "n", "posted", "coords", "sketch")
    dealt = lambda df: df.repartition(partitions(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep")
    members = dealt(cells).mapInArrow(_by_cell(_candidates(t, percent)), "key long, lo int, hi int, side int, rep long, comp long")
    whole = members.join(sets.select(F.col("id").alias("rep"), "shingles"), "rep").select("key", "lo", "hi", "side", "rep", "comp", "shingles")
    links = staged(dealt(whole).mapInArrow(_by_cell(_joining_links(percent)), "a long, b long"), "links")
    found = staged(_joined(found, links), "components")

    rep = signed.join(classes.select("key_a", "key_b", "n", "rep"), ["key_a", "key_b", "n"], "left").withColumn("node", F.coalesce("rep", "doc_id"))
    out = rep.join(found, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (node, component) of found after more links (a, b)."""
    for x in "ab":
        links = links.join(found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")), x, "left").withColumn(x, F.coalesce(f"c_{x}", x)).drop(f"c_{x}")
    return _merged(found.select(F.col("node").alias("a"), F.col("component").alias("b")), components(links))


def _merged(stars: DataFrame, more: DataFrame) -> DataFrame:
    """Rows (node, component) after the components of stars were joined as more says."""
    to = more.withColumnRenamed("node", "b").withColumnRenamed("component", "root")
    moved = stars.join(to, "b", "left").select(F.col("a").alias("node"), F.coalesce("root", "b").alias("component"))
    return moved.unionByName(more).distinct()


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLE = {
    "op8_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS x FROM d, unnest(range(1, greatest(2, len(ws) - 3))) u(i) WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, d.doc_id = c AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = d.doc_id"""
}
