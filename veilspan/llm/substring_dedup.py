"""Removal of repeated passages with prefix-partitioned suffix trees over words.

A word is [^\\x20\\x09-\\x0D]+, unchanged. A window is `window` consecutive words of one
document. Every word in a window whose word sequence also starts earlier (smaller
doc_id, or same document and earlier start) is removed; windows are judged on the input.

Suffixes are cut at `window` words, the least length of a repeat, as in a truncated suffix tree: its
internal nodes of that depth are the repeats, and a longer maximal repeat is a row of them whose
leaves move on together. A suffix's label is its first LETTERS words (16 bits of each word's hash, in
their order) and, for the path below, 80 bits of two hashes of all its words. Documents
are dealt once into blocks of some MB, a table bucketed by block, and the trees are built in three passes over it:

1. Census. Of each window a block notes the least hash among its half-window sequences;
   equal windows have equal least hashes. Values seen at one place only, in all blocks,
   belong to branches with one leaf and are pruned. A bounded sample of labels is taken too.
2. Trees. The sample's quantiles cut the order of suffixes into groups that fit a worker's memory. A cut is
   the shortest run of first words that parts its neighbours: one word where that is enough, more
   below prefixes that many suffixes share, and the path's hash below the last letter. So a group holds
   whole subtrees whose roots are prefixes of several lengths. A block sends each group its distinct
   suffixes, sorted, with the smallest place of each. In a group they are merged, the lengths of the common
   prefixes of neighbours give the internal nodes, and the leaves of a deep node but the earliest go back
   marked, with the earliest's place where it is asked for.
3. Removal. Each block marks the words below marked leaves and writes what is kept, and the maximal repeats.

A passage that a block repeats is sent once, so no group grows with the number of copies within blocks.

Defined cases: a null text has no words; a null id sorts first; rows that share an id (null ids too) are
ordered by text and count as one after the other; an empty table gives an empty one. Only
the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.tables import fresh_path, partitions, short_scans, staged, table
from veilspan.llm.words import Words, mix, raw, rolled

WINDOW = 20
BLOCK_BYTES = 6 << 20  # of text in a block, on average
BUCKET_BYTES = 64 << 20  # of text in a file of blocks, on average
MAX_BUCKETS = 100_000
ROW_GROUP_BYTES = 2 << 20  # of a file of blocks; a task holds one when it writes, and decodes no more at once when it reads
GROUP_SUFFIXES = 4_000_000  # a worker's memory holds so many suffixes of a group
LETTERS = 3  # words that stand in a label themselves; 16 bits are left for the path
SAMPLE = 1 << 18  # labels that the cuts are chosen from, as expected; they set sizes of groups, never results
_TABLE_BITS = 22
_U = np.uint64
NULL_ID = -(1 << 63)
_LABEL = (("letters", _U), ("path", _U), ("ids", np.int64), ("at", np.int32))


def _slide(x: np.ndarray, n: int, how: np.ufunc) -> np.ndarray:
    """how over x[i:i+n]; spans that leave x end with it."""
    out, width = x.copy(), 1
    while width < min(n, len(x)):
        step = min(width, n - width, len(x) - width)
        out[: len(out) - step] = how(out[: len(out) - step], out[step:])
        width += step
    return out


def letters_of(hashes: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The first LETTERS words of each suffix, 16 bits each, the first one highest; the lowest 16 bits are free."""
    out = np.zeros(len(at), _U)
    for k in range(min(LETTERS, window)):
        out |= (hashes[at + k] >> _U(48)) << _U(48 - 16 * k)
    return out


def common_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first letters are equal."""
    differ = a ^ b
    return sum(((differ >> _U(48 - 16 * k)) == 0).astype(np.int64) for k in range(LETTERS))


def lcp(letters: np.ndarray, path: np.ndarray, window: int) -> np.ndarray:
    """Common words of each sorted suffix and the one before it: up to LETTERS, or the window if the paths are equal."""
    out = np.zeros(len(letters), np.int64)
    out[1:] = common_letters(letters[1:], letters[:-1])
    out[1:][(letters[1:] == letters[:-1]) & (path[1:] == path[:-1])] = window
    return out


def nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last leaf (exclusive) of each internal node at a depth of a sorted subtree, from its leaves' common prefixes."""
    deep = np.r_[False, common[1:] >= depth, False] if len(common) else np.zeros(1, bool)
    return np.flatnonzero(~deep[:-1] & deep[1:]), np.flatnonzero(deep[:-1] & ~deep[1:]) + 1


class Cuts:
    """Group boundaries in the order of suffixes: (letters, path) pairs, each the first label of a group."""

    def __init__(self, letters: np.ndarray, path: np.ndarray, groups: int):
        order = np.lexsort((path, letters))
        letters, path = letters[order], path[order]
        found: list[tuple[int, int]] = []
        for k in range(1, groups if len(order) else 0):
            i = len(order) * k // groups
            j = i
            while j and letters[j - 1] == letters[i] and path[j - 1] == path[i]:
                j -= 1  # copies of one suffix stay together
            if j == 0:
                continue
            same = int(common_letters(letters[j - 1 : j], letters[j : j + 1])[0])
            if same < LETTERS:
                cut = (int(letters[j]) >> 48 - 16 * same << 48 - 16 * same, 0)
            else:
                cut = (int(letters[j]), int(path[j]))
            if not found or cut > found[-1]:
                found.append(cut)
        self.letters, self.path = (np.array([x[k] for x in found], _U) for k in range(2))

    def group(self, letters: np.ndarray, path: np.ndarray) -> np.ndarray:
        """Number of cuts at or before each label."""
        low, high = np.searchsorted(self.letters, letters, "left"), np.searchsorted(self.letters, letters, "right")
        out, tied = low.copy(), np.flatnonzero(high > low)
        for k in np.unique(low[tied]).tolist():
            some = tied[low[tied] == k]
            out[some] = k + np.searchsorted(self.path[k : high[some[0]]], path[some], "right")
        return out


class Block:
    """Sorted documents of one block with the suffixes that have a whole window."""

    def __init__(self, rows: pa.Table, id_column: str, text_column: str, window: int):
        self.rows = rows.sort_by([(id_column, "ascending"), (text_column, "ascending")]).combine_chunks() if len(rows) else rows
        ids = self.rows.column(id_column).fill_null(NULL_ID)
        self.rows = self.rows if not rows.column(id_column).null_count else self.rows.take(pa.compute.sort_indices(ids))
        self.ids = self.rows.column(id_column).fill_null(NULL_ID).to_numpy().astype(np.int64)
        self.words = Words(*raw(self.rows.column(text_column)))
        self.window = window
        self.hashes = self.words.hashes()
        _, self.at = self.words.grams(window, hashes=self.hashes)
        self.half = max(1, window // 2)
        self.halves = rolled(self.hashes, self.half)

    def census(self) -> tuple[np.ndarray, np.ndarray]:
        """The least half-window hash of each window, and the places' hashes that are one."""
        grams, half = self.halves | _U(1), self.half
        least = _slide(grams, self.window - half + 1, np.minimum)
        whole = np.zeros(len(grams), _U)
        whole[self.at] = least[self.at]
        reach = _slide(whole[::-1], self.window - half + 1, np.maximum)[::-1]
        return least[self.at], grams[reach == grams] if len(grams) else grams

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of each suffix's document, and its first word's number there."""
        text = self.words.text[at]
        return self.ids[text], (at - self.words.first[text]).astype(np.int32)

    def labels(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = mix(self.halves[at] * _U(0x9E3779B97F4A7C15) + self.halves[at + self.window - self.half])  # both halves, so all words
        return letters_of(self.hashes, at, self.window) | (other >> _U(48)), rolled(self.hashes, self.window)[at]

    def suffixes(self, repeated: np.ndarray, cuts: Cuts) -> dict[str, np.ndarray]:
        """Suffixes that aren't pruned, sorted by group and label, equal ones by place; `new` marks the first of equals."""
        known = np.zeros(1 << _TABLE_BITS, bool)
        known[(repeated >> _U(64 - _TABLE_BITS)).astype(np.int64)] = True
        at = self.at[known[(self.census()[0] >> _U(64 - _TABLE_BITS)).astype(np.int64)]]
        letters, path = self.labels(at)
        order = np.lexsort((path, letters))
        at, letters, path = at[order], letters[order], path[order]
        new = lcp(letters, path, self.window) < self.window
        return {"at": at, "letters": letters, "path": path, "group": cuts.group(letters, path), "new": new}


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _pieces(group: np.ndarray) -> list[tuple[int, int, int]]:
    edge = np.append(np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)) if len(group) else []
    return [(int(group[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _rows(out: list[tuple], names: list[str], kinds: tuple[pa.DataType, ...]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ((),) * len(kinds), kinds, strict=True)], names)


_WHERE = (pa.int32(), pa.int32())
_ANCHORS, _SAMPLED = -1, -2  # in place of a group's number: values that stay, labels of the sample


def _census(block_of: Callable[[pa.Table], Block], ranges: int, every: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block, number = block_of(rows), key[0].as_py()
        values, seen = np.unique(block.census()[1], return_counts=True)
        group = (values >> _U(32)).astype(np.int64) * ranges >> 32
        letters, path = block.labels(block.at)
        _, one = np.unique(path, return_index=True)  # copies within a block go to their group once
        some = one[mix(path[one] ^ mix(np.array([number], _U))) % _U(every) == 0]
        out = [(-1 - number % ranges, number, _bytes(letters[some]), _bytes(path[some]))] if len(some) else []
        out += [(g, number, _bytes(values[a:b]), _bytes(seen[a:b] > 1)) for g, a, b in _pieces(group)]
        return _rows(out, ["grp", "block", "items", "flags"], (*_WHERE, pa.binary(), pa.binary()))

    return run


def _shared_anchors(key: tuple, rows: pa.Table) -> pa.Table:
    """Which values of each block are at two places or more in all blocks; groups below 0, the sample, go through."""
    if key[0].as_py() < 0:
        return pa.table([rows.column("block"), pa.array(np.full(len(rows), _SAMPLED, np.int32)), rows.column("items"), rows.column("flags")], ["block", "grp", "reply", "sources"])
    values = [np.frombuffer(x, _U) for x in rows.column("items").to_pylist()]
    flags = np.concatenate([np.frombuffer(x, bool) for x in rows.column("flags").to_pylist()])
    flat = np.concatenate(values)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    again = np.zeros(len(flat), bool)
    if len(flat):
        equal = ordered[1:] == ordered[:-1]
        again[order[1:][equal]] = again[order[:-1][equal]] = True
    again |= flags  # a value that one block repeats and another holds is marked in both by the line above
    edge = np.cumsum([0, *map(len, values)])
    kept = [_bytes(flat[a:b][again[a:b]]) for a, b in zip(edge[:-1], edge[1:])]
    none = pa.array([None] * len(kept), pa.binary())
    return pa.table([rows.column("block"), pa.array(np.full(len(kept), _ANCHORS, np.int32)), pa.array(kept, pa.binary()), none], ["block", "grp", "reply", "sources"])


def _branches(block_of: Callable[[pa.Table], Block], cuts: Cuts, sources: bool):
    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if len(rows):
            block, number = block_of(rows), key[0].as_py()
            s = block.suffixes(_repeated(replies), cuts)
            s = {k: v[s["new"]] for k, v in s.items()}
            ids, place = block.place(s["at"])
            out = [(g, number, _bytes(s["letters"][a:b]), _bytes(s["path"][a:b]), _bytes(ids[a:b]), _bytes(place[a:b]) if sources else None) for g, a, b in _pieces(s["group"])]
        return _rows(out, ["grp", "block", *(k for k, _ in _LABEL)], (*_WHERE, *(pa.binary(),) * 4))

    return run


def _repeated(replies: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, _U), *(np.frombuffer(x, _U) for g, x in zip(replies.column("grp").to_pylist(), replies.column("reply").to_pylist()) if g < 0)])


def _subtrees(window: int, sources: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Marks the leaves but the earliest of each deep node of a group's subtrees.

        A block's rows hold its documents by id, so ids decide between blocks, and rows that share an id are in one block.
        """
        rows = rows.sort_by("block")
        part = {k: [np.frombuffer(x or b"", t) for x in rows.column(k).to_pylist()] for k, t in _LABEL}
        edge = np.cumsum([0, *map(len, part["path"])])
        letters, path, ids, at = (np.concatenate(part[k]) for k, _ in _LABEL)
        order = np.lexsort((ids, path, letters))
        first, last = nodes(lcp(letters[order], path[order], window), window)
        mark = np.zeros(len(order) + 1, np.int32)
        mark[first + 1] += 1
        mark[last] -= 1
        marked = np.zeros(len(order), bool)
        marked[order] = np.cumsum(mark[:-1]) > 0
        bits = [_bytes(np.packbits(marked[a:b])) for a, b in zip(edge[:-1], edge[1:])]
        found = [None] * len(bits)
        if sources:
            head = np.zeros(len(order), np.int64)
            head[order] = order[np.repeat(np.r_[0, first], np.diff(np.r_[0, first, len(order)]))] if len(order) else head
            where = np.stack([ids, at.astype(np.int64)], 1)
            found = [_bytes(where[head[a:b][marked[a:b]]]) for a, b in zip(edge[:-1], edge[1:])]
        return pa.table([rows.column("block"), rows.column("grp"), pa.array(bits, pa.binary()), pa.array(found, pa.binary())], ["block", "grp", "reply", "sources"])

    return run


def _removal(block_of: Callable[[pa.Table], Block], cuts: Cuts, text_column: str, kept_columns: list[str], digest: bool, sources: bool):
    def run(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        block = block_of(rows)
        words, window = block.words, block.window
        gone = np.zeros(len(words.start), bool)
        source = np.full((len(words.start) if sources else 0, 2), -1, np.int64)
        if len(block.at):
            s = block.suffixes(_repeated(replies), cuts)
            found = {g: (x, y) for g, x, y in zip(*(replies.column(c).to_pylist() for c in ("grp", "reply", "sources")))}
            pieces = _pieces(s["group"][s["new"]])
            marked = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(found[g][0], np.uint8), count=b - a).astype(bool) for g, a, b in pieces)])
            repeat = ~s["new"]
            repeat[s["new"]] = marked
            change = np.zeros(len(gone) + window + 1, np.int32)
            np.add.at(change, s["at"][repeat], 1)
            np.add.at(change, s["at"][repeat] + window, -1)
            gone = np.cumsum(change)[: len(gone)] > 0
            if sources and len(s["at"]):
                earliest = np.stack(block.place(s["at"][s["new"]]), 1).astype(np.int64)
                earliest[marked] = np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(found[g][1], np.int64).reshape(-1, 2) for g, _, _ in pieces)])
                source[s["at"]] = np.where(repeat[:, None], earliest[np.cumsum(s["new"]) - 1], -1)
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[words.first])
        data, edge = kept_text(words, gone)
        columns = [block.rows.column(c) for c in kept_columns]
        more = [pa.array(words.count.astype(np.int64)), pa.array(count(gone).astype(np.int64))]
        if digest:
            view, at = memoryview(data), edge.tolist()
            last = pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string())
        else:
            last = pa.StringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data))
        out = [*columns, *more, last, _spans(words, gone)]
        names = [*kept_columns, "n_words", "n_removed", "kept_sha256" if digest else text_column, "removed_spans"]
        if sources:
            out, names = [*out, _maximal(words, source, window)], [*names, "repeats"]
        return pa.table(out, names)

    return run


def _maximal(words: Words, source: np.ndarray, window: int) -> pa.Array:
    """Rows of windows of each text whose earliest places move on together, as [first word, word after the last, source id, first word there]."""
    on = source[:, 1] >= 0
    follows = np.r_[False, (words.text[1:] == words.text[:-1]) & on[1:] & on[:-1] & (source[1:, 0] == source[:-1, 0]) & (source[1:, 1] == source[:-1, 1] + 1)] if len(on) else on
    start = np.flatnonzero(on & ~follows)
    end = np.flatnonzero(on & ~np.r_[follows[1:], False]) + window if len(on) else start
    base = words.first[words.text[start]]
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())])
    ids = source[start, 0]
    parts = [pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), pa.array(ids, mask=ids == NULL_ID), pa.array(source[start, 1].astype(np.int32))]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, words.first), pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind)))


def kept_text(words: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all kept words joined by one space within each text, and the bounds of texts."""
    keep = ~gone
    start, end, text = words.start[keep], words.end[keep], words.text[keep]
    change = np.zeros(len(words.data) + 1, np.int8)
    change[start] += 1
    change[end] -= 1
    mask = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    joint = end[:-1][text[1:] == text[:-1]]  # white space stands here
    data = words.data.copy()
    data[joint] = 0x20
    mask[joint] = True
    size = end - start
    size[:-1] += text[1:] == text[:-1]
    edge = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(text, np.arange(len(words.bounds)))]
    return data[mask], edge


def _spans(words: Words, gone: np.ndarray) -> pa.Array:
    """Maximal removed runs of each text as [first word, word after the last]."""
    fresh = np.zeros(len(gone) + 1, bool)
    fresh[words.first] = True
    start = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]] | fresh[:-1])) if len(gone) else np.zeros(0, np.int64)
    end = np.flatnonzero(gone & (np.r_[~gone[1:], True] | fresh[1:])) + 1 if len(gone) else start
    base = words.first[words.text[start]]
    pair = pa.FixedSizeListArray.from_arrays(pa.array(np.stack([start - base, end - base], 1).reshape(-1).astype(np.int32)), 2).cast(pa.list_(pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, words.first), pa.int32()), pair)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """df as a table in the shared folder whose files hold whole blocks, so later passes over blocks move no text."""
    name = f"veilspan_blocks_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, "block").write.format("parquet").option("path", fresh_path(df.sparkSession, "blocks"))
    writer.option("parquet.block.size", ROW_GROUP_BYTES).bucketBy(buckets, "block").saveAsTable(name)
    return df.sparkSession.table(name)


def remove_repeats(df: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", keep_columns: tuple[str, ...] = (), digest: bool = False, sources: bool = False) -> DataFrame:
    """One row per input row: id_column, keep_columns, n_words, n_removed, the kept text
    (or its kept_sha256), removed_spans (array of [first, end) word numbers).

    sources=True adds repeats: the document's maximal repeats of `window` words and more that also start
    earlier (array of start, end, source_id, source_start in words), the earliest place of each.
    """
    spark = df.sparkSession
    n = partitions(spark)
    kept = [id_column, *(c for c in keep_columns if c not in (id_column, text_column))]
    with short_scans(spark):
        size = df.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    n_blocks = max(1, size // BLOCK_BYTES, min(4 * n, size // (BLOCK_BYTES // 8)))
    block = F.pmod(F.xxhash64(id_column), F.lit(n_blocks)).cast("int")
    names = [f"c{i}" for i in range(len(kept))]  # whatever the columns are called
    wide = df.select(block.alias("block"), *(F.col(c).alias(x) for c, x in zip(kept, names)), F.col(text_column).alias("text"))
    with short_scans(spark):
        wide = _bucketed(wide, int(min(MAX_BUCKETS, max(n, size // BUCKET_BYTES))))
    docs = wide.select("block", names[0], "text")

    def block_of(rows: pa.Table) -> Block:
        return Block(rows, names[0], "text", window)

    ranges = max(1, min(1 << 20, max(2 * n, size // (32 << 20))))
    every = max(1, size // 6 // SAMPLE)  # words have some six bytes
    census = docs.groupBy("block").applyInArrow(_census(block_of, ranges, every), "grp int, block int, items binary, flags binary")
    shape = "block int, grp int, reply binary, sources binary"
    with short_scans(spark):
        found = staged(census.groupBy("grp").applyInArrow(_shared_anchors, shape), "anchors")
    anchors = found.where(F.col("grp") == _ANCHORS)
    sample = found.where(F.col("grp") == _SAMPLED).select("reply", "sources").toPandas()  # SAMPLE labels, about
    letters, path = (np.concatenate([np.zeros(0, _U), *(np.frombuffer(x, _U) for x in sample[c])]) for c in ("reply", "sources"))
    limit = int(max(1 << 17, min(GROUP_SUFFIXES, len(path) * every // (2 * n))))
    cuts = Cuts(letters, path, -(-len(path) * every // limit))

    by_block = docs.groupBy("block").cogroup(anchors.groupBy("block"))
    branches = by_block.applyInArrow(_branches(block_of, cuts, sources), "grp int, block int, " + ", ".join(f"{k} binary" for k, _ in _LABEL))
    marks = branches.groupBy("grp").applyInArrow(_subtrees(window, sources), shape)
    with short_scans(spark):
        marks = staged(marks.repartition("block"), "marks")  # a bit a suffix: few files, not one for each task that has trees

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    shape = ", ".join(f"{x} {kinds[c]}" for c, x in zip(kept, names)) + f", n_words long, n_removed long, {'kept_sha256' if digest else 'text'} string, removed_spans array<array<int>>"
    shape += ", repeats array<struct<start:int,end:int,source_id:bigint,source_start:int>>" if sources else ""
    out = wide.groupBy("block").cogroup(anchors.unionByName(marks).groupBy("block")).applyInArrow(_removal(block_of, cuts, "text", names, digest, sources), shape)
    back = dict(zip(names, kept)) | {"text": text_column}
    return out.toDF(*(back.get(c, c) for c in out.columns))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE = {
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, ws, i, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i+19], ' ') END AS win FROM d, unnest(range(1, len(ws) + 1)) u(i)),
        f AS (SELECT doc_id, i, ws[i] AS word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS dup FROM w),
        g AS (SELECT doc_id, i, word, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
        k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""
}
