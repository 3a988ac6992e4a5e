"""Token-id output: raw id payloads in shard files, with a minimal perfect hash over document keys.

File, all little-endian: the ids of all documents in order (unsigned, 16 bits each where
the vocabulary fits, else 32), then the
sections named in the JSON directory, the directory, its length (u32) and MAGIC. Sections:
keys (i64, file order), offsets (u64, n + 1, in ids), levels (the hash's bit arrays, one
after another), ranks (u32, set bits before each 64-bit word), fingerprints (u32 per slot)
and ordinals (u32 per slot: the document's place in the file).

The hash is built level by level: a key that alone falls on a bit of a level keeps that
bit, the others go on to the next level; a key's slot is the number of set bits before its
own. So n keys get slots 0 to n - 1, a lookup reads a fixed number of bits whatever n is,
and the 32-bit fingerprint turns away keys that the file doesn't hold.

Files hold ascending keys, so the list of files routes a key to the one file that can hold it: a
look-up opens one file however many there are.

Repeated keys: a file holds all their documents, in order of their texts; keyed access finds the first. A null
key can't be looked up: its row is stored under key -2**63. Null texts count as empty.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.bpe import UNIT_BYTES, codec
from veilspan.llm.tables import fresh_path, partitions, small_batches, staged, table
from veilspan.llm.words import mix, slices

MAGIC = b"VSTOK001"
END_ID = 0
GAMMA = 2  # bits of a level per key that reaches it
SHARD_IDS = 32 << 20  # a file ends after the batch that reaches so many ids
NULL_KEY = -(1 << 63)
READ_BYTES = 8 << 20  # of a file that are read at once
_U = np.uint64
_SECTIONS = (("keys", "<i8"), ("offsets", "<u8"), ("levels", "<u8"), ("ranks", "<u4"), ("fingerprints", "<u4"), ("ordinals", "<u4"))


def _spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys.view(_U) ^ _U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % _U(bits)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(_U) + _U(0x632BE59BD9B4E019)) >> _U(32)).astype(np.uint32)


@dataclass
class KeyIndex:
    """Minimal perfect hash of distinct 64-bit keys with stored fingerprints."""

    sizes: list[int]  # bits of each level
    words: np.ndarray
    ranks: np.ndarray
    fingerprints: np.ndarray
    ordinals: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> KeyIndex:
        _, first = np.unique(keys, return_index=True)
        all_keys, left, sizes, words = keys[first], keys[first], [], []
        while len(left):
            bits = -(-max(64, GAMMA * len(left)) // 64) * 64
            at = _spot(left, len(sizes), bits).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(bits)
            left = left[~alone[at]]
        flat = np.concatenate(words) if words else np.zeros(0, "<u8")
        ones = np.bitwise_count(flat).astype(np.int64)
        out = cls(sizes, flat, (np.cumsum(ones) - ones).astype("<u4"), np.zeros(len(all_keys), "<u4"), np.zeros(len(all_keys), "<u4"))
        slot = out.slots(all_keys)
        out.fingerprints[slot] = _fingerprint(all_keys)
        out.ordinals[slot] = first
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; of a key that was not built in, any slot or -1."""
        found, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes):
            at = start + _spot(keys[open_], level, bits).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(_U)
            hit = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
            found[open_[hit]] = (self.ranks[at >> 6] + below)[hit]
            open_, start = open_[~hit], start + bits
        return found

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place in the file of each key's document, -1 for keys that the file doesn't hold."""
        if not len(self.fingerprints):
            return np.full(len(keys), -1, np.int64)
        slot = self.slots(keys)
        ok = (slot >= 0) & (self.fingerprints[slot] == _fingerprint(keys))
        return np.where(ok, self.ordinals[slot].astype(np.int64), -1)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = uri.partition("://")
    if scheme in ("s3a", "s3n"):  # Hadoop's names of it
        uri = f"s3://{rest}"
    return fs.FileSystem.from_uri(uri if colon or uri.startswith("file:") else f"file://{uri}")


def _publish(store: fs.FileSystem, part: str, path: str) -> None:
    """Give a complete file its name. Where another attempt did so before and the store refuses, that one's stands: its bytes are the same."""
    size = store.get_file_info(part).size
    try:
        store.move(part, path)
    except OSError:
        found = store.get_file_info(path)
        if found.type != fs.FileType.File or found.size != size:
            raise
        store.delete_file(part)


class ShardWriter:
    """Streams documents to one file; the file appears under its name only when it is complete."""

    def __init__(self, uri: str, width: int = 4):
        self.width = width
        self.store, self.path = _open(uri)
        self.uri, self.part = uri, f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.store.open_output_stream(self.part)
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n_ids = 0

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(keys)
        self.counts.append(counts)
        self.n_ids += len(ids)

    def close(self) -> tuple[str, int, int, int]:
        keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.counts]))])
        index = KeyIndex.build(keys)
        at, parts = self.width * self.n_ids, {}
        for (name, kind), values in zip(_SECTIONS, (keys, offsets, index.words, index.ranks, index.fingerprints, index.ordinals), strict=True):
            content = np.ascontiguousarray(values, kind).tobytes()
            parts[name] = [at, len(content)]
            at += len(content)
            self.out.write(content)
        directory = json.dumps({"n_ids": self.n_ids, "width": self.width, "sizes": index.sizes, "sections": parts}).encode()
        self.out.write(directory + len(directory).to_bytes(4, "little") + MAGIC)
        self.out.close()
        _publish(self.store, self.part, self.path)
        return self.uri, int(keys[0]) if len(keys) else NULL_KEY, len(keys), self.n_ids


class ShardReader:
    """Keyed and ordered access to one file."""

    def __init__(self, uri: str):
        store, path = _open(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no token file or is cut short")
        n = int.from_bytes(tail[:4], "little")
        directory = json.loads(self.file.read_at(n, size - 12 - n))
        part = {name: np.frombuffer(self.file.read_at(directory["sections"][name][1], directory["sections"][name][0]), kind) for name, kind in _SECTIONS}
        self.width = directory["width"]
        self.keys, self.offsets = part["keys"].astype(np.int64), part["offsets"].astype(np.int64)
        self.index = KeyIndex(directory["sizes"], part["levels"].astype(_U), part["ranks"], part["fingerprints"], part["ordinals"])

    def ids(self, place: int) -> np.ndarray:
        """Unsigned 32-bit ids of the document at a place of the file."""
        return next(self.ids_of(np.array([place])))

    def ids_of(self, places: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of the documents at these places, in their order; neighbours are read together, up to READ_BYTES at once."""
        start, stop = self.width * self.offsets[places], self.width * self.offsets[places + 1]
        i = 0
        while i < len(places):
            j = i + 1
            while j < len(places) and start[j] == stop[j - 1] and stop[j] - start[i] <= READ_BYTES:
                j += 1
            content = self.file.read_at(int(stop[j - 1] - start[i]), int(start[i]))
            for k in range(i, j):
                yield np.frombuffer(content, f"<u{self.width}", int(stop[k] - start[k]) // self.width, int(start[k] - start[i])).astype("<u4")
            i = j

    def get(self, key: int) -> np.ndarray | None:
        """Ids of the first document with this key, or None."""
        place = int(self.index.find(np.array([key], np.int64))[0])
        return None if place < 0 else self.ids(place)


def write_shards(df: DataFrame, folder: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode and write all texts in ascending id order; return the staged list of files.

    Columns: shard (files in this order hold ascending ids), path, first_key, n_docs, n_ids. A task
    that runs again writes the same bytes and puts the file in place in one move; what lost tasks left is removed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number, writer, done = codec(tokenizer), TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for rows, data, bounds in slices(batch, text_column, UNIT_BYTES):
                ids, at = coder.encode_bytes(data, bounds)
                counts = np.diff(at)
                ids = np.insert(ids, at[1:], end_id)
                keys = rows.column(0).fill_null(NULL_KEY).to_numpy().astype(np.int64)
                if writer is not None and writer.n_ids >= shard_ids and writer.keys[-1][-1] != keys[0]:  # a key's documents stay together
                    done.append((part * 1_000_000 + number, *writer.close()))
                    number, writer = number + 1, None
                if writer is None:
                    writer = ShardWriter(f"{folder}/shard-{part:06}-{number:06}.tok", 2 if max(len(coder.names), end_id + 1) <= 1 << 16 else 4)
                writer.add(keys, ids, counts + 1)
        if writer is not None:
            done.append((part * 1_000_000 + number, *writer.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["shard", "path", "first_key", "n_docs", "n_ids"])

    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    rows = df.select(id_column, text_column).repartitionByRange(partitions(df.sparkSession), id_column).sortWithinPartitions(id_column, text_column)
    with small_batches(df.sparkSession):
        done = staged(rows.mapInArrow(run, "shard long, path string, first_key long, n_docs long, n_ids long"), "shards")
    for left in store.get_file_info(fs.FileSelector(path)):
        if left.path.endswith(".part"):
            store.delete_file(left.path)
    return done


class Router:
    """Keyed access to all files: a key is sought in the one file whose keys can hold it.

    files: path and first_key of each, in order of shard; some 100 bytes a file on the driver, a file holding SHARD_IDS ids.
    """

    def __init__(self, files: list[tuple[str, int]]):
        self.paths, self.first = [x for x, _ in files], np.array([k for _, k in files], np.int64)
        self.opened: dict[str, ShardReader] = {}

    @classmethod
    def of(cls, shards: DataFrame) -> Router:
        return cls([tuple(r) for r in shards.orderBy("shard").select("path", "first_key").collect()])

    def path(self, keys: np.ndarray) -> np.ndarray:
        """Number of the file that can hold each key, -1 for keys before the first."""
        return np.searchsorted(self.first, keys, "right") - 1

    def get(self, key: int) -> np.ndarray | None:
        """Ids of the first document with this key, or None."""
        at = int(self.path(np.array([key], np.int64))[0])
        if at < 0:
            return None
        path = self.paths[at]
        reader = self.opened.setdefault(path, None) or ShardReader(path)
        self.opened[path] = reader
        return reader.get(key)


def look_up(keys: DataFrame, shards: DataFrame, key_column: str = "doc_id") -> DataFrame:
    """key_column, ids (array<long>, null for a key that no file holds) of distinct keys; each file is opened by one task."""
    router = Router.of(shards)
    first, paths = router.first, router.paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            wanted, files = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy()
            edge = np.r_[0, np.flatnonzero(files[1:] != files[:-1]) + 1, len(files)]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                found: list[list[int] | None] = [None] * (b - a)
                if a < b and files[a] >= 0:
                    if opened != files[a]:
                        reader, opened = ShardReader(paths[files[a]]), files[a]
                    place = reader.index.find(wanted[a:b])
                    order = np.argsort(place, kind="stable")
                    order = order[place[order] >= 0]
                    for i, ids in zip(order.tolist(), reader.ids_of(place[order]), strict=True):
                        found[i] = ids.tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.list_(pa.int64()))], [key_column, "ids"])

    @F.pandas_udf("int")
    def file_of(column: pd.Series) -> pd.Series:
        known = column.to_numpy(np.int64, na_value=NULL_KEY)
        return pd.Series((np.searchsorted(first, known, "right") - 1).astype(np.int32))

    asked = keys.select(F.col(key_column).cast("long").alias(key_column)).where(F.col(key_column).isNotNull()).distinct()
    dealt = asked.withColumn("file", file_of(key_column)).repartition(partitions(keys.sparkSession), "file").sortWithinPartitions("file", key_column)
    return dealt.mapInArrow(run, f"`{key_column}` long, ids array<long>")


def chosen(place: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places to read: the index's for the first row of each key, the row's own for later ones. keys: ascending."""
    later = np.concatenate([np.zeros(min(1, len(keys)), bool), keys[1:] == keys[:-1]])
    return np.where(later, np.arange(len(keys)), place)


def read_shards(shards: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """All documents of the files: id_column, start (ids of all documents before), n_tokens, ids_crc32.

    Each document is looked up by its key through the file's index; only repeated keys,
    of which the index finds the first, are read by place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(path)
                place = reader.index.find(reader.keys)
                if (place < 0).any() or (reader.keys[place] != reader.keys).any():
                    raise ValueError(f"the index of {path} doesn't fit its keys")
                place = chosen(place, reader.keys)
                for a in range(0, len(place), 10_000):
                    some = place[a : a + 10_000]
                    crc = [zlib.crc32(x) for x in reader.ids_of(some)]
                    keys = pa.array(reader.keys[some], mask=reader.keys[some] == NULL_KEY)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(base + reader.offsets[some]), pa.array(reader.offsets[some + 1] - reader.offsets[some]), pa.array(crc, pa.int64())], [id_column, "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = placed.select("path", "base").repartition(partitions(shards.sparkSession))
    return files.mapInArrow(run, f"`{id_column}` long, start long, n_tokens long, ids_crc32 long")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(shards)


QUERIES = {"op3_token_shards": op3_token_shards}
ORACLE: dict[str, str] = {}
