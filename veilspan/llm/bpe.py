"""BPE encoding and decoding of whole texts with a public tokenizer file.

A text is cut into units. A cut stands between an ASCII (or Latin-1) character that isn't
white space and ASCII white space, or between an ASCII letter and ASCII punctuation but
"|", which special tokens have after a letter. No token of either vocabulary, no piece of either splitting pattern and no
special token crosses such a cut, so a text's ids are the ids of its units in order.
Each distinct unit of a batch is encoded once.

The pieces of a unit longer than leaf_chars are encoded by tree concatenation: a piece
is halved until the halves are short, all leaves are encoded in parallel calls, and at
each join a growing window of tokens is encoded again until its first and last tokens
equal those of the two halves; the windows of a level are encoded in parallel too. In BPE by ranks, a row of tokens is the encoding of its
text exactly if each adjacent pair is the encoding of that pair's text, so the joined
row is then exact.

Nulls encode as empty texts; an empty text has no ids and decodes to an empty text.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, models

from veilspan.llm.tables import table
from veilspan.llm.words import raw, slices

LEAF_CHARS = 32
CALL_TEXTS = 1 << 14  # units, leaves or windows that go to the library in one call; what it returns for each is many times its ids
TAKE_UNITS = 1 << 16  # units whose ids are put into a result at once
UNIT_BYTES = 2 << 20  # of text whose units are encoded at once
KNOWN_UNITS = 600_000  # units whose ids a worker keeps at most

_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[0x21:0x7F] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = _WORDLIKE.copy()  # ASCII punctuation but for what special tokens hold after a letter
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), ord("|")]] = False


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte offsets at which units start, empty texts having none."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        ends = _WORDLIKE[data]
        latin = np.zeros(len(data), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        cut[1:-1] = ((ends | latin)[:-1] & _SPACE[data[1:]]) | (_LETTER[data[:-1]] & _MARK[data[1:]])
    cut[bounds] = True
    cut[-1] = False
    return np.flatnonzero(cut)


class TreeEncoder:
    """Encodes one piece (text that the tokenizer would not split) by tree concatenation.

    A node holds the ids of its part of the piece and how many symbols each id covers,
    from the tokens themselves: offsets of the library count bytes, not symbols.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str | None):
        self.suffix = len(suffix or "")
        self.inner = Tokenizer(models.BPE(vocab, merges))
        self.last = Tokenizer(models.BPE(vocab, merges, end_of_word_suffix=suffix)) if suffix else self.inner

    def _coded(self, texts: list[str], final: list[bool]) -> list[tuple[array, array]]:
        """Nodes of all texts, the final ones with the ending that only a piece's end has; the library encodes a call's texts in parallel."""
        out: list[tuple[array, array]] = [(array("I"), array("I"))] * len(texts)
        for coder, ends in ((self.inner, False), (self.last, True)):
            at = [i for i, x in enumerate(final) if x == ends]
            for k in range(0, len(at), CALL_TEXTS):
                some = at[k : k + CALL_TEXTS]
                for i, found in zip(some, coder.encode_batch([texts[i] for i in some], add_special_tokens=False), strict=True):
                    sizes = array("I", map(len, found.tokens))
                    if ends and len(sizes):
                        sizes[-1] -= self.suffix
                    out[i] = array("I", found.ids), sizes
        return out

    def _joined(self, symbols: str, edges: list[int], level: list[tuple[array, array]]) -> list[tuple[array, array]]:
        """Each two neighbours of a level as one; edges: where the level's parts start, and the piece's end."""
        out = [level[i] for i in range(0, len(level), 2)]
        open_, width = [i for i in range(0, len(level) - 1, 2)], 2
        while open_:
            spans, texts = [], []
            for i in open_:
                (left, left_sizes), (right, right_sizes) = level[i], level[i + 1]
                a, b = max(0, len(left) - width), min(len(right), width)
                spans.append((a, b))
                texts.append(symbols[edges[i + 1] - sum(left_sizes[a:]) : edges[i + 1] + sum(right_sizes[:b])])
            final = [i + 2 == len(level) and b == len(level[i + 1][0]) for i, (_, b) in zip(open_, spans)]
            still = []
            for i, (a, b), (again, sizes) in zip(open_, spans, self._coded(texts, final), strict=True):
                (left, left_sizes), (right, right_sizes) = level[i], level[i + 1]
                if (a == 0 or again[0] == left[a]) and (b == len(right) or again[-1] == right[b - 1]):
                    out[i // 2] = left[:a] + again + right[b:], left_sizes[:a] + sizes + right_sizes[b:]
                else:
                    still.append(i)
            open_, width = still, 2 * width
        return out

    def encode(self, symbols: str, leaf: int = LEAF_CHARS) -> array:
        """Ids of a whole piece: it is halved until no part is longer than leaf, and joined level by level."""
        if not symbols:
            return array("I")
        depth = 0
        while -(-len(symbols) >> depth) > leaf:
            depth += 1
        edges = [len(symbols) * i >> depth for i in range((1 << depth) + 1)]
        level = self._coded([symbols[a:b] for a, b in zip(edges[:-1], edges[1:])], [False] * ((1 << depth) - 1) + [True])
        while len(level) > 1:
            level = self._joined(symbols, edges, level)
            edges = edges[::2]
        return level[0][0]


class Codec:
    """Encoder and decoder of texts for one tokenizer file, made once a worker."""

    def __init__(self, content: str, leaf_chars: int = LEAF_CHARS):
        spec = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf = leaf_chars
        self.special = [x["content"] for x in spec["added_tokens"]]
        model = spec["model"]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.tree = TreeEncoder(model["vocab"], merges, model["end_of_word_suffix"])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = pa.array([self.tokenizer.id_to_token(i) or "" for i in range(size)])
        self.plain_decoder = spec["decoder"] is None
        self._known = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def pieces(self, text: str) -> list[str]:
        t = self.tokenizer
        normal = t.normalizer.normalize_str(text) if t.normalizer else text
        return [x for x, _ in t.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all units, and how many each has."""
        long = [i for i, x in enumerate(units) if len(x) > self.leaf and not any(s in x for s in self.special)]
        whole = set(long)
        short = [x for i, x in enumerate(units) if i not in whole]
        found = iter(self.tokenizer.encode_batch(short, add_special_tokens=False))
        ids = [None if i in whole else next(found).ids for i in range(len(units))]
        for i in long:
            ids[i] = array("I")
            for piece in self.pieces(units[i]):
                ids[i] += self.tree.encode(piece, self.leaf)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))
        return flat, counts

    def encode_all(self, units: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """As encode_units, some units a call."""
        done = [self.encode_units(units.slice(k, CALL_TEXTS).to_numpy(zero_copy_only=False).tolist()) for k in range(0, len(units), CALL_TEXTS)]
        return tuple(np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.uint32, np.int64), zip(*done) if done else ((), ())))

    def ids_of(self, units: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where in them each of these distinct units' ids start and how many they are.

        A worker keeps units that it has encoded; when there are too many, only those of
        the last call stay. That changes the work and never the result.
        """
        known, flat, counts = self._known
        at = pc.index_in(known, value_set=units)  # so the table that it makes is of this call's units, not of all known ones
        here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        where = np.full(len(units), -1, np.int64)
        where[at.take(pa.array(here)).to_numpy()] = here
        new = np.flatnonzero(where < 0)
        fresh = units.take(pa.array(new))
        more, more_counts = self.encode_all(fresh)
        where[new] = len(known) + np.arange(len(new))
        flat, counts = np.concatenate([flat, more]), np.concatenate([counts, more_counts])
        starts = np.cumsum(counts) - counts
        if len(counts) <= KNOWN_UNITS:
            self._known = pa.concat_arrays([known, fresh]), flat, counts
        else:
            self._known = fresh, more, more_counts
        return flat, starts[where], counts[where]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts as one array, and where each text's ids start and the last end."""
        data, bounds = raw(texts)
        return self.encode_bytes(data, bounds)

    def encode_bytes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = unit_starts(data, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        edges = np.append(starts, len(data)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
        coded = units.dictionary_encode()
        flat, places, counts = self.ids_of(coded.dictionary)
        code = coded.indices.to_numpy()
        sizes = counts[code]
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]), np.uint32)
        for k in range(0, len(code), TAKE_UNITS):
            some, size = code[k : k + TAKE_UNITS], sizes[k : k + TAKE_UNITS]
            start = int(ends[k] - sizes[k])
            stop = start + int(size.sum())
            out[start:stop] = flat[np.repeat(places[some] - (ends[k : k + TAKE_UNITS] - size), size) + np.arange(start, stop)]
        first = np.searchsorted(starts, bounds)
        return out, np.concatenate([[0], ends])[first]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Text of each row of ids, as the tokenizer's decode(ids, skip_special_tokens=False)."""
        if not self.plain_decoder:
            return self.tokenizer.decode_batch([ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])], skip_special_tokens=False)
        names = self.names.take(pa.array(ids.astype(np.int32)))
        rows = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), names.cast(pa.large_string()))
        return pc.binary_join(rows, pa.scalar(" ", pa.large_string())).to_pylist()


@functools.lru_cache(2)
def codec(path: str, leaf_chars: int = LEAF_CHARS) -> Codec:
    with open(path, encoding="utf-8") as f:
        return Codec(f.read(), leaf_chars)


def encode(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row per input row: id_column and ids array<int>. Other columns are not read.

    A null text has no ids; a null id stays null; repeated rows give repeated rows; an
    empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer, leaf_chars)
        for batch in batches:
            for rows, data, bounds in slices(batch, text_column, UNIT_BYTES):
                ids, at = coder.encode_bytes(data, bounds)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], [id_column, "ids"])

    kind = dict(df.dtypes)[id_column]
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(df: DataFrame, tokenizer: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row per input row: id_column and the text of its ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            texts = coder.decode(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    kind = dict(df.dtypes)[id_column]
    return df.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trip(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Digests of each text's ids and of what they decode to, without moving either out of the worker.

    Columns: id_column, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (UTF-8). Rows and nulls as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer, leaf_chars)
        for batch in batches:
            for rows, data, bounds in slices(batch, text_column, UNIT_BYTES):
                ids, at = coder.encode_bytes(data, bounds)
                flat = memoryview(ids.astype("<u4").view(np.uint8))
                edges = (4 * at).tolist()
                digests = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:])]
                texts = [hashlib.sha256(x.encode()).hexdigest() for x in coder.decode(ids, at)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(digests, pa.string()), pa.array(texts, pa.string())], [id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[id_column]
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_bpe_round_trip": op4_bpe_round_trip}
ORACLE: dict[str, str] = {}
