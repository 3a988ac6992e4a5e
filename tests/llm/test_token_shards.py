import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilspan.llm import token_shards as ts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_index_is_minimal_perfect_and_turns_strangers_away(n):
    keys = np.random.default_rng(n).permutation(np.arange(n, dtype=np.int64) * 7 - 5)
    index = ts.KeyIndex.build(keys)
    if n:
        assert sorted(index.slots(keys).tolist()) == list(range(n))
    assert (index.find(keys) == np.arange(n)).all()
    strangers = np.arange(n, dtype=np.int64) * 7 - 4
    assert (index.find(strangers) == -1).mean() > 0.999 if n else True


def test_files_round_trip(spark, odd, nothing, tmp_path):
    library = Tokenizer.from_file(PATH)
    shards = ts.write_shards(odd, f"file://{tmp_path}/a", PATH, shard_ids=2000)
    got = [tuple(r) for r in ts.read_shards(shards).collect()]
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert shards.count() > 1
    reader = next(x for x in map(ts.ShardReader, [r.path for r in shards.collect()]) if x.get(5) is not None)
    assert reader.get(5).tolist() == [*library.encode("one two three four", add_special_tokens=False).ids, 0]
    assert reader.get(12345) is None
    assert ts.read_shards(ts.write_shards(nothing, f"file://{tmp_path}/b", PATH)).count() == 0


def test_batches_sent_to_the_writers_are_bounded(spark, odd, tmp_path, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    monkeypatch.setattr(ts, "staged", lambda df, tag, real=ts.staged: seen.append(spark.conf.get(key)) or real(df, tag))
    ts.write_shards(odd, f"file://{tmp_path}/a", PATH)
    assert [int(x) for x in seen] == [8 << 20] and spark.conf.get(key) == before


def test_a_cut_file_is_refused(tmp_path):
    writer = ts.ShardWriter(f"file://{tmp_path}/x.tok")
    writer.add(np.array([3]), np.array([7, 8], np.uint32), np.array([2]))
    writer.close()
    whole = (tmp_path / "x.tok").read_bytes()
    assert ts.ShardReader(f"file://{tmp_path}/x.tok").get(3).tolist() == [7, 8]
    (tmp_path / "y.tok").write_bytes(whole[:-5])
    with pytest.raises(ValueError):
        ts.ShardReader(f"file://{tmp_path}/y.tok")
    assert not list(tmp_path.glob("*.part"))


def test_unique_keys_are_read_where_the_index_says():
    assert ts.chosen(np.array([2, 0, 1]), np.array([5, 7, 9])).tolist() == [2, 0, 1]
    assert ts.chosen(np.array([0, 0, 2, 2]), np.array([5, 5, 9, 9])).tolist() == [0, 1, 2, 3]
    assert ts.chosen(np.zeros(0, int), np.zeros(0, np.int64)).tolist() == []


@pytest.fixture
def many(spark, tmp_path, monkeypatch):
    """Some files with a few keys each, and what they hold."""
    monkeypatch.setattr(ts, "UNIT_BYTES", 64)
    rows = [(7 * i, f"text number {i} " + "x" * (i % 5)) for i in range(300)] + [(7, "the same key again"), (70, None), (None, "no key")]
    library = Tokenizer.from_file(PATH)
    held = {}
    for k, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        held.setdefault(k, [*library.encode(x or "", add_special_tokens=False).ids, 0])
    return ts.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/s", PATH, shard_ids=60), held


def test_a_key_opens_one_of_many_files(spark, many, monkeypatch):
    shards, held = many
    assert shards.count() > 10
    opened = []
    monkeypatch.setattr(ts, "ShardReader", lambda uri, real=ts.ShardReader: opened.append(uri) or real(uri))
    router = ts.Router.of(shards)
    for key in (0, 7, 70, 700, 2093):
        opened.clear()
        assert router.get(key).tolist() == held[key] and len(opened) <= 1
    assert router.get(3) is None and router.get(-5) is None and router.get(10**9) is None


def test_look_up_of_many_keys(spark, many):
    shards, held = many
    asked = [*range(0, 2100, 21), 3, -9, 5000, 7, 7, None]
    got = {r.doc_id: r.ids for r in ts.look_up(spark.createDataFrame([(k, "x") for k in asked], "doc_id long, ids string"), shards).collect()}
    assert got == {k: held.get(k) for k in asked if k is not None}
    assert ts.look_up(spark.createDataFrame([], "doc_id long"), shards).count() == 0


def test_a_wrong_index_is_seen(tmp_path):
    """What is read back comes from the place that the index names."""
    writer = ts.ShardWriter(f"file://{tmp_path}/x.tok")
    writer.add(np.array([3, 5, 9]), np.array([7, 8, 9, 10], np.uint32), np.array([1, 1, 2]))
    writer.close()
    reader = ts.ShardReader(f"file://{tmp_path}/x.tok")
    place = ts.chosen(reader.index.find(reader.keys), reader.keys)
    assert [x.tolist() for x in reader.ids_of(place)] == [[7], [8], [9, 10]]
    reader.index.ordinals = reader.index.ordinals[::-1].copy()
    wrong = ts.chosen(reader.index.find(reader.keys), reader.keys)
    assert [x.tolist() for x in reader.ids_of(wrong)] != [[7], [8], [9, 10]] and (reader.keys[wrong] != reader.keys).any()


def test_a_second_attempt_keeps_the_file(tmp_path):
    from pyarrow import fs

    class Strict:
        """A store that refuses to move onto a file, as HDFS does."""

        def __init__(self):
            self.real = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.real, name)

        def move(self, a, b):
            if (tmp_path / "f").exists():
                raise OSError("exists")
            self.real.move(a, b)

    for content in (b"same", b"same"):
        (tmp_path / "p").write_bytes(content)
        ts._publish(Strict(), str(tmp_path / "p"), str(tmp_path / "f"))
        assert (tmp_path / "f").read_bytes() == b"same" and not (tmp_path / "p").exists()
    (tmp_path / "p").write_bytes(b"another")
    with pytest.raises(OSError):
        ts._publish(Strict(), str(tmp_path / "p"), str(tmp_path / "f"))
