"""The store against literal histories and a dict: BINARY keys, snapshots, transactions, compaction, reopening."""

import random

import pytest
from pyspark.sql import functions as F

from timberline import repl
from timberline.model import Bound, excluded, included
from timberline.plans.leveled import Options, Task, apply_task
from timberline.sources import Store, wal
from timberline.sources.store import Conflict
from timberline.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield Store(spark, str(tmp_path / "t"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def rows(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def all_versions(s):
    return [(bytes(r.key), bytes(r.value)) for r in s.versions().orderBy("key", F.desc("ts")).collect()]


def test_snapshots_of_a_history(store):
    """Gets and scans as of six snapshots, with a reopening in the middle."""
    want = [
        {b"a": b"1", b"b": b"1"},
        {b"a": b"2", b"b": b"1"},
        {b"a": b"2", b"c": b"1"},
        {b"a": b"3", b"b": b"3", b"c": b"1"},
        {b"a": b"4", b"b": b"3", b"c": b"1"},
        {b"a": b"4", b"c": b"5"},
    ]
    at = []
    store.put(b"a", b"1"), at.append(store.put(b"b", b"1"))
    at.append(store.put(b"a", b"2"))
    store.delete(b"b"), at.append(store.put(b"c", b"1"))
    again = Store(store.spark, store.path)
    again.put(b"a", b"3"), at.append(again.put(b"b", b"3"))
    at.append(again.put(b"a", b"4"))
    again.delete(b"b"), at.append(again.put(b"c", b"5"))
    for ts, seen in zip(at, want):
        assert rows(store.scan(read_ts=ts)) == sorted(seen.items())
        assert store.get(b"b", ts) == seen.get(b"b")
    assert rows(store.scan(included(b"a"), included(b"b"), at[3])) == [(b"a", b"3"), (b"b", b"3")]
    assert rows(store.scan(excluded(b"a"), excluded(b"c"))) == [] and store.get(b"zz") is None
    asked = store.spark.createDataFrame([(bytearray(k),) for k in (b"a", b"b")], "key binary")
    assert {bytes(r.key): r.value and bytes(r.value) for r in store.get_many(asked).collect()} == {b"a": b"4", b"b": None}
    with pytest.raises(ValueError):
        store.put(b"", b"1")
    with pytest.raises(ValueError):
        store.put(b"a", b"")


def test_versions_that_readers_keep(spark, tmp_path):
    """Four batches with readers between them; as readers end, full compaction keeps less."""
    s = Store(spark, str(tmp_path / "t"), strategy="none")
    readers = [s.begin()]
    for batch in ([(b"a", b"1"), (b"b", b"1")], [(b"a", b"2"), (b"d", b"2")], [(b"a", b"3"), (b"d", None)], [(b"c", b"4"), (b"a", None)]):
        s.write_batch(batch)
        readers.append(s.begin())
    readers.pop().__exit__()
    all_of = [(b"a", b""), (b"a", b"3"), (b"a", b"2"), (b"a", b"1"), (b"b", b"1"), (b"c", b"4"), (b"d", b""), (b"d", b"2")]
    want = [all_of, all_of, [x for x in all_of if x != (b"a", b"1")], [(b"a", b""), (b"a", b"3"), (b"b", b"1"), (b"c", b"4")], [(b"b", b"1"), (b"c", b"4")]]
    for i, expected in enumerate(want):
        if i:
            readers[i - 1].__exit__()
        assert s.compact() and all_versions(s) == expected and not s.maintain()


def test_filters_drop_below_the_watermark(store):
    tables = [(f"table{t}_{c}".encode()) for t in (1, 2) for c in "abc"]
    store.write_batch([(k, b"1") for k in tables])
    reader = store.begin()
    store.write_batch([(k, None if k.endswith(b"b") else b"2") for k in tables])
    store.add_compaction_filter(b"table2_")
    store.compact()
    newest = lambda k: (k, b"" if k.endswith(b"b") else b"2")
    assert all_versions(store) == [x for k in tables[:3] for x in (newest(k), (k, b"1"))] + [newest(k) for k in tables[3:]]
    reader.__exit__()
    store.compact()
    assert all_versions(store) == [(b"table1_a", b"2"), (b"table1_c", b"2")]
    store.add_compaction_filter(F.col("value") == F.lit(bytearray(b"2")))
    store.put(b"x", b"3"), store.compact()
    assert all_versions(store) == [(b"x", b"3")]


def test_deleted_keys_stay_deleted(spark, tmp_path):
    """Full compaction of levels 0 and 1 is not the bottom while deeper levels hold files."""
    s = Store(spark, str(tmp_path / "t"), Options(trigger=1, multiplier=2, max_levels=3, base_bytes=1 << 20))
    s.put(b"k", b"v1")
    assert s.maintain() and {f["level"] for f in s.files()} == {3}
    s.delete(b"k")
    s.compact()
    assert s.get(b"k") is None and Store(spark, s.path).get(b"k") is None and len(all_versions(s)) == 2
    while s.maintain():
        pass
    assert s.get(b"k") is None


def test_transactions_see_their_own_writes(store):
    t1, t2 = store.begin(), store.begin()
    t1.put(b"test1", b"233"), t2.put(b"test2", b"233")
    assert list(t1.scan()) == [(b"test1", b"233")] and list(t2.scan()) == [(b"test2", b"233")]
    t3 = store.begin()
    assert list(t3.scan()) == []
    t1.commit(), t2.commit()
    assert list(t3.scan()) == [] and rows(store.scan()) == [(b"test1", b"233"), (b"test2", b"233")]
    t4 = store.begin()
    assert (t4.get(b"test1"), t4.get(b"test2")) == (b"233", b"233")
    t4.put(b"test2", b"2333")
    assert list(t4.scan()) == [(b"test1", b"233"), (b"test2", b"2333")] and t4.get(b"test2") == b"2333"
    t4.delete(b"test2")
    assert t4.get(b"test2") is None and list(t4.scan(included(b"test1"), included(b"test9"))) == [(b"test1", b"233")]
    with t3, t4:
        pass
    with pytest.raises(RuntimeError):
        t4.get(b"test1")
    with pytest.raises(ValueError):
        store.begin().put(b"", b"x")
    assert store.low() <= store.clock()


def test_conflicts(spark, tmp_path):
    def opened(n):
        s = Store(spark, str(tmp_path / str(n)))
        s.write_batch([(b"key1", b"1"), (b"key2", b"2")]) if n != 2 else None
        return s

    s = opened(1)  # write skew
    t1, t2 = s.begin(), s.begin()
    t1.put(b"key1", t1.get(b"key2")), t2.put(b"key2", t2.get(b"key1"))
    t1.commit()
    with pytest.raises(Conflict):
        t2.commit()
    assert (s.get(b"key1"), s.get(b"key2")) == (b"2", b"2") and not s.readers
    s = opened(2)  # blind writes
    t1, t2 = s.begin(), s.begin()
    t1.put(b"key1", b"1"), t2.put(b"key1", b"2")
    t1.commit(), t2.commit()
    assert s.get(b"key1") == b"2"
    s = opened(3)  # one after the other
    for a, b in ((b"key1", b"key2"), (b"key2", b"key1")):
        t = s.begin()
        t.put(a, t.get(b))
        t.commit()
    assert (s.get(b"key1"), s.get(b"key2")) == (b"2", b"2")
    s = opened(4)  # a scan reads every key that it yields
    t1, t2 = s.begin(), s.begin()
    t1.put(b"key1", t1.get(b"key2")), t1.commit()
    assert len(list(t2.scan())) == 2
    t2.put(b"key2", b"1")
    with pytest.raises(Conflict):
        t2.commit()
    t3 = s.begin()  # readers alone commit
    t3.get(b"key1"), list(t3.scan()), s.put(b"key1", b"9")
    before = s.clock()
    assert t3.commit() == before + 1 and s.get(b"key1") == b"9"


def test_against_a_dict(spark, tmp_path):
    """Random batches, compactions and reopenings over keys with bytes of any kind."""
    r, s, model = random.Random(7), Store(spark, str(tmp_path / "t"), Options(2, 2, 3, 2_000), checkpoint_every=4), {}
    keys = [bytes([r.randrange(256) for _ in range(r.randrange(1, 4))]) for _ in range(300)]
    for step in range(12):
        batch = {}
        for _ in range(150):
            k = r.choice(keys)
            batch[k] = None if r.random() < 0.3 else bytes([r.randrange(1, 256)]) * r.randrange(1, 30)
        s.write_batch(list(batch.items()))
        model.update(batch)
        if step % 3 == 1:
            while s.maintain():
                pass
        if step % 5 == 4:
            s = Store(spark, s.path, s.options, checkpoint_every=4)
        seen = sorted((k, v) for k, v in model.items() if v is not None)
        assert rows(s.scan()) == seen
        by_level = {}
        for f in s.files():
            by_level.setdefault(f["level"], []).append((f["first_key"], f["last_key"]))
        assert all(a[1] < b[0] for level, x in by_level.items() if level for a, b in zip(sorted(x), sorted(x)[1:]))
    assert s._named("checkpoint") and s.vacuum() > 0 and rows(Store(spark, s.path).scan()) == seen
    assert s.read_amplification() <= sum(f["level"] == 0 for f in s.files()) + 3


def test_many_puts(spark, tmp_path):
    """Ten commits of 10,000 rows over 55,000 keys: the last version of each key is read."""
    s = Store(spark, str(tmp_path / "t"), Options(2, 2, 3, 1 << 20))
    for i in range(10):
        i0 = i * 5000
        key = F.lpad((F.col("id") + i0).cast("string"), 10, "0").cast("binary")
        s.commit_rows(spark.range(10_000).select(key.alias("key"), F.col("id").alias("seq"), F.rpad(F.concat(F.lit(f"{i}@"), "id"), 110, "x").cast("binary").alias("value")))
        while s.maintain():
            pass
    got = s.scan().select(F.col("key").cast("string").cast("int").alias("k"), F.substring_index(F.col("value").cast("string"), "@", 1).cast("int").alias("i"))
    assert got.count() == 55_000 and got.filter("i <> least(k div 5000, 9)").isEmpty()


def test_log_reads_each_commit_once(store):
    store.put(b"a", b"1")
    loads, load = [], store._load
    store._load = lambda p: loads.append(p.getName()) or load(p)
    store.put(b"b", b"1"), store.get(b"a"), store.scan().collect(), store.clock()
    assert sorted(loads) == sorted(set(loads)) and len(loads) == 2
    with pytest.raises(Conflict):
        store._publish(1, {"kind": "flush", "ts": 9, "add": []})
    path = store._path(f"{store.path}/_log/{3:012d}.json")
    out = store._fs.create(path, False)
    out.write(bytearray(b'{"crc": 1, "body": "{}"}'))
    out.close()
    with pytest.raises(ValueError, match="checksum"):
        Store(store.spark, store.path).clock()


def test_file_ids_do_not_meet(store):
    """More files in a commit than any step between versions: no later id falls among them."""
    f = {"name": "x/part-0", "level": 1, "size": 1, "first_key": "61", "last_key": "61", "max_ts": 1}
    store._publish(1, {"kind": "flush", "ts": 1, "add": store._numbered([f] * 200_000, store.state())})
    store._publish(2, {"kind": "flush", "ts": 2, "add": store._numbered([f] * 3, store.state())})
    assert len(store.files()) == 200_003 and len(Store(store.spark, store.path).files()) == 200_003


def test_concurrent_writers_retry(store):
    other = Store(store.spark, store.path)
    publish = store._publish

    def late(version, record):
        store._publish = publish
        other.put(b"b", b"2")
        return publish(version, record)

    store._publish = late
    assert store.put(b"a", b"1") == 2 and rows(other.scan()) == [(b"a", b"1"), (b"b", b"2")]
    assert {bytes(r.key): r.ts for r in store.versions().collect()} == {b"a": 2, b"b": 1}


def test_cached_reads(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), strategy="none", cached=True)
    s.put(b"a", b"1"), s.put(b"b", b"2")
    assert s.get(b"a") == b"1" and len(s._kept) == 1 and s.get(b"a") == b"1"
    s.compact()
    assert s.get(b"b") == b"2" and len(s._kept) == 1
    s.close()
    assert not s._kept


def test_streamed_batches_commit_once(spark, store, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(bytearray(b"a"), 0, bytearray(b"1")), (bytearray(b"a"), 1, bytearray(b"2"))], "key binary, seq long, value binary").coalesce(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema("key binary, seq long, value binary").parquet(str(source))
    ingest(stream(), store, str(tmp_path / "cp")).awaitTermination()
    assert store.get(b"a") == b"2" and store.clock() == 1
    ingest(stream(), store, str(tmp_path / "other-cp")).awaitTermination()  # the same batch again, as after a crash
    assert store.clock() == 1 and Store(spark, store.path).state().tags == {"ingest": [0, 1]}


def test_shell(store):
    said = []
    repl.run(store, ["init 1 3", "put k v", "get k", "del k", "get k", "scan 1 2", "scan", "flush", "what", "compact", "dump", "quit", "put z z"], said.append)
    assert said[:2] == ["3 values filled with epoch 0", "k=v"] and said[2] == "k not exist"
    assert said[3:6] == ["1=value1@0", "2=value2@0", "2 keys scanned"] and said[9] == "3 keys scanned"
    assert said[10].startswith("error:") and said[11].startswith("L1 (1)") and store.get(b"z") is None


def test_task_outputs_are_sorted(spark):
    schema = "file_id long, level int, size long, first_key binary, last_key binary"
    f = lambda i, level, a, z: (i, level, 1, bytearray(a), bytearray(z))
    before = spark.createDataFrame([f(1, 0, b"a", b"z"), f(5, 0, b"a", b"b"), f(2, 1, b"m", b"n"), f(3, 1, b"a", b"c")], schema)
    after = apply_task(before, Task(0, [1], 1, [3]), spark.createDataFrame([f(7, 1, b"x", b"y"), f(6, 1, b"a", b"c"), f(8, 1, b"d", b"e")], schema))
    assert [r.file_id for r in after.collect()] == [5, 6, 8, 2, 7]


def test_wal(spark, tmp_path):
    kept = [(b"key", 7, b"value"), (b"\x00\xff", 2**40, b""), (b"k" * 300, 9, b"v" * 70)]
    data = wal.encode_wal(kept)
    # two bytes of length, the key, eight of time, two of length, the value, and the checksum over little-endian numbers
    assert data[:20] == b"\x00\x03key\x00\x00\x00\x00\x00\x00\x00\x07\x00\x05value" and data[20:24] == bytes.fromhex("%08x" % wal.zlib.crc32(b"\x03\x00key\x07\x00\x00\x00\x00\x00\x00\x00\x05\x00value"))
    assert list(wal.records(data)) == kept
    for cut in (1, 5, len(data) - 1):
        assert list(wal.records(data[:-cut])) == kept[: 2 if cut < 390 else 0]
    with pytest.raises(ValueError):
        list(wal.records(data[:5] + b"X" + data[6:]))
    for part in (kept[:1], kept[1:]):
        w = wal.WalWriter(str(tmp_path / "wal"), segment_bytes=10)
        w.append(part), w.sync(), w.close()
    assert list(wal.recover(str(tmp_path / "wal"))) == kept
    got = wal.decode_wal(spark, str(tmp_path / "wal/*.wal")).collect()
    assert sorted((bytes(r.key), r.ts, bytes(r.value)) for r in got) == sorted(kept)


def test_bounds_on_binary_keys(store):
    store.write_batch([(bytes([i]), b"v") for i in (1, 0x7F, 0x80, 0xFF)] + [(b"\x80\x00", b"v")])
    key = lambda *a: [k for k, _ in rows(store.scan(*a))]
    assert key() == [b"\x01", b"\x7f", b"\x80", b"\x80\x00", b"\xff"] and key(Bound(b"\x80", False)) == [b"\x80\x00", b"\xff"]
    assert key(None, Bound(b"\x80", False)) == [b"\x01", b"\x7f"] and key(Bound(b"\xff"), Bound(b"\x01")) == []
