"""Operators against plain Python, with columns whose names the operators use inside, and order where it counts."""

import random

import pytest
from pyspark.sql import functions as F

from timberline import functions as fn, operators as ops, plans
from timberline.model import validated
from timberline.operators.graph import components
from timberline.plans.simulator import simulate


def log(spark, rows, extra=""):
    return spark.createDataFrame([(bytearray(k), t, bytearray(v)) for k, t, v in rows], "key binary, ts long, value binary")


@pytest.mark.parametrize("seed", range(3))
def test_collection(spark, seed):
    """Every reader at or above the watermark sees after a collection what it saw before."""
    r = random.Random(seed)
    rows = [(bytes([r.randrange(5)]), t, b"" if r.random() < 0.4 else bytes([t])) for t in range(1, 41)]
    low = r.randrange(40)
    kept = ops.collect_versions(log(spark, rows), low, True)
    left = {(bytes(x.key), x.ts) for x in kept.collect()}
    for at in range(low, 41, 7):
        see = lambda df: sorted((bytes(x.key), bytes(x.value)) for x in ops.snapshot(df, at).collect())
        assert see(kept) == see(log(spark, rows))
    for k in {k for k, _, _ in rows}:
        old = sorted((t for q, t, _ in rows if q == k and t <= low), reverse=True)
        assert not any((k, t) in left for t in old[1:]) and all((q, t) in left for q, t, _ in rows if q == k and t > low)


def test_orders(spark):
    got = ops.raw_versions(log(spark, [(b"b", 1, b"x"), (b"a", 1, b"y"), (b"a", 3, b""), (b"\xff", 2, b"z"), (b"a", 2, b"w")])).collect()
    assert [(bytes(r.key), r.ts) for r in got] == [(b"a", 3), (b"a", 2), (b"a", 1), (b"b", 1), (b"\xff", 2)]


def test_clashing_names(spark):
    probes = spark.createDataFrame([("k", 5, 1, 2, 3, 4, 5, 6)], "key string, probe_ts long, slice int, at int, ver int, row int, probe int, rank int")
    out = ops.asof_join(probes, spark.createDataFrame([("k", 2, "v"), ("k", 7, "w")], "key string, ts long, value string"), 3).first()
    assert tuple(out) == ("k", 5, 1, 2, 3, 4, 5, 6, "v")
    one = ops.merge_kway(spark.createDataFrame([(1, "a", "x", 9), (0, "a", "y", 8)], "run_id int, key string, value string, rank int")).first()
    assert (one.key, one.value, one["rank"]) == ("a", "y", 8)
    cut = ops.freeze_segments(spark.createDataFrame([(1, i, "k", "v" * 40, 0) for i in range(4)], "stream int, n int, key string, value string, bytes int"), "stream", "n", 60).orderBy("n").collect()
    assert [(r.segment, r["bytes"]) for r in cut] == [(0, 0), (0, 0), (1, 0), (1, 0)]
    h = spark.createDataFrame([(1, 7), (2, 9)], "hash long, h long")
    shape = fn.bloom_shape(10)
    assert {(r["hash"], r.may_contain) for r in fn.bloom_probe(h, "h", fn.bloom_build(h.filter("h = 7"), "h", *shape), *shape).collect()} >= {(1, True)}


@pytest.mark.parametrize("seed", range(3))
def test_fold_by_component(spark, seed):
    r = random.Random(seed)
    txns = {t: ([(max(0, t - r.randrange(1, 12)), f"k{r.randrange(90)}") for _ in range(r.randrange(3))], [f"k{r.randrange(90)}" for _ in range(r.randrange(3))]) for t in range(1, 120)}
    last, want = {}, {}
    for t, (reads, writes) in txns.items():
        if reads or writes:
            want[t] = not (writes and any(last.get(k, -1) > ts for ts, k in reads))
            if want[t]:
                last |= dict.fromkeys(writes, t)
    reads = spark.createDataFrame([(t, ts, k) for t, (x, _) in txns.items() for ts, k in x], "txn_id long, read_ts long, key string")
    writes = spark.createDataFrame([(t, k) for t, (_, x) in txns.items() for k in x], "txn_id long, key string")
    assert {x.txn_id: x.committed for x in ops.occ_fold(reads, writes).collect()} == want and not all(want.values())


def test_components(spark):
    links = [(i, i + 1) for i in range(10)] + [(20, 30), (30, 25), (7, 7)] + [(50, 50 + i) for i in range(1, 9)]
    got = {r.key: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 11)}, 30: 20, 25: 20, **{50 + i: 50 for i in range(1, 9)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_watermark(spark):
    """Readers 0 to 1000 that leave one after another; doubles count once until the last of them leaves."""
    def state(ts):
        df = spark.createDataFrame([(t,) for t in ts], "read_ts long")
        return ops.watermark(df, 5000).first()[0], ops.snapshot_count(df).first()[0]

    assert state(range(1001)) == (0, 1001) and state(range(500, 1001)) == (500, 501) and state([500]) == (500, 1) and state([]) == (5000, 0)
    assert state([2000, 2000, 2001]) == (2000, 2) and state([2000, 2001]) == (2000, 2) and state([2001]) == (2001, 1)


def test_functions(spark):
    df = spark.createDataFrame([(0,), (1,), (255,), (2**63 - 1,), (-1,), (-(2**63),)], "n long")
    out = df.select("n", fn.be64_encode(F.col("n")).alias("b")).select("n", "b", fn.be64_decode(F.col("b")).alias("back")).collect()
    assert all(r.back == r.n and bytes(r.b) == (r.n % 2**64).to_bytes(8, "big") for r in out)
    one = spark.createDataFrame([("abc", "abd", 7)], "a string, b string, n int")
    assert tuple(one.select(fn.common_prefix_length("a", "b"), fn.raw_length("a"), fn.padded(F.col("n"), 5), fn.file_name(F.col("n"))).first()) == (2, 11, "00007", "00007.sst")


def test_bloom_rates(spark):
    """No key is missed, some of 900 others pass, not all do, and packing keeps the bits."""
    shape = fn.bloom_shape(100)
    h = spark.range(1000).select("id", F.pmod(F.xxhash64("id"), F.lit(2**32)).alias("h"))
    bits = fn.bloom_build(h.filter("id < 100"), "h", *shape)
    assert sorted(bits.collect()) == sorted(fn.bloom_unpack(fn.bloom_bitmap(bits)).collect())
    got = fn.bloom_probe(h, "h", bits, *shape).collect()
    assert all(r.may_contain for r in got if r.id < 100) and sum(r.may_contain for r in got) < 150


def test_validation(spark):
    df = spark.createDataFrame([(bytearray(b"k"), bytearray(b""))], "key binary, value binary")
    assert validated(df, True).count() == 1
    for bad in (df, spark.createDataFrame([(None, bytearray(b"v"))], "key binary, value binary")):
        with pytest.raises(Exception, match="cannot be empty"):
            validated(bad).collect()


@pytest.mark.parametrize("options", [plans.leveled.Options(), plans.leveled.Options(3, 4, 5, 64 << 20), plans.leveled.Options(2, 2, 2, 1 << 20)])
def test_simulator(options):
    history = simulate(60, o=options)
    assert all(h["disjoint"] and h["l0_files"] < options.trigger for h in history)
    assert len(history) == 60 and sum(h["writes"] for h in history) >= 60
