"""Queries of the engine over the shared tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import operators as ops, plans
from .functions import bloom_bitmap, bloom_build, bloom_probe, bloom_shape, bloom_unpack, common_prefix_length
from .model import excluded, has_prefix, included
from .operators.snapshot import top_one
from .plans.leveled import Options, level_targets
from .plans.simulator import simulate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOG = "v_log as (select lpad(cast(user_id as varchar), 6, '0') as key, event_id + 1 as ts, case when event_type = 'error' then '' else props end as value from events)"
TOP = "row_number() over (partition by key order by ts desc)"


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def key_of(c: str):
    return F.lpad(F.col(c).cast("string"), 6, "0")


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(key_of("user_id").alias("key"), (F.col("event_id") + 1).alias("ts"), F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("props")).alias("value"))


def clock(df: DataFrame) -> int:
    return df.agg(F.max("ts")).first()[0] or 0


def batches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(key_of("user_id").alias("key"), F.expr("event_id div 100 + 1").alias("commit_ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("props")).alias("value"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.expr("event_id div 250").alias("run_id"), key_of("user_id").alias("key"), F.col("event_id").alias("ts"), F.col("props").alias("value"))
    return e.groupBy("run_id", "key").agg(F.max_by("value", "ts").alias("value"))


RUNS = "v_runs as (select event_id // 250 as run_id, lpad(cast(user_id as varchar), 6, '0') as key, arg_max(props, event_id) as value from events group by 1, 2)"


def txn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.expr("event_id div 10").alias("txn_id"), "event_type", key_of("user_id").alias("key"))
    reads = e.filter(F.col("event_type").isin("view", "click")).select("txn_id", F.greatest(F.col("txn_id") - 5, F.lit(0)).alias("read_ts"), "key")
    return reads, e.filter(F.col("event_type").isin("purchase", "signup", "error")).select("txn_id", "key")


TXN = "e as (select event_id // 10 as txn_id, event_type, lpad(cast(user_id as varchar), 6, '0') as key from events), rd as (select txn_id, greatest(txn_id - 5, 0) as read_ts, key from e where event_type in ('view', 'click')), wr as (select txn_id, key from e where event_type in ('purchase', 'signup', 'error'))"


def files(spark: SparkSession, d: str, by: str = "o_custkey") -> DataFrame:
    o = table(spark, d, "orders").select(F.expr("o_orderkey div 500").alias("file_id"), F.lpad(F.col(by).cast("string"), 9, "0").alias("k"))
    return o.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_key"), F.max("k").alias("last_key")).select("file_id", (F.col("file_id") % 4).cast("int").alias("level"), (F.col("n") * 100).alias("size"), "first_key", "last_key")


def files_sql(by: str = "o_custkey") -> str:
    return f"v_files as (select o_orderkey // 500 as file_id, cast((o_orderkey // 500) % 4 as integer) as level, count(*) * 100 as size, min(lpad(cast({by} as varchar), 9, '0')) as first_key, max(lpad(cast({by} as varchar), 9, '0')) as last_key from orders group by 1, 2)"


def snap_sql(where: str) -> str:
    return f"with {LOG} select key, value from (select *, {TOP} as rn from v_log where {where}) where rn = 1 and value <> ''"


@query("snapshot_latest", snap_sql("true"))
def _(spark, d):
    return ops.snapshot(log(spark, d))


@query("snapshot_asof", snap_sql("ts <= (select max(ts) // 2 from v_log)"))
def _(spark, d):
    v = log(spark, d)
    return ops.snapshot(v, clock(v) // 2)


@query("scan_incl_incl", snap_sql("key >= '000020' and key <= '000060'"))
def _(spark, d):
    return ops.snapshot(log(spark, d), None, included("000020"), included("000060"))


@query("scan_excl_excl", snap_sql("key > '000020' and key < '000060'"))
def _(spark, d):
    return ops.snapshot(log(spark, d), None, excluded("000020"), excluded("000060"))


@query("scan_unbounded_upper", snap_sql("key >= '000090'"))
def _(spark, d):
    return ops.snapshot(log(spark, d), None, included("000090"))


@query("scan_inverted", snap_sql("key >= '000060' and key <= '000020'"))
def _(spark, d):
    return ops.snapshot(log(spark, d), None, included("000060"), included("000020"))


@query("point_get", snap_sql("key = '000007'"))
def _(spark, d):
    return ops.point_get(log(spark, d), "000007")


@query("point_get_asof", snap_sql("key = '000007' and ts <= (select max(ts) // 2 from v_log)"))
def _(spark, d):
    v = log(spark, d)
    return ops.point_get(v, "000007", clock(v) // 2)


@query("multi_get", f"with {LOG} select k.key, s.value from (select lpad(cast(c_custkey as varchar), 6, '0') as key from customer) k left join (select key, value from (select *, {TOP} as rn from v_log) where rn = 1 and value <> '') s on k.key = s.key")
def _(spark, d):
    return ops.multi_get(log(spark, d), table(spark, d, "customer").select(key_of("c_custkey").alias("key")))


@query("asof_join", f"with {LOG} select p.key, p.probe_ts, p.orderkey, nullif(v.value, '') as value from (select lpad(cast(o_custkey % 150 as varchar), 6, '0') as key, (o_orderkey * 7919) % 10000 as probe_ts, o_orderkey as orderkey from orders) p asof left join v_log v on p.key = v.key and p.probe_ts >= v.ts")
def _(spark, d):
    p = table(spark, d, "orders").select(F.lpad((F.col("o_custkey") % 150).cast("string"), 6, "0").alias("key"), ((F.col("o_orderkey") * 7919) % 10000).alias("probe_ts"), F.col("o_orderkey").alias("orderkey"))
    return ops.asof_join(p, log(spark, d), 1000)


@query("raw_versions", f"with {LOG} select key, ts, value from v_log")
def _(spark, d):
    return ops.raw_versions(log(spark, d))


@query("merge_kway", f"with {RUNS} select key, value from (select *, row_number() over (partition by key order by run_id) as rn from v_runs) where rn = 1")
def _(spark, d):
    return ops.merge_kway(runs(spark, d)).select("key", "value")


HALVES = f"{RUNS}, cut as (select max(run_id) // 2 as run_id from v_runs), a as (select key, value from (select *, row_number() over (partition by key order by run_id) as rn from v_runs where run_id <= (select run_id from cut)) where rn = 1), b as (select key, value from (select *, row_number() over (partition by key order by run_id) as rn from v_runs where run_id > (select run_id from cut)) where rn = 1)"


@query("merge_two", f"with {HALVES} select key, value from a union all select key, value from b where key not in (select key from a)")
def _(spark, d):
    """The earlier half of the runs over the later one, each merged before."""
    r = runs(spark, d)
    half = r.agg(F.expr("max(run_id) div 2")).first()[0] or 0
    side = lambda test: ops.merge_kway(r.filter(test)).select("key", "value")
    return ops.merge_two(side(F.col("run_id") <= half), side(F.col("run_id") > half))


@query("concat_runs", snap_sql("true"))
def _(spark, d):
    """Three runs of adjacent ranges that hold all keys."""
    v = log(spark, d)
    return ops.concat_runs([ops.snapshot(v, None, None, excluded("000030")), ops.snapshot(v, None, included("000030"), excluded("000100")), ops.snapshot(v, None, included("000100"))])


@query("txn_overlay", f"with {LOG}, n as (select max(ts) * 9 // 10 as cut from v_log), loc as (select key, value from (select *, {TOP} as rn from v_log where ts > (select cut from n)) where rn = 1), base as (select key, value from (select *, {TOP} as rn from v_log where ts <= (select cut from n)) where rn = 1 and value <> '') select key, value from loc where value <> '' union all select key, value from base where key not in (select key from loc)")
def _(spark, d):
    v = log(spark, d)
    cut = clock(v) * 9 // 10
    local = top_one(v.filter(F.col("ts") > cut), ["key"], F.desc("ts"))
    return ops.overlay(local, v, cut)


@query("batch_last_wins", "select key, ts, value from (select lpad(cast(user_id as varchar), 6, '0') as key, event_id // 100 + 1 as ts, case when event_type = 'error' then '' else props end as value, row_number() over (partition by user_id, event_id // 100 order by event_id desc) as rn from events) where rn = 1")
def _(spark, d):
    return ops.batch_last_wins(batches(spark, d))


def gc_sql(bottom: bool, prefix: str | None) -> str:
    drop = f"and not starts_with(key, '{prefix}')" if prefix else ""
    dead = "and not (value = '' and not has_above)" if bottom else ""
    return f"with {LOG}, w as (select max(ts) * 3 // 4 as low from v_log), r as (select *, ts <= low as below, row_number() over (partition by key, ts <= low order by ts desc) as rn, bool_or(ts > low) over (partition by key) as has_above from v_log, w) select key, ts, value from r where not below or (rn = 1 {drop} {dead})"


def gc_query(bottom: bool, prefixes: list) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = log(spark, d)
        return ops.collect_versions(v, clock(v) * 3 // 4, bottom, prefixes)

    return run


query("gc_bottom", gc_sql(True, None))(gc_query(True, []))
query("gc_nonbottom", gc_sql(False, None))(gc_query(False, []))
query("gc_prefix", gc_sql(True, "00001"))(gc_query(True, ["00001"]))


def readers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'signup'").select(F.expr("event_id div 50 + 3").alias("read_ts"))


@query("watermark", "select coalesce(min(event_id // 50 + 3), 99999) as watermark from events where event_type = 'signup'")
def _(spark, d):
    return ops.watermark(readers(spark, d), 99999)


@query("watermark_idle", "select cast(77 as bigint) as watermark")
def _(spark, d):
    return ops.watermark(readers(spark, d).filter("false"), 77)


@query("snapshot_count", "select count(distinct event_id // 50 + 3) as snapshots from events where event_type = 'signup'")
def _(spark, d):
    return ops.snapshot_count(readers(spark, d))


@query("history_prune", "select event_id // 10 as commit_ts, lpad(cast(user_id as varchar), 6, '0') as key from events where event_type in ('purchase', 'signup', 'error') and event_id // 10 >= 40")
def _(spark, d):
    return ops.history_prune(txn(spark, d)[1].withColumnRenamed("txn_id", "commit_ts"), 40).select("commit_ts", "key")


@query("occ_conflicts", f"with {TXN} select rd.txn_id, rd.read_ts, rd.key from rd where exists (select 1 from wr where wr.key = rd.key and wr.txn_id > rd.read_ts)")
def _(spark, d):
    reads, writes = txn(spark, d)
    return ops.occ_conflicts(reads, writes.withColumnRenamed("txn_id", "commit_ts"))


@query("occ_fold", f"with recursive {TXN}, ids as (select txn_id, row_number() over (order by txn_id) as n from (select distinct txn_id from e where event_type in ('view', 'click', 'purchase', 'signup', 'error'))), cf as (select rd.txn_id, list(distinct wr.txn_id) as others from rd join wr on rd.key = wr.key and wr.txn_id > rd.read_ts and wr.txn_id < rd.txn_id group by 1), st as (select ids.n, ids.txn_id, coalesce(cf.others, []) as others, exists (select 1 from wr where wr.txn_id = ids.txn_id) as writes from ids left join cf on ids.txn_id = cf.txn_id), f(n, txn_id, committed, recent) as (select cast(0 as bigint), cast(-1 as bigint), true, cast([] as bigint[]) union all select st.n, st.txn_id, not (st.writes and list_has_any(f.recent, st.others)), case when st.writes and not list_has_any(f.recent, st.others) then list_append(f.recent, st.txn_id) else f.recent end from f join st on st.n = f.n + 1) select txn_id, committed from f where n > 0")
def _(spark, d):
    return ops.occ_fold(*txn(spark, d))


@query("level_sizes", f"with {files_sql()} select cast(l.level as integer) as level, coalesce(count(file_id), 0) as files, cast(coalesce(sum(size), 0) as bigint) as size from range(5) l(level) left join v_files using (level) group by 1")
def _(spark, d):
    return plans.level_sizes(files(spark, d), 4)


@query("file_overlap", f"with {files_sql('o_orderkey')}, c as (select min(first_key) as b, max(last_key) as e from v_files where level = 1) select f.file_id, f.level, f.size, f.first_key, f.last_key from v_files f, c where f.level <> 1 and f.last_key >= c.b and f.first_key <= c.e")
def _(spark, d):
    f = files(spark, d, "o_orderkey")
    return plans.file_overlap(f.filter("level = 1"), f.filter("level <> 1"))


@query("live_files", f"with {files_sql()} select * from v_files where file_id not in (select file_id from v_files where level = 0)")
def _(spark, d):
    f = files(spark, d)
    return plans.live_files(f, f.filter("level = 0"))


@query("file_disjoint", f"with {files_sql('o_orderkey')} select *, coalesce(lag(last_key) over (partition by level order by first_key, file_id) < first_key, true) as ok from v_files")
def _(spark, d):
    return ops.runs_disjoint(files(spark, d, "o_orderkey"))


@query("file_pruning", f"with {files_sql('o_orderkey')} select * from v_files where last_key > '000001000' and first_key <= '000003000'")
def _(spark, d):
    return plans.pruned_files(files(spark, d, "o_orderkey"), excluded("000001000"), included("000003000"))


OPT = Options(trigger=10**9, multiplier=2, max_levels=3, base_bytes=5_000)
TARGETS = "s as (select coalesce(sum(size) filter (level = 1), 0) as r1, coalesce(sum(size) filter (level = 2), 0) as r2, coalesce(sum(size) filter (level = 3), 0) as r3 from v_files), t3 as (select *, greatest(r3, 5000) as t3 from s), t2 as (select *, case when t3 > 5000 then t3 // 2 else 0 end as t2 from t3), t as (select *, case when t2 > 5000 then t2 // 2 else 0 end as t1 from t2)"


@query("level_targets", f"with {files_sql()}, {TARGETS} select cast(level as integer) as level, cast(target as bigint) as target, cast(case when t1 > 0 then 1 when t2 > 0 then 2 else 3 end as integer) as base_level from (select unnest([1, 2, 3]) as level, unnest([t1, t2, t3]) as target, t1, t2 from t)")
def _(spark, d):
    sizes = {r.level: r.size for r in plans.level_sizes(files(spark, d), 3).collect()}
    target, base = level_targets([sizes[i] for i in range(1, 4)], OPT)
    return spark.createDataFrame([(i + 1, t, base) for i, t in enumerate(target)], "level int, target long, base_level int")


def task_rows(spark: SparkSession, task) -> DataFrame:
    rows = [(i, "upper", task.bottom) for i in task.upper] + [(i, "lower", task.bottom) for i in task.lower] if task else []
    return spark.createDataFrame(rows, "file_id long, side string, bottom boolean")


@query("compaction_task", f"with {files_sql('o_orderkey')}, {TARGETS}, over as (select unnest([1, 2]) as level, unnest([case when t1 > 0 then r1 / t1 else 0 end, case when t2 > 0 then r2 / t2 else 0 end]) as ratio from t), pick as (select level from over where ratio > 1 order by ratio desc, level desc limit 1), up as (select min(file_id) as file_id from v_files where level = (select level from pick)), low as (select f.file_id from v_files f, v_files u, up, pick where u.file_id = up.file_id and f.level = pick.level + 1 and f.last_key >= u.first_key and f.first_key <= u.last_key), bt as (select level + 1 = 3 as bottom from pick) select file_id, 'upper' as side, bottom from up, bt where file_id is not null union all select file_id, 'lower' as side, bottom from low, bt")
def _(spark, d):
    """No level has a trigger here: the level most over its target gives its oldest file."""
    return task_rows(spark, plans.plan_leveled(files(spark, d, "o_orderkey"), OPT))


@query("compaction_task_l0", f"with {files_sql('o_custkey')}, {TARGETS}, base as (select case when t1 > 0 then 1 when t2 > 0 then 2 else 3 end as level from t), span as (select min(first_key) as b, max(last_key) as e from v_files where level = 0) select file_id, 'upper' as side, base.level = 3 as bottom from v_files, base where v_files.level = 0 union all select file_id, 'lower' as side, base.level = 3 as bottom from v_files, base, span where v_files.level = base.level and last_key >= b and first_key <= e")
def _(spark, d):
    """Level 0 has as many files as its trigger: all of it goes to the base level."""
    return task_rows(spark, plans.plan_leveled(files(spark, d, "o_custkey"), Options(2, 2, 3, 5_000)))


@query("split_ranges", "select i, 10 + (991 * i) // 7 as lo, 10 + (991 * (i + 1)) // 7 - 1 as hi from range(7) t(i)")
def _(spark, d):
    return plans.split_ranges(spark, 10, 1000, 7)


@query("memtable_bytes", f"with {LOG} select cast(sum(strlen(key) + 8 + strlen(value)) as bigint) as bytes from v_log")
def _(spark, d):
    return ops.live_bytes(log(spark, d))


@query("freeze_segments", "with recursive s as (select event_id // 100 as stream, event_id, strlen(lpad(cast(user_id as varchar), 6, '0')) + 8 + strlen(props) as b, row_number() over (partition by event_id // 100 order by event_id) as n from events), f(stream, event_id, n, segment, used) as (select stream, event_id, n, cast(0 as bigint), b from s where n = 1 union all select s.stream, s.event_id, s.n, case when f.used > 500 then f.segment + 1 else f.segment end, case when f.used > 500 then s.b else f.used + s.b end from f join s on s.stream = f.stream and s.n = f.n + 1) select stream, event_id, segment from f")
def _(spark, d):
    e = table(spark, d, "events").select(F.expr("event_id div 100").alias("stream"), "event_id", key_of("user_id").alias("key"), F.col("props").alias("value"))
    return ops.freeze_segments(e, "stream", "event_id", 500).select("stream", "event_id", "segment")


K = bloom_shape(1)[1]
H = "(user_id * 2654435761) % 4294967296"
HASHED = f"v_hash as (select distinct user_id, cast({H} as bigint) as h from events), shape as (select (greatest(count(*) * 10, 64) + 7) // 8 * 8 as bits from v_hash)"
POS = f"select distinct h, cast((h + i * (((h >> 17) | (h << 15)) & 4294967295)) & 4294967295 as bigint) % bits as bit from v_hash, shape, range({K}) t(i)"


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct().withColumn("h", (F.col("user_id") * 2654435761) % 4294967296)


@query("bloom_bits", f"with {HASHED}, p as ({POS}) select distinct bit from p")
def _(spark, d):
    h = hashes(spark, d)
    return bloom_build(h, "h", *bloom_shape(h.count()))


@query("bloom_round_trip", f"with {HASHED}, p as ({POS}) select distinct bit from p")
def _(spark, d):
    """The set bits after packing into bitmaps and back."""
    h = hashes(spark, d)
    return bloom_unpack(bloom_bitmap(bloom_build(h, "h", *bloom_shape(h.count()))))


@query("bloom_probe", f"with {HASHED}, b as (select distinct bit from ({POS})), q as (select c_custkey as user_id, cast((c_custkey * 2654435761) % 4294967296 as bigint) as h from customer), x as (select user_id, h, bit from (select q.user_id, q.h, cast((h + i * (((h >> 17) | (h << 15)) & 4294967295)) & 4294967295 as bigint) % bits as bit from q, shape, range({K}) t(i))) select user_id, h, count(*) = count(b.bit) as may_contain from x left join b on x.bit = b.bit group by 1, 2")
def _(spark, d):
    h = hashes(spark, d)
    shape = bloom_shape(h.count())
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).withColumn("h", (F.col("user_id") * 2654435761) % 4294967296)
    return bloom_probe(q, "h", bloom_build(h, "h", *shape), *shape)


@query("common_prefix", "with p as (select p_partkey, p_name as b, lag(p_name) over (order by p_partkey) as a from part), x as (select p_partkey, a, b, (select coalesce(max(i), 0) from range(1, 40) t(i) where i <= least(length(a), length(b)) and left(a, i) = left(b, i)) as prefix from p where a is not null) select p_partkey, cast(prefix as integer) as prefix from x")
def _(spark, d):
    a = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("a"))
    b = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", common_prefix_length("a", "b").alias("prefix"))


@query("prefix_filter", f"with {LOG} select key, ts, value from v_log where not starts_with(key, '00000') and not starts_with(key, '00012')")
def _(spark, d):
    return log(spark, d).filter(~has_prefix(["00000", "00012"]))


@query("range_gen", "select lpad(cast(i as varchar), 6, '0') as key, 'value' || i || '@3' as value from range(100, 201) t(i)")
def _(spark, d):
    i = F.col("id").cast("string")
    return spark.range(100, 201).select(F.lpad(i, 6, "0").alias("key"), F.concat(F.lit("value"), i, F.lit("@3")).alias("value"))


@query("amplification", "with h as (select o_orderkey as step, 1 as flushes, o_custkey % 7 + 1 as writes, o_custkey % 40 as files, o_orderkey % 3 as l0, o_orderkey % 4 as used from orders) select sum(writes) / sum(flushes) as write_amp, max(files) / sum(flushes) as space_amp, (select l0 + used from h order by step desc limit 1) as read_amp from h")
def _(spark, d):
    h = table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.lit(1).alias("flushes"), (F.col("o_custkey") % 7 + 1).alias("writes"), (F.col("o_custkey") % 40).alias("files"), (F.col("o_orderkey") % 3).alias("l0_files"), (F.col("o_orderkey") % 4).alias("levels_used"))
    return plans.amplification(h)


@query("read_amplification", f"with {files_sql()}, met as (select * from v_files where last_key >= '000000200' and first_key <= '000000900') select count(*) filter (level = 0) + count(distinct level) filter (level > 0) as iterators from met")
def _(spark, d):
    return plans.read_amplification(plans.pruned_files(files(spark, d), included("000000200"), included("000000900")))


@query("simulator", "select cast(i as integer) as step, true as disjoint, true as settled from range(50) t(i)")
def _(spark, d):
    """Of every step, whether levels from 1 on are disjoint and level 0 is below its trigger."""
    rows = spark.createDataFrame(simulate(), "step int, flushes int, writes int, files int, l0_files int, levels_used int, disjoint boolean")
    return rows.select("step", "disjoint", (F.col("l0_files") < 2).alias("settled"))
