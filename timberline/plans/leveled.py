"""Leveled compaction planning over file metadata (file_id, level, size, first_key, last_key)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import Bound, as_lit


@dataclass(frozen=True)
class Options:
    trigger: int = 2
    multiplier: int = 2
    max_levels: int = 4
    base_bytes: int = 128 << 20


@dataclass(frozen=True)
class Task:
    """Which files meet in which level. upper_level 0 stands for the overlapping runs of level 0."""

    upper_level: int
    upper: list = field(default_factory=list)
    lower_level: int = 1
    lower: list = field(default_factory=list)
    bottom: bool = False


def level_sizes(files: DataFrame, max_levels: int) -> DataFrame:
    """(level, files, size) of every level from 0, empty ones as 0."""
    levels = files.sparkSession.range(max_levels + 1).select(F.col("id").cast("int").alias("level"))
    sums = files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))
    return levels.join(sums, "level", "left").na.fill(0, ["files", "size"])


def key_range(files: DataFrame) -> DataFrame:
    return files.agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))


def file_overlap(chosen: DataFrame, lower: DataFrame) -> DataFrame:
    """Files of `lower` whose range meets the joint range of the chosen files. One row is broadcast."""
    span = key_range(chosen).select(F.col("first_key").alias("_b"), F.col("last_key").alias("_e"))
    return lower.join(F.broadcast(span), (lower.last_key >= F.col("_b")) & (lower.first_key <= F.col("_e"))).drop("_b", "_e")


def live_files(files: DataFrame, removed: DataFrame) -> DataFrame:
    return files.join(removed.select("file_id"), "file_id", "left_anti")


def pruned_files(files: DataFrame, lower: Bound | None, upper: Bound | None) -> DataFrame:
    """Files whose range meets the bounds; a point lookup has the same key at both ends."""
    test = F.lit(True)
    if lower is not None:
        test &= (F.col("last_key") >= as_lit(lower.key)) if lower.inclusive else (F.col("last_key") > as_lit(lower.key))
    if upper is not None:
        test &= (F.col("first_key") <= as_lit(upper.key)) if upper.inclusive else (F.col("first_key") < as_lit(upper.key))
    return files.filter(test)


def level_targets(real: list, o: Options = Options()) -> tuple[list, int]:
    """Target bytes of levels 1..max and the base level. real: bytes of levels 1..max."""
    target = [0] * o.max_levels
    target[-1] = max(real[-1], o.base_bytes)
    for i in range(o.max_levels - 2, -1, -1):
        if target[i + 1] > o.base_bytes:
            target[i] = target[i + 1] // o.multiplier
    return target, 1 + next(i for i, t in enumerate(target) if t > 0)


def plan_leveled(files: DataFrame, o: Options = Options()) -> Task | None:
    """The next task, None if every level is within its target. Only per-level sums and the chosen ids reach the driver."""
    by = {r.level: r for r in level_sizes(files, o.max_levels).collect()}
    target, base = level_targets([by[i].size for i in range(1, o.max_levels + 1)], o)
    if by[0].files >= o.trigger:
        upper, lower_level, upper_level = files.filter("level = 0"), base, 0
    else:
        over = [(by[i].size / target[i - 1], i) for i in range(1, o.max_levels) if target[i - 1] > 0 and by[i].size > target[i - 1]]
        if not over:
            return None
        upper_level = max(over)[1]
        oldest = files.filter(F.col("level") == upper_level).agg(F.min("file_id")).first()[0]
        upper, lower_level = files.filter(F.col("file_id") == oldest), upper_level + 1
    below = file_overlap(upper, files.filter(F.col("level") == lower_level))
    ids = lambda df: [r.file_id for r in df.select("file_id").orderBy("file_id").toLocalIterator()]
    return Task(upper_level, ids(upper), lower_level, ids(below), lower_level == o.max_levels)


def plan_full(files: DataFrame) -> Task:
    """All of levels 0 and 1 into level 1. It is the bottom, where tombstones go, only if no level below has files: those
    may hold older versions."""
    ids = lambda n: [r.file_id for r in files.filter(F.col("level") == n).select("file_id").orderBy("file_id").toLocalIterator()]
    return Task(0, ids(0), 1, ids(1), files.filter("level > 1").isEmpty())


def apply_task(files: DataFrame, task: Task, outputs: DataFrame) -> DataFrame:
    """The inputs leave both levels, the outputs join the lower one. Files that came meanwhile stay. Level 0 is in order of
    age, newest first, the others of their keys."""
    gone = files.sparkSession.createDataFrame([(i,) for i in [*task.upper, *task.lower]], "file_id long")
    after = live_files(files, gone).unionByName(outputs.withColumn("level", F.lit(task.lower_level)))
    return after.orderBy("level", F.when(F.col("level") == 0, -F.col("file_id")), "first_key")


def split_ranges(spark: SparkSession, begin: int, end: int, n: int) -> DataFrame:
    """n even, adjacent ranges (i, lo, hi) of the integers begin..end."""
    size = end - begin + 1
    return spark.range(n).select(F.col("id").alias("i"), F.expr(f"{begin} + ({size} * id) div {n}").alias("lo"), F.expr(f"{begin} + ({size} * (id + 1)) div {n} - 1").alias("hi"))


def amplification(history: DataFrame) -> DataFrame:
    """history (step, flushes, writes, files, l0_files, levels_used): write, space and read amplification at the end."""
    last = F.max_by(F.struct("l0_files", "levels_used"), "step")
    return history.agg((F.sum("writes") / F.sum("flushes")).alias("write_amp"), (F.max("files") / F.sum("flushes")).alias("space_amp"), (last["l0_files"] + last["levels_used"]).alias("read_amp"))


def read_amplification(met: DataFrame) -> DataFrame:
    """(iterators): sorted runs that a read of these files merges, each file of level 0 and each level below."""
    return met.agg((F.count_if(F.col("level") == 0) + F.count_distinct(F.when(F.col("level") > 0, F.col("level")))).alias("iterators"))
