"""The versions relation (key, ts, value) and the predicates every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

VERSIONS = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("ts", T.LongType(), False), T.StructField("value", T.BinaryType(), False)])
FILES = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("size", T.LongType()), T.StructField("first_key", T.BinaryType()), T.StructField("last_key", T.BinaryType())])


@dataclass(frozen=True)
class Bound:
    """One end of a key range: a value and whether it belongs to the range. None stands for unbounded."""

    key: object
    inclusive: bool = True


def free_name(name: str, taken: list[str]) -> str:
    """name with as many leading underscores as no given column has."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def included(key: object) -> Bound:
    return Bound(key, True)


def excluded(key: object) -> Bound:
    return Bound(key, False)


def as_lit(key: object) -> Column:
    return F.lit(bytearray(key)) if isinstance(key, bytes) else F.lit(key)


def in_range(lower: Bound | None, upper: Bound | None, key: str = "key") -> Column:
    """Both ends are tested on every row, so inverted bounds give no rows."""
    test = F.lit(True)
    if lower is not None:
        test &= (F.col(key) >= as_lit(lower.key)) if lower.inclusive else (F.col(key) > as_lit(lower.key))
    if upper is not None:
        test &= (F.col(key) <= as_lit(upper.key)) if upper.inclusive else (F.col(key) < as_lit(upper.key))
    return test


def is_tombstone(value: str = "value") -> Column:
    return F.octet_length(value) == 0


def has_prefix(prefixes: list, key: str = "key") -> Column:
    test = F.lit(False)
    for p in prefixes:
        test |= F.startswith(F.col(key), as_lit(p))
    return test


def validated(df: DataFrame, allow_empty_value: bool = False) -> DataFrame:
    """Fails the job on an empty or null key, and on an empty or null value unless deletes are allowed."""
    bad = F.coalesce(F.octet_length("key") == 0, F.lit(True))
    if not allow_empty_value:
        bad |= F.coalesce(F.octet_length("value") == 0, F.lit(True))
    return df.withColumn("key", F.when(bad, F.raise_error(F.lit("key and value cannot be empty")).cast(df.schema["key"].dataType)).otherwise(F.col("key")))
