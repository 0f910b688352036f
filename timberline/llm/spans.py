"""Matches of a regular expression with their places, in SQL functions alone.

Patterns are written so that a failed start never scans text again: possessive runs, begun at a run's first character
or at the end of the match before (\\\\G).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), SPAN)


def find(text: Column, pattern: Column, kind: str) -> Column:
    """Leftmost matches that don't overlap, as (kind, start, end, match) in code points, end exclusive: what lies
    between matches and the matches themselves, in turn, give each place."""
    between, met = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        one = F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), x["match"].alias("match"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.transform(met, lambda m, i: F.struct(F.element_at(between, i + 1).alias("gap"), m.alias("match")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def in_order(spans: Column, by: list[str], kinds: list[str]) -> Column:
    """Sorted by 'kind' as listed and 'start', in the order of `by`."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).cast("int")
    parts = lambda s: [(rank(s) if b == "kind" else s["start"]).alias(b) for b in by]
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(*parts(s), s.alias("span"))))
    return F.transform(keyed, lambda k: k["span"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, label) -> Column:
    """text with each span, in order of start, replaced by label(span); a span that begins inside another is passed."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label(s)).alias("out"))
        return F.when(s["start"] >= acc["at"], more).otherwise(acc)

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
