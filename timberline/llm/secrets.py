"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: any of some conjunctions, each a set of
trigrams that a match must hold. Texts are indexed under the trigrams that rules ask for (case folded), postings of a
conjunction are intersected, and only the candidates are matched. A rule without mandatory trigrams scans every text.

Rows: null and empty texts have no spans; copies share postings and each row gets its spans; null doc_ids and repeated
rows keep a row each; an empty table gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import spans as sp
from .common import OWN, text_of, written


@dataclass(frozen=True)
class Rule:
    """pattern: for Java, without scanning twice. value: group whose length counts, 0 the match. plain: the same
    language in the syntax that the trigram query is derived from, if it differs."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0
    plain: str | None = None


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Rule("assign", ASSIGN, 2, 6, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""),
    Rule("access", r"AKIA[A-Z0-9]++", 0, 20, r"AKIA[A-Z0-9]+"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24, r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", plain=r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+", plain=r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", plain=r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
FEW = 16  # strings that a part may stand for and still be spelled out; more only weakens the query


def trigrams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def strings_of(op, arg) -> set[str] | None:
    """All strings of one element if they are few, else None."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for o, a in arg:
            if o is sre.LITERAL:
                out.add(chr(a).lower())
            elif o is sre.RANGE and a[1] - a[0] < FEW:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= FEW else None
    if op is sre.SUBPATTERN:
        return joined_strings(arg[3])
    if op is sre.BRANCH:
        parts = [joined_strings(x) for x in arg[1]]
        return None if None in parts or len(set().union(*parts)) > FEW else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[1] != sre.MAXREPEAT and arg[1] <= 4:
        one, out = joined_strings(arg[2]), set()
        if one is None:
            return None
        now = {""}
        for i in range(arg[1] + 1):
            if i >= arg[0]:
                out |= now
            now = {a + b for a in now for b in one}
        return out if len(out) <= FEW else None
    return {""} if op is sre.AT else None


def joined_strings(seq) -> set[str] | None:
    out = {""}
    for op, arg in seq:
        s = strings_of(op, arg)
        if s is None:
            return None
        out = {a + b for a in out for b in s}
        if len(out) > FEW:
            return None
    return out


def trigram_query(pattern: str) -> list[frozenset]:
    """Conjunctions, any of which a match fulfils; [frozenset()] asks for nothing. Runs of elements that stand for few
    strings are spelled out; a longer element in between ends the run, and required runs are multiplied."""
    return [q for q in reduced(conjunctions(sre_parser.parse(pattern)))]


def conjunctions(seq) -> list[frozenset]:
    out: list[frozenset] = [frozenset()]
    now = {""}

    def close() -> None:
        nonlocal out, now
        if all(len(s) >= 3 for s in now):
            out = reduced([a | trigrams(s) for a in out for s in now])
        now = {""}

    for op, arg in seq:
        s = strings_of(op, arg)
        if s is not None and len(s) * len(now) <= FEW:
            now = {a + b for a in now for b in s}
            continue
        close()
        inner = [frozenset()]
        if s is not None:
            now = s
        elif op is sre.SUBPATTERN:
            inner = conjunctions(arg[3])
        elif op is sre.BRANCH:
            inner = [q for x in arg[1] for q in conjunctions(x)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = conjunctions(arg[2])
        out = reduced([a | b for a in out for b in inner])
    close()
    return out


def reduced(qs: list[frozenset]) -> list[frozenset]:
    """Without conjunctions that hold another one."""
    return [q for q in dict.fromkeys(qs) if not any(o < q for o in qs)]


def wanted(rules: list[Rule]) -> list[str]:
    """The trigrams that the rules' queries ask for."""
    return sorted({t for r in rules for q in trigram_query(r.plain or r.pattern) for t in q})


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over these trigrams, written: (trigram, text_key), each once. It serves any rules whose queries
    ask for these trigrams alone, so it can be built once for many scans."""
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("_low"), t))
    texts = docs.select(F.md5(text_of()).alias("text_key"), F.lower(text_of()).alias("_low"))
    return written(texts.select("text_key", F.explode(held).alias("trigram")).distinct(), "postings")


def candidates(docs: DataFrame, rules: list[Rule], index: DataFrame | None = None) -> tuple[DataFrame | None, set[str]]:
    """(text_key, kinds) of texts that fulfil some rule's query, and the kinds that have none. Of each conjunction the
    postings are intersected by counting them for a text."""
    asked, full = [], set()
    for r in rules:
        qs = trigram_query(r.plain or r.pattern)
        if any(not q for q in qs):
            full.add(r.kind)
            continue
        asked += [(f"{r.kind}/{i}", r.kind, t, len(q)) for i, q in enumerate(qs) for t in sorted(q)]
    if not asked:
        return None, full
    table = docs.sparkSession.createDataFrame(asked, "part string, kind string, trigram string, need int")  # as long as the rules
    index = postings(docs, wanted(rules)) if index is None else index
    met = index.join(F.broadcast(table), "trigram").groupBy("text_key", "part", "kind", "need").agg(F.count(F.lit(1)).alias("have")).filter("have = need")
    return met.groupBy("text_key").agg(F.collect_set("kind").alias("kinds")), full


def spans_of(text: Column, rule: Rule) -> Column:
    all_spans = sp.find(text, F.lit(rule.pattern), rule.kind)
    if rule.value or rule.least:
        size = lambda s: F.length(F.regexp_extract(s["match"], rule.pattern, rule.value) if rule.value else s["match"])
        all_spans = F.filter(all_spans, lambda s: size(s) >= rule.least)
    return all_spans


def scan(docs: DataFrame, rules: list[Rule] | None = None, to: str = "spans", index: DataFrame | None = None) -> DataFrame:
    """docs with the column `to` (replaced if there is one): an array of (kind, start, end, match) by start, then rule.
    index: the postings of these docs if they are there already."""
    rules = BASE + MORE if rules is None else rules
    found, full = candidates(docs, rules, index)
    key, kinds = f"{OWN}key", f"{OWN}kinds"
    rows = docs.withColumn(key, F.md5(text_of()))
    if found is None:
        rows = rows.withColumn(kinds, F.array().cast("array<string>"))
    else:
        rows = rows.join(written(found.select(F.col("text_key").alias(key), F.col("kinds").alias(kinds)), "candidates"), key, "left")
    each = [spans_of(text_of(), r) if r.kind in full else F.when(F.array_contains(kinds, r.kind), spans_of(text_of(), r)).otherwise(sp.no_spans()) for r in rules]
    each = [F.coalesce(e, sp.no_spans()) for e in each]
    return rows.select(*(c for c in docs.columns if c != to), sp.in_order(F.concat(*each), ["start", "kind"], [r.kind for r in rules]).alias(to))


def redact(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs with secrets replaced by [KIND]."""
    label = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    found = scan(docs, rules, f"{OWN}spans")
    return found.withColumn("text", sp.replaced(text_of(), F.col(f"{OWN}spans"), label)).select(*docs.columns)
