"""Personal data: patterns, and terms that reveal protected values.

Emails, IP addresses, card and phone numbers are protected values. Which other terms reveal one is estimated from the
whole corpus: with N distinct texts, a value c in n(c) of them carries IC(c) = log2(N / n(c)) bits, and a term t that
shares n(t, c) of the n(t) texts that hold it with c tells PMI(t; c) = log2(N n(t, c) / (n(t) n(c))) of them. A term
exceeds the disclosure threshold if PMI >= share * IC, in at least `support` distinct texts (so that copies of a text
are no evidence). Such a term is a span in every text: one with digits is generalised to its shape, any other is
removed.

Rows: null and empty texts have no spans; copies count once in the statistics and each row gets its spans; null doc_ids
and repeated rows keep a row each; an empty table gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import spans as sp
from .common import OWN, forget, lower_ascii, text_of, written

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
BROADCAST_TERMS = 1_000_000


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the check."""
    figures = F.transform(F.split(F.reverse(d), "(?<=.)(?=.)"), lambda x, i: F.when(i % 2 == 0, x.cast("int")).when(x.cast("int") * 2 > 9, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four patterns, by kind and start. Each pattern runs only on texts with the character that it needs."""
    if_any = lambda test, s: F.when(test, s).otherwise(sp.no_spans())
    numeric = F.rlike(text, F.lit("[0-9]"))
    email = if_any(F.contains(text, F.lit("@")), sp.find(text, F.lit(EMAIL), "email"))
    ip = if_any(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), F.filter(sp.find(text, F.lit(IP), "ip"), lambda s: F.forall(F.split(s["match"], r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.try_to_number(F.substring(F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0"), -3, 3), F.lit("999")), F.lit(0)) <= 255))))
    n = lambda s: F.length(digits(s["match"]))
    card = if_any(numeric, F.filter(sp.find(text, F.lit(CARD), "card"), lambda s: F.when(n(s).between(16, 19), luhn(digits(s["match"]))).otherwise(False)))
    phone = if_any(F.contains(text, F.lit("+")), F.filter(sp.find(text, F.lit(PHONE), "phone"), lambda s: n(s).between(8, 15)))
    return F.concat(email, ip, card, phone)


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def value_of(s: Column) -> Column:
    """A protected value: its kind and normalised text."""
    return F.concat(s["kind"], F.lit(":"), F.when(s["kind"].isin("card", "phone"), digits(s["match"])).otherwise(lower_ascii(s["match"])))


def outside(text: Column, spans: Column) -> Column:
    """text with the characters of spans, which may overlap, blanked; places stay."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - start, F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), blank).alias("out"))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(by_start, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def contents(found: DataFrame) -> DataFrame:
    """found (text_key, text, base) -> (text_key, values, terms) of each distinct text with values: its distinct values,
    and its distinct words outside them."""
    each = found.filter(F.size("base") > 0).select("text_key", F.array_distinct(F.transform("base", value_of)).alias("values"), F.array_distinct(words(outside(F.col("text"), F.col("base")))).alias("terms"))
    return each.dropDuplicates(["text_key"])


def holding(docs: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, term) of each distinct text and the terms among its words. Up to BROADCAST_TERMS terms (written) are
    broadcast to spare all other words the move."""
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    return docs.select(F.md5(text_of()).alias(key), F.explode(F.array_distinct(words(text_of()))).alias("term")).join(terms, "term", "left_semi").distinct()


def disclosing(docs: DataFrame, base: DataFrame, share: float = 0.9, support: int = 3) -> DataFrame:
    """(term, value, pmi, ic) beyond the threshold, from all of docs. base (text_key, text, base): texts with values.

    Where PMI reaches the threshold, n(t) <= n(t, c) * (N / n(c)) ** (1 - share). Terms are first held against that with
    n(c) for n(t, c) and their count in texts with values for n(t): pairs are made only of values and terms that pass."""
    total = docs.select(F.md5(text_of()).alias("text_key")).distinct().count()
    held_in = written(contents(base), "contents")
    valued = held_in.select("text_key", F.explode("values").alias("value"))
    spread = F.pow(F.lit(float(total)) / F.col("n_c"), F.lit(1 - share)) * 1.000001
    per_value = valued.groupBy("value").agg(F.count(F.lit(1)).alias("n_c")).filter(F.col("n_c") >= support).withColumn("spread", spread)
    known = written(valued.join(per_value, "value"), "values")
    reach = known.groupBy("text_key").agg(F.max(F.col("n_c") * F.col("spread")).alias("reach"))
    each = written(held_in.join(reach, "text_key").select("text_key", "reach", F.explode("terms").alias("term")), "terms-by-text")
    # a term is in at least as many texts as hold values too; pairs that fail with that number fail with the whole
    least = each.groupBy("term").agg(F.count(F.lit(1)).alias("n_near"), F.max("reach").alias("most")).filter((F.col("n_near") >= support) & (F.col("n_near") <= F.col("most"))).drop("most")
    rare = each.join(least, "term").filter(F.col("n_near") <= F.col("reach")).select("text_key", "term", "n_near")
    pairs = rare.join(known, "text_key").filter(F.col("n_near") <= F.col("n_c") * F.col("spread"))
    both = pairs.groupBy("value", "term").agg(F.count(F.lit(1)).alias("n_tc"), F.first("n_c").alias("n_c"), F.first("spread").alias("spread"), F.first("n_near").alias("n_near"))
    likely = written(both.filter((F.col("n_tc") >= support) & (F.col("n_near") <= F.col("n_tc") * F.col("spread"))).drop("n_near"), "pairs")
    forget(held_in, known, each)
    bound = written(likely.groupBy("term").agg(F.max(F.col("n_tc") * F.col("spread")).alias("most")), "likely-terms")
    # the texts of one slice alone already show that a frequent term is in too many: only the rest are counted in all
    part = holding(docs.filter(F.md5(text_of()).startswith("0")), bound.select("term"), "text_key").groupBy("term").agg(F.count(F.lit(1)).alias("n_part"))
    rest = written(bound.join(part, "term", "left").filter(F.coalesce("n_part", F.lit(0)) <= F.col("most")).select("term"), "rare-terms")
    df = holding(docs, rest, "text_key").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    bits = likely.join(df, "term").withColumn("ic", F.log2(F.lit(float(total)) / F.col("n_c"))).withColumn("pmi", F.log2(F.lit(float(total)) * F.col("n_tc") / (F.col("n_t") * F.col("n_c"))))
    return bits.filter((F.col("ic") > 0) & (F.col("pmi") >= share * F.col("ic"))).select("term", "value", "pmi", "ic")


def detect(docs: DataFrame, share: float = 0.9, support: int = 3, base_to: str = "base", to: str = "spans") -> DataFrame:
    """docs with two columns (replaced if there are any): arrays of (kind, start, end, match) by kind and start, the
    patterns' spans in base_to, those and the terms' in `to`."""
    key, told_terms = f"{OWN}key", f"{OWN}terms"
    source = docs.select(F.md5(text_of()).alias("text_key"), text_of().alias("text"))
    likely = F.contains("text", F.lit("@")) | F.contains("text", F.lit("+")) | F.rlike("text", F.lit("[0-9]"))
    base = source.filter(likely).select("text_key", "text", base_spans(F.col("text")).alias("base"))
    terms = written(disclosing(docs, base, share, support).select("term").distinct(), "terms")
    per_text = written(holding(docs, terms, key).groupBy(key).agg(F.sort_array(F.collect_set("term")).alias(told_terms)), "texts-with-terms")
    rows = docs.withColumn(key, F.md5(text_of())).join(per_text, key, "left").withColumn(base_to, base_spans(text_of()))
    longest = F.array_sort(told_terms, lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(f"(?i)(?<![{WORD}])(?:"), F.array_join(longest, "|"), F.lit(f")(?![{WORD}])"))
    free = lambda s: ~F.exists(base_to, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    told = F.when(F.col(told_terms).isNotNull(), F.filter(sp.find(text_of(), pattern, "term"), free)).otherwise(sp.no_spans())
    return rows.select(*(c for c in docs.columns if c not in (base_to, to)), base_to, F.concat(base_to, told).alias(to))


def label(s: Column) -> Column:
    """What replaces a span: the kind of a value, the shape of a term with digits, a mark for any other term."""
    shape = F.regexp_replace(F.regexp_replace(s["match"], "[0-9]", "0"), "[^0-9]", "x")
    return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(F.rlike(s["match"], F.lit("[0-9]")), shape).otherwise(F.lit("[TERM]"))


def sanitise(docs: DataFrame, share: float = 0.9, support: int = 3) -> DataFrame:
    """docs with the spans' text replaced; n_chars, if there is one, follows the new text."""
    all_spans = f"{OWN}spans"
    found = detect(docs, share, support, f"{OWN}base", all_spans)
    by_start = F.array_sort(F.transform(all_spans, lambda s: F.struct(s["start"].alias("start"), s.alias("s"))))
    text = F.when(F.size(all_spans) > 0, sp.replaced(text_of(), F.transform(by_start, lambda k: k["s"]), label)).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
