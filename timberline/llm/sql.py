"""DuckDB SQL for the rows of the queries that SQL can express, written from their definitions and not from the operators:
exact sets, joins and windows over whole tables, without prefixes, sketches, anchors or indexes."""

from __future__ import annotations

#: Lower-cases A-Z alone.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = f"list_filter(string_split_regex({LOWER}, '{BETWEEN}'), lambda x: x <> '')"

DECONTAMINATION = f"""
with d as (select doc_id, {WORDS} as w from documents),
i as (select cast(item_id as varchar) as item, {WORDS} as w from benchmark where item_id is not null),
each as (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as p from i where len(w) > 0),
windows as (select distinct item, len(w[p : p + 12]) as n, array_to_string(w[p : p + 12], ' ') as t from each),
places as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from windows) where len(w) >= n),
met as (select doc_id, p, n, item from (select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as t from places) join windows using (n, t)),
hit as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(p, p + n)) from met) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from met) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

NEAR_DUPLICATES = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(""" + LOWER + r""", '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' ')))) as shingle from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
sized as (select doc_id, shingle, n from s join n using (doc_id)),
pair as (select a.doc_id as a, b.doc_id as b, a.n as n_a, b.n as n_b, count(*) as shared from sized a join sized b on a.shingle = b.shingle and a.doc_id < b.doc_id and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n group by all),
one_way as (select a, b from pair where 100 * shared >= 85 * (n_a + n_b - shared)),
link as (select a, b from one_way union all select b, a from one_way),
reach as (select doc_id, doc_id as other from d union select doc_id, b from reach join link on other = a)
select d.doc_id, coalesce(n, 0) as n_shingles, min(other) as component_id, d.doc_id = min(other) as kept from d join reach using (doc_id) left join n using (doc_id) group by 1, 2
"""

REPEATS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
blocks as (select doc_id, b, substr(h, 2 * b + 1, 2 * (512 + 199)) as part, n from (select doc_id, h, n, unnest(range(0, n - 199, 512)) as b from d where n >= 200)),
w as (select doc_id, b + j as i, hash(substr(part, 2 * j + 1, 400)) as k from (select doc_id, b, part, unnest(range(least(512, n - 199 - b))) as j from blocks)),
again as (select k from w group by 1 having count(*) > 1),
starts as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) > 200 as fresh from w join again using (k)),
runs as (select doc_id, run, min(i) as a, max(i) + 200 as z from (select *, count(*) filter (fresh) over (partition by doc_id order by i rows unbounded preceding) as run from starts) group by 1, 2),
kept as (select doc_id, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' order by a) || substr(any_value(h), 2 * max(z) + 1) as left_, sum(z - a) as gone, count(*) as n_spans
  from (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as b from runs) join d using (doc_id) group by 1)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(left_, h))) as kept_sha256 from d left join kept using (doc_id)
"""


def found(kind: str, pattern: str, group: int = 0, head: int = 0) -> str:
    """Rows (doc_id, kind, a, z, m) of a pattern's matches in code points, from the gaps between matches and the matches.
    With `head`, group 1 stands before the match and is no part of it; m is then group 2."""
    m = f"regexp_extract_all(text, '{pattern}', {2 if head else group})"
    whole, gaps = f"regexp_extract_all(text, '{pattern}')", f"string_split_regex(text, '{pattern}')"
    return f"""select doc_id, '{kind}' as kind, z - length(m) as a, z, m from (select doc_id, m, sum(length(gap) + length(whole)) over (partition by doc_id order by j) as z
      from (select doc_id, unnest({m}) as m, unnest({whole}) as whole, unnest(({gaps})[1 : len({whole})]) as gap, unnest(range(len({whole}))) as j from t where regexp_matches(text, '{pattern}')))"""


SECRETS = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
assign as (""" + found("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""") + r"""),
access as (""" + found("access", "AKIA[A-Z0-9]+") + r"""),
hex as (""" + found("hex", "[0-9a-f]+") + r"""),
private as (""" + found("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----") + r"""),
host as (""" + found("code_host", "(^|[^A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36,})", head=1) + r"""),
web as (""" + found("web_token", r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", head=1) + r"""),
spans as (select doc_id, 0 as rank, kind, a, z from assign where length(regexp_extract(m, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6
  union all select doc_id, 1, kind, a, z from access where length(m) >= 20 union all select doc_id, 2, kind, a, z from hex where length(m) >= 24
  union all select doc_id, 3, kind, a, z from private union all select doc_id, 4, kind, a, z from host union all select doc_id, 5, kind, a, z from web),
one as (select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  string_agg(kind || ':' || a || ':' || z, ',' order by a, rank) filter (rank < 3) as base, string_agg(kind || ':' || a || ':' || z, ',' order by a, rank) as spans from spans group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join one using (doc_id)
"""

DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = "list_sum(list_transform(string_split(reverse(x), ''), lambda c, i: case when i % 2 = 1 then cast(c as integer) when cast(c as integer) * 2 > 9 then cast(c as integer) * 2 - 9 else cast(c as integer) * 2 end)) % 10 = 0"

#: Base spans by their patterns; words outside them; terms whose pointwise mutual information with a value, over distinct
#: texts, is at least 0.9 of the value's information and rests on three texts; words of every text that are such terms.
PII = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
email as (""" + found("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+") + r"""),
ip as (""" + found("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") + r"""),
card as (""" + found("card", r"[0-9]([\x20-]?[0-9])+") + r"""),
phone as (""" + found("phone", r"\+[0-9][\x20().0-9-]+[0-9]") + r"""),
base as (select doc_id, 0 as rank, kind, a, z, 'email:' || translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as value from email
  union all select doc_id, 1, kind, a, z, 'ip:' || m from ip where list_bool_and(list_transform(string_split(m, '.'), lambda p: cast(p as hugeint) <= 255))
  union all select doc_id, 2, kind, a, z, 'card:' || x from (select *, """ + DIGITS + r""" as x from card) where length(x) between 16 and 19 and """ + LUHN + r"""
  union all select doc_id, 3, kind, a, z, 'phone:' || x from (select *, """ + DIGITS + r""" as x from phone) where length(x) between 8 and 15),
words as (""" + found("term", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") + r"""),
lower_words as (select doc_id, a, z, translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from words),
one as (select md5(text) as k, min(doc_id) as doc_id from t group by 1),
outside as (select distinct c.doc_id, b.value, c.term from (select * from lower_words w where not exists (select 1 from base b where b.doc_id = w.doc_id and b.a < w.z and w.a < b.z)) c join one using (doc_id) join base b on b.doc_id = c.doc_id),
total as (select count(*) as n from one),
n_c as (select value, count(distinct doc_id) as n_c from base join one using (doc_id) group by 1),
n_t as (select term, count(distinct doc_id) as n_t from lower_words join one using (doc_id) group by 1),
pairs as (select value, term, count(*) as n_tc from outside group by 1, 2 having count(*) >= 3),
terms as (select distinct term from pairs join n_c using (value) join n_t using (term), total where n > n_c and log2(n * n_tc / (n_t * n_c)) >= 0.9 * log2(n / n_c)),
told as (select doc_id, 4 as rank, 'term' as kind, a, z from lower_words w join terms using (term) where not exists (select 1 from base b where b.doc_id = w.doc_id and b.a < w.z and w.a < b.z)),
spans as (select doc_id, rank, kind, a, z from base union all select doc_id, rank, kind, a, z from told),
per as (select doc_id, count(*) filter (rank = 0) as n_email, count(*) filter (rank = 1) as n_ip, count(*) filter (rank = 2) as n_card, count(*) filter (rank = 3) as n_phone,
  string_agg(kind || ':' || a || ':' || z, ',' order by rank, a) filter (rank < 4) as base, string_agg(kind || ':' || a || ':' || z, ',' order by rank, a) as spans from spans group by 1)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join per using (doc_id)
"""

#: The stored form is "P5", the width and height, "255" and the padded bytes. crc32 goes bit by bit over the last 64; the
#: feature is from the counts of byte values and the steps between bytes 64 apart.
MEDIA = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
p as (select doc_id, n, h || repeat('00', cast(case when n = 0 then 64 else (64 - n % 64) % 64 end as integer)) as h from d),
q as (select doc_id, n, h, length(h) // 2 as m, hex(encode('P5' || chr(10) || '64 ' || (length(h) // 128) || chr(10) || '255' || chr(10))) || h as image from p),
bits as (select doc_id, list_reduce(list_prepend(4294967295::bigint, list_transform(range(64), lambda i: cast('0x' || substr(h, length(h) - 127 + 2 * i, 2) as bigint))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as crc from q),
blocks as (select doc_id, b, substr(h, 2 * b + 1, 2 * (512 + 64)) as part, m from (select doc_id, h, m, unnest(range(0, m, 512)) as b from q)),
bytes as (select doc_id, b + j as i, m, cast('0x' || substr(part, 2 * j + 1, 2) as integer) as v, case when b + j + 64 < m then cast('0x' || substr(part, 2 * j + 129, 2) as integer) end as later from (select doc_id, b, m, part, unnest(range(least(512, m - b))) as j from blocks)),
counts as (select doc_id, v, count(*) as c, any_value(m) as m from bytes group by 1, 2),
mean as (select doc_id, cast(sum(c * v) as hugeint) as total, cast(sum(c * v * v) as hugeint) as squares, any_value(m) as m from counts group by 1),
shape as (select doc_id, (1000 * any_value(total) + any_value(mean.m) // 2) // any_value(mean.m) as mean, round(1000 * sqrt(cast(any_value(mean.m * squares - total * total) as double)) / any_value(mean.m)) as dev, round(1000 * abs(sum(c / mean.m * log2(c / mean.m)))) as entropy from counts join mean using (doc_id) group by 1),
steps as (select doc_id, (1000 * coalesce(sum(abs(later - v)), 0) + greatest(1, any_value(m) - 64) // 2) // greatest(1, any_value(m) - 64) as step from bytes group by 1)
select doc_id, cast(n as bigint) as n_bytes, cast(m as bigint) as payload_bytes, sha256(unhex(h)) as payload_sha256, xor(crc, 4294967295) as tail_crc32, cast(length(image) // 2 as bigint) as media_bytes, sha256(unhex(image)) as media_sha256,
  'mean=' || mean || ';dev=' || cast(dev as bigint) || ';entropy=' || cast(entropy as bigint) || ';step=' || step as feature
from q join bits using (doc_id) join shape using (doc_id) join steps using (doc_id)
"""
