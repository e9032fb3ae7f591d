"""The registered queries of the training-data operators, with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debruijn, fmindex, hashtree, langid, lines, periods, pieces, projections, quantised, semicrf, simhash, suffixes, urltrees
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.digest(fmindex.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashtree.shard_documents(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove(table(spark, sf_dir, "documents")).drop("spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.evaluate(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urltrees.judge(pages, urltrees.learn(pages, table(spark, sf_dir, "labels")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op9_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove(table(spark, sf_dir, "documents")).drop("spans")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semicrf.digest(semicrf.find(table(spark, sf_dir, "documents")))


def op11_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.search_every(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.planted(table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.mine_every(quantised.relabelled(table(spark, sf_dir, "embeddings")))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op 7 takes from the urls alone: hosts, paths and rules."""
    return urltrees.judge(table(spark, sf_dir, "pages"), urltrees.train([])).select("page_id", "host", "path", "rule")


def personal_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base of op 10: the kinds' counts, and what their spans hold, kind after kind."""
    docs = table(spark, sf_dir, "documents")
    found = semicrf.find(docs).select(F.col("doc_id").alias("_id"), "base")
    both = docs.select("doc_id", "text").join(found, F.col("doc_id") == F.col("_id"))

    def held(kind: str):
        own = F.array_sort(F.filter("base", lambda s: s["kind"] == kind))
        return F.array_join(F.transform(own, lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])), "|")

    return both.select("doc_id", *[held(kind).alias(kind) for kind in semicrf.KINDS])


URL_RULES_SQL = r"""
with u as (select page_id, case when contains(url, '://') then substring(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') as path from h)
select page_id, host, path, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/' when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
 when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/' when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from p
"""

PERSONAL_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as (select doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') as email, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') as ip,
 regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+') as card, regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]') as phone from d)
select doc_id, array_to_string(email, '|') as email,
 array_to_string(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda q: length(ltrim(q, '0')) > 3 or coalesce(try_cast(q as bigint), 999) > 255)) = 0), '|') as ip,
 array_to_string(list_filter(card, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) between 12 and 19 and list_sum(list_transform(range(1, length(regexp_replace(x, '[^0-9]', '', 'g')) + 1),
   lambda i: case when i % 2 = 1 then substring(reverse(regexp_replace(x, '[^0-9]', '', 'g')), i, 1)::int else (2 * substring(reverse(regexp_replace(x, '[^0-9]', '', 'g')), i, 1)::int) // 10 + (2 * substring(reverse(regexp_replace(x, '[^0-9]', '', 'g')), i, 1)::int) % 10 end)) % 10 = 0), '|') as card,
 array_to_string(list_filter(phone, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) between 9 and 15), '|') as phone from m
"""

OP1_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select distinct item_id, s, array_to_string(ws[i:i+s-1], ' ') as gram
       from (select item_id, ws, least(10, len(ws)) as s, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0)),
sizes as (select distinct s from bw),
dw as (select rid, i, s, array_to_string(ws[i:i+s-1], ' ') as gram
       from (select rid, ws, s, unnest(range(1, len(ws) - s + 2)) as i from d, sizes where len(ws) >= s)),
h as (select rid, i, s, item_id from dw join bw using (s, gram)),
cov as (select rid, count(distinct i + k) as n_hit from h, range(0, 10) t(k) where k < s group by rid),
it as (select rid, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as items from h group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (rid) left join it using (rid)
"""

OP3_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
w as (select rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
g as (select rid, i, array_to_string(ws[i:i+4], ' ') as gram from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w)),
r as (select rid, i from g qualify count(*) over (partition by rid, gram) > 1),
cov as (select rid, count(distinct i + k) as n_repeat_words from r, range(0, 5) t(k) group by rid),
ln as (select rid, doc_id, host, text, line from (select *, unnest(string_split(text, chr(10))) as line from d)
       where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select rid, count(*) - count(distinct line) as n_dup_lines from ln group by rid),
nl as (select rid, host, text, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) as l,
       length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as chars from ln),
hosts as (select host, count(distinct text) as n from d group by host),
freq as (select host, l from (select host, l, count(distinct text) as c from nl group by host, l) join hosts using (host)
         where c > 5 and c > 0.05 * n),
lost as (select rid, sum(chars) as lost from nl join freq using (host, l) group by rid),
b as (select d.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
      coalesce(lost, 0)::bigint as removed_chars
      from d join w using (rid) left join cov using (rid) left join dup using (rid) left join lost using (rid))
select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and word_chars - removed_chars >= 0.25 * word_chars as kept
from b
"""

OP5_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(doc_id, 9223372036854775807) as o, hex(encode(coalesce(text, ''))) as h from documents),
w as (select rid, o, p, substring(h, 2 * p + 1, 100) as g from (select rid, o, h, unnest(range(0, length(h) // 2 - 49)) as p from d where length(h) >= 100)),
m as (select g, min(o) as least from w group by g),
r as (select rid, p, lag(p) over (partition by rid order by p) as before from w join m using (g) where least < o),
s as (select rid, span, min(p) as a, max(p) + 50 as b from (select *, sum(case when before is null or p - before > 50 then 1 else 0 end) over (partition by rid order by p) as span from r) group by rid, span),
k as (select rid, string_agg(substring(h, 2 * prior + 1, 2 * (a - prior)), '' order by a) || substring(any_value(h), 2 * max(b) + 1) as kept, sum(b - a) as gone, count(*) as spans
      from (select s.*, d.h, coalesce(lag(b) over (partition by s.rid order by a), 0) as prior from s join d using (rid)) group by rid)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join k using (rid)
"""

OP9_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(doc_id, 9223372036854775807) as o, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
w as (select rid, o, p, array_to_string(ws[p:p+49], ' ') as g from (select rid, o, ws, unnest(range(1, len(ws) - 48)) as p from d where len(ws) >= 50)),
m as (select g, min(o) as least from w group by g),
r as (select distinct rid, p + k as p from w join m using (g), range(0, 50) t(k) where least < o),
u as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as p from d),
k as (select rid, string_agg(word, ' ' order by p) as kept from u anti join r using (rid, p) group by rid),
c as (select rid, count(*) as gone from r group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (rid) left join c using (rid)
"""

#: Runs as stretches of places from which five words are the same some words on; the checksum is worked out bit by bit.
OP12_SQL = r"""
with recursive bits as (select i::bigint as i, 0 as k, i::bigint as c from range(256) t(i)
 union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
d as (select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
h as (select rid, doc_id, ws, len(ws) as n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295::bigint) as h from d, crc),
g as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a, h // 10 as g from h),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from g),
w as (select rid, doc_id, n, case when a is null then ws else list_transform(range(0, n), lambda i: case when i < a then ws[i + 1] else ws[a + (i - a) % p + 1] end) end as ws from p),
f as (select rid, n, i, array_to_string(ws[i + 1:i + 5], ' ') as gram from (select rid, n, ws, unnest(range(0, n - 4)) as i from w where n >= 6)),
m as (select x.rid, x.i, y.i - x.i as q from f x join f y on x.rid = y.rid and x.gram = y.gram and y.i > x.i and 4 * (y.i - x.i) <= x.n),
s as (select rid, q, min(i) as start, count(*) + 4 + q as length from (select *, i - row_number() over (partition by rid, q order by i) as isle from m) group by rid, q, isle),
r as (select rid, start, length, min(q) as period from s where length >= greatest(6, 4 * q) group by rid, start, length),
o as (select rid, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from r group by rid),
top as (select * from r x qualify row_number() over (partition by rid order by (length::hugeint * 1000000000000 // period) desc, start, period) = 1),
gone as (select distinct rid, unnest(range(start + period, start + length)) as i from r),
kept as (select rid, string_agg(word, ' ' order by i) as kept from (select rid, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from w) anti join gone using (rid, i) group by rid)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, start::bigint as start, length::bigint as length, period::bigint as period, (1000 * length // period)::bigint as exponent_milli,
 sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from w left join o using (rid) left join top using (rid) left join kept using (rid)
"""

OP13_SQL = r"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
 where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor, b.vec_id as other, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor, other, score from s where same qualify row_number() over (partition by anchor order by score desc, other) <= 5)
select p.anchor as anchor_id, p.other as positive_id, (row_number() over (partition by p.anchor, p.other order by n.score desc, n.other))::int as rank, n.other as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor = p.anchor and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score qualify rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_hash_tree": op2_hash_tree,
        "op3_quality_rules": op3_quality_rules,
        "op4_simhash": op4_simhash,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_language_id": op6_language_id,
        "op7_url_filters": op7_url_filters,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_de_bruijn": op9_de_bruijn,
        "op10_pii": op10_pii,
        "op11_stable_projections": op11_stable_projections,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_hard_negatives": op13_hard_negatives,
        "url_rules": url_rules,
        "personal_patterns": personal_patterns,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op3_quality_rules": OP3_SQL, "op5_suffix_dedup": OP5_SQL, "op9_de_bruijn": OP9_SQL, "op12_periodic_runs": OP12_SQL, "op13_hard_negatives": OP13_SQL, "url_rules": URL_RULES_SQL, "personal_patterns": PERSONAL_SQL}
