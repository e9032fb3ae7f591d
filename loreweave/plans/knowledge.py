"""Registered queries: text functions, similarity, curation, consistency, chunks and index."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions import redact as secrets
from loreweave.functions import text as T
from loreweave.functions.vectors import truncated
from loreweave.operators import catalog, chunking, curation, lint, similarity
from loreweave.session import spread

from .base import query
from .retrieval import set_sql

DASHED = r"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _dashed(x: str) -> str:
    return DASHED.format(x=x)


@query(
    "slugs",
    f"""with d as (select doc_id, lang, text as t, {_dashed("text")} as s from documents), h as (select *, substring(s, 1, 60) as c from d),
    b as (select *, length(c) - instr(reverse(c), '-') as cut from h)
    select doc_id, coalesce(nullif(case when length(s) <= 60 then s else regexp_replace(case when instr(c, '-') > 0 and cut >= 36 then substring(c, 1, cut) else c end, '-+$', '') end, ''), 'untitled') as file_slug,
    coalesce(nullif(regexp_replace(substring(s, 1, 48), '-+$', ''), ''), 'section') as section_slug,
    coalesce(nullif(regexp_replace(regexp_replace(lower(lang || ' ' || t), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'general') as topic_slug,
    array_to_string((list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda w: w <> ''))[1:5], '-') as slug_part from b""",
)
def slugs(read):
    t = F.col("text")
    return read("documents").select(
        "doc_id", T.slug(t).alias("file_slug"), T.section_slug(t).alias("section_slug"), T.topic_slug(F.concat_ws(" ", "lang", t)).alias("topic_slug"), T.slug_part(t).alias("slug_part")
    )


@query(
    "normalized_texts",
    r"""select doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')) as plain, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) as lines, substring(sha256(text), 1, 16) as short_hash from documents""",
)
def normalized_texts(read):
    t = F.col("text")
    return read("documents").select("doc_id", F.sha2(T.normalize(t), 256).alias("plain"), F.sha2(T.normalize_newlines(t), 256).alias("lines"), F.substring(F.sha2(t, 256), 1, 16).alias("short_hash"))


_LITERALS_SQL = r"""
with b as (select doc_id, regexp_replace(text, '```[\s\S]*?```', ' ', 'g') as t from documents),
f as (select doc_id, list_transform(regexp_extract_all(t, '\b\d+(?:[.,]\d+)*(?:\s?(?:ms|s|m|h|kb|mb|gb|tok|tokens|%)|(?:\s?(?:million|billion)))?\b') || regexp_extract_all(t, 'https?://[^\s)"''\]]+') || regexp_extract_all(t, '\bv?\d+\.\d+(?:\.\d+)?\b'), lambda x: trim(x, ' ')) as xs from b)
select doc_id, array_to_string(list_sort(list_distinct(list_filter(xs, lambda x: not regexp_full_match(x, '\d') and not regexp_full_match(x, '(19|20)\d{2}')))), '|') as literals from f
"""


@query("literals", _LITERALS_SQL)
def literals(read):
    return read("documents").select("doc_id", F.array_join(F.array_sort(T.literals(F.col("text"))), "|").alias("literals"))


@query("page_links", """select page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) as link from pages""")
def page_links(read):
    return read("pages").select("page_id", F.explode(T.html_links(F.col("html"))).alias("link"))


@query(
    "markdown_links",
    r"""with m as (select page_id, '[a](' || regexp_replace(url, '^https?://[^/]*/', '') || ') [b](' || url || ') [c](#top) x' as t from pages),
    l as (select page_id, unnest(regexp_extract_all(t, '\[[^\]]*\]\(([^)]+)\)', 1)) as link from m)
    select page_id, split_part(link, '#', 1) as target from l where not regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') and not starts_with(link, '#')""",
)
def markdown_links(read):
    bare = F.regexp_replace("url", "^https?://[^/]*/", "")
    text = F.concat(F.lit("[a]("), bare, F.lit(") [b]("), "url", F.lit(") [c](#top) x"))
    return read("pages").select("page_id", F.explode(T.markdown_links(text)).alias("target"))


_COUNT = [(n, p) for n, p, _ in secrets.PATTERNS]
_CHAIN = "text"
_FOUND = []
for _n, _p, _m in secrets.PATTERNS:
    _q = (_p.replace("(?!or-v1-|ant-)", "")).replace("'", "''")
    _FOUND.append(f"len(regexp_extract_all({_CHAIN}, '{_q}'))::int as {_n}")
    _CHAIN = f"regexp_replace({_CHAIN}, '{_q}', '{_m}', 'g')"


# the other engine's patterns know no lookahead; it only parts keys that differ in their third letter
@query("redaction", f"select doc_id, {', '.join(_FOUND)}, sha256({_CHAIN}) as redacted from documents")
def redaction(read):
    found = spread(read("documents").select("doc_id", "text")).select("doc_id", F.explode(F.array(secrets.redacted(F.col("text")))).alias("r"))
    return found.select("doc_id", secrets.counts(F.col("r.counts")).alias("f"), F.sha2("r.text", 256).alias("redacted")).select("doc_id", "f.*", "redacted")


@query(
    "truncated_vectors",
    "with h as (select vec_id, embedding[1:16]::double[] as e from embeddings) select vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) as first, round(e[16] / sqrt(list_dot_product(e, e)), 6) as last from h",
)
def truncated_vectors(read):
    v = truncated(F.col("embedding"), 16)
    return read("embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 15), 6).alias("last"))


@query(
    "suggested_topics",
    "select id, case kind when 'architecture' then 'architecture' when 'invariant' then 'invariants' when 'decision' then 'decisions' when 'gotcha' then 'gotchas' when 'fact' then 'facts' else 'notes' end as topic from judged",
)
def suggested_topics(read):
    return read("judged").select("id", T.suggested_topic(F.col("kind")).alias("topic"))


@query(
    "file_patterns",
    r"""with x as (select id, file_a as f, case id % 8 when 0 then 'src/*.py' when 1 then './src/' when 2 then 'src/3.py' when 3 then 'lib' when 4 then '*/' || (id % 7)::varchar || '.py' when 5 then '' when 6 then 'src/3' else 's*c/?.py' end as p from claim_rows)
    select id, case id % 8 when 0 then true when 1 then true when 2 then f = 'src/3.py' when 4 then f = 'src/' || (id % 7)::varchar || '.py' else false end as fits from x""",
)
def file_patterns(read):
    i = F.col("id")
    p = F.when(i % 8 == 0, "src/*.py").when(i % 8 == 1, "./src/").when(i % 8 == 2, "src/3.py").when(i % 8 == 3, "lib").when(i % 8 == 4, F.concat(F.lit("*/"), (i % 7).cast("string"), F.lit(".py"))).when(i % 8 == 5, "").when(i % 8 == 6, "src/3").otherwise("s*c/?.py")
    return read("claim_rows").select("id", T.file_matches(F.col("file_a"), p).alias("fits"))


# --- similarity --------------------------------------------------------------------------------------------------

_CLAIMS = f"claims as (select id, page, {set_sql('text')} as ts from claim_rows)"


@query(
    "similar_claims",
    f"""with {_CLAIMS}, p as (select a.id as a, b.id as b, len(list_intersect(a.ts, b.ts)) as shared, least(len(a.ts), len(b.ts)) as n from claims a, claims b where a.id < b.id)
    select a, b, shared::int as shared, round(shared / n::double, 6) as score from p where n > 0 and shared / n::double >= 0.72 - 1e-12""",
)
def similar_claims(read):
    rows = read("claim_rows").select("id", T.token_set(F.col("text")).alias("tokens"))
    return similarity.similar_pairs(rows, 0.72).withColumn("score", F.round("score", 6))


@query(
    "duplicate_candidates",
    f"""with {_CLAIMS}, p as (select a.id as a, b.id as b, len(list_intersect(a.ts, b.ts)) as shared, least(len(a.ts), len(b.ts)) as n from claims a, claims b where a.id < b.id and a.page <> b.page)
    select a, b from p where n > 0 and shared / n::double >= 0.72 - 1e-12 order by a, b limit 6""",
)
def duplicate_candidates(read):
    rows = read("claim_rows").select("id", "page", T.token_set(F.col("text")).alias("tokens"))
    return similarity.duplicate_candidates(rows).select("a", "b")


@query(
    "contradiction_candidates",
    f"""with c as (select id, page, file_a, file_b, {set_sql("text")} as ts from claim_rows)
    select a.id as a, b.id as b from c a, c b where a.id < b.id and a.page <> b.page and (a.file_a = b.file_a or a.file_b = b.file_b)
    and coalesce(len(list_intersect(a.ts, b.ts)) / nullif(least(len(a.ts), len(b.ts)), 0)::double, 0) < 0.9 order by 1, 2 limit 8""",
)
def contradiction_candidates(read):
    rows = read("claim_rows").select("id", "page", F.array("file_a", "file_b").alias("files"), T.token_set(F.col("text")).alias("tokens"))
    return similarity.contradiction_candidates(rows)


@query(
    "best_matching_claim",
    f"""with {_CLAIMS}, q as (select item_id as query_id, {set_sql("text")} as qt from benchmark),
    s as (select query_id, id, len(list_intersect(qt, ts)) / least(len(qt), len(ts))::double as raw from q, claims where len(list_intersect(qt, ts)) > 0)
    select query_id, id, round(raw, 6) as score from (select *, row_number() over (partition by query_id order by raw desc, id) as r from s where raw >= 0.3) where r = 1""",
)
def best_matching_claim(read):
    asked = read("benchmark").select(F.col("item_id").alias("query_id"), T.token_set(F.col("text")).alias("tokens"))
    return similarity.best_match(asked, read("claim_rows").select("id", T.token_set(F.col("text")).alias("tokens")), 0.3)


@query(
    "recurrence",
    f"""with {_CLAIMS}, p as (select a.id as a, b.id as b from claims a, claims b where a.id <> b.id and least(len(a.ts), len(b.ts)) > 0 and len(list_intersect(a.ts, b.ts)) / least(len(a.ts), len(b.ts))::double >= 0.7 - 1e-12)
    select id, count(b) as n from claims left join p on a = id group by id""",
)
def recurrence(read):
    return similarity.recurrence(read("claim_rows").select("id", T.token_set(F.col("text")).alias("tokens")))


# text after text of a key joins the first group whose first text it resembles, or opens one
_PROMOTED_SQL = f"""with recursive r as (select 'k' || (id % 7)::varchar as key, id as ord, text, {set_sql("text")} as ts, id % 19 = 0 as accepted, row_number() over (partition by id % 7 order by id) as n from claim_rows),
w as (select distinct key, 0::bigint as n, []::struct(ord bigint, text varchar, ts varchar[], size bigint, barred boolean)[] as g from r
  union all
  select key, n, case when hit is null then list_append(g, {{'ord': ord, 'text': text, 'ts': ts, 'size': 1::bigint, 'barred': accepted}}) else list_transform(g, lambda x, i: case when i = hit then {{'ord': x.ord, 'text': x.text, 'ts': x.ts, 'size': x.size + 1, 'barred': x.barred or accepted}} else x end) end
  from (select r.key, r.n, r.ord, r.text, r.ts, r.accepted, w.g, nullif(list_position(list_transform(w.g, lambda x: least(len(x.ts), len(r.ts)) > 0 and len(list_intersect(x.ts, r.ts)) / least(len(x.ts), len(r.ts))::double >= 0.25), true), 0) as hit from w join r on r.key = w.key and r.n = w.n + 1)),
last as (select key, arg_max(g, n) as g from w group by key), u as (select key, unnest(g) as x from last)
select key, x.ord as ord, x.text as text, x.size as size from u where x.size >= 3 and not x.barred"""


@query("promoted_texts", _PROMOTED_SQL)
def promoted_texts(read):
    rows = read("claim_rows").select(
        F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("key"), F.col("id").alias("ord"), "text", T.token_set(F.col("text")).alias("tokens"), (F.col("id") % 19 == 0).alias("accepted"), F.lit(False).alias("promoted")
    )
    return similarity.promote_recurring(rows, 0.25)


@query(
    "closest_passages",
    f"""with q as (select id as query_id, {set_sql("text")} as qt, text from claim_rows), p as (select query_id, qt, unnest(string_split(text, chr(10))) as passage, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from q),
    s as (select query_id, pos, passage, len(list_intersect(qt, {set_sql("passage")})) / least(len(qt), len({set_sql("passage")}))::double as raw from p where len({set_sql("passage")}) > 0 and len(qt) > 0)
    select query_id, pos::int as at, passage from (select *, row_number() over (partition by query_id order by raw desc, pos) as r from s where raw > 0) where r = 1""",
)
def closest_passages(read):
    claims = read("claim_rows")
    docs = claims.select(F.col("id").alias("query_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return similarity.closest_passage(docs, claims.select(F.col("id").alias("query_id"), T.token_set(F.col("text")).alias("tokens"))).drop("score")


# --- curation ----------------------------------------------------------------------------------------------------

_LADDER = """case when sensitive >= 0.9 then 'reject_sensitive'
 when derivable >= 0.5 then case when coalesce(kind, '') in ('architecture', 'invariant', 'decision') and importance_norm >= 0.6 and grounded >= 0.5 then 'review' else 'reject_derivable' end
 when already_known >= 0.9 then 'reject_duplicate' when grounded >= 0.8 and importance >= 1 and relation in ('extends', 'consistent') then 'reinforce'
 when grounded >= 0.8 and importance >= 1 then case when durable < 0.5 and importance_norm < 0.5 then 'review' else 'file' end
 when grounded >= 0.7 then case when trust_tier = 'user_stated' and durable >= 0.5 and importance >= 1 then 'file_user_stated' else 'review' end
 when trust_tier = 'user_stated' and durable >= 0.5 and importance >= 1 then 'file_user_stated'
 when trust_tier = 'verified_in_repo' and durable >= 0.5 and importance >= 1 then 'file' else 'reject_unsupported' end"""


@query("decision_ladder", f"select id, {_LADDER} as action, round(case when ({_LADDER}) in ('reject_sensitive', 'reject_derivable', 'reject_duplicate') then 0 else 0.45 * grounded + 0.25 * importance_norm + 0.2 * (1 - derivable) + 0.08 end, 6) as score from judged")
def decision_ladder(read):
    action, score = curation.decide()
    return read("judged").select("id", action.alias("action"), F.round(score, 6).alias("score"))


@query("action_counts", f"select action, count(*) as n, round(avg(grounded), 6) as grounded from (select *, {_LADDER} as action from judged) group by action")
def action_counts(read):
    action, _ = curation.decide()
    return read("judged").withColumn("action", action).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("grounded"), 6).alias("grounded"))


@query("reinforced_claims", "select id, round(least(0.99, greatest(grounded, 0.85 + 0.02 * (id % 9 + 1))), 6) as support, id % 9 + 1 as corroborations from judged")
def reinforced_claims(read):
    support, more = curation.reinforced_support(F.col("grounded"), F.col("id") % 9)
    return read("judged").select("id", F.round(support, 6).alias("support"), more.alias("corroborations"))


@query(
    "writer_modes",
    "select id, case when criticality >= 0.95 then 'guided' when criticality >= 0.85 and mode = 'auto' then 'draft' when criticality >= 0.85 and mode = 'draft' then 'guided' else mode end as mode from (select *, case when id % 3 = 0 then 'auto' when id % 3 = 1 then 'draft' else 'guided' end as mode from judged)",
)
def writer_modes(read):
    mode = F.when(F.col("id") % 3 == 0, "auto").when(F.col("id") % 3 == 1, "draft").otherwise("guided")
    return read("judged").select("id", curation.writer_mode(mode, F.col("criticality")).alias("mode"))


_REVIEW = "select *, case when id % 5 = 0 then 'accept' when id % 5 = 1 then 'reject' when id % 5 = 2 then 'supersede' when id % 5 = 3 then 'defer' else 'out_of_scope' end as resolution, case when id % 7 = 0 then 'user-stated' else 'needs_recheck' end as status, id % 2 = 0 as confirmed from judged"


@query(
    "reviewed_claims",
    f"""select id, case when (criticality >= 0.85 and resolution <> 'defer' and not confirmed) or resolution in ('defer', 'out_of_scope') then status when resolution = 'accept' then case when status = 'user-stated' then status else 'verified' end
    when resolution = 'reject' then 'rejected' else 'superseded' end as status from ({_REVIEW})""",
)
def reviewed_claims(read):
    i = F.col("id")
    resolution = F.when(i % 5 == 0, "accept").when(i % 5 == 1, "reject").when(i % 5 == 2, "supersede").when(i % 5 == 3, "defer").otherwise("out_of_scope")
    status = F.when(i % 7 == 0, "user-stated").otherwise("needs_recheck")
    return read("judged").select("id", curation.reviewed_status(resolution, status, F.col("criticality"), i % 2 == 0).alias("status"))


def _items(read):
    i = F.col("id")
    return read("judged").select(
        i, F.when(i % 3 == 0, "dispute").when(i % 3 == 1, "needs_recheck").otherwise("claim_review").alias("kind"), F.when(i % 4 == 0, "resolved").otherwise("open").alias("status"), F.concat(F.lit("p"), (i % 9).cast("string")).alias("page"),
        F.concat(F.lit("c"), (i % 31).cast("string")).alias("claim_text"), "criticality"
    )


@query("review_queue", "select id, case when id % 3 = 0 then 'dispute' when id % 3 = 1 then 'needs_recheck' else 'claim_review' end as kind, criticality from judged where id % 4 <> 0 order by id % 3, criticality desc, id limit 20")
def review_queue(read):
    return curation.review_queue(_items(read)).select("id", "kind", "criticality")


@query("review_enqueue", "with o as (select distinct id % 3 as k, id % 9 as p, id % 31 as c from judged where id % 4 <> 0), n as (select distinct (id + 1) % 3 as k, (id + 2) % 9 as p, id % 31 as c from judged) select (select count(*) from judged) + (select count(*) from n where (k, p, c) not in (select (k, p, c) from o)) as n_items")
def review_enqueue(read):
    items, i = _items(read), F.col("id")
    new = read("judged").select(
        (i + 10_000_000).alias("id"), F.when((i + 1) % 3 == 0, "dispute").when((i + 1) % 3 == 1, "needs_recheck").otherwise("claim_review").alias("kind"), F.lit("open").alias("status"), F.concat(F.lit("p"), ((i + 2) % 9).cast("string")).alias("page"),
        F.concat(F.lit("c"), (i % 31).cast("string")).alias("claim_text"), "criticality"
    )
    return curation.enqueue(items, new).agg(F.count(F.lit(1)).alias("n_items"))


@query(
    "synced_claims",
    """select id, case when durable >= 0.9 then 'superseded' when grounded < 0.1 then 'disputed' when grounded < 0.8 then 'needs_recheck' else 'verified' end as status, round(case when grounded < 0.1 then greatest(0.85, 1 - grounded) else greatest(0.4, 1 - grounded) end, 6) as criticality from judged""",
)
def synced_claims(read):
    status, criticality = curation.synced_status(F.lit("verified"), F.col("grounded"), F.col("durable"), 0.9)
    return read("judged").select("id", status.alias("status"), F.round(criticality, 6).alias("criticality"))


@query("applied_updates", "select id, source, case when id % 6 = 0 then 'new' else lang end as lang, criticality from judged")
def applied_updates(read):
    claims = read("judged").select("id", "source", "lang", "criticality")
    return curation.apply_to_claims(claims, claims.where("id % 6 = 0").select("id", F.lit("new").alias("lang")))


@query("writer_groups", "select case when id % 4 = 0 then 't' || (id % 8)::varchar else coalesce(kind || ':', '') || lang end as key, count(*) as n, max(criticality) as worst, array_to_string(list_sort(list(id)), ',') as ids from judged group by 1")
def writer_groups(read):
    rows = read("judged").select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("t"), (F.col("id") % 8).cast("string"))).alias("target"), F.col("kind").alias("page_type"), F.col("lang").alias("topic"), "criticality")
    return curation.writer_groups(rows).select("key", "n", "worst", F.array_join("ids", ",").alias("ids"))


@query(
    "tournament",
    """with f as (select concat('c', (doc_id % 5)::varchar) as claim_id, row_number() over (partition by doc_id % 5 order by doc_id) as position, doc_id as page, (doc_id * 37 % 101) * 0.01 as fit, (doc_id * 53 % 103) * 0.01 as final_fit from documents),
    w as (select * from (select *, row_number() over (partition by claim_id, (position - 1) // 250 order by fit desc, position) as r from f) where r = 1 and fit >= 0.6),
    n as (select *, count(*) over (partition by claim_id) as n from w), b as (select claim_id, page from (select *, row_number() over (partition by claim_id order by case when n = 1 then fit else final_fit end desc, position) as q from n) where q = 1)
    select claim_id, page as target from (select distinct claim_id from f) left join b using (claim_id)""",
)
def tournament(read):
    from pyspark.sql import Window

    d = F.col("doc_id")
    fits = read("documents").select(
        F.concat(F.lit("c"), (d % 5).cast("string")).alias("claim_id"), F.row_number().over(Window.partitionBy(d % 5).orderBy(d)).alias("position"), d.alias("page"), ((d * 37 % 101) * 0.01).alias("fit"), ((d * 53 % 103) * 0.01).alias("final_fit")
    )
    return curation.tournament(fits)


# --- consistency -------------------------------------------------------------------------------------------------


@query("topic_counts", "select source as topic, count(*) as n from documents group by 1")
def topic_counts(read):
    return lint.topic_counts(read("wiki_pages"))


@query("toc_filtered", "select path from wiki_pages where starts_with(path, 'src1/') and lang = 'en' and (contains(lower(title), 'th') or contains(lower(summary), 'th'))")
def toc_filtered(read):
    toc = read("wiki_pages").withColumn("tags", F.array("lang"))
    return lint.toc_filter(toc, topic="src1", tag="en", query="TH").select("path")


@query("toc_entries", "select path, title, coalesce(type, 'concept') as type, coalesce(summary, '(no summary)') as summary, coalesce(updated, '2026-02-01') as updated from wiki_pages")
def toc_entries(read):
    return lint.toc_entry(read("wiki_pages"), "2026-02-01")


@query(
    "toc_reconciliation",
    """select path, case when t.path is null then 'added' when p.path is null then 'missing_file' else 'updated' end as finding from wiki_pages p full join wiki_toc t using (path)
    where t.path is null or p.path is null or p.updated is distinct from t.updated or p.summary is distinct from t.summary""",
)
def toc_reconciliation(read):
    return lint.reconcile(read("wiki_pages"), read("wiki_toc"))


@query(
    "entries_hash",
    r"""with r as (select path, path || chr(0) || title || chr(0) || coalesce(type || chr(0), '') || lang || chr(0) || summary || coalesce(chr(0) || updated, '') as row from wiki_pages)
    select substring(sha256(string_agg(row, chr(10) order by path)), 1, 16) as entries_hash, count(*) as pages from r""",
)
def entries_hash(read):
    return lint.entries_hash(read("wiki_pages").withColumn("tags", F.array("lang")))


_LINKS = """links as (select 'p' || page_id::varchar as page, 'p' || ((page_id * 8 + k) % 300)::varchar as target from pages, range(0, 3) t(k))"""


def _links(read):
    return read("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("page"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"), "page_id").select(
        "page", F.concat(F.lit("p"), ((F.col("page_id") * 8 + F.col("k")) % 300).cast("string")).alias("target")
    )


@query("broken_links", f"with {_LINKS} select distinct page, target from links where target not in (select 'p' || page_id::varchar from pages)")
def broken_links(read):
    return lint.broken_links(_links(read), read("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path")))


@query(
    "orphan_pages",
    f"""with {_LINKS} select 'p' || page_id::varchar as path from pages where 'p' || page_id::varchar not in (select target from links where page <> target)
    and not coalesce(case when page_id % 5 = 0 then null when page_id % 5 = 1 then '2026-02-01' else '2026-01-10' end >= '2026-01-25', false)""",
)
def orphan_pages(read):
    i = F.col("page_id")
    pages = read("pages").select(F.concat(F.lit("p"), i.cast("string")).alias("path"), F.when(i % 5 == 0, None).when(i % 5 == 1, "2026-02-01").otherwise("2026-01-10").alias("updated"))
    return lint.orphans(pages, _links(read), "2026-02-01")


@query("link_degrees", f"with {_LINKS}, e as (select distinct * from links) select page, sum(o)::bigint as n_out, sum(i)::bigint as n_in from (select page, 1 as o, 0 as i from e union all select target, 0, 1 from e) group by page")
def link_degrees(read):
    return lint.link_degrees(_links(read))


@query(
    "page_classes",
    """with x as (select doc_id, case doc_id % 6 when 0 then 'index.md' when 1 then 'toc/a.md' when 2 then 'a/log.md' when 3 then 'notes/changelog.md' when 4 then 'log.md' else 'a/b.md' end as p from documents)
    select doc_id, p in ('index.md', 'log.md', 'toc.md') or starts_with(p, 'toc/') as meta, doc_id % 6 in (0, 2, 4) as generated, doc_id % 6 in (0, 4) as generated_root, doc_id % 6 in (0, 2, 3, 4) as skipped from x""",
)
def page_classes(read):
    names = F.array(*map(F.lit, ["index.md", "toc/a.md", "a/log.md", "notes/changelog.md", "log.md", "a/b.md"]))
    p = F.get(names, (F.col("doc_id") % 6).cast("int"))
    return read("documents").select("doc_id", lint.is_meta(p).alias("meta"), lint.is_generated(p).alias("generated"), lint.is_generated_root(p).alias("generated_root"), lint.is_skipped_by_sync(p).alias("skipped"))


@query("raw_backlog", "with n as (select path, regexp_extract(path, '([^/]+)$', 1) as name from raw_files where not starts_with(path, 'raw/sessions/')) select path from n where not exists (select 1 from raw_files p where contains(p.text, n.name))")
def raw_backlog(read):
    rows = read("raw_files")
    return lint.backlog(rows.select("path"), rows.select("text"))


@query(
    "resolved_links",
    """select page, case when doc_id % 8 <= doc_id % 6 then repeat('d/', (doc_id % 6 - doc_id % 8)::int) else repeat('../', (doc_id % 8 - doc_id % 6)::int) end || 'x/y' || (doc_id % 3)::varchar || '.md' as target from deep_links""",
)
def resolved_links(read):
    return lint.resolved_links(read("deep_links").select("page", "link"))


_FILES = "files as (select doc_id, case when doc_id % 3 = 0 then 'src/' || source else source end || '/f' || doc_id::varchar || '.ts' as path from documents)"


def _files(read):
    folder = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("src/"), "source")).otherwise(F.col("source"))
    return read("documents").select("doc_id", F.concat(folder, F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"))


@query(
    "import_edges",
    f"""with {_FILES}, e as (select distinct case when doc_id % 3 = 0 then 'src/src' || (doc_id % 20)::varchar else 'x' end as s, path, doc_id from files),
    m as (select doc_id, case when doc_id % 3 = 0 then regexp_extract(path, '^(src/[^/]+)', 1) else split_part(path, '/', 1) end as src, case when doc_id % 3 = 0 then 'src/src' || (doc_id % 4)::varchar else 'src' || (doc_id % 5)::varchar end as dst from files)
    select distinct src as src_module, dst as dst_module from m where src <> dst and dst in (select src from m)""",
)
def import_edges(read):
    files = _files(read)
    spec = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("../src"), (F.col("doc_id") % 4).cast("string"), F.lit("/./a"))).otherwise(F.concat(F.lit("../src"), (F.col("doc_id") % 5).cast("string"), F.lit("/b")))
    return lint.import_edges(files.withColumn("spec", spec), files)


@query(
    "code_modules",
    f"""with {_FILES}, m as (select doc_id, path, case when doc_id % 3 = 0 then regexp_extract(path, '^(src/[^/]+)', 1) else split_part(path, '/', 1) end as src, case when doc_id % 3 = 0 then 'src/src' || (doc_id % 4)::varchar else 'src' || (doc_id % 5)::varchar end as dst from files),
    e as (select distinct src, dst from m where src <> dst and dst in (select src from m)), n as (select src as module, count(*) as n_files from m group by 1)
    select module, n_files, coalesce((select array_to_string(list_sort(list(dst)), ',') from e where src = module), '') as imports, coalesce((select array_to_string(list_sort(list(src)), ',') from e where dst = module), '') as imported_by, false as entry from n
    union all select 'src', 1, '', '', true union all select '(root)', 2, '', '', true""",
)
def code_modules(read):
    files = _files(read)
    more = files.sparkSession.createDataFrame([("src/cli.py",), ("main.py",), ("setup.py",)], "path string")
    rows = lint.modules(files.select("path").unionByName(more), import_edges(read))
    return rows.select("module", "n_files", F.array_join("imports", ",").alias("imports"), F.array_join("imported_by", ",").alias("imported_by"), "entry")


@query("stale_references", f"with {_FILES} select 'w' || doc_id::varchar as path, case when doc_id % 4 = 0 then 'gone/' || doc_id::varchar else path end as file from files where doc_id % 4 = 0")
def stale_references(read):
    files = _files(read)
    declared = files.select(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("path"), F.array(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("gone/"), F.col("doc_id").cast("string"))).otherwise(F.col("path"))).alias("files"))
    return lint.stale_references(declared, files)


@query("raw_integrity", "select 'r' || doc_id::varchar as path, case when doc_id % 5 = 0 then 'missing' else 'drifted' end as finding from documents where doc_id % 5 = 0 or doc_id % 7 = 0")
def raw_integrity(read):
    docs = read("documents").withColumn("path", F.concat(F.lit("r"), F.col("doc_id").cast("string")))
    index = docs.select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.rtrim("text")), 256).alias("sha"))
    return lint.integrity(index, docs.where("doc_id % 5 <> 0").select("path", F.concat("text", F.lit("  ")).alias("text")))


# --- chunks, index, catalogue ------------------------------------------------------------------------------------


_WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# headings keep links and lose marks; lines lose both; sections without a text go before slugs are numbered
_SECTIONS = (
    r"""lines as (select path, title, unnest(regexp_split_to_array(text, '\r?\n')) as line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) as pos from <source>),
heads as (select *, regexp_matches(line, '^#{1,6}<ws>+[^\n\r\x{2028}\x{2029}]*$') as head from lines), parts as (select *, sum(head::int) over (partition by path order by pos) as section from heads),
bare as (select *, case when head then regexp_replace(regexp_replace(regexp_replace(line, '^#{1,6}<ws>+', ''), '[*_`]', '', 'g'), '^<ws>+|<ws>+$', '', 'g') end as h,
 case when not head then regexp_replace(regexp_replace(regexp_replace(line, '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '[*_`]', '', 'g'), '<ws>+$', '') end as l from parts),
cut as (select path, any_value(title) as title, section, coalesce(nullif(max(h), ''), 'overview') as heading, regexp_replace(coalesce(string_agg(l, chr(10) order by pos), ''), '^<ws>+|<ws>+$', '', 'g') as body from bare group by path, section),
named as (select *, coalesce(nullif(regexp_replace(substring(regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', ''), ''), 'section') as base from cut where body <> ''),
sections as (select *, case when row_number() over (partition by path, base order by section) = 1 then base else base || '-' || (row_number() over (partition by path, base order by section))::varchar end as slug from named)"""
).replace("<ws>", _WS)


@query("page_sections", f"with {_SECTIONS.replace('<source>', 'headed_pages')} select path, section::bigint as section, heading, slug, sha256(body) as body_hash from sections")
def page_sections(read):
    pages = read("headed_pages")
    return chunking.sections(pages, unique=chunking.unique_paths(pages)).select("path", "section", "heading", "slug", F.sha2("body", 256).alias("body_hash"))


# windows one after the other, each cut at the last blank line of its reach if that lies beyond its middle
_CHUNKS = (
    r"""<sections>,
s as (select path, title, heading, slug, body from sections),
e0 as (select *, 0 as a from s), w as (
  select path, slug, 1 as n, 0 as a, case when length(body) <= 4800 then length(body) else coalesce(case when instr(reverse(substring(body, 1, 4802)), E'\n\n') > 0 and 4802 - instr(reverse(substring(body, 1, 4802)), E'\n\n') - 1 > 2400 then 4802 - instr(reverse(substring(body, 1, 4802)), E'\n\n') - 1 end, 4800) end as b, length(body) as l, body, title from e0
  union all
  select path, slug, n + 1, a2, case when a2 + 4800 >= l then l else coalesce(case when instr(reverse(substring(body, 1, a2 + 4802)), E'\n\n') > 0 and least(l, a2 + 4802) - instr(reverse(substring(body, 1, a2 + 4802)), E'\n\n') - 1 > a2 + 2400 then least(l, a2 + 4802) - instr(reverse(substring(body, 1, a2 + 4802)), E'\n\n') - 1 end, a2 + 4800) end, l, body, title
  from (select *, greatest(b - 640, a + 1) as a2 from w where b < l)),
t as (select path, slug, title, case when l <= 4800 then body else regexp_replace(substring(body, a + 1, b - a), '^<ws>+|<ws>+$', '', 'g') end as text, n from w),
u as (select path, slug, title, text, row_number() over (partition by path, slug order by n) as n from t where text <> ''),
c as (select path, 'section:' || slug || case when n > 1 then '-' || n::varchar else '' end as key, coalesce(nullif(trim(title, ' '), ''), regexp_replace(path, '\.md$', '')) as title, text from u where length(text) >= 80),
k as (select path, key, title, text from (select *, row_number() over (partition by path, key order by text desc) as r from c) where r = 1)"""
).replace("<sections>", _SECTIONS.replace("<source>", "headed_pages")).replace("<ws>", _WS)
_CHUNKS_SQL = f"with recursive {_CHUNKS} select path, key, title, sha256(title || chr(10) || text) as hash, length(text)::int as n_chars from k"

# a page's claims: some with an id, some without, some blank, some that no longer hold
_CLAIMS_SQL = rf"""with c as (select page, case when id % 3 = 0 then null when id % 7 = 0 then '' else id::varchar end as id, case when id % 11 = 0 then ' ' || chr(9) else '  ' || text || chr(10) end as text, status from claim_rows where status in ('verified', 'user-stated')),
t as (select page, id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') as text, status from c),
k as (select page, 'claim:' || coalesce(id, coalesce(nullif(regexp_replace(substring(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', ''), ''), 'section')) as key, nullif(id, '') as claim_id, status, text from t where text <> '')
select page as path, key, claim_id, status, sha256('T ' || page || chr(10) || text) as hash from (select *, row_number() over (partition by page, key order by text desc) as r from k) where r = 1"""


@query("claim_chunks", _CLAIMS_SQL)
def claim_chunks(read):
    own = read("claim_rows")
    pages = own.select(F.col("page").alias("path"), F.concat(F.lit("T "), "page").alias("title"), F.lit("").alias("text")).distinct()
    id_ = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 7 == 0, "").otherwise(F.col("id").cast("string"))
    text = F.when(F.col("id") % 11 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    claims = own.select(F.col("page").alias("path"), id_.alias("id"), text.alias("text"), "status")
    return chunking.chunks(pages, claims).select("path", "key", "claim_id", "status", "hash")


@query("page_chunks", _CHUNKS_SQL)
def page_chunks(read):
    pages = read("headed_pages")
    return chunking.chunks(pages, unique=chunking.unique_paths(pages)).select("path", "key", "title", "hash", F.length("text").alias("n_chars"))


@query(
    "index_diff",
    """with c as (select doc_id as k, case when doc_id % 4 = 0 then 'changed' else sha256(text) end as h from documents where doc_id % 9 <> 0), s as (select doc_id as k, sha256(text) as h from documents where doc_id % 7 <> 0)
    select 'd' || coalesce(c.k, s.k)::varchar as path, 'k' as key, case when c.h is null then 'remove' when c.h = s.h then 'skip' else 'embed' end as action from c full join s on c.k = s.k""",
)
def index_diff(read):
    docs = read("documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit("k").alias("key"), F.sha2("text", 256).alias("hash"))
    now = docs.where("doc_id % 9 <> 0").withColumn("hash", F.when(F.col("doc_id") % 4 == 0, "changed").otherwise(F.col("hash")))
    return chunking.index_diff(now, docs.where("doc_id % 7 <> 0"))


@query("index_upsert_delete", "select source as wiki, doc_id::varchar as path, case when doc_id % 2 = 0 or doc_id % 4 = 1 then lang else 'old' end as fingerprint from documents where doc_id % 10 <> 3")
def index_upsert_delete(read):
    rows = read("documents").select(F.col("source").alias("wiki"), F.col("doc_id").cast("string").alias("path"), F.lit("k").alias("key"), F.col("lang").alias("fingerprint"), "doc_id")
    stored = rows.withColumn("fingerprint", F.lit("old"))
    new = rows.withColumn("k", F.when((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 4 == 1), F.col("key"))).where("k is not null").drop("k")
    return chunking.delete(chunking.upsert(stored, new), rows.where("doc_id % 10 = 3")).select("wiki", "path", "fingerprint")


def _registry(read):
    return read("supplier").select(F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_suppkey") % 5 != 0).alias("enabled"), F.col("s_suppkey").alias("k"))


@query("index_status", "select 'w' || s_suppkey::varchar as wiki, case when s_suppkey % 3 = 0 then 0 else s_suppkey end as chunks, s_suppkey % 3 = 0 as missing, s_suppkey % 3 = 1 as stale from supplier where s_suppkey % 5 <> 0")
def index_status(read):
    reg = _registry(read).withColumnRenamed("name", "wiki")
    state = reg.where("k % 3 <> 0").select("wiki", F.col("k").alias("chunks"), F.when(F.col("k") % 3 == 1, "old").otherwise("new").alias("fingerprint"))
    return chunking.index_status(reg.select("wiki", "enabled"), state, "new")


@query(
    "wiki_catalog",
    """with r as (select 'w' || s_suppkey::varchar as name, s_suppkey as k from supplier),
    x as (select name, k, case when k % 4 <> 0 then '2026-01-' || (10 + k % 20)::varchar end as g, case when k % 3 <> 0 then '2026-02-' || (10 + k % 18)::varchar end as u from r)
    select name, case when g is null then 0 else k * 2 end as pages, case when u is null then 0 else k end as chunks, coalesce(u, g, '') as recency,
    concat_ws(',', case when k % 5 = 0 then 'disabled' end, case when g is null then 'no_toc' end, case when g is not null and k % 2 = 0 then 'toc_stale' end, case when u is null then 'no_index' end, case when u is not null and k % 6 = 1 then 'index_stale' end) as flags
    from x order by recency desc, name limit 25 offset 5""",
)
def wiki_catalog(read):
    reg, k = _registry(read), F.col("k")
    made = F.concat(F.lit("2026-01-"), (10 + k % 20).cast("string"))
    manifests = reg.where("k % 4 <> 0").select("name", (k * 2).alias("pages"), made.alias("generated_at"), F.when(k % 2 == 0, "2026-09-01").otherwise("2025-01-01").alias("newest"))
    states = reg.where("k % 3 <> 0").select("name", k.alias("chunks"), F.when(k % 6 == 1, "old").otherwise("new").alias("fingerprint"), F.concat(F.lit("2026-02-"), (10 + k % 18).cast("string")).alias("updated_at"), F.lit("new").alias("current"))
    return catalog.catalog(reg.select("name", "enabled"), manifests, states, 25, 5)


@query("path_owners", "select source || '/a/' || doc_id::varchar || '.md' as path, source as name, false as ambiguous from documents where lang <> 'fr' order by path limit 20")
def path_owners(read):
    docs = read("documents")
    paths = docs.where("lang <> 'fr'").select(F.concat("source", F.lit("/a/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return catalog.owners(paths, docs.select(F.col("source").alias("name"), F.col("source").alias("root")).distinct())


@query("keep_last_union", "select doc_id, case when doc_id % 2 = 0 then 'new' else lang end as lang from documents")
def keep_last_union(read):
    docs = read("documents").select("doc_id", "lang")
    return catalog.union_keep_last(docs, docs.where("doc_id % 2 = 0").withColumn("lang", F.lit("new")), "doc_id")


@query(
    "unique_names",
    "select doc_id as ord, lang as name, case when row_number() over (partition by lang order by doc_id) = 1 then lang else lang || '-' || (row_number() over (partition by lang order by doc_id))::varchar end as unique_name from documents",
)
def unique_names(read):
    return catalog.unique_names(read("documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("name")))


@query(
    "raw_source_names",
    """with s as (select '2026-01-01' as day, lang as slug, sha256(text) as sha, doc_id as ord from documents), n as (select *, substring(sha, 1, 8) as s8, row_number() over (partition by slug order by ord) as n from s),
    a as (select *, sum((n > 1)::int) over (partition by slug, s8 order by ord) as again from n)
    select day, slug, sha, ord, day || '-' || slug || case when n = 1 then '' when again = 1 then '-' || s8 else '-' || s8 || '-' || again::varchar end || '.md' as name from a""",
)
def raw_source_names(read):
    return catalog.raw_names(read("documents").select(F.lit("2026-01-01").alias("day"), F.col("lang").alias("slug"), F.sha2("text", 256).alias("sha"), F.col("doc_id").alias("ord")))
