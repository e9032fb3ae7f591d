"""Registered queries: what flows make of claims, reviews, registries and models' answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave import api, models
from loreweave.functions.text import token_set
from loreweave.operators import catalog, curation, evidence, workflow
from loreweave.sources import changes, git

from .base import query
from .knowledge import _LADDER
from .retrieval import _BM25_SQL, set_sql, tokens_sql

_REASONS = f"""with j as (select *, {_LADDER} as action, list_filter([case when relation = 'contradicts' then 'contradicts existing knowledge — dispute' end], lambda x: x is not null) as noted from judged)
select id, array_to_string(case when action = 'reject_sensitive' then ['contains sensitive content']
 when derivable >= 0.5 then ['derivable from code (' || printf('%.2f', derivable) || ' ≥ 0.5)' || case when action = 'review' then ' but high-importance ' || kind || ' framing — queued for confirmation instead of dropped' else '' end]
 when action = 'reject_duplicate' then ['already known']
 else noted || list_filter([case when action = 'reinforce' then 'reinforces existing knowledge' when action = 'reject_unsupported' then 'not grounded in evidence' when action = 'file_user_stated' then case when grounded >= 0.7 then 'user-stated trust tier (auto-accepted)' else 'user-stated trust tier (lower confidence)' end
   when action = 'file' and (grounded < 0.8 or importance < 1) then 'repo-verified evidence' when action = 'review' and grounded >= 0.8 and importance >= 1 then 'low durability' when action = 'review' then 'below auto-accept threshold' end], lambda x: x is not null) end, '; ') as reasons from j"""


@query("decision_reasons", _REASONS)
def decision_reasons(read):
    return read("judged").select("id", F.array_join(curation.reasons(), "; ").alias("reasons"))


def _claims(read):
    rows = read("claim_rows").withColumn("tokens", token_set(F.col("text")))
    k = F.col("id")
    return rows.select(
        "id", "page", "text", "tokens", F.when(k % 11 == 0, "rejected").otherwise(F.col("status")).alias("status"), ((k % 90) * 0.01).alias("support"), F.when(k % 3 != 0, (k % 4).cast("int")).alias("corroborations"),
        F.lit("2025-01-01").alias("last_confirmed"), F.when(k % 2 == 0, F.array(F.lit("e1"))).alias("evidence"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("superseded_at"),
    )


@query(
    "active_claims",
    """select id, status is null or status in ('verified', 'user-stated', 'needs_recheck') as indexed, status is null or status not in ('superseded', 'rejected') as checked, status is null or status in ('verified', 'user-stated') as found, status is null or status = 'verified' as found_strictly
    from (select id, case when id % 9 = 0 then null else status end as status from claim_rows)""",
)
def active_claims(read):
    status = F.when(F.col("id") % 9 != 0, F.col("status"))
    kinds = {"indexed": ("index",), "checked": ("lint",), "found": ("search",), "found_strictly": ("search", True)}
    return read("claim_rows").select("id", *[curation.is_active(status, *how).alias(name) for name, how in kinds.items()])


_MET = f"""c as (select id, page, text, case when id % 11 = 0 then 'rejected' else status end as status, (id % 90) * 1e-2 as support, case when id % 3 <> 0 then id % 4 end as corroborations, {set_sql("text")} as ts from claim_rows),
q as (select id as query_id, page, text, {set_sql("case when id % 2 = 0 then text else regexp_replace(text, '^[a-zA-Z]+ ', 'zzzz ') end")} as ts from claim_rows where id % 5 < 2),
s as (select query_id, c.id, len(list_intersect(q.ts, c.ts)) / least(len(q.ts), len(c.ts))::double as score from q join c on c.page = q.page and c.status not in ('superseded', 'rejected') and least(len(q.ts), len(c.ts)) > 0),
b as (select query_id, id from (select *, row_number() over (partition by query_id order by score desc, id) as r from s where score >= {{least}}) where r = 1)"""


def _newer(read):
    text = F.when(F.col("id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "^[a-zA-Z]+ ", "zzzz "))
    return read("claim_rows").where("id % 5 < 2").select(F.col("id").alias("query_id"), "page", "text", token_set(text).alias("tokens"), F.array(F.lit("e1"), F.concat(F.lit("f"), (F.col("id") % 3).cast("string"))).alias("evidence"))


@query(
    "confirmed_claims",
    f"""with {_MET.format(least=0.5)}, n as (select id, count(*) as n, list_distinct(list('f' || (query_id % 3)::varchar)) as fs from b group by id)
    select c.id, round(case when n is null then support else least(0.99, greatest(support, 0.85 + 0.02 * (coalesce(corroborations, 1) + n))) end, 6) as support, (case when n is null then corroborations else coalesce(corroborations, 1) + n end)::bigint as corroborations,
    case when n is null then '2025-01-01' else '2026-02-01' end as last_confirmed, case when n is null then case when c.id % 2 = 0 then 'e1' else '' end else array_to_string(list_sort(list_distinct(['e1'] || fs)), ',') end as evidence from c left join n using (id)""",
)
def confirmed_claims(read):
    rows = curation.reinforce(_claims(read), _newer(read), "2026-02-01")
    return rows.select("id", F.round("support", 6).alias("support"), F.col("corroborations").cast("long").alias("corroborations"), "last_confirmed", F.coalesce(F.array_join(F.array_sort("evidence"), ","), F.lit("")).alias("evidence"))


@query(
    "superseded_claims",
    f"""with {_MET.format(least=0.35)}, n as (select b.id, arg_max(q.text, q.query_id) as by_text from b join q using (query_id) group by 1)
    select c.id, case when by_text is null then status else 'superseded' end as status, substring(by_text, 1, 100) as superseded_by, case when by_text is not null then '2026-02-01' end as superseded_at from c left join n using (id)""",
)
def superseded_claims(read):
    return curation.supersede(_claims(read), _newer(read), "2026-02-01").select("id", "status", "superseded_by", "superseded_at")


_ITEMS = "i as (select id, criticality, case id % 6 when 0 then 'accept' when 1 then 'reject' when 2 then 'supersede' when 3 then 'defer' when 4 then 'out_of_scope' end as want, id % 2 = 0 as sure from judged)"


def _resolved(read):
    k = F.col("id")
    items = read("judged").select("id", "criticality", F.lit("open").alias("status"), F.lit(None).cast("string").alias("resolution"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("resolved_at"))
    want = F.when(k % 6 == 0, "accept").when(k % 6 == 1, "reject").when(k % 6 == 2, "supersede").when(k % 6 == 3, "defer").when(k % 6 == 4, "out_of_scope")
    wanted = read("judged").select("id", want.alias("resolution"), F.lit("seen").alias("note"), (k % 2 == 0).alias("confirmed")).where("resolution is not null")
    return curation.resolve_reviews(items, wanted, "2026-02-01T10:00")


@query(
    "resolved_reviews",
    f"""with {_ITEMS}, h as (select *, want <> 'defer' and criticality >= 0.85 and not sure as held from i) select id, criticality, case when want is null then 'open' when held or want = 'defer' then 'deferred' else 'resolved' end as status, case when held then 'defer' else want end as resolution,
    case when want is null then null when held then 'critical item requires user confirmation' else 'seen' end as note, case when want is not null then '2026-02-01T10:00' end as resolved_at from h""",
)
def resolved_reviews(read):
    return _resolved(read)


_APPLIED = f"""with {_ITEMS}, d as (select id, want from i where want is not null and want not in ('defer') and not (criticality >= 0.85 and not sure)),
c as (select id, 'p' || (id % 9)::varchar as page, case id % 4 when 0 then 'user-stated' when 1 then null else 'needs_recheck' end as status, grounded as support from judged)
select c.id, case when want = 'accept' then case when status = 'user-stated' then status else 'verified' end when want = 'reject' then 'rejected' when want = 'supersede' then 'superseded' else status end as status,
round(case when want = 'accept' and status is distinct from 'user-stated' then greatest(support, 0.8) else support end, 6) as support, case when want is not null and want <> 'out_of_scope' then '2026-02-01' end as reviewed from c left join d using (id)"""


@query("applied_reviews", _APPLIED)
def applied_reviews(read):
    k = F.col("id")
    page, text = F.concat(F.lit("p"), (k % 9).cast("string")), F.concat(F.lit("text "), k.cast("string"))
    claims = read("judged").select(page.alias("page"), k.cast("string").alias("id"), text.alias("text"), F.when(k % 4 == 0, "user-stated").when(k % 4 > 1, "needs_recheck").alias("status"), F.col("grounded").alias("support"), F.lit(None).cast("string").alias("reviewed"))
    # half of the items know their claim's id, half its text only
    done = _resolved(read).where("status = 'resolved'").select(page.alias("page"), F.when(k % 2 == 0, k.cast("string")).alias("claim_id"), text.alias("claim_text"), "resolution")
    return curation.apply_reviews(claims, done, "2026-02-01").select(F.col("id").cast("long").alias("id"), "status", F.round("support", 6).alias("support"), "reviewed")


@query(
    "sync_updates",
    """with i as (select id, 'p' as page, case id % 5 when 0 then 'no_impact' when 1 then 'needs_recheck' when 2 then 'supersede' when 3 then 'contradict' end as impact, case when id % 7 = 0 then 0.5 else grounded end as t from judged)
    select page, id, case impact when 'no_impact' then 'verified' when 'supersede' then 'superseded' when 'contradict' then 'disputed' else 'needs_recheck' end as status, case when impact = 'supersede' then 'commit abcdef0' end as superseded_by,
    case impact when 'no_impact' then null when 'contradict' then 'dispute' else 'needs_recheck' end as kind, round(case impact when 'no_impact' then null when 'contradict' then greatest(0.85, 1 - t) else greatest(0.4, 1 - t) end, 6) as criticality from i""",
)
def sync_updates(read):
    k = F.col("id")
    impact = F.when(k % 5 == 0, "no_impact").when(k % 5 == 1, "needs_recheck").when(k % 5 == 2, "supersede").when(k % 5 == 3, "contradict")
    rows = read("judged").select(F.lit("p").alias("page"), "id", F.lit("verified").alias("status"), impact.alias("impact"), F.when(k % 7 != 0, F.col("grounded")).alias("still_true"))
    return curation.sync_updates(rows, "abcdef0123").withColumn("criticality", F.round("criticality", 6))


@query("review_criticalities", "select id, round(greatest(0.3, 1 - grounded), 6) as review, round(case id % 4 when 0 then 0.45 when 1 then 0.5 when 2 then greatest(0.7, durable) end, 6) as lint from judged")
def review_criticalities(read):
    k = F.col("id") % 4
    finding = F.when(k == 0, "unbacked_claim").when(k == 1, "duplicate").when(k == 2, "contradiction").otherwise("orphan")
    return read("judged").select("id", F.round(curation.review_criticality(F.col("grounded")), 6).alias("review"), F.round(curation.lint_criticality(finding, F.col("durable")), 6).alias("lint"))


# --- registries and places ---------------------------------------------------------------------------------------


@query(
    "registered_roots",
    """with r as (select 's' || (s_suppkey % 3)::varchar || case when s_suppkey > 3 then '-' || s_suppkey::varchar else '' end as name, '/old/' || s_suppkey::varchar as root from supplier where s_suppkey <= 6),
    n as (select distinct '/new/' || s_suppkey::varchar as root, 's' || (s_suppkey % 3)::varchar as base, s_suppkey as ord from supplier), k as (select *, row_number() over (partition by base order by ord, root) as nth from n),
    f as (select base, case when i = 1 then base else base || '-' || i::varchar end as name, row_number() over (partition by base order by i) as nth from (select distinct base from n) b, range(1, 3000) t(i) where case when i = 1 then base else base || '-' || i::varchar end not in (select name from r))
    select name, root from r union all select f.name, k.root from k join f using (base, nth)""",
)
def registered_roots(read):
    k = F.col("s_suppkey")
    base = F.concat(F.lit("s"), (k % 3).cast("string"))
    old = read("supplier").where("s_suppkey <= 6").select(F.when(k > 3, F.concat_ws("-", base, k.cast("string"))).otherwise(base).alias("name"), F.concat(F.lit("/old/"), k.cast("string")).alias("root"), F.lit(True).alias("enabled"), F.lit("2025").alias("added"))
    new = read("supplier").select(F.concat(F.lit("\\new\\"), k.cast("string"), F.lit("/")).alias("root"), base.alias("name"), k.alias("ord"))
    return catalog.register(old, new.unionByName(old.select(F.col("root"), F.lit("x").alias("name"), F.lit(0).cast("long").alias("ord"))), "2026").select("name", "root")


@query(
    "resolved_pages",
    """with a as (select distinct case doc_id % 4 when 0 then '/abs/' || lang || '.md' when 1 then 'notes/' || source || '.md' when 2 then '../' || lang || '.md' else 'none/' || source || '.md' end as page, doc_id % 4 as k, lang, source from documents)
    select distinct page, case k when 0 then page when 1 then case when source <= 'src2' then '/cwd/notes/' || source || '.md' else '/root/wiki/notes/' || source || '.md' end else '/root/' || lang || '.md' end as file from a where k < 3""",
)
def resolved_pages(read):
    d = F.col("doc_id") % 4
    page = F.when(d == 0, F.concat(F.lit("/abs/"), "lang", F.lit(".md"))).when(d == 1, F.concat(F.lit("notes/"), "source", F.lit(".md"))).when(d == 2, F.concat(F.lit("../"), "lang", F.lit(".md"))).otherwise(F.concat(F.lit("none/"), "source", F.lit(".md")))
    docs = read("documents")
    places = F.array(F.concat(F.lit("/abs/"), "lang", F.lit(".md")), F.concat(F.lit("/root/wiki/notes/"), "source", F.lit(".md")), F.when(F.col("source") <= "src2", F.concat(F.lit("/cwd/notes/"), "source", F.lit(".md"))), F.concat(F.lit("/root/"), "lang", F.lit(".md")))
    files = docs.select(F.explode(places).alias("path")).where("path is not null").distinct()
    return catalog.resolve_pages(docs.select(page.alias("page")), files, "/root/wiki", "/root", "/cwd")


@query(
    "project_roots",
    """select distinct '/w/' || source || case doc_id % 3 when 0 then '/docs/wiki' when 1 then '/a/b/c/d/e/wiki' else '/lib/wiki' end as root,
    case when source <= 'src1' and doc_id % 3 <> 1 then '/w/' || source else case doc_id % 3 when 0 then '/w/' || source when 1 then '/w/' || source || '/a/b/c/d/e' else '/w/' || source || '/lib' end end as project from documents""",
)
def project_roots(read):
    d = F.col("doc_id") % 3
    base = F.concat(F.lit("/w/"), "source")
    roots = read("documents").select(F.concat(base, F.when(d == 0, "/docs/wiki").when(d == 1, "/a/b/c/d/e/wiki").otherwise("/lib/wiki")).alias("root")).distinct()
    return catalog.project_roots(roots, read("documents").where("source <= 'src1'").select(F.concat(base, F.lit("/.git")).alias("path")).distinct())


@query("commit_files", "select 'c' || user_id::varchar || '-' || (event_id % 2)::varchar as commit, '2026-01-02' as day, 'Fix ' || event_type as subject, 'src/' || event_type || (event_id % 5)::varchar || '.ts' as path, case when event_id % 4 = 0 then null else event_id % 9 end::int as added, case when event_id % 4 = 0 then null else event_id % 7 end::int as deleted from events")
def commit_files(read):
    e = F.col("event_id")
    count = lambda n: F.when(e % 4 == 0, "-").otherwise((e % n).cast("string"))
    line = F.concat_ws("\t", count(9), count(7), F.concat(F.lit("src/"), "event_type", (e % 5).cast("string"), F.lit(".ts")))
    head = F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("-"), (e % 2).cast("string"), F.lit("\u00012026-01-02\u0001Fix "), "event_type")
    return git.parse_history(read("events").select(F.concat(head, F.lit("\n\n"), line, F.lit("\n")).alias("block")))


# --- models' answers ---------------------------------------------------------------------------------------------


@query(
    "extracted_claims",
    """with d as (select doc_id, lang, source, text from documents where doc_id % 5 <> 4)
    select doc_id as source, 0 as at, 'First of ' || lang as text, 'gotcha' as kind, case when doc_id % 5 = 1 or length(trim(text, ' ')) < 12 then null else trim(text, ' ') end as quote, 'a.ts,' || source as files, 0.5::double as confidence from d
    union all select doc_id, 1, 'Third', 'fact', null, '', null from d""",
)
def extracted_claims(read):
    d = F.col("doc_id")
    quote = F.when(d % 5 == 1, "never said in the source at all").otherwise(F.col("text"))
    claim = F.struct(F.concat(F.lit(" First of "), "lang", F.lit(" ")).alias("text"), F.lit("gotcha").alias("kind"), quote.alias("quote"), F.array(F.lit("a.ts"), F.col("source")).alias("files"), F.lit(0.5).alias("confidence"))
    body = F.to_json(F.struct(F.lit("T").alias("title"), F.array(claim).alias("claims")))
    more = F.regexp_replace(body, r"\}\]\}$", '},{"text": "  ", "kind": "fact"},{"text": "Third", "quote": ""}]}')
    answer = F.when(d % 5 == 4, F.lit("I found no claims.")).otherwise(F.concat(F.lit("```json\n"), more, F.lit("\n```")))
    rows = models.extracted_claims(read("documents").select(d.alias("source"), answer.alias("answer"), "text"))
    return rows.withColumn("files", F.array_join("files", ","))


@query("extraction_inputs", "select doc_id, 'Document title: ' || source || chr(10) || chr(10) || '<document>' || chr(10) || case when length(text) > 500 then substring(text, 1, 500) || chr(10) || chr(10) || '[... source truncated for extraction ...]' else text end || chr(10) || '</document>' as input from documents")
def extraction_inputs(read):
    return read("documents").select("doc_id", models.extraction_input(F.col("text"), F.col("source"), 500).alias("input"))


@query(
    "extracted_insights",
    """select doc_id as source, x::int as at, lang || ' ' || x::varchar as text, case when x % 2 = 0 then 'decision' else 'fact' end as kind, case when x % 3 = 0 then 'file:a.ts' else '' end as evidence from documents, range(0, 8) t(x) where doc_id % 3 <> 2""",
)
def extracted_insights(read):
    def item(x):
        return F.concat(F.lit('{"text": "'), F.col("lang"), F.lit(" "), x.cast("string"), F.lit('"'), F.when(x % 2 == 0, ', "kind": "decision"').otherwise(""), F.when(x % 3 == 0, ', "evidence": [{"kind": "file", "ref": "a.ts"}, {"kind": "odd"}]').otherwise(""), F.lit("}"))

    listed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), item), ",")
    answer = F.when(F.col("doc_id") % 3 == 2, F.lit('{"insights": "none"}')).otherwise(F.concat(F.lit('{"insights": ['), listed, F.lit("]}")))
    rows = models.extracted_insights(read("documents").select(F.col("doc_id").alias("source"), answer.alias("answer")))
    return rows.select("source", "at", "text", "kind", F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["kind"], x["ref"])), ",").alias("evidence"))


@query(
    "written_pages",
    """select doc_id as key, case when doc_id % 3 = 0 then 'Stand-in' else 'T ' || lang end as title, case when doc_id % 2 = 0 then 'sum' else '' end as summary, 'a,b' as tags, 'Takes 250 ms in ' || lang as body, case when doc_id % 4 = 0 then '' else '250 ms' end as missing from documents where doc_id % 5 <> 0""",
)
def written_pages(read):
    d = F.col("doc_id")
    title = F.when(d % 3 == 0, " ").otherwise(F.concat(F.lit("T "), "lang"))
    body = F.when(d % 5 == 0, "  ").otherwise(F.concat(F.lit("Takes 250 ms in "), "lang"))
    answer = F.to_json(F.struct(title.alias("title"), F.when(d % 2 == 0, "sum").alias("summary"), F.array(F.lit("a"), F.lit("b")).alias("tags"), body.alias("body")))
    rows = read("documents").select(d.alias("key"), answer.alias("answer"), F.lit("concept").alias("page_type"), F.lit("t").alias("topic"), F.lit("Stand-in").alias("title"), F.array(F.lit("s")).alias("sources"), F.when(d % 4 == 0, "about 250ms").otherwise("fast").alias("evidence"))
    return models.written_pages(rows, "2026-02-01").select("key", "title", "summary", F.array_join("tags", ",").alias("tags"), "body", F.array_join("missing", ",").alias("missing"))


@query(
    "insight_evidence",
    """select doc_id as id, 'file: f' || doc_id::varchar || case when doc_id % 3 = 0 then ' (not found)' else chr(10) || substring(lang || ' is here', 1, 3500) end || chr(10) || chr(10) || 'commit: c' || doc_id::varchar || chr(10) || case when doc_id % 2 = 0 then '(commit not found)' else 'Fix ' || source end || chr(10) || chr(10)
    || case when doc_id % 4 = 0 then 'user statement' else 'agent-stated (unverified)' end || ': "we said [REDACTED_EMAIL]"' || chr(10) || chr(10) || 'source: s' || chr(10) || 'quote: "q"' as evidence from documents""",
)
def insight_evidence(read):
    d = F.col("doc_id")
    name = d.cast("string")
    item = lambda at, kind, ref, quote: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), ref.alias("ref"), F.lit(quote).cast("string").alias("quote"))
    listed = F.array(item(0, "file", F.concat(F.lit("f"), name), None), item(1, "commit", F.concat(F.lit("c"), name), None), item(2, "user", F.lit("u"), "we said a.b@c.de"), item(3, "source", F.lit("s"), "q"))
    items = read("documents").select(d.alias("id"), F.array(F.lit("here")).alias("terms"), (d % 4 == 0).alias("said"), F.explode(listed).alias("x")).select("id", "terms", "said", "x.*")
    files = read("documents").where("doc_id % 3 <> 0").select(F.concat(F.lit("f"), name).alias("path"), F.concat("lang", F.lit(" is here")).alias("text"))
    commits = read("documents").where("doc_id % 2 = 1").select(F.concat(F.lit("c"), name).alias("ref"), F.concat(F.lit("Fix "), "source").alias("text"))
    return evidence.insight_evidence(items, files, commits)


# --- whole flows -------------------------------------------------------------------------------------------------


@query(
    "ingested_reviews",
    f"""with j as (select *, {_LADDER} as action from judged) select 'review-' || id::varchar as id, 'claim_review' as kind, round(greatest(0.3, 1 - grounded), 6) as criticality from j where action = 'review'
    union all select 'dispute-' || id::varchar, 'dispute', 0.8 from j where relation = 'contradicts'""",
)
def ingested_reviews(read):
    rows = workflow.decided(read("judged").withColumn("text", F.lit("t"))).withColumn("target", F.lit(None).cast("string"))
    return workflow.to_review(rows).select("id", "kind", F.round("criticality", 6).alias("criticality"))


@query(
    "placed_claims",
    f"""with j as (select id, {_LADDER} as action, relation from judged), t as (select doc_id as id, {set_sql("text")} as ts from documents), c as (select id as cid, page, {set_sql("text")} as cs from claim_rows),
    f as (select id, case when (id * 37 % 101) * 0.01 >= 0.6 then 'page' || (id % 7)::varchar end as won from j where action in ('file', 'reinforce')),
    s as (select j.id, cid, page, len(list_intersect(ts, cs)) / least(len(ts), len(cs))::double as score from j join t using (id) join c on least(len(ts), len(cs)) > 0 where action = 'reinforce'),
    b as (select id, cid, page from (select *, row_number() over (partition by id order by score desc, cid) as r from s where score >= 0.4) where r = 1)
    select j.id, j.action, coalesce(won, case when action = 'reinforce' then page end) as target, case when action = 'reinforce' and won is null then cid end as merge_into from j left join f using (id) left join b using (id)""",
)
def placed_claims(read):
    rows = workflow.decided(read("judged")).join(read("documents").select(F.col("doc_id").alias("id"), "text"), "id").select("id", "action", "text")
    k = F.col("id")
    fits = rows.select(k.alias("claim_id"), F.lit(1).alias("position"), F.concat(F.lit("page"), (k % 7).cast("string")).alias("page"), ((k * 37 % 101) * 0.01).alias("fit"), F.lit(0.0).alias("final_fit"))
    return workflow.placed(rows, fits, read("claim_rows").select("id", "page", "text")).select("id", "action", "target", "merge_into")


_ASKED = f"""with {_BM25_SQL.strip()[5:].replace("select query_id, path, rank::int as rank, score from (select *, row_number()", ", hits as (select query_id, path, rank::int as rank, score from (select *, row_number()").strip()}),
w as (select h.*, p.text, {tokens_sql("b.text")} as ts from hits h join wiki_pages p using (path) join benchmark b on b.item_id = h.query_id),
l as (select *, list_filter(string_split(text, chr(10)), lambda x: len(list_filter(ts, lambda t: contains(lower(x), t))) > 0) as hit from w),
j as (select query_id, path, rank, score, substring(trim(array_to_string(list_transform(hit[1:3], lambda x: trim(x, ' ')), ' '), ' '), 1, 240) as excerpt, (query_id * 7 + rank * 13) % 100 * 1e-2 as relevance, (query_id * 31) % 100 * 1e-2 as sufficiency from l)"""


def _judge(hits):
    q, r = F.col("query_id"), F.col("rank")
    return hits.withColumn("relevance", (q * 7 + r * 13) % 100 * 1e-2).withColumn("sufficiency", q * 31 % 100 * 1e-2)


def _asked(read):
    queries = read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return api.wiki_ask(read("wiki_pages"), queries, 5, "bm25", judge=_judge, rerank="always")


@query(
    "asked_and_judged",
    f"""{_ASKED} select query_id, path, (row_number() over (partition by query_id order by relevance desc, score desc, rank, path))::int as rank, score, round(relevance, 6) as relevance, excerpt, case when sufficiency < 0.5 then 'Evidence may be insufficient (' || printf('%.2f', sufficiency) || '): the wiki may not cover this yet.' end as note from j""",
)
def asked_and_judged(read):
    return _asked(read).select("query_id", "path", "rank", "score", F.round("relevance", 6).alias("relevance"), "excerpt", "note")


@query(
    "briefs",
    f"""{_ASKED}, r as (select *, row_number() over (partition by query_id order by relevance desc, score desc, rank, path) as place from j), g as (select *, sum(length(excerpt)) over o as used, count(*) over o as n from r where sufficiency >= 0.5 and relevance >= 0.5 and place <= 6 window o as (partition by query_id order by place rows unbounded preceding))
    select query_id, path, place::int as rank, used from g where used <= 400 or n = 1""",
)
def briefs(read):
    return api.wiki_brief(_asked(read), budget=400).select("query_id", "path", "rank", "used")


@query(
    "checked_collection",
    f"""with p as (select * from wiki_pages), k as (select * from (values ('toc_added'), ('toc_missing_file'), ('toc_updated'), ('broken_link'), ('orphan'), ('raw_backlog'), ('unbacked_claim'), ('contradiction'), ('duplicate')) t(finding)),
    found as (select case when t.path is null then 'toc_added' when p.path is null then 'toc_missing_file' else 'toc_updated' end as finding from p full join wiki_toc t using (path) where t.path is null or p.path is null or p.updated is distinct from t.updated or p.summary is distinct from t.summary
      union all select 'broken_link' from p where doc_id % 3 = 0
      union all select 'orphan' from p where not coalesce(updated >= '2026-01-25', false) and path not in (select q.path from p q, p o where o.doc_id % 3 = 1 and q.source = o.source and q.doc_id = o.doc_id - 1 and q.path <> o.path)
      union all select 'raw_backlog' from p where doc_id % 4 <> 0),
    claims as (select id, page, {set_sql("text")} as ts, file_a, file_b from claim_rows where status not in ('superseded', 'rejected')),
    pairs as (select 'contradiction' as finding, a.id as a, b.id as b from claims a, claims b where a.id < b.id and a.page <> b.page and (a.file_a = b.file_a or a.file_b = b.file_b) and coalesce(len(list_intersect(a.ts, b.ts)) / nullif(least(len(a.ts), len(b.ts)), 0)::double, 0) < 0.9 order by 2, 3 limit 8),
    twins as (select 'duplicate' as finding, a.id as a, b.id as b from claims a, claims b where a.id < b.id and a.page <> b.page and least(len(a.ts), len(b.ts)) > 0 and len(list_intersect(a.ts, b.ts)) / least(len(a.ts), len(b.ts))::double >= 0.72 - 1e-12 order by 2, 3 limit 6),
    every as (select finding from found union all select finding from pairs union all select finding from twins union all select 'unbacked_claim' from claims)
    select k.finding, count(every.finding) as n from k left join every using (finding) group by 1""",
)
def checked_collection(read):
    d = F.col("doc_id")
    link = F.when(d % 3 == 0, "[gone](../none/x.md)").when(d % 3 == 1, F.concat(F.lit("[one]("), (d - 1).cast("string"), F.lit(".md)"))).otherwise("")
    rows = read("wiki_pages")
    # a link to a page of another source is broken as well: those of the second kind stay where the page before is of the same source
    near = rows.select((d + 1).alias("doc_id"), F.col("source").alias("_s"))
    pages = rows.join(near, "doc_id", "left").withColumn("text", F.when((d % 3 == 1) & ~F.col("source").eqNullSafe(F.col("_s")), "").otherwise(link))
    pages = pages.withColumn("text", F.concat("text", F.when(d % 4 == 0, F.concat(F.lit(" see r"), d.cast("string"), F.lit(".txt;"))).otherwise("")))
    claims = read("claim_rows").select("id", "page", "text", "status", F.array("file_a", "file_b").alias("files"), F.lit(0.5).alias("support"))
    raw = rows.select(F.concat(F.lit("raw/r"), d.cast("string"), F.lit(".txt")).alias("path"))
    log = rows.limit(0).select(*[F.lit("").alias(c) for c in ("actor", "op", "action", "subject", "outcome", "reason")])
    return workflow.check(pages, read("wiki_toc").withColumn("title", F.lit("t")), claims, raw, log, "2026-02-01")["counts"]


# --- changes of a folder of pages ----------------------------------------------------------------------------------


@query(
    "page_changes",
    """select coalesce(a.path, b.path) as path, b.path is null as gone from stale_pages a full join kept_pages b on a.path = b.path
    where a.path is null or b.path is null or a.text is distinct from b.text""",
)
def page_changes(read):
    return changes.differences(*[read(t).select("path", F.md5("text").alias("stamp")) for t in ("stale_pages", "kept_pages")])
