"""Registered queries: what backs claims, and what changes touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions.text import auto_query, same_file, same_page, tokenize
from loreweave.operators import evidence
from loreweave.operators.sessions import previous_user

from .base import query
from .retrieval import set_sql, tokens_sql


@query(
    "verified_quotes",
    r"""with q as (select doc_id, text, case when doc_id % 4 = 0 then 'not in this text at all' when doc_id % 4 = 1 then substring(text, 1, 8) when doc_id % 4 = 2 then replace(text, ' ', '  ') else substring(text, (length(text) // 2)::int) || ' no' end as quote from documents)
    select doc_id, length(trim(quote, ' ')) >= 12 and contains(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), trim(regexp_replace(quote, '\s+', ' ', 'g'), ' ')) as holds from q""",
)
def verified_quotes(read):
    d = F.col("doc_id") % 4
    half = F.substring(F.col("text"), F.floor(F.length("text") / 2).cast("int"), F.length("text"))
    quote = F.when(d == 0, "not in this text at all").when(d == 1, F.substring("text", 1, 8)).when(d == 2, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.concat(half, F.lit(" no")))
    return read("documents").select("doc_id", evidence.quote_holds(quote, F.col("text")).alias("holds"))


@query(
    "user_statements",
    r"""with s as (select session, trim(regexp_replace(lower(string_agg(text, chr(10) order by ord)), '\s+', ' ', 'g'), ' ') as said from messages where role = 'user' group by session),
    c as (select session || '/' || ord::varchar as id, session, case when ord % 3 = 0 then replace(text, 'e', 'E') when ord % 3 = 1 then text || ' not' else replace(text, ' ', chr(10)) end as ev from messages)
    select id, coalesce(length(trim(regexp_replace(lower(ev), '\s+', ' ', 'g'), ' ')) >= 12 and contains(said, trim(regexp_replace(lower(ev), '\s+', ' ', 'g'), ' ')), false) as stated from c left join s using (session)""",
)
def user_statements(read):
    m = read("messages")
    claims = m.select(F.concat_ws("/", "session", F.col("ord").cast("string")).alias("id"), "session", F.when(F.col("ord") % 3 == 0, F.replace("text", F.lit("e"), F.lit("E"))).when(F.col("ord") % 3 == 1, F.concat("text", F.lit(" not"))).otherwise(F.replace("text", F.lit(" "), F.lit("\n"))).alias("evidence"))
    return evidence.user_said(claims, m.select("session", "ord", "role", "text"))


@query(
    "contaminated_sessions",
    """with f as (select distinct split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) as v, item_id % 2 as odd from benchmark)
    select conv_id::varchar as session, array_to_string(list_sort(list(distinct case when odd = 0 then 'root:' else 'canary:' end || v)), '|') as reasons from conversations, f where contains(text, v) group by conv_id""",
)
def contaminated_sessions(read):
    calls = read("conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("text").alias("args"), F.col("text").alias("result"))
    two = F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(2)), F.split_part("text", F.lit(" "), F.lit(3)))
    forbidden = read("benchmark").select(F.when(F.col("item_id") % 2 == 0, "root").otherwise("canary").alias("kind"), two.alias("value"))
    return evidence.contaminated(calls, forbidden, block=50).select("session", F.array_join("reasons", "|").alias("reasons"))


@query("affected_claims", "select id from claim_rows where file_a in ('src/3.py', 'src/5.py') or (id % 5 = 0 and file_b like 'src/%.ts' and file_b = 'src/1.ts') order by id limit 40")
def affected_claims(read):
    claims = read("claim_rows").select("id", F.array(F.col("file_a"), F.when(F.col("id") % 5 == 0, F.replace("file_b", F.lit("/1"), F.lit("/*1"))).otherwise("none")).alias("files"))
    changed = read("claim_rows").select(F.explode(F.array(F.lit("src/3.py"), F.lit("src/5.py"), F.lit("src/1.ts"))).alias("path")).distinct()
    return evidence.affected_claims(claims.withColumn("files", F.when(F.col("files")[1].contains("*"), F.col("files")).otherwise(F.slice("files", 1, 1))), changed)


_NORM = "trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'), ' ')"


@query(
    "unbacked_claims",
    f"""with c as (select id, {_NORM.format(x="page")} as page, {_NORM.format(x="text")} as whole, substring({_NORM.format(x="text")}, 1, 100) as head, {set_sql("text")} as ts from claim_rows),
    s as (select distinct {_NORM.format(x="subject")} as subject, {set_sql("subject")} as ss from accepted_rows), m as (select distinct {_NORM.format(x="outcome")} as said from accepted_rows)
    select id from c where not exists (select 1 from s where starts_with(s.subject, c.head) or starts_with(c.head, s.subject) or (least(len(ss), len(ts)) > 0 and len(list_intersect(ss, ts)) / least(len(ss), len(ts))::double >= 0.5))
    and not exists (select 1 from m where contains(said, page) and (contains(said, id::varchar) or contains(said, substring(whole, 1, 60))))""",
)
def unbacked_claims(read):
    claims = read("claim_rows").select("id", "page", "text", F.col("id").cast("string").alias("claim_id"))
    rows = read("accepted_rows")
    return evidence.unbacked_claims(claims, rows.select("subject"), mentions=rows.select(F.col("outcome").alias("text")))


@query(
    "undocumented_modules",
    """with m as (select distinct module, lower(regexp_extract(module, '([^/]+)$', 1)) as name from module_rows), a as (select distinct lower(concat_ws(' ', title, '', path)) as t, file from module_rows where starts_with(type, 'architecture/'))
    select module from m where not exists (select 1 from a where contains(t, name)) and not exists (select 1 from a where file = module or starts_with(file, module || '/'))""",
)
def undocumented_modules(read):
    rows = read("module_rows")
    pages = rows.select("path", "type", "title", F.lit("").alias("summary"), F.array("file").alias("files"))
    return evidence.undocumented(rows.select("module").distinct(), pages)


@query(
    "same_pages",
    r"""with x as (select doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '[\\/]+', '/', 'g'), '^\./', ''), '^wiki/', ''), '\.md$', '')) as x, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '[\\/]+', '/', 'g'), '^\./', ''), '^wiki/', ''), '\.md$', '')) as y,
      lower(regexp_replace(regexp_replace(a, '[\\/]+', '/', 'g'), '^\./', '')) as f, lower(regexp_replace(regexp_replace(replace(b, '//', chr(92)), '[\\/]+', '/', 'g'), '^\./', '')) as g from spellings)
    select doc_id, x = y or ends_with(x, '/' || y) or ends_with(y, '/' || x) as page, f = g or ends_with(f, '/' || g) or ends_with(g, '/' || f) or regexp_extract(f, '([^/]*)$', 1) = regexp_extract(g, '([^/]*)$', 1) as file from x""",
)
def same_pages(read):
    a, b = F.col("a"), F.col("b")
    return read("spellings").select("doc_id", same_page(a, b).alias("page"), same_file(a, F.replace(b, F.lit("//"), F.lit("\\"))).alias("file"))


@query(
    "rediscoveries",
    """with r as (select event_id // 20 as episode, 'p' || (event_id % 15)::varchar as page from events where event_type = 'view'), f as (select event_id // 20 as episode, 'x/f' || (event_id % 23)::varchar || '.ts' as file from events where event_type = 'click')
    select episode, bool_or(exists (select 1 from f where f.episode = r.episode and f.file in ('x/f' || (substring(page, 2)::int)::varchar || '.ts', 'x/f' || (substring(page, 2)::int + 3)::varchar || '.ts'))) as rediscovered from r group by episode""",
)
def rediscoveries(read):
    e = read("events").withColumn("episode", F.floor(F.col("event_id") / 20))
    retrievals = e.where("event_type = 'view'").select("episode", F.concat(F.lit("wiki/p"), (F.col("event_id") % 15).cast("string"), F.lit(".md")).alias("page"))
    links = e.select((F.col("event_id") % 15).alias("k")).distinct().select(F.concat(F.lit("p"), F.col("k").cast("string"), F.lit(".md")).alias("path"), F.array(*[F.concat(F.lit("f"), (F.col("k") + d).cast("string"), F.lit(".ts")) for d in (0, 3)]).alias("files"))
    reads = e.where("event_type = 'click'").select("episode", F.concat(F.lit("x/f"), (F.col("event_id") % 23).cast("string"), F.lit(".ts")).alias("file"))
    return evidence.rediscovered(retrievals, links, reads)


@query(
    "auto_queries",
    f"""with u as (select session, ord, trim(text, ' ') as t, last_value(case when role = 'user' then text end ignore nulls) over (partition by session order by ord rows between unbounded preceding and 1 preceding) as prev, role from messages),
    b as (select session, ord, case when len({tokens_sql("t")}) < 4 or regexp_matches(t, '(?i)^(yes|yeah|yep|ok|okay|sure|continue|go on|go ahead|do it|proceed|next|and then|please do)\\b') then coalesce(nullif(trim(prev, ' '), ''), t) else t end as b from u where role = 'user')
    select session, ord, sha256(case when length(b) <= 1200 then b else trim(substring(b, 1, 804) || ' … ' || right(b, 393), ' ') end) as query_hash from b""",
)
def auto_queries(read):
    return previous_user(read("messages")).select("session", "ord", F.sha2(auto_query(F.col("text"), F.col("previous")), 256).alias("query_hash"))


_EXCERPT_SQL = f"""with p as (select doc_id, repeat(text || chr(10), 1 + (doc_id % 40)::int) as text, list_filter({tokens_sql("title")}, lambda t: length(t) > 3)[1:12] as ts from wiki_pages),
l as (select doc_id, ts, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i, len(string_split(text, chr(10))) as n from p),
s as (select *, len(list_filter(ts, lambda t: contains(lower(line), t))) as hits from l), b as (select doc_id, i, n from (select *, row_number() over (partition by doc_id order by hits desc, i) as r from s where hits > 0) where r <= 10),
w as (select distinct doc_id, x as i from (select doc_id, unnest(range(greatest(0, i - 4), least(n - 1, i + 4) + 1)) as x from b)),
g as (select w.doc_id, w.i, line, lag(w.i) over (partition by w.doc_id order by w.i) as before from w join l on l.doc_id = w.doc_id and l.i = w.i),
o as (select doc_id, string_agg(case when before < i - 1 then '…' || chr(10) else '' end || (i + 1)::varchar || ': ' || line, chr(10) order by i) as t from g group by doc_id)
select p.doc_id, sha256(case when len(string_split(text, chr(10))) <= 60 then text else coalesce(t, '') end) as excerpt_hash from p left join o using (doc_id)"""


@query("excerpts_around_terms", _EXCERPT_SQL)
def excerpts_around_terms(read):
    long = F.repeat(F.concat("text", F.lit("\n")), (1 + F.col("doc_id") % 40).cast("int"))
    return read("wiki_pages").select("doc_id", F.sha2(evidence.excerpt_around(long, tokenize(F.col("title"))), 256).alias("excerpt_hash"))


@query(
    "task_candidates",
    """with c as (select user_id, date_trunc('day', ts)::date as day, case when event_id % 9 = 0 then 'tests/a.ts' else 'src/a.ts' end as path, event_id % 40 as added, event_id % 13 as deleted from events),
    g as (select user_id as commit, day, count(*) as files, sum(added + deleted)::bigint as lines, bool_or(starts_with(path, 'tests/')) as has_tests from c group by 1, 2)
    select *, (case when has_tests then 2 else 0 end + case when files <= 6 then 1 else 0 end)::int as score from g where files <= 15 and lines <= 400""",
)
def task_candidates(read):
    e = F.col("event_id")
    files = read("events").select(F.col("user_id").alias("commit"), F.to_date("ts").alias("day"), F.when(e % 9 == 0, "tests/a.ts").otherwise("src/a.ts").alias("path"), (e % 40).alias("added"), (e % 13).alias("deleted"))
    return evidence.task_candidates(files)
