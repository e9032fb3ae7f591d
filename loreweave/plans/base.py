"""How queries are registered, and views of the driver's tables in the shapes that the operators take.

The view texts are plain SQL that both engines read; what the operators compute is written twice, as DataFrame
programs in ``loreweave.operators`` and as independent SQL beside each query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    # a page for each document
    "wiki_pages": """select doc_id, concat(source, '/', cast(doc_id as string), '.md') as path, replace(substring(text, 1, 40), chr(10), ' ') as title,
        concat(lang, ' ', source) as rest, lang, source, case when doc_id % 5 = 0 then null else 'concept' end as type, replace(substring(text, 41, 60), chr(10), ' ') as summary,
        case when doc_id % 11 = 0 then null else cast(date '2026-01-01' + cast(doc_id % 300 as int) as string) end as updated, text from {documents}""",
    # a stale table of contents for the same pages: some rows are missing, some are of pages that are gone, some differ
    "wiki_toc": """select concat(source, '/', cast(case when doc_id % 13 = 0 then doc_id + 1000000 else doc_id end as string), '.md') as path,
        case when doc_id % 7 = 0 then '2025-12-31' when doc_id % 11 = 0 then null else cast(date '2026-01-01' + cast(doc_id % 300 as int) as string) end as updated,
        replace(substring(text, 41, 60), chr(10), ' ') as summary from {documents} where doc_id % 17 <> 3""",
    # pages as they are, and as they were when last looked at: some changed, some are new, some are gone
    "kept_pages": """select doc_id, concat(source, '/', cast(doc_id as string), '.md') as path, case when doc_id % 4 = 0 then 'starting' else replace(substring(text, 1, 40), chr(10), ' ') end as title,
        concat(lang, ' ', source) as rest, case when doc_id % 29 = 0 then null else text end as text from {documents} where doc_id % 19 <> 5""",
    "stale_pages": """select doc_id, concat(source, '/', cast(doc_id as string), '.md') as path, case when doc_id % 4 = 0 then 'starting' else replace(substring(text, 1, 40), chr(10), ' ') end as title,
        concat(lang, ' ', source) as rest, case when doc_id % 29 = 0 then null when doc_id % 23 = 1 then concat('old words ', text) else text end as text from {documents} where doc_id % 31 <> 7""",
    # questions that say their words twice and name parts of titles
    "asked_twice": """select item_id, concat(text, ' ', substring(text, 1, 60), ' art starting src1') as text from {benchmark}""",
    # events that come in as streams: numbers of messages, questions, changes of a review queue, messages with their times
    "capture_events": "select concat('u', cast(user_id % 40 as string)) as session, cast(ts as timestamp) as ts, event_id * 7 % 3 as messages from {events}",
    "asks_in_time": "select concat('u', cast(user_id % 40 as string)) as session, cast(ts as timestamp) as ts, event_type as query from {events}",
    "review_events": "select concat('k', cast(user_id as string)) as key, cast(ts as timestamp) as ts, case when event_type in ('click', 'purchase') then 'resolve' else 'enqueue' end as op, cast(event_id as string) as id from {events}",
    "timed_messages": """select cast(conv_id as string) as session, turn as ord, cast('2026-01-01 10:00:00' as timestamp) + cast(turn * 60 + conv_id % 60 as int) * interval '1' second as ts, case when role = 'system' then 'user' else role end as role,
        case when (conv_id + turn) % 5 = 0 then 'toolUse' when (conv_id + turn) % 5 = 1 then 'aborted' when (conv_id + turn) % 5 = 2 then null else 'stop' end as stop_reason from {conversations}""",
    # a ledger of decisions from the event log
    "ledger_rows": """select event_id as id, ts, case when user_id % 3 = 0 then 'judge' when user_id % 3 = 1 then 'agent' else 'code' end as actor,
        case when event_type = 'view' then 'toc' when event_type = 'signup' then 'ask' else 'adjudicate' end as op,
        case when event_type = 'click' then 'file' when event_type = 'purchase' then 'reject_derivable' when event_type = 'error' then 'reject_unsupported' else 'none' end as action,
        case when event_id % 10 = 0 then null else event_id % 97 end as input_tokens, event_id % 31 as output_tokens, case when event_id % 4 = 0 then null else (event_id % 50) * 5e-1 end as cost,
        case when event_id % 9 = 0 then null else (event_id % 101) * 1e-2 end as derivable, (event_id % 89) * 1e-2 as grounded,
        concat('p', cast(user_id as string)) as page, user_id from {events}""",
    # ranked hits of many queries: fifteen lexical and fifteen anchored ones each
    "lexical_hits": """select cast(floor(event_id / 15) as bigint) as query_id, concat('p', cast((event_id * 7 + floor(event_id / 15)) % 40 as bigint)) as path, cast(event_id % 15 + 1 as int) as rank,
        value as score, case when event_id % 4 = 0 then null else (event_id % 100) * 1e-2 end as relevance, concat(event_type, ' ', props) as excerpt from {events}""",
    "vector_hits": """select cast(floor(event_id / 15) as bigint) as query_id, concat('p', cast((event_id * 3 + floor(event_id / 15)) % 12 as bigint)) as path,
        case when event_id % 6 = 5 then null else concat('c', cast(event_id % 5 as string)) end as anchor, cast(event_id % 15 + 1 as int) as rank from {events}""",
    # claims: one for each turn of a conversation
    "claim_rows": """select conv_id * 1000 + turn as id, concat('page', cast(conv_id as string)) as page, text, case when turn % 4 = 0 then 'verified' when turn % 4 = 1 then 'user-stated' when turn % 4 = 2 then 'superseded' else 'disputed' end as status,
        concat('src/', cast(conv_id % 7 as string), '.py') as file_a, concat('src/', cast(turn % 3 as string), '.ts') as file_b from {conversations}""",
    # judged columns for every document
    "judged": """select doc_id as id, (doc_id * 7 % 100) * 1e-2 as grounded, (doc_id * 13 % 100) * 1e-2 as derivable, (doc_id * 29 % 100) * 1e-2 as durable, (doc_id * 31 % 97) * 1e-2 as sensitive,
        (doc_id * 5 % 40) * 1e-1 as importance, (doc_id * 5 % 40) * 2.5e-2 as importance_norm, (doc_id * 17 % 95) * 1e-2 as already_known, (doc_id * 11 % 100) * 1e-2 as criticality,
        case when doc_id % 6 = 0 then 'architecture' when doc_id % 6 = 1 then 'invariant' when doc_id % 6 = 2 then 'decision' when doc_id % 6 = 3 then 'fact' when doc_id % 6 = 4 then 'gotcha' else null end as kind,
        case when doc_id % 5 = 0 then 'extends' when doc_id % 5 = 1 then 'consistent' when doc_id % 5 = 2 then 'contradicts' else 'new' end as relation,
        case when doc_id % 3 = 0 then 'user_stated' when doc_id % 3 = 1 then 'verified_in_repo' else 'inferred' end as trust_tier, source, lang from {documents}""",
    # messages of sessions
    "messages": """select cast(conv_id as string) as session, turn as ord, case when role = 'system' then 'user' else role end as role,
        case when (conv_id + turn) % 5 = 0 then 'toolUse' when (conv_id + turn) % 5 = 1 then 'aborted' when (conv_id + turn) % 5 = 2 then null else 'stop' end as stop_reason,
        concat('2026-01-', case when conv_id % 28 < 9 then '0' else '' end, cast(conv_id % 28 + 1 as string), 'T10:0', cast(turn % 10 as string)) as ts, text from {conversations}""",
    # links from pages in folders of many depths, climbing up to seven folders
    "deep_links": """select doc_id, concat(repeat('d/', cast(doc_id % 6 as int)), 'p', cast(doc_id as string), '.md') as page,
        concat(case when doc_id % 4 = 0 then './' else '' end, repeat('../', cast(doc_id % 8 as int)), 'x/./y', cast(doc_id % 3 as string), '.md') as link from {documents}""",
    # names of pages and files as different tools write them
    "spellings": """select doc_id, concat(case when doc_id % 4 = 0 then './' when doc_id % 4 = 1 then 'wiki/' when doc_id % 4 = 2 then './wiki/' else '' end, case when doc_id % 5 = 0 then '' else 'Src/' end, 'Page', cast(doc_id % 7 as string), case when doc_id % 3 = 0 then '.md' else '' end) as a,
        concat(case when doc_id % 6 = 0 then 'x/' when doc_id % 6 = 1 then '' else './' end, case when doc_id % 2 = 0 then 'src/' else 'SRC//' end, 'page', cast(doc_id % 5 as string), case when doc_id % 7 = 0 then '.md' else '' end) as b from {documents}""",
    # files whose names are words, phrases, other letters, or parts of longer words
    "raw_files": """select doc_id, concat('raw/', case when doc_id % 9 = 0 then 'sessions/' else '' end, case when doc_id % 4 = 0 then 'my notes ' when doc_id % 4 = 1 then 'Über ' when doc_id % 4 = 2 then 'plan-b_' else '注' end, cast(doc_id as string), '.md') as path,
        concat(source, ' says (x', case when doc_id % 4 = 0 then 'my notes ' when doc_id % 4 = 1 then 'Über ' when doc_id % 4 = 2 then 'plan-b_' else '注' end, cast(doc_id + doc_id % 3 as string), '.mdx) ', text) as text from {documents}""",
    # modules and architecture pages, some of which name them inside longer words
    "module_rows": """select distinct concat('src/', source, case when doc_id % 2 = 0 then '-core' else '' end) as module, concat('arch/', source, '.md') as path,
        case when doc_id % 2 = 0 then 'architecture/module' else 'concept' end as type, concat('About ', upper(source), case when doc_id % 3 = 0 then '-CORES' else '' end) as title,
        case when doc_id % 7 = 0 then concat('src/', source, '/a.ts') else 'none' end as file from {documents} where source <> 'src0'""",
    # pages with headings, two of which are alike
    "headed_pages": """select concat('h', cast(doc_id as string)) as path, title, concat('intro ', body, chr(10), '## Notes on *', lang, '*', chr(10), body, chr(10), chr(10), body, chr(10), '##  Notes on ', lang, chr(10), source, chr(10), '#no heading', chr(10), '### [Link](x.md)  ', chr(10), body, chr(13), chr(10), '## ', chr(10), 'a `b` [c](d) [](e)  ', chr(13), chr(10), '##', chr(10), '## Empty', chr(10), ' ', chr(10), '## Empty', chr(10), body, chr(10), '## Empty', chr(10), body) as text
        from (select doc_id, lang, source, replace(substring(text, 1, 20), chr(10), ' ') as title, text as body from {documents})""",
    # subjects that a ledger has accepted, and what it says of claims
    "accepted_rows": """select conv_id * 1000 + turn as id, case when turn % 5 = 0 then substring(text, 1, cast(15 + conv_id % 130 as int)) when turn % 5 = 1 then concat(text, ' and more of it') else concat('nothing like ', cast(conv_id as string)) end as subject,
        case when turn % 7 = 3 then concat('Reviewed PAGE', cast(conv_id as string), '  claim ', cast(conv_id * 1000 + turn as string)) else 'no review' end as outcome from {conversations}""",
    # runs of an experiment with three arms
    "runs": """select concat('t', cast(o_custkey % 40 as string)) as task, case when o_orderkey % 3 = 0 then 'off' when o_orderkey % 3 = 1 then 'wiki' else 'plain' end as arm, o_orderkey % 4 as repeat,
        o_orderkey as ordinal, case when o_orderkey % 10 = 0 then null else o_totalprice * 1e-4 end as cost, case when o_orderkey % 6 = 0 then true when o_orderkey % 6 = 1 then false else null end as valid,
        o_orderstatus as expected, case when o_orderkey % 9 = 0 then 'X' else o_orderstatus end as observed, case when o_orderkey % 8 = 0 then false when o_orderkey % 8 = 1 then null else true end as clean from {orders}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by its name, or a view over one."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    base = text[text.rindex("{") + 1 : text.rindex("}")]
    return spark.sql(text, **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


def with_views(sql: str) -> str:
    """Oracle SQL with the views that it names put before it."""
    used = [n for n in VIEWS if n in sql]
    parts = [f"{n} as ({VIEWS[n].format(**{t: t for t in ('documents', 'events', 'conversations', 'orders', 'benchmark')})})" for n in used]
    body = sql.strip()
    if not parts:
        return body
    for head in ("with recursive ", "with "):
        if body.lower().startswith(head):
            return f"{head}{', '.join(parts)}, {body[len(head) :]}"
    return f"with {', '.join(parts)} {body}"


def query(name: str, sql: str | None = None):
    """Register a query over (view reader) under a name, with its oracle."""

    def add(program: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: program(lambda table: view(spark, sf_dir, table))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return program

    return add
