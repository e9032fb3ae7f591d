"""Registered queries: small formats, run usage, diff statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions import formats
from loreweave.functions.text import overlap, token_set
from loreweave.operators import harness

from .base import query
from .retrieval import set_sql


@query(
    "same_dirs",
    """select doc_id, doc_id % 4 <> 3 as same, case doc_id % 4 when 0 then '--home-' || source || '--' when 1 then '--C--' || source || '--' when 2 then '--x-' || source || '---' else '--x---' end as slug from documents""",
)
def same_dirs(read):
    d = F.col("doc_id") % 4
    a = F.when(d == 0, F.concat(F.lit("/home/"), "source")).when(d == 1, F.concat(F.lit("C:\\"), "source")).when(d == 2, F.concat(F.lit("/x/"), "source", F.lit("/"))).otherwise("/x/")
    b = F.when(d == 0, F.concat(F.lit("//wsl$/box/home/"), "source")).when(d == 1, F.concat(F.lit("c:/"), F.upper("source"))).when(d == 2, F.concat(F.lit("/x/"), "source")).otherwise("/y")
    return read("documents").select("doc_id", formats.same_dir(a, b).alias("same"), formats.project_slug(a).alias("slug"))


@query("json_slices", """select doc_id, case when doc_id % 3 = 2 then null else '{"k": ' || doc_id::varchar || '}' end as cut from documents""")
def json_slices(read):
    body = F.concat(F.lit('{"k": '), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 2, "").otherwise("}"))
    return read("documents").select("doc_id", formats.json_slice(F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\n"))).alias("cut"))


@query("code_patches", "select doc_id, 'diff --git a/src/' || lang || E' b\\n+x\\n' || text || E'\\n' as patch from documents")
def code_patches(read):
    patch = F.concat(F.lit("diff --git a/docs/"), "source", F.lit(" b\n+y\n"), F.lit("diff --git a/src/"), "lang", F.lit(" b\n+x\n"), "text", F.lit("\ndiff --git a/.cfg/z b\n"))
    return read("documents").select("doc_id", formats.code_patch(patch, ("docs/", ".cfg/")).alias("patch"))


@query("failure_kinds", "select event_id, case event_id % 3 when 0 then 'assertions' when 1 then 'collection' else 'unknown' end as kind from events")
def failure_kinds(read):
    e = F.col("event_id") % 3
    log = F.when(e == 0, "\u001b[31m2 failed\u001b[0m").when(e == 1, "Error: Cannot find module './a'").otherwise("killed")
    return read("events").select("event_id", formats.failure_kind(log).alias("kind"))


@query("embedding_fingerprints", "select vec_id, 'm' || label::varchar || '@v1:f32:' || len(embedding)::varchar as fingerprint from embeddings")
def embedding_fingerprints(read):
    return read("embeddings").select("vec_id", formats.fingerprint(F.concat(F.lit("m"), F.col("label").cast("string")), F.lit(1), F.lit("f32"), F.size("embedding")).alias("fingerprint"))


@query("run_usage", "select user_id as run, count(*) as calls, sum(coalesce(input_tokens, 0))::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, round(sum(coalesce(cost, 0)), 4) as cost from ledger_rows where op = 'adjudicate' and id >= case when user_id % 5 = 0 then 0 else user_id end group by user_id")
def run_usage(read):
    rows = read("ledger_rows").select(F.col("user_id").alias("run"), F.col("id").alias("line"), "input_tokens", "output_tokens", "cost", (F.col("op") == "adjudicate").alias("has_usage"))
    base = rows.where("run % 5 <> 0").select("run", F.col("run").alias("lines")).distinct()  # other runs had no ledger before
    return harness.model_usage(rows, base).withColumn("cost", F.round("cost", 4))


@query(
    "diff_statistics",
    """with c as (select l_orderkey as run, case when l_linenumber % 3 = 0 then '.cfg/' when l_linenumber % 5 = 0 then 'tests/' else 'src/' end || case l_linenumber % 4 when 1 then 'a.test.ts' when 2 then 'test_x.py' else 'attest.ts' end as path, case when l_linenumber = 7 then null else l_quantity end as added, l_linenumber as deleted from lineitem)
    select run, count(*) as files, count_if(not starts_with(path, '.cfg/')) as code_files, count_if(starts_with(path, '.cfg/')) as tooling_files, sum(coalesce(added, 0))::bigint as insertions, sum(deleted)::bigint as deletions,
    count_if(starts_with(path, 'tests/') or ends_with(path, 'a.test.ts') or ends_with(path, '/test_x.py')) as test_files from c group by run""",
)
def diff_statistics(read):
    n = F.col("l_linenumber")
    path = F.concat(F.when(n % 3 == 0, ".cfg/").when(n % 5 == 0, "tests/").otherwise("src/"), F.when(n % 4 == 1, "a.test.ts").when(n % 4 == 2, "test_x.py").otherwise("attest.ts"))
    rows = read("lineitem").select(F.col("l_orderkey").alias("run"), path.alias("path"), F.when(n != 7, F.col("l_quantity").cast("long")).alias("added"), n.cast("long").alias("deleted"))
    return harness.diff_statistics(rows, (".cfg/",))


@query("near_identical", f"select id, coalesce(len(list_intersect({set_sql('text')}, {set_sql('half')})) / nullif(least(len({set_sql('text')}), len({set_sql('half')})), 0)::double, 0) >= 0.9 as near from (select id, text, case when id % 3 = 0 then text || ' addition' when id % 3 = 1 then regexp_replace(text, 'a[a-z]*', 'other', 'g') else text end as half from claim_rows)")
def near_identical(read):
    half = F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" addition"))).when(F.col("id") % 3 == 1, F.regexp_replace("text", "a[a-z]*", "other")).otherwise(F.col("text"))
    return read("claim_rows").select("id", (overlap(token_set(F.col("text")), token_set(half)) >= 0.9).alias("near"))
