"""Registered queries: search, fusion, gating."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.text import is_continuation, token_set, tokenize
from loreweave.functions.vectors import cosine, norm
from loreweave.operators import cells, fusion, lexical, vector
from loreweave.session import shared_folder
from loreweave.sources.textindex import TextIndex

from .base import query, view

# written out once more, so that a word lost on one side shows
_STOP = (
    "['the', 'and', 'for', 'with', 'that', 'this', 'from', 'into', 'when', 'what', 'where', 'which', 'does', 'how', 'why', 'are', 'was', 'were', 'has', 'have', 'had', "
    "'not', 'but', 'can', 'could', 'should', 'would', 'about', 'over', 'under']"
)


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9_]+'), lambda w: length(w) > 2 and not list_contains({_STOP}, w))"


def set_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9_]+'), lambda w: length(w) > 3))"


def _asked(read) -> DataFrame:
    return read("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# every distinct token of a query once; boosts by tokens of the title, then of tags and summary; lengths of 1 at least
_BM25_SQL = f"""
with asked as (select distinct item_id as query_id, unnest({tokens_sql("text")}) as token from benchmark),
words as (select path, {tokens_sql("title")} as title, {tokens_sql("rest")} as rest, {tokens_sql("text")} as ts from wiki_pages),
stats as (select count(*) as n_docs, avg(greatest(len(ts), 1)) as avg_len from words),
tf as (select path, token, count(*) as tf, any_value(len) as len, any_value(boost) as boost
       from (select path, greatest(len, 1) as len, token, case when list_contains(title, token) then 3.0 when list_contains(rest, token) then 2.0 else 1.0 end as boost
             from (select path, title, rest, len(ts) as len, unnest(ts) as token from words)) where token in (select token from asked) group by path, token),
df as (select token, count(*) as df from tf group by token),
scored as (select query_id, path, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) * boost), 6) as score
           from tf join df using (token) join asked using (token), stats group by query_id, path)
select query_id, path, rank::int as rank, score from (select *, row_number() over (partition by query_id order by score desc, path) as rank from scored where score > 0) where rank <= 5
"""


@query("bm25_top5", _BM25_SQL)
def bm25_top5(read):
    return lexical.bm25(read("wiki_pages"), _asked(read), 5)


_KEPT_SQL = _BM25_SQL.replace("benchmark", "asked_twice").replace("wiki_pages", "kept_pages")


@query("kept_index_top5", _KEPT_SQL)
def kept_index_top5(read):
    """An index of stale pages, brought up to date, and asked queries that repeat their words and name titles."""
    pages = read("stale_pages")
    index = TextIndex(pages.sparkSession, f"{shared_folder(pages.sparkSession)}/index-{uuid.uuid4().hex}")
    index.refresh(pages)
    index.refresh(read("kept_pages"))
    return index.search(read("asked_twice").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 5)


@query(
    "index_search_top5",
    f"""with q as (select item_id as query_id, {tokens_sql("text")} as ts from benchmark),
    s as (select query_id, path, len(list_filter(ts, lambda t: contains(lower(concat_ws(' ', title, rest)), t))) as score from wiki_pages, q)
    select query_id, path, rank::int as rank, score from (select *, row_number() over (partition by query_id order by score desc, path) as rank from s where score > 0) where rank <= 5""",
)
def index_search_top5(read):
    return lexical.index_search(read("wiki_pages"), _asked(read), 5)


@query("document_frequency", f"select token, count(*) as df from (select unnest(list_distinct({tokens_sql('text')})) as token from documents) group by token")
def document_frequency(read):
    return lexical.document_frequency(read("documents"))


@query("corpus_stats", f"select count(*) as n_docs, round(avg(greatest(len({tokens_sql('text')}), 1)), 6) as avg_len from documents")
def corpus_stats(read):
    return lexical.corpus_stats(read("documents")).withColumn("avg_len", F.round("avg_len", 6))


@query(
    "token_counts",
    f"select doc_id, len({tokens_sql('text')})::int as n_tokens, len({set_sql('text')})::int as n_set, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3)))::int as n_plain from documents",
)
def token_counts(read):
    t = F.col("text")
    return read("documents").select("doc_id", F.size(tokenize(t)).alias("n_tokens"), F.size(token_set(t)).alias("n_set"), F.size(token_set(t, r"[\W_]+")).alias("n_plain"))


@query(
    "bm25_excerpts",
    f"""with w as (select doc_id, text, {tokens_sql("title")} as ts from wiki_pages),
    l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: len(list_filter(ts, lambda t: contains(lower(x), t))) > 0) as hit, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') as full_lines from w)
    select doc_id, substring(trim(array_to_string(list_transform(case when len(hit) > 0 then hit[1:3] else full_lines[1:2] end, lambda x: trim(x, ' ')), ' '), ' '), 1, 240) as excerpt from l""",
)
def bm25_excerpts(read):
    return read("wiki_pages").select("doc_id", lexical.excerpt(F.col("text"), tokenize(F.col("title"))).alias("excerpt"))


_KNN_SQL = """with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 20 = 0), c as (select vec_id as key, embedding::double[] as e from embeddings),
    s as (select query_id, key, round(list_cosine_similarity(q.e, c.e), 6) as score from q, c)
    select query_id, key, rank::int as rank, score from (select *, row_number() over (partition by query_id order by score desc, key) as rank from s) where rank <= 5"""


@query("knn_top5", _KNN_SQL)
def knn_top5(read):
    rows = read("embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return vector.knn(rows, rows.where("key % 20 = 0").select(F.col("key").alias("query_id"), "embedding"), 5)


@query("knn_by_cells_top5", _KNN_SQL)
def knn_by_cells_top5(read):
    rows = read("embeddings").select(F.col("vec_id").alias("key"), "embedding")
    asked = rows.where("key % 20 = 0").select(F.col("key").alias("query_id"), "embedding")
    return cells.build(rows).search(asked, 5).drop("opened")


@query("vector_norms", "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as length, round(list_cosine_similarity(embedding::double[], list_reverse(embedding::double[])), 6) as mirrored from embeddings")
def vector_norms(read):
    return read("embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("length"), F.round(cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("mirrored"))


_RRF_SQL = """
with page as (select query_id, path, sum(1.0::double / (60 + rank)) as ps, min(rank) as pr from lexical_hits group by 1, 2),
hits as (select query_id, path, anchor, sum(1.0::double / (60 + rank)) as own, min(rank) as first from vector_hits group by 1, 2, 3),
b as (select *, row_number() over (partition by query_id, path order by anchor is null, first) = 1 as best from hits),
f as (select query_id, path, anchor, round((case when best is null or best then coalesce(ps, 0) else 0 end) + coalesce(own, 0), 9) as score, case when best is null then 0 else 1 end as l, case when best is null then pr else first end as pos
      from page full join b using (query_id, path))
select query_id, path, anchor, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, l, pos, path) as rank from f) where rank <= 10
"""


@query("rrf_fusion", _RRF_SQL)
def rrf_fusion(read):
    return fusion.rrf(read("lexical_hits"), read("vector_hits"), 10)


@query("one_hit_per_page", "select query_id, path, min(rank) as rank from lexical_hits group by 1, 2")
def one_hit_per_page(read):
    return fusion.one_per_page(read("lexical_hits").select("query_id", "path", "rank"))


@query("judged_rerank", "select query_id, path, rank, score, relevance, (row_number() over (partition by query_id order by coalesce(relevance, 0.5) desc, score desc, rank, path))::int as judged_rank from lexical_hits")
def judged_rerank(read):
    return fusion.rerank(read("lexical_hits").select("query_id", "path", "rank", "score", "relevance"))


@query(
    "sufficiency_gate",
    """select query_id, path, rank, relevance from lexical_hits where coalesce(relevance, 0.5) >= 0.5 and query_id in
    (select query_id from (select query_id, max(relevance) as m, min(score) as s from lexical_hits group by 1) where s < 5 and m >= 0.5)""",
)
def sufficiency_gate(read):
    hits = read("lexical_hits").select("query_id", "path", "rank", "score", "relevance")
    sufficiency = hits.groupBy("query_id").agg(F.when(F.min("score") < 5, F.max("relevance")).alias("sufficiency"))
    return fusion.gate(hits, sufficiency).drop("score")


@query(
    "budgeted_brief",
    """select query_id, path, rank, used from (select query_id, path, rank, sum(length(excerpt)) over w as used, count(*) over w as n from lexical_hits window w as (partition by query_id order by rank rows unbounded preceding)) where used <= 120 or n = 1""",
)
def budgeted_brief(read):
    return fusion.within_budget(read("lexical_hits").select("query_id", "path", "rank", "excerpt"), 120).drop("excerpt")


@query(
    "merged_engines",
    """with e as (select query_id, path, rank, score, 0 as engine from lexical_hits where rank <= 5 union all select query_id, concat('g/', path), rank, score * 1.5, 1 from lexical_hits where rank <= 5)
    select query_id, path, score, rank::int as rank from (select query_id, path, score, row_number() over (partition by query_id order by score desc, engine, rank, path) as rank from e) where rank <= 10""",
)
def merged_engines(read):
    own = read("lexical_hits").select("query_id", "path", "rank", "score")
    other = own.select("query_id", F.concat(F.lit("g/"), "path").alias("path"), "rank", (F.col("score") * 1.5).alias("score"))
    return fusion.merge_by_score([own, other], 10)


@query(
    "continuations",
    f"""with u as (select session, ord, role, text, last_value(case when role = 'user' then text end ignore nulls) over (partition by session order by ord rows between unbounded preceding and 1 preceding) as previous from messages)
    select session, ord, length(previous)::int as n_previous, (len({tokens_sql("trim(text, ' ')")}) < 4 or regexp_matches(trim(text, ' '), '(?i)^(yes|yeah|yep|ok|okay|sure|continue|go on|go ahead|do it|proceed|next|and then|please do)\\b')) as continuation from u where role = 'user'""",
)
def continuations(read):
    from loreweave.operators.sessions import previous_user

    return previous_user(read("messages")).select("session", "ord", F.length("previous").alias("n_previous"), is_continuation(F.col("text")).alias("continuation"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: BM25 over the pages and nearest vectors of equal number, fused."""
    pages = view(spark, sf_dir, "wiki_pages")
    asked = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    lex = lexical.bm25(pages, asked, 15).select("query_id", "path", "rank")
    rows = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    near = vector.knn(rows, rows.join(asked, rows["key"] == asked["query_id"], "left_semi").select(F.col("key").alias("query_id"), "embedding"), 15)
    named = pages.select(F.col("doc_id").alias("key"), "path")
    anchored = near.join(named, "key").select("query_id", "path", F.lit("overview").alias("anchor"), "rank")
    return fusion.rrf(lex, anchored, 10)


_HYBRID_SQL = f"""
with {_BM25_SQL.strip()[5:].replace("select query_id, path, rank::int as rank, score from (select *, row_number()", ", lex as (select query_id, path, rank::int as rank from (select *, row_number()").replace("where rank <= 5", "where rank <= 15)")},
knn as (select q.vec_id as query_id, c.vec_id as key, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) as sim from embeddings q, embeddings c where q.vec_id in (select item_id from benchmark)),
near as (select query_id, path, rank from (select query_id, key, row_number() over (partition by query_id order by sim desc, key) as rank from knn) k join wiki_pages on key = doc_id where rank <= 15),
page as (select query_id, path, sum(1.0::double / (60 + rank)) as ps, min(rank) as pr from lex group by 1, 2),
vec as (select query_id, path, sum(1.0::double / (60 + rank)) as own, min(rank) as first from near group by 1, 2),
fused as (select query_id, path, case when own is null then null else 'overview' end as anchor, round(coalesce(ps, 0) + coalesce(own, 0), 9) as total, case when own is null then 0 else 1 end as l, case when own is null then pr else first end as pos from page full join vec using (query_id, path))
select query_id, path, anchor, total as score, rank::int as rank from (select *, row_number() over (partition by query_id order by total desc, l, pos, path) as rank from fused) where rank <= 10
"""


@query("hybrid_top10", _HYBRID_SQL)
def hybrid_top10(read):
    pages, rows = read("wiki_pages"), read("embeddings").select(F.col("vec_id").alias("key"), "embedding")
    asked = _asked(read)
    lex = lexical.bm25(pages, asked, 15).select("query_id", "path", "rank")
    near = vector.knn(rows, rows.join(asked, rows["key"] == asked["query_id"], "left_semi").select(F.col("key").alias("query_id"), "embedding"), 15)
    anchored = near.join(pages.select(F.col("doc_id").alias("key"), "path"), "key").select("query_id", "path", F.lit("overview").alias("anchor"), "rank")
    return fusion.rrf(lex, anchored, 10)
