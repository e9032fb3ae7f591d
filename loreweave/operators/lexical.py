"""Lexical search: corpus statistics, BM25 and index search for a set of queries, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import tokenize

from loreweave.session import cut, spread

from . import postings
from .containment import held_names


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, n): a query's tokens and how often it has them."""
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("n"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents and their average length in tokens; a document without any counts as 1."""
    length = F.greatest(F.size(tokenize(F.coalesce("text", F.lit("")))), F.lit(1))
    return spread(docs.select("text")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(length), F.lit(1.0)).alias("avg_len"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(token, df) over all distinct tokens."""
    return spread(docs.select("text")).select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, block: int = postings.QUERIES) -> DataFrame:
    """The ``k`` best documents of each query: query_id, path, rank, score (6 digits).

    ``docs`` has path, title, rest (tags and summary) and text. Each distinct token of a query counts once, three times as
    much where it is a token of the title and twice where it is one of the rest; ties go by path. The corpus is cut into
    tokens once: blocks of the queries' tokens only, which are then searched as a kept index is (``postings``,
    ``sources.textindex``), about ``block`` queries at a time.
    """
    spark = docs.sparkSession
    asked = cut(postings.query_tokens(queries))
    ranges = postings.ranges_for(docs.count(), spark.sparkContext.defaultParallelism)
    held = cut(postings.blocks(docs.select("path", "title", "rest", "text"), ranges, asked.select("token").distinct()))
    return postings.search(held, asked, *postings.statistics(held), k, block=block)


def top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "path", "rank", "score")


def index_search(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Score: how many of a query's tokens (repeats count) are part of title, summary or tags.

    Parts of words count: each distinct token of the queries is looked up in the titles once, see ``held_names``, and
    what was found meets the queries on the token.
    """
    asked = query_tokens(queries)
    hay = docs.select("path", F.lower(F.concat_ws(" ", "title", "rest")).alias("hay"))
    held = held_names(hay, asked.select(F.col("token").alias("name")).distinct(), "hay", keep=["path"]).select("path", F.col("name").alias("token"))
    scored = held.join(asked, "token").groupBy("query_id", "path").agg(F.sum("n").alias("score"))
    return top(scored, k)


def excerpt(text: Column, tokens: Column, lines: int = 3, chars: int = 240) -> Column:
    """The first lines that hold a token, else the first two that aren't blank."""
    every = F.split(text, "\n")
    hit = F.filter(every, lambda x: F.exists(tokens, lambda t: F.lower(x).contains(t)))
    full = F.filter(every, lambda x: F.trim(x) != "")
    chosen = F.when(F.size(hit) > 0, F.slice(hit, 1, lines)).otherwise(F.slice(full, 1, 2))
    return F.substring(F.trim(F.array_join(F.transform(chosen, lambda x: F.trim(x)), " ")), 1, chars)
