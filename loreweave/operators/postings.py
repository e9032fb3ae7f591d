"""An inverted index in blocks, and BM25 search over it that passes over ranges of documents out of reach.

Documents are dealt into ranges and numbered inside them. A block holds the postings of one token in one range, with how
often the token is there at most, the least length and the greatest boost of its documents: no document of the block can
score more than those would. So for a query and a range there is a bound on every score, from one number a block. Each
query searches its most promising range first; only ranges whose bound reaches the k-th score found there are opened.

A block under the token "" lists all documents of its range with their paths, and one under " " those that no longer count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import tokenize
from loreweave.session import spread

K1, B = 1.2, 0.75
EVERY, DEAD = "", " "
#: Documents in a range, at most about; queries that meet a range at once.
RANGE, QUERIES = 4096, 256
#: Distinct tokens of queries that are broadcast, at most.
WANTED = 1 << 18
BLOCK = "range long, token string, n long, most int, least int, boost double, slots array<int>, tfs array<int>, lens array<int>, boosts array<double>, paths array<string>, hashes array<string>"


def ranges_for(count: int, cores: int, size: int = RANGE) -> int:
    """How many ranges: of ``size`` documents, or smaller ones while there are fewer ranges than cores can work on."""
    return max(1, -(-count // size), min(2 * cores, -(-count // 256)))


def blocks(docs: DataFrame, ranges: int, wanted: DataFrame | None = None, first: int = 0) -> DataFrame:
    """The blocks of ``docs`` (path, title, rest, text; hash, if it is there), of all tokens or those of ``wanted`` (token).

    A token of the title weighs 3, one of ``rest`` (tags, summary) 2, any other 1. Where all tokens are kept, texts move once,
    to their range; else they are counted where they are, and only counts of asked tokens move. A text's length is its number of tokens, 1 at least. Null texts have no tokens. Ranges are
    numbered from ``first``.
    """
    own = docs if "hash" in docs.columns else docs.withColumn("hash", F.lit(None).cast("string"))
    placed = own.select("path", "hash", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "rest", "text")], (F.pmod(F.xxhash64("path"), F.lit(ranges)) + first).alias("range"))
    spark = docs.sparkSession
    if wanted is None:
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        numbered = placed.repartition(parts, "range").withColumn("slot", F.row_number().over(Window.partitionBy("range").orderBy("path", "hash")) - 1)
        words = numbered.select("range", "slot", "path", "hash", tokenize(F.col("text")).alias("tokens"), *[F.array_distinct(tokenize(F.col(c))).alias(c) for c in ("title", "rest")])
        return words.groupBy("range").applyInArrow(gathered_range, BLOCK)
    # words of the title and the rest come marked; only one array is opened, and only the row that lists a document has its path
    marked = lambda c, mark: F.transform(F.array_distinct(tokenize(F.col(c))), lambda t: F.concat(F.lit(mark), t))
    sized = spread(placed).select("range", F.monotonically_increasing_id().alias("doc"), "path", "hash", tokenize(F.col("text")).alias("tokens"), marked("title", "3:").alias("title"), marked("rest", "2:").alias("rest"))
    each = sized.select("range", "doc", "path", "hash", F.greatest(F.size("tokens"), F.lit(1)).alias("len"), F.explode(F.concat("tokens", "title", "rest", F.array(F.lit(EVERY)))).alias("word"))
    mark, lists = F.substring("word", 1, 2), F.col("word") == EVERY
    named = each.select("range", "doc", F.when(lists, F.col("path")).alias("path"), F.when(lists, F.col("hash")).alias("hash"), "len", F.when(mark == "3:", 3.0).when(mark == "2:", 2.0).otherwise(1.0).alias("boost"), F.when(mark.isin("3:", "2:"), F.substring("word", 3, 1 << 30)).otherwise(F.col("word")).alias("token"))
    # few tokens go to the words: else every word of the texts would move to them, and once more to its range
    held_ = wanted.select("token").unionByName(spark.createDataFrame([(EVERY,)], "token string")).distinct()
    named = named.join(F.broadcast(held_) if held_.count() <= WANTED else held_, "token", "left_semi")
    tf = named.groupBy("range", "doc", "token", "path", "hash").agg(F.sum(F.when(F.col("boost") == 1.0, 1).otherwise(0)).cast("int").alias("tf"), F.max("boost").alias("boost"), F.max("len").alias("len")).where("tf > 0")
    return tf.groupBy("range").applyInArrow(packed_range, BLOCK)


def gathered_range(docs: pa.Table) -> pa.Table:
    """The blocks of one range (range, slot, path, hash, tokens, title, rest), of all tokens: numbered, sorted and cut as arrays."""
    docs = docs.sort_by("slot").combine_chunks()
    count = docs.num_rows
    column = lambda c: docs[c].combine_chunks() if isinstance(docs[c], pa.ChunkedArray) else docs[c]
    lists = [column(c) for c in ("tokens", "title", "rest")]
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    flat = [x.flatten() for x in lists]
    numbered = pa.concat_arrays([*flat, pa.array([EVERY], flat[0].type)]).dictionary_encode()
    code = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum([len(x) for x in flat])
    doc = np.arange(count)
    text, title, rest = (c * count + np.repeat(doc, n) for c, n in zip(np.split(code[:-1], at[:-1]), sizes, strict=True))
    key, tf = np.unique(np.concatenate([text, code[-1] * count + doc]), return_counts=True)
    boost = np.ones(len(key))
    for more, weight in ((rest, 2.0), (title, 3.0)):
        place = np.minimum(np.searchsorted(key, more), len(key) - 1)
        boost[place[key[place] == more]] = weight
    token, own = key // count, key % count
    length = np.maximum(sizes[0], 1)[own]
    return _gathered(docs["range"][0].as_py(), numbered.dictionary, token, column("slot").to_numpy(zero_copy_only=False)[own], tf, length, boost, docs["path"].to_pylist(), docs["hash"].to_pylist())


def packed_range(counts: pa.Table) -> pa.Table:
    """The blocks of one range (range, doc, token, path, hash, tf, boost, len): documents are numbered as their paths sort."""
    counts = counts.combine_chunks()
    column = lambda c: counts[c].combine_chunks() if isinstance(counts[c], pa.ChunkedArray) else counts[c]
    coded = column("token").dictionary_encode()
    listed = counts.filter(pc.equal(counts["token"], EVERY)).sort_by([(c, "ascending") for c in ("path", "hash", "doc")])
    docs = listed["doc"].to_numpy()
    order = np.argsort(docs)
    slot = order[np.searchsorted(docs, column("doc").to_numpy(zero_copy_only=False), sorter=order)]
    token = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.lexsort((slot, token))
    tf, length, boost = (column(c).to_numpy(zero_copy_only=False)[by] for c in ("tf", "len", "boost"))
    return _gathered(counts["range"][0].as_py(), coded.dictionary, token[by], slot[by], tf, length, boost, listed["path"].to_pylist(), listed["hash"].to_pylist())


def _gathered(range_: int, words: pa.Array, token: np.ndarray, slot: np.ndarray, tf: np.ndarray, length: np.ndarray, boost: np.ndarray, paths: list, hashes: list) -> pa.Table:
    """The blocks of one range, cut as arrays where another token begins; postings are sorted by token and slot."""
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    ends = pa.array(np.append(start, len(token)), pa.int32())
    ids = words.take(pa.array(token[start])).cast(pa.string())
    every = pc.equal(ids, EVERY).to_pylist()
    whole = lambda values: pa.array([values if e else None for e in every], pa.list_(pa.string()))
    listed = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(values, kind))
    kept = {
        "range": pa.array(np.full(len(ids), range_), pa.int64()),
        "token": ids,
        "n": pa.array(np.diff(np.append(start, len(token))), pa.int64()),
        "most": pa.array(np.maximum.reduceat(tf, start), pa.int32()),
        "least": pa.array(np.minimum.reduceat(length, start), pa.int32()),
        "boost": pa.array(np.maximum.reduceat(boost, start), pa.float64()),
        "slots": listed(slot, pa.int32()),
        "tfs": listed(tf, pa.int32()),
        "lens": listed(length, pa.int32()),
        "boosts": listed(boost, pa.float64()),
        "paths": whole(paths),
        "hashes": whole(hashes),
    }
    return pa.table(kept)


def statistics(held: DataFrame) -> tuple[int, float]:
    """(documents, their lengths together), of the blocks that list documents."""
    total = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
    found = held.where(F.col("token") == EVERY).agg(F.sum("n"), F.sum(total)).head()
    return found[0] or 0, float(found[1] or 0)


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token): the distinct tokens of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("token")).distinct()


def _part(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


def search(held: DataFrame, asked: DataFrame, documents: int, length: float, k: int, less: DataFrame | None = None, block: int = QUERIES) -> DataFrame:
    """The ``k`` best documents of each query: query_id, path, rank, score (6 digits); ties go by path.

    ``held``: blocks of the asked tokens, and those that list documents or what no longer counts; ``asked``: query_id,
    token; ``less`` (token, n): postings that no longer count. ``documents`` and ``length`` are those of the collection. A range
    meets about ``block`` queries at once.
    """
    shares = max(1, -(-asked.select("query_id").distinct().count() // block))
    scored = score(held, weights(held, asked, documents, less), length / max(1, documents), k, shares)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "path", "rank", "score")


def weights(held: DataFrame, asked: DataFrame, documents: int, less: DataFrame | None = None) -> DataFrame:
    """(query_id, token, idf) of the tokens that some document holds."""
    df = held.where(~F.col("token").isin(EVERY, DEAD)).select("token", "n")
    if less is not None:
        df = df.unionByName(less.select("token", (-F.col("n")).alias("n")))
    counted = df.groupBy("token").agg(F.sum("n").alias("df")).where("df > 0")
    return asked.join(counted, "token").select("query_id", "token", F.log(1 + (F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bounds(held: DataFrame, weighed: DataFrame, average: float) -> DataFrame:
    """(query_id, range, bound): what no document of a range exceeds."""
    most = held.where(~F.col("token").isin(EVERY, DEAD)).select("range", "token", (_part(F.col("most"), F.col("least"), average) * F.col("boost")).alias("top"))
    return weighed.join(most, "token").groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))


def score(held: DataFrame, weighed: DataFrame, average: float, k: int, shares: int = 1) -> DataFrame:
    """(query_id, path, score): of each opened range the ``k`` best documents of a query."""
    from loreweave.session import cut

    weighed = cut(weighed)
    reach = cut(bounds(held, weighed, average))
    best = reach.groupBy("query_id").agg(F.max_by("range", F.struct("bound", "range")).alias("range"))
    first = cut(_open(held, best, weighed, average, k, shares))
    kth = Window.partitionBy("query_id").orderBy(F.desc("score"))
    edge = first.withColumn("at", F.row_number().over(kth)).where(F.col("at") == k).select("query_id", F.col("score").alias("edge"))
    left = reach.join(best, ["query_id", "range"], "left_anti").join(edge, "query_id", "left").where(F.col("edge").isNull() | (F.col("bound") + 1e-5 >= F.col("edge"))).select("query_id", "range")
    return first.unionByName(_open(held, left, weighed, average, k, shares))


def _open(held: DataFrame, pairs: DataFrame, weighed: DataFrame, average: float, k: int, shares: int) -> DataFrame:
    """Score the queries in the ranges that they are paired with, in ``shares`` parts, each by itself in a range."""
    share = F.pmod(F.xxhash64("query_id"), F.lit(shares))
    wanted = pairs.join(weighed, "query_id").select(F.col("range").alias("at"), share.alias("part"), "query_id", "token", "idf")
    opened = pairs.select("range", share.alias("share")).distinct()
    needed = wanted.select(F.col("at").alias("range"), "token").distinct()
    listed = held.where(F.col("token").isin(EVERY, DEAD))
    used = held.where(~F.col("token").isin(EVERY, DEAD)).join(needed, ["range", "token"], "left_semi").unionByName(listed)
    blocks_ = used.join(opened, "range").select("range", "share", "token", "slots", "tfs", "lens", "boosts", "paths")
    kind = pairs.schema["query_id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"query_id": right["query_id"].iloc[:0], "path": np.zeros(0, object), "score": np.zeros(0)})
        own = left[~left["token"].isin((EVERY, DEAD))].reset_index(drop=True)
        if not len(own) or not len(right):
            return nothing
        paths = np.concatenate(left["paths"][left["token"] == EVERY].tolist())
        dead = [x for x in left["slots"][left["token"] == DEAD]]
        sizes = own["slots"].map(len).to_numpy()
        slot, tf, length, boosts = (np.concatenate(own[c].tolist()) for c in ("slots", "tfs", "lens", "boosts"))
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average)) * boosts
        if dead:
            weight = np.where(np.isin(slot, np.concatenate(dead)), 0, weight)
        place = pd.Index(own["token"]).get_indexer(right["token"])
        right, place = right[place >= 0], place[place >= 0]
        query, ids = pd.factorize(right["query_id"])
        count = sizes[place]
        start = (np.cumsum(sizes) - sizes)[place]
        at = np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)
        cell = np.repeat(query, count) * len(paths) + slot[at]
        total = np.bincount(cell, np.repeat(right["idf"].to_numpy(), count) * weight[at], len(ids) * len(paths)).reshape(len(ids), len(paths))
        total = np.round(total, 6)
        top = np.argsort(-total, axis=1, kind="stable")[:, :k]  # slots follow paths, so ties go by path
        value = np.take_along_axis(total, top, 1)
        x, y = np.nonzero(value > 0)
        return pd.DataFrame({"query_id": np.asarray(ids)[x], "path": paths[top[x, y]], "score": value[x, y]})

    return blocks_.groupBy("range", "share").cogroup(wanted.groupBy("at", "part")).applyInPandas(run, f"query_id {kind}, path string, score double")
