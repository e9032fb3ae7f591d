"""Exact nearest neighbours by cosine for a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and chunks whose scores a task holds at once, of each.
TILE = 512


def best_of(frames: Iterator[pd.DataFrame], ids: np.ndarray, q: np.ndarray, dims: int, k: int, plain: type) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query the scores and keys of the ``k`` nearest rows of ``frames`` (key, embedding); ``q`` has length 1."""
    best = [(np.zeros(0), np.zeros(0, plain)) for _ in ids]  # of each query: scores and keys, k at most
    edge = np.full(len(ids), -np.inf)  # the k-th score of each query so far
    for frame in frames:
        frame = frame[frame["embedding"].map(lambda e: e is not None and len(e) == dims)]
        if not len(frame) or not len(ids):
            continue
        m = np.array(frame["embedding"].tolist(), np.float64)
        size = np.linalg.norm(m, axis=1)
        fit = (size > 0) & np.isfinite(size)
        keys, m = frame["key"].to_numpy()[fit], m[fit] / size[fit][:, None]
        for x, y in ((x, y) for y in range(0, len(keys), TILE) for x in range(0, len(ids), TILE)):
            score = q[x : x + TILE] @ m[y : y + TILE].T
            np.round(score, 6, out=score)
            for i in np.flatnonzero(score.max(axis=1) >= edge[x : x + TILE]):
                own, keep = score[i], min(k, score.shape[1])
                least = max(edge[x + i], np.partition(own, len(own) - keep)[len(own) - keep])
                at = np.flatnonzero(own >= least)  # ties at the edge stay until keys decide
                s, near_ = np.concatenate([best[x + i][0], own[at]]), np.concatenate([best[x + i][1], keys[y + at]])
                order = np.lexsort((near_ if plain is np.int64 else pd.factorize(near_, sort=True)[0], -s))[:k]
                best[x + i] = s[order], near_[order]
                edge[x + i] = s[order][-1] if len(order) == k else -np.inf
    return best


def knn(chunks: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """The ``k`` nearest chunks of each query: query_id, key, rank, score (6 digits).

    ``chunks`` has key and embedding, ``queries`` query_id and embedding. Queries go to the tasks in blocks of
    ``block`` vectors (a bounded broadcast, one pass a block); every task keeps its ``k`` best of each query by matrix
    products, of ``TILE`` queries and as many chunks at once, and a window takes the best of those. Vectors of no length,
    of another size or with components that aren't finite are left out; ties go by key. Keys and query_ids may be numbers or texts.
    """
    spark, out = chunks.sparkSession, None
    rows = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding").orderBy("query_id")
    count = rows.count()
    key, query = (df.schema[c].dataType.simpleString() for df, c in ((chunks, "key"), (rows, "query_id")))
    kinds, plain = f"query_id {query}, key {key}, score double", object if key == "string" else np.int64
    for start in range(0, max(1, count), block):
        own = rows.offset(start).limit(block).toPandas()
        dims = len(own["embedding"].iloc[0]) if len(own) else 0
        own = own[own["embedding"].map(len) == dims]
        q = np.array(own["embedding"].tolist(), np.float64).reshape(len(own), dims)
        length = np.linalg.norm(q, axis=1)
        held = spark.sparkContext.broadcast((own["query_id"].to_numpy()[length > 0], q[length > 0] / length[length > 0][:, None], dims))

        def near(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q, dims = held.value
            best = best_of(frames, ids, q, dims, k, plain)
            yield pd.DataFrame({"query_id": np.repeat(ids, [len(s) for s, _ in best]), "key": np.concatenate([x[1] for x in best]), "score": np.concatenate([x[0] for x in best])} if len(ids) else {"query_id": [], "key": [], "score": []})

        part = chunks.select("key", "embedding").mapInPandas(near, kinds)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "key", "rank", "score")
