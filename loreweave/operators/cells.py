"""Exact nearest neighbours by cosine over an inverted file: cells of near vectors, of which a search opens only those that
the triangle inequality leaves in reach."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.session import cut

#: Scores are compared at six digits, so what comes this close to the k-th one may still tie with it.
MARGIN = 2e-6


def _small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Rows with packed vectors go to Python some ``size`` bytes at a time, where the session allows more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not str(now).isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def _units(embeddings: pd.Series, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length 1, and which of the rows have one: of ``dims`` numbers, all finite, not all zero."""
    fit = embeddings.map(lambda e: e is not None and len(e) == dims).to_numpy(bool)
    m = np.array([[np.nan if x is None else x for x in e] for e in embeddings[fit]], np.float64).reshape(int(fit.sum()), dims)
    size = np.sqrt((m * m).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    fit[fit] = good
    return m[good] / size[good][:, None], fit


def _distances(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 1.0 - 2.0 * (units @ centres.T) + (centres * centres).sum(axis=1)))


def _centres(units: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Means of ``cells`` clusters at most (Lloyd's rounds from evenly taken rows); empty clusters go."""
    centres = np.unique(units[np.linspace(0, len(units) - 1, min(cells, len(units))).astype(int)], axis=0)
    for _ in range(rounds):
        own = np.argmax(units @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, units)
        centres = total[count > 0] / count[count > 0][:, None]
    return centres


@dataclass
class Cells:
    """Packed vectors (``parts``: cell, low, high, n, keys, vectors), the cells' centres and how far their rows lie from them.

    A part holds rows of one cell between two distances from its centre. Centres and reaches are one row a cell, so their
    size is bounded by ``build``'s ``cells``.
    """

    parts: DataFrame
    centres: np.ndarray
    reach: np.ndarray

    def search(self, queries: DataFrame, k: int = 5, probe: int = 4) -> DataFrame:
        """The ``k`` nearest rows of each query: query_id, key, rank, score (6 digits), opened (rows scored for the query).

        First each query's ``probe`` nearest cells are scored. Their k-th score says how near a vector must lie, and only
        cells and parts that may hold such a one are opened after. The answer is that of a scan of all rows; ties go by
        key. Queries stay in their partitions: nothing is collected. Queries without a vector, of no length, with null or
        non-finite numbers, of another size or without an id give no rows; queries that share an id share one answer.
        """
        _small_batches(queries.sparkSession)
        asked = queries.select("query_id", "embedding").where("query_id is not null")
        first = cut(_best(self._scored(asked, k, probe, None), k))
        edge = first.groupBy("query_id").agg(F.when(F.count("key") >= k, F.min("score")).alias("edge"))
        rest = self._scored(asked.join(edge, "query_id", "left"), k, probe, "edge")
        return _best(first.drop("rank").unionByName(rest), k)

    def _scored(self, asked: DataFrame, k: int, probe: int, edge: str | None) -> DataFrame:
        centres, reach = self.centres, self.reach
        kind, key = asked.schema["query_id"].dataType.simpleString(), self.parts.schema["keys"].dataType.elementType.simpleString()

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in frames:
                for start in range(0, len(whole), 1024):
                    frame = whole.iloc[start : start + 1024]
                    units, fit = _units(frame["embedding"], centres.shape[1])
                    ids = frame["query_id"].to_numpy()[fit]
                    if not len(ids) or not len(centres):
                        continue
                    far = _distances(units, centres)
                    near = np.zeros(far.shape, bool)
                    np.put_along_axis(near, np.argpartition(far, min(probe, len(centres)) - 1, axis=1)[:, :probe], True, axis=1)
                    edges = np.full(len(ids), -2.0)
                    if edge is not None:
                        edges = frame[edge].fillna(-2.0).to_numpy(np.float64)[fit]
                        near = ~near & _within(far, reach[:, 0], reach[:, 1], edges[:, None])
                    for cell in np.flatnonzero(near.any(axis=0)):
                        at = near[:, cell]
                        yield pd.DataFrame({"cell": [cell], "ids": [ids[at].tolist()], "edges": [edges[at].tolist()], "far": [far[at, cell].tolist()], "asked": [units[at].tobytes()]})

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    far, edges = np.asarray(row.far, np.float64), np.asarray(row.edges, np.float64)
                    open_ = _within(far, row.low, row.high, edges)
                    if not open_.any():
                        continue
                    vectors = np.frombuffer(row.vectors, np.float64).reshape(row.n, -1)
                    units = np.frombuffer(row.asked, np.float64).reshape(len(far), -1)[open_]
                    scores, keys = np.round(units @ vectors.T, 6), np.asarray(row.keys, object)
                    keep, out = min(k, row.n), []
                    by_key = np.argsort(np.argsort(keys))  # keys differ in their own order, whatever their type
                    for own in scores:
                        at = np.flatnonzero(own >= np.partition(own, row.n - keep)[row.n - keep])
                        out.append(at[np.lexsort((by_key[at], -own[at]))[:keep]])
                    ids = np.asarray(row.ids, object)[open_]
                    yield pd.DataFrame({"query_id": np.repeat(ids, keep), "key": keys[np.concatenate(out)], "score": np.concatenate([s[o] for s, o in zip(scores, out, strict=True)]), "opened": np.where(np.arange(len(ids) * keep) % keep == 0, row.n, 0)})

        blocks = asked.mapInPandas(ask, f"cell int, ids array<{kind}>, edges array<double>, far array<double>, asked binary")
        return self.parts.join(blocks, "cell").mapInPandas(score, f"query_id {kind}, key {key}, score double, opened long")


def _within(far, low, high, edges):
    """Whether rows that lie ``low`` to ``high`` from a centre may score ``edges`` for a query that lies ``far`` from it."""
    gap = np.maximum(0.0, np.maximum(far - high, low - far) - MARGIN)
    return 1.0 - gap * gap / 2.0 >= edges - MARGIN


def _best(scored: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query_id")
    once = scored.groupBy("query_id", "key").agg(F.max("score").alias("score"), F.sum("opened").alias("opened"))
    ranked = once.withColumn("opened", F.sum("opened").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "key")))
    # a query's count of opened rows stands on its first row alone, so that it is added once when results meet
    return ranked.where(F.col("rank") <= k).select("query_id", "key", "rank", "score", F.when(F.col("rank") == 1, F.col("opened")).otherwise(0).alias("opened"))


def build(chunks: DataFrame, cells: int | None = None, sample: int = 32_768, rows: int = 4096) -> Cells:
    """An inverted file over ``chunks`` (key, unique; embedding): every row goes to the cell whose centre is nearest.

    Centres are means fitted on the ``sample`` rows whose keys have the least hashes; they decide what a search may skip,
    never what it finds. ``cells``: the root of the number of rows, 4,096 at most, unless named. The size that most vectors
    have is the index's; others, and those that are null, zero or hold a null or a non-finite number, are left out. Rows
    are ranged by cell, distance and hash, so a cell of any size, copies included, is dealt over tasks, and packed in parts
    of ``rows`` at most. The parts are written once to the shared folder. An empty table gives no parts.
    """
    spark = chunks.sparkSession
    _small_batches(spark)
    given = chunks.select("key", "embedding").where("key is not null and size(embedding) > 0")
    figures = given.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").head()
    dims, count = (figures["dims"], figures["count"]) if figures else (0, 0)
    given = given.where(F.size("embedding") == dims)
    taken = given.orderBy(F.xxhash64("key"), "key").limit(sample).toPandas()
    units = _units(taken["embedding"], dims)[0]
    centres = _centres(units, cells or min(4096, max(1, int(count**0.5)))) if len(units) else np.zeros((0, dims))
    if not len(centres):  # none in the sample may have a vector of any length
        centres = np.zeros((1, max(dims, 1)))
    key = given.schema["key"].dataType.simpleString()

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            units, fit = _units(frame["embedding"], dims)
            far = _distances(units, centres)
            cell = np.argmin(far, axis=1) if len(units) else np.zeros(0, int)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "far": far[np.arange(len(units)), cell], "key": frame["key"].to_numpy()[fit], "unit": [u.tobytes() for u in units]})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def part() -> pd.DataFrame:
            return pd.DataFrame({"cell": [held[0][0]], "low": [held[0][1]], "high": [held[-1][1]], "n": [len(held)], "keys": [[h[2] for h in held]], "vectors": [b"".join(h[3] for h in held)]})

        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if held and (held[0][0] != row[0] or len(held) >= rows):
                    yield part()
                    held = []
                held.append(row)
        if held:
            yield part()

    placed = given.mapInPandas(assign, f"cell int, far double, key {key}, unit binary")
    ranged = placed.repartitionByRange("cell", "far", F.xxhash64("key")).sortWithinPartitions("cell", "far", "key")
    parts = cut(ranged.mapInPandas(pack, f"cell int, low double, high double, n long, keys array<{key}>, vectors binary"))
    reach = np.tile([[np.inf, -np.inf]], (len(centres), 1))  # a cell without rows is out of every reach
    for r in parts.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # a row a cell
        reach[r["cell"]] = r["low"], r["high"]
    return Cells(parts, centres, reach)
