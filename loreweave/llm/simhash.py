"""Operator 4, SimHash near-duplicates by tiled exact comparison.

Each text's word shingles are hashed (XXH64) and voted into 64 bits. Distinct fingerprints are dealt by five bit
blocks: two that differ in at most four bits agree in a whole block, so every link is found in some block's group.
Within a group they are sorted by population count and compared tile by tile, by numpy exclusive-or and bit counts;
tile pairs whose counts differ beyond the radius are skipped. A group over the bound is cut into parts of that size
by population count and hash, and its parts are compared pair by pair in tasks of their own. A task returns the
smallest forest that connects what it linked, so that a clique costs as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, tidy
from .components import components

SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit vote over a whole text's shingles of ``width`` words, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest as xxh64

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:count].tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1)[:count].tolist()
    hashes = np.fromiter((xxh64(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, count)
    votes = np.zeros(64, np.int64)
    for at in range(0, count, 4096):
        votes += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > count).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, a hash of the text (_text) and the fingerprint as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = np.array([fingerprint(t if isinstance(t, str) else None, width) for t in frame["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "_text": frame["_text"], "fp": found.view(np.int64)})

    text = F.col("text").cast("string")
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("_text")).mapInPandas(tidy(run), "doc_id long, _text long, fp long")


class Forest:
    """Union by smallest index over 0..n-1, over arrays of links."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, low, high = a[apart], b[apart], np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(self.up, high, low)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[x]
            above = self.up[up]
            if np.array_equal(up, above):
                return up
            self.up[x] = above
            x = up


def tiled_links(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (as values) that connect what ``left`` has within ``radius`` bits of itself, or of ``right``.

    Both are sorted by population count; a tile pair is skipped if the counts of its nearest members differ by more.
    """
    nodes = left if right is None else np.concatenate([left, right])
    order = np.argsort(np.bitwise_count(nodes), kind="stable")
    nodes, side = nodes[order], order >= len(left)
    pops = np.bitwise_count(nodes).astype(np.int64)
    forest = Forest(len(nodes))
    for i in range(0, len(nodes), tile):
        a = nodes[i : i + tile]
        highest = pops[min(i + tile, len(nodes)) - 1]
        for j in range(i, len(nodes), tile):
            if pops[j] - highest > radius:
                break
            near = np.bitwise_count(a[:, None] ^ nodes[None, j : j + tile]) <= radius
            if right is not None:
                near &= side[i : i + tile][:, None] != side[None, j : j + tile]
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            apart = x < y
            forest.link(x[apart], y[apart])
    roots = forest.roots(np.arange(len(nodes)))
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[moved], nodes[roots[moved]]


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of ``radius`` + 1 blocks that cover 64 bits."""
    cuts = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(distinct: DataFrame, radius: int = 4, bound: int = 20_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all within ``radius`` bits of each other."""
    keys = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("bits")) for k, (s, w) in enumerate(blocks_of(radius))]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.block", "k.bits", "fp")
    # groups over the bound: how many parts, each pair of which is a task of its own
    large = rows.groupBy("block", "bits").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound)
    parts = large.select("block", "bits", F.ceil(F.col("_n") / bound).cast("int").alias("_parts"))
    dealt = rows.join(parts, ["block", "bits"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda o: F.struct(F.least(o, F.col("_own")).alias("p"), F.greatest(o, F.col("_own")).alias("q")))
    tasks = (
        dealt.withColumn("_own", part)
        .select("block", "bits", "fp", "_own", F.explode(others).alias("_t"))
        .select("block", "bits", F.col("_t.p").alias("p"), F.col("_t.q").alias("q"), "fp", "_own")
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fps, own = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["_own"].to_numpy()
        p, q = frame["p"].iloc[0], frame["q"].iloc[0]
        a, b = tiled_links(fps, None, radius) if p == q else tiled_links(fps[own == p], fps[own == q], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return _by_task(tasks, compare)


def _by_task(tasks: DataFrame, compare) -> DataFrame:
    """Sort the tasks' rows into partitions and compare group by group, many small groups in one batch of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, rest = ["block", "bits", "p", "q"], None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            k = frame[keys].to_numpy(np.int64)
            new = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            edges = [0, *new.tolist()]
            out = [compare(frame.iloc[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
            rest = frame.iloc[edges[-1] :] if len(frame) else None
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None and len(rest) > 1:
            yield compare(rest)

    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_tasks = tasks.repartition(n, "block", "bits", "p", "q").sortWithinPartitions("block", "bits", "p", "q")
    return sorted_tasks.mapInPandas(run, "a long, b long")


def groups(rows: DataFrame, radius: int, *least: Column) -> DataFrame:
    """(fp, _root, then the ``least`` columns) for each distinct fingerprint of ``rows``; _root names its component.

    ``least``: aggregates over the rows of one fingerprint. Copies of one text are one row from here on.
    """
    distinct = cut_lineage(rows.groupBy("fp").agg(*least))
    roots = components(links(distinct.select("fp"), radius))
    return cut_lineage(distinct.join(roots, distinct["fp"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "fp")).drop("node", "root"))


def cluster(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links).

    Null, empty and blank texts have fingerprint 0, which links like any other; a text of any length is hashed whole.
    Copies share a fingerprint and are linked by it. Repeated rows stay; null doc_ids get the component of the
    fingerprints they share (null if alone); an empty table gives no rows; other columns are ignored.
    """
    rows = cut_lineage(fingerprints(docs, width).drop("_text"))
    named = groups(rows, radius, F.min("doc_id").alias("_least"))
    # written, so that both joins are plain ones, whose large partitions Spark can split
    least = cut_lineage(named.groupBy("_root").agg(F.min("_least").alias("component_id")))
    told = cut_lineage(named.join(least, "_root").select("fp", "component_id"))
    return rows.join(told, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """The rows of ``docs`` with one row for each component: that of the smallest doc_id, then of the least text hash.

    All columns stay, whatever their names. Null doc_ids come after all others; of rows that repeat in doc_id and text
    one stays; null and empty texts are one component.
    """
    order = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_text")).alias("_k")
    rows = cut_lineage(fingerprints(docs, width))
    kept = groups(rows, radius, order).groupBy("_root").agg(F.min("_k").alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k._text").alias("_kept"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    # the small side is hashed, so that texts are shuffled once and not sorted for the join
    same = own["_own"].eqNullSafe(kept["_id"]) & (own["_hash"] == kept["_kept"])
    return own.join(kept.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["_own", "_hash"]).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
