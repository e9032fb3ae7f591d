"""Operator 13, hard negatives: product quantisation with stored residual norms, bounds both ways, exact integer rerank.

Vectors are whole numbers. Each is stored with the numbers of its nearest codewords, one for each of its slices, and the
length r of what the codewords leave over. A score is then a sum of looked-up products, s, and by Cauchy-Schwarz it is
never further than ``|anchor| * r`` from s. Rows whose whole interval is outside of what can still matter are passed over;
the others are scored exactly. Bounds only decide what is scored, so results are those of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .common import cut_lineage

#: Components in a slice, codewords of a slice, rows that codewords are fitted on, rounds of fitting.
SLICE, WORDS, SAMPLE, ROUNDS = 2, 256, 4096, 6
#: Rows in a chunk, anchors in a block.
CHUNK, BLOCK = 8192, 128
#: Whole components stay below this, so that the score of any vector of up to 2**13 components fits a long.
LARGEST = 1 << 25
#: Room for rounding in the bounds, relative.
SLACK = 1e-9


def whole(vector):
    """``floor(256 * x)`` of each component; null where a vector is null, or a component is null, not finite or too large."""
    v = vector.cast("array<double>")
    fit = grid.finite(v) & F.forall(v, lambda x: F.abs(x * 256) < LARGEST)
    return F.when(fit, F.transform(v, lambda x: F.floor(x * 256).cast("double")))


def codebook(sample: np.ndarray, seed: int = 13) -> np.ndarray:
    """Codewords by k-means, slice by slice: (slices, words, SLICE); the last slice is filled up with zeros."""
    r = np.random.default_rng(seed)
    cut = slices(sample)
    words = min(WORDS, len(sample))
    out = np.empty((cut.shape[1], words, SLICE))
    for m in range(cut.shape[1]):
        own = cut[:, m]
        centre = own[r.choice(len(own), words, replace=False)].copy()
        for _ in range(ROUNDS):
            at = nearest_word(own, centre)
            count = np.bincount(at, minlength=words)
            for c in range(SLICE):
                total = np.bincount(at, weights=own[:, c], minlength=words)
                centre[:, c] = np.where(count > 0, total / np.maximum(count, 1), centre[:, c])
        out[m] = centre
    return out


def slices(x: np.ndarray) -> np.ndarray:
    count = -(-x.shape[1] // SLICE)
    return np.pad(x, ((0, 0), (0, count * SLICE - x.shape[1]))).reshape(len(x), count, SLICE)


def nearest_word(own: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre * centre).sum(1) - 2 * own @ centre.T, axis=1)


def encode(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword numbers (rows, slices) and residual lengths, rounded up."""
    cut = slices(x)
    codes = np.stack([nearest_word(cut[:, m], book[m]) for m in range(len(book))], axis=1).astype(np.uint8) if len(book) else np.zeros((len(x), 0), np.uint8)
    left = cut - np.stack([book[m][codes[:, m]] for m in range(len(book))], axis=1) if len(book) else np.zeros((len(x), 0, SLICE))
    return codes, np.sqrt((left * left).sum((1, 2))) * (1 + SLACK)


def looked_up(anchors: np.ndarray, codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Sums of table entries: what each anchor would score if rows were their codewords."""
    tables = np.einsum("amc,mwc->maw", slices(anchors), book)
    total = np.zeros((len(anchors), len(codes)))
    for m in range(len(book)):
        total += tables[m][:, codes[:, m]]
    return total


def index(rows: DataFrame, size: int = CHUNK) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``rows(id, label, v)`` of whole numbers as chunks with codes and residual lengths, and the codebooks by vector size.

    Codebooks are fitted on some ``SAMPLE`` rows of each vector size (all, if fewer), those under a threshold of their hash;
    every row is encoded.
    """
    sized = rows.select(F.size("v").alias("dims"), F.xxhash64("id", "v").alias("hash"), "v")
    counts = {r["dims"]: r["n"] for r in sized.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each size
    fit = F.lit(False)
    for dims, n in counts.items():
        fit |= (F.col("dims") == dims) & (F.shiftrightunsigned("hash", 32) <= min(1.0, SAMPLE / n) * 2**32)
    books, held = {}, {}
    for dims, v in sized.where(fit).orderBy("dims", "hash").select("dims", "v").collect():  # about SAMPLE rows for each size
        held.setdefault(dims, []).append(v)
    for dims, own in held.items():
        books[dims] = codebook(np.array(own, np.float64).reshape(len(own), dims))

    def build(x: np.ndarray, id: np.ndarray, label: np.ndarray) -> dict[str, bytes]:
        codes, left = encode(x, books[x.shape[1]])
        return {"ids": id.astype(np.int64).tobytes(), "labels": label.astype(np.int64).tobytes(), "x": x.astype(np.int32).tobytes(), "codes": codes.tobytes(), "left": left.tobytes()}

    return grid.pack(rows.select("id", "label", "v"), size, build, ["ids", "labels", "x", "codes", "left"]), books


class Met:
    """A block of anchors over a chunk: bounds of all scores, exact ones where asked for."""

    def __init__(self, chunk: dict, block: dict, books: dict[int, np.ndarray]):
        dims = chunk["dims"]
        self.ids, self.labels = grid.vector(chunk["ids"]), grid.vector(chunk["labels"])
        self.x = grid.matrix(chunk["x"], dims, np.int32) if dims else np.zeros((chunk["rows"], 0), np.int32)
        self.anchors, self.own_labels = grid.vector(block["ids"]), grid.vector(block["labels"])
        self.a = grid.matrix(block["x"], dims) if dims else np.zeros((block["rows"], 0))
        book = books[dims]
        near = looked_up(self.a, np.frombuffer(chunk["codes"], np.uint8).reshape(chunk["rows"], len(book)), book)
        reach = np.sqrt((self.a * self.a).sum(1))[:, None] * np.frombuffer(chunk["left"])[None, :]
        reach = reach + SLACK * (1 + np.abs(near) + reach)
        self.low, self.high = near - reach, near + reach

    def exact(self, i: int, rows: np.ndarray) -> np.ndarray:
        return self.x[rows].astype(np.int64) @ self.a[i].astype(np.int64)


def kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest; below everything if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def best_of_label(met: Met, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor the first ``k`` other rows of its label: its place, their ids and scores."""
    for i, label in enumerate(met.own_labels):
        rows = np.flatnonzero((met.labels == label) & (met.ids != met.anchors[i]))
        if len(rows):
            rows = rows[met.high[i, rows] >= kth(met.low[i, rows], k)]
            score = met.exact(i, rows)
            top = np.lexsort((met.ids[rows], -score))[:k]
            yield i, met.ids[rows[top]], score[top]


def best_in_window(met: Met, i: int, lows: np.ndarray, highs: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window the first ``k`` rows of another label than anchor i's that score inside it."""
    rows = np.flatnonzero((met.labels != met.own_labels[i]) & (met.high[i] >= lows.min()) & (met.low[i] <= highs.max()))
    low, high, known = met.low[i, rows], met.high[i, rows], {}
    for w, (least, most) in enumerate(zip(lows, highs, strict=True)):
        sure = kth(low[(low >= least) & (high <= most)], k)  # so many are inside for certain, and score at least this
        own = np.flatnonzero((high >= max(least, sure)) & (low <= most))
        key = own.tobytes()
        if key not in known:
            known = {key: met.exact(i, rows[own])}
        score = known[key]
        fit = np.flatnonzero((score >= least) & (score <= most))
        top = fit[np.lexsort((met.ids[rows[own[fit]]], -score[fit]))[:k]]
        if len(top):
            yield w, met.ids[rows[own[top]]], score[top]


def windows_of(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From 80 to 100 hundredths of each score, both included, in whole numbers; empty for scores under 0."""
    return -((-80 * scores) // 100), scores


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, block: int = BLOCK, limit: int = grid.BROADCAST_BYTES) -> DataFrame:
    """Positives and hard negatives of ``anchors`` among ``rows``, both (id long, label long, v array of whole doubles).

    An anchor's positives are the first rows of its label by score, then id; for each, the first rows of another label with
    ``80 * positive <= 100 * negative <= 100 * positive`` come out: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. Two passes of the anchors' blocks over the chunks, each ended by a window over a few
    rows a chunk.
    """
    chunks, books = index(rows)

    def held(x: np.ndarray, id: np.ndarray, label: np.ndarray) -> dict[str, bytes]:
        return {"ids": id.astype(np.int64).tobytes(), "labels": label.astype(np.int64).tobytes(), "x": x.tobytes()}

    blocks = grid.pack(anchors.select("id", "label", "v"), block, held, ["ids", "labels", "x"])

    def same_label(chunk: dict, own: dict) -> Iterator[list]:
        met = Met(chunk, own, books)
        found = list(best_of_label(met, positives))
        if found:
            yield [np.repeat(met.anchors[[i for i, *_ in found]], [len(s) for *_, s in found]), np.concatenate([x for _, x, _ in found]), np.concatenate([s for *_, s in found])]

    near = grid.meet(chunks, blocks, same_label, "anchor_id long, positive_id long, positive_score long", limit)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = cut_lineage(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives))
    wanted = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("pairs"))
    # Anchors with fewer positives are filled up with their first one, which is answered once all the same.
    filled = [F.coalesce(F.get(F.col(f"pairs.{c}"), F.lit(k)), F.get(F.col(f"pairs.{c}"), F.lit(0))).alias(f"{c}{k}") for k in range(positives) for c in ("positive_id", "positive_score")]
    asked = anchors.join(wanted, F.col("id") == F.col("anchor_id")).select("id", "label", "v", *filled)

    def held_pairs(x: np.ndarray, id: np.ndarray, label: np.ndarray, **more: np.ndarray) -> dict[str, bytes]:
        own = held(x, id, label)
        return own | {c: np.stack([more[f"{c}{k}"] for k in range(positives)], 1).astype(np.int64).tobytes() for c in ("positive_id", "positive_score")}

    second = grid.pack(asked, block, held_pairs, ["ids", "labels", "x", "positive_id", "positive_score"])

    def in_windows(chunk: dict, own: dict) -> Iterator[list]:
        met, out = Met(chunk, own, books), []
        ids, scores = (grid.matrix(own[c], positives, np.int64) for c in ("positive_id", "positive_score"))
        for i in range(len(met.anchors)):
            once = np.unique(ids[i], return_index=True)[1]
            for w, negative, score in best_in_window(met, i, *windows_of(scores[i, once]), negatives):
                n, w = len(negative), once[w]
                out.append((np.full(n, met.anchors[i]), np.full(n, ids[i, w]), negative, np.full(n, scores[i, w]), score))
        if out:
            yield [np.concatenate(c) for c in zip(*out, strict=True)]

    found = grid.meet(chunks, second, in_windows, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", limit)
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """The label of each ``every``-th id moved on by one, round ``classes``."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label").cast("long") + 1) % classes).otherwise(F.col("label")))


def mine_every(rows: DataFrame, every: int = 100) -> DataFrame:
    """Hard negatives for the rows of ``rows(vec_id, embedding, label)`` whose id is divisible by ``every``.

    Rows without an id or label, and vectors that are null or hold a null, non-finite or very large component (from
    131,072 on, whose scores would not fit), take no part. Empty vectors and vectors of zeros score 0. Vectors of another
    size than the anchor's are not compared. Rows that share an id are candidates each for itself, but never of an anchor
    of that id, and an anchor whose id repeats is asked once, with its least label and vector; where a positive's id
    repeats its best score counts. An empty table gives no rows; other columns are ignored.
    """
    taken = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole(F.col("embedding")).alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    anchors = taken.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("one")).select("id", "one.*")
    return mine(taken, anchors)
