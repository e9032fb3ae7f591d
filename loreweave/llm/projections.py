"""Operator 11, approximate nearest neighbours: stable projections under a kd-tree, ended by a chi-square test.

Largest inner product becomes least distance by one more component: ``x`` is lifted to ``(x, sqrt(M^2 - |x|^2))`` with M
the greatest length in its chunk, a query to ``(q, 0)``; then ``|x' - q'|^2 = M^2 + |q|^2 - 2<q, x>``. Lifted vectors are
projected on a few Gaussian directions (2-stable: a projected squared distance is the true one times a chi-square draw),
and each chunk keeps a kd-tree over them. A query takes leaves in the order of their projected distance and verifies their
rows by the true measure, until a neighbour at its k-th best distance would, with probability ``certainty``, have been
projected nearer than the next leaf. So each of the k true neighbours is found with at least that probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .common import cut_lineage

#: Projected dimensions (an even number: the chi-square distribution then has a closed form).
DIRECTIONS = 8
#: The confidence of the stopping test. Recall is at least this in expectation.
CERTAINTY = 0.95
#: Rows in a chunk, queries in a block, rows in a leaf.
CHUNK, BLOCK, LEAF = 8192, 512, 32
#: Beyond this no square of a component is safe; such chunks are verified whole.
HUGE = 1e100


def chi_square(x: float, degrees: int = DIRECTIONS) -> float:
    """The distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(degrees // 2):
        term = term * half / i if i else 1.0
        total += term
    return 1 - math.exp(-half) * total


def quantile(certainty: float, degrees: int = DIRECTIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < certainty else (low, middle)
    return high


def directions(dims: int, count: int = DIRECTIONS) -> np.ndarray:
    """Gaussian directions of the lifted space; the same for all chunks of one vector size."""
    return np.random.default_rng([11, dims]).standard_normal((dims + 1, count))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, component after component, so that equal vectors score equally everywhere."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
            total += x * y
    return np.where(np.isnan(total), -np.inf, total)


def depth(rows: int, leaf: int = LEAF) -> int:
    return max(0, math.ceil(math.log2(max(1, rows) / leaf)))


def edges(rows: int, levels: int) -> np.ndarray:
    """Where the leaves start, and the end: each node is halved, so it follows from the number of rows."""
    at = np.array([0, rows])
    for _ in range(levels):
        at = np.sort(np.r_[at, (at[:-1] + at[1:]) // 2])
    return at


def build(x: np.ndarray, id: np.ndarray) -> dict[str, bytes]:
    """The kd-tree of a chunk: rows in the order of its leaves, projected rows and the boxes of all nodes."""
    n, dims = x.shape
    squares = (x * x).sum(1) if np.abs(x).max(initial=0) < HUGE else np.full(n, np.inf)
    reach = squares.max(initial=0)
    lifted = np.column_stack([x, np.sqrt(np.maximum(reach - squares, 0))]) if np.isfinite(reach) else np.zeros((n, dims + 1))
    near, order, levels = lifted @ directions(dims), np.arange(n), depth(n)
    boxes = np.zeros((2 ** (levels + 1) - 1, 2, DIRECTIONS))
    for level in range(levels + 1):
        at = edges(n, level)
        for k, (start, end) in enumerate(zip(at[:-1], at[1:], strict=True)):
            own = near[order[start:end]]
            low, high = own.min(0), own.max(0)
            boxes[2**level - 1 + k] = low, high
            if level < levels:
                cut = (start + end) // 2 - start
                order[start:end] = order[start:end][np.argpartition(own[:, np.argmax(high - low)], cut)]
    return {"ids": id[order].astype(np.int64).tobytes(), "x": x[order].tobytes(), "boxes": boxes.tobytes(), "reach": np.float64(reach).tobytes()}


def leaves_near(boxes: np.ndarray, levels: int, points: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Down the tree with all queries at once: (query, leaf, projected squared distance) within each query's limit."""
    who, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    for level in range(levels + 1):
        if level:
            who, node = np.repeat(who, 2), (2 * node[:, None] + [1, 2]).ravel()
        box = boxes[node]
        gap = np.maximum(np.maximum(box[:, 0] - points[who], points[who] - box[:, 1]), 0)
        far = (gap * gap).sum(1)
        keep = far <= limit[who]
        who, node, far = who[keep], node[keep], far[keep]
    return who, node - (2**levels - 1), far


def search(chunk: dict, block: dict, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a block's queries the ``k`` best rows of a chunk that may be among the best of all: (query's place, id, score).

    ``edge`` of the block is what the k-th best is known to score elsewhere. The last value is the number of rows verified.
    """
    dims, n = chunk["dims"], chunk["rows"]
    ids, x = grid.vector(chunk["ids"]), grid.matrix(chunk["x"], dims)
    asked, q, edge = grid.vector(block["ids"]), grid.matrix(block["x"], dims), grid.vector(block["edge"], np.float64).copy()
    reach, levels = float(grid.vector(chunk["reach"], np.float64)[0]), depth(n)
    boxes, starts = np.frombuffer(chunk["boxes"]).reshape(-1, 2, DIRECTIONS), edges(n, levels)
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (q * q).sum(1)
        slack = 1e-12 * np.sqrt(squares * reach)
        safe = np.isfinite(squares * reach)
    points = np.where(safe[:, None], np.nan_to_num(q, posinf=0, neginf=0) @ directions(dims)[:-1], 0) if np.isfinite(reach) else np.zeros((len(q), DIRECTIONS))

    def limits() -> np.ndarray:
        away = np.maximum(reach + squares - 2 * edge, 0)
        return np.where(safe & np.isfinite(away), stop * away * (1 + 1e-9), np.inf)

    limit = limits()
    who, leaf, far = leaves_near(boxes, levels, points, limit)
    order = np.lexsort((far, who))
    who, leaf, far = who[order], leaf[order], far[order]
    first = np.searchsorted(who, np.arange(len(q)))
    rank, verified = np.arange(len(who)) - first[who], 0
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    start, width = 0, 1
    while start <= rank.max(initial=-1):
        now = np.flatnonzero((rank >= start) & (rank < start + width) & (far <= limit[who]))
        start, width = start + width, min(2 * width, 16)
        pairs = []
        by = now[np.argsort(leaf[now], kind="stable")]
        for own in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1) if len(by) else ():
            a, b = starts[leaf[own[0]]], starts[leaf[own[0]] + 1]
            with np.errstate(over="ignore", invalid="ignore"):
                near = q[who[own]] @ x[a:b].T
            verified += near.size
            i, j = np.nonzero(~(near < (edge - slack)[who[own]][:, None]))
            pairs.append((who[own][i], a + j))
        if not pairs:
            continue
        g, row = (np.concatenate(c) for c in zip(*pairs, strict=True))
        other = ids[row] != asked[g]
        g, row = g[other], row[other]
        score = dots(q[g], x[row])
        keep = score >= edge[g]
        best = tuple(np.concatenate(c) for c in zip(best, (g[keep], ids[row[keep]], score[keep]), strict=True))
        top = grid.first_rows(best[0], best[2], best[1], k)
        best = tuple(c[top] for c in best)
        count = np.bincount(best[0], minlength=len(q))
        full = count >= k
        last = np.cumsum(count) - 1
        edge[full] = np.maximum(edge[full], best[2][last[full]])
        limit = limits()
    return *best, verified


def index(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunks of ``rows(id long, v)`` with their trees; every row is in one."""
    return grid.pack(rows, size, build, ["ids", "x", "boxes", "reach"])


def nearest(chunks: DataFrame, queries: DataFrame, k: int = 20, certainty: float = CERTAINTY, block: int = BLOCK, limit: int = grid.BROADCAST_BYTES) -> DataFrame:
    """The ``k`` nearest rows of ``index()`` to each of ``queries(id, v)``, without the query's own id: query_id, rank, vec_id, score.

    Each block first searches one chunk, which gives its queries an edge to beat; with it, all blocks search all chunks.
    What comes out is bounded by k rows for a query and chunk, and those under the edge stay away.
    """
    stop = quantile(certainty)

    def held(x: np.ndarray, id: np.ndarray) -> dict[str, bytes]:
        return {"ids": id.astype(np.int64).tobytes(), "x": x.tobytes(), "edge": np.full(len(x), -np.inf).tobytes()}

    blocks = grid.pack(queries, block, held, ["ids", "x", "edge"])

    def edges_of(own: dict, chunk: dict) -> Iterator[list]:
        who, _, score, _ = search(chunk, own, k, stop)
        edge, count = np.full(own["rows"], -np.inf), np.bincount(who, minlength=own["rows"])
        last = np.cumsum(count) - 1
        edge[count >= k] = score[last[count >= k]]
        yield [[own["dims"]], [own["part"]], [own["number"]], [own["rows"]], [own["ids"]], [own["x"]], [edge.tobytes()]]

    some = chunks.groupBy("dims").agg(F.max_by(F.struct("part", "number"), F.struct("rows", "part", "number")).alias("one")).select("dims", "one.*")
    seeds = chunks.join(F.broadcast(some), ["dims", "part", "number"])  # one chunk for each size of vectors
    fields = "dims int, part int, number int, rows int, ids binary, x binary, edge binary"
    dealt = blocks.join(F.broadcast(seeds.select("dims", *[F.col(c).alias(f"seed_{c}") for c in seeds.columns if c != "dims"])), "dims")
    seeded = cut_lineage(grid.each(dealt, "seed_", edges_of, fields))

    def answers(chunk: dict, own: dict) -> Iterator[list]:
        who, ids, score, _ = search(chunk, own, k, stop)
        yield [grid.vector(own["ids"])[who], ids, score]

    found = grid.meet(chunks, seeded, answers, "query_id long, vec_id long, score double", limit)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Neighbours of the rows of ``rows(vec_id, embedding)`` whose id is divisible by ``every``, among all other rows.

    Rows without an id, and vectors that are null, zero, empty or hold null or non-finite components, take no part. Rows
    that share an id are candidates each for itself but never of a query of that id; a query whose id repeats is asked
    once, with the least of its vectors. Equal scores go by id, repeated vectors score equally. Vectors of another size
    than the query's are no candidates. Scores that overflow to no number rank last. An empty table gives no rows; other
    columns are ignored.
    """
    v = F.col("embedding").cast("array<double>")
    taken = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & grid.finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    asked = taken.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    return nearest(index(taken), asked, k)
