"""Vectors packed into chunks, stated query sets packed into blocks, and how the two meet.

A chunk or block is one row of a table: the numbers of its vectors as bytes, so that a task works on whole matrices.
Vectors of different sizes never share a chunk and are never compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut_lineage, map_rows

#: Blocks are broadcast up to this many bytes, which is measured; beyond it they are dealt to the chunks' parts.
BROADCAST_BYTES = 48 << 20


def finite(vector: Column) -> Column:
    """Whether a vector is there and each of its components is a finite number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def pack(rows: DataFrame, size: int, build: Callable[..., dict[str, bytes]], made: list[str]) -> DataFrame:
    """``rows(id long, v array<double>, further longs...)`` as chunks of up to ``size``: dims, part, number, rows, ``made``.

    ``build(x, id, ...)`` gets a matrix and the columns beside it and gives the columns ``made``, all bytes. Each task packs
    what it reads, without a shuffle. The result is written to the shared folder: chunks stay what they are when an
    executor is lost, and later passes read them.
    """
    order = rows.columns
    names = [c for c in order if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbers, held = TaskContext.get().partitionId(), 0, {}

        def flush(dims: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal numbers
            while sum(len(p[0]) for p in held[dims]) >= least:
                x, *more = (np.concatenate(c) for c in zip(*held[dims], strict=True))
                held[dims] = [tuple(c[size:] for c in (x, *more))] if len(x) > size else []
                own = build(x[:size], **{n: c[:size] for n, c in zip(names, more, strict=True)})
                numbers += 1
                values = [dims, part, numbers - 1, min(size, len(x)), *(own[m] for m in made)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32()] * 4 + [pa.binary()] * len(made), strict=True)], names=[f"c{k}" for k in range(len(values))])

        for batch in batches:
            columns = dict(zip(order, batch.columns, strict=True))
            lengths = pc.list_value_length(columns["v"])
            for dims in pc.unique(lengths).to_pylist():
                at = pc.equal(lengths, dims)
                x = columns["v"].filter(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                own = tuple(columns[n].filter(at).to_numpy(zero_copy_only=False) for n in names)
                held.setdefault(dims, []).append((x.reshape(len(own[0]), dims), *own))
                yield from flush(dims, size)
        for dims in list(held):
            yield from flush(dims, 1)

    fields = [T.StructField(n, T.IntegerType()) for n in ("dims", "part", "number", "rows")] + [T.StructField(m, T.BinaryType()) for m in made]
    plain = rows.select(*[F.col(n).cast("array<double>" if n == "v" else "long").alias(n) for n in order])
    return cut_lineage(map_rows(plain, run, fields))


def meet(chunks: DataFrame, blocks: DataFrame, run: Callable[[dict, dict], Iterator[list]], fields: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``run(chunk, block)`` for each chunk and block of one vector size; both are dicts of what ``pack`` made.

    Blocks are broadcast while their measured bytes are few. Beyond that each part of the chunks gets all blocks by a
    shuffle on the part's number, a block at a time.
    """
    made = blocks.columns[3:]
    size = blocks.agg(F.sum(sum((F.octet_length(b) for b in made[1:]), F.lit(0)).cast("long"))).head()[0] or 0
    named = blocks.select("dims", *[F.col(b).alias(f"block_{b}") for b in made])
    if size <= limit:
        both = chunks.join(F.broadcast(named), "dims")
    else:
        parts = chunks.agg(F.max("part")).head()[0] or 0
        both = chunks.join(named.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts)))), ["dims", "part"])
    return each(both, "block_", run, fields)


def each(rows: DataFrame, prefix: str, run: Callable[[dict, dict], Iterator[list]], fields: str) -> DataFrame:
    """``run(own, other)`` over rows that hold two packs of one vector size, the other's columns named with ``prefix``.

    It gives lists of columns (arrays, or lists of bytes) in the order of ``fields``.
    """
    order, schema = rows.columns, T.StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row = dict(zip(order, row.values(), strict=True))
                other = {n[len(prefix) :]: v for n, v in row.items() if n.startswith(prefix)} | {"dims": row["dims"]}
                for out in run(row, other):
                    yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(out, kinds, strict=True)], names=[f"c{k}" for k in range(len(out))])

    return map_rows(rows, over, schema.fields)


def matrix(data: bytes, columns: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, columns)


def vector(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(data, kind)


def first_rows(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, the highest score first and ties by id; group after group."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]
