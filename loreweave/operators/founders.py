"""Greedy groups in a bounded block: sets of tokens are held against founders through an inverted index of these.

Nothing is estimated: how many tokens two sets share is counted over the postings of the smaller table's words, for some
of the sets at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Counts and postings that are held at once, about; sets that are held against each other directly.
HELD, FEW = 1 << 21, 256


class Index(NamedTuple):
    """Sets by place: the size of each, and for each word the places of those that hold it."""

    sizes: np.ndarray
    words: pa.Array
    starts: np.ndarray
    places: np.ndarray


def _lengths(sets: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)


def index(sets: pa.ListArray) -> Index:
    sizes, coded = _lengths(sets), sets.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    starts = np.append(0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary))))
    places = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[np.argsort(code, kind="stable")]
    return Index(sizes, coded.dictionary, starts, places)


def alike(held: Index, sets: pa.ListArray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(set, place) of those whose overlap coefficient reaches ``threshold``, in this order, some of the sets at a time."""
    count, sizes = len(held.sizes), _lengths(sets)
    if not count or not len(sets):
        return
    code = pc.fill_null(pc.index_in(sets.flatten(), value_set=held.words), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sets)), sizes)[code >= 0]
    code = code[code >= 0]
    posted = held.starts[code + 1] - held.starts[code]
    load = np.cumsum(np.bincount(row, posted, len(sets)) + count)
    start = 0
    while start < len(sets):
        end = max(start + 1, int(np.searchsorted(load, (load[start - 1] if start else 0) + HELD, "right")))
        a, b = np.searchsorted(row, (start, end))
        n = posted[a:b]
        at = np.arange(n.sum()) + np.repeat(held.starts[code[a:b]] - (np.cumsum(n) - n), n)
        shared = np.bincount(np.repeat((row[a:b] - start) * count, n) + held.places[at])
        met = np.flatnonzero(shared)
        x, y = met // count + start, met % count
        like = shared[met] / np.minimum(sizes[x], held.sizes[y]) >= threshold - 1e-12
        yield x[like], y[like]
        start = end


def first_alike(held: Index, sets: pa.ListArray, threshold: float) -> np.ndarray:
    """Of each set the first place that is like it, or -1."""
    out = np.full(len(sets), -1)
    for x, y in alike(held, sets, threshold):
        own, at = np.unique(x, return_index=True)
        out[own] = y[at]
    return out


def founders(sets: pa.ListArray, threshold: float) -> np.ndarray:
    """Of each set the founder that it joins: the first before it that is like it and joined none, or itself."""
    count = len(sets)
    out = np.arange(count)
    if count <= FEW:
        like, founds = np.zeros((count, count), bool), np.zeros(count, bool)
        for x, y in alike(index(sets), sets, threshold):
            like[x, y] = True
        for i in range(count):
            met = np.flatnonzero(like[i, :i] & founds[:i])
            founds[i] = not len(met)
            out[i] = met[0] if len(met) else i
        return out
    half = count // 2
    out[:half] = founders(sets[:half], threshold)
    first = np.flatnonzero(out[:half] == np.arange(half))
    met = first_alike(index(sets.take(pa.array(first))), sets[half:], threshold)
    out[half:] = first[met]
    left = half + np.flatnonzero(met < 0)
    out[left] = left[founders(sets.take(pa.array(left)), threshold)]
    return out


def _column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    column = table[name]
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _where(kept: pa.Array, sets: pa.ListArray) -> pa.ListArray:
    return pc.if_else(kept, sets, pa.scalar(None, sets.type)).cast(pa.list_(pa.string()))  # elements may be null, as the schema says


def founded(rows: pa.Table, threshold: float) -> pa.Table:
    """``rows`` of one key (id, key, tokens, ...) in order of id with their founder; only founders keep their tokens."""
    rows = rows.sort_by("id").combine_chunks()
    ids, sets = _column(rows, "id"), _column(rows, "tokens")
    own = ids.take(pa.array(founders(sets, threshold)))
    kept = _where(pc.equal(ids, own), sets)
    return rows.set_column(rows.schema.get_field_index("tokens"), "tokens", kept).append_column("founder", own)


def by_key(rows: pa.Table) -> dict[str | None, tuple[np.ndarray, Index]]:
    """Of each key the ids of its founders in order, and the index of their sets. ``rows``: id, key, tokens."""
    rows = rows.sort_by("id").combine_chunks()
    out = {}
    for key, own in _of_keys(rows):
        part = rows.take(pa.array(own))
        out[key] = (_column(part, "id").to_numpy(), index(_column(part, "tokens")))
    return out


def _of_keys(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray]]:
    """The keys of ``rows`` and where each stands, in order."""
    coded = _column(rows, "key").dictionary_encode("encode")
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
    yield from zip(coded.dictionary.to_pylist(), np.split(order, ends[:-1]), strict=True)


def joined(rows: pa.RecordBatch, held: dict[str | None, tuple[np.ndarray, Index]], threshold: float) -> pa.RecordBatch:
    """``rows`` (id, key, tokens, ...) with the first founder of their key in ``held`` that is like them; who has one loses
    its tokens."""
    sets, found = rows["tokens"], np.full(rows.num_rows, -1)
    for key, own in _of_keys(rows):
        if key in held and len(own):
            ids, known = held[key]
            met = first_alike(known, sets.take(pa.array(own)), threshold)
            found[own[met >= 0]] = ids[met[met >= 0]]
    kept = _where(pa.array(found < 0), sets)
    columns = {n: kept if n == "tokens" else rows[n] for n in rows.schema.names} | {"founder": pa.array(found, pa.int64(), mask=found < 0)}
    return pa.RecordBatch.from_pydict(columns)
