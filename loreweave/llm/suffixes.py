"""Operator 5, exact substring removal by suffix arrays.

Per shard: the stretches whose windows may repeat (see ``screen``) get a suffix array by Larsson-Sadakane refinement
(prefix doubling that re-sorts only groups still tied) and Kasai's common prefixes; suffixes that share 50 bytes are
one group, whose smallest document keeps the bytes. Across shards: the suffixes at shared anchors, in the order of the
shard's array and with the bytes before them that their windows can hold, go once per shard to the anchor's bin. The
bin merges the shards' sorted runs by binary search, takes common prefixes of neighbours, and does the same for the
bytes before the anchors, read backward. A window that begins j bytes before its anchor is then the same in two
documents exactly if the anchors' suffixes share 50 - j bytes and the bytes before them j. No hash decides anything.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from . import screen
from .common import cut_lineage, release
from .windows import NONE, REACH, WINDOW, Shard, shards, unpacked

LEFT = REACH - 1  # symbols before an anchor that its windows can hold
CONTEXT = LEFT + WINDOW
PAD = 255  # in no UTF-8 text


def _zip(*parts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts))


def _unzip(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """By position: the next eight bytes as a number (zeros beyond the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    pair = (padded[:-1].astype(np.uint16) << 8) | padded[1:]
    four = (pair[:-2].astype(np.uint32) << 16) | pair[2:]
    return ((four[:-4].astype(np.uint64) << np.uint64(32)) | four[4:])[: len(text)]


def suffix_array(text: np.ndarray, depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank of suffixes by their first ``depth`` bytes at least; equal ranks mean equal to that depth.

    Refinement stops there, as windows are shorter: a full suffix array only if no two suffixes share ``depth`` bytes.
    """
    n = len(text)
    key = eight_bytes(text)
    order = np.argsort(key)
    ranked = key[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    step = 8
    while step < depth:
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, n))
        tied = np.repeat(size > 1, size)
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        suffix = order[slots]
        after = suffix + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = (rank[suffix] << 32) | second
        turn = np.argsort(pair)
        order[slots] = suffix[turn]
        pair = pair[turn]
        head[slots[1:]] |= pair[1:] != pair[:-1]
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order[slots]] = group[slots]
        step *= 2
    return order, rank


def kasai(text: np.ndarray, order: np.ndarray, rank: np.ndarray, cap: int = WINDOW, stride: int = 64) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in suffix order (by order, up to ``cap``).

    Kasai's walk in text order, in many lanes at once: each lane carries its last length less one to the next suffix.
    Neighbours of equal rank agree to the depth of the array, which is ``cap`` at least; as their order is not settled
    beyond, nothing is carried from them.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    key = np.concatenate([eight_bytes(text), np.zeros(cap + 1, np.uint64)])
    found = np.zeros(n, np.int64)
    lanes = np.arange(0, n, stride)
    carried = np.zeros(len(lanes), np.int64)
    for k in range(stride):
        at = lanes + k
        live = at < n
        at, length = at[live], np.maximum(carried[live] - 1, 0)
        prior = before[at]
        length[prior < 0] = 0
        tied = (prior >= 0) & (rank[at] == rank[prior])
        length[tied] = cap
        going = np.flatnonzero((prior >= 0) & (length < cap))
        while len(going):  # eight bytes at a time
            i, j, m = at[going], prior[going], length[going]
            differ = key[i + m] ^ key[j + m]
            same = np.full(len(going), 8)
            some = np.flatnonzero(differ)
            same[some] = sum((differ[some] < np.uint64(1 << (64 - 8 * b))).astype(np.int64) for b in range(1, 8))
            length[going] = np.minimum(m + np.minimum(same, n - np.maximum(i, j) - m), cap)
            going = going[(same == 8) & (length[going] < cap) & (np.maximum(i, j) + m + 8 < n)]
        found[at] = length
        carried[live] = np.where(tied, 0, length)
    return found[order]


def repeats_within(shard: Shard, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By symbol: whether its window starts in a smaller document of the shard; and of the suffix array's text the
    symbols, their ranks, and the first place of each stretch.

    ``starts`` marks the candidate windows; only stretches that they cover enter the suffix array.
    """
    removed = np.zeros(len(shard.raw), bool)
    held = screen.covered(starts)
    none = np.zeros(0, np.int64)
    if not held.any():
        return removed, none, none, none
    # stretches of one document each, a separator behind each
    source = np.flatnonzero(held)
    ends = np.flatnonzero((np.diff(source, append=source[-1] + 2) > 1) | (np.diff(shard.doc[source], append=-1) != 0))
    closed = np.zeros(len(source) + 1, np.int64)
    closed[ends + 1] = 1
    place = np.arange(len(source)) + np.cumsum(closed)[:-1]
    text = np.full(len(source) + len(ends), PAD, np.uint8)
    text[place] = shard.raw[source]
    origin = np.full(len(text), -1, np.int64)
    origin[place] = source
    order, rank = suffix_array(text)
    common = kasai(text, order, rank)
    symbol = origin[order]
    valid = symbol >= 0
    valid[valid] = starts[symbol[valid]]
    # a window that crosses no separator has 50 bytes in common only with others of the kind
    group = np.cumsum(common < WINDOW) - 1
    group, symbol = group[valid], symbol[valid]
    ids = shard.ids[shard.doc[symbol]]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(group))))
    removed[symbol[ids > least]] = True
    return removed, source, rank[place], np.concatenate([[0], ends[:-1] + 1])


def contexts(shard: Shard, at: np.ndarray, source: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes around anchors, padded where their stretch ends; and the anchors' places in the suffix array's text."""
    place = np.searchsorted(source, at)
    own = np.searchsorted(stretch, place, side="right") - 1
    low, high = source[stretch[own]], source[np.append(stretch[1:], len(source))[own] - 1]
    out = np.empty((len(at), CONTEXT), np.uint8)
    for k in range(CONTEXT):
        spot = at + (k - LEFT)
        inside = (spot >= low) & (spot <= high)
        out[:, k] = np.where(inside, shard.raw[np.where(inside, spot, 0)], PAD)
    return out, place


def distinct_rows(rows: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each kind, kind of each row), kinds in order of their suffixes' rank."""
    before = np.ascontiguousarray(rows[:, :LEFT]).view(f"S{LEFT}").ravel()
    after = np.ascontiguousarray(rows[:, LEFT:]).view(f"S{WINDOW}").ravel()
    order = np.lexsort((before, after, rank))
    # equal suffixes have equal ranks, unless they differ behind the bytes that count
    new = np.concatenate([[True], (rows[order][1:] != rows[order][:-1]).any(axis=1)])
    kind = np.empty(len(rows), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def offer(shard: Shard, bins: int, replies: dict[int, bytes]) -> tuple[list[tuple[int, bytes]], bytes]:
    """For each bin the shard's distinct contexts in suffix order, with their least documents; and what the shard keeps."""
    at, grams, low, high = screen.shared_anchors(shard, bins, replies, own=True)
    some = low <= high  # the first least gram of some window
    at, grams, low, high = at[some], grams[some], low[some].astype(np.int64), high[some].astype(np.int64)
    starts = screen.candidates(shard, at, low, high)
    removed, source, rank, stretch = repeats_within(shard, starts)
    held = np.zeros(len(shard.raw), bool)
    held[source] = True
    met = held[at]  # the others' windows reach over their document's end
    at, grams, low, high = at[met], grams[met], low[met], high[met]
    if not len(at):
        return [], b""
    rows, place = contexts(shard, at, source, stretch)
    first, kind = distinct_rows(rows, rank[place])
    least = np.full(len(first), NONE)
    np.minimum.at(least, kind, shard.ids[shard.doc[at]])
    where = screen.bin_of(grams[first], bins)
    order = np.argsort(where, kind="stable")  # suffix order inside a bin
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    first, least = first[order], least[order]
    parts = screen.parts_of(where[order])
    sent = [(k, _zip(least[a:b], low[first[a:b]].astype(np.uint8), high[first[a:b]].astype(np.uint8), rows[first[a:b]])) for k, a, b in parts]
    own = _zip(np.array([len(at), len(order), len(parts)], np.int64), np.diff(at, prepend=0).astype(np.int32), new[kind].astype(np.int32), np.array(parts, np.int64).ravel(), np.packbits(removed))
    return sent, own


def read_offer(blob: bytes) -> tuple[np.ndarray, ...]:
    """Smallest documents, least and largest offsets, contexts."""
    raw = _unzip(blob)
    n = len(raw) // (10 + CONTEXT)
    return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, np.uint8, n, 9 * n), np.frombuffer(raw, np.uint8, n * CONTEXT, 10 * n).reshape(n, CONTEXT)


def merged(key: np.ndarray, runs: list[np.ndarray]) -> np.ndarray:
    """The order of all rows from sorted runs of them (as row numbers): two by two, each by binary search in the other."""
    while len(runs) > 1:
        runs.sort(key=len)
        pairs = list(zip(runs[::2], runs[1::2], strict=False))
        rest = runs[-1:] if len(runs) % 2 else []
        for i, (x, y) in enumerate(pairs):
            out = np.empty(len(x) + len(y), np.int64)
            spot = np.searchsorted(key[y], key[x], side="right") + np.arange(len(x))
            free = np.ones(len(out), bool)
            free[spot] = False
            out[spot], out[free] = x, y
            pairs[i] = out
        runs = pairs + rest
    return runs[0] if runs else np.zeros(0, np.int64)


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def settle(blobs: list[bytes]) -> list[np.ndarray]:
    """For each run of contexts: a bit for each offset whose window starts in a document smaller than the context's."""
    offers = [read_offer(blob) for blob in blobs]
    cuts = np.cumsum([0, *(len(x[0]) for x in offers)])
    ids, low, high, text = (np.concatenate(x) for x in zip(*offers, strict=True))
    del offers
    answers = np.zeros(len(ids), np.uint32)
    after = np.ascontiguousarray(text[:, LEFT:])
    key = after.view(f"S{WINDOW}").ravel()
    order = merged(key, [np.arange(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
    common = common_prefixes(after[order])
    # a window holds 24 bytes from its anchor on at least: only rows that share as many, from two documents, can meet
    first = np.flatnonzero(common < WINDOW - LEFT)
    two = np.minimum.reduceat(ids[order], first) < np.maximum.reduceat(ids[order], first)
    some = np.repeat(two, np.diff(np.append(first, len(order))))
    order, common = order[some], common[some]
    if len(order):
        ids, low, high, text = ids[order], low[order], high[order], text[order]
        before = np.ascontiguousarray(text[:, LEFT - 1 :: -1])
        back = np.argsort(before.view(f"S{LEFT}").ravel(), kind="stable")
        common_before = common_prefixes(before[back])
        group_before = np.empty(len(order), np.int64)
        for j in range(REACH):
            whole = np.flatnonzero((low <= j) & (j <= high) & (text[:, LEFT - j] != PAD) & (text[:, LEFT - j + WINDOW - 1] != PAD))
            if not len(whole):
                continue
            group_before[back] = np.cumsum(common_before < j)
            group = np.cumsum(common < WINDOW - j) * (len(order) + 1) + group_before
            own, doc = group[whole], ids[whole]
            turn = np.argsort(own, kind="stable")
            ranked = own[turn]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            smallest = np.repeat(np.minimum.reduceat(doc[turn], first), np.diff(np.append(first, len(turn))))
            gives = turn[smallest < doc[turn]]
            answers[order[whole[gives]]] |= np.uint32(1 << j)
    return [answers[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def conclude(shard: Shard, own: bytes, bits: dict[int, np.ndarray]) -> np.ndarray:
    """By byte: whether it goes."""
    starts = np.zeros(len(shard.raw), bool)
    if own:
        raw = _unzip(own)
        n, m, p = np.frombuffer(raw, np.int64, 3).tolist()
        at = np.cumsum(np.frombuffer(raw, np.int32, n, 24).astype(np.int64))
        kind = np.frombuffer(raw, np.int32, n, 24 + 4 * n)
        parts = np.frombuffer(raw, np.int64, 3 * p, 24 + 8 * n).reshape(-1, 3)
        starts |= np.unpackbits(np.frombuffer(raw, np.uint8, -1, 24 + 8 * n + 24 * p), count=len(starts)).astype(bool)
        mask = np.zeros(m, np.uint32)
        for k, a, b in parts.tolist():
            mask[a:b] = bits[k]
        of = mask[kind]
        for j in range(REACH):
            starts[at[(of >> np.uint32(j)) & 1 == 1] - j] = True
    return screen.covered(starts)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def remove(docs: DataFrame, shard_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans of every document.

    A null text is empty. A null doc_id counts as larger than all others; rows with one doc_id don't remove each
    other's bytes. Repeated rows stay; an empty table gives no rows; other columns are ignored. The result is written
    to the checkpoint folder, so that the working table of shards can go at once.
    """
    with screen.stored(shards(docs, words=False, size=shard_bytes)) as table:
        bins = screen.bins_for(table)
        replies = screen.answer(screen.ask(table, bins, words=False), bins)

        def offers(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame({"route": [], "shard": [], "blob": []})
            sent, own = offer(unpacked(left["blob"].iloc[0], False), bins, dict(zip(right["bin"], right["shared"], strict=True)))
            release()
            number = left["shard"].iloc[0]
            # what a shard keeps goes along, by a route of its own
            return pd.DataFrame({"route": [*(k for k, _ in sent), -1 - number], "shard": number, "blob": [*(b for _, b in sent), own]})

        def settles(frame: pd.DataFrame) -> pd.DataFrame:
            route = int(frame["route"].iloc[0])
            if route < 0:
                return frame
            blobs = frame.pop("blob").tolist()
            frame["blob"] = [_zip(x) for x in settle(blobs)]
            release()
            return frame

        def concludes(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
            shard = unpacked(left["blob"].iloc[0], False)
            blobs = dict(zip(right["route"], right["blob"], strict=True))
            own = next((b for r, b in blobs.items() if r < 0), b"")
            gone = conclude(shard, own, {r: np.frombuffer(_unzip(b), np.uint32) for r, b in blobs.items() if r >= 0})
            return results(shard, gone)

        offered = table.select("shard", "blob").groupBy("shard").cogroup(replies.groupBy("shard")).applyInPandas(offers, "route long, shard long, blob binary")
        settled = screen.deal(offered, "route", 2 * bins).groupBy("route").applyInPandas(settles, "route long, shard long, blob binary")
        done = table.select("shard", "blob").groupBy("shard").cogroup(settled.groupBy("shard")).applyInPandas(concludes, OUT)
        return cut_lineage(done)


def results(shard: Shard, gone: np.ndarray) -> pd.DataFrame:
    rows = []
    for k, doc_id in enumerate(shard.ids.tolist()):
        a, b = int(shard.offsets[k]), int(shard.offsets[k + 1])
        own, body = gone[a:b], shard.raw[a:b]
        edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        kept = body[~own] if len(edge) else body
        spans = [{"start": s, "end": e} for s, e in edge.tolist()]
        rows.append((None if doc_id == NONE else doc_id, b - a, int(own.sum()), len(edge), hashlib.sha256(kept.tobytes()).hexdigest(), spans))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    return out.assign(doc_id=out["doc_id"].astype("Int64"))

