"""Operator 9, long repeated word spans by a compacted De Bruijn graph of token k-mers.

An edge is a 50-word k-mer (a window), a node the 49 words that two successive k-mers share. Shards send the k-mers
that may repeat (see ``screen``) to hash ranges, as runs of nodes: a node's home is the range of the least of its 26
hashed 24-word grams, so that successive nodes mostly share it, and every k-mer that meets a node is known in the node's
home. There k-mers of one document only are dropped; what is left is the graph of repeated k-mers. Homes contract it
along nodes with one way in and one way out; Spark joins compact the pieces, by pointer doubling, into nonbranching
paths, so that every repeated k-mer has a path and a place on it. A shard's maximal runs along a path, as long spans,
then go to the path's blocks with their words, where the words of all sources are held against each other, place by
place: a k-mer goes if the same 50 words stand at its place in a smaller document.

Hashes only decide who meets: equal k-mers always do, and unequal words at one place are told apart as words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import screen
from .common import cut_lineage, release
from .windows import GRAM, NONE, WINDOW, Shard, hashes, mix, shards, sliding, unpacked

NODE = WINDOW - 1
INSIDE = NODE - GRAM + 1  # grams in a node
BLOCK = 4096  # places of a path that are settled together
ROUNDS = 40
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _zip(*parts: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts))


def _unzip(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


class _Reader:
    """Arrays one after another from bytes."""

    def __init__(self, blob: bytes) -> None:
        self.raw, self.at = _unzip(blob), 0

    def take(self, dtype, count: int) -> np.ndarray:
        out = np.frombuffer(self.raw, dtype, count, self.at)
        self.at += out.nbytes
        return out

    def rest(self) -> bytes:
        return self.raw[self.at :]


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, laid end to end."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


# --- k-mers of a shard -------------------------------------------------------------------------------------------


class Runs:
    """The k-mers that may repeat, as stretches of successive ones; their nodes, as runs of one home.

    ``begin`` and ``size``: first k-mer (by its word) and number of k-mers of each stretch; a stretch has one node more.
    ``first`` and ``count``: nodes of each run; ``left`` and ``right``: whether the stretch goes on at either side.
    """

    def __init__(self, shard: Shard, starts: np.ndarray) -> None:
        edge = np.flatnonzero(np.diff(starts.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        self.begin, self.size = edge[:, 0], edge[:, 1] - edge[:, 0]
        self.node = self.home = np.zeros(0, np.uint64)
        self.first = self.count = np.zeros(0, np.int64)
        self.left = self.right = np.zeros(0, bool)
        if not len(edge):
            return
        grams, nodes = hashes(shard.symbols()[ranges(self.begin, self.size + NODE)])
        at = ranges(_starts(self.size + NODE), self.size + 1)
        self.node, self.home = nodes[at], sliding(grams, INSIDE, np.minimum)[at]
        opens = np.zeros(len(at), bool)
        opens[_starts(self.size + 1)] = True
        new = opens.copy()
        new[1:] |= self.home[1:] != self.home[:-1]
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, len(at)))
        self.left = ~opens[self.first]
        self.right = np.append(self.left[1:], False)


def offer_runs(shard: Shard, starts: np.ndarray, bins: int) -> tuple[list[tuple[int, bytes]], bytes]:
    """For each bin the shard's distinct runs of nodes with their least and largest document; and what the shard keeps."""
    runs = Runs(shard, starts)
    if not len(runs.first):
        return [], b""
    first, size = runs.first - runs.left, runs.count + runs.left + runs.right
    inside = ranges(first, size)
    told = runs.node[inside]
    head = _starts(size)
    weight = mix(told + (np.arange(len(inside)) - np.repeat(head, size)).astype(np.uint64) * _ODD)
    digest = np.add.reduceat(weight, head) + runs.left.astype(np.uint64) * _ODD + runs.right.astype(np.uint64)
    _, one, kind = np.unique(digest, return_index=True, return_inverse=True)
    if (size != size[one[kind]]).any() or (told != told[ranges(head[one[kind]], size)]).any():  # digests met by chance
        one = kind = np.arange(len(size))
    ids = shard.ids[shard.doc[ranges(runs.begin, runs.size + 1)[runs.first]]]
    least, most = np.full(len(one), NONE), np.full(len(one), np.iinfo(np.int64).min)
    np.minimum.at(least, kind, ids)
    np.maximum.at(most, kind, ids)
    where = screen.bin_of(mix(runs.home[runs.first[one]]), bins)
    order = np.argsort(where, kind="stable")
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    one = one[order]
    parts = screen.parts_of(where[order])
    sent = []
    for k, a, b in parts:
        some = one[a:b]
        flags = runs.left[some] + 2 * runs.right[some].astype(np.uint8)
        sent.append((k, _zip(np.array([b - a], np.int64), size[some], least[order[a:b]], most[order[a:b]], flags.astype(np.uint8), told[ranges(head[some], size[some])])))
    own = _zip(
        np.array([len(runs.begin), len(runs.first), len(parts)], np.int64), runs.begin, runs.size, runs.count, new[kind], runs.left, np.array(parts, np.int64).ravel(), (runs.count - ~runs.left)[one]
    )
    return sent, own


# --- the graph of a bin --------------------------------------------------------------------------------------------


def edge_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left) * _ODD + right)


def chains(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, place) of every edge by its predecessor (itself where it has none); edges of a ring are heads of their own."""
    n = len(up)
    place = (up != np.arange(n)).astype(np.int64)
    head = up.copy()
    for _ in range(max(1, n).bit_length() + 1):
        above = head[head]
        if np.array_equal(above, head):
            break
        place, head = place + place[head], above
    ring = up[head] != head
    return np.where(ring, np.arange(n), head), np.where(ring, 0, place)


def graph(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """What the runs of a bin make of the graph of repeated k-mers.

    Returns, for each shard, what each k-mer that ends in one of its runs' nodes is: repeated or not, head of its chain
    and place in it; the chains that may go on in another bin, as rows (head, tail, distance); and for each shard the
    heads that may be tails elsewhere.
    """
    parts = []
    for blob in blobs:
        r = _Reader(blob)
        n = int(r.take(np.int64, 1)[0])
        size, least, most, flags = r.take(np.int64, n), r.take(np.int64, n), r.take(np.int64, n), r.take(np.uint8, n)
        parts.append((size, least, most, flags, r.take(np.uint64, int(size.sum()))))
    size, least, most, flags, node = (np.concatenate(x) for x in zip(*parts, strict=True))
    counts = [len(p[0]) for p in parts]
    del parts
    left, right = (flags & 1).astype(bool), (flags & 2).astype(bool)
    edges = size - 1  # of each run
    at = ranges(_starts(size), edges)  # the node that each edge leaves
    run = np.repeat(np.arange(len(size)), edges)
    place = at - np.repeat(_starts(size), edges)
    a, b = node[at], node[at + 1]
    home_a = ~((place == 0) & left[run])
    home_b = ~((place == edges[run] - 1) & right[run])
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    if len(order):
        held = [f.reduceat(x[order], first) for f, x in ((np.minimum, least[run]), (np.maximum, most[run]), (np.maximum, home_a), (np.maximum, home_b))]
    else:
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool)] * 2
    kept = np.flatnonzero(held[0] < held[1])  # two documents have it
    of = np.full(len(first), -1)
    of[kept] = np.arange(len(kept))
    ea, eb = a[order][first][kept], b[order][first][kept]
    home_a, home_b = held[2][kept], held[3][kept]
    # nodes of the kept edges; those at home here know all edges that meet them
    nodes, ends = np.unique(np.concatenate([ea, eb]), return_inverse=True)
    na, nb = ends[: len(ea)], ends[len(ea) :]
    home = np.zeros(len(nodes), bool)
    home[na[home_a]] = True
    home[nb[home_b]] = True
    simple = home & (np.bincount(na, minlength=len(nodes)) == 1) & (np.bincount(nb, minlength=len(nodes)) == 1)
    into = np.zeros(len(nodes), np.int64)
    into[nb] = np.arange(len(eb))
    head, step = chains(np.where(simple[na], into[na], np.arange(len(ea))))
    names = edge_ids(ea, eb).view(np.int64)
    tail = ~home[nb] & (head != np.arange(len(ea)))
    links = np.column_stack([names[head[tail]], names[tail], step[tail]])
    open_head = ~home[na[head]]
    # answers, for edges that end in a node of the run itself
    own = ~((place == edges[run] - 1) & right[run])
    edge = of[number[own]]
    owner = run[own]
    cuts = np.searchsorted(owner, np.cumsum([0, *counts]))
    answers, heads = [], []
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        some = edge[x:y]
        good = some >= 0
        some = some[good]
        answers.append(_zip(np.array([y - x, len(some)], np.int64), np.packbits(good), names[head[some]], (step[some] - np.arange(len(some))).astype(np.int64)))
        heads.append(np.unique(names[head[some[open_head[some]]]]))
    return answers, links, heads


def compact(links: DataFrame) -> DataFrame:
    """(node, path, offset) for the heads of chains that go on from another chain; others are paths of their own.

    ``links`` has columns a, b and gap: the chain from a ends in b, ``gap`` edges on, where another may begin. A tail
    ends one chain only. Doubling ends when every pointer has met its path's head; what is on a closed ring never does
    and stays a path of its own. Each round is written to the checkpoint folder.
    """
    now = cut_lineage(links.groupBy(F.col("b").alias("node")).agg(F.min(F.struct(F.col("a").alias("up"), F.col("gap").cast("long").alias("dist"))).alias("l")).select("node", "l.up", "l.dist"))
    size, rounds = now.count(), 0
    while rounds < ROUNDS and (1 << rounds) <= max(1, size):
        above = now.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("dist").alias("more"))
        then = cut_lineage(
            now.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("top").isNotNull().alias("moved"))
        )
        now, rounds = then.drop("moved"), rounds + 1
        if then.where("moved").isEmpty():
            break
    heads = now.select(F.col("node").alias("up"))
    return now.join(heads, "up", "left_anti").select("node", F.col("up").alias("path"), F.col("dist").alias("offset"))


# --- spans along paths ---------------------------------------------------------------------------------------------


class Known:
    """What a shard kept of its runs, and what the bins said of their k-mers."""

    def __init__(self, own: bytes, replies: dict[int, bytes]) -> None:
        r = _Reader(own)
        n, m, p = r.take(np.int64, 3).tolist()
        self.begin, self.size = r.take(np.int64, n), r.take(np.int64, n)
        count, kind, left = r.take(np.int64, m), r.take(np.int64, m), r.take(bool, m)
        parts = r.take(np.int64, 3 * p).reshape(-1, 3)
        answered = np.frombuffer(r.rest(), np.int64)  # edges that each distinct run gets answers for
        start = _starts(answered)
        good, head, place = np.zeros(int(answered.sum()), bool), np.zeros(int(answered.sum()), np.int64), np.zeros(int(answered.sum()), np.int64)
        for k, a, b in parts.tolist():
            x = _Reader(replies[k])
            total, some = x.take(np.int64, 2).tolist()
            bits = np.unpackbits(x.take(np.uint8, (total + 7) // 8), count=total).astype(bool)
            at = start[a] + np.flatnonzero(bits)
            good[at] = True
            head[at] = x.take(np.int64, some)
            place[at] = x.take(np.int64, some) + np.arange(some)
        every = ranges(start[kind], count - ~left)  # the edges of all runs, in order: those of the stretches
        self.good, self.head, self.place = good[every], head[every], place[every]
        self.word = ranges(self.begin, self.size)


def pieces(shard: Shard, known: Known, nodes: np.ndarray, paths: np.ndarray, offsets: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """Spans of successive repeated k-mers along one path inside one block of it: word, size, path, place and document.

    ``nodes`` is sorted; ``paths`` and ``offsets`` belong to it. Heads that it lacks are paths of their own.
    """
    word, path, place = known.word[known.good], known.head[known.good].copy(), known.place[known.good].copy()
    if len(nodes) and len(path):
        at = np.minimum(np.searchsorted(nodes, path), len(nodes) - 1)
        met = nodes[at] == path
        path[met] = paths[at[met]]
        place[met] += offsets[at[met]]
    doc = shard.ids[shard.doc[word]]
    if not len(word):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    same = (word[1:] == word[:-1] + 1) & (path[1:] == path[:-1]) & (place[1:] == place[:-1] + 1) & (place[1:] % block != 0) & (shard.doc[word[1:]] == shard.doc[word[:-1]])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return word[first], np.diff(np.append(first, len(word))), path[first], place[first], doc[first]


def plain_words(shard: Shard) -> tuple[bytes, np.ndarray]:
    """The shard's words, one blank behind each, and where each begins."""
    inside = np.zeros(len(shard.raw) + 2, np.int8)
    inside[shard.starts] += 1
    inside[shard.stops + 1] -= 1  # every word has a blank behind it, which stays
    keep = np.cumsum(inside[:-2], dtype=np.int8) > 0
    text = shard.raw[keep].copy()
    begin = _starts(shard.stops - shard.starts + 1)
    text[begin + shard.stops - shard.starts] = 32
    return text.tobytes(), begin


def offer_spans(shard: Shard, known: Known, nodes: np.ndarray, paths: np.ndarray, offsets: np.ndarray, bins: int, block: int = BLOCK) -> tuple[list[tuple[int, bytes]], bytes]:
    """For each bin the shard's distinct spans, with their words and least documents; and what the shard keeps."""
    word, size, path, place, doc = pieces(shard, known, nodes, paths, offsets, block)
    if not len(word):
        return [], b""
    text, begin = plain_words(shard)
    begin = np.append(begin, len(text))
    low, high = begin[word], begin[word + size + NODE]  # the blank behind the last word stays
    seen: dict[tuple, int] = {}
    kind = np.array([seen.setdefault((p, c, text[a:b]), len(seen)) for p, c, a, b in zip(path.tolist(), place.tolist(), low.tolist(), high.tolist(), strict=True)])
    _, one = np.unique(kind, return_index=True)
    least = np.full(len(one), NONE)
    np.minimum.at(least, kind, doc)
    spot = mix(path[one].view(np.uint64) + (place[one] // block).astype(np.uint64) * _ODD)
    where = screen.bin_of(spot, bins)
    order = np.argsort(where, kind="stable")
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    one, least = one[order], least[order]
    parts = screen.parts_of(where[order])
    sent = [
        (k, _zip(np.array([b - a], np.int64), path[one[a:b]], place[one[a:b]], size[one[a:b]], least[a:b], b"".join(text[x:y] for x, y in zip(low[one[a:b]].tolist(), high[one[a:b]].tolist(), strict=True))))
        for k, a, b in parts
    ]
    own = _zip(np.array([len(word), len(one), len(parts)], np.int64), word, size, new[kind], doc, least, size[one], np.array(parts, np.int64).ravel())
    return sent, own


def settle(blobs: list[bytes]) -> list[bytes]:
    """For each shard's spans: by k-mer, whether the same words stand at its place in a document smaller than the span's.

    Words get numbers as they are, by a dictionary of the bin's words. Where all words at each place of a path are the
    same, equal places mean equal k-mers; on other paths the k-mers themselves, as rows of 50 words, are told apart.
    """
    parts = []
    for blob in blobs:
        r = _Reader(blob)
        n = int(r.take(np.int64, 1)[0])
        parts.append((*[r.take(np.int64, n) for _ in range(4)], r.rest()))
    path, place, size, least = (np.concatenate([p[k] for p in parts]) for k in range(4))
    counts = [int(p[2].sum()) for p in parts]
    texts = pa.array([p[4][:-1] for p in parts], pa.large_binary())
    word = pc.split_pattern(texts, b" ").flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    del parts, texts
    _, lane = np.unique(path, return_inverse=True)
    # by word: its path and place
    width = size + NODE
    key = np.repeat(lane.astype(np.int64) << 40, width) + ranges(place, width)
    order = np.argsort(key, kind="stable")
    k, w = key[order], word[order]
    mixed = np.zeros(int(lane.max()) + 1, bool)
    mixed[(k[1:][(k[1:] == k[:-1]) & (w[1:] != w[:-1])] >> 40)] = True
    # by k-mer
    key = np.repeat(lane.astype(np.int64) << 40, size) + ranges(place, size)
    doc = np.repeat(least, size)
    at = ranges(_starts(width), size)  # its first word
    kmer = np.zeros(len(key), np.int64)
    for p in np.flatnonzero(mixed).tolist():
        some = np.flatnonzero(np.repeat(lane, size) == p)
        rows = word[at[some][:, None] + np.arange(WINDOW)]
        kmer[some] = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((kmer, key)) if mixed.any() else np.argsort(key, kind="stable")
    k, w, d = key[order], kmer[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])]))
    smaller = np.empty(len(order), bool)
    smaller[order] = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(order)))) < d
    cuts = np.cumsum([0, *counts])
    return [_zip(np.packbits(smaller[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def conclude(shard: Shard, own: bytes, replies: dict[int, bytes]) -> np.ndarray:
    """By word: whether it goes.

    A k-mer goes if a bin knows a smaller document with it, or if the shard itself has its whole span in one.
    """
    starts = np.zeros(shard.count, bool)
    if own:
        r = _Reader(own)
        n, m, p = r.take(np.int64, 3).tolist()
        word, size, kind, doc = (r.take(np.int64, n) for _ in range(4))
        least, sizes = r.take(np.int64, m), r.take(np.int64, m)
        begin = _starts(sizes)
        ends = np.append(begin, int(sizes.sum()))
        bits = np.zeros(int(sizes.sum()), bool)
        for k, a, b in r.take(np.int64, 3 * p).reshape(-1, 3).tolist():
            bits[ends[a] : ends[b]] = np.unpackbits(np.frombuffer(_unzip(replies[k]), np.uint8), count=int(ends[b] - ends[a]))
        gone = bits[ranges(begin[kind], size)] | np.repeat(doc > least[kind], size)
        starts[ranges(word, size)[gone]] = True
    return screen.covered(starts)


def results(shard: Shard, gone: np.ndarray) -> pd.DataFrame:
    rows, raw = [], shard.raw.tobytes()
    for k, doc_id in enumerate(shard.ids.tolist()):
        a, b = int(shard.first[k]), int(shard.first[k + 1])
        own = gone[a:b]
        words = [raw[x:y] for x, y in zip(shard.starts[a:b][~own].tolist(), shard.stops[a:b][~own].tolist(), strict=True)]
        edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        spans = [{"start": s, "end": e} for s, e in edge.tolist()]
        rows.append((None if doc_id == NONE else doc_id, b - a, int(own.sum()), hashlib.sha256(b" ".join(words)).hexdigest(), spans))
    out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])
    return out.assign(doc_id=out["doc_id"].astype("Int64"))


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"
SENT = "route long, shard long, blob binary"


def _sent(number: int, sent: list[tuple[int, bytes]], own: bytes) -> pd.DataFrame:
    """Messages to bins, and what the shard keeps, by a route of its own."""
    return pd.DataFrame({"route": [*(k for k, _ in sent), -1 - number], "shard": number, "blob": [*(b for _, b in sent), own]})


def remove(docs: DataFrame, shard_bytes: int = 4 << 20, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word spans of every document.

    A null text has no words; words of any length count as they are. A null doc_id counts as larger than all others;
    rows with one doc_id don't remove each other's words. Repeated rows stay; an empty table gives no rows; other
    columns are ignored. The result is written to the checkpoint folder, so that the working table of shards can go.
    """
    with screen.stored(shards(docs, words=True, size=shard_bytes)) as table:
        bins = screen.bins_for(table)
        replies = screen.answer(screen.ask(table, bins, words=True), bins)

        def runs(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame({"route": [], "shard": [], "blob": []})
            shard = unpacked(left["blob"].iloc[0], True)
            at, _, low, high = screen.shared_anchors(shard, bins, dict(zip(right["bin"], right["shared"], strict=True)), own=True)
            starts = screen.candidates(shard, at, low.astype(np.int64), high.astype(np.int64))
            return _sent(int(left["shard"].iloc[0]), *offer_runs(shard, starts, bins))

        def graphs(frame: pd.DataFrame) -> pd.DataFrame:
            route = int(frame["route"].iloc[0])
            frame = frame.assign(a=pd.array([None] * len(frame), "Int64"), b=pd.array([None] * len(frame), "Int64"), gap=pd.array([None] * len(frame), "Int64"))
            if route < 0:
                return frame
            numbers, blobs = frame["shard"].tolist(), frame.pop("blob").tolist()
            answers, links, heads = graph(blobs)
            release()
            frame["blob"] = answers
            total = sum(map(len, heads))
            held = pd.DataFrame({"route": route, "shard": np.repeat(np.array(numbers, np.int64), [len(h) for h in heads]), "blob": None, "a": pd.array(np.concatenate(heads) if total else [], "Int64"), "b": pd.array([None] * total, "Int64"), "gap": pd.array([None] * total, "Int64")})
            joined = pd.DataFrame({"route": route, "shard": pd.array([None] * len(links), "Int64"), "blob": None, **{c: pd.array(links[:, k], "Int64") for k, c in enumerate(("a", "b", "gap"))}})
            return pd.concat([x.astype({"shard": "Int64"}) for x in (frame, held, joined) if len(x)])[["route", "shard", "blob", "a", "b", "gap"]]

        told = table.select("shard", "blob").groupBy("shard").cogroup(replies.groupBy("shard")).applyInPandas(runs, SENT)
        known = cut_lineage(screen.deal(told, "route", 2 * bins).groupBy("route").applyInPandas(graphs, "route long, shard long, blob binary, a long, b long, gap long"))
        paths = compact(known.where("b is not null").select("a", "b", "gap"))
        held = known.where("a is not null and b is null").select("shard", F.col("a").alias("node"))
        nodes = held.join(paths, "node").groupBy("shard").agg(F.collect_list(F.struct("node", "path", "offset")).alias("nodes"))
        none = F.lit(None).cast("array<struct<node:bigint,path:bigint,offset:bigint>>")
        said = known.where("blob is not null").select("shard", "route", "blob", none.alias("nodes"))
        said = said.unionByName(nodes.select("shard", F.lit(None).cast("long").alias("route"), F.lit(None).cast("binary").alias("blob"), "nodes"))

        def spans(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame({"route": [], "shard": [], "blob": []})
            blobs = {int(r): b for r, b in zip(right["route"], right["blob"], strict=True) if b is not None}
            own = next((b for r, b in blobs.items() if r < 0), b"")
            number = int(left["shard"].iloc[0])
            if not own:
                return _sent(number, [], b"")
            rows = [(x["node"], x["path"], x["offset"]) for listed in right["nodes"] if listed is not None for x in listed]
            rows = np.array(rows, np.int64).reshape(-1, 3)
            rows = rows[np.argsort(rows[:, 0])]
            return _sent(number, *offer_spans(unpacked(left["blob"].iloc[0], True), Known(own, blobs), rows[:, 0], rows[:, 1], rows[:, 2], bins, block))

        def settles(frame: pd.DataFrame) -> pd.DataFrame:
            if frame["route"].iloc[0] < 0:
                return frame
            blobs = frame.pop("blob").tolist()
            frame["blob"] = settle(blobs)
            release()
            return frame

        def concludes(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])
            shard = unpacked(left["blob"].iloc[0], True)
            blobs = dict(zip(right["route"], right["blob"], strict=True))
            own = next((b for r, b in blobs.items() if r < 0), b"")
            return results(shard, conclude(shard, own, {r: b for r, b in blobs.items() if r >= 0}))

        offered = table.select("shard", "blob").groupBy("shard").cogroup(said.groupBy("shard")).applyInPandas(spans, SENT)
        settled = screen.deal(offered, "route", 2 * bins).groupBy("route").applyInPandas(settles, SENT)
        done = table.select("shard", "blob").groupBy("shard").cogroup(settled.groupBy("shard")).applyInPandas(concludes, OUT)
        return cut_lineage(done)
