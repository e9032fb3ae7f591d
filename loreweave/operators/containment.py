"""Which texts hold which strings: an automaton over all strings at once, in one pass over each text.

Strings that are too many for one automaton are looked for by their hashes. Texts stay where they are: a task hashes
all windows of the strings' lengths and holds them against bitmaps of the strings' starts and of whole strings; what both
let through goes, as text, to the strings themselves, and only equal ones count. So nothing is lost to a hash and what
moves is what was found, not texts times strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of strings that go into one automaton (some 40 bytes each in a task).
STRINGS = 2 << 20
#: Bits of the bitmaps of strings' hashes, a power of two; bytes at the start of a string that have a bitmap of their own.
BITS, START = 1 << 26, 4
#: Bytes of texts that are hashed at once.
HASHED = 1 << 20
#: Characters that are given on at once.
OUT = 32 << 20


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64)))) if n > 1 else np.ones(1, np.uint64)


class Windows:
    """The hashes of a byte string's windows, modulo 2**64, from one sum over it."""

    def __init__(self, data: np.ndarray) -> None:
        n = 1 << max(10, len(data).bit_length())
        self.back = _powers(_BACK, n)[: len(data)]
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[: len(data)])))

    def bits(self, at: np.ndarray | None, size: int, bits: int) -> np.ndarray:
        """Of the windows of ``size`` bytes that start ``at`` (everywhere), their place in a bitmap of ``bits``."""
        if at is None:
            mixed = (self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size]
        else:
            mixed = (self.sums[at + size] - self.sums[at]) * self.back[at]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _signed(names: DataFrame, bits: int) -> tuple[dict[int, np.ndarray], list[int]]:
    """({0: bits of whole strings, n: bits of the first n bytes}, the lengths of the strings), from ``name`` of ``names``.

    What comes to the driver is a bounded bitmap, in pieces of 4 KB, and the distinct lengths.
    """

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in range(0, len(frame), 4096):
                raw = [n.encode() for n in frame["name"].iloc[part : part + 4096]]
                size = np.array([len(r) for r in raw], np.int64)
                at = np.cumsum(size) - size
                windows = Windows(np.frombuffer(b"".join(raw), np.uint8))
                for kind, length in ((0, size), (1, np.minimum(size, START))):
                    for own in np.unique(length):
                        here = length == own
                        of = np.zeros(here.sum(), np.int64) if kind == 0 else np.full(here.sum(), own)
                        yield pd.DataFrame({"kind": of, "size": size[here], "bit": windows.bits(at[here], int(own), bits)})

    rows = names.mapInPandas(hashed, "kind long, size long, bit long")
    place = F.col("bit") + 1  # the built-in bitmaps count from 1
    found = rows.groupBy("kind", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"), F.collect_set("size").alias("sizes")).toLocalIterator()
    maps: dict[int, np.ndarray] = {}
    sizes: set[int] = set()
    for r in found:
        own = maps.setdefault(r["kind"], np.zeros(bits // 8 + 4096, np.uint8))
        start = (r["bucket"] - 1) * 4096
        own[start : start + 4096] = np.frombuffer(r["bits"], np.uint8)
        sizes |= set(r["sizes"])
    return maps, sorted(sizes)


def candidates(texts: list[str | None], maps: dict[int, np.ndarray], sizes: list[int], bits: int) -> tuple[np.ndarray, list[str]]:
    """(places in ``texts``, strings): what may be one of the strings that ``maps`` were made of, each once a text."""
    raw = [(t or "").encode() for t in texts]
    length = np.array([len(r) for r in raw], np.int64)
    end = np.cumsum(length)
    whole = b"".join(raw)
    if not whole:
        return np.zeros(0, np.int64), []
    windows = Windows(np.frombuffer(whole, np.uint8))
    held = lambda m, b: (m[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
    begun = {n: np.flatnonzero(held(m, windows.bits(None, n, bits))) for n, m in maps.items() if 0 < n <= len(whole)}
    found: set[tuple[int, str]] = set()
    for size in sizes:
        at = begun.get(min(size, START), np.zeros(0, np.int64))
        at = at[at + size <= len(whole)]
        at = at[held(maps[0], windows.bits(at, size, bits))]
        text = np.searchsorted(end, at, side="right")
        inside = at + size <= end[text]
        found |= {(int(i), bytes(whole[a : a + size])) for i, a in zip(text[inside], at[inside].tolist(), strict=True)}
    listed = sorted(found)
    # a window that begins or ends inside a character is none of the strings
    pairs = [(i, b.decode("utf-8", "replace")) for i, b in listed]
    return np.array([i for i, _ in pairs], np.int64), [t for _, t in pairs]


class Finder:
    """All strings of a set that a text holds, in time linear in the text, however many strings there are."""

    def __init__(self, strings: list[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for s in strings:
            self.automaton.add_word(s, s)
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def held(self, text: str | None) -> list[str]:
        return sorted({s for _, s in self.automaton.iter(text)}) if self.any and text else []


@lru_cache(maxsize=2)
def _finder(strings: tuple[str, ...]) -> Finder:
    """A worker's tasks share the automaton of a block of strings."""
    return Finder(list(strings))


def held_names(texts: DataFrame, names: DataFrame, text: str = "text", block: int = STRINGS, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``texts`` with each ``name`` of ``names`` that their text holds, once; empty names aren't looked for.

    Of the rows the columns ``keep`` come back (all), which spares texts that hold many names from being repeated.

    While the names' characters, which are counted, are ``block`` at most, they are broadcast. Beyond that texts are held
    against bitmaps of the names' hashes, and what these let through against the names. Texts stay where they are.
    """
    listed = names.select("name").where("name <> ''").distinct()
    size = listed.agg(F.sum(F.length("name"))).head()[0] or 0
    rows = texts.where(F.col(text).isNotNull())
    order = rows.columns if keep is None else keep
    rows = rows.select(*dict.fromkeys([*order, text]))
    schema = T.StructType([*[rows.schema[c] for c in order], T.StructField("name", T.StringType())])

    def matched(frame: pd.DataFrame, finder: Finder) -> Iterator[pd.DataFrame]:
        frame, start, found, size = frame.reset_index(drop=True), 0, [], 0
        for at, own in enumerate(frame[text]):
            found.append(finder.held(own))
            size += len(found[-1]) * (len(own) + 64 if text in order and own else 64)
            if size > OUT or at == len(frame) - 1:
                part = frame[order].iloc[start : at + 1]
                out = part.loc[part.index.repeat([len(f) for f in found])].reset_index(drop=True)
                yield out.assign(name=np.array([n for f in found for n in f], object))
                start, found, size = at + 1, [], 0

    if size <= block:
        held = rows.sparkSession.sparkContext.broadcast(tuple(sorted(r["name"] for r in listed.collect())))

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finder = _finder(held.value)
            for frame in frames:
                yield from matched(frame, finder)

        return rows.mapInPandas(near, schema)
    bits = min(BITS, max(1 << 18, 1 << (32 * listed.count()).bit_length()))
    maps, sizes = _signed(listed, bits)
    signs = rows.sparkSession.sparkContext.broadcast(maps)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            octets, start = 0, 0
            for at, own in enumerate(frame[text].tolist()):
                octets += len(own)
                if octets > HASHED or at == len(frame) - 1:
                    part = frame.iloc[start : at + 1]
                    place, strings = candidates(part[text].tolist(), signs.value, sizes, bits)
                    if order or strings:
                        out = part[order].iloc[place].reset_index(drop=True)
                        yield out.assign(name=np.array(strings, object)) if order else pd.DataFrame({"name": sorted(set(strings))})
                    octets, start = 0, at + 1

    met = rows.mapInPandas(near, schema)
    return met.join(listed.hint("merge"), "name", "left_semi").select(*order, "name")
