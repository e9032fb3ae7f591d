"""Fixed-length windows over sequences of symbols: rolling hashes, minimizers, packed shards.

Operators 5 and 9 judge windows of 50 symbols (bytes, or words). Both first screen: every window holds a minimizer
(the least of its 27 hashed 24-symbol grams), which depends on the window's content alone. Only windows whose
minimizer also occurs in another document can repeat, so only those take part in the exact steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

WINDOW, GRAM = 50, 24
REACH = WINDOW - GRAM + 1  # grams in a window
NONE = np.iinfo(np.int64).max  # stands for a null doc_id: no document is larger
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _grown(h: np.ndarray, n: int, tail: np.ndarray, at: int) -> np.ndarray:
    """Hashes of at + n symbols from those of ``at`` symbols and, ``at`` further on, of n symbols."""
    size = len(tail) - at
    return h[:size] + tail[at:] * _power(at) if size > 0 else h[:0]


def hashes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes (mod 2^64, then mixed) of every 24-symbol gram and of every 49-symbol run."""
    h2 = _grown(symbols, 1, symbols, 1)
    h4 = _grown(h2, 2, h2, 2)
    h8 = _grown(h4, 4, h4, 4)
    h16 = _grown(h8, 8, h8, 8)
    h24 = _grown(h16, 8, h8, 16)
    h48 = _grown(h24, 24, h24, 24)
    return mix(h24), mix(_grown(h48, 1, symbols, 48))


def gram_hashes(symbols: np.ndarray) -> np.ndarray:
    h2 = _grown(symbols, 1, symbols, 1)
    h4 = _grown(h2, 2, h2, 2)
    h8 = _grown(h4, 4, h4, 4)
    return mix(_grown(_grown(h8, 8, h8, 8), 8, h8, 16))


def sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every n neighbours."""
    out, width = x, 1
    while width * 2 <= n:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[: len(x) - n + 1], out[n - width : len(x) - width + 1]) if width < n else out


def minimizers(grams: np.ndarray) -> np.ndarray:
    """Positions of grams that are the least of some 27 neighbours (ties all count)."""
    if len(grams) < REACH:
        return np.zeros(0, np.int64)
    least = sliding(grams, REACH, np.minimum)
    pad = np.zeros(REACH - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([pad, least, pad]), REACH, np.maximum) == grams)


def byte_symbols(raw: np.ndarray) -> np.ndarray:
    return _BYTES[raw]


# --- shards ----------------------------------------------------------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a number for each byte at its place in the word.

    The numbers don't follow from one another, so no pattern of bytes cancels out as it would in a polynomial.
    """
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), block):  # blocks stay in the processor's cache
        first, last = starts[a : a + block], stops[a : a + block]
        low, high = int(first[0]), int(last[-1])
        reach = np.diff(np.append(first, high))  # a word and the blanks behind it
        place = np.arange(high - low) - np.repeat(first - low, reach)
        value = mix((place.astype(np.uint64) << np.uint64(8) | raw[low:high]) * np.uint64(_BASE))
        value[_BLANK[raw[low:high]]] = 0
        out[a : a + block] = np.add.reduceat(value, first - low)
    return mix(out)


class Shard:
    """Whole texts laid end to end, with the symbols that windows are made of.

    ``ids``: doc_id by document (NONE if null); ``first``: symbol offsets of documents, with the end; ``doc``: by symbol.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, raw: bytes, words: bool) -> None:
        self.ids, self.sizes, self.raw = ids, sizes, np.frombuffer(raw, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.offsets = offsets
        if words:
            # every document is followed by a blank, so no word reaches over
            inside = ~_BLANK[self.raw]
            edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
            self.starts, self.stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            self.first = np.searchsorted(self.starts, offsets)
            self.words = word_hashes(self.raw, self.starts, self.stops)
        else:
            self.first, self.words = offsets, None
        self.count = int(self.first[-1])
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(self.first))

    def symbols(self, low: int = 0, high: int | None = None) -> np.ndarray:
        return byte_symbols(self.raw[low:high]) if self.words is None else self.words[low:high]

    def room(self, at: np.ndarray) -> np.ndarray:
        """How many symbols of its document are left from each position on."""
        return self.first[1:][self.doc[at]] - at

    def starts_window(self) -> np.ndarray:
        """By symbol: whether a whole window of its document starts there."""
        out = np.ones(self.count, bool)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            out[max(a, b - WINDOW + 1) : b] = False
        return out


def packed(ids: list, texts: list[bytes], words: bool) -> bytes:
    end = b" " if words else b""
    head = np.array([NONE if i is None or i != i else int(i) for i in ids], np.int64)
    sizes = np.array([len(t) + len(end) for t in texts], np.int64)
    body = b"".join(t + end for t in texts)
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(ids)).tobytes() + head.tobytes() + sizes.tobytes() + body)


def unpacked(blob: bytes, words: bool) -> Shard:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    return Shard(head[:n], head[n:], raw[8 + 16 * n :], words)


def shards(docs: DataFrame, words: bool, size: int = 4 << 20) -> DataFrame:
    """(shard, raw, blob): whole texts in runs of about ``size`` bytes, compressed.

    A shard's number and content are fixed once the rows are written, see ``screen.stored``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, ids, texts, total = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"shard": [number], "raw": [total], "blob": [packed(ids, texts, words)]})

        for frame in frames:
            for i, text in zip(frame["doc_id"].astype(object), frame["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                if texts and total + len(raw) > size:
                    yield out()
                    number, ids, texts, total = number + 1, [], [], 0
                ids.append(None if pd.isna(i) else i)
                texts.append(raw)
                total += len(raw)
        if texts:
            yield out()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(tidy(run), "shard long, raw long, blob binary")
