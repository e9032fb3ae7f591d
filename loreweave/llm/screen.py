"""The screening round that operators 5 and 9 share: which minimizer grams occur in two documents or more.

Shards are kept in a table bucketed by shard number, so that later rounds meet their replies without moving texts.
Each shard sends the distinct hashes of its minimizers to hash ranges ("bins"), sorted and packed; a bin finds what
two documents hold and answers each shard with a bitmap. A gram costs a shard four bytes however often it occurs, so
no gram, and no group of copies, makes a bin heavy. Shards send to bins for which they have something only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import shared_folder, tidy
from .windows import GRAM, REACH, WINDOW, Shard, gram_hashes, minimizers, mix, unpacked

BIN_BYTES = 8 << 20  # of text for each bin
MOST = 1 << 14  # partitions
BLOCK = 1 << 15
_TOP = np.uint64(np.iinfo(np.uint64).max)


@contextmanager
def stored(shards: DataFrame) -> Iterator[DataFrame]:
    """``shards`` as a table bucketed by shard in the shared folder, for as long as the block lasts.

    It is written once: from then on a shard's number and content are fixed, whatever executors are lost.
    """
    spark = shards.sparkSession
    name = f"loreweave_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards.write.format("parquet").option("compression", "uncompressed").option("path", folder).bucketBy(buckets, "shard").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def deal(rows: DataFrame, key: str, bins: int) -> DataFrame:
    """Rows dealt to partitions by a bin's number: a partition each, or several bins to one beyond ``MOST`` partitions."""
    return rows.repartition(min(bins, MOST), key)


def bins_for(shards: DataFrame) -> int:
    """A power of two: one bin for each ``BIN_BYTES`` of text, eight at least."""
    total = shards.agg({"raw": "sum"}).head()[0] or 0
    return 1 << max(3, int(-(-total // BIN_BYTES) - 1).bit_length())


def anchors(shard: Shard, own: bool = False) -> tuple[np.ndarray, ...]:
    """Positions of the minimizers that lie inside one document, and their gram hashes.

    With ``own`` also the least and largest offset of the windows whose first least gram each is: a window that starts
    that many symbols before it. They follow from the symbols that these windows can hold. Done block by block, so that
    the passes over a block stay in the processor's cache.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    side = REACH - 1
    for start in range(0, shard.count, BLOCK):
        low, high = max(0, start - side), min(shard.count, start + BLOCK + side + GRAM - 1)
        grams = gram_hashes(shard.symbols(low, high))
        at = minimizers(grams)
        at = at[(at + low >= start) & (at + low < start + BLOCK)]
        at = at[shard.room(at + low) >= GRAM]
        value = grams[at]
        # least hashes crowd at the low end; mixed once more they spread evenly over bins
        found: tuple[np.ndarray, ...] = (at + low, mix(value))
        if own:
            before, after = np.full(len(at), side, np.uint8), np.zeros(len(at), np.uint8)
            padded = np.concatenate([np.full(side, _TOP), grams, np.full(side, _TOP)])
            for d in range(side, 0, -1):  # the nearest ones are met last
                before[padded[at + side - d] <= value] = d - 1
                after[padded[at + side + d] < value] = REACH - d
            found += (after, before)
        parts.append(found)
    if not parts:
        none = np.zeros(0, np.int64)
        return (none, none.view(np.uint64), *[none.astype(np.uint8)] * (2 * own))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def codes(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The bin's number and the 32 bits behind it."""
    return hashes >> np.uint64(32 - (bins.bit_length() - 1))


def bin_of(hashes: np.ndarray, bins: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)


def parts_of(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(number, start, end) of each run of equal sorted numbers: what work by bin costs follows what there is, not the bins."""
    if not len(numbers):
        return []
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    return list(zip(numbers[first].tolist(), first.tolist(), np.append(first[1:], len(numbers)).tolist(), strict=True))


def _summary(at: np.ndarray, grams: np.ndarray, shard: Shard, bins: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each bin that gets any: the distinct short hashes, and whether two of the shard's documents hold them."""
    if not len(at):
        return []
    order = np.argsort(grams)
    code, ids = codes(grams[order], bins), shard.ids[shard.doc[at[order]]]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
    code = code[first]
    return [(k, code[a:b].astype(np.uint32), several[a:b]) for k, a, b in parts_of((code >> np.uint64(32)).astype(np.int64))]


def ask(table: DataFrame, bins: int, words: bool) -> DataFrame:
    """(bin, shard, keys, several): what each shard tells each bin."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, blob in zip(frame["shard"], frame["blob"], strict=True):
                shard = unpacked(blob, words)
                parts = _summary(*anchors(shard), shard, bins)
                yield pd.DataFrame({"bin": [k for k, _, _ in parts], "shard": number, "keys": [x.tobytes() for _, x, _ in parts], "several": [np.packbits(x).tobytes() for _, _, x in parts]})

    return table.select("shard", "blob").mapInPandas(tidy(run), "bin int, shard long, keys binary, several binary")


def answer(asked: DataFrame, bins: int) -> DataFrame:
    """(shard, bin, shared): a bit for each of the shard's keys, in its order. Each bin is a partition: few bytes, much work."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint32) for k in frame["keys"]]
        several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)).astype(bool) for s, k in zip(frame["several"], keys, strict=True)]
        every = np.sort(np.concatenate(keys))
        twice = every[1:][every[1:] == every[:-1]]
        shared = np.union1d(twice, np.concatenate([k[s] for k, s in zip(keys, several, strict=True)]))
        bits = [np.packbits(shared[np.minimum(np.searchsorted(shared, k), len(shared) - 1)] == k if len(shared) else np.zeros(len(k), bool)).tobytes() for k in keys]
        return pd.DataFrame({"shard": frame["shard"], "bin": frame["bin"], "shared": bits})

    return deal(asked, "bin", bins).groupBy("bin").applyInPandas(run, "shard long, bin int, shared binary")


def shared_anchors(shard: Shard, bins: int, replies: dict[int, bytes], own: bool = False) -> tuple[np.ndarray, ...]:
    """The anchors whose grams other documents hold too, by position; see ``anchors``."""
    found = anchors(shard, own)
    code, number = np.unique(codes(found[1], bins), return_inverse=True)
    bins_held = (code >> np.uint64(32)).astype(np.int64)
    shared = np.zeros(len(code), bool)
    for k, bits in replies.items():
        a, b = np.searchsorted(bins_held, [k, k + 1]).tolist()
        shared[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    keep = shared[number]
    return tuple(x[keep] for x in found)


def candidates(shard: Shard, at: np.ndarray, least: np.ndarray | int = 0, most: np.ndarray | int = REACH - 1) -> np.ndarray:
    """By symbol: whether a window of one document starts there, ``least`` to ``most`` symbols before one of ``at``."""
    low, high = np.maximum(at - most, 0), at - least + 1
    some = high > low
    change = np.bincount(low[some], minlength=shard.count + 2) - np.bincount(high[some], minlength=shard.count + 2)
    return (np.cumsum(change)[: shard.count] > 0) & shard.starts_window()


def covered(starts: np.ndarray) -> np.ndarray:
    """By symbol: whether a window that starts at a marked symbol covers it."""
    change = np.zeros(len(starts) + WINDOW + 1, np.int32)
    change[: len(starts)] += starts
    change[WINDOW : WINDOW + len(starts)] -= starts
    return np.cumsum(change)[: len(starts)] > 0
