"""Operator 12, periodic runs of words: repeated k-grams mask a text, Main-Lorentz divides what survives.

A run of smallest period q and length n holds each of its words in a stretch of ``n - q`` words that occurs again q words
on or back. With runs of at least ``max(least, power * q)`` words no such stretch is shorter than the minimum over q of
``max(least, power * q) - q`` words: that is k. So words outside all k-grams that the document repeats are in no run, and
no run goes over them; the surviving segments are searched by themselves.

A segment is halved again and again; a run that lies across the middle of a part is found by how far the words on at
the middle agree with those p words away, forward and backward, for each p up to a ``power``-th of the part. These
extensions come from the names of all stretches of 1, 2, 4, ... words (equal names: equal stretches), so nothing rests on a
hash; all parts of one level, of all texts of a batch, are answered at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK_RUN, fresh, map_rows

LEAST, POWER = 6, 4
#: Characters of text that are searched at once; one longer text is searched by itself.
TOGETHER = 1 << 21


def minimum_overlap(least: int = LEAST, power: int = POWER) -> int:
    """The fewest words that a run shares with itself one period on."""
    return min(max(least, power * q) - q for q in range(1, least + 1))


def repeated(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words are in a k-gram that its document holds twice (unequal grams of one hash only let more words through)."""
    n = len(words) - k + 1
    mask = np.zeros(len(words) + 1, np.int64)
    if n <= 0:
        return mask[:-1] > 0
    key = doc[:n].astype(np.uint64)
    for j in range(k):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n].astype(np.uint64)
    key ^= key >> np.uint64(32)
    key = key * np.uint64(0xD6E8FEB86659FD93)
    inside = doc[:n] == doc[k - 1 :]
    held = np.sort(key[inside])
    twice = np.unique(held[1:][held[1:] == held[:-1]])
    if not len(twice):
        return mask[:-1] > 0
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = np.flatnonzero(inside & (twice[at] == key))
    np.add.at(mask, hit, 1)
    np.add.at(mask, hit + k, -1)
    return np.cumsum(mask[:-1]) > 0


def names(line: np.ndarray, longest: int) -> np.ndarray:
    """Row j names the stretches of 2**j elements that start at each place; places too near the end get names of their own."""
    levels = max(1, int(longest).bit_length())
    out = np.empty((levels, len(line)), np.int64)
    out[0] = pd.factorize(line)[0]
    for j in range(1, levels):
        half = 1 << (j - 1)
        n = max(0, len(line) - 2 * half + 1)
        out[j, :n] = pd.factorize(out[j - 1, :n] * (len(line) + 1) + out[j - 1, half : half + n])[0]
        out[j, n:] = len(line) + np.arange(len(line) - n)
    return out


def forward(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements agree from a and from b on."""
    got = np.zeros(len(a), np.int64)
    for j in range(len(name) - 1, -1, -1):
        x, y = a + got, b + got
        ok = y + (1 << j) <= name.shape[1]
        got += np.where(ok & (name[j, np.where(ok, x, 0)] == name[j, np.where(ok, y, 0)]), 1 << j, 0)
    return got


def backward(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements agree before a and before b."""
    got = np.zeros(len(a), np.int64)
    for j in range(len(name) - 1, -1, -1):
        x, y = a - got - (1 << j), b - got - (1 << j)
        ok = x >= 0
        got += np.where(ok & (name[j, np.where(ok, x, 0)] == name[j, np.where(ok, y, 0)]), 1 << j, 0)
    return got


def main_lorentz(line: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs inside the parts ``starts`` to ``ends`` of ``line``: (start, length, period) by start, then period.

    What stands between the parts must be unlike anything else, so that no agreement goes over it.
    """
    nothing = np.zeros(0, np.int64)
    if power < 4:
        raise ValueError("a run must hold four periods, so that two of them are on one side of any middle")
    if not len(starts):
        return nothing, nothing, nothing
    name = names(line, int((ends - starts).max()))
    found, low, high = [], starts, ends
    while len(low):
        middle, most = (low + high) // 2, (high - low) // power
        mid = np.repeat(middle, most)
        p = np.arange(len(mid)) - np.repeat(np.cumsum(most) - most, most) + 1
        level = np.frexp(p.astype(np.float64))[1].astype(np.int64) - 1  # a run holds two periods on one side of the middle
        for at, size in ((mid, 1 << level), (mid - p - (1 << level), 1 << level)):
            inside = (at >= 0) & (at + p + size <= len(line))
            same = np.flatnonzero(inside & (name[level, np.where(inside, at, 0)] == name[level, np.where(inside, at + p, 0)]))
            x, q = at[same], p[same]
            on, back = forward(name, x, x + q), backward(name, x, x + q)
            length = on + back + q
            good = length >= np.maximum(least, power * q)
            found.append(np.column_stack([x - back, length, q])[good])
        low, high = np.r_[low, middle], np.r_[middle, high]
        keep = high - low >= max(least, power)
        low, high = low[keep], high[keep]
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)  # one stretch of several periods: the smallest comes first
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def runs_of(texts: list[bytes | None], least: int = LEAST, power: int = POWER) -> list[tuple[list[bytes], np.ndarray]]:
    """Of each text its words and its runs, a row (start, length, period) each."""
    split = [(t or b"").split() for t in texts]  # of bytes: at the six ASCII blanks only
    sizes = np.array([len(w) for w in split], np.int64)
    words = pd.factorize(np.array([w for own in split for w in own] + [None], object)[:-1])[0]
    doc, first = np.repeat(np.arange(len(split)), sizes), np.cumsum(sizes) - sizes
    alive = repeated(words, doc, minimum_overlap(least, power))
    alive = np.r_[False, alive, False]
    change = np.flatnonzero(alive[1:] != alive[:-1])
    cuts = first[sizes > 0]
    begins, finishes = change[::2], change[1::2]
    inner = cuts[alive[1:-1][cuts] & alive[:-2][cuts]] if len(cuts) else cuts  # two documents' segments that touch
    begins, finishes = np.sort(np.r_[begins, inner]), np.sort(np.r_[finishes, inner])
    length = finishes - begins
    keep = length >= least
    begins, length = begins[keep], length[keep]
    starts = np.cumsum(length + 1) - length  # one separator before each segment
    line = -1 - np.arange(int(length.sum()) + len(length) + 1)
    source = np.repeat(begins - starts, length)
    places = np.arange(len(source)) + np.repeat(starts - (np.cumsum(length) - length), length)
    line[places] = words[places + source]
    at, size, period = main_lorentz(line, starts, starts + length, least, power)
    back = begins - starts
    at = at + back[np.searchsorted(starts, at, side="right") - 1] if len(at) else at
    owner = doc[at] if len(at) else at
    out, edges = [], np.searchsorted(owner, np.arange(len(split) + 1))
    for i, own in enumerate(split):
        a, b = edges[i], edges[i + 1]
        out.append((own, np.column_stack([at[a:b] - first[i], size[a:b], period[a:b]])))
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that stay when each run keeps its first period only."""
    if not len(runs):
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length over period; ties go to the smallest start, then period."""
    return min(((s, n, q) for s, n, q in runs.tolist()), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def detect(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """``docs`` with the columns runs (start, length, period; by start, then period) and collapsed, the text without repeats.

    Every row is searched as a whole and by itself, without a shuffle; one text takes some 8 bytes for each word and each
    doubling of its longest surviving segment. Null texts have no runs and stay null; empty and blank texts have none;
    rows that repeat get the same. If a column is already named so, the new one gets an underscore in front.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    names_of = docs.columns
    runs_name, text_name = fresh(docs, "runs", "collapsed")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.columns[names_of.index("text")]
            sizes, start = pc.binary_length(texts).fill_null(0).to_pylist(), 0
            while start < len(texts):
                end, total = start + 1, sizes[start]
                while end < len(texts) and total + sizes[end] <= TOGETHER:
                    total, end = total + sizes[end], end + 1
                part = batch.slice(start, end - start)
                own = texts.slice(start, end - start).cast(pa.binary()).to_pylist()
                found = runs_of(own, least, power)
                flat = np.concatenate([r for _, r in found])
                offsets = pa.array(np.r_[0, np.cumsum([len(r) for _, r in found])], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind.value_type)))
                kept = pa.array([None if t is None else b" ".join(collapsed(w, r)) for t, (w, r) in zip(own, found, strict=True)], pa.binary()).cast(pa.string())
                start = end
                yield pa.RecordBatch.from_arrays([*part.columns, lists, kept], names=[f"c{k}" for k in range(len(names_of) + 2)])

    struct = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    return map_rows(docs, run, [*docs.schema.fields, T.StructField(runs_name, T.ArrayType(struct)), T.StructField(text_name, T.StringType())])


def digest(docs: DataFrame) -> DataFrame:
    """For each document n_runs, the strongest run, and the hashes of all runs and of the collapsed text."""
    runs, text = fresh(docs, "runs", "collapsed")
    # Greatest exact ratio: lengths and periods of one text are under 2**31, so cross products are exact in a long.
    best = F.aggregate(
        F.col(runs),
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top),
    )
    line = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    found = detect(docs).select("doc_id", F.col(runs).alias("runs"), F.col(text).alias("collapsed"), best.alias("best"), line.alias("line"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.when(F.size("runs") > 0, F.concat("line", F.lit("\n"))).otherwise(F.lit("")), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode(F.coalesce("collapsed", F.lit("")), "UTF-8"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the checksum of its id, made periodic from some word on; the others as they are."""
    words, h, n, a, p = fresh(docs, "words", "h", "n", "a", "p")
    g = F.floor(F.col(h) / 10)
    with_words = docs.withColumn(h, F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))).withColumn(words, F.when(F.col(h) % 10 == 0, F.filter(F.split("text", BLANK_RUN, -1), lambda w: w != "")))
    with_words = with_words.withColumn(n, F.size(words)).withColumn(a, F.when(F.col(n) > 0, g % F.col(n))).withColumn(p, F.floor((F.col(n) - F.col(a)) / (3 + g % 8)) + 1)
    place = lambda i: F.when(i < F.col(a), i).otherwise(F.col(a) + F.pmod(i - F.col(a), F.col(p)))
    new = F.array_join(F.transform(words, lambda w, i: F.get(F.col(words), place(i).cast("int"))), " ")
    return with_words.withColumn("text", F.when(F.col(n) > 0, new).otherwise(F.col("text"))).select(docs.columns)
