"""Operator 1, benchmark decontamination: an FM-index per training shard, searched backward for benchmark windows.

Texts become word numbers of the benchmark's vocabulary. A shard (a bounded run of whole documents) is first reduced,
without loss, to the runs of words in which every neighbouring pair also neighbours in a benchmark item: no window can
occur elsewhere. Over these runs the shard's suffix array, its Burrows-Wheeler transform and a wavelet matrix are
built; all windows are searched at once, one backward step per word through wavelet ranks; occurrences are located by
walking to sampled suffix positions; spans of each document are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, map_rows

WINDOW = 10
#: Bytes to A-Z lower-cased, and all bytes that are no word bytes to a blank: 0-9, a-z and every byte of a non-ASCII character stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Phrases:
    """The windows of a block of benchmark items. Word numbers start at 1."""

    numbers: dict[bytes, int]
    pairs: np.ndarray  # sorted codes of neighbouring words
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: windows, and the pairs (window, item) in them
    items: list[str | None]
    shortest: int


def phrases(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    numbers: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], list[int]]] = {}
    pairs: set[tuple[int, int]] = set()
    for at, (_, text) in enumerate(items):
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        pairs.update(zip(ids, ids[1:], strict=False))
        size = min(window, len(ids))
        for i in range(len(ids) - size + 1 if size else 0):
            owners = found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), [])
            if not owners or owners[-1] != at:
                owners.append(at)
    windows = []
    for size in sorted(found):
        table = np.array(list(found[size]), np.int64).reshape(-1, size)
        owner = [(w, at) for w, owners in enumerate(found[size].values()) for at in owners]
        windows.append((table, *np.array(owner, np.int64).reshape(-1, 2).T))
    base = len(numbers) + 1
    codes = np.array(sorted(a * base + b for a, b in pairs), np.int64)
    return Phrases(numbers, codes, windows, [x[0] for x in items], min(found, default=0))


class WaveletMatrix:
    """Ranks of symbols in an integer sequence, one bit level at a time."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        start, end = np.zeros_like(ends), ends
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            up = ((symbols >> level) & 1).astype(bool)
            start = np.where(up, zeros + ones[start], start - ones[start])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - start

    def value(self, at: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Prefix doubling until all suffixes differ."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else after[: n - step]
        key = rank * (n + 2) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Backward search and location over a sequence of symbols from 1 up; 0 separates runs."""

    def __init__(self, values: np.ndarray, alphabet: int, sample: int = 8) -> None:
        text = np.concatenate([values, [0]]).astype(np.int64)
        # separators are told apart, so that prefix doubling ends after the longest repeated run
        marks = text == 0
        keys = np.where(marks, np.cumsum(marks) - 1, text + marks.sum())
        order = suffix_array(keys)
        self.transform = text[order - 1]
        self.wavelet = WaveletMatrix(self.transform, alphabet)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.sampled = order % sample == 0
        self.sampled[np.flatnonzero(self.transform == 0)] = True  # a walk never crosses a separator
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each pattern (rows of one length)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.transform))
        alive = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            symbols = patterns[alive, column]
            low[alive] = self.before[symbols] + self.wavelet.rank(symbols, low[alive])
            high[alive] = self.before[symbols] + self.wavelet.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking back to a sampled row."""
        out, steps, at, left = np.zeros(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.samples[self.sample_rank[at[done]]] + steps
            at, left = at[~done], left[~done]
            symbols = self.wavelet.value(at) if len(at) else at
            at = self.before[symbols] + self.wavelet.rank(symbols, at) if len(at) else at
            steps += 1
        return out


def search_shard(texts: list[str | None], wanted: Phrases) -> list[tuple[int, np.ndarray, np.ndarray, list[int]]]:
    """For each text: words, span starts, span ends (in words, merged) and the items found."""
    empty = np.zeros(0, np.int64)
    counts, parts = [], []
    get, lookup = wanted.numbers.get, wanted.numbers
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        parts.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)) if lookup else np.zeros(len(words), np.int64))
    results = [(n, empty, empty, []) for n in counts]
    if not wanted.windows or not sum(counts):
        return results
    ids, doc = np.concatenate(parts), np.repeat(np.arange(len(texts)), counts)
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    joined = np.zeros(len(ids), bool)  # whether a word may follow its predecessor inside a window
    if len(wanted.pairs):
        near = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0) & (doc[1:] == doc[:-1]))
        codes = ids[near] * (len(wanted.numbers) + 1) + ids[near + 1]
        place = np.minimum(np.searchsorted(wanted.pairs, codes), len(wanted.pairs) - 1)
        joined[near[wanted.pairs[place] == codes] + 1] = True
    starts = np.flatnonzero(~joined)
    lengths = np.diff(np.append(starts, len(ids)))
    good = (lengths >= wanted.shortest) & (ids[starts] > 0)
    starts, lengths = starts[good], lengths[good]
    if not len(starts):
        return results
    # the kept runs, each behind a separator
    total = int(lengths.sum()) + len(lengths)
    head = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    source = np.full(total, -1, np.int64)
    fill = np.arange(total) - np.repeat(head, lengths + 1)
    source[:] = np.where(fill == 0, -1, np.repeat(starts, lengths + 1) + fill - 1)
    index = FMIndex(np.where(source < 0, 0, ids[np.maximum(source, 0)]), len(wanted.numbers))
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    in_doc: dict[int, set[int]] = {}
    for table, owner_window, owner_item in wanted.windows:
        low, high = index.ranges(table)
        n = high - low
        if not n.sum():
            continue
        window = np.repeat(np.arange(len(table)), n)
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        at = source[index.locate(rows)]
        hits.append((at, at + table.shape[1]))
        pair = np.unique(np.column_stack([window, doc[at]]), axis=0)
        first, last = np.searchsorted(owner_window, pair[:, 0]), np.searchsorted(owner_window, pair[:, 0], side="right")
        for a, b, d in zip(first.tolist(), last.tolist(), pair[:, 1].tolist(), strict=True):
            in_doc.setdefault(d, set()).update(owner_item[a:b].tolist())
    if not hits:
        return results
    begin, end = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.argsort(begin, kind="stable")
    begin, end, of = begin[order], np.maximum.accumulate(end[order]), doc[begin[order]]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > end[:-1]) | (of[1:] != of[:-1])
    span_start, span_end, span_doc = begin[new], np.append(end[np.flatnonzero(new)[1:] - 1], end[-1]), of[new]
    for d in np.unique(span_doc).tolist():
        own = span_doc == d
        results[d] = (counts[d], span_start[own] - firsts[d], span_end[own] - firsts[d], sorted(in_doc[d]))
    return results


def _shards(texts: list[str | None], chars: int) -> Iterator[slice]:
    start = total = 0
    for at, text in enumerate(texts):
        size = len(text) if text else 0
        if total and total + size > chars:
            yield slice(start, at)
            start, total = at, 0
        total += size
    if start < len(texts):
        yield slice(start, len(texts))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with touching or overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


#: Words of a text, its merged spans, the items found in it.
FOUND = (T.LongType(), T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])), T.ArrayType(T.StringType()))


def annotate(docs: DataFrame, benchmark: DataFrame, names: tuple[str, str, str], window: int = WINDOW, block_bytes: int = 8 << 20, shard_chars: int = 4_000_000) -> DataFrame:
    """``docs`` with three columns more, named by ``names`` (no column of docs): its number of words, its merged spans
    (word positions, end exclusive) and the item ids found, each once.

    The benchmark is cut into blocks of some ``block_bytes`` of text. Each block is one pass over the rows, without a
    shuffle, and but for the last one its rows are written before the next block's phrases are made: driver and tasks
    hold the phrases of one block at a time, however large the benchmark. Null texts have no words; a text of any length
    is indexed whole; repeated rows get equal answers; an empty table gives no rows. An item without an id is searched
    like any other, its hits count, and it is not listed.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    at = docs.columns.index("text")
    keyed = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).distinct()  # copies would all fall into one block
    sizes = keyed.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0)).alias("n")).head()["n"]
    blocks = max(1, -(-int(sizes) // block_bytes))
    kinds = [to_arrow_type(t) for t in FOUND]
    rows = docs
    for block in range(blocks):
        own = keyed.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        held = docs.sparkSession.sparkContext.broadcast(phrases(sorted(((r["item"], r["text"]) for r in own), key=lambda x: (x[0] or "", x[1] or "")), window))

        def run(batches: Iterator[pa.RecordBatch], held=held, again=block > 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                got = [x for part in _shards(texts, shard_chars) for x in search_shard(texts[part], held.value)]
                spans = [list(zip(g[1].tolist(), g[2].tolist(), strict=True)) for g in got]
                items = [sorted({held.value.items[i] for i in g[3]} - {None}) for g in got]
                columns = list(batch.columns)
                if again:
                    spans = [merged([*x, *((y["start"], y["end"]) for y in old)]) for x, old in zip(spans, columns[-2].to_pylist(), strict=True)]
                    items = [sorted({*x, *old}) for x, old in zip(items, columns[-1].to_pylist(), strict=True)]
                    columns = columns[:-3]
                new = [[g[0] for g in got], [[{"start": a, "end": b} for a, b in x] for x in spans], items]
                columns += list(map(pa.array, new, kinds))
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

        rows = map_rows(rows, run, [*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, FOUND, strict=True))])
        if block + 1 < blocks:
            rows = cut_lineage(rows)
            held.destroy()
    return rows


def find(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """doc_id, n_words, spans and items of every document; see ``annotate``. Other columns are ignored."""
    rows = annotate(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, ("n_words", "spans", "items"), **limits)
    return rows.select("doc_id", "n_words", "spans", "items")


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without its words ``start`` to ``end`` - 1 and what stands between them."""
    if not text or not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for start, end in spans:
        out.append(text[done : at[start][0]])
        done = at[end - 1][1]
    return "".join([*out, text[done:]])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )

