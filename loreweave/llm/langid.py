"""Operator 6, language identification by the nearest of several clustered centroids a language.

A text becomes counts of letter n-grams (1 to 3 bytes of the lower-cased text, all but letters blank) hashed into a
fixed number of cells, damped by a logarithm, weighted by inverse document frequency and scaled to length 1.
Each language's training vectors are clustered by spherical k-means; a text takes the language of the centroid with
the largest cosine. A cosine distance beyond the language's own training distances marks the answer ``rejected``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

UNKNOWN = "und"
CELLS = 1 << 13
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    langs: np.ndarray  # of each centroid
    centroids: np.ndarray  # float32, rows of length 1
    idf: np.ndarray
    reach: np.ndarray  # of each centroid: the cosine under which an answer is rejected


def gram_counts(text: str) -> np.ndarray | None:
    """Hashed counts of the text's letter n-grams, or None if it has no letter. The whole text counts."""
    bare = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, bare)):
        return None
    a = np.frombuffer(f" {bare} ".encode(), np.uint8).astype(np.uint32)
    two = a[:-1] * np.uint32(257) + a[1:]
    three = two[:-1] * np.uint32(65599) + a[2:]
    grams = np.concatenate([a, two + np.uint32(1 << 17), three ^ np.uint32(0x5BD1E995)])
    mixed = (grams * np.uint32(2654435761)) >> np.uint32(32 - 13)
    return np.bincount(mixed, minlength=CELLS)[:CELLS].astype(np.float32)


def _scaled(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.maximum(length, 1e-12)


def _cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with far-apart first centres; the same rows always give the same centroids."""
    centres = rows[:1]
    while len(centres) < min(k, len(rows)):
        centres = np.vstack([centres, rows[np.argmin((rows @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        means = [rows[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]
        centres = _scaled(np.array(means))
    return centres


def fit(counts: np.ndarray, langs: np.ndarray, k: int = 4, slack: float = 0.5) -> LanguageModel:
    """Centroids from n-gram counts and their languages."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    rows = _scaled(np.log1p(counts) * idf)
    names, centroids, reach = [], [], []
    for lang in sorted(set(langs)):
        own = rows[langs == lang]
        centres = _cluster(own, k)
        near = (own @ centres.T).max(axis=1)
        names += [lang] * len(centres)
        centroids.append(centres)
        reach += [float(np.quantile(near, 0.01)) * slack] * len(centres)
    if not names:
        return LanguageModel(np.array([], object), np.zeros((0, CELLS), np.float32), idf, np.zeros(0))
    return LanguageModel(np.array(names, object), np.vstack(centroids).astype(np.float32), idf, np.array(reach))


def _under(edges: dict[str, int]) -> Column:
    """Whether a row's _hash is at most its language's edge."""
    edge = F.element_at(F.create_map(*[x for lang, e in sorted(edges.items()) for x in (F.lit(lang), F.lit(e))]), F.col("lang"))
    return F.col("_hash") <= edge


def _edges(hashed: DataFrame, per_lang: int) -> dict[str, int]:
    """By language the ``per_lang``-th smallest text hash (the largest one, if there are fewer).

    A share of the hash range that holds twice as many, by the language's estimated number of texts, is looked at, and
    a larger one where that held too few; so a language's rows are never gathered or ranked in one task.
    """
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("n")).collect()}
    shares = {lang: min(1.0, 2 * per_lang / max(1, n)) for lang, n in sizes.items()}
    found: dict[str, int] = {}
    while shares:
        limits = {lang: min(int(share * 2**64), 2**64 - 1) - 2**63 for lang, share in shares.items()}
        some: dict[str, list[int]] = {lang: [] for lang in shares}
        for r in hashed.where(_under(limits)).select("lang", "_hash").distinct().collect():
            some[r["lang"]].append(r["_hash"])
        done = [lang for lang, own in some.items() if len(own) >= per_lang or shares[lang] >= 1]
        found |= {lang: sorted(some[lang])[:per_lang][-1] for lang in done}
        shares = {lang: min(1.0, 4 * share) for lang, share in shares.items() if lang not in done}
    return found


def learn(docs: DataFrame, per_lang: int = 300, k: int = 4) -> LanguageModel:
    """Fit on at most ``per_lang`` whole texts of each language among ``docs(text, lang)``, chosen by a hash of the text.

    The n-grams are counted on the executors; the driver gets the cells of each chosen text that are not zero.
    Rows without text, language or letters teach nothing.
    """
    hashed = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.xxhash64("text").alias("_hash"), "text")
    edges = _edges(hashed, per_lang)
    if not edges:
        return fit(np.zeros((0, CELLS), np.float32), np.array([], object), k)
    chosen = hashed.where(_under(edges)).groupBy("lang", "_hash").agg(F.min("text").alias("text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(lang, gram_counts(text)) for lang, text in zip(frame["lang"], frame["text"], strict=True)]
            found = [(lang, x, np.flatnonzero(x)) for lang, x in found if x is not None]
            yield pd.DataFrame({"lang": [x[0] for x in found], "cells": [x[2].astype(np.uint16).tobytes() for x in found], "counts": [x[1][x[2]].astype(np.uint32).tobytes() for x in found]})

    rows = sorted((r["lang"], bytes(r["cells"]), bytes(r["counts"])) for r in chosen.mapInPandas(count, "lang string, cells binary, counts binary").collect())
    counts = np.zeros((len(rows), CELLS), np.float32)
    for row, (_, cells, own) in zip(counts, rows, strict=True):
        row[np.frombuffer(cells, np.uint16)] = np.frombuffer(own, np.uint32)
    return fit(counts, np.array([r[0] for r in rows], object), k)


def _answers(model: LanguageModel, texts: list[str | None], block: int = 256) -> Iterator[tuple[str, float, bool]]:
    for start in range(0, len(texts), block):
        counts = [gram_counts(t) if isinstance(t, str) else None for t in texts[start : start + block]]
        known = [x for x in counts if x is not None]
        best: Iterator[int] = iter(())
        if known and len(model.langs):
            near = _scaled(np.log1p(np.array(known)) * model.idf) @ model.centroids.T
            top = near.argmax(axis=1)
            best = iter(zip(top.tolist(), near[np.arange(len(top)), top].tolist(), strict=True))
        for x in counts:
            if x is None or not len(model.langs):
                yield UNKNOWN, 0.0, True
            else:
                c, cosine = next(best)
                yield model.langs[c], min(1.0, max(0.0, cosine)), cosine < model.reach[c]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (cosine with the chosen centroid) and rejected, from the whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or nothing could be learned. Equal cosines go to the
    language that sorts first. A text of any length is counted whole. Repeated rows get equal answers; other columns are ignored; no rows give no rows.
    The model goes to the tasks by value: a few centroids a language of ``CELLS`` numbers.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = list(_answers(held.value, frame["text"].tolist()))
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "lang_pred": [x[0] for x in found],
                    "score": [float(x[1]) for x in found],
                    "rejected": [bool(x[2]) for x in found],
                }
            )

    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(tidy(run), schema)


def held_out(doc_id: str = "doc_id"):
    """True for the third of the documents that nothing is learned from. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def evaluate(docs: DataFrame, per_lang: int = 300, k: int = 4) -> DataFrame:
    """Learn from the documents that are not held out, and answer for all: the contract's columns and ``rejected``."""
    model = learn(docs.where(~held_out()), per_lang, k)
    return identify(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected")
