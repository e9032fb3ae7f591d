"""Operator 7, URL filters: domain rules first, then gradient-boosted trees on lexical features.

Features of a url: lengths, depth, digit ratio, entropy, counts of parameters, labels and marks, and statistics of its
host's suffix learned from the labelled urls. The trees are histogram trees of bounded depth under logistic loss,
trained here from the labelled urls alone: where labels have nothing to do with urls, the trees learn that there is little
to tell. The number of trees is the one that does best on urls left out, one at least. A url whose predicted chance of being unwanted reaches the threshold is blocked.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BINS = 32


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return _ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path starts the url's, as a struct."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:], r[0]))
    found = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ranked
    ]
    return F.coalesce(*found)


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffix_of(host: str) -> str:
    return ".".join(host.split(".")[-2:])


FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "digit_ratio", "entropy", "host_entropy", "params", "labels", "hyphens", "digits_in_host", "fragment", "suffix_rate", "suffix_count")


def lexical(url: str | None, host: str, path: str, suffixes: dict[str, tuple[float, int]]) -> list[float]:
    """The feature row of a url; a null url has the features of an empty one."""
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    rate, count = suffixes.get(suffix_of(host), suffixes.get("", (0.0, 0)))
    return [
        len(url),
        len(host),
        len(path),
        sum(bool(x) for x in path.split("/")),
        sum(c.isdigit() for c in url) / max(1, len(url)),
        _entropy(url),
        _entropy(host),
        sum(bool(x) for x in query.split("&")),
        len(host.split(".")),
        url.count("-"),
        sum(c.isdigit() for c in host),
        float("#" in url),
        rate,
        math.log1p(count),
    ]


@dataclass
class Trees:
    """Boosted trees as flat arrays; ``edges`` cut each feature into bins."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, value by node
    suffixes: dict[str, tuple[float, int]] = field(default_factory=dict)

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(self.edges)]).astype(np.int16)

    def chance(self, rows: np.ndarray) -> np.ndarray:
        score = np.full(len(rows), self.base)
        if len(rows) and self.trees:
            bins = self.binned(rows)
            for feature, cut, value in self.trees:
                node = np.zeros(len(rows), np.int64)
                for _ in range(int(math.log2(len(value) + 1)) - 1):
                    f = feature[node]
                    right = bins[np.arange(len(rows)), np.maximum(f, 0)] > cut[node]
                    node = np.where(f < 0, node, 2 * node + 1 + right)
                score += value[node]
        return 1 / (1 + np.exp(-score))


def _grow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float, least: int, ridge: float):
    """One tree by exact gain over bin histograms; nodes in heap order, feature -1 marks a leaf."""
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
    rows_at = {0: np.arange(len(grad))}
    for node in range(size):
        rows = rows_at.pop(node, None)
        if rows is None:
            continue
        g, h = grad[rows].sum(), hess[rows].sum()
        value[node] = -rate * g / (h + ridge)
        if 2 * node + 2 >= size or len(rows) < 2 * least:
            continue
        best = (1e-9, -1, 0)
        for f in range(bins.shape[1]):
            b = bins[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, BINS + 1)) for w in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        if best[1] >= 0:
            feature[node], cut[node] = best[1:]
            right = bins[rows, best[1]] > best[2]
            rows_at[2 * node + 1], rows_at[2 * node + 2] = rows[~right], rows[right]
    return feature, cut, value


Labelled = list[tuple[str, str, str, int]]


def _losses(urls: Labelled, rest: Labelled, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of ``rest`` after each tree that ``urls`` give (from none on), and their labels."""
    model = train(urls, trees)
    rows = np.array([lexical(u, h, p, model.suffixes) for u, h, p, _ in rest], float).reshape(-1, len(FEATURES))
    alone = [Trees(0.0, model.edges, [t]).chance(rows) for t in model.trees]
    steps = np.cumsum([np.full(len(rows), model.base), *[np.log(c / (1 - c)) for c in alone]], axis=0)
    return steps, np.array([r[3] for r in rest], float)


def best_size(urls: Labelled, most: int = 40, folds: int = 5) -> int:
    """The number of trees with the least logistic loss on urls left out, fold by fold (dealt by a hash of the url)."""
    fold = np.array([zlib.crc32(u[0].encode()) % folds for u in urls])
    total = np.zeros(most + 1)
    for k in range(folds):
        rest = [u for u, f in zip(urls, fold, strict=True) if f == k]
        if rest and len(rest) < len(urls):
            steps, labels = _losses([u for u, f in zip(urls, fold, strict=True) if f != k], rest, most)
            total += np.logaddexp(0, np.where(labels == 1, -steps, steps)).sum(axis=1)
    return int(total.argmin())


def train(urls: Labelled, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 20, ridge: float = 1.0) -> Trees:
    """Trees from (url, host, path, label) rows; label 1 is unwanted. Without rows the answer is always 0."""
    if not urls:
        return Trees(base=-20.0)
    labels = np.array([r[3] for r in urls], float)
    mean = labels.mean()
    stats: dict[str, list[float]] = {}
    for _, host, _, label in urls:
        of = stats.setdefault(suffix_of(host), [0.0, 0])
        of[0] += label
        of[1] += 1
    suffixes = {k: ((s + 10 * mean) / (n + 10), int(n)) for k, (s, n) in stats.items()} | {"": (float(mean), 0)}
    rows = np.array([lexical(u, h, p, suffixes) for u, h, p, _ in urls], float)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])]
    odds = min(max(mean, 1e-6), 1 - 1e-6)
    model = Trees(math.log(odds / (1 - odds)), edges, [], suffixes)
    bins, score = model.binned(rows), np.full(len(rows), math.log(odds / (1 - odds)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(bins, p - labels, p * (1 - p), depth, rate, least, ridge)
        alone = Trees(0.0, edges, [tree])
        model.trees.append(tree)
        raw = alone.chance(rows)
        score += np.log(raw / (1 - raw))
    return model


def labelled(pages: DataFrame, labels: DataFrame, most: int = 20_000) -> Labelled:
    """(url, host, path, label) of at most ``most`` labelled urls, chosen by a hash of the url.

    A url is labelled by the labelled document that it names (the number in its path): unwanted if that document is
    toxic or of low quality in any of its label rows. Every url that has a label can be chosen; null labels say nothing.
    """
    known = pages.select("url", F.try_to_number(F.regexp_extract("url", r"/(\d{1,18})(?=\D|$)", 1), F.lit("9" * 18)).cast("long").alias("_doc"))
    wanted = labels.select(F.col("doc_id").alias("_doc"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int").alias("_label"))
    rows = (
        known.where(F.col("_doc").isNotNull())
        .join(wanted.groupBy("_doc").agg(F.max("_label").alias("_label")), "_doc")
        .groupBy("url")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("url"), "url")
        .limit(most)
        .select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), "_label")
    )
    return sorted((r["url"], r["h"], r["p"], r["_label"]) for r in rows.collect())


def learn(pages: DataFrame, labels: DataFrame, most: int = 20_000) -> Trees:
    """Trees from the labelled urls, see ``labelled``; as many as do best on urls left out."""
    urls = labelled(pages, labels, most)
    return train(urls, max(1, best_size(urls)))


def ranked_right(scores: np.ndarray, labels: np.ndarray) -> float | None:
    """Chance that an unwanted url ranks above a wanted one (area under the curve); null without both kinds."""
    bad, good = int((labels == 1).sum()), int((labels == 0).sum())
    ranks = pd.Series(scores).rank().to_numpy()
    return float((ranks[labels == 1].sum() - bad * (bad + 1) / 2) / (bad * good)) if bad and good else None


def held_out_auc(urls: Labelled, folds: int = 5, trees: int = 40) -> float | None:
    """``ranked_right`` of urls by trees that haven't seen them."""
    fold = np.array([zlib.crc32(u[0].encode()) % folds for u in urls])
    score = np.zeros(len(urls))
    for k in range(folds):
        own = np.flatnonzero(fold == k)
        if len(own):
            steps, _ = _losses([u for u, f in zip(urls, fold, strict=True) if f != k], [urls[i] for i in own], trees)
            score[own] = steps[-1]
    return ranked_right(score, np.array([u[3] for u in urls]))


def judge(pages: DataFrame, model: Trees, threshold: float = 0.5, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule (null if none fits), chance and verdict of every url.

    A rule decides where one fits; else the trees do. Null or odd urls have an empty host and path, fit no rule and are
    judged by their (few) features. Repeated rows are judged alike; other columns are ignored; no rows give no rows.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))

    @F.pandas_udf("double")
    def chance(urls: pd.Series, hosts: pd.Series, paths: pd.Series) -> pd.Series:
        features = [lexical(u, h, p, held.value.suffixes) for u, h, p in zip(urls, hosts, paths, strict=True)]
        return pd.Series(held.value.chance(np.array(features, float).reshape(-1, len(FEATURES))))

    judged = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("chance", chance("url", "host", "path"))
    by_trees = F.when(F.col("chance") >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_trees).alias("verdict"), "chance")
