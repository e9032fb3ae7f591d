"""Paired experiments: latest valid rows, pairs, summaries, tests and intervals."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: tuple[str, ...] = ("task", "arm", "repeat"), ordinal: str = "ordinal") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def is_valid(valid: Column, expected: Column, observed: Column, clean: Column, cost: Column) -> Column:
    """Explicit validity, else equal tools; not unclean; with a cost."""
    return F.coalesce(valid, expected.eqNullSafe(observed)) & F.coalesce(clean, F.lit(True)) & cost.isNotNull()


def pairs(rows: DataFrame, treated: str, control: str) -> DataFrame:
    """(task, repeat, treated, control): costs of both arms where both are positive."""
    both = rows.groupBy("task", "repeat").pivot("arm", [treated, control]).agg(F.max("cost"))
    return both.select("task", "repeat", F.col(f"`{treated}`").alias("treated"), F.col(f"`{control}`").alias("control")).where("treated > 0 and control > 0")


def describe(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, sample deviation (null for one) and median."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.when(F.count(value) > 1, F.stddev_samp(value)), 6).alias("sd"), F.round(F.median(value), 6).alias("median")
    )


def average_rank(value: Column, by: list[Column | str]) -> Column:
    """Rank with ties at their average."""
    same = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(same) - 1) / 2


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided p by Abramowitz and Stegun's 7.1.26."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return 1 - (1 - series * F.exp(-x * x))


def required_pairs(sd: Column, effect: float) -> Column:
    """Pairs that a relative effect on log cost takes."""
    return F.ceil(8 * sd * sd / math.log1p(effect) ** 2)


def wilcoxon(values: list[float]) -> tuple[int, float, float]:
    """(n, smaller rank sum, p) of the signed-rank test: zeros dropped, ties averaged.

    Exact up to 15 values, else normal with corrections for ties and continuity; p is 1 where nothing differs.
    """
    x = pd.Series([v for v in values if v], dtype=float)
    n = len(x)
    if not n:
        return 0, 0.0, 1.0
    ranks = x.abs().rank().tolist()
    plus, total = sum(r for r, v in zip(ranks, x, strict=True) if v > 0), n * (n + 1) / 2
    least, far = min(plus, total - plus), abs(plus - total / 2)
    if n <= 15:
        sums = {0.0: 1}
        for r in ranks:
            for s, c in list(sums.items()):
                sums[s + r] = sums.get(s + r, 0) + c
        # the sums above hold each subset once: sums without r, and with it
        return n, least, sum(c for s, c in sums.items() if abs(s - total / 2) >= far - 1e-9) / 2**n
    ties = pd.Series(ranks).value_counts()
    spread = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    if spread <= 0:
        return n, least, 1.0
    step = 0.5 if far else 0.0
    x = abs(far - step) / math.sqrt(spread) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return n, least, ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * math.exp(-x * x)


def _median(values: list[float]) -> float:
    s, n = sorted(values), len(values)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def bootstrap_median(values: list[float], resamples: int = 2000, alpha: float = 0.05) -> tuple[float | None, float | None]:
    """Percentile interval of the median from a fixed linear congruential sequence in double arithmetic."""
    if len(values) < 2:
        return None, None
    seed, medians = 12345, []
    for _ in range(resamples):
        sample = []
        for _ in values:
            seed = int(float(seed) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
            sample.append(values[min(len(values) - 1, int(seed / 0x7FFFFFFF * len(values)))])
        medians.append(_median(sample))
    medians.sort()
    return medians[int(alpha / 2 * resamples)], medians[min(resamples - 1, math.ceil((1 - alpha / 2) * resamples) - 1)]


def paired_tests(paired: DataFrame, by: str = "contrast") -> DataFrame:
    """(contrast, n, statistic, p, low, high) over differences treated - control; one contrast's pairs are few.

    The statistic is the smaller rank sum; low and high are the bootstrap's bounds of the median.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["task", "repeat"])
        d = (frame["treated"] - frame["control"]).tolist()
        n, w, p = wilcoxon(d)
        low, high = bootstrap_median(d)
        return pd.DataFrame({by: [frame[by].iloc[0]], "n": [n], "statistic": [w], "p": [p], "low": [low], "high": [high]})

    return paired.groupBy(by).applyInPandas(run, f"{by} string, n long, statistic double, p double, low double, high double")


def outcomes(rows: DataFrame, treated: str, control: str) -> DataFrame:
    """One row: pairs, successes of either arm, and pairs that only one of them passed. ``rows``: task, repeat, arm, cost, passed.

    Successes count over pairs with both costs; only pairs where both outcomes are known can disagree.
    """
    both = rows.groupBy("task", "repeat").pivot("arm", [treated, control]).agg(F.max("cost").alias("cost"), F.max("passed").alias("passed"))
    t, c = (F.col(f"`{arm}_passed`") for arm in (treated, control))
    pairs_ = both.where((F.col(f"`{treated}_cost`") > 0) & (F.col(f"`{control}_cost`") > 0))
    return pairs_.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(t).alias("treated_passed"),
        F.count_if(c).alias("control_passed"),
        F.count_if(t & ~c).alias("only_treated"),
        F.count_if(c & ~t).alias("only_control"),
    )


def paired_report(paired: DataFrame, effects: tuple[float, ...] = (0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """One row on the log cost ratios of pairs: n, median, mean, deviation, and the pairs that each effect takes."""
    r = paired.select(F.log(F.col("treated") / F.col("control")).alias("r"))
    sd = F.stddev_samp("r")
    return r.agg(
        F.count("r").alias("n"), F.round(F.median("r"), 6).alias("median"), F.round(F.avg("r"), 6).alias("mean"), F.round(sd, 6).alias("sd"),
        *[required_pairs(sd, e).alias(f"pairs_for_{round(100 * e)}") for e in effects],
    )


def judged_by_task(rows: DataFrame) -> DataFrame:
    """(task, arm, n, mean, low, high) of judges' totals."""
    return rows.groupBy("task", "arm").agg(F.count("total").alias("n"), F.avg("total").alias("mean"), F.min("total").alias("low"), F.max("total").alias("high"))


def judged_by_arm(by_task: DataFrame) -> DataFrame:
    """(arm, n, mean, within_task_range) from ``judged_by_task``: the judges' own noise beside the arms' means."""
    weighted = F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n"))
    return by_task.groupBy("arm").agg(F.sum("n").alias("n"), weighted.alias("mean"), F.avg(F.col("high") - F.col("low")).alias("within_task_range"))
