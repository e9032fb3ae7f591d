"""Decision ledgers and use metrics: summaries, triage, recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(ledger: DataFrame) -> DataFrame:
    """By actor, and for all (actor null): entries, tokens in and out, cost; missing numbers count as 0."""
    sums = [F.count(F.lit(1)).alias("entries")] + [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cost")]
    return ledger.rollup("actor").agg(*sums)


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """One row: consultations (toc or ask), searches (ask), distinct pages."""
    counted = metrics.agg(F.count_if(F.col("op").isin("toc", "ask")).alias("consultations"), F.count_if(F.col("op") == "ask").alias("searches"))
    seen = metrics.select(F.explode("pages").alias("page")).agg(F.count_distinct("page").alias("pages"))
    return counted.crossJoin(F.broadcast(seen))  # a row each


def recent(rows: DataFrame, n: int, *, ts: str = "ts", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def upper_median(values: Column) -> Column:
    """sorted[floor(n / 2)] of an array."""
    order = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.get(order, F.floor(F.size(order) / 2).cast("int"))


def within_days(ts: Column, now: str, days: int) -> Column:
    return ts >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))


def triage(ledger: DataFrame) -> DataFrame:
    """(group, field, n, min, median, max) of accepted and rejected derivability and rejected groundedness.

    Median: the upper one. ``ledger``: op, action, derivable, grounded. Groups are decided by the action's name.
    """
    own = ledger.where("op = 'adjudicate'").withColumn("group", F.when(F.col("action").startswith("reject"), "rejected").when(F.col("action").isin("file", "file_user_stated", "reinforce"), "accepted"))
    long = own.select("group", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("derivable", "grounded")])).alias("x")).select("group", "x.field", "x.value")
    wanted = long.where("group is not null and value is not null and not (group = 'accepted' and field = 'grounded')")
    # the upper median has the rank floor(n / 2): rows below an estimate of it are only counted, and the few around it
    # ranked by their distinct values, so that no group is gathered or sorted in one place
    sizes = wanted.groupBy("group", "field").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile_approx("value", [0.499, 0.501], 10_000).alias("around"))
    near = wanted.join(F.broadcast(sizes.select("group", "field", "around")), ["group", "field"])  # three rows
    below = near.groupBy("group", "field").agg(F.count_if(F.col("value") < F.get("around", 0)).alias("below"))
    inside = near.where((F.col("value") >= F.get("around", 0)) & (F.col("value") <= F.get("around", 1))).groupBy("group", "field", "value").agg(F.count(F.lit(1)).alias("c"))
    running = F.sum("c").over(Window.partitionBy("group", "field").orderBy("value"))
    placed = inside.withColumn("upto", running).join(F.broadcast(below), ["group", "field"]).join(F.broadcast(sizes.drop("around")), ["group", "field"])
    reached = placed.where(F.col("below") + F.col("upto") > F.floor(F.col("n") / 2))
    return reached.groupBy("group", "field").agg(F.first("n").alias("n"), F.first("min").alias("min"), F.min("value").alias("median"), F.first("max").alias("max"))


def overlaps(triaged: DataFrame) -> DataFrame:
    """One row: whether accepted claims reach as far into derivability as rejected ones begin."""
    own = triaged.where("field = 'derivable'")
    top, low = (F.max(F.when(F.col("group") == g, F.col(c))) for g, c in (("accepted", "max"), ("rejected", "min")))
    return own.agg(F.coalesce(top >= low, F.lit(False)).alias("overlap"))


def remedy(action: Column, kind: Column, importance_norm: Column) -> Column:
    """What to do about a rejected claim."""
    framing = kind.isin("architecture", "invariant", "decision") & (importance_norm >= 0.6)
    return (
        F.when((action == "reject_derivable") & framing, "restate_as_framing")
        .when(action == "reject_derivable", "leave_to_the_code")
        .when(action == "reject_duplicate", "already_filed")
        .when(action == "reject_sensitive", "keep_out")
        .when(action == "reject_unsupported", "add_evidence")
    )


def brief(claims: DataFrame) -> DataFrame:
    """One row of counts by action."""
    return claims.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("file", "file_user_stated", "reinforce", "review")], F.count_if(F.col("action").startswith("reject")).alias("rejected"))
