"""Claims judged, placed, reinforced and reviewed: rules over judged columns, in native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import ordered_union


@dataclass(frozen=True)
class Rules:
    """Thresholds and weights of the decision ladder (fixed default values)."""

    auto_accept: float = 0.8
    min_support: float = 0.7
    min_derivable: float = 0.5
    framing_importance: float = 0.6
    min_importance: float = 1.0
    w_grounded: float = 0.45
    w_importance: float = 0.25
    w_novel: float = 0.2
    w_authority: float = 0.1
    authority: float = 0.8
    accept_user_stated: bool = True


FRAMING = ("architecture", "invariant", "decision")


def decide(rules: Rules = Rules()) -> tuple[Column, Column]:
    """(action, score) from the columns sensitive, derivable, kind, importance, importance_norm, grounded, durable,
    already_known, relation, trust_tier. The first rule that fits decides; missing judgements count as 0."""
    c = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in ("sensitive", "derivable", "importance", "importance_norm", "grounded", "durable", "already_known")}
    kind, relation, tier = (F.coalesce(F.col(k), F.lit("")) for k in ("kind", "relation", "trust_tier"))
    important = c["importance"] >= rules.min_importance
    lasting = (c["durable"] >= 0.5) & important
    user = F.lit(rules.accept_user_stated) & (tier == "user_stated") & lasting
    framing = kind.isin(*FRAMING) & (c["importance_norm"] >= rules.framing_importance) & (c["grounded"] >= 0.5)
    sure = (c["grounded"] >= rules.auto_accept) & important
    action = (
        F.when(c["sensitive"] >= 0.9, "reject_sensitive")
        .when(c["derivable"] >= rules.min_derivable, F.when(framing, "review").otherwise("reject_derivable"))
        .when(c["already_known"] >= 0.9, "reject_duplicate")
        .when(sure & relation.isin("extends", "consistent"), "reinforce")
        .when(sure, F.when((c["durable"] < 0.5) & (c["importance_norm"] < 0.5), "review").otherwise("file"))
        .when(c["grounded"] >= rules.min_support, F.when(user, "file_user_stated").otherwise("review"))
        .when((tier == "user_stated") & lasting, "file_user_stated")
        .when((tier == "verified_in_repo") & lasting, "file")
        .otherwise("reject_unsupported")
    )
    total = rules.w_grounded * c["grounded"] + rules.w_importance * c["importance_norm"] + rules.w_novel * (1 - c["derivable"]) + rules.w_authority * rules.authority
    barred = (c["sensitive"] >= 0.9) | ((c["derivable"] >= rules.min_derivable) & ~framing) | ((c["derivable"] < rules.min_derivable) & (c["already_known"] >= 0.9))
    return action, F.when(barred, 0.0).otherwise(total)


def reasons(rules: Rules = Rules()) -> Column:
    """Why ``decide`` decides as it does, from the same columns: an array of sentences, some of them notes on the way."""
    action, _ = decide(rules)
    c = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in ("sensitive", "derivable", "grounded", "already_known")}
    relation, tier = (F.coalesce(F.col(k), F.lit("")) for k in ("relation", "trust_tier"))
    measured = F.concat(F.lit("derivable from code ("), F.format_string("%.2f", c["derivable"]), F.lit(f" ≥ {rules.min_derivable:g})"))
    framed = F.concat(measured, F.lit(" but high-importance "), F.coalesce(F.col("kind"), F.lit("")), F.lit(" framing — queued for confirmation instead of dropped"))
    noted = F.array_compact(
        F.array(
            F.when(relation == "supersedes", "supersedes an existing claim"),
            F.when(relation == "contradicts", "contradicts existing knowledge — dispute"),
        )
    )
    sure = c["grounded"] >= rules.auto_accept
    supported = c["grounded"] >= rules.min_support
    important = F.coalesce("importance", F.lit(0.0)) >= rules.min_importance
    last = (
        F.when(action == "reinforce", "reinforces existing knowledge")
        .when(action == "reject_unsupported", "not grounded in evidence")
        .when(action == "file_user_stated", F.when(supported, "user-stated trust tier (auto-accepted)").otherwise("user-stated trust tier (lower confidence)"))
        .when((action == "file") & ~sure & (tier == "verified_in_repo"), "repo-verified evidence")
        .when((action == "review") & sure & important, "low durability")
        .when(action == "review", "below auto-accept threshold")
    )
    return (
        F.when(action == "reject_sensitive", F.array(F.lit("contains sensitive content")))
        .when(c["derivable"] >= rules.min_derivable, F.array(F.when(action == "review", framed).otherwise(measured)))
        .when(action == "reject_duplicate", F.array(F.lit("already known")))
        .otherwise(F.concat(noted, F.array_compact(F.array(last))))
    )


def is_active(status: Column, use: str, strict: bool = False) -> Column:
    """Whether a claim counts, by what for: ``index`` (what is cut into chunks), ``lint`` (what is checked), ``search``.

    The three differ: checks count disputed claims too, and search, if ``strict``, by the one spelling that leaves
    user-stated ones out.
    """
    if use == "lint":
        return ~F.coalesce(status, F.lit("verified")).isin("superseded", "rejected")
    if use == "index":
        return F.coalesce(status, F.lit("")).isin("", "verified", "user-stated", "needs_recheck")
    if use != "search":
        raise ValueError(use)
    return status.isNull() | status.isin(*["verified", "user_stated", "needs_recheck"] + ([] if strict else ["user-stated"]))


def tournament(fits: DataFrame, shard: int = 250, least: float = 0.6) -> DataFrame:
    """(claim_id, target): the best page of each claim by judged fit, shard by shard and then among the shards' winners.

    ``fits``: claim_id, position (from 1), page, fit (within its shard), final_fit (among winners). No winner with a fit
    of ``least`` or more: a new page (null). A single shard needs no final.
    """
    sharded = fits.withColumn("shard", F.floor((F.col("position") - 1) / shard))
    order = Window.partitionBy("claim_id", "shard").orderBy(F.desc("fit"), "position")
    winners = sharded.withColumn("_r", F.row_number().over(order)).where((F.col("_r") == 1) & (F.col("fit") >= least))
    counted = winners.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("claim_id")))
    score = F.when(F.col("_n") == 1, F.col("fit")).otherwise(F.col("final_fit"))
    last = Window.partitionBy("claim_id").orderBy(F.desc("_score"), "position")
    best = counted.withColumn("_score", score).withColumn("_r", F.row_number().over(last)).where("_r = 1").select("claim_id", F.col("page").alias("target"))
    return fits.select("claim_id").distinct().join(best, "claim_id", "left")


def reinforced_support(support: Column, corroborations: Column) -> tuple[Column, Column]:
    """(support, corroborations) of a claim that was met again."""
    more = F.coalesce(corroborations, F.lit(1)) + 1
    return F.least(F.lit(0.99), F.greatest(F.coalesce(support, F.lit(0.8)), 0.85 + 0.02 * more)), more


def reinforce(claims: DataFrame, met: DataFrame, today: str, least: float = 0.5) -> DataFrame:
    """``claims`` with the best match of each new text confirmed: support, corroborations, last_confirmed, evidence.

    ``claims``: id, page, text, tokens, status, support, corroborations, last_confirmed, evidence; ``met``: query_id,
    page, tokens, evidence. Superseded and rejected claims aren't matched. Several texts that meet one claim confirm it
    one after the other, which only the last step's support shows.
    """
    hit = _best_on_page(claims, met, least).groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.array_distinct(F.flatten(F.array_sort(F.collect_list("evidence")))).alias("_more"))
    both = claims.join(hit, "id", "left")
    again = F.coalesce("corroborations", F.lit(1)) + F.col("_n")
    first = F.coalesce("corroborations", F.lit(1)) + 1
    # support only grows, and by the last confirmation most
    support = F.least(F.lit(0.99), F.greatest(F.coalesce("support", F.lit(0.8)), 0.85 + 0.02 * F.greatest(first, again)))
    new = {"support": support, "corroborations": again, "last_confirmed": F.lit(today), "evidence": ordered_union(F.col("evidence"), F.col("_more"))}
    return both.select(*[F.when(F.col("_n").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in claims.columns])


def supersede(claims: DataFrame, newer: DataFrame, today: str, least: float = 0.35) -> DataFrame:
    """``claims`` with the best match of each newer text marked as superseded by it (its first 100 characters).

    ``claims``: id, page, tokens, status, superseded_by, superseded_at; ``newer``: query_id, page, tokens, text.
    """
    hit = _best_on_page(claims, newer, least).groupBy("id").agg(F.max_by("text", "query_id").alias("_by"))
    both = claims.join(hit, "id", "left")
    new = {"status": F.lit("superseded"), "superseded_by": F.substring("_by", 1, 100), "superseded_at": F.lit(today)}
    return both.select(*[F.when(F.col("_by").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in claims.columns])


def _best_on_page(claims: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """The claim of its page that each text overlaps most, from ``least`` up; the smallest id of equals; with the text's columns."""
    active = claims.where(is_active(F.col("status"), "lint"))
    # tokens travel alone, with the sizes of their sets; the hints keep exploded tables, which look small, from broadcasts
    one = met.select("query_id", F.col("page").alias("_page"), F.size("tokens").alias("_m"), F.explode(F.array_distinct("tokens")).alias("token"))
    other = active.select("id", F.col("page").alias("_page"), F.size("tokens").alias("_n"), F.explode(F.array_distinct("tokens")).alias("token"))
    near = one.join(other.hint("merge"), ["_page", "token"]).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("_shared"), F.first("_m").alias("_m"), F.first("_n").alias("_n"))
    scored = near.select("query_id", "id", (F.col("_shared") / F.least("_m", "_n")).alias("_score")).where(F.col("_score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("_score"), "id")
    best = scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("query_id", "id")
    return best.join(met.drop("tokens").hint("merge"), "query_id")


def writer_mode(mode: Column, worst: Column) -> Column:
    """How freely pages are written, given the worst criticality: auto, draft or guided."""
    return (
        F.when(worst >= 0.95, "guided")
        .when((worst >= 0.85) & (mode == "auto"), "draft")
        .when((worst >= 0.85) & (mode == "draft"), "guided")
        .otherwise(mode)
    )


def reviewed_status(resolution: Column, status: Column, criticality: Column, confirmed: Column) -> Column:
    """A claim's status after a review: critical ones change only when confirmed."""
    held = (criticality >= 0.85) & (resolution != "defer") & ~F.coalesce(confirmed, F.lit(False))
    return (
        F.when(held | resolution.isin("defer", "out_of_scope"), status)
        .when((resolution == "accept") & (status == "user-stated"), status)
        .when(resolution == "accept", "verified")
        .when(resolution == "reject", "rejected")
        .when(resolution == "supersede", "superseded")
        .otherwise(status)
    )


def review_queue(items: DataFrame, limit: int = 20) -> DataFrame:
    """Open items: disputes, then rechecks, then claim reviews; the most critical first."""
    kind = F.when(F.col("kind") == "dispute", 0).when(F.col("kind") == "needs_recheck", 1).otherwise(2)
    return items.where("status = 'open'").orderBy(kind, F.desc("criticality"), "id").limit(limit)


def enqueue(items: DataFrame, new: DataFrame) -> DataFrame:
    """``items`` with the new ones of which no open item of the same kind, page and text stands in the queue."""
    key = ["kind", "page", "claim_text"]
    fresh = new.dropDuplicates(key).join(items.where("status = 'open'").select(*key), key, "left_anti")
    return items.unionByName(fresh.select(*items.columns))


def resolve_reviews(items: DataFrame, wanted: DataFrame, now: str, critical: float = 0.85) -> DataFrame:
    """``items`` with the wanted resolutions: status, resolution, note, resolved_at.

    ``wanted``: id, resolution, note, confirmed. A critical item that nobody confirmed is deferred, whatever was wanted.
    Ids that no item has change nothing.
    """
    asked = wanted.select("id", F.col("resolution").alias("_want"), F.col("note").alias("_note"), F.coalesce("confirmed", F.lit(False)).alias("_sure"))
    both = items.join(asked, "id", "left")
    held = (F.col("criticality") >= critical) & (F.col("_want") != "defer") & ~F.col("_sure")
    said = F.when(held, "defer").otherwise(F.col("_want"))
    new = {
        "status": F.when(said == "defer", "deferred").otherwise("resolved"),
        "resolution": said,
        "note": F.when(held, "critical item requires user confirmation").otherwise(F.col("_note")),
        "resolved_at": F.lit(now),
    }
    return both.select(*[F.when(F.col("_want").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns])


def apply_reviews(claims: DataFrame, resolved: DataFrame, today: str) -> DataFrame:
    """``claims`` as resolved reviews leave them: status, support (0.8 at least once accepted) and the day of review.

    ``claims``: page, id, text, status, support, reviewed; ``resolved``: page, claim_id, claim_text, resolution. An item
    finds its claim by page and id, or by page and text; one out of scope leaves it alone.
    """
    done = resolved.where(F.col("page").isNotNull() & (F.col("resolution") != "out_of_scope"))
    by_id = done.where("claim_id is not null").select("page", F.col("claim_id").alias("id"), F.col("resolution").alias("_a")).dropDuplicates(["page", "id"])
    by_text = done.select("page", F.col("claim_text").alias("text"), F.col("resolution").alias("_b")).dropDuplicates(["page", "text"])
    both = claims.join(by_id, ["page", "id"], "left").join(by_text, ["page", "text"], "left").withColumn("_r", F.coalesce("_a", "_b"))
    kept = (F.col("_r") == "accept") & F.col("status").eqNullSafe("user-stated")
    status = (
        F.when(kept, F.col("status")).when(F.col("_r") == "accept", "verified").when(F.col("_r") == "reject", "rejected").when(F.col("_r") == "supersede", "superseded").otherwise(F.col("status"))
    )
    support = F.when((F.col("_r") == "accept") & ~kept, F.greatest(F.coalesce("support", F.lit(0.0)), F.lit(0.8))).otherwise(F.col("support"))
    new = {"status": status, "support": support, "reviewed": F.lit(today)}
    return both.select(*[F.when(F.col("_r").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in claims.columns])


def not_survived(before: DataFrame, after: DataFrame, resolved: DataFrame) -> DataFrame:
    """(page, id, expected, status): reviewed claims that, read back after writing, lack the status they should have."""
    want = apply_reviews(before, resolved, "").where("reviewed = ''").select("page", "id", F.col("status").alias("expected"))
    both = want.join(after.select("page", "id", "status"), ["page", "id"], "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("status")))


def review_criticality(grounded: Column) -> Column:
    """How critical a claim's review is: the less it is grounded, the more."""
    return F.greatest(F.lit(0.3), 1 - grounded)


def lint_criticality(finding: Column, confidence: Column) -> Column:
    """How critical what a check of the collection found is."""
    return F.when(finding == "unbacked_claim", 0.45).when(finding == "duplicate", 0.5).when(finding == "contradiction", F.greatest(F.lit(0.7), confidence))


def sync_updates(impacts: DataFrame, commit: str) -> DataFrame:
    """(page, id, status, superseded_by, kind, criticality): what a judged change does to the claims it touches.

    ``impacts``: page, id, status, impact, still_true. Claims without impact keep their status and start no review.
    """
    impact, doubt = F.coalesce("impact", F.lit("needs_recheck")), 1 - F.coalesce("still_true", F.lit(0.5))
    return impacts.select(
        "page",
        "id",
        F.when(impact == "needs_recheck", "needs_recheck").when(impact == "supersede", "superseded").when(impact == "contradict", "disputed").otherwise(F.col("status")).alias("status"),
        F.when(impact == "supersede", F.lit(f"commit {commit[:7]}")).alias("superseded_by"),
        F.when(impact == "contradict", "dispute").when(impact.isin("needs_recheck", "supersede"), "needs_recheck").alias("kind"),
        F.when(impact == "contradict", F.greatest(F.lit(0.85), doubt)).when(impact.isin("needs_recheck", "supersede"), F.greatest(F.lit(0.4), doubt)).alias("criticality"),
    )


def synced_status(status: Column, still_true: Column, replaced: Column, least: float = 0.5) -> tuple[Column, Column]:
    """(status, criticality) of a claim whose files changed: superseded, disputed, to be rechecked, or as it was."""
    contradicted = still_true < 1 - least
    out = F.when(replaced >= least, "superseded").when(contradicted, "disputed").when(still_true < 0.8, "needs_recheck").otherwise(status)
    criticality = F.when(contradicted, F.greatest(F.lit(0.85), 1 - still_true)).otherwise(F.greatest(F.lit(0.4), 1 - still_true))
    return out, criticality


def apply_to_claims(claims: DataFrame, updates: DataFrame) -> DataFrame:
    """``claims`` with the columns of ``updates`` (by id) where it has a row."""
    changed = [c for c in updates.columns if c != "id"]
    both = claims.alias("c").join(updates.alias("u"), "id", "left")
    return both.select(*[F.coalesce(F.col(f"u.{c}"), F.col(f"c.{c}")).alias(c) if c in changed else F.col("id") if c == "id" else F.col(f"c.{c}").alias(c) for c in claims.columns])


def writer_groups(claims: DataFrame) -> DataFrame:
    """Claims gathered for one page: by target, else by page type and topic. The key, the number, the worst criticality."""
    key = F.coalesce(F.col("target"), F.concat_ws(":", "page_type", "topic"))
    return claims.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("criticality").alias("worst"), F.array_sort(F.collect_list("id")).alias("ids"))
