"""The flows that change a collection, as tables in and tables out: ingest, insights, finalize, sync, lint with fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loreweave.functions.formats import truncated_text
from loreweave.functions.redact import findings, redact
from loreweave.functions.text import markdown_links, normalize_newlines, token_set
from loreweave.session import cut

from . import catalog, curation, evidence, ledger, lint, similarity

#: Columns of a review item.
REVIEW = ("id", "kind", "page", "claim_id", "claim_text", "criticality", "reason", "status")


def taken_in(sources: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new sources, redaction rows): newlines made plain, secrets redacted, told apart by hash.

    ``sources``: path, title, text; ``known``: sha. Sources that are known, or repeat, are left out.
    """
    plain = normalize_newlines(F.col("text"))
    clean = sources.withColumn("_found", findings(plain)).withColumn("text", redact(plain)).withColumn("sha", F.sha2("text", 256))
    new = clean.dropDuplicates(["sha"]).join(known.select("sha"), "sha", "left_anti")
    total = sum(F.col(f"_found.{f.name}") for f in clean.schema["_found"].dataType.fields)
    redacted = new.where(total > 0).select(F.lit("code").alias("actor"), F.lit("ingest.redact").alias("op"), F.substring("title", 1, 80).alias("subject"), F.lit("redacted").alias("action"), F.to_json("_found").alias("verdict"))
    return new.drop("_found"), redacted


def decided(judged: DataFrame, rules: curation.Rules = curation.Rules()) -> DataFrame:
    """Judged claims with action, score, reasons and remedy."""
    action, score = curation.decide(rules)
    rows = judged.withColumn("action", action).withColumn("score", score).withColumn("reasons", curation.reasons(rules))
    return rows.withColumn("remedy", ledger.remedy(F.col("action"), F.col("kind"), F.col("importance_norm")))


def placed(rows: DataFrame, fits: DataFrame, claims: DataFrame, least: float = 0.4) -> DataFrame:
    """Decided claims with their target page: the tournament's winner, or for one that reinforces without a winner the page
    of the claim that it overlaps most (merge_into names that claim).

    ``rows``: id, text, action; ``fits``: see ``curation.tournament``; ``claims``: id, page, text.
    """
    wanted = rows.where(F.col("action").isin("file", "reinforce")).select(F.col("id").alias("claim_id"))
    won = curation.tournament(fits.join(wanted, "claim_id", "left_semi")).select(F.col("claim_id").alias("id"), "target")
    both = rows.join(won, "id", "left")
    lost = both.where((F.col("action") == "reinforce") & F.col("target").isNull())
    asked = lost.select(F.col("id").alias("query_id"), token_set(F.col("text")).alias("tokens"))
    near = similarity.best_match(asked, claims.select("id", token_set(F.col("text")).alias("tokens")), least)
    pages = claims.select("id", F.col("page").alias("_page"))
    met = near.join(pages, "id").select(F.col("query_id").alias("_q"), F.col("id").alias("merge_into"), "_page")
    return both.join(met, F.col("id") == F.col("_q"), "left").withColumn("target", F.coalesce("target", "_page")).drop("_q", "_page")


def to_review(rows: DataFrame) -> DataFrame:
    """Review items of decided claims: those to be reviewed, and disputes for those that contradict. ``rows``: with target."""
    because = F.array_join("reasons", "; ")
    unsure = rows.where("action = 'review'").select(
        F.concat(F.lit("review-"), F.col("id").cast("string")).alias("id"), F.lit("claim_review").alias("kind"), F.col("target").alias("page"), F.lit(None).cast("string").alias("claim_id"), F.col("text").alias("claim_text"),
        curation.review_criticality(F.col("grounded")).alias("criticality"), because.alias("reason"), F.lit("open").alias("status"),
    )
    disputed = rows.where("relation = 'contradicts'").select(
        F.concat(F.lit("dispute-"), F.col("id").cast("string")).alias("id"), F.lit("dispute").alias("kind"), F.col("target").alias("page"), F.lit(None).cast("string").alias("claim_id"), F.col("text").alias("claim_text"),
        F.lit(0.8).alias("criticality"), F.lit("contradicts existing wiki knowledge").alias("reason"), F.lit("open").alias("status"),
    )
    return unsure.unionByName(disputed)


def ledger_rows(rows: DataFrame, op: str, now: str) -> DataFrame:
    """Two ledger rows for each decided claim: what the judge said, and what the rules made of it."""
    because, subject = F.array_join("reasons", "; "), F.substring("text", 1, 120)
    verdicts = F.to_json(F.struct(*[c for c in ("grounded", "derivable", "durable", "sensitive", "importance_norm", "relation", "trust_tier") if c in rows.columns]))
    fixed = [F.lit(now).alias("ts"), subject.alias("subject"), F.col("action"), because.alias("reason")]
    said = rows.select(F.lit("judge").alias("actor"), F.lit(f"{op}.adjudicate").alias("op"), *fixed, verdicts.alias("verdict"))
    made = rows.select(F.lit("code").alias("actor"), F.lit(f"{op}.decide").alias("op"), *fixed, F.to_json(F.struct("score", "target")).alias("verdict"))
    return said.unionByName(made)


def ingest(sources: DataFrame, known: DataFrame, extract, judge, fits: DataFrame, claims: DataFrame, now: str) -> dict[str, DataFrame]:
    """A source's way into a collection: redact, tell apart, extract, judge, decide, place; a table for each sink.

    ``extract``: from sources (path, title, text) to claims (id, source, text, kind, quote, files); ``judge``: adds the
    columns that the rules read; ``fits``: claim_id, position, page, fit, final_fit; ``claims``: id, page, text.
    """
    new, redacted = taken_in(sources, known)
    rows = placed(decided(judge(extract(new))), fits, claims)
    return {"raw": new.select("path", "title", "text", "sha"), "claims": rows, "reviews": to_review(rows), "ledger": ledger_rows(rows, "ingest", now), "redactions": redacted, "brief": ledger.brief(rows)}


def insights(found: DataFrame, judge, fits: DataFrame, claims: DataFrame, log: DataFrame, today: str) -> dict[str, DataFrame]:
    """A session's insights: judge, decide, place, then confirm or supersede claims; a table for each sink.

    ``found``: id, text, kind, files (evidence) and what ``judge`` needs; ``claims``: id, page, text, status, support,
    corroborations, last_confirmed, evidence, superseded_by, superseded_at; ``log``: key, ord, text, accepted, promoted
    (the sessions' log, whose recurring texts are promoted).
    """
    rows = placed(decided(judge(found)), fits, claims.select("id", "page", "text"))
    own = claims.withColumn("tokens", token_set(F.col("text")))
    told = rows.withColumn("tokens", token_set(F.col("text"))).withColumn("page", F.col("target")).withColumn("evidence", F.col("files"))
    met = told.where(F.col("action").isin("file", "reinforce") & F.col("target").isNotNull()).select(F.col("id").alias("query_id"), "page", "tokens", "evidence")
    after = curation.reinforce(own, met, today)
    newer = told.where("relation = 'supersedes'").select(F.col("id").alias("query_id"), "tokens", "text")
    at = similarity.best_match(newer, own.select("id", "tokens"), 0.4).join(own.select("id", "page"), "id").select("query_id", "page")
    after = curation.supersede(after, newer.join(at, "query_id"), today).drop("tokens")
    promoted = similarity.promote_recurring(log.withColumn("tokens", token_set(F.col("text"))))
    return {"claims": rows, "pages": after, "reviews": to_review(rows), "ledger": ledger_rows(rows, "insight", today), "promoted": promoted, "brief": ledger.brief(rows)}


def finalize(touched: DataFrame, pages: DataFrame, toc: DataFrame, overrides: DataFrame, today: str) -> dict[str, DataFrame]:
    """After pages were written: their rows of the contents, their broken links, and overrides for the ledger.

    ``touched``: path; ``pages``: path, title, type, summary, updated, text; ``overrides``: text, reason, advised.
    A touched page that doesn't exist is reported as missing.
    """
    own = pages.join(touched, "path", "left_semi")
    entries = lint.toc_entry(own, today)
    links = lint.resolved_links(own.select(F.col("path").alias("page"), F.explode(markdown_links(F.col("text"))).alias("link")))
    gone = touched.join(pages.select("path"), "path", "left_anti").select(F.col("path").alias("page"), F.lit(None).cast("string").alias("target"))
    noted = overrides.select(F.lit("agent").alias("actor"), F.lit("wiki.override").alias("op"), F.lit("override").alias("action"), F.substring("text", 1, 120).alias("subject"), "reason", F.to_json(F.struct("advised")).alias("verdict"))
    return {"toc": catalog.union_keep_last(toc.select(*entries.columns), entries, "path"), "broken": lint.broken_links(links, pages.select("path")).unionByName(gone), "ledger": noted}


def sync(claims: DataFrame, changed: DataFrame, judge, commit: str, today: str, most: int = 40) -> dict[str, DataFrame]:
    """Claims whose files changed, judged: their new status, reviews to open, ledger rows.

    ``claims``: id, page, text, status, files, superseded_by, last_checked; ``changed``: path; ``judge`` adds impact and still_true.
    """
    touched = claims.join(evidence.affected_claims(claims, changed, most), "id", "left_semi")
    judged = judge(touched)
    new = curation.sync_updates(judged, commit)
    said = new.select("id", "status", "superseded_by").withColumn("last_checked", F.lit(today))
    after = curation.apply_to_claims(claims, said)
    both = new.where("kind is not null").join(claims.select("id", F.col("text").alias("claim_text")), "id")
    reviews = both.select(F.concat(F.lit("sync-"), F.col("id").cast("string")).alias("id"), "kind", "page", F.col("id").cast("string").alias("claim_id"), "claim_text", "criticality", F.lit("code changed").alias("reason"), F.lit("open").alias("status"))
    rows = judged.select(F.lit("judge").alias("actor"), F.lit("sync.impact").alias("op"), F.concat_ws("#", "page", F.col("id").cast("string")).alias("subject"), F.col("impact").alias("action"), F.to_json(F.struct("impact", "still_true")).alias("verdict"))
    return {"claims": after, "reviews": reviews, "ledger": rows}


def check(pages: DataFrame, toc: DataFrame, claims: DataFrame, raw: DataFrame, log: DataFrame, today: str, judge=None, accept: float = 0.8, same: float = 0.8) -> dict[str, DataFrame]:
    """All checks of a collection, and what they mend: findings, the mended contents and claims, reviews to open, counts.

    ``pages``: path, title, type, summary, updated, text; ``claims``: id, page, text, status, files, support; ``raw``:
    path; ``log``: the ledger (actor, op, action, subject, outcome, reason). ``judge`` adds relation and confidence to
    contradiction candidates and merge to duplicate candidates (rows: finding, a, b); without it these stay candidates.
    """
    own = pages.where(~lint.is_meta(F.col("path")))
    links = lint.resolved_links(own.select(F.col("path").alias("page"), F.explode(markdown_links(F.col("text"))).alias("link"))).distinct()
    active = claims.where(curation.is_active(F.col("status"), "lint") & F.col("text").isNotNull())
    accepted = log.where(F.col("subject").isNotNull() & (((F.col("actor") == "code") & F.col("action").isin("file", "reinforce", "file_user_stated")) | ((F.col("op") == "wiki.override") & (F.col("action") == "override"))))
    said = log.select(F.explode(F.array("subject", "outcome", "reason")).alias("text")).where("text is not null")
    asked = active.select("id", "text", "page", F.col("id").cast("string").alias("claim_id"))
    unbacked = evidence.unbacked_claims(asked, accepted.select("subject"), mentions=said)
    rows = active.withColumn("tokens", token_set(F.col("text")))
    pairs = similarity.contradiction_candidates(rows.select("id", "page", "files", "tokens")).withColumn("finding", F.lit("contradiction"))
    pairs = pairs.unionByName(similarity.duplicate_candidates(rows.select("id", "page", "tokens")).select("a", "b").withColumn("finding", F.lit("duplicate")))
    none = F.lit(None).cast("string")
    reconciled = lint.reconcile(own, toc)
    parts = [
        reconciled.select(F.concat(F.lit("toc_"), "finding").alias("finding"), "path", none.alias("detail")),
        lint.broken_links(links, pages.select("path")).select(F.lit("broken_link").alias("finding"), F.col("page").alias("path"), F.col("target").alias("detail")),
        lint.orphans(own, links, today).select(F.lit("orphan").alias("finding"), "path", none.alias("detail")),
        lint.backlog(raw, own).select(F.lit("raw_backlog").alias("finding"), "path", none.alias("detail")),
        active.join(unbacked, "id", "left_semi").select(F.lit("unbacked_claim").alias("finding"), F.col("page").alias("path"), F.col("id").cast("string").alias("detail")),
        pairs.join(active.select(F.col("id").alias("a"), F.col("page").alias("path")), "a").select("finding", "path", F.concat_ws(" / ", F.col("a").cast("string"), F.col("b").cast("string")).alias("detail")),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # counted while they are written: each check runs once
    kinds = ("toc_added", "toc_missing_file", "toc_updated", "broken_link", "orphan", "raw_backlog", "unbacked_claim", "contradiction", "duplicate")
    seen = Observation()
    found = cut(found.observe(seen, *[F.count_if(F.col("finding") == k).alias(k) for k in kinds]))
    counts = found.sparkSession.createDataFrame([(k, seen.get[k]) for k in kinds], "finding string, n long")
    entries = lint.toc_entry(own.join(reconciled.where("finding in ('added', 'updated')").select("path"), "path", "left_semi"), today)
    mended = catalog.union_keep_last(toc.select(*[c for c in entries.columns if c in toc.columns]), entries.select(*[c for c in entries.columns if c in toc.columns]), "path")
    item = lambda df, kind, finding, reason, confidence: df.join(claims.select("id", "page", F.col("text").alias("claim_text")), "id").select(
        F.concat(F.lit(f"{finding}-"), F.col("id").cast("string")).alias("id"), F.lit(kind).alias("kind"), "page", F.col("id").cast("string").alias("claim_id"), "claim_text", curation.lint_criticality(F.lit(finding), confidence).alias("criticality"), F.lit(reason).alias("reason"), F.lit("open").alias("status")
    )
    reviews = item(unbacked.withColumn("c", F.lit(0.0)), "claim_review", "unbacked_claim", "lint: no accepted ledger entry backs this claim", F.col("c"))
    after = claims
    if judge is not None:
        told = judge(pairs)
        sure = told.where((F.col("finding") == "contradiction") & (F.col("relation") == "contradicts") & (F.col("confidence") >= accept))
        sides = sure.select(F.explode(F.array("a", "b")).alias("id"), F.col("confidence").alias("c")).groupBy("id").agg(F.max("c").alias("c"))
        after = curation.apply_to_claims(claims, sides.select("id", F.lit("disputed").alias("status")))
        again = told.where((F.col("finding") == "duplicate") & (F.col("merge") >= same)).select(F.col("a").alias("id"), F.col("merge").alias("c")).groupBy("id").agg(F.max("c").alias("c"))
        reviews = reviews.unionByName(item(sides, "dispute", "contradiction", "lint: contradicts another page", F.col("c"))).unionByName(item(again, "claim_review", "duplicate", "possible duplicate", F.col("c")))
    return {"findings": found, "toc": mended, "claims": after, "reviews": reviews, "counts": counts}


def shown_hits(hits: DataFrame, most: int = 700) -> DataFrame:
    """Hits as a judge gets them: numbered, with the first ``most`` characters of their excerpts."""
    return hits.withColumn("candidate", F.concat(F.lit("c"), F.col("rank").cast("string"))).withColumn("excerpt", F.substring("excerpt", 1, most))


def brief_text(rows: DataFrame, most: int = 160) -> DataFrame:
    """A brief's lines in order: what to file, reinforce, review, and not to add. (part, line)."""
    text, why = truncated_text(F.col("text"), most), F.array_join("reasons", "; ")
    action = F.col("action")
    part = F.when(action.isin("file", "file_user_stated"), 1).when(action == "reinforce", 2).when(action == "review", 3).otherwise(4)
    where = F.when(F.col("target").isNotNull(), F.concat(F.lit("merge → `"), "target", F.lit("`"))).otherwise(F.concat(F.lit("new page ("), F.coalesce("page_type", F.lit("concept")), F.lit(")")))
    line = F.when(part == 1, F.concat(F.lit("- "), where, F.lit(" — "), text)).when(part == 2, F.concat(F.lit("- "), F.coalesce("target", F.lit("existing page")), F.lit(" — "), text))
    line = line.when(part == 3, F.concat(F.lit("- "), text, F.lit(" — "), why)).otherwise(F.concat(F.lit("- ["), F.replace(action, F.lit("reject_"), F.lit("")), F.lit("] "), text, F.lit(" — "), why))
    return rows.select(part.alias("part"), line.alias("line"))
