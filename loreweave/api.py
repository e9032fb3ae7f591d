"""The entry points of a knowledge base as functions over DataFrames: ask, contents, ingest, insights, sync, lint and more.

Tables come in as DataFrames and results go out as DataFrames; nothing is collected but what a parameter bounds.
External models are columns: an extractor, a judge or a writer is a function from a table to a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave import config
from loreweave.functions.redact import findings, redact
from loreweave.functions.text import html_links, markdown_links, normalize_newlines, token_set, tokenize
from loreweave.models import Embedder, HashingEmbedder, embed
from loreweave.operators import catalog as cat
from loreweave.operators import chunking, curation, evidence, fusion, ledger, lexical, lint, postings, sessions, similarity, vector, workflow

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Defaults:
    """Limits of the entry points (fixed default values)."""

    limit: int = 5
    most: int = 10
    sufficiency: float = 0.5
    candidates: int = 8
    orphan_days: int = 7
    budget: int = 3200
    embedder: HashingEmbedder = HashingEmbedder()


D = Defaults()


def wiki_ask(pages: DataFrame, queries: DataFrame, limit: int = D.limit, search: str = "auto", chunks: DataFrame | None = None, toc: DataFrame | None = None, judge: Step | None = None, rerank: str = "auto", embedder: Embedder = D.embedder) -> DataFrame:
    """Ranked hits of each query. ``search``: keyword (index search), bm25, semantic, hybrid, or auto.

    ``pages``: path, title, rest, text (with ``toc``, the contents, path and text are enough); ``queries``: query_id,
    query; ``chunks``: as a chunk store holds them, embedded by ``embedder`` (path, key, kind, claim_id, status, embedding), or
    with an anchor of their own. With a ``judge`` (it adds relevance to each hit shown, and
    sufficiency to each query) hits carry excerpt, relevance, sufficiency and note, and are reranked always, never, or
    where vectors took part (auto).
    """
    limit = max(1, min(limit, D.most))
    if toc is not None:
        pages = lint.with_contents(pages, toc)
    if search == "auto":
        search = "hybrid" if chunks is not None else "bm25"
    hits = _hits(pages, queries, limit, search, chunks, embedder)
    if judge is None:
        return hits
    return judged_hits(pages, queries, hits, judge, rerank == "always" or (rerank == "auto" and search in ("semantic", "hybrid")))


def _hits(pages: DataFrame, queries: DataFrame, limit: int, search: str, chunks: DataFrame | None, embedder: Embedder) -> DataFrame:
    if search == "keyword":
        return lexical.index_search(pages, queries, limit)
    wide = max(limit, 3 * limit)
    if search != "semantic" or chunks is None:
        lex = lexical.bm25(pages, queries, wide)
    if search == "bm25" or chunks is None:
        return lex.where(F.col("rank") <= limit)
    active = chunks.where(curation.is_active(F.col("status"), "search"))
    if "anchor" not in active.columns:
        active = active.withColumn("anchor", chunking.anchor(F.col("key"), F.col("kind"), F.col("claim_id")))
    asked = embed(queries.withColumn("text", F.col("query")), embedder).select("query_id", "embedding")
    # a chunk's key is its own within its page only
    keyed = active.withColumn("key", F.concat_ws("\0", "path", "key"))
    # few hits go to the chunks: else the keys of all chunks would move to them
    near = vector.knn(keyed, asked, wide)
    near = keyed.select("key", "path", "anchor").join(F.broadcast(near) if queries.count() * wide <= postings.WANTED else near, "key")
    near = near.select("query_id", "path", "anchor", F.expr("substring(key, length(path) + 2)").alias("key"), "rank", "score")
    if search == "semantic":
        return near.where(F.col("rank") <= limit)
    return fusion.rrf(lex, near.select("query_id", "path", "anchor", "rank"), limit)


def judged_hits(pages: DataFrame, queries: DataFrame, hits: DataFrame, judge: Step, reranked: bool, least: float = D.sufficiency) -> DataFrame:
    """Hits with their excerpts, judged: the first ``Defaults.candidates`` of each query go to the judge, the others count
    as neutral; a note says where the evidence may not suffice."""
    asked = queries.select("query_id", "query", tokenize(F.col("query")).alias("_tokens"))
    shown = hits.join(pages.select("path", "text"), "path", "left").join(asked, "query_id")
    shown = shown.withColumn("excerpt", lexical.excerpt(F.coalesce("text", F.lit("")), F.col("_tokens"))).drop("text", "_tokens")
    told = judge(workflow.shown_hits(shown.where(F.col("rank") <= D.candidates))).select("query_id", "rank", "relevance", "sufficiency")
    by_query = told.groupBy("query_id").agg(F.max("sufficiency").alias("sufficiency"))
    all_ = shown.join(told.select("query_id", "rank", "relevance"), ["query_id", "rank"], "left").join(by_query, "query_id", "left")
    noted = all_.withColumn("note", F.when(F.col("sufficiency") < least, F.format_string("Evidence may be insufficient (%.2f): the wiki may not cover this yet.", "sufficiency")))
    return fusion.rerank(noted).withColumn("rank", F.col("judged_rank")).drop("judged_rank") if reranked else noted


def wiki_brief(hits: DataFrame, limit: int = 6, budget: int = D.budget, least: float = D.sufficiency) -> DataFrame:
    """What goes before an agent's turn unasked: judged hits of queries with enough evidence, one a page, within a budget
    of characters; nothing for queries that nobody judged. ``hits``: from ``wiki_ask`` with a judge."""
    enough = hits.select("query_id", "sufficiency").distinct()
    passed = fusion.one_per_page(fusion.gate(hits, enough, least))
    return fusion.within_budget(passed.where(F.col("rank") <= limit), budget)


def wiki_toc(toc: DataFrame, topic: str | None = None, tag: str | None = None, query: str | None = None) -> DataFrame:
    return lint.toc_filter(toc, topic, tag, query)


def wiki_status(pages: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, ledger summary)."""
    return lint.topic_counts(pages), ledger.summary(rows)


def wiki_ingest(sources: DataFrame, known: DataFrame) -> DataFrame:
    """New sources only: newlines made plain, secrets redacted, told apart by hash. ``sources``: path, text; ``known``: sha."""
    clean = sources.withColumn("text", redact(normalize_newlines(F.col("text")))).withColumn("sha", F.sha2("text", 256))
    return clean.dropDuplicates(["sha"]).join(known.select("sha"), "sha", "left_anti").withColumn("findings", findings(F.col("text")))


def wiki_ingest_claims(sources: DataFrame, known: DataFrame, extract: Step, judge: Step, fits: DataFrame, claims: DataFrame, now: str) -> dict[str, DataFrame]:
    """The whole way of new sources to judged and placed claims, a table for each sink; see ``workflow.ingest``."""
    return workflow.ingest(sources, known, extract, judge, fits, claims, now)


def wiki_insights(judged: DataFrame) -> DataFrame:
    """Judged claims with action, score, reasons and suggested remedy."""
    return workflow.decided(judged)


def wiki_capture(found: DataFrame, judge: Step, fits: DataFrame, claims: DataFrame, log: DataFrame, today: str) -> dict[str, DataFrame]:
    """A session's insights judged, placed, and worked into the claims; see ``workflow.insights``."""
    return workflow.insights(found, judge, fits, claims, log, today)


def wiki_finalize(pages: DataFrame, toc: DataFrame, today: str, touched: DataFrame | None = None, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(contents with the touched pages' rows in place, broken links); all pages count as touched if none are named.

    With ``overrides`` (text, reason, advised) a third table holds their ledger rows.
    """
    spark = pages.sparkSession
    noted = overrides if overrides is not None else spark.createDataFrame([], "text string, reason string, advised string")
    out = workflow.finalize(touched if touched is not None else pages.select("path"), pages, toc, noted, today)
    return (out["toc"], out["broken"]) if overrides is None else (out["toc"], out["broken"], out["ledger"])


def wiki_sync(claims: DataFrame, changed: DataFrame, judge: Step | None = None, commit: str = "", today: str = "") -> DataFrame | dict[str, DataFrame]:
    """Claims that changed files touch; with a ``judge`` (impact, still_true) what becomes of them, see ``workflow.sync``."""
    return evidence.affected_claims(claims, changed) if judge is None else workflow.sync(claims, changed, judge, commit, today)


def wiki_review(items: DataFrame, limit: int = 50) -> DataFrame:
    return curation.review_queue(items, max(1, min(limit, 200)))


def wiki_resolve(items: DataFrame, wanted: DataFrame, claims: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, claims, ledger rows) after resolutions (id, resolution, note, confirmed): critical items wait for a person."""
    after = curation.resolve_reviews(items, wanted, now)
    done = after.join(wanted.select("id"), "id", "left_semi").where("status = 'resolved'")
    claims = curation.apply_reviews(claims, done, now[:10])
    rows = done.select(F.lit("agent").alias("actor"), F.lit("wiki.review").alias("op"), F.col("id").cast("string").alias("subject"), F.col("resolution").alias("action"), F.col("note").alias("reason"))
    filed = done.where("resolution = 'accept'").select(F.lit("code").alias("actor"), F.lit("wiki.review.accept").alias("op"), F.substring("claim_text", 1, 120).alias("subject"), F.lit("file").alias("action"), F.col("note").alias("reason"))
    return after, claims, rows.unionByName(filed)


def wiki_lint(pages: DataFrame, toc: DataFrame, today: str, html: bool = False) -> DataFrame:
    """(finding, path, detail) of contents, links and orphans. ``pages``: path, updated, summary, text."""
    found = (html_links if html else markdown_links)(F.col("text"))
    links = lint.resolved_links(pages.select(F.col("path").alias("page"), F.explode(found).alias("link"))).distinct()
    none = F.lit(None).cast("string")
    parts = [
        lint.reconcile(pages, toc).select(F.concat(F.lit("toc_"), "finding").alias("finding"), "path", none.alias("detail")),
        lint.broken_links(links, pages.select("path")).select(F.lit("broken_link").alias("finding"), F.col("page").alias("path"), F.col("target").alias("detail")),
        lint.orphans(pages, links, today, D.orphan_days).select(F.lit("orphan").alias("finding"), "path", none.alias("detail")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def wiki_lint_all(pages: DataFrame, toc: DataFrame, claims: DataFrame, raw: DataFrame, log: DataFrame, today: str, judge: Step | None = None) -> dict[str, DataFrame]:
    """All checks with what they mend: findings, contents, claims, reviews, counts; see ``workflow.check``."""
    return workflow.check(pages, toc, claims, raw, log, today, judge)


def wiki_lint_claims(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(duplicate candidates, contradiction candidates). ``claims``: id, page, text, files."""
    rows = claims.withColumn("tokens", token_set(F.col("text")))
    return similarity.duplicate_candidates(rows), similarity.contradiction_candidates(rows)


def wiki_remove(pages: DataFrame, toc: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    return pages.join(paths, "path", "left_anti"), toc.join(paths, "path", "left_anti")


def wiki_structure(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Modules of code files with what they import. ``files``: path; ``imports``: path, spec."""
    return lint.modules(files, lint.import_edges(imports, files))


def wiki_index(pages: DataFrame, claims: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, key, action) of an incremental refresh."""
    return chunking.index_diff(chunking.chunks(pages, claims), stored)


class Index:
    """The index over registered collections: its store, and what can be done with it, an action each.

    There is no embedding process to stop or restart: embedders live in the tasks that use them.
    """

    def __init__(self, store, registry: DataFrame, embedder: HashingEmbedder = D.embedder) -> None:
        self.store, self.registry, self.embedder = store, registry, embedder

    def status(self) -> DataFrame:
        """Enabled collections with their chunks, whether their index is missing, or stale (of another embedder)."""
        state = self.store.state().select("wiki", "chunks", "fingerprint")
        return chunking.index_status(self.registry.select(F.col("name").alias("wiki"), "enabled"), state, self.embedder.fingerprint())

    @staticmethod
    def model(project: Mapping[str, Any] | None, user: Mapping[str, Any] | None) -> tuple[str, str]:
        """(model, where the choice comes from)."""
        return config.model_choice(project, user)

    def discover(self, roots: list[str], **limits) -> DataFrame:
        """What stands under the roots, beside what is registered and indexed."""
        from loreweave.sources import discover

        found = discover.scan(self.store.spark, roots, **limits)
        return discover.discovered(found, self.registry, self.store.state().select(F.col("wiki").alias("name"), "chunks", "model", "updated_at"))

    def rebuild(self, wiki: str, pages: DataFrame, claims: DataFrame | None, now: str, paths: list[str] | None = None) -> DataFrame:
        """Embed what is new or changed, drop what is gone, and note the state: (action, n).

        With ``paths`` only those pages are looked at, and only if the index is warm.
        """
        mark = self.embedder.fingerprint()
        if paths is not None and not self.store.warm(wiki, mark):
            return pages.sparkSession.createDataFrame([], "action string, n long")
        now_ = chunking.chunks(pages, claims)
        todo = chunking.index_diff(now_, self.store.hashes(wiki, mark), paths).checkpoint()
        new = now_.join(todo.where("action = 'embed'").select("path", "key"), ["path", "key"], "left_semi")
        fixed = {"wiki": wiki, "fingerprint": mark, "model": type(self.embedder).__name__, "updated_at": now}
        rows = embed(new, self.embedder).withColumns({c: F.lit(v) for c, v in fixed.items()}).withColumn("dim", F.lit(self.embedder.dims))
        gone = todo.where("action = 'remove'").select(F.lit(wiki).alias("wiki"), F.lit(mark).alias("fingerprint"), "path", "key")
        held = now_ if paths is None else self.store.hashes(wiki, mark).join(todo.where("action = 'remove'"), ["path", "key"], "left_anti").select("path", "key").union(new.select("path", "key")).distinct()
        state = held.agg(F.count(F.lit(1)).alias("chunks")).select(F.lit(wiki).alias("wiki"), F.lit(mark).alias("fingerprint"), F.lit(fixed["model"]).alias("model"), F.lit(self.embedder.dims).alias("dim"), "chunks", F.lit(now).alias("updated_at"))
        others = [k for k in self.store.table.latest().parts if k[0] == wiki and k[1] != mark]
        self.store.apply(rows, gone, others, state)  # chunks, removals and state in one transaction
        return todo.groupBy("action").agg(F.count(F.lit(1)).alias("n"))

    def reset(self) -> None:
        """All chunks of all collections gone."""
        for r in self.store.read().select("wiki").distinct().collect():  # a row for each collection
            self.store.purge(r["wiki"])

    def add(self, roots: DataFrame, now: str) -> DataFrame:
        self.registry = cat.register(self.registry, roots, now)
        return self.registry

    def remove(self, names: list[str]) -> DataFrame:
        self.registry = cat.unregister(self.registry, names)
        return self.registry

    def enable(self, names: list[str], enabled: bool = True) -> DataFrame:
        self.registry = cat.set_enabled(self.registry, names, enabled)
        return self.registry


def wiki_catalog(registry: DataFrame, manifests: DataFrame, states: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    return cat.catalog(registry, manifests, states, limit, offset)


def wiki_doctor(index: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw sources that are missing or have drifted."""
    return lint.integrity(index, raw)


def wiki_health(settings: Mapping[str, Any], index: DataFrame, raw: DataFrame, files: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(checks, their counts): settings, raw sources, and temporary files left behind. ``files``: see ``sources.files``."""
    from loreweave.sources.files import stale_temporary

    wrong = config.invalid(settings)
    odd, left = lint.integrity(index, raw).agg(F.count(F.lit(1)).alias("n")), stale_temporary(files, now_ms).agg(F.count(F.lit(1)).alias("n"))
    first = index.sparkSession.createDataFrame([("config values", "fail" if wrong else "ok", ", ".join(wrong))], "name string, status string, detail string")
    row = lambda df, name, bad: df.select(F.lit(name).alias("name"), F.when(F.col("n") > 0, bad).otherwise("ok").alias("status"), F.concat(F.col("n").cast("string"), F.lit(" found")).alias("detail"))
    checks = first.unionByName(row(odd, "raw sources", "fail")).unionByName(row(left, "temporary files", "warn"))
    return checks, config.check_counts(checks)


def wiki_triage(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(separation statistics, whether accepted and rejected overlap)."""
    stats = ledger.triage(rows)
    return stats, ledger.overlaps(stats)


def wiki_eval(messages: DataFrame) -> DataFrame:
    """Labelled episodes of session messages."""
    return sessions.labelled(sessions.episodes(messages))


def wiki_project(messages: DataFrame, calls: DataFrame, retrieval: DataFrame, roots: tuple[str, ...], episodes: int = 0) -> dict[str, DataFrame]:
    """A project's sessions as tables: episodes with their measures, totals, models, summary.

    ``calls``: session, ord, at, name, args, chars, is_error; see ``sessions`` for the rest. ``episodes``: how many of
    the costliest are shown (0: all); totals cover every one.
    """
    own = sessions.episode_metrics(messages, sessions.classified(calls, roots))
    eps = sessions.labelled(sessions.episodes(messages)).join(own.drop("requests"), ["session", "episode"])
    total = sessions.analysis(own, retrieval)
    shown = sessions.costliest(eps, episodes)
    return {"episodes": shown, "totals": total, "models": sessions.model_requests(messages), "summary": sessions.summary_row(total, shown)}
