"""Whole flows on small tables: ask, ingest, capture, finalize, sync, review, lint, index, health; models, settings, engines."""

import json

import pytest
from pyspark.sql import functions as F

from loreweave import api, config, models
from loreweave.models import HashingEmbedder, Unavailable
from loreweave.operators import catalog, curation, engines, harness, workflow
from loreweave.sources.store import ChunkStore

GOOD = dict(grounded=0.95, derivable=0.1, durable=0.9, sensitive=0.0, importance=2.0, importance_norm=0.7, already_known=0.0, relation="unrelated", trust_tier="inference")


def judge(**changes):
    """A judge that answers the same to all, but for texts that hold a word."""

    def run(rows):
        out = rows
        for name, value in GOOD.items():
            told = F.lit(value)
            for word, other in changes.items():
                if name in other:
                    told = F.when(F.contains("text", F.lit(word)), F.lit(other[name])).otherwise(told)
            out = out.withColumn(name, told)
        return out

    return run


def _claims(spark):
    rows = [(1, "a.md", "the parser reads tokens lazily", "verified", 0.8, 1), (2, "b.md", "the cache expires after ten minutes", "verified", 0.8, None), (3, "b.md", "the cache expires never", "rejected", 0.8, 1)]
    df = spark.createDataFrame(rows, "id long, page string, text string, status string, support double, corroborations int")
    none = F.lit(None).cast("string")
    return df.withColumns({"last_confirmed": none, "evidence": F.array(F.lit("old")), "superseded_by": none, "superseded_at": none, "files": F.array(F.lit("src/")), "last_checked": none})


FITS = "claim_id long, position int, page string, fit double, final_fit double"


def test_ingest_from_source_to_sinks(spark):
    sources = spark.createDataFrame([("s.md", "S", "one\r\npassword = abcdefghijklmnop1234"), ("t.md", "T", "two"), ("u.md", "U", "two")], "path string, title string, text string")

    def extract(new):
        return new.select(F.xxhash64("path").alias("id"), F.col("path").alias("source"), F.concat(F.lit("claim of "), "text").alias("text"), F.lit("fact").alias("kind"), F.lit(None).cast("string").alias("quote"), F.array().cast("array<string>").alias("files"))

    out = api.wiki_ingest_claims(sources, spark.createDataFrame([], "sha string"), extract, judge(two={"grounded": 0.75, "relation": "contradicts"}), spark.createDataFrame([], FITS), _claims(spark), "2026-02-01")
    assert sorted(r.path for r in out["raw"].collect()) in (["s.md", "t.md"], ["s.md", "u.md"])
    assert all("abcdefghijklmnop" not in r.text for r in out["raw"].collect())
    assert [(r.subject, json.loads(r.verdict)["generic_secret_assignment"]) for r in out["redactions"].collect()] == [("S", 1)]
    assert sorted(r.action for r in out["claims"].collect()) == ["file", "review"]
    assert sorted((r.kind, round(r.criticality, 2), r.reason) for r in out["reviews"].collect()) == [("claim_review", 0.3, "contradicts existing knowledge — dispute; below auto-accept threshold"), ("dispute", 0.8, "contradicts existing wiki knowledge")]
    assert out["ledger"].count() == 4 and out["brief"].head()["review"] == 1
    again = api.wiki_ingest_claims(sources, out["raw"].select("sha"), extract, judge(), spark.createDataFrame([], FITS), _claims(spark), "2026-02-01")
    assert again["raw"].count() == 0 and again["claims"].count() == 0
    lines = workflow.brief_text(out["claims"].withColumn("page_type", F.lit(None).cast("string"))).collect()
    assert sorted(r.part for r in lines) == [1, 3] and any(r.line.startswith("- new page (concept) — claim of one") for r in lines)


def test_capture_confirms_and_supersedes(spark):
    found = spark.createDataFrame([(1, "the parser reads its tokens lazily", "fact", ["f1"]), (2, "newer: the cache expires after five minutes", "fact", ["f2"])], "id long, text string, kind string, files array<string>")
    fits = spark.createDataFrame([(1, 1, "a.md", 0.9, 0.0)], FITS)
    log = spark.createDataFrame([("k", n, "again and again the same thing", False, False) for n in range(3)], "key string, ord long, text string, accepted boolean, promoted boolean")
    out = api.wiki_capture(found, judge(newer={"relation": "supersedes"}), fits, _claims(spark), log, "2026-02-01")
    pages = {r.id: r for r in out["pages"].collect()}
    assert (pages[1].corroborations, round(pages[1].support, 2), pages[1].last_confirmed, pages[1].evidence) == (2, 0.89, "2026-02-01", ["old", "f1"])
    assert (pages[2].status, pages[2].superseded_by) == ("superseded", "newer: the cache expires after five minutes") and pages[3].status == "rejected"
    assert [r["size"] for r in out["promoted"].collect()] == [3]
    assert {r.id: r.target for r in out["claims"].collect()}[1] == "a.md"


def test_a_claim_that_reinforces_finds_its_page_without_a_winner(spark):
    rows = spark.createDataFrame([(7, "the cache expires after twelve minutes", "reinforce"), (8, "nothing of the kind", "reinforce"), (9, "whatever", "review")], "id long, text string, action string")
    got = {r.id: (r.target, r.merge_into) for r in workflow.placed(rows, spark.createDataFrame([], FITS), _claims(spark)).collect()}
    assert got == {7: ("b.md", 2), 8: (None, None), 9: (None, None)}


def test_finalize_reviews_and_sync(spark):
    pages = spark.createDataFrame([("a.md", "A", None, "s", "2026-01-01", "[x](b.md) [y](gone.md)"), ("b.md", "B", "concept", "t", "2026-01-02", "")], "path string, title string, type string, summary string, updated string, text string")
    toc = spark.createDataFrame([("a.md", "old", "concept", "s", "2025-01-01"), ("z.md", "Z", "concept", "z", "2025-01-01")], "path string, title string, type string, summary string, updated string")
    touched = spark.createDataFrame([("a.md",), ("lost.md",)], "path string")
    noted = spark.createDataFrame([("a claim", "I know better", "reject_derivable")], "text string, reason string, advised string")
    contents, broken, ledger = api.wiki_finalize(pages, toc, "2026-02-01", touched, noted)
    assert sorted((r.path, r.title) for r in contents.collect()) == [("a.md", "A"), ("z.md", "Z")]
    assert sorted((r.page, r.target) for r in broken.collect()) == [("a.md", "gone.md"), ("lost.md", None)]
    assert [(r.op, r.subject) for r in ledger.collect()] == [("wiki.override", "a claim")]
    assert api.wiki_finalize(pages, toc, "2026-02-01")[0].count() == 3

    changed = spark.createDataFrame([("src/x.py",)], "path string")
    told = F.when(F.col("id") == 1, "contradict").when(F.col("id") == 2, "supersede").otherwise("no_impact")
    out = api.wiki_sync(_claims(spark), changed, lambda rows: rows.withColumn("impact", told).withColumn("still_true", F.lit(0.1)), "0123456789", "2026-02-01")
    after = {r.id: (r.status, r.superseded_by, r.last_checked) for r in out["claims"].collect()}
    assert after == {1: ("disputed", None, "2026-02-01"), 2: ("superseded", "commit 0123456", "2026-02-01"), 3: ("rejected", None, "2026-02-01")}
    assert sorted((r.kind, r.criticality) for r in out["reviews"].collect()) == [("dispute", 0.9), ("needs_recheck", 0.9)]

    items = spark.createDataFrame([("r1", 0.5, "open", "a.md", "1", "x"), ("r2", 0.9, "open", "b.md", "2", "y")], "id string, criticality double, status string, page string, claim_id string, claim_text string")
    items = items.withColumns({c: F.lit(None).cast("string") for c in ("resolution", "note", "resolved_at")})
    wanted = spark.createDataFrame([("r1", "accept", "fine", False), ("r2", "reject", "no", False), ("none", "accept", "", True)], "id string, resolution string, note string, confirmed boolean")
    claims = _claims(spark).select("page", F.col("id").cast("string").alias("id"), "text", F.lit("needs_recheck").alias("status"), F.lit(0.3).alias("support"), F.lit(None).cast("string").alias("reviewed"))
    resolved, mended, rows = api.wiki_resolve(items, wanted, claims, "2026-02-01T09:00")
    assert sorted((r.id, r.status, r.resolution) for r in resolved.collect()) == [("r1", "resolved", "accept"), ("r2", "deferred", "defer")]
    assert {r.id: (r.status, r.support) for r in mended.collect()} == {"1": ("verified", 0.8), "2": ("needs_recheck", 0.3), "3": ("needs_recheck", 0.3)}
    assert sorted(r.op for r in rows.collect()) == ["wiki.review", "wiki.review.accept"]
    done = resolved.where("status = 'resolved'")
    assert curation.not_survived(claims, mended, done).count() == 0
    assert [(r.id, r.expected, r.status) for r in curation.not_survived(claims, claims, done).collect()] == [("1", "verified", "needs_recheck")]


def test_all_checks_with_a_judge(spark):
    pages = spark.createDataFrame([("a.md", "A", "concept", "s", "2025-01-01", "[b](b.md) raw1.md"), ("b.md", "B", "concept", "new", "2025-01-01", "[a](a.md)"), ("index.md", "I", "x", "", "", "")], "path string, title string, type string, summary string, updated string, text string")
    toc = spark.createDataFrame([("b.md", "B", "concept", "old", "2025-01-01")], "path string, title string, type string, summary string, updated string")
    claims = spark.createDataFrame(
        [(1, "a.md", "servers listen on port eighty always", "verified", ["f"], 0.9), (2, "b.md", "clients never connect to servers directly", "verified", ["f"], 0.9), (3, "a.md", "backups rotate weekly during nights", "verified", [], 0.9), (4, "b.md", "backups rotate weekly during nights", "verified", [], 0.9)],
        "id long, page string, text string, status string, files array<string>, support double",
    )
    raw = spark.createDataFrame([("raw/raw1.md",), ("raw/raw2.md",)], "path string")
    log = spark.createDataFrame([("code", "ingest.decide", "file", "Backups rotate weekly", None, None)], "actor string, op string, action string, subject string, outcome string, reason string")

    def both(pairs):
        return pairs.withColumns({"relation": F.lit("contradicts"), "confidence": F.lit(0.95), "merge": F.lit(0.9)})

    out = api.wiki_lint_all(pages, toc, claims, raw, log, "2026-02-01", both)
    counts = {r.finding: r.n for r in out["counts"].collect()}
    assert counts == {"toc_added": 1, "toc_missing_file": 0, "toc_updated": 1, "broken_link": 0, "orphan": 0, "raw_backlog": 1, "unbacked_claim": 2, "contradiction": 1, "duplicate": 1}
    assert sorted((r.path, r.summary) for r in out["toc"].collect()) == [("a.md", "s"), ("b.md", "new")]
    assert {r.id: r.status for r in out["claims"].collect()} == {1: "disputed", 2: "disputed", 3: "verified", 4: "verified"}
    assert sorted((r.kind, r.claim_id, round(r.criticality, 2)) for r in out["reviews"].collect()) == [("claim_review", "1", 0.45), ("claim_review", "2", 0.45), ("claim_review", "3", 0.5), ("dispute", "1", 0.95), ("dispute", "2", 0.95)]
    plain = api.wiki_lint_all(pages, toc, claims, raw, log, "2026-02-01")
    assert {r.status for r in plain["claims"].collect()} == {"verified"}


def test_the_index_is_built_refreshed_and_reset(spark, tmp_path):
    registry = spark.createDataFrame([("w", "/r/w", True, "t"), ("v", "/r/v", True, "t")], "name string, root string, enabled boolean, added string")
    index = api.Index(ChunkStore(spark, str(tmp_path / "chunks")), registry, HashingEmbedder(8))
    pages = spark.createDataFrame([("p.md", "t", "word " * 40), ("q.md", "t", "other " * 40)], "path string, title string, text string")
    assert index.rebuild("w", pages, None, "t1", ["p.md"]).count() == 0  # not warm
    assert {r.action: r.n for r in index.rebuild("w", pages, None, "t1").collect()} == {"embed": 2}
    assert {r.action: r.n for r in index.rebuild("w", pages.where("path = 'p.md'"), None, "t2").collect()} == {"skip": 1, "remove": 1}
    assert {r.wiki: (r.chunks, r.missing, r.stale) for r in index.status().collect()} == {"w": (1, False, False), "v": (0, True, False)}
    other = api.Index(index.store, registry, HashingEmbedder(16))
    assert {r.wiki: r.stale for r in other.status().collect()}["w"]
    roots = spark.createDataFrame([("/r/w/", None, 1), ("/x/w", None, 2), ("/y/docs/w", "w", 3)], "root string, name string, ord int")
    assert sorted((r.name, r.root) for r in index.add(roots, "t3").collect()) == [("v", "/r/v"), ("w", "/r/w"), ("w-2", "/x/w"), ("w-3", "/y/docs/w")]
    index.enable(["v"], False)
    assert sorted(r.name for r in catalog.enabled_names(index.remove(["w-2"])).collect()) == ["w", "w-3"]
    index.reset()
    assert not index.store.read().count()
    assert index.model({"search": {"vector": {"model": "quality"}}}, None) == ("quality", "project") and index.model(None, {"search": {"vector": {"model": " "}}}) == ("performance", "default")


def test_health_and_settings(spark, monkeypatch):
    index = spark.createDataFrame([("r.md", "nothing")], "path string, sha string")
    raw = spark.createDataFrame([("r.md", "text")], "path string, text string")
    files = spark.createDataFrame([("a.tmp-1", "a.tmp-1", False, 0, 0, 0)], "path string, name string, folder boolean, depth int, size long, mtime long")
    checks, counts = api.wiki_health(config.layered({"routing": {"shardSize": 5}}), index, raw, files, 10**9)
    assert {r.name: r.status for r in checks.collect()} == {"config values": "fail", "raw sources": "fail", "temporary files": "warn"}
    assert tuple(counts.head()) == (0, 1, 2)
    assert config.invalid(config.layered()) == []
    assert config.layered({"toc": {"maxTokens": 1}, "new": 2}, None, {"toc": None})["toc"] == {"maxTokens": 1}
    assert config.invalid(config.layered({"search": {"vector": {"dimensions": 900}}})) == ["search.vector.dimensions=900"]
    monkeypatch.setenv("LW_KEY", "k1")
    assert config.indirect("$LW_KEY", {}) == "k1" and config.indirect("$LW_NONE", {"LW_NONE": "f"}) == "f" and config.indirect("plain", {}) == "plain" and config.indirect("", {}) is None


def test_models_are_asked_patiently():
    waits, answers = [], iter([Unavailable(529), Unavailable(429, 7), Unavailable(0), "yes"])

    def ask():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert models.patiently(ask, sleep=waits.append) == "yes" and waits == [0.5, 7, 2.0]
    for errors, count in (([Unavailable(400)], 0), ([Unavailable(500)] * 4, 3)):
        waits, answers = [], iter(errors)
        with pytest.raises(Unavailable):
            models.patiently(ask, sleep=waits.append)
        assert len(waits) == count
    assert models.at_most(4, lambda x: x * 2, list(range(10))) == [2 * x for x in range(10)] and models.at_most(4, str, []) == []


def test_questions_and_verdicts():
    assert len(models.claim_questions(0, [])) == 9 and len(models.claim_questions(3, ["a"])) == 12
    assert models.claim_questions(0, [str(k) for k in range(150)])["topic"].options[-2:] == ("99", "new_topic")
    told = models.verdict({"grounded": 0.9, "importance": 2, "kind": "decision", "topic": "new_topic", "verifiable": "user_stated"}, "fact", lambda k: f"{k}s")
    assert (told["importance_norm"], told["topic"], told["topic_is_new"], told["trust_tier"], told["derivable"]) == (2 / 3, "decisions", True, "user_stated", 0.0)
    assert set(models.pair_questions("contradiction")) == {"relation"} and set(models.pair_questions("duplicate")) == {"merge"}
    assert set(models.impact_questions()) == {"impact", "still_true"} and list(models.retrieval_questions(2)) == ["sufficient", "c1", "c2"]


def test_engines_fall_back(spark, tmp_path):
    program = tmp_path / "engine.py"
    program.write_text("import json, sys\nif 'bad' in sys.argv[1]: sys.exit(3)\nprint(json.dumps([{'path': sys.argv[1] + '.md', 'score': 2}, {'file': 'b.md'}][: int(sys.argv[2])]))")
    import sys

    own = engines.command_engine([sys.executable, str(program)])
    queries = spark.createDataFrame([(1, "x")], "query_id long, query string")
    plain = lambda q, limit: q.select("query_id", F.lit("plain.md").alias("path"), F.lit(1).alias("rank"), F.lit(0.0).alias("score"))
    both = engines.with_fallback(own, plain)
    assert [(r.path, r.rank, r.score) for r in both(queries, 5).collect()] == [("x.md", 1, 2.0), ("b.md", 2, 0.0)]
    assert [r.path for r in both(queries.withColumn("query", F.lit("bad")), 5).collect()] == ["plain.md"]


def test_budgets_fail_closed_and_people_go_first(spark):
    import threading
    import time

    from loreweave import budget

    assert budget.within(spark, 30, lambda: spark.range(5).count()) == 5
    assert budget.within(spark, 30, lambda: 1 / 0, "closed") == "closed"
    began = time.time()
    assert budget.within(spark, 0.5, lambda: spark.range(1 << 42).selectExpr("sum(id % 7)").collect(), "late") == "late" and time.time() - began < 20
    queue, order, gate = budget.Queue(), [], threading.Event()
    first = queue.submit(gate.wait, "batch")
    time.sleep(0.1)
    later = [queue.submit(lambda n=n: order.append(n), kind) for n, kind in enumerate(("batch", "interactive", "batch", "interactive"))]
    one = queue.submit(lambda: "once", key="k")
    assert queue.submit(lambda: "twice", key="k") is one
    gate.set()
    assert one.result(10) == "once" and first.result(10)
    for f in later:
        f.result(10)
    assert order == [1, 3, 0, 2]


def test_projects_are_analysed(spark):
    rows = [("s", 0, "user", None, "2026-01-01T10:00", None, 0.0), ("s", 1, "assistant", "stop", "2026-01-01T10:01", "m", 0.5), ("s", 2, "user", None, "2026-01-01T10:02", None, 0.0), ("s", 3, "assistant", "toolUse", "2026-01-01T10:03", "m", 0.25)]
    messages = spark.createDataFrame(rows, "session string, ord long, role string, stop_reason string, ts string, model string, cost double")
    messages = messages.withColumns({c: F.lit(1).cast("long") for c in ("input", "output", "cache_read", "cache_write", "reasoning", "total_tokens")})
    calls = spark.createDataFrame([("s", 1, 0, "read", '{"path": "a.py"}', 10, False), ("s", 1, 1, "read", '{"path": "/w/wiki/x.md"}', 5, True), ("s", 3, 0, "edit", '{"path": "a.py"}', 0, False)], "session string, ord long, at int, name string, args string, chars long, is_error boolean")
    retrieval = spark.createDataFrame([("s", 1, 1, 2, 1)], "session string, episode long, retrieved long, declared long, rediscovered long")
    out = api.wiki_project(messages, calls, retrieval, ("/w/wiki",), 1)
    (shown,) = out["episodes"].collect()
    assert (shown.episode, shown.label, shown.read_files, shown.n_wiki, shown.errors) == (1, "E01", ["a.py"], 1, 1)
    total = out["totals"].head()
    assert (total.episodes, total.cost, total.n_act, total.rediscovery_rate, total.files_read) == (2, 0.75, 1, 0.5, 1)
    assert out["models"].head()["requests"] == 2 and out["summary"].head()["median_cost"] == 0.5
    assert harness.shuffled(list("abcd"), "run1") == harness.shuffled(list("abcd"), "run1")
    assert len({tuple(harness.shuffled(list("abcd"), f"run{k}")) for k in range(60)}) == 3  # doubles lose the low bits that an even divisor looks at
