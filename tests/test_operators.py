"""Facts that the operators must reproduce, on small literals."""

import math

import pytest
from pyspark.sql import functions as F

from loreweave import api
from loreweave.functions import redact as secrets
from loreweave.functions import text as T
from loreweave.functions.vectors import truncated
from loreweave.models import BatchJudge, HashingEmbedder, StaticJudge, embed
from loreweave.operators import chunking, curation, evidence, fusion, ledger, lexical, lint, sessions, similarity, stats, vector
from loreweave.operators.containment import held_names


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).head()["x"] if values else spark.range(1).select(column.alias("x")).head()["x"]


BASE = dict(grounded=0.95, derivable=0.2, durable=0.9, sensitive=0.0, importance=2.5, importance_norm=0.83, already_known=0.0, kind="gotcha", relation="new", trust_tier="inferred")


@pytest.mark.parametrize(
    ("change", "action"),
    [
        ({}, "file"),
        ({"sensitive": 0.95}, "reject_sensitive"),
        ({"derivable": 0.8, "kind": "fact", "importance_norm": 0.3}, "reject_derivable"),
        ({"already_known": 0.95}, "reject_duplicate"),
        ({"relation": "extends"}, "reinforce"),
        ({"grounded": 0.74}, "review"),
        ({"grounded": 0.74, "trust_tier": "user_stated"}, "file_user_stated"),
        ({"grounded": 0.4, "trust_tier": "user_stated"}, "file_user_stated"),
        ({"grounded": 0.4, "trust_tier": "verified_in_repo"}, "file"),
        ({"grounded": 0.2}, "reject_unsupported"),
        ({"derivable": 0.62, "kind": "architecture", "importance_norm": 0.7, "grounded": 0.8}, "review"),
    ],
)
def test_decision_ladder(spark, change, action):
    assert one(spark, curation.decide()[0], **(BASE | change)) == action


def test_auto_acceptance_can_be_off(spark):
    rules = curation.Rules(accept_user_stated=False)
    assert one(spark, curation.decide(rules)[0], **(BASE | {"grounded": 0.74, "trust_tier": "user_stated"})) == "review"


def test_tournament_over_shards(spark):
    fits = spark.range(1, 601).select(F.lit("c").alias("claim_id"), F.col("id").alias("position"), F.col("id").alias("page"), F.when(F.col("id") == 437, 0.95).otherwise(0.7).alias("fit"), F.when(F.col("id") == 1, 0.9).otherwise(0.5).alias("final_fit"))
    assert curation.tournament(fits).head()["target"] == 1
    assert curation.tournament(fits.withColumn("fit", F.when(F.col("id" if "id" in fits.columns else "page") == 437, 0.95).otherwise(0.1))).head()["target"] == 437
    assert curation.tournament(fits.withColumn("fit", F.lit(0.1))).head()["target"] is None


def test_reciprocal_rank_fusion(spark):
    lex = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, path string, rank int")
    vec = spark.createDataFrame([(1, "b", None, 1), (1, "c", None, 2)], "query_id long, path string, anchor string, rank int")
    got = [r.path for r in fusion.rrf(lex, vec).orderBy("rank").collect()]
    assert got == ["b", "a", "c"]
    anchored = spark.createDataFrame([(1, "a", "c1", 1), (1, "a", "c2", 2)], "query_id long, path string, anchor string, rank int")
    rows = {(r.path, r.anchor): r.score for r in fusion.rrf(lex, anchored).collect()}
    assert set(rows) == {("a", "c1"), ("a", "c2"), ("b", None)}  # the page's share went to its best anchor
    assert rows["a", "c1"] > 1 / 61 and math.isclose(rows["a", "c2"], 1 / 62, abs_tol=1e-8)


def test_gate_rerank_budget(spark):
    hits = spark.createDataFrame([(1, "a", 1, 3.0, 0.1, "x" * 50), (1, "b", 2, 2.0, 0.9, "y" * 50), (1, "c", 3, 1.0, None, "z")], "query_id long, path string, rank int, score double, relevance double, excerpt string")
    assert [r.path for r in fusion.rerank(hits).orderBy("judged_rank").collect()] == ["b", "c", "a"]
    gates = spark.createDataFrame([(1, 0.3)], "query_id long, sufficiency double")
    assert fusion.gate(hits, gates).count() == 0 and fusion.gate(hits, gates.where("false")).count() == 0
    assert {r.path for r in fusion.gate(hits, gates.withColumn("sufficiency", F.lit(0.5))).collect()} == {"b", "c"}
    assert [r.path for r in fusion.within_budget(hits, 10).collect()] == ["a"]


def test_a_distinctive_page_ranks_first(spark):
    pages = spark.range(1000).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("path"), F.lit("common words").alias("title"), F.lit("x").alias("rest"), F.when(F.col("id") == 731, "zebra quantum lighthouse").otherwise("common words for every page").alias("text"))
    asked = spark.createDataFrame([(1, "quantum lighthouse"), (2, "the and")], "query_id long, query string")
    got = api.wiki_ask(pages, asked, search="bm25").collect()
    assert [(r.query_id, r.path) for r in got] == [(1, "p0731")]
    assert api.wiki_ask(pages, asked.where("query_id = 1"), search="keyword").count() == 0  # titles only


def test_nearest_vectors_equal_a_plain_scan(spark):
    rows = [(i, [math.sin(i * k + 1.0) for k in range(8)]) for i in range(40)] + [(40, [0.0] * 8), (41, [1.0]), (42, None)]
    df = spark.createDataFrame(rows, "key long, embedding array<double>")
    got = vector.knn(df, df.where("key < 3").withColumnRenamed("key", "query_id"), 4, block=2).collect()

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for q in range(3):
        best = sorted(((-round(cos(rows[q][1], v), 6), k) for k, v in rows[:40]))[:4]
        assert [(r.key, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(k, -s) for s, k in best]
    assert one(spark, truncated(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2)) == [0.6, 0.8]


def test_overlap_is_symmetric_and_of_the_smaller(spark):
    a, b = F.array(*map(F.lit, ["one", "two", "three", "four"])), F.array(F.lit("two"), F.lit("nine"))
    assert one(spark, T.overlap(a, b)) == one(spark, T.overlap(b, a)) == 0.5
    assert one(spark, T.overlap(F.array().cast("array<string>"), a)) == 0.0


def test_similar_pairs_equal_all_pairs(spark):
    import random

    r = random.Random(3)
    rows = [(i, list({f"w{int(r.random() ** 3 * 30)}" for _ in range(r.randint(1, 12))})) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    for t in (0.5, 0.72, 0.9):
        expected = {(a, b) for a, x in rows for b, y in rows if a < b and len({*x} & {*y}) / min(len(x), len(y)) >= t}
        assert {(p.a, p.b) for p in similarity.similar_pairs(df, t).collect()} == expected


def test_promotion(spark):
    text = "always pin the session zone before comparing stamps"
    rows = [("k", i, text, text.split(), False, False) for i in range(3)] + [("j", i, text, text.split(), i == 1, False) for i in range(3)]
    df = spark.createDataFrame(rows, "key string, ord long, text string, tokens array<string>, accepted boolean, promoted boolean")
    assert [(r.key, r["size"]) for r in similarity.promote_recurring(df).collect()] == [("k", 3)]


def test_sections_and_chunks(spark):
    text = "intro " * 30 + "\n## Alpha\n" + "first " * 30 + "\n# Beta\n" + "second " * 30 + "\n## Alpha\n" + "third " * 30
    pages = spark.createDataFrame([("p.md", " ", text)], "path string, title string, text string")
    claims = spark.createDataFrame([("p.md", "c1", "one", "verified"), ("p.md", "c2", "two", "superseded"), ("p.md", "c3", "three", "user-stated"), ("p.md", "c4", None, "verified")], "path string, id string, text string, status string")
    got = chunking.chunks(pages, claims).orderBy("key").collect()
    assert [r.key for r in got] == ["claim:c1", "claim:c3", "section:alpha", "section:alpha-2", "section:beta", "section:overview"]
    assert got[0].title == "p"
    windows = chunking.cut_windows("abc def\n\n" * 450, 1000, 200)
    assert len(windows) > 1 and all(len(w) <= 1000 for w in windows)
    diff = chunking.index_diff(chunking.chunks(pages, claims), spark.createDataFrame([(r.path, r.key, r.hash) for r in got], "path string, key string, hash string"))
    assert {r.action for r in diff.collect()} == {"skip"}  # a second run embeds nothing


def test_file_patterns_pages_and_files(spark):
    def fits(a, b):
        return one(spark, T.file_matches(F.lit(a), F.lit(b)))

    assert fits("src/a.ts", "src/a.ts") and fits("src/wiki/search.ts", "src/wiki") and fits("src/wiki/search.ts", "src/wiki/*.ts")
    assert not fits("src/wiki/search.ts", "src/other") and not fits("src/wikis/a.ts", "src/wiki")
    assert one(spark, T.same_page(F.lit("./wiki/Topic/A.md"), F.lit("a")))
    assert one(spark, T.same_file(F.lit("x/y.ts"), F.lit("z/y.ts")))


def test_words_links_and_names_that_once_were_missed(spark):
    assert one(spark, T.tokenize(F.lit("we had tests"))) == ["tests"]
    assert one(spark, T.same_file(F.lit("src/A.ts"), F.lit("./SRC/a.ts"))) and one(spark, T.same_page(F.lit("wiki\\a\\B.md"), F.lit("./a/b")))
    assert not one(spark, T.same_file(F.lit(""), F.lit("a.ts")))
    assert one(spark, lint.resolved_path(F.lit("a/b/c/d/e/f/p.md"), F.lit("../../../../../../x.md"))) == "x.md"
    assert one(spark, lint.resolved_path(F.lit("a/p.md"), F.lit("../../x.md"))) == "../x.md"
    raw = spark.createDataFrame([("raw/my notes.md",), ("raw/Über.md",), ("raw/gone.md",), ("raw/sessions/x.md",)], "path string")
    pages = spark.createDataFrame([("see (my notes.md), ÜberÜber.mdx",)], "text string")
    assert [r.path for r in lint.backlog(raw, pages).collect()] == ["raw/gone.md"]
    modules = spark.createDataFrame([("src/payments-core",), ("src/lost",), ("(root)",)], "module string")
    about = spark.createDataFrame([("a.md", "architecture/module", "The Payments-Cores", "", ["x"])], "path string, type string, title string, summary string, files array<string>")
    assert [r.module for r in evidence.undocumented(modules, about).collect()] == ["src/lost"]
    claims = spark.createDataFrame([(1, "p", "use tls 1", "1"), (2, "p", "use tls 1 in all of it and more", "2"), (3, "q.md", "nobody said so", "c3"), (4, "q.md", "nobody said that", "c4")], "id long, page string, text string, claim_id string")
    said = spark.createDataFrame([("Use TLS 1 in all of it",)], "subject string")
    told = spark.createDataFrame([("looked at Q.md  claim c3",)], "text string")
    assert sorted(r.id for r in evidence.unbacked_claims(claims, said).collect()) == [3, 4]
    assert [r.id for r in evidence.unbacked_claims(claims, said, mentions=told).collect()] == [4]


def test_names_held_in_texts_equal_a_plain_scan(spark):
    import random

    r = random.Random(3)
    bits = ["ab", "abc", "c", "-", " ", "é", "_x", "9", ".md"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(120)]
    names = sorted({"".join(r.choice(bits) for _ in range(r.randint(1, 3))) for _ in range(60)})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "i long, text string")
    got = sorted((x.i, x.name) for x in held_names(rows, spark.createDataFrame([(n,) for n in names], "name string"), block=3).collect())
    assert got == sorted((i, n) for i, t in enumerate(texts) for n in names if n in t)
    assert held_names(rows, spark.createDataFrame([], "name string")).count() == 0


def test_forbidden_strings_in_blocks(spark):
    calls = spark.createDataFrame([("s", "ls /secret/x", "canary-3"), ("t", "ls", "none")], "session string, args string, result string")
    words = spark.createDataFrame([("canary", f"canary-{k}") for k in range(50)] + [("root", "/secret"), ("root", "/secret")], "kind string, value string")
    for block in (7, 10_000):
        assert [(r.session, r.reasons) for r in evidence.contaminated(calls, words, block).collect()] == [("s", ["canary:canary-3", "root:/secret"])]


def test_texts(spark):
    assert one(spark, T.normalize_newlines(F.lit("a\r\nb\rc"))) == "a\nb\nc"
    assert one(spark, T.slug(F.lit("Hello, World!"))) == "hello-world" and one(spark, T.slug(F.lit("!!"))) == "untitled"
    assert len(one(spark, T.slug(F.lit("word " * 40)))) <= 60
    assert one(spark, T.tokenize(F.lit("The quick_fox and 42 of it!"))) == ["quick_fox"]
    assert one(spark, T.markdown_links(F.lit("[a](b.md#c) [d](https://e) [f](#g)"))) == ["b.md"]
    assert one(spark, T.strip_inline(F.lit("**see** [this](that) `x` "))) == "see this x"
    assert one(spark, T.literals(F.lit("In 2024 it took 350 ms, 5 tries, v1.2.3 at https://x.y/z"))) == ["350 ms", "2.3", "https://x.y/z", "v1.2.3"]
    assert one(spark, T.missing_literals(F.array(F.lit("1,200"), F.lit("7 ms")), F.lit("about 1200 rows"))) == ["7 ms"]
    previous = "how does the index refresh work"
    assert one(spark, T.auto_query(F.lit("continue"), F.lit(previous))) == previous
    assert one(spark, T.auto_query(F.lit("go ahead"), F.lit(None).cast("string"))) == "go ahead"
    long = one(spark, T.auto_query(F.lit("word " * 500 + "the end"), F.lit("")))
    assert len(long) <= 1200 and long.endswith("the end")


def test_redaction(spark):
    text = "key sk-or-v1-" + "a" * 24 + " and sk-ant-" + "b" * 24 + " and sk-" + "c" * 24 + " password = 'abcdefgh12345678' mail a@b.co"
    out = one(spark, secrets.redact(F.lit(text)))
    assert out == "key [REDACTED_OPENROUTER_KEY] and [REDACTED_ANTHROPIC_KEY] and [REDACTED_OPENAI_KEY] [REDACTED_SECRET] mail [REDACTED_EMAIL]"
    found = one(spark, secrets.findings(F.lit(text)))
    assert (found["openai_key"], found["email"], found["jwt"]) == (1, 1, 0)


def test_episodes(spark):
    rows = [(0, "user", None), (1, "assistant", "toolUse"), (2, "assistant", "stop"), (3, "user", None), (4, "assistant", "toolUse"), (5, "user", None), (6, "assistant", "aborted"), (7, "assistant", None), (8, "user", None)]
    df = spark.createDataFrame([("s", o, r, s, f"2026-01-01T10:0{o}") for o, r, s in rows], "session string, ord long, role string, stop_reason string, ts string")
    got = [(r.episode, r.end_reason, r.n_requests, r.implicit) for r in sessions.episodes(df).orderBy("episode").collect()]
    assert got == [(1, "settled", 2, False), (2, "steered", 1, False), (3, "interrupted", 1, False), (4, "settled", 1, True), (5, "eof", 0, False)]
    assert [r.label for r in sessions.labelled(sessions.episodes(df)).orderBy("episode").collect()] == ["E01", "E02", "E03", "E04", "E05"]
    assert sum(g[2] for g in got) == sum(r == "assistant" for _, r, _ in rows)  # every request in one episode


def test_branches_and_their_faults(spark):
    rows = [("s", 0, "a", None), ("s", 1, "b", "a"), ("s", 2, "c", "a"), ("t", 0, "a", "zz"), ("t", 1, "b", "a"), ("r", 0, "a", "b"), ("r", 1, "b", "a")]
    df = spark.createDataFrame(rows, "session string, ord long, id string, parent_id string")
    got = {}
    for r in sessions.active_branch(df).collect():
        got.setdefault(r.session, []).append((r.ord, r.id, r.broken))
    assert sorted(got["s"]) == [(0, "a", False), (2, "c", False)]
    assert all(b for _, _, b in got["t"]) and len(got["t"]) == 2
    assert len(got["r"]) == 2  # a ring ends the walk


def test_classification(spark):
    def bucket(tool, command=""):
        return one(spark, sessions.classify(F.lit(tool), F.lit(command), F.lit(False)))

    assert [bucket("bash", c) for c in ("git log", "git push", "sudo npx tsc", "X=1 rg a | head", "npm install", "cd x && pytest", "")] == ["explore", "act", "verify", "explore", "other", "verify", "other"]
    assert [bucket(t) for t in ("wiki_ask", "Read", "edit", "mystery")] == ["wiki", "explore", "act", "other"]


def test_statistics(spark):
    assert stats.wilcoxon([1.0, 2.0, 3.0]) == (3, 0.0, 0.25)
    assert stats.wilcoxon([0.0]) == (0, 0.0, 1.0)
    n, w, p = stats.wilcoxon([float(k) for k in range(1, 31)])
    assert (n, w) == (30, 0.0) and p < 1e-4
    assert stats.wilcoxon([-float(k) for k in range(1, 31)]) == (n, w, p)
    low, high = stats.bootstrap_median([1.0, 2.0, 3.0, 4.0, 5.0])
    assert 1 <= low <= high <= 5 and stats.bootstrap_median([1.0]) == (None, None)
    assert abs(one(spark, stats.normal_two_sided_p(F.lit(1.96))) - 0.05) < 1e-3
    rows = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0)], "id long, v double")
    assert [r.x for r in rows.select("id", stats.average_rank(F.col("v"), []).alias("x")).orderBy("id").collect()] == [1.5, 1.5, 3.0]


def test_triage_separation(spark):
    rows = [("adjudicate", "file", 0.3, 0.9), ("adjudicate", "reject_derivable", 0.6, 0.5), ("adjudicate", "reject_derivable", 0.9, None)]
    df = spark.createDataFrame(rows, "op string, action string, derivable double, grounded double")
    table, overlap = api.wiki_triage(df)
    got = {(r.group, r.field): (r.n, r.min, r.median, r.max) for r in table.collect()}
    assert got["accepted", "derivable"] == (1, 0.3, 0.3, 0.3) and got["rejected", "derivable"] == (2, 0.6, 0.9, 0.9)
    assert overlap.head()["overlap"] is False
    assert one(spark, ledger.upper_median(F.array(*map(F.lit, [3.0, 1.0, 2.0, 4.0])))) == 3.0


def test_lint(spark):
    pages = spark.createDataFrame([("a/x.md", None, "s", "[y](../b/y.md) [gone](./z.md)"), ("b/y.md", "2026-01-31", "s", "")], "path string, updated string, summary string, text string")
    got = {(r.finding, r.path) for r in api.wiki_lint(pages, pages.select("path", "updated", "summary"), "2026-02-01").collect()}
    assert got == {("broken_link", "a/x.md"), ("orphan", "a/x.md")}
    assert one(spark, lint.module_of(F.lit("src/wiki/a.ts"))) == "src/wiki" and one(spark, lint.module_of(F.lit("eval/x/y.ts"))) == "eval"


def test_quotes_and_excerpts(spark):
    assert one(spark, evidence.quote_holds(F.lit("“smart  quotes” here"), F.lit('it has "smart quotes" here')))
    assert not one(spark, evidence.quote_holds(F.lit("short"), F.lit("short")))
    text = "\n".join(f"line {i}" + (" needle" if i in (10, 70) else "") for i in range(100))
    got = one(spark, evidence.excerpt_around(F.lit(text), F.array(F.lit("needle"))))
    assert got.startswith("7: line 6\n") and "\n…\n67: line 66" in got


def test_models(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    got = embed(rows, HashingEmbedder(8)).collect()
    assert len(got[0].embedding) == 8 and sum(x * x for x in got[1].embedding) == 0
    judged = BatchJudge(lambda texts: {"n": [float(len(t)) for t in texts]}, ("n",)).judge(StaticJudge({"grounded": 0.5}).judge(rows)).orderBy("id").collect()
    assert [(r.n, r.grounded) for r in judged] == [(3.0, 0.5), (0.0, 0.5)]


def test_ingest_twice(spark):
    sources = spark.createDataFrame([("a", "x\r\ny"), ("b", "x\ny"), ("c", "z")], "path string, text string")
    first = api.wiki_ingest(sources, spark.createDataFrame([], "sha string"))
    assert first.count() == 2
    assert api.wiki_ingest(sources, first.select("sha")).count() == 0


def test_statistics_of_a_corpus(spark):
    docs = spark.createDataFrame([("one two three",), (None,)], "text string")
    assert lexical.corpus_stats(docs).head()["n_docs"] == 2


def test_bm25_in_blocks_equals_a_plain_sum(spark):
    import math
    import random

    r = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    pages = [(f"p{k}", r.choice(words), " ".join(r.sample(words, 2)), " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for k in range(60)]
    asked = [(k, " ".join(r.choice([*words, "none"]) for _ in range(r.randint(0, 6)))) for k in range(25)]
    docs = spark.createDataFrame(pages, "path string, title string, rest string, text string")
    queries = spark.createDataFrame(asked, "query_id long, query string")
    tokens = {p: [w for w in t.split() if len(w) > 2] for p, _, _, t in pages}  # w0 to w9 are too short
    mean = sum(max(1, len(t)) for t in tokens.values()) / len(pages)
    expected = []
    for q, text in asked:
        scores = {}
        for p, title, rest, _ in pages:
            own = tokens[p]
            for w in set(text.split()):  # each word of a query once
                if len(w) > 2 and w in own:
                    df = sum(w in x for x in tokens.values())
                    part = own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean))
                    scores[p] = scores.get(p, 0.0) + math.log(1 + (len(pages) - df + 0.5) / (df + 0.5)) * part * (3 if w in title.split() else 2 if w in rest.split() else 1)
        best = sorted((-round(s, 6), p) for p, s in scores.items())[:4]
        expected += [(q, p, n, -s) for n, (s, p) in enumerate(best, 1)]
    for block in (7, 1024):
        got = sorted((x.query_id, x.path, x["rank"], x.score) for x in lexical.bm25(docs, queries, 4, block).collect())
        assert [(a, b, c) for a, b, c, _ in got] == sorted((a, b, c) for a, b, c, _ in expected)
        assert all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, sorted(expected), strict=True))
