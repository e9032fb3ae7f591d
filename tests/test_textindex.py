"""The kept index: same rows as a plain scan, whatever changed in between; a search opens its buckets and reachable ranges."""

import math
import random
import re

import pytest

from loreweave.operators import lexical, postings
from loreweave.sources import textindex
from loreweave.sources.textindex import TextIndex

PAGES = "path string, title string, rest string, text string"
STOP = {"the", "and", "for", "with"}


def _tokens(text):
    return [t for t in re.split("[^a-z0-9_]+", (text or "").lower()) if len(t) > 2 and t not in STOP]


def _plain(pages, queries, k):
    docs = [(p, set(_tokens(t)), set(_tokens(r)), _tokens(x)) for p, t, r, x in pages]
    average = sum(max(1, len(x)) for *_, x in docs) / len(docs)
    out = []
    for q, text in queries:
        scores = []
        for path, title, rest, words in docs:
            score = 0.0
            for t in set(_tokens(text)):
                df = sum(t in d[3] for d in docs)
                tf = words.count(t)
                if tf:
                    score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * max(1, len(words)) / average)) * (3 if t in title else 2 if t in rest else 1)
            if score > 0:
                scores.append((-round(score, 6), path))
        out += [(q, path, n + 1, -s) for n, (s, path) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def _pages(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i:02d}x" for i in range(40)] + ["art", "starting", "the"]
    draw = lambda k: " ".join(r.choice(vocabulary[: r.randint(3, 43)]) for _ in range(k))
    rows = [(f"p{i:03d}", draw(3), draw(2), draw(r.randint(0, 60))) for i in range(n)]
    return rows + [("null", None, None, None), ("blank", "", "", "   "), ("same", "art", "", "starting art"), ("same2", "art", "", "starting art")]


QUERIES = [(1, "art art starting"), (2, "w00x w01x w02x"), (3, "nothing known"), (4, ""), (5, "W39X the"), (6, " ".join(f"w{i:02d}x" for i in range(40)))]


def _got(df):
    return sorted((r["query_id"], r["path"], r["rank"], round(r["score"], 6)) for r in df.collect())


def _near(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(a, b, strict=True))


def test_bm25_is_a_plain_scan(spark):
    pages = _pages(1)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    _near(_got(lexical.bm25(spark.createDataFrame(pages, PAGES), queries, 4)), _plain(pages, QUERIES, 4))
    assert lexical.bm25(spark.createDataFrame([], PAGES), queries).count() == 0
    assert lexical.bm25(spark.createDataFrame(pages, PAGES), queries.limit(0)).count() == 0


def test_a_refreshed_index_is_a_new_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BUCKETS", 8)
    monkeypatch.setattr(textindex, "SEGMENTS", 3)
    index = TextIndex(spark, str(tmp_path / "ix"), range_size=16)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    assert index.search(queries).count() == 0
    pages = _pages(1)
    assert index.refresh(spark.createDataFrame(pages, PAGES)) == {"embed": len(pages)}
    _near(_got(index.search(queries, 4)), _plain(pages, QUERIES, 4))
    assert index.refresh(spark.createDataFrame(pages, PAGES)) == {"skip": len(pages)} and index.table.latest().number == 2
    other = dict((p[0], p) for p in _pages(2))
    pages = [other[p[0]] if i % 9 == 0 else p for i, p in enumerate(pages) if i % 11 != 5] + [("new", "art", "w00x", "art w00x w01x")]
    told = index.refresh(spark.createDataFrame(pages, PAGES))
    assert told["remove"] == 6 and told["embed"] >= 7
    _near(_got(index.search(queries, 4)), _plain(pages, QUERIES, 4))
    assert {k[0] for k in index.table.latest().parts} == {"s1", "s2", "gone"}
    pages = [p for i, p in enumerate(pages) if i % 3]  # so much is dead that the segments are put together
    index.refresh(spark.createDataFrame(pages, PAGES))
    _near(_got(index.search(queries, 4)), _plain(pages, QUERIES, 4))
    assert {k[0] for k in index.table.latest().parts} == {"s3"} and index.table.latest().notes["dead"] == 0
    index.refresh(spark.createDataFrame([], PAGES))
    assert index.search(queries).count() == 0


def test_a_search_opens_its_buckets_and_the_ranges_in_reach(spark, tmp_path):
    pages = [(f"p{i:04d}", "x", "", "common word" + (" rare" * (1 + i % 3) if 100 <= i < 110 else "")) for i in range(2000)]
    index = TextIndex(spark, str(tmp_path / "ix"), range_size=100)
    index.refresh(spark.createDataFrame(pages, PAGES))
    queries = spark.createDataFrame([(1, "rare common")], "query_id long, query string")
    assert len(index.buckets(queries)) == 2
    seen = []
    real = index.table.read
    index.table.read = lambda now, keep: seen.append({k for k in now.parts if keep(k)}) or real(now, keep)
    got = _got(index.search(queries, 3))
    assert {k[1] for own in seen for k in own} <= index.buckets(queries) | {textindex.LISTS}
    _near(got, _plain(pages, [(1, "rare common")], 3))
    held = real(index.table.latest(), lambda k: True).select([c.split()[0] for c in postings.BLOCK.split(", ")])
    weighed = postings.weights(held, postings.query_tokens(queries), 2000)
    reach = sorted((r["bound"] for r in postings.bounds(held, weighed, 2.0).collect()), reverse=True)
    assert len(reach) >= 8 and sum(b >= got[2][3] for b in reach) <= 10  # ranges without the rare word are out of reach
    assert reach[0] >= got[0][3]


def test_no_bound_is_exceeded(spark):
    pages = _pages(3, 200)
    held = postings.blocks(spark.createDataFrame(pages, PAGES), 7).cache()
    n, length = postings.statistics(held)
    assert n == len(pages) and length == sum(max(1, len(_tokens(p[3]))) for p in pages)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    weighed = postings.weights(held, postings.query_tokens(queries), n)
    bound = {(r["query_id"], r["range"]): r["bound"] for r in postings.bounds(held, weighed, length / n).collect()}
    place = {p: r["range"] for r in held.where("token = ''").collect() for p in r["paths"]}
    for q, path, _, s in _plain(pages, QUERIES, 1000):
        assert s <= bound[q, place[path]] + 1e-5
    with pytest.raises(KeyError):
        bound[3, 0]


def test_blocks_of_all_tokens_are_gathered_as_arrays_and_equal_those_of_asked_ones(spark):
    rows = [(f"p{i}.md", ["alpha beta", "", None][i % 3], ["beta", None][i % 2], [" ".join(["alpha", "beta", "gamma é", "delta"][: i % 5] * (i % 4)), None][i % 11 == 0]) for i in range(60)]
    docs = spark.createDataFrame(rows, "path string, title string, rest string, text string")
    made = postings.blocks(docs, 4, first=7)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "ObjectHashAggregate" not in plan  # before: a row for each word, sorted twice
    wanted = spark.createDataFrame([(t,) for t in ("alpha", "beta", "gamma", "delta")], "token string")
    plain = postings.blocks(docs, 4, wanted, first=7)
    assert made.columns == plain.columns
    assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))
