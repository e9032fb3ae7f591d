"""What a step holds or moves at once doesn't grow with its input."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from loreweave.operators import chunking, postings, vector
from loreweave.plans import asked
from loreweave.streaming import flows


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_cut_where_they_are_and_only_once(spark):
    pages = spark.createDataFrame([("a.md", "T", "intro\r\n# One\n" + "word " * 40 + "\n#\r\n# One\r\n" + "more " * 2000)], "path string, title string, text string")
    plan = _plan(chunking.chunks(pages))
    assert plan.count("Exchange hashpartitioning(") == 2  # pages by path, chunks by key
    assert plan.count("Generate posexplode(split(") == 1
    assert [r[1:] for r in chunking.sections(pages.select("path", "text")).where("section > 0").select("path", "section", "heading", "slug").collect()] == [(1, "One", "one"), (2, "One", "one-2")]


def test_a_task_scores_tiles_of_queries_and_rows():
    rng = np.random.default_rng(1)
    q, m = rng.normal(size=(1500, 8)), rng.normal(size=(9000, 8))
    q /= np.linalg.norm(q, axis=1)[:, None]
    frame = pd.DataFrame({"key": np.arange(9000), "embedding": list(m)})
    tracemalloc.start()
    best = vector.best_of(iter([frame]), np.arange(1500), q, 8, 3, np.int64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # all scores at once: 108 MB, and their rounded copy
    score = np.round(q @ (m / np.linalg.norm(m, axis=1)[:, None]).T, 6)
    for i in (0, 700, 1499):
        assert best[i][1].tolist() == np.lexsort((np.arange(9000), -score[i]))[:3].tolist()


def test_words_of_texts_stay_in_their_range_while_few_are_asked(spark):
    docs = spark.createDataFrame([("a", "t", "", "one two two three")], "path string, title string, rest string, text string")
    wanted = spark.range(1).selectExpr("'two' as token").checkpoint()
    plan = _plan(postings.blocks(docs, 3, wanted))
    assert "BroadcastHashJoin [token" in plan and "SortMergeJoin" not in plan.split("BroadcastHashJoin [token")[1]
    assert [(r.token, r.n, r.tfs) for r in postings.blocks(docs, 3, wanted).where("token <> ''").collect()] == [("two", 1, [2])]


def test_a_store_that_is_searched_holds_no_texts(spark):
    pages = spark.createDataFrame([("a.md", "T", "Kelvin K é " * 20)], "path string, title string, text string")
    rows = asked._store(lambda name: pages)
    assert rows.columns == ["path", "key", "kind", "claim_id", "status", "embedding"]
    text = chunking.chunks(pages).head()["text"]
    assert rows.head()["embedding"] == [float(text.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"]


class _Held(list):
    """A list state that notes what it is told."""

    def appendValue(self, value):
        self.append(value)

    def exists(self):
        return bool(self)

    def get(self):
        return iter(self)


class _Handle:
    def __init__(self):
        self.list, self.values, self.timers = _Held(), {}, []

    def getListState(self, name, schema):
        return self.list

    def getValueState(self, name, schema):
        values = self.values
        return type("Value", (), {"exists": lambda _: name in values, "get": lambda _: values[name], "update": lambda _, v: values.update({name: v}), "clear": lambda _: values.pop(name, None)})()

    def registerTimer(self, at):
        self.timers.append(at)


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_rows_that_wait_are_kept_in_blocks_and_keys_in_buckets():
    step = lambda state, r: ((r.n,), [(r.ts, r.n)] if not state or r.n is None or state[0] is None or r.n > state[0] else [])
    walker = flows.InOrder(["k", "ts", "n"], {"ts": "ts__null", "n": "n__null"}, ["k", "ts", "n"], step, ("n",), True, None, None, lambda state: state[0] is None)
    walker.init(handle := _Handle())
    n, keys, start = 50_000, 100, 1_700_000_000_000
    at = np.random.default_rng(3).permutation(n)
    none = at % 7 == 0
    frame = pd.DataFrame({"k": [f"k{x % keys}" for x in at], "ts": (start + at) * 1000 + 1, "n": np.where(none, 0, at + (1 << 60)), "ts__null": False, "n__null": none})
    assert list(walker.handleInputRows((0,), iter([frame[:30_000], frame[30_000:]]), _Watermark(-1))) == []
    assert len(handle.list) == 1 and handle.timers == [start]  # before: a value for each row, and calls for each key
    first = pd.concat(list(walker.handleExpiredTimer((0,), _Watermark(start + n // 2 - 1), None)))
    assert len(handle.list) == 1 and handle.timers[-1] == start + n // 2
    out = pd.concat([first, *walker.handleExpiredTimer((0,), _Watermark(start + n), None)])
    assert handle.list == [] and list(handle.values) == ["states"]
    assert {(k, t, None if x is None else x - (1 << 60)) for k, t, x in out.itertuples(index=False)} == {(f"k{x % keys}", (start + x) * 1000 + 1, None if x % 7 == 0 else x) for x in range(n)}
    for _, own in out.groupby("k"):
        assert own["ts"].is_monotonic_increasing


def test_rows_are_packed_before_they_are_dealt_to_their_buckets(spark, tmp_path):
    spark.createDataFrame([], "key string, ts timestamp, op string, id string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, ts timestamp, op string, id string").parquet(str(tmp_path / "in"))
    assert "MapInArrow" in flows.open_reviews(source)._jdf.queryExecution().analyzed().toString()
    rng, n = np.random.default_rng(4), 6000
    at = rng.permutation(n)
    none = pa.array(at % 50 == 0).to_numpy(zero_copy_only=False)
    rows = pa.table({"bucket__": pa.array(at % 3), "k": pa.array([f"k{x % 30}" for x in at]), "ts": pa.array(at * 1000, mask=none), "n": pa.array(at, mask=at % 7 == 0)})
    parts = [flows._blocks(rows.slice(x, 2000).to_batches(), True) for x in range(0, n, 2000)]
    assert [p.num_rows for p in parts] == [3, 3, 3]  # before: each row went to the step by itself
    packed = pa.Table.from_batches(parts).to_pandas()
    assert set(packed["first__"]) == {0} and packed["last__"].max() == (n - 1) * 1000
    out = {}
    for bucket, own in packed.groupby("bucket__"):
        walker = flows.InOrder(["k", "ts", "n"], {}, ["k", "ts", "n"], lambda state, r: (True, [(r.ts, r.n)]), ("n",), True, None, None, None)
        walker.init(handle := _Handle())
        assert list(walker.handleInputRows((bucket,), iter([own[:2], own[2:]]), _Watermark(-1))) == [] and len(handle.list) == 1
        got = [r for f in walker.handleExpiredTimer((bucket,), _Watermark(3000), None) for r in f.itertuples(index=False, name=None)]
        # a row that comes after its bucket was walked past it is late; one without a time isn't
        late = pa.table({"bucket__": [bucket] * 3, "k": ["late"] * 3, "ts": pa.array([2_000_000, None, 4_000_500]), "n": [0, 1, 2]})
        list(walker.handleInputRows((bucket,), iter([flows._blocks(late.to_batches(), True).to_pandas()]), _Watermark(3000)))
        out[bucket] = got + [r for f in walker.handleExpiredTimer((bucket,), _Watermark(n), None) for r in f.itertuples(index=False, name=None)]
        assert handle.list == []
    value = lambda x: None if x is None or x != x else int(x)
    for bucket, got in out.items():
        assert [(value(t), value(x)) for k, t, x in got if k == "late"] == [(None, 1), (4_000_500, 2)]
        for key in {r[0] for r in got} - {"late"}:
            own = sorted((int(x) for x in at if f"k{x % 30}" == key), key=lambda x: (x % 50 != 0, x if x % 50 else -1, x % 7 != 0, x))
            assert [(value(t), value(x)) for k, t, x in got if k == key] == [(None if x % 50 == 0 else x * 1000, None if x % 7 == 0 else x) for x in own]


def test_pages_of_unique_paths_are_cut_without_moving_their_texts(spark):
    texts = [
        "intro\r\n# One\n" + "word " * 40 + "\n#\r\n# One\r\n" + "more text\n\n" * 2000 + "\n# One-2\n" + "x" * 90 + "\n### *Deep* [l](u)\n\n",
        "", None, "\n\n  \n", "# only\n", "plain `code` [label](target) **bold** " * 9, "```\n# in code\n" + "y " * 3000 + "\n```\n#no heading\n####### seven\n# a b\n" + "z" * 100, "# A\n" + "p\n\n" * 2500 + "# A\n" + "q " * 60 + "# A-2\n# a 2\n" + "r " * 60,
    ]
    pages = spark.createDataFrame([(f"p{i}.md", [f"T{i}", " ", None][i % 3], t) for i, t in enumerate(texts)] + [(None, "t", "w " * 90)], "path string, title string, text string")
    claims = spark.createDataFrame([("p0.md", "c1", "a claim", None), ("p0.md", None, "said twice", None), ("p0.md", None, "said twice", None), ("p5.md", "", " ", None)], "path string, id string, text string, status string")
    assert chunking.unique_paths(pages) and not chunking.unique_paths(pages.union(pages.limit(1)))
    rows = lambda df: sorted(map(str, df.collect()))
    known = pages.where("path is not null").select("path", "title", "text")
    assert rows(chunking.sections(known, ("title",), unique=True)) == rows(chunking.sections(known, ("title",)))
    plain = chunking.chunks(pages, claims)
    assert rows(chunking.chunks(pages, claims, unique=True).select(plain.columns)) == rows(plain)
    assert "hashpartitioning" not in _plan(chunking.chunks(pages, unique=True))  # small tables are dealt to all cores only


def test_texts_stay_where_they_are_while_asked_tokens_are_counted(spark):
    docs = spark.createDataFrame([("a", "t", "", "one two two three"), ("a", "two", "x", "two"), ("b", None, None, None)], "path string, title string, rest string, text string")
    wanted = spark.range(1).selectExpr("'two' as token").checkpoint()
    plan = _plan(postings.blocks(docs, 1, wanted))
    assert "Exchange hashpartitioning(" not in plan.split("Generate explode")[1].split("BroadcastExchange")[0]  # before, texts went to their range first
    got = {r.token: (r.n, r.tfs, r.paths) for r in postings.blocks(docs, 1, wanted).collect()}
    assert got == {"": (3, [1, 1, 1], ["a", "a", "b"]), "two": (2, got["two"][1], None)} and sorted(got["two"][1]) == [1, 2]
