"""Greedy groups, first pairs and held strings against plain walks."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from loreweave.operators import founders, sessions, similarity
from loreweave.operators.containment import held_names


def _like(a, b, least):
    small = min(len(a), len(b))
    return small > 0 and len(a & b) / small >= least


def _walk(rows, threshold, least):
    out = []
    for key in {r[0] for r in rows}:
        groups = []
        for _, ord_, text, tokens, accepted, promoted in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            own = set(tokens)
            g = next((g for g in groups if _like(own, g["tokens"], threshold)), None)
            if g is None:
                g = {"row": (key, ord_, text), "tokens": own, "size": 0, "barred": False}
                groups.append(g)
            g["size"] += 1
            g["barred"] |= accepted or promoted
        out += [(*g["row"], g["size"]) for g in groups if g["size"] >= least and not g["barred"]]
    return sorted(out)


def test_greedy_groups_are_those_of_a_walk(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(14)]
    rows = []
    for i in range(220):
        tokens = r.sample(words, r.randint(0, 6))
        rows.append((r.choice(["k", "l", "one", "one", "one"]), i, f"t{i}", tokens, r.random() < 0.02, r.random() < 0.02))
    rows += [("one", 300 + i, f"copy{i}", ["w1", "w2", "x"], False, False) for i in range(150)]  # copies make no pairs
    df = spark.createDataFrame(rows, "key string, ord long, text string, tokens array<string>, accepted boolean, promoted boolean").repartition(4)
    for threshold, least in ((0.7, 3), (0.5, 2), (0.3, 1)):
        got = sorted(tuple(x) for x in similarity.promote_recurring(df, threshold, least).collect())
        assert got == _walk(rows, threshold, least)
    assert similarity.promote_recurring(df.limit(0)).count() == 0


def test_greedy_groups_of_many_texts_come_in_blocks_and_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FEW", 0)
    monkeypatch.setattr(similarity, "BLOCK", 23)
    monkeypatch.setattr(similarity, "similar_pairs", None)  # before, this made all pairs
    r = random.Random(7)
    words = [f"w{i}" for i in range(16)]
    rows = [(r.choice(["k", "", "one", "one"]), i // 2, f"t{i}", r.sample(words, r.randint(0, 6)), r.random() < 0.02, False) for i in range(240)]
    df = spark.createDataFrame([*rows, (None, 0, "a", ["w1"], False, False), (None, 1, "b", ["w1", "w2"], False, False)], "key string, ord long, text string, tokens array<string>, accepted boolean, promoted boolean").repartition(3)
    df = df.withColumn("tokens", F.filter(F.split(F.array_join("tokens", " "), " "), lambda t: t != ""))  # words that can't be null, as those of texts
    for threshold, least in ((0.7, 3), (0.3, 1)):
        got = [tuple(x) for x in similarity.promote_recurring(df, threshold, least).collect()]
        assert sorted(x for x in got if x[0] is not None) == _walk(rows, threshold, least)
        assert [x for x in got if x[0] is None] == ([(None, 0, "a", 2)] if least == 1 else [])


def test_founders_of_a_block_are_those_of_a_walk(monkeypatch):
    monkeypatch.setattr(founders, "FEW", 5)
    monkeypatch.setattr(founders, "HELD", 50)
    r = random.Random(1)
    sets = [r.sample([f"w{i}" for i in range(20)], r.randint(1, 7)) for _ in range(300)]
    first, expected = [], []
    for i, own in enumerate(sets):
        met = next((j for j in first if _like(set(own), set(sets[j]), 0.4)), i)
        first += [i] if met == i else []
        expected.append(met)
    assert founders.founders(pa.array(sets), 0.4).tolist() == expected


def _first(claims, most, identical):
    out = []
    for i, (a, page, files, tokens) in enumerate(sorted(claims)):
        for b, other, more, words in sorted(claims)[i + 1 :]:
            small = min(len(tokens), len(words))
            score = len(set(tokens) & set(words)) / small if small else 0.0
            if page != other and set(files) & set(more) and score < identical:
                out.append((a, b))
    return out[:most]


def test_first_pairs_come_without_all_pairs(spark):
    r = random.Random(4)
    kinds = "id long, page string, files array<string>, tokens array<string>"
    for pages, same in ((12, 0.3), (2, 0.9), (1, 0.0)):
        claims = [(i, f"p{r.randrange(pages)}", r.sample(["a", "b", "c", "d"], r.randint(0, 2)), ["x", "y"] if r.random() < same else r.sample(["u", "v", "w", "z"], 2)) for i in range(60)]
        for first, reach in ((64, 16), (4, 2)):
            got = [tuple(x) for x in similarity.contradiction_candidates(spark.createDataFrame(claims, kinds), 8, 0.9, first, reach).orderBy("a", "b").collect()]
            assert got == _first(claims, 8, 0.9)
    many = spark.range(200_000).selectExpr("id", "concat('p', id % 3) as page", "array('one') as files", "array(concat('t', id)) as tokens")
    assert [tuple(x) for x in similarity.contradiction_candidates(many).orderBy("a", "b").collect()] == [(0, b) for b in (1, 2, 4, 5, 7, 8, 10, 11)]


def test_many_strings_in_one_pass(spark):
    r = random.Random(9)
    names = sorted({"".join(r.choice("ab注ü -") for _ in range(r.randint(1, 6))) for _ in range(400)})
    texts = ["".join(r.choice("ab注ü -c") for _ in range(r.randint(0, 40))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    expected = sorted((i, n) for i, t in enumerate(texts) for n in names if n in (t or ""))
    wanted = spark.createDataFrame([(n,) for n in [*names, "", None]], "name string")
    for block in (1 << 20, 100):
        assert sorted((x.i, x.name) for x in held_names(df, wanted, block=block).collect()) == expected


def test_texts_stay_where_they_are_however_many_strings_there_are(spark):
    texts = spark.range(20).selectExpr("id", "concat('see file', id, '.md and ', repeat('long text ', 50)) as text")
    names = spark.range(3000).selectExpr("concat('file', id, '.md') as name")
    got = held_names(texts, names, block=100, keep=["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    # before: every text moved once for each block of strings
    assert "FlatMapCoGroupsInPandas" not in plan and "Generate" not in plan and not re.search(r"Exchange hashpartitioning\(.*text#", plan)
    assert sorted(map(tuple, got.collect())) == [(i, f"file{i}.md") for i in range(20)]


def _up(rows):
    """The way up of one session, step by step."""
    rows = sorted(rows, key=lambda r: r[1])
    parent = {r[2]: r[3] for r in rows}
    at, seen = rows[-1][2], set()
    while at is not None and at not in seen:
        if at not in parent:
            return [(r[0], r[1], r[2], True) for r in rows]
        seen.add(at)
        at = parent[at]
    return [(r[0], r[1], r[2], False) for r in rows if r[2] in seen]


def test_the_way_up_by_doubling(spark):
    r = random.Random(3)
    rows = [("chain", i, f"e{i}", f"e{i - 1}" if i else None) for i in range(300)]
    for s in range(40):
        n = r.randint(1, 12)
        for i in range(n):
            up = r.choice([None, f"e{r.randrange(n)}", f"e{max(0, i - 1)}", f"e{max(0, i - 1)}", "gone" if r.random() < 0.2 else f"e{max(0, i - 2)}"])
            rows.append((f"s{s}", i, f"e{i % max(1, n - 1)}", up))
    rows += [(None, 0, "a", None), (None, 1, "b", "a"), ("nothing", 0, "a", None), ("nothing", 1, None, "a"), ("empty", 0, "", None), ("self", 0, "a", "a")]
    df = spark.createDataFrame(rows, "session string, ord long, id string, parent_id string").repartition(3)
    got = sorted((tuple(x) for x in sessions.active_branch(df).collect()), key=repr)
    expected = [x for s in {r[0] for r in rows} for x in _up([r for r in rows if r[0] == s])]
    assert got == sorted(expected, key=repr)
    assert sessions.active_branch(df.limit(0)).count() == 0


def _given(monkeypatch):
    """What similar_pairs is asked for, while it does its work."""
    asked, work = [], similarity.similar_pairs
    monkeypatch.setattr(similarity, "similar_pairs", lambda rows, *a, **k: asked.append(rows) or work(rows, *a, **k))
    return asked


def test_pairs_of_groups_carry_no_texts(spark, monkeypatch):
    asked = _given(monkeypatch)
    rows = [("k", 1, "b", ["x", "y"], False, False), ("k", 1, "a", ["x", "z"], False, False), ("k", 2, "c", ["x", "y", "z"], False, False)]
    df = spark.createDataFrame(rows, "key string, ord long, text string, tokens array<string>, accepted boolean, promoted boolean")
    assert [tuple(r) for r in similarity.promote_recurring(df, 0.5, 2).collect()] == [("k", 1, "a", 3)]
    assert "text" not in asked[0].schema["id"].dataType.simpleString()


def test_pairs_that_share_a_key_but_too_little_are_not_taken_on(spark):
    # all hold one word, that nothing is rarer than in the small ones
    rows = [(i, ["all", f"a{i // 2}", f"b{i // 2}", f"c{i // 2}"]) for i in range(60)]
    known = similarity._signed_words(spark.createDataFrame(rows, "id long, tokens array<string>"))
    met = similarity._met(known, known, 0.25, F.col("x") < F.col("y"))
    some = similarity._met(known, known, 0.5, F.col("x") < F.col("y"))
    assert met.distinct().count() == 60 * 59 // 2 and some.distinct().count() < 60


def test_rows_of_the_same_words_recur_without_pairs(spark, monkeypatch):
    asked = _given(monkeypatch)
    rows = [(i, ["x", "y"]) for i in range(300)] + [(400, ["x", "y", "z"]), (401, ["w"]), (402, []), (403, None)]
    got = {r.id: r.n for r in similarity.recurrence(spark.createDataFrame(rows, "id long, tokens array<string>")).collect()}
    assert got == {i: 300 for i in range(300)} | {400: 300, 401: 0, 402: 0, 403: 0}
    assert asked[0].count() == 3


def test_first_duplicates_come_without_all_pairs(spark):
    r = random.Random(5)
    rows = [(i, f"p{r.randrange(3)}", r.sample("abcdefgh", r.randint(0, 5))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, page string, tokens array<string>")
    all_ = [(a, b) for a, p, x in rows for b, q, y in rows if a < b and p != q and _like(set(x), set(y), 0.72)]
    for first in (256, 2):
        assert [(p.a, p.b) for p in similarity.duplicate_candidates(df, 0.72, 6, first).collect()] == all_[:6]
    assert [(p.a, p.b) for p in similarity.duplicate_candidates(df.where("id >= 80"), 0.72, 1000, 4).collect()] == [(a, b) for a, b in all_ if a >= 80]


def test_best_matches_take_on_no_pairs_below_what_was_found(spark, monkeypatch):
    r = random.Random(6)
    some = lambda n: [(i, r.sample("abcdefghij", r.randint(0, 7))) for i in range(n)]
    asked, claims = some(40), some(60)
    levels, work = [], similarity._met
    monkeypatch.setattr(similarity, "_met", lambda a, b, level, twins: levels.append(level) or work(a, b, level, twins))
    best = {}
    for q, x in asked:
        scored = [(-len(set(x) & set(y)) / min(len(x), len(y)), i) for i, y in claims if x and y]
        best |= {q: min(scored)[1]} if scored and min(scored)[0] <= -0.3 else {}
    got = similarity.best_match(spark.createDataFrame(asked, "query_id long, tokens array<string>"), spark.createDataFrame(claims, "id long, tokens array<string>"), 0.3)
    assert {m.query_id: m.id for m in got.collect()} == best
    assert levels[0] == 1.0 and levels[-1] == 0.3
