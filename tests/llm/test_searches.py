"""Operators 11 to 13 against brute force: odd vectors and texts, ties, repeated rows, hot copies, empty tables."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from loreweave.llm import grid, periods, projections, quantised

from .conftest import clashing, corpus, rows

VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(seed=3, n=400, dims=12):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims))
    x[50:150] = x[50]  # copies: ties everywhere
    x[150:170] = x[50] + 1e-3 * r.standard_normal((20, dims))
    out = [(int(i), [float(v) for v in x[i]], int(i * 7 % 10)) for i in range(n)]
    out += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * dims, 2), (n + 3, [1.0, None] + [0.0] * (dims - 2), 3), (n + 4, [math.nan] * dims, 3), (n + 5, [math.inf] + [0.0] * (dims - 1), 3)]
    out += [(None, [1.0] * dims, 1), (n + 20, [3.0, 4.0], 1), (n + 21, [1.0, 1.0], 2), (n + 22, [2.0, 1.0], None), (n + 40, [5.0] * dims, 4), (n + 23, [-5.0] * dims, 4)]
    out += [out[40], out[40], (100, [float(v) for v in x[3]], 0), (200, [float(v) for v in x[5]], 2), (n + 100, [0.5] * dims, 5)]
    return out


def plain_score(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def plain_nearest(data, every, k):
    taken = [(i, v) for i, v, _ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    asked = {}
    for i, v in taken:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = {}
    for q, v in asked.items():
        best = sorted((-plain_score(v, w), i) for i, w in taken if i != q and len(w) == len(v))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


@pytest.mark.parametrize("limit", [grid.BROADCAST_BYTES, 0])
def test_stable_projections_find_the_nearest(spark, limit, monkeypatch):
    data = vectors()
    monkeypatch.setattr(projections, "CHUNK", 128)
    df = spark.createDataFrame(data, VECTORS).repartition(3)
    expected = plain_nearest(data, 20, 20)
    v = df.selectExpr("vec_id as id", "embedding as v").where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)")
    asked = v.where("id % 20 = 0").groupBy("id").agg({"v": "min"}).toDF("id", "v")
    got = {}
    for r in projections.nearest(projections.index(v, 128), asked, 20, block=7, limit=limit).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {q for q, best in expected.items() if best}
    hit = total = 0
    for q, own in got.items():
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and len(own) == len(expected[q])
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hit += len({(i, s) for _, i, s in own} & set(expected[q]))
        total += len(expected[q])
    assert hit >= 0.9 * total
    assert [(i, s) for _, i, s in got[60]] == expected[60]  # one of the copies: the smallest ids among ties


def test_certainty_one_is_exact_and_the_operator_takes_odd_rows(spark):
    data = vectors(5, 300)
    df = clashing(spark.createDataFrame(data, VECTORS))
    found = projections.search_every(df)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = plain_nearest(data, 20, 20)
    whole = sum(len({i for _, i, _ in got[q]} & {i for i, _ in best}) for q, best in expected.items() if best)
    assert whole >= 0.9 * sum(map(len, expected.values()))
    assert projections.search_every(spark.createDataFrame([], VECTORS)).count() == 0


def test_chi_square_and_tree():
    draws = (np.random.default_rng(1).standard_normal((200_000, 8)) ** 2).sum(1)
    for p in (0.1, 0.5, 0.95):
        assert abs((draws <= projections.quantile(p)).mean() - p) < 0.005
    x = np.random.default_rng(2).standard_normal((1000, 6))
    held = projections.build(x, np.arange(1000))
    assert sorted(np.frombuffer(held["ids"], np.int64)) == list(range(1000))
    levels = projections.depth(1000)
    boxes = np.frombuffer(held["boxes"]).reshape(-1, 2, projections.DIRECTIONS)
    points = np.random.default_rng(3).standard_normal((4, projections.DIRECTIONS))
    who, leaf, far = projections.leaves_near(boxes, levels, points, np.full(4, np.inf))
    assert len(who) == 4 * 2**levels
    at = projections.edges(1000, levels)
    lifted = np.column_stack([x, np.sqrt((x * x).sum(1).max() - (x * x).sum(1))])[np.frombuffer(held["ids"], np.int64)] @ projections.directions(6)
    for q, k, d in zip(who, leaf, far, strict=True):
        assert d <= ((lifted[at[k] : at[k + 1]] - points[q]) ** 2).sum(1).min() + 1e-9
    few = projections.leaves_near(boxes, levels, points, np.full(4, 2.0))
    assert set(zip(few[0].tolist(), few[1].tolist(), strict=True)) == {(q, k) for q, k, d in zip(who.tolist(), leaf.tolist(), far.tolist(), strict=True) if d <= 2.0}


def test_a_stopped_search_verifies_less(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.standard_normal((1, 32)) * 5 + r.standard_normal((256, 32)) * 0.3 for _ in range(16)])
    held = projections.build(x, np.arange(len(x)))
    chunk = held | {"dims": 32, "rows": len(x)}
    own = {"ids": np.arange(0, 4096, 64).tobytes(), "x": x[::64].tobytes(), "edge": np.full(64, -np.inf).tobytes()}
    who, ids, score, verified = projections.search(chunk, own, 10, projections.quantile(0.95))
    assert verified < 0.5 * 64 * len(x)
    hit = sum(len(set(ids[who == q]) & set(np.lexsort((np.arange(len(x)), -(x @ x[64 * q])))[:11])) for q in range(64))
    assert hit >= 0.9 * 640


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def odd_texts():
    r = random.Random(7)
    out = [t for _, t, *_ in corpus(2, 40)][:42]
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 6)):
            unit = [r.choice("abc") for _ in range(r.randint(1, 7))]
            parts += (unit * 9)[: r.randint(1, 8 * len(unit))] + [r.choice("abcdefg") for _ in range(r.randint(0, 5))]
        out.append(" ".join(parts))
    out += ["a " * 3000, "a b " * 900 + "c " + "a b " * 900, " ".join("ab"[bin(i).count("1") % 2] for i in range(512)), "x y " * 9, "é ü\x1c " * 8, "\t\n \x0b", None, "a\x00b " * 7]
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    return out + [" ".join(fib[-1]), " ".join(fib[-1] * 4)]


def test_runs_are_all_runs(spark):
    texts = list(enumerate(odd_texts())) + [(None, "a a a a a a a"), (5, "b b b b b b"), (5, "b b b b b b")]
    df = clashing(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    got = rows(periods.digest(df), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert got == sorted((plain_digest(i, t) for i, t in texts), key=repr)
    assert periods.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert any(len(plain_runs((t or "").split())) > 3 for _, t in texts)


def test_other_powers_and_the_mask():
    assert periods.minimum_overlap() == 5 and periods.minimum_overlap(10, 2) == 5 and periods.minimum_overlap(2, 2) == 1
    r = random.Random(3)
    for least, power in ((6, 4), (4, 4), (12, 5)):
        for _ in range(60):
            words = [r.choice(b"ab") for _ in range(r.randint(0, 60))]
            found = periods.runs_of([b" ".join(bytes([w]) for w in words)], least, power)[0][1]
            plain = {}
            for q in range(1, len(words) // power + 1):
                i = 0
                while i + q < len(words):
                    j = i
                    while j + q < len(words) and words[j] == words[j + q]:
                        j += 1
                    if j - i + q >= max(least, power * q):
                        plain.setdefault((i, j - i + q), q)
                    i = j + 1
            assert sorted(map(tuple, found.tolist())) == sorted((s, n, q) for (s, n), q in plain.items())
    words = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 8, 1, 2])
    assert periods.repeated(words, np.zeros(14, int), 5).tolist() == [True] * 5 + [False] + [True] * 5 + [False] * 3
    assert not periods.repeated(words, np.array([0] * 6 + [1] * 8), 5).any()  # two documents


def test_planted_periods(spark):
    import zlib

    texts = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a b c")]
    got = dict(rows(periods.planted(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "text"))
    changed = 0
    for i, t in texts:
        h = zlib.crc32(str(i).encode())
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if x]
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got[i] == " ".join(w[x] if x < a else w[a + (x - a) % p] for x in range(n))
            changed += 1
        else:
            assert got[i] == t
    assert changed


def plain_negatives(data):
    taken = []
    for i, v, label in data:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        taken.append((i, label, [math.floor(256 * x) for x in v]))
    anchors = {}
    for i, label, v in taken:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, own) for i, own, w in taken if i != a and len(w) == len(v)]
        best = {}
        for s, p, own in sorted(scored):
            if own == label and sum(1 for _ in best) < 5:
                best.setdefault(p, -s)
        for p, ps in best.items():
            fit = [(s, i) for s, i, own in sorted(scored) if own != label and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(a, p, k + 1, i, ps, -s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("limit", [grid.BROADCAST_BYTES, 0])
def test_hard_negatives_are_exact(spark, limit, monkeypatch):
    data = [r for r in vectors(9, 500) if r[0] != 100 or r[2] != 0]
    df = clashing(spark.createDataFrame(data, VECTORS).repartition(3)).selectExpr("*", "0 as rank", "0 as id", "0 as v")
    real = grid.meet
    monkeypatch.setattr(grid, "meet", lambda chunks, blocks, run, fields, _=None: real(chunks, blocks, run, fields, limit))
    got = sorted(rows(quantised.mine_every(quantised.relabelled(df)), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    assert got == plain_negatives(data) and got


def test_bounds_hold_and_few_rows_are_scored():
    r = np.random.default_rng(6)
    x = np.floor(256 * r.standard_normal((3000, 64)) / 8)
    book = quantised.codebook(x[:2000])
    codes, left = quantised.encode(x, book)
    chunk = {"dims": 64, "rows": 3000, "ids": np.arange(3000).tobytes(), "labels": (np.arange(3000) % 10).tobytes(), "x": x.astype(np.int32).tobytes(), "codes": codes.tobytes(), "left": left.tobytes()}
    block = {"rows": 20, "ids": np.arange(20).tobytes(), "labels": (np.arange(20) % 10).tobytes(), "x": x[:20].tobytes()}
    met = quantised.Met(chunk, block, {64: book})
    exact = x[:20] @ x.T
    assert (met.low <= exact).all() and (exact <= met.high).all()
    assert ((met.high - met.low) < 0.6 * np.ptp(exact)).mean() > 0.9
    low, high = quantised.windows_of(np.array([10, 11, 0, -5, 1 << 40]))
    assert low.tolist() == [8, 9, 0, -4, -((-80 << 40) // 100)] and (low[3] > high[3])


def test_odd_vectors_have_no_negatives(spark):
    assert quantised.mine_every(spark.createDataFrame([], VECTORS)).count() == 0
    some = [(0, [1.0, 0.0], 1), (100, [], 1), (200, [], 1), (201, [], 2), (300, [1e300], 1), (400, None, 1), (500, [1.0], None)]
    got = rows(quantised.mine_every(spark.createDataFrame(some, VECTORS)), "anchor_id", "positive_id", "negative_id", "negative_score")
    assert got == [(100, 200, 201, 0), (200, 100, 201, 0)]
