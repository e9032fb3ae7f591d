"""Each operator against a brute-force version over odd rows: nulls, empty and long texts, ties, repeated rows."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from loreweave.llm import debruijn, fmindex, hashtree, langid, lines, pieces, registry, screen, semicrf, simhash, suffixes, urltrees, windows

from .conftest import clashing, corpus, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FAR = 1 << 62


def _brute_windows(texts, cut, removed):
    """What 50-element windows of smaller documents take: (elements, mask) by row."""
    first: dict = {}
    parts = [(FAR if i is None else i, cut(t or "")) for i, t in texts]
    for i, x in parts:
        for p in range(len(x) - 49):
            w = tuple(x[p : p + 50])
            first[w] = min(first.get(w, FAR), i)
    out = []
    for i, x in parts:
        mask = np.zeros(len(x), bool)
        for p in range(len(x) - 49):
            if first[tuple(x[p : p + 50])] < i:
                mask[p : p + 50] = True
        out.append((x, mask))
    return out


def _texts():
    return [(r[0], r[1]) for r in corpus()]


def test_decontamination(spark, docs):
    items = [(1, corpus()[2][1]), (2, "zzz"), (3, None), (4, ""), (5, " ".join(corpus()[8][1].split()[:12]).upper()), (5, "zzz zzz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows: dict = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(UPPER))
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    expected = []
    for i, text in _texts():
        w = WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if own := windows.get(tuple(w[p : p + size])):
                    found |= own
                    hit.update(range(p, p + size))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected.append((i, len(w), len(hit), len(found), sha, bool(hit)))
    for rows_in in (docs, clashing(docs)):
        for limits in ({}, {"block_bytes": 400, "shard_chars": 500}):
            got = fmindex.digest(fmindex.find(rows_in, bench, **limits))
            assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(expected, key=repr)


def test_decontamination_counts_an_item_of_two_rows_once(spark):
    bench = spark.createDataFrame([(7, "one two three"), (7, "four five six"), (8, "four five six")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x one two three y four five six z"), (2, "x four five six")], "doc_id long, text string")
    for limits in ({}, {"block_bytes": 120}):
        got = rows(fmindex.digest(fmindex.find(df, bench, **limits)), "doc_id", "n_hit", "n_items", "items_sha256")
        assert got == [(1, 6, 2, hashlib.sha256(b"7,8").hexdigest()), (2, 3, 2, hashlib.sha256(b"7,8").hexdigest())]


def test_decontamination_by_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "one two three"), (None, "one two three"), (4, "one two"), (5, None), (None, None)], "item_id long, text string")
    df = spark.createDataFrame([(1, "x one two three y"), (2, "one two"), (3, "three"), (None, "One, TWO; three")], "doc_id long, text string")
    four, none = hashlib.sha256(b"4").hexdigest(), hashlib.sha256(b"").hexdigest()
    for limits in ({}, {"block_bytes": 70}):
        got = rows(fmindex.digest(fmindex.find(df, bench, **limits)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == sorted([(1, 5, 3, 1, four, True), (2, 2, 2, 1, four, True), (3, 1, 0, 0, none, False), (None, 3, 3, 1, four, True)], key=repr)
    alone = spark.createDataFrame([(None, "one two three")], "item_id long, text string")
    assert rows(fmindex.digest(fmindex.find(df, alone)), "doc_id", "n_hit", "n_items", "items_sha256")[0] == (1, 3, 0, none)


def test_decontamination_by_many_blocks_takes_them_in_turn(spark, docs):
    texts = [r[1] for r in corpus() if r[1] and len(r[1].split()) > 12]
    items = [(k, " ".join(texts[k % len(texts)].split()[k % 3 : k % 3 + 11])) for k in range(150)] + [(7, "zzz"), (7, "zzz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = fmindex.find(docs, bench, block_bytes=sum(len(t.encode()) + 64 for _, t in items) // 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the other passes are written and done
    assert rows(found) == rows(fmindex.find(docs, bench))
    assert sum(len(r.items) > 0 for r in found.collect()) > 10


def test_decontamination_of_nothing(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(r[5] for r in rows(fmindex.digest(fmindex.find(docs, bench))))
    assert rows(fmindex.find(none, bench)) == []
    assert fmindex.without_spans("a b, c d", [(1, 3)]) == "a  d"


@pytest.mark.parametrize("size", [200, 4 << 20])
def test_suffix_removal(docs, size):
    got = rows(suffixes.remove(clashing(docs), shard_bytes=size), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = []
    texts = _texts()
    for (i, _), (x, mask) in zip(texts, _brute_windows(texts, lambda t: t.encode(), None), strict=True):
        kept = bytes(b for b, m in zip(x, mask, strict=True) if not m)
        runs = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        expected.append((i, len(x), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(expected, key=repr)


def _words_left(texts):
    expected = []
    for (i, _), (x, mask) in zip(texts, _brute_windows(texts, lambda t: t.encode().split(), None), strict=True):
        kept = [w for w, m in zip(x, mask, strict=True) if not m]
        expected.append((i, len(x), int(mask.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(expected, key=repr)


@pytest.mark.parametrize(("size", "block"), [(200, 7), (4 << 20, 4096)])
def test_word_span_removal(docs, size, block):
    got = rows(debruijn.remove(clashing(docs), shard_bytes=size, block=block), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == _words_left(_texts())


def test_word_spans_that_branch_and_turn_in_rings(spark):
    r = random.Random(11)
    w = [[f"{k}{r.randrange(10**6)}" for _ in range(90)] for k in range(6)]
    parts = [w[0] + w[1] + w[2], w[0] + w[1] + w[3], w[4] + w[1] + w[2], w[4] + w[1] + w[3], w[1], w[1][20:80], w[0][40:] + w[1][:30], w[5] * 4, w[5][30:] + w[5] * 2, ["a"] * 200, ["a"] * 130, list("abc") * 60, list("bca") * 50 + ["x"], w[0]]
    texts = [(3 * i + 1, "  ".join(p)) for i, p in enumerate(parts)] + [(2, " \n".join(parts[3])), (2, "\t".join(parts[0])), (None, " ".join(parts[7])), (40, " ".join(["a"] * 49))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for limits in ({"shard_bytes": 1, "block": 11}, {"shard_bytes": 2500}, {}):
        assert rows(debruijn.remove(df.repartition(4), **limits), "doc_id", "n_words", "n_removed", "kept_sha256") == _words_left(texts)


def test_words_of_which_polynomials_collide_stay_apart(spark):
    signs = [bin(k).count("1") % 2 for k in range(1024)]
    one, other = ("".join("ab"[s ^ flip] for s in signs) for flip in (0, 1))
    tail = [f"w{k}" for k in range(49)]
    texts = [(1, " ".join([one, *tail])), (2, " ".join([other, *tail])), (3, " ".join([one, *tail, "end"]))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = rows(debruijn.remove(df, shard_bytes=1), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert [x[2] for x in got] == [0, 0, 50] and got == _words_left(texts)


def test_unequal_words_at_one_place_are_told_apart():
    """Were hashes ever to agree on different k-mers, the words decide: here three spans claim one path and place."""
    words = [f"w{k}" for k in range(60)]
    other = [*words[:55], "odd", *words[56:]]
    one = np.array([1], np.int64)
    blobs = [debruijn._zip(one, one * 9, one * 5, one * 11, one * doc, b"".join(w.encode() + b" " for w in text)) for doc, text in ((3, words), (1, other), (7, words))]
    bits = [np.unpackbits(np.frombuffer(debruijn._unzip(x), np.uint8), count=11).tolist() for x in debruijn.settle(blobs)]
    assert bits == [[1] * 6 + [0] * 5, [0] * 11, [1] * 11]


def test_word_spans_in_shards_that_hold_a_piece_of_a_path(spark, monkeypatch):
    texts = []
    for j, seed in enumerate([*range(1, 7), 23, 24]):
        r = random.Random(seed)
        passage = [str(r.randrange(10**6)) for _ in range(140)]
        for k, part in enumerate([passage, passage, passage[50:102]]):
            words = [[str(r.randrange(10**6)) for _ in range(60)] for _ in range(2)]
            texts.append((3 * j + k, " ".join([*words[0], *part, *words[1]])))
    linked: list = []
    compact = debruijn.compact
    monkeypatch.setattr(debruijn, "compact", lambda edges: linked.extend(edges.collect()) or compact(edges))
    got = rows(debruijn.remove(spark.createDataFrame(texts, "doc_id long, text string"), shard_bytes=1), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert [x[2] for x in sorted(got)] == [0, 140, 52] * 8
    assert got == _words_left(texts)
    names = set()
    for i, text in texts:
        node = windows.hashes(windows.unpacked(windows.packed([i], [text.encode()], True), True).symbols())[1]
        names |= set(debruijn.edge_ids(node[:-1], node[1:]).view(np.int64).tolist())
    assert linked and all({x.a, x.b} <= names for x in linked)  # links name k-mers to the last bit


def test_without_the_graph_nothing_goes(spark, monkeypatch):
    words = " ".join(f"w{k}" for k in range(80))
    df = spark.createDataFrame([(1, words), (2, words)], "doc_id long, text string")
    assert [r.n_removed for r in debruijn.remove(df).orderBy("doc_id").collect()] == [0, 80]
    shard = windows.unpacked(windows.packed([1, 2], [words.encode()] * 2, True), True)
    starts = shard.starts_window()
    sent, own = debruijn.offer_runs(shard, starts, 8)
    answers = {k: debruijn.graph([b])[0][0] for k, b in sent}
    known = debruijn.Known(own, answers)
    assert known.good.all() and len(known.word) == 62
    alone = debruijn.offer_runs(windows.unpacked(windows.packed([1], [words.encode()], True), True), starts[:80], 8)
    nothing = debruijn.Known(alone[1], {k: debruijn.graph([b])[0][0] for k, b in alone[0]})
    assert not nothing.good.any()  # k-mers of one document are no edges


def test_removal_from_nothing(none):
    assert rows(suffixes.remove(none)) == []
    assert rows(debruijn.remove(none)) == []


def test_runs_are_merged_by_binary_search():
    r = random.Random(8)
    for _ in range(20):
        rows_ = np.array([[r.choice(b"ab\x00") for _ in range(6)] for _ in range(r.randint(1, 60))], np.uint8)
        key = rows_.view("S6").ravel()
        cuts = sorted(r.randrange(len(key) + 1) for _ in range(3))
        runs = [a + np.argsort(key[a:b], kind="stable") for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True)]
        order = suffixes.merged(key, runs)
        got = [rows_[k].tobytes() for k in order]
        assert got == sorted(x.tobytes() for x in rows_)
        common = suffixes.common_prefixes(rows_[order])
        assert common.tolist() == [0] + [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(got, got[1:], strict=False)]


def test_suffix_array_and_common_prefixes():
    r = random.Random(4)
    for _ in range(30):
        text = np.frombuffer("".join(r.choice("ab") for _ in range(r.randint(1, 200))).encode(), np.uint8)
        order, rank = suffixes.suffix_array(text, 256)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())
        common = suffixes.kasai(text, order, rank, 300, 7)
        for k in range(1, len(text)):
            a, b = text[order[k] :].tobytes(), text[order[k - 1] :].tobytes()
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[k] == n


def test_hash_tree(docs, none):
    got = hashtree.shard_documents(clashing(docs), cells=8).collect()
    assert len(got) == len(corpus())
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 8) and r.law == "key" and 0 <= r.shard < 8 for r in got)
    import zlib

    sizes = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in _texts())
    assert sorted((r["size"], r.text_crc32) for r in got) == sizes
    assert rows(hashtree.shard_documents(none)) == []


def test_hash_tree_places_rows_as_its_law_says(docs):
    """Every row by itself: weighted draws -ln(u) / weight of hashed numbers, level by level."""
    import math
    import struct
    import zlib

    import xxhash

    def draw(key, name, weight):
        seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        unit = ((xxhash.xxh64(name.encode(), seed=seed).intdigest() >> 11) + 0.5) / 2**53
        return -math.log(unit) / weight

    def place(key, regions):
        region = min(regions, key=lambda r: draw(key, r, sum(len(x) for x in regions[r].values())))
        rack = min(regions[region], key=lambda x: draw(key, f"{region}/{x}", len(regions[region][x])))
        return min(regions[region][rack], key=lambda x: draw(key, f"{region}/{rack}/{x}", 1))

    base = {"region0": {"rack0": [0, 1], "rack1": [2, 3]}, "region1": {"rack2": [4, 5], "rack3": [6, 7]}}
    more = base | {"region-of-8": {"rack-of-8": [8]}}
    # a single child is taken without a draw, which changes nothing
    expected = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), place(i, base), place(i, more)) for i, t in _texts()]
    got = hashtree.shard_documents(clashing(docs))
    assert rows(got, "doc_id", "size", "text_crc32", "shard", "grown_shard") == sorted(expected, key=repr)


def test_hash_tree_moves_only_where_weights_change(spark):
    tree = hashtree.topology()
    heavier = {**tree, "region1": {**tree["region1"], "rack2": {4: 3.0, 5: 1.0}}}
    keys = spark.range(20_000).select("id", hashtree.place(__import__("pyspark").sql.functions.col("id"), tree).alias("a"), hashtree.place(__import__("pyspark").sql.functions.col("id"), heavier).alias("b")).collect()
    moved = [(r.a, r.b) for r in keys if r.a != r.b]
    assert moved and all(b in (4, 5, 6, 7) for _, b in moved)  # into the region whose weight grew
    assert all(b in (4, 5) for a, b in moved if a in (4, 5, 6, 7))  # and inside it, into the rack
    share = [sum(r.b == s for r in keys) / len(keys) for s in range(8)]
    assert abs(share[4] - 0.3) < 0.02 and abs(share[0] - 0.1) < 0.02


def test_quality_rules(docs, none):
    def base(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams: dict = {}
        for p in range(len(words) - 4):
            grams.setdefault(tuple(words[p : p + 5]), []).append(p)
        repeat = len({q for own in grams.values() if len(own) > 1 for p in own for q in range(p, p + 5)})
        full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * repeat > 20 * len(words)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), repeat, failed

    expected = sorted([(i, *base(t)) for i, t in _texts()], key=repr)
    judged = lines.judge(clashing(docs))
    assert rows(judged, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected
    assert not any(r.kept and r.base_failed for r in judged.collect())
    assert rows(lines.judge(none)) == []
    for limits in ({"least": 1, "share": 0.0}, {"least": 1, "share": 0.03}):  # carried by hosts, and joined
        one, other = (lines.clean(clashing(docs), most=most, **limits) for most in (100_000, -1))
        assert one.columns == other.columns == clashing(docs).columns
        assert rows(one) == rows(other)
        assert rows(lines.judge(docs, most=-1, **limits)) == rows(lines.judge(docs, **limits))
        assert any(r.removed_chars for r in lines.judge(docs, least=1, share=0.0).collect())


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    own = [(i, f"all rights reserved for everyone here now {i % 1}\n" + " ".join(f"w{i}x{k}" for k in range(12 if i < 8 else 1)), "h", "en", 1) for i in range(10)]
    docs = spark.createDataFrame([(i, t + (" a b c d e f g h i j" if i < 8 else ""), s, la, n) for i, t, s, la, n in own], "doc_id long, text string, source string, lang string, n_chars long")
    kept = lines.clean(docs, least=5).collect()
    assert sorted(r.doc_id for r in kept) == list(range(8))
    assert all("reserved" not in r.text and r.n_chars == len(r.text) for r in kept)


def _fingerprint(text):
    """Bit by bit, from the contract alone."""
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    expected = {}
    prints = [(i, _fingerprint(t)) for i, t in _texts()]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for a in range(len(prints)):
        ids = [i for k, (i, _) in enumerate(prints) if root(k) == root(a) and i is not None]
        expected[a] = (prints[a][0], f"{prints[a][1]:016x}", min(ids) if ids else None)
    got = rows(simhash.cluster(clashing(docs)), "doc_id", "fingerprint", "component_id")
    assert got == sorted(expected.values(), key=repr)
    assert rows(simhash.cluster(none)) == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len({root(k) for k in range(len(prints))})


def test_simhash_groups_over_the_bound_lose_no_link(spark):
    r = random.Random(2)
    seed = [r.getrandbits(64) for _ in range(5)]
    values = sorted({s ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for s in seed for _ in range(40)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")

    def parts(bound):
        up = {}

        def top(x):
            up.setdefault(x, x)
            while up[x] != x:
                x = up[x]
            return x

        for e in simhash.links(df, 4, bound).collect():
            a, b = top(e.a), top(e.b)
            up[max(a, b)] = min(a, b)
        return {frozenset(k for k in up if top(k) == t) for t in {top(k) for k in up}}

    assert parts(3) == parts(10_000)


def test_language(spark, docs, none):
    words = {"en": "the and of to in is that it was for", "de": "der die und das ist nicht mit ein auch für", "es": "el la de que y en los por con una"}
    r = random.Random(1)
    train = [(i, " ".join(r.choice(words[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(list(words) * 60)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    got = langid.evaluate(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in got if x.held_out]
    assert held and sum(x.lang == x.lang_pred for x in held) / len(held) > 0.95
    import zlib

    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 for x in got)
    odd = {(x.doc_id, x.lang_pred) for x in langid.evaluate(clashing(docs)).collect()}
    assert {(60, "und"), (61, "und"), (62, "und"), (None, "und")} <= odd
    assert all(p in ("en", "fr", "und") for _, p in odd)
    assert rows(langid.evaluate(none)) == []


def test_languages_are_learned_from_the_least_hashes(spark):
    texts = [(f"text number {i} of these", "en" if i % 7 else "de") for i in range(3000)] + [("the same text", "en")] * 5000 + [("drei", "xx")] * 3
    df = spark.createDataFrame(texts, "text string, lang string").repartition(6)
    hashed = df.selectExpr("lang", "xxhash64(text) as _hash", "text")
    by_lang: dict = {}
    for r in hashed.select("lang", "_hash").distinct().collect():
        by_lang.setdefault(r["lang"], []).append(r["_hash"])
    for per_lang in (1, 40, 5000):
        assert langid._edges(hashed, per_lang) == {lang: sorted(own)[:per_lang][-1] for lang, own in by_lang.items()}
    assert len(langid.learn(df, 40, 2).langs) == 5  # two centroids a language, one of a single text


def test_hosts_paths_and_rules_by_hand(spark):
    r = random.Random(13)
    parts = ["http://", "https://", "://", "a.", "net", "example.net", "Example.COM", "org", "x.org", "/", "/en/", "/de/", "/fr/", "/fr", "?q=/en/", "#/de/", "b", "NET", ".", "\n", "http://a.org/fr/", "http://b.Example.net/en/", "x://org/fr"]
    urls = ["".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(1500)]
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    expected = []
    for i, url in enumerate(urls):
        head, sign, rest = url.partition("://")
        host = re.split("[/?#]", rest)[0].translate(UPPER) if sign else ""
        path = re.split("[?#]", rest[len(host) :])[0] if sign else ""
        fits = [rule for rule in rules if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[len(rule.split("/")[0]) :])]
        rule = max(fits, key=len, default=None)
        expected.append((i, host, path, rule, rules.get(rule, "allow")))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urltrees.judge(clashing(pages), urltrees.train([]))  # trees that have learned nothing allow
    assert rows(got, "page_id", "host", "path", "rule", "verdict") == sorted(expected, key=repr)
    assert len({x[3] for x in expected}) == 5


def test_labels_that_repeat_or_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/1"), (2, "http://a.org/en/1"), (3, "http://b.org/2?x=3"), (4, "http://c.org/9"), (5, None)], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 0), (2, 1, None), (2, None, 0), (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = urltrees.labelled(clashing(pages), clashing(labels))
    assert got == [("http://a.org/en/1", "a.org", "/en/1", 1), ("http://b.org/2?x=3", "b.org", "/2", 0), ("http://c.org/9", "c.org", "/9", 0)]


def test_held_out_rank_of_labelled_urls():
    r = random.Random(5)
    hosts = [f"h{k}.org" for k in range(40)]
    learnable = sorted({(f"http://{h}/{k}{'-sale' if bad else ''}", h, f"/{k}{'-sale' if bad else ''}", bad) for k in range(400) for h, bad in [(r.choice(hosts), int(r.random() < 0.3))]})
    assert urltrees.held_out_auc(learnable) > 0.95
    assert abs(urltrees.held_out_auc([(u, h, p, int(r.random() < 0.3)) for u, h, p, _ in learnable]) - 0.5) < 0.15
    assert urltrees.held_out_auc(learnable[:0]) is None
    assert urltrees.best_size(learnable) > 5
    assert urltrees.best_size([(u, h, p, int(r.random() < 0.3)) for u, h, p, _ in learnable]) < 5  # nothing to learn


def test_one_tree_takes_the_greatest_gains():
    r = np.random.default_rng(8)
    bins = r.integers(0, 6, (300, 4)).astype(np.int16)
    label = (bins[:, 2] > 3).astype(float) * 0.7 + (bins[:, 0] > 1) * 0.2
    label = (r.random(300) < label).astype(float)
    p = np.full(300, label.mean())
    feature, cut, value = urltrees._grow(bins, p - label, p * (1 - p), 2, 0.2, 20, 1.0)

    def plain(own, depth):
        """(feature, cut, value) of a node and of those below, by trying every cut of every feature."""
        g, h = (p - label)[own].sum(), (p * (1 - p))[own].sum()
        best = (1e-9, -1, 0)
        if depth and own.sum() >= 40:
            for f in range(4):
                for c in range(6):
                    left, right = own & (bins[:, f] <= c), own & (bins[:, f] > c)
                    if min(left.sum(), right.sum()) >= 20:
                        part = [(p - label)[x].sum() ** 2 / ((p * (1 - p))[x].sum() + 1) for x in (left, right)]
                        gain = sum(part) - g * g / (h + 1)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, c)
        below = [plain(own & (bins[:, best[1]] <= best[2]), depth - 1), plain(own & (bins[:, best[1]] > best[2]), depth - 1)] if best[1] >= 0 else []
        return best[1], best[2], -0.2 * g / (h + 1), below

    def same(node, at):
        f, c, v, below = node
        assert feature[at] == f and (f < 0 or cut[at] == c) and abs(value[at] - v) < 1e-9
        for k, child in enumerate(below):
            same(child, 2 * at + 1 + k)

    same(plain(np.ones(300, bool), 2), 0)
    assert feature[0] == 2


def test_the_score_is_the_sum_of_the_trees_leaves():
    r = random.Random(4)
    data = [(f"http://h{i % 30}.org/{'9' * r.randint(1, 12)}", f"h{i % 30}.org", f"/{'9' * r.randint(1, 12)}", int(r.random() < 0.4)) for i in range(300)]
    model = urltrees.train(data, 7)
    rows_ = np.array([urltrees.lexical(u, h, p, model.suffixes) for u, h, p, _ in data])
    bins = model.binned(rows_)
    for i, chance in enumerate(model.chance(rows_)):
        score = model.base
        for feature, cut, value in model.trees:
            at = 0
            while feature[at] >= 0:
                at = 2 * at + 1 + int(bins[i, feature[at]] > cut[at])
            score += value[at]
        assert abs(chance - 1 / (1 + np.exp(-score))) < 1e-9
    assert len(model.trees) == 7


def test_url_rules_and_trees(spark):
    urls = ["http://a.Example.NET/en/1", "http://x.example.com/de/2?a=1", "http://x.example.com/en/3", "https://org/fr/", "http://net", "http://net/", "nonsense", "", None, "http://b.example.net/fr/1#t", "http://notnet/x", "http://a.org/fr?x"]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urltrees.judge(clashing(pages), urltrees.learn(pages, labels)).collect()}
    assert [got[i].rule for i in range(13)] == ["example.net/en/", "example.com/de/", None, "org/fr/", None, "net/", None, None, None, "net/", None, None, "example.net/en/"]
    assert (got[0].host, got[0].path, got[0].verdict) == ("a.example.net", "/en/1", "allow")
    assert got[1].verdict == "block" and got[5].verdict == "block" and got[8].host == "" and got[4].path == ""
    empty = pages.limit(0)
    assert rows(urltrees.judge(empty, urltrees.learn(empty, labels))) == []


def test_trees_learn_a_lexical_rule():
    r = random.Random(3)
    data = [(f"http://h{i}.org/{'9' * 12 if i % 2 else 'about'}", f"h{i}.org", f"/{'9' * 12 if i % 2 else 'about'}", i % 2) for i in range(r.randint(300, 400))]
    model = urltrees.train(data)
    rows_ = np.array([urltrees.lexical(u, h, p, model.suffixes) for u, h, p, _ in data])
    assert ((model.chance(rows_) > 0.5) == np.array([d[3] for d in data], bool)).all()


def test_tokens(docs, none):
    pytest.importorskip("sentencepiece")
    got = pieces.encode(clashing(docs)).collect()
    assert len(got) == len(corpus())
    assert all(r.parity and r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (60, 61))
    assert rows(pieces.encode(none)) == []
    raw = open(pieces.MODEL, "rb").read()
    odd = ["", " ", "  a  b ", "日本語 😀", "<s>x</s>", " lead", "tail  ", "\x00\x01", "<0x0A>", "a" * 3000, "a  b   c d", "ab cd  ef\n gh " * 40]
    whole = pieces._standard(raw).encode(odd)
    for chars in (1_000_000, 300, 7):  # as wholes, and cut at blanks
        pieces._words.cache_clear()
        found = list(pieces.encode_texts(odd, raw, chars))
        assert [x[0].tolist() for x in found] == whole
        assert all(same and alike for _, same, alike in found)
    assert pieces.decode_ids(whole, raw) == odd
    assert len(pieces.cut_text(odd[11], 7)) > 20 and " ".join(pieces.cut_text(odd[11], 7)) == odd[11]
    worded = [t for t in [r[1] for r in corpus() if r[1]] + odd if pieces._worded(t)]
    store = pieces.Words(raw, most=90, run=7)  # too small for some batches: emptied over and over
    for _ in range(2):
        for k in range(0, len(worded), 3):
            some = worded[k : k + 3]
            assert [(x.tolist(), agree) for x, agree in store.encode(some)] == [(x, True) for x in pieces._standard(raw).encode(some)]
    assert not next(pieces.encode_texts(["a▁b"], raw))[1]  # the marker itself comes back as a blank


def test_the_store_of_words_is_bounded_whatever_the_texts():
    pytest.importorskip("sentencepiece")
    raw = open(pieces.MODEL, "rb").read()
    r = random.Random(4)
    texts = ["".join(r.choice("天地玄黄宇宙洪荒abc") for _ in range(n)) for n in (4000, 20, 70, 64, 65, 900)] * 3
    texts = [t + f"x{k}" for k, t in enumerate(texts)] + ["ab " + "q" * 500 + " cd", "ab cd"]
    store = pieces.Words(raw, chars=200)
    for k in range(0, len(texts), 2):
        some = texts[k : k + 2]
        assert [(x.tolist(), agree) for x, agree in store.encode(some)] == [(x, True) for x in pieces._standard(raw).encode(some)]
        assert store.held == sum(map(len, store.at)) <= 200 and all(len(w) <= 64 for w in store.at)
        assert len(store.ids) <= 4 * 200 + len(store.at)


def test_words_without_a_first_piece_send_their_texts_whole(monkeypatch):
    pytest.importorskip("sentencepiece")
    raw = open(pieces.MODEL, "rb").read()
    texts = ["the cat and the dog", "a dog", "", "no  single blanks"]
    whole = pieces._standard(raw).encode(texts)
    first = pieces._first_of_word(raw).copy()
    first[whole[0][0]] = False  # as if the first word of all had been normalised away
    monkeypatch.setattr(pieces, "_first_of_word", lambda raw: first)
    pieces._words.cache_clear()
    assert pieces.Words(raw).encode(texts[:1]) is None
    assert [(x[0].tolist(), *x[1:]) for x in pieces.encode_texts(texts, raw)] == [(x, True, True) for x in whole]
    pieces._words.cache_clear()


def test_the_registered_query_returns_the_ids(docs, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    docs.limit(20).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["op8_sentencepiece"](docs.sparkSession, str(tmp_path)).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = dict(docs.select("doc_id", "text").collect())
    assert len(got) == 20 and all(list(r.ids) == model.encode(texts[r.doc_id] or "") for r in got if r.doc_id is not None)


def test_the_rebuilt_tokenizer_normalises_and_decodes(spark, monkeypatch):
    pytest.importorskip("sentencepiece")
    from tokenizers import decoders, normalizers

    class Local:
        """Stands for a table of two rows whose functions run in this process."""

        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": ["ab c", "AB c"]})
            frame = pa.Table.from_batches(run(iter([batch]))).to_pandas()
            return list(zip(frame["round_trip"], frame["parity"], strict=True))

    pieces._words.cache_clear()
    assert pieces.encode(Local()) == [(True, True), (True, True)]
    pieces._words.cache_clear()
    other = pieces.build(pieces.parse(open(pieces.MODEL, "rb").read()))
    rebuilt = other.normalizer, other.decoder
    monkeypatch.setattr(pieces, "_ready", lambda raw: other)
    other.normalizer = normalizers.Sequence([normalizers.Lowercase(), rebuilt[0]])
    assert pieces.encode(Local()) == [(True, True), (False, False)]
    pieces._words.cache_clear()
    other.normalizer, other.decoder = rebuilt[0], decoders.Fuse()
    assert pieces.encode(Local()) == [(False, True), (False, True)]
    pieces._words.cache_clear()


def test_unigram_models_are_rebuilt_too():
    model = pieces.Model([("<unk>", 0.0, pieces.UNKNOWN), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -2.5, 1), ("▁", -3.0, 1)], pieces.UNIGRAM, squeeze=True)
    tokenizer = pieces.build(model)
    assert tokenizer.encode("ab  a", add_special_tokens=False).ids == [3, 1]


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "phone" and 9 <= len(digits) <= 15) or (kind == "card" and 12 <= len(digits) <= 19 and semicrf.luhn(digits))
            if ok:
                out.append((m.start(), list(BASE).index(kind), m.end(), kind))
    return sorted(out)


def test_personal_data(spark, docs, none):
    r = random.Random(6)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "988-555-2485", "é", "2020-01-02", " ", " ", ".", "a@b@c.d.e"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([*enumerate(texts), (None, None), (7, texts[7])], "doc_id long, text string")
    found = {r.doc_id: r for r in semicrf.digest(semicrf.find(clashing(df))).collect()}
    for i, text in enumerate(texts):
        base = _base(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert found[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [found[i][f"n_{k}"] for k in BASE] == [sum(x[3] == k for x in base) for k in BASE]
        assert set(joined.split(",")) - {""} <= set(found[i].spans.split(","))
    assert found[None].spans == ""
    assert rows(semicrf.find(none)) == []
    assert sum(x.n_added for x in semicrf.digest(semicrf.find(docs)).collect()) == 0  # no digits, nothing found
    long = " ".join(texts) * 40 + " call 988-555-2485 or a@b.cd"
    (one,) = semicrf.digest(semicrf.find(spark.createDataFrame([(1, long)], "doc_id long, text string"))).collect()
    assert one.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in _base(long)).encode()).hexdigest()
    assert f"phone:{long.index('988-555-2485 or')}:{len(long) - len(' or a@b.cd')}" in one.spans.split(",")


def test_the_field_finds_what_the_patterns_miss():
    field = semicrf.trained()
    right = wrong = missed = 0
    for text, gold in semicrf.sentences(200, 99):
        tokens = [m.span() for m in semicrf._TOKEN.finditer(text)]
        got = {(tokens[i][0], tokens[j - 1][1], semicrf.KINDS[k - 1]) for i, j, k in field.best(text, tokens)}
        right, wrong, missed = right + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95
    assert semicrf.masked("ab 988-555-2485 c", [(3, 15, "phone")]) == "ab <PHONE> c"
