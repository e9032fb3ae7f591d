"""The language and personal-data models against plain versions: every segmentation, every centroid."""

import math
import random

import numpy as np
import pytest

from loreweave.llm import langid, semicrf

from .conftest import clashing, corpus


def _all_ways(n, segments):
    """Every segmentation of n tokens into entities and single ordinary tokens, as lists of (start, end, type, features)."""
    from_start = {}
    for s in segments:
        from_start.setdefault(s[0], []).append(s)

    def ways(at):
        if at == n:
            yield []
            return
        for s in [(at, at + 1, 0, []), *from_start.get(at, [])]:
            for rest in ways(s[1]):
                yield [s, *rest]

    return list(ways(0))


def _value(field, way):
    total, prior = 0.0, 0
    for _, _, kind, features in way:
        total += field.moves[prior][kind] + sum(field.weights.get(f, 0.0) for f in features)
        prior = kind
    return total


def _texts():
    r = random.Random(11)
    made = [t for t, _ in semicrf.sentences(120, 5)] + ["4111 1111 1111 1111", "a @ b.co 555-123-4567", "10.0.0.1-10.0.0.2", "no digits here", ""]
    for text in made:
        tokens = [m.span() for m in semicrf._TOKEN.finditer(text)]
        start = r.randrange(max(1, len(tokens) - 9))
        yield text, tokens[start : start + 9]


def _random_field(seed, segments):
    r, field = random.Random(seed), semicrf.Field()
    field.weights = {f: r.gauss(0, 1) for s in segments for f in s[3]}
    field.moves = [[r.gauss(0, 1) for _ in row] for row in field.moves]
    return field


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_the_chosen_segmentation_is_the_best_of_all(seed):
    entities = 0
    for text, tokens in _texts():
        field = semicrf.trained()
        segments = field.segments(text, tokens)
        if seed is not None:
            field = _random_field(seed, segments)
        if not segments:
            assert field.best(text, tokens) == []
            continue
        ways = _all_ways(len(tokens), segments)
        best = max(_value(field, w) for w in ways)
        got = field.best(text, tokens)
        same = [w for w in ways if [s[:3] for s in w if s[2]] == got]
        assert len(same) == 1 and math.isclose(_value(field, same[0]), best, abs_tol=1e-9)
        entities += len(got)
    assert entities > 20


def test_a_step_of_learning_is_the_gradient_over_all_segmentations():
    steps = 0
    for text, tokens in _texts():
        segments = semicrf.Field().segments(text, tokens)
        ways = _all_ways(len(tokens), segments)
        if len(segments) < 2 or len(ways) > 3000:
            continue
        field, plain = _random_field(3, segments), _random_field(3, segments)
        gold = max(ways, key=lambda w: (sum(s[1] - s[0] for s in w if s[2]), str([s[:3] for s in w])))
        field.learn(text, tokens, segments, {s[:3] for s in gold if s[2]}, 0.1)
        values = [_value(plain, w) for w in ways]
        whole = math.log(sum(map(math.exp, values)))
        weights, moves = dict(plain.weights), [list(row) for row in plain.moves]
        for way, share in [(gold, 0.1), *((w, -0.1 * math.exp(v - whole)) for w, v in zip(ways, values, strict=True))]:
            prior = 0
            for _, _, kind, features in way:
                moves[prior][kind] += share
                prior = kind
                for f in features:
                    weights[f] += share
        assert np.allclose(field.moves, moves, atol=1e-8)
        assert all(math.isclose(field.weights[f], weights[f], abs_tol=1e-8) for f in weights)
        steps += 1
    assert steps > 20


def _plain_counts(text):
    """Counts of the text's grams of one to three bytes, cell by cell, in Python's whole numbers."""
    bare = langid._NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(c.isalpha() for c in bare):
        return None
    b, out = f" {bare} ".encode(), {}
    for at in range(len(b)):
        one = b[at]
        two = b[at] * 257 + b[at + 1] if at + 1 < len(b) else None
        three = (two * 65599 + b[at + 2]) & 0xFFFFFFFF if at + 2 < len(b) else None
        for gram in (one, None if two is None else two + (1 << 17), None if three is None else three ^ 0x5BD1E995):
            if gram is not None:
                cell = (gram * 2654435761 & 0xFFFFFFFF) >> 19
                out[cell] = out.get(cell, 0) + 1
    return out


def test_languages_by_plain_cosines(spark, docs):
    known = [(r[1], r[2]) for r in corpus() if r[1] and r[2]] + [("der hund und die katze", "de"), ("le chien et le chat", "fr"), ("été à la mer", "fr")]
    train = spark.createDataFrame(known, "text string, lang string")
    model = langid.learn(train, per_lang=25, k=3)
    texts = [r[1] for r in corpus()] + ["der katze", "ÉTÉ", "12 34", "x", "日本語", "a\x00b"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(clashing(asked), model).collect()}
    rejected = 0
    for k, text in enumerate(texts):
        counts = _plain_counts(text) if text is not None else None
        if counts is None:
            assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
            continue
        row = {c: math.log1p(n) * float(model.idf[c]) for c, n in counts.items()}
        length = math.sqrt(sum(x * x for x in row.values()))
        near = [sum(x / length * float(centroid[c]) for c, x in row.items()) for centroid in model.centroids]
        best = max(near)
        assert math.isclose(got[k].score, best, abs_tol=1e-4)
        assert got[k].lang_pred in {lang for lang, x in zip(model.langs, near, strict=True) if x > best - 1e-4}
        reach = {float(e) for e, x in zip(model.reach, near, strict=True) if x > best - 1e-4}
        assert any(got[k].rejected == (best < e) or abs(best - e) < 1e-4 for e in reach)
        rejected += got[k].rejected
    assert rejected


def test_one_centroid_is_the_mean_of_plain_tf_idf():
    texts = ["the cat and the dog", "the dog", "der hund und", "die katze und der hund", "a cat"]
    langs = np.array(["en", "en", "de", "de", "en"], object)
    counts = [_plain_counts(t) for t in texts]
    model = langid.fit(np.array([langid.gram_counts(t) for t in texts]), langs, k=1)
    seen = {c: sum(c in own for own in counts) for own in counts for c in own}
    idf = {c: math.log((1 + len(texts)) / (1 + n)) + 1 for c, n in seen.items()}
    assert all(math.isclose(model.idf[c], x, rel_tol=1e-5) for c, x in idf.items())
    assert list(model.langs) == ["de", "en"]
    for at, lang in enumerate(model.langs):
        total = np.zeros(langid.CELLS)
        for own, its in zip(counts, langs, strict=True):
            if its == lang:
                row = np.zeros(langid.CELLS)
                for c, n in own.items():
                    row[c] = math.log1p(n) * idf[c]
                total += row / np.sqrt((row * row).sum())
        assert np.allclose(model.centroids[at], total / np.sqrt((total * total).sum()), atol=1e-5)
