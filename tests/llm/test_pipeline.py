"""The pipeline's stages, one by one against plain versions, and as a whole."""

import re

import corpus_pipeline as pipeline
from loreweave.llm import pieces, semicrf, simhash

from .conftest import clashing, corpus


def _table(spark, tmp_path, items):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_columns_and_rows(spark, tmp_path):
    item = " ".join(corpus()[2][1].split()[:25])
    sf = _table(spark, tmp_path, [(1, item), (2, None)])
    docs = clashing(spark.read.parquet(f"{sf}/documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/{name.replace(' ', '_')}.parquet")
        docs = spark.read.parquet(f"{sf}/{name.replace(' ', '_')}.parquet")
    assert all(item not in (r.text or "") for r in docs.collect())


def test_whole_run_against_plain_steps(spark, tmp_path):
    sf = _table(spark, tmp_path, [(1, "zzz zzz zzz zzz zzz zzz zzz zzz zzz zzz")])
    from loreweave.llm import lines

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in lines.clean(docs).collect()]
    # one row of each near-duplicate component, by all pairs
    prints = [(i, t, simhash.fingerprint(t)) for i, t in kept]
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][2] ^ prints[b][2]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    first = {}
    for k, (i, t, _) in enumerate(prints):
        key = (i is None, i or 0)
        if root(k) not in first or key < first[root(k)][0]:
            first[root(k)] = (key, i, t)
    field = semicrf.trained()
    raw = open(pieces.MODEL, "rb").read()
    expected = set()
    for _, i, t in first.values():
        base = semicrf.base_spans(t)
        text = semicrf.masked(t, base + semicrf.added_spans(t, base, field))
        expected.add((i, tuple(pieces._standard(raw).encode([text])[0])))
    got = {(r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, sf).collect()}
    assert got == expected
    assert re.fullmatch("[a-z A-Z-]+", " ".join(n for n, _ in pipeline.STAGES[:3]))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
