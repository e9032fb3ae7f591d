"""The inverted file of vectors against a plain scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.operators import cells

BAD = [("zero", [0.0] * 8), ("none", None), ("short", [1.0]), ("nan", [float("nan")] * 8), ("hole", [1.0] * 7 + [None]), ("empty", [])]


def _rows(n=900, seed=3):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(12, 8))
    rows = [(f"k{i}", (centre[i % 12] + 0.05 * r.normal(size=8)).tolist()) for i in range(n)]
    return rows + [(f"copy{i}", rows[5][1]) for i in range(n // 3)] + BAD


def _brute(rows, asked, k):
    good = [(key, np.array(v) / np.linalg.norm(v)) for key, v in rows if key not in dict(BAD)]
    keys, m = [x[0] for x in good], np.array([x[1] for x in good])
    own = dict(good)
    out = []
    for q in asked:
        scores = np.round(m @ own[q], 6)
        best = sorted(zip(-scores, keys, strict=True))[:k]
        out += [(q, key, at + 1, -s) for at, (s, key) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"cells": 1}, {"cells": 30, "rows": 7, "sample": 60}])
def test_cells_give_what_a_scan_gives(spark, limits):
    rows = _rows()
    df = spark.createDataFrame(rows, "key string, embedding array<double>").withColumn("cell", F.lit("clash")).repartition(3)
    asked = [f"k{i}" for i in range(0, 900, 60)] + ["k5", "copy7"]
    queries = df.where(F.col("key").isin([*asked, *dict(BAD)])).withColumnRenamed("key", "query_id")
    index = cells.build(df, **limits)
    got = index.search(queries, 6).collect()
    assert sorted((r.query_id, r.key, r["rank"], r.score) for r in got) == _brute(rows, asked, 6)
    assert index.parts.agg(F.max("n")).head()[0] <= limits.get("rows", 4096)
    opened, all_rows = sum(r.opened for r in got) / len(asked), 1200
    assert opened == all_rows if limits.get("cells") == 1 else opened < all_rows / 2


def test_few_rows_numbers_as_keys_and_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-2.0, 0.0]), (4, [0.0, 0.0])], "key long, embedding array<float>")
    queries = df.selectExpr("key as query_id", "embedding").unionByName(df.limit(1).selectExpr("cast(null as bigint) as query_id", "embedding"))
    got = cells.build(df).search(queries, 5, probe=1)
    assert sorted((r.query_id, r["rank"], r.key, r.score) for r in got.collect() if r.query_id == 1) == [(1, 1, 1, 1.0), (1, 2, 2, 0.707107), (1, 3, 3, -1.0)]
    assert got.count() == 9
    assert cells.build(df.where("key > 9")).search(queries).count() == 0
    assert cells.build(df.where("key = 4")).search(queries).count() == 0
    assert cells.build(df).search(queries.where("query_id > 9")).count() == 0
