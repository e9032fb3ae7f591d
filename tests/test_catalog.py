"""Names of registered collections against a walk that registers one after the other."""

import random

from pyspark.sql import functions as F

from loreweave.operators import catalog

REGISTRY, ROOTS = "name string, root string, enabled boolean, added string", "root string, name string, ord long"


def _registered(spark, names, roots):
    registry = spark.createDataFrame([(n, f"/old/{i}", True, "2025") for i, n in enumerate(names)], REGISTRY)
    return catalog.register(registry, spark.createDataFrame(roots, ROOTS), "2026")


def test_names_past_those_that_are_taken_are_those_of_a_walk(spark):
    r = random.Random(3)
    names = ["a", "a-2", "a-3", "a-7", "a-07", "a-1", "b-2", "b-99999999999999999999", "c-5-2", "x\ny", "x\ny-3", *[f"d-{i}" for i in r.sample(range(1, 60), 30)]]
    roots = [(f"/new/{i}", r.choice(["a", "b", "c-5", "d", "d", "x\ny"]), r.randrange(50)) for i in range(120)] + [("/old/1", "a", 0), ("/twice", "b", 90), ("\\twice\\", "a", 70)]
    used, held, expected = set(names), {f"/old/{i}" for i in range(len(names))}, {}
    for ord_, root, base in sorted((o, root.replace("\\", "/").rstrip("/"), base) for root, base, o in roots):
        if root in held:
            continue
        n = 1
        while (name := base if n == 1 else f"{base}-{n}") in used:
            n += 1
        used.add(name)
        held.add(root)
        expected[root] = name
    got = {x.root: x.name for x in _registered(spark, names, roots).where("added = '2026'").collect()}
    assert got == expected


def test_many_roots_of_one_name_are_no_rows_of_all_names_before_them(spark):
    # 40,000 roots that each listed the names up to their own would make 800 million names
    rows = spark.range(40_000).select(F.concat(F.lit("/new/"), "id").alias("root"), F.lit("s").alias("name"), F.col("id").alias("ord"))
    got = catalog.register(spark.createDataFrame([("s-4", "/old", True, "2025")], REGISTRY), rows, "2026")
    found = got.where("added = '2026'").agg(F.count_distinct("name"), F.max(F.regexp_extract("name", r"\d+", 0).try_cast("long"))).head()
    assert tuple(found) == (40_000, 40_001)
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
