"""Registries of collections and their catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import collection_name

from .lint import resolved_path


def union_keep_last(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Rows of both; where keys meet, the second's."""
    return first.join(second.select(*keys), list(keys), "left_anti").unionByName(second)


def catalog(registry: DataFrame, manifests: DataFrame, states: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """name, pages, chunks, recency and flags of registered collections: the most recent first, then by name.

    ``manifests``: name, pages, generated_at, newest; ``states``: name, chunks, fingerprint, updated_at, current.
    """
    both = registry.join(manifests, "name", "left").join(states, "name", "left")
    flags = F.array_compact(
        F.array(
            F.when(~F.col("enabled"), "disabled"),
            F.when(F.col("generated_at").isNull(), "no_toc"),
            F.when(F.col("newest") > F.col("generated_at"), "toc_stale"),
            F.when(F.col("updated_at").isNull(), "no_index"),
            F.when(F.col("fingerprint") != F.col("current"), "index_stale"),
        )
    )
    recency = F.coalesce("updated_at", "generated_at", F.lit(""))
    rows = both.select("name", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chunks", F.lit(0)).alias("chunks"), recency.alias("recency"), F.array_join(flags, ",").alias("flags"))
    return rows.orderBy(F.desc("recency"), "name").offset(offset).limit(max(1, min(limit, 100)))


def owners(paths: DataFrame, roots: DataFrame, most: int = 20) -> DataFrame:
    """(path, name, ambiguous): the collections whose root holds a path. ``paths``: path; ``roots``: name, root.

    Every folder above a path is looked up among the roots, so the join is on equal folders.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    some = paths.orderBy("path").limit(most) if most else paths
    found = some.select("path", F.explode(above).alias("root")).join(roots, "root").select("path", "name").distinct()
    return found.withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy("path")) > 1)


def raw_names(sources: DataFrame) -> DataFrame:
    """File names of raw sources: date-slug.md; further ones of a name get the hash's first eight digits, then a number.

    ``sources``: day, slug, sha, ord.
    """
    base = F.concat_ws("-", "day", "slug")
    by_name = Window.partitionBy("day", "slug").orderBy("ord")
    by_sha = Window.partitionBy("day", "slug", "sha8").orderBy("ord")
    rows = sources.withColumn("sha8", F.substring("sha", 1, 8)).withColumn("n", F.row_number().over(by_name))
    again = F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).over(by_sha)
    tail: Column = F.when(F.col("n") == 1, "").when(again == 1, F.concat(F.lit("-"), "sha8")).otherwise(F.concat(F.lit("-"), "sha8", F.lit("-"), again))
    return rows.withColumn("name", F.concat(base, tail, F.lit(".md"))).select("day", "slug", "sha", "ord", "name")


def unique_names(rows: DataFrame) -> DataFrame:
    """Registry names made unique: the first keeps its name, others get -2, -3 and so on. ``rows``: name, ord."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    return rows.withColumn("unique_name", F.when(n == 1, F.col("name")).otherwise(F.concat_ws("-", "name", n)))


def register(registry: DataFrame, roots: DataFrame, now: str, home: str = "") -> DataFrame:
    """``registry`` (name, root, enabled, added) with new roots, each under a name of its own.

    ``roots``: root, name (or null), ord. A root that is registered keeps its row. A name that is taken gets -2, -3 and
    so on, past the ones that are there.
    """
    plain = F.regexp_replace(F.regexp_replace("root", r"\\", "/"), "/+$", "")
    new = roots.withColumn("root", plain).groupBy("root").agg(F.min(F.struct("ord", "name")).alias("_first")).select("root", "_first.*").join(registry.select("root"), "root", "left_anti")
    new = new.withColumn("base", F.coalesce(F.nullif(F.trim("name"), F.lit("")), collection_name(F.col("root"), home)))
    # a name is number 1 of itself, and number n of what stands before a last -n
    numbered = F.regexp_extract("name", r"(?s)^(.*)-([1-9][0-9]{0,17})$", 2).try_cast("long")
    before = F.regexp_extract("name", r"(?s)^(.*)-([1-9][0-9]{0,17})$", 1)
    names = registry.select("name").where("name is not null")
    taken = names.select(F.col("name").alias("base"), F.lit(1).cast("long").alias("number")).unionByName(names.select(before.alias("base"), numbered.alias("number")).where("number > 1")).distinct()
    # the nth free number of a base is n and as many more as are taken with less than n free ones before them
    free = F.col("number") - F.row_number().over(Window.partitionBy("base").orderBy("number"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("ord", "root")).cast("long")
    both = new.select("base", "root", nth.alias("_at"), F.lit(0).alias("_taken")).unionByName(taken.select("base", F.lit(None).cast("string").alias("root"), free.alias("_at"), F.lit(1).alias("_taken")))
    passed = F.sum("_taken").over(Window.partitionBy("base").orderBy("_at", "_taken").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_number", F.col("_at") + passed).where("_taken = 0")
    rows = placed.select(F.when(F.col("_number") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "_number")).alias("name"), "root", F.lit(True).alias("enabled"), F.lit(now).alias("added"))
    return registry.select("name", "root", "enabled", "added").unionByName(rows)


def set_enabled(registry: DataFrame, names: list[str], enabled: bool) -> DataFrame:
    return registry.withColumn("enabled", F.when(F.col("name").isin(names), enabled).otherwise(F.col("enabled")))


def unregister(registry: DataFrame, names: list[str]) -> DataFrame:
    return registry.where(~F.col("name").isin(names))


def enabled_names(registry: DataFrame) -> DataFrame:
    return registry.where("enabled").select("name")


def resolve_pages(asked: DataFrame, files: DataFrame, wiki: str, root: str, base: str | None = None) -> DataFrame:
    """(page, file): the first place where each named page exists; pages that exist nowhere are left out.

    Places, in order: as it stands, if it is absolute; else under ``base`` (the caller's folder, only inside one
    collection), under the collection's ``wiki`` folder, under its ``root``. ``asked``: page; ``files``: path (absolute).
    """
    absolute = F.col("page").startswith("/")
    places = [F.when(absolute, F.col("page")), *[F.when(~absolute, resolved_path(F.lit(f"{x.rstrip('/')}/_"), F.col("page"))) for x in (base, wiki, root) if x]]
    slash = lambda x: F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))
    one = asked.distinct().select("page", F.posexplode(F.array(*[slash(p) for p in places])).alias("at", "file")).where("file is not null")
    there = one.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    return there.groupBy("page").agg(F.min_by("file", "at").alias("file"))


def project_roots(roots: DataFrame, entries: DataFrame, most: int = 5) -> DataFrame:
    """(root, project): the nearest folder above a collection's root (itself included) that holds a repository.

    Without one within ``most`` folders: the folder above, or two above if that is one of documents. ``roots``: root;
    ``entries``: path of every repository folder (ending in .git).
    """
    parts = F.split(F.regexp_replace("root", "/+$", ""), "/")
    up = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - n, F.lit(1))), "/"))
    held = entries.select(F.regexp_replace("path", r"/\.git$", "").alias("project"), F.lit(True).alias("held"))
    near = roots.select("root", F.posexplode(up).alias("at", "project")).join(held, "project").groupBy("root").agg(F.min_by("project", "at").alias("found"))
    above = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "/")
    second = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1))), "/")
    documents = F.lower(F.element_at(F.split(above, "/"), -1)).isin("docs", "documentation")
    return roots.join(near, "root", "left").select("root", F.coalesce("found", F.when(documents, second).otherwise(above)).alias("project"))
