"""Collections found on a file system, joined with those that are registered."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists, listing, read_text

SKIPPED = ("node_modules", "dist", "build", "out", "coverage", "vendor", "target", "venv", "__pycache__")
FOUND = "root string, name string, marker string, pages long, raw_sources long"


def clean_root(root: str) -> str:
    return root.replace("\\", "/").rstrip("/")


def scan(spark: SparkSession, roots: list[str], state: str = ".wiki-state", settings: str = ".wiki.json", depth: int = 6) -> DataFrame:
    """(root, name, marker, pages, raw_sources): folders that are collections, from 1 to 12 levels down.

    A folder is one if it holds the ``state`` folder, or ``wiki`` beside ``raw``, or ``wiki/index.md``; or if a
    project's ``settings`` file names it as its root. What stands inside a collection belongs to it.
    """
    depth = max(1, min(depth, 12))
    found: dict[str, str] = {}
    for start in map(clean_root, roots):
        todo, seen = [(start, 0)], set()
        while todo:
            folder, level = todo.pop()
            if folder in seen or not exists(spark, folder):
                continue
            seen.add(folder)
            marker = _marker(spark, folder, state)
            if marker:
                found.setdefault(folder, marker)
                continue
            named = _configured(spark, folder, settings)
            if named and _marker(spark, named, state):
                found.setdefault(named, "project-config")
            if level < depth:
                inner = listing(spark, folder, depth=0)
                todo += [(f"{folder}/{name}", level + 1) for _, name, is_folder, *_ in inner if is_folder and not name.startswith(".") and name not in SKIPPED]
    from loreweave.functions.text import collection_name

    rows = [(root, marker, *_sizes(spark, root)) for root, marker in found.items()]
    df = spark.createDataFrame(rows, "root string, marker string, pages long, raw_sources long")
    return df.select("root", collection_name(F.col("root")).alias("name"), "marker", "pages", "raw_sources")


def _marker(spark: SparkSession, folder: str, state: str) -> str | None:
    if exists(spark, f"{folder}/{state}"):
        return "state-dir"
    docs = exists(spark, f"{folder}/wiki") and (exists(spark, f"{folder}/raw") or exists(spark, f"{folder}/wiki/index.md"))
    return "docs-layout" if docs else None


def _configured(spark: SparkSession, folder: str, settings: str) -> str | None:
    if not exists(spark, f"{folder}/{settings}"):
        return None
    try:
        root = json.loads(read_text(spark, f"{folder}/{settings}")).get("wikiRoot")
    except (ValueError, AttributeError):
        return None
    if not isinstance(root, str) or not root.strip():
        return None
    return clean_root(root if root.startswith("/") or "://" in root else f"{folder}/{root}")


def _sizes(spark: SparkSession, root: str) -> tuple[int, int]:
    generated = ("index.md", "log.md", "toc.md")
    pages = [n for p, n, f, *_ in listing(spark, f"{root}/wiki", depth=20, skipped=("raw", "toc")) if not f and n.endswith(".md") and n not in generated]
    raw = [n for _, n, f, *_ in listing(spark, f"{root}/raw", depth=20) if not f and n.endswith(".md")]
    return len(pages), len(raw)


def discovered(found: DataFrame, registry: DataFrame, states: DataFrame) -> DataFrame:
    """What was found, what is registered (with its name), and their index: most pages first, then by root.

    ``registry``: name, root, enabled; ``states``: name, chunks, model, updated_at. A registered root that wasn't found
    is missing.
    """
    own = registry.select(F.regexp_replace(F.regexp_replace("root", r"\\", "/"), "/+$", "").alias("root"), F.col("name").alias("_name"), "enabled")
    both = found.join(own, "root", "full")
    named = both.withColumn("name", F.coalesce("_name", "name")).withColumn("registered", F.col("_name").isNotNull()).withColumn("missing", F.col("marker").isNull())
    rows = named.join(states.select("name", "chunks", "model", "updated_at"), "name", "left")
    kept = rows.select("root", "name", F.coalesce("marker", F.lit("registry")).alias("marker"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("raw_sources", F.lit(0)).alias("raw_sources"), "registered", F.coalesce("enabled", F.lit(False)).alias("enabled"), "missing", "chunks", "model", "updated_at")
    return kept.orderBy(F.desc("pages"), "root")
