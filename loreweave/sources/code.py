"""A project's code: its files, their imports, its entry points, tests and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators.lint import is_entry

from .files import listed

#: Endings of code files, folders not gone into, manifests.
ENDINGS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "rb")
SKIPPED = ("node_modules", "dist", "build", "out", "coverage", "vendor", "target", "venv", "__pycache__")
MANIFESTS = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "requirements.txt", "pom.xml", "build.gradle")


def scan(spark: SparkSession, root: str, depth: int = 7) -> DataFrame:
    """(path, text): the code files under a folder, hidden and built ones aside; paths relative to it, empty files included."""
    names = listed(spark, root, depth=depth, skipped=SKIPPED).where(~F.col("folder") & F.regexp_extract("name", r"\.([A-Za-z]+)$", 1).isin(*ENDINGS)).select("path")
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").load(root)
    base, file = root.rstrip("/").split("://")[-1] + "/", F.col("_metadata.file_path")
    path = F.url_decode(F.right(file, F.length(file) - F.instr(file, base) - (len(base) - 1)))
    return names.join(files.select(path.alias("path"), F.col("value").alias("text")), "path", "left").withColumn("text", F.coalesce("text", F.lit("")))


def import_specs(path: Column, text: Column) -> Column:
    """What a file imports, as it is written there."""
    python = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:from|import)\s+([.\w/]+)"), F.lit(1))
    others = F.transform(
        F.regexp_extract_all(text, F.lit(r"""(from\s+["'][^"']+["']|import\s+["'][^"']+["']|require\(\s*["'][^"']+["']\s*\))"""), F.lit(1)),
        lambda x: F.regexp_extract(x, r"""["']([^"']+)["']""", 1),
    )
    return F.when(path.endswith(".py"), python).otherwise(others)


def imports(files: DataFrame, most: int = 200_000) -> DataFrame:
    """(path, spec) of all imports; files over ``most`` characters are generated ones and have none."""
    return files.where(F.length("text") <= most).select("path", F.explode(import_specs(F.col("path"), F.col("text"))).alias("spec"))


def is_test(path: Column) -> Column:
    return path.rlike(r"(?i)(^|[._-])(test|spec)\.") | F.contains(path, F.lit("/tests/")) | path.startswith("tests/")


def counts(files: DataFrame) -> DataFrame:
    """One row: files, test files and entry points."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if(is_test(F.col("path"))).alias("test_files"), F.array_sort(F.collect_list(F.when(is_entry(F.col("path")), F.col("path")))).alias("entry_points"))


def manifests(files: DataFrame) -> DataFrame:
    """Manifests of a project and of its packages, the project's first. ``files``: path."""
    own = F.col("path").isin(*MANIFESTS)
    return files.where(own | F.col("path").rlike(r"^packages/[^/]+/package\.json$")).select("path").orderBy(F.when(own, 0).otherwise(1), "path")
