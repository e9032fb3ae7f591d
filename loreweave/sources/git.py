"""What a repository's history says, collected on the driver by the git command and turned into tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run(folder: str, *args: str, timeout: int = 60) -> str | None:
    """Output of a git command; null if it fails."""
    try:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def head(folder: str) -> str | None:
    out = run(folder, "rev-parse", "HEAD")
    return out.strip() if out else None


def changed(spark: SparkSession, folder: str, since: str, until: str = "HEAD") -> DataFrame:
    """(path): files added, copied, modified or renamed between two commits."""
    out = run(folder, "diff", "--name-only", "--diff-filter=ACMR", f"{since}..{until}") or ""
    return spark.createDataFrame([(x.strip().replace("\\", "/"),) for x in out.splitlines() if x.strip()], "path string")


def diff(folder: str, since: str, until: str, paths: list[str], most: int) -> str:
    """The unified diff of some files, cut at ``most`` characters."""
    out = run(folder, "diff", "--no-color", "--unified=3", f"{since}..{until}", "--", *paths) if paths else None
    return "" if not out else out if len(out) <= most else out[:most] + "\n[... diff truncated ...]"


def history(spark: SparkSession, folder: str, most: int = 10_000) -> DataFrame:
    """(commit, day, subject, path, added, deleted) of the last commits; counts of binary files are null."""
    out = run(folder, "log", f"-{most}", "--numstat", "--date=short", "--format=%x00%H%x01%ad%x01%s") or ""
    return parse_history(spark.createDataFrame([(x,) for x in out.split("\0") if x.strip()], "block string"))


def parse_history(blocks: DataFrame) -> DataFrame:
    """``history`` from its text: a block for each commit, its fields parted by a control character, then a line for each file."""
    lines = F.split("block", "\n")
    fields = F.split(F.get(lines, 0), "\u0001")
    rows = blocks.select(F.get(fields, 0).alias("commit"), F.get(fields, 1).alias("day"), F.get(fields, 2).alias("subject"), F.explode(F.filter(lines, lambda x: x.rlike(r"^[0-9-]+\t[0-9-]+\t"))).alias("line"))
    part = F.split("line", "\t", 3)
    return rows.select("commit", "day", "subject", F.get(part, 2).alias("path"), F.get(part, 0).try_cast("int").alias("added"), F.get(part, 1).try_cast("int").alias("deleted"))
