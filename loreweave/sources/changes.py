"""Changes of a folder of pages, removals too, as a log that only grows and that a stream can read."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.session import cut

from .markdown import SKIPPED, scan
from .snapshots import Change, SnapshotTable

CHANGE = "path string, seq long, gone boolean, stamp string, text string"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, stamp, modified): the pages that ``scan`` would read, by their files' time and length; no file is opened.

    A root that isn't there raises: an outage is not a folder whose pages all went.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    path = F.right("path", F.length("path") - F.instr("path", base) - (len(base) - 1))
    named = files.select(path.alias("path"), F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("stamp"), F.col("modificationTime").alias("modified"))
    return named.where(~F.exists(F.split("path", "/"), lambda s: s.isin(*SKIPPED) | s.startswith(".")))


def differences(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, gone): pages whose stamp is new or another one, and pages that went, by one outer join on path.

    Both have path (unique in each) and stamp; a null stamp is a stamp like any other.
    """
    old, new = before.select("path", F.struct("stamp").alias("_old")), now.select("path", F.struct("stamp").alias("_new"))
    met = old.join(new, "path", "full_outer")
    return met.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("path", F.col("_new").isNull().alias("gone"))


def latest(changes: DataFrame) -> DataFrame:
    """Of each path its last change: (path, seq, gone, stamp, text). Changes of one poll that repeat are one."""
    names = [c for c in ("gone", "stamp", "text") if c in changes.columns]
    last = F.max_by(F.struct(*names), F.struct("seq", ~F.col("gone")))
    return changes.groupBy("path").agg(F.max("seq").alias("seq"), last.alias("_last")).select("path", "seq", *[f"_last.{c}" for c in names])


class PageChanges:
    """The log of a folder's changes: ``changes`` holds them, ``listing`` the pages as the log had them at some number.

    ``poll`` adds to the log in what the folder differs from it. The log alone says what is known: the kept listing is
    there so that only changes after its number are read again, and a poll that dies before it is in place, or with half
    of its changes written, is made up for by the next one. Taking a change twice does no harm. ``stream`` reads the log.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str) -> None:
        self.spark, self.root, self.folder = spark, root, folder
        self.seen = SnapshotTable(spark, f"{folder}/listing", "path string, stamp string, half int", ["half"])

    def _log(self) -> DataFrame:
        self.spark.createDataFrame([], CHANGE).write.mode("ignore").parquet(f"{self.folder}/changes")
        return self.spark.read.schema(CHANGE).parquet(f"{self.folder}/changes")

    def poll(self) -> int:
        """Add what changed; gives the number of changes. Only files as new as the oldest changed one are opened, which
        their listing tells."""
        now = cut(listing(self.spark, self.root))
        held = self.seen.latest()
        mark = int(held.notes.get("seq", 0))
        after = latest(self._log().where(F.col("seq") > mark).select("path", "seq", "gone", "stamp"))
        known = self.seen.read(held).select("path", "stamp").join(after, "path", "left_anti").unionByName(after.where("not gone").select("path", "stamp"))
        found = cut(differences(known, now).join(now.select("path", "stamp", "modified"), "path", "left"))
        count, oldest = found.agg(F.count("*"), F.min("modified")).head()
        if not count:
            return 0
        seq = max(mark + 1, (after.agg(F.max("seq")).head()[0] or 0) + 1, time.time_ns() // 1_000_000)
        rows = found.where("gone").withColumn("text", F.lit(None).cast("string"))
        if oldest is not None:  # a page that goes between listing and reading is found gone by the next poll
            rows = rows.unionByName(found.where("not gone").join(scan(self.spark, self.root, since=oldest), "path"))
        rows.select("path", F.lit(seq).cast("long").alias("seq"), "gone", "stamp", "text").write.mode("append").parquet(f"{self.folder}/changes")
        written = self._log().where(F.col("seq") == seq).select("path", "stamp", "gone")
        kept = known.join(written, "path", "left_anti").unionByName(written.where("not gone").drop("gone"))
        fresh = self.seen.write(kept.select("path", "stamp", F.lit(0).alias("half")))
        self.seen.commit(lambda old: Change({k: [] for k in old.parts} | fresh, {"seq": seq}, everything=True))
        return count

    def stream(self, files: int = 1000) -> DataFrame:
        """The log as a stream of (path, seq, gone, stamp, text), at most ``files`` files of it in a batch."""
        self._log()
        return self.spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files).parquet(f"{self.folder}/changes")
