"""A kept inverted index over pages: segments of token buckets in a snapshot table, brought up to date by what changed.

A refresh compares the pages' hashes with those in the index and reads no text that is there already: new and changed pages become
a segment of their own, those that changed or went are marked in the segment that holds them, and the postings that this
takes from each token are noted beside it. Segments are put together anew when there are many of them, or when much of them is dead. A search
opens the buckets of its tokens only, and of those only the ranges that can reach the best scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import postings
from loreweave.operators.chunking import index_diff
from loreweave.session import cut

from .snapshots import Change, Snapshot, SnapshotTable

#: Buckets of tokens; segments before they are put together; the share of dead pages that does so.
BUCKETS, SEGMENTS, ROTTEN = 64, 8, 0.25
LISTS, GONE = "lists", "gone"


def bucket(token):
    return F.when(token.isin(postings.EVERY, postings.DEAD), F.lit(LISTS)).otherwise(F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("string"))


def page_hash():
    return F.sha2(F.to_json(F.array("title", "rest", "text")), 256)


class TextIndex:
    """Partitions are (segment, bucket); the bucket ``lists`` of a segment lists its pages, segment ``gone`` holds what no
    longer counts. A missing folder is an empty index."""

    def __init__(self, spark: SparkSession, folder: str, range_size: int = postings.RANGE) -> None:
        self.spark, self.size = spark, range_size
        self.table = SnapshotTable(spark, folder, f"{postings.BLOCK}, segment string, bucket string", ["segment", "bucket"])

    def _write(self, held: DataFrame, segment: str) -> dict:
        return self.table.write(held.withColumn("segment", F.lit(segment)).withColumn("bucket", bucket(F.col("token"))))

    def pages(self, now: Snapshot | None = None) -> DataFrame:
        """(path, hash, range, slot, len) of the pages that count."""
        now = self.table.latest() if now is None else now
        listed = self.table.read(now, lambda k: k[1] == LISTS)
        live = listed.where(F.col("token") == postings.EVERY).select("range", F.explode(F.arrays_zip("paths", "hashes", "slots", "lens")).alias("p"))
        live = live.select(F.col("p.paths").alias("path"), F.col("p.hashes").alias("hash"), "range", F.col("p.slots").alias("slot"), F.col("p.lens").alias("len"))
        dead = listed.where(F.col("token") == postings.DEAD).select("range", F.explode("slots").alias("slot"))
        return live.join(dead, ["range", "slot"], "left_anti")

    def refresh(self, pages: DataFrame) -> dict[str, int]:
        """Bring the index up to ``pages`` (path, title, rest, text), one transaction: how many were embed, skip, remove.

        Pages without a path are left out; of pages that share a path one is kept, by its hash.
        """
        counts: dict[str, int] = {}
        hashed = pages.where("path is not null").select("path", "title", "rest", "text").withColumn("hash", page_hash())
        current = hashed.groupBy("path").agg(F.min("hash").alias("hash"))

        def work(now: Snapshot) -> Change:
            counts.clear()
            stored = self.pages(now)
            key = F.lit("page").alias("key")
            todo = cut(index_diff(current.select("path", key, "hash"), stored.select("path", key, "hash")))
            counts.update({r["action"]: r["n"] for r in todo.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()})
            dead = cut(stored.join(todo.where("action <> 'skip'").select("path"), "path").select("range", "slot", "len"))
            segments = sorted({k[0] for k in now.parts if k[0] != GONE})
            new, lost, live = counts.get("embed", 0), dead.count(), counts.get("embed", 0) + counts.get("skip", 0)
            if not new and not lost:
                return Change()
            had = now.notes.get("dead", 0) + lost
            whole = len(segments) >= SEGMENTS or had > ROTTEN * max(1, live + had)
            number = now.notes.get("segments", 0) + 1
            taken = current if whole else current.join(todo.where("action = 'embed'").select("path"), "path", "left_semi")
            texts = hashed.join(taken, ["path", "hash"], "left_semi").dropDuplicates(["path", "hash"])
            ranges = postings.ranges_for(live if whole else new, self.spark.sparkContext.defaultParallelism, self.size)
            fresh = cut(postings.blocks(texts, ranges, first=number << 32))
            parts = self._write(fresh, f"s{number}")
            added, added_length = postings.statistics(fresh)
            if whole:
                parts |= {k: [] for k in now.parts}
                return Change(parts, {"segments": number, "dead": 0, "documents": added, "length": added_length}, everything=True)
            lost_length = dead.agg(F.sum("len")).head()[0] or 0
            if lost:
                parts |= {k: [] for k in now.parts if k[0] == GONE} | self._write(self._gone(now, dead), GONE)
            notes = {"segments": number, "dead": had, "documents": now.notes.get("documents", 0) + added - lost, "length": now.notes.get("length", 0.0) + added_length - lost_length}
            return Change(parts, notes, everything=True)

        self.table.commit(work)
        return counts

    def _gone(self, now: Snapshot, dead: DataFrame) -> DataFrame:
        """All that no longer counts: slots by range, and postings by token (as blocks without lists)."""
        before = self.table.read(now, lambda k: k[0] == GONE)
        slots = before.where(F.col("token") == postings.DEAD).select("range", F.explode("slots").alias("slot")).unionByName(dead.select("range", "slot"))
        listed = slots.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("slot")).alias("slots")).withColumn("token", F.lit(postings.DEAD))
        held = self.table.read(now, lambda k: k[0] != GONE and k[1] != LISTS).join(dead.select("range").distinct(), "range", "left_semi")
        taken = held.select("range", "token", F.explode("slots").alias("slot")).join(dead, ["range", "slot"]).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        less = taken.unionByName(before.where(F.col("token") != postings.DEAD).select("token", "n")).groupBy("token").agg(F.sum("n").alias("n"))
        empty = self.spark.createDataFrame([], postings.BLOCK)
        return empty.unionByName(listed, allowMissingColumns=True).unionByName(less, allowMissingColumns=True)

    def buckets(self, queries: DataFrame) -> set[str]:
        """The buckets of the queries' tokens."""
        return {r[0] for r in postings.query_tokens(queries).select(bucket(F.col("token"))).distinct().collect()}  # BUCKETS at most

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The ``k`` best pages of each of ``queries`` (query_id, query): query_id, path, rank, score."""
        now = self.table.latest()
        asked = cut(postings.query_tokens(queries))
        wanted = self.buckets(queries)
        tokens = asked.select("token").distinct()
        held = self.table.read(now, lambda key: key[0] != GONE and key[1] in wanted).join(tokens, "token", "left_semi").select([c.split()[0] for c in postings.BLOCK.split(", ")])
        listed = self.table.read(now, lambda key: key[1] == LISTS).select(held.columns)
        less = self.table.read(now, lambda key: key[0] == GONE and key[1] in wanted).join(tokens, "token", "left_semi").select("token", "n")
        return postings.search(held.unionByName(listed), asked, now.notes.get("documents", 0), now.notes.get("length", 0.0), k, less)
