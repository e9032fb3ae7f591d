"""Operator 2, sharding: a weighted hash tree of regions, racks and shards (law: ``key``).

At each level a row draws ``-ln(u) / weight`` for every child, with ``u`` hashed from the row's key and the
child's name, and goes down into the child with the smallest draw. A child's weight is the sum of its leaves.
Draws of one child never depend on its siblings, so changing a weight moves rows only into or out of the
subtrees whose weights changed. ``grown()`` adds a shard as a region of its own: rows move only into it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: region -> rack -> shard number -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def topology(shards: int = 8, per_rack: int = 2, racks: int = 2) -> Tree:
    """Regions of ``racks`` racks of ``per_rack`` shards, filled in the order of the shard numbers."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for shard in range(shards):
        region, rack = shard // (per_rack * racks), shard // per_rack
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` with one more shard, in a region of its own so that no other subtree's weight changes."""
    leaves = [shard for racks in tree.values() for rack in racks.values() for shard in rack]
    new = max(leaves) + 1
    return {**tree, f"region-of-{new}": {f"rack-of-{new}": {new: weight}}}


def _draw(key: Column, name: str, weight: float) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(unit) / F.lit(float(weight))


def _smallest(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The third member of the child that draws least; equal draws go to the first child."""
    if len(children) == 1:
        return children[0][2]
    draws = [
        F.struct(_draw(key, name, weight).alias("draw"), F.lit(at).alias("at"), then.alias("then"))
        for at, (name, weight, then) in enumerate(children)
    ]
    return F.array_min(F.array(*draws))["then"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: one weighted draw for each level on the way down."""
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(f"{region}/{rack}/{shard}", weight, F.lit(shard)) for shard, weight in shards.items() if weight > 0]
            if leaves:
                inner.append((f"{region}/{rack}", sum(x[1] for x in leaves), _smallest(key, leaves)))
        if inner:
            regions.append((region, sum(x[1] for x in inner), _smallest(key, inner)))
    return _smallest(key, regions)


def shard_documents(docs: DataFrame, tree: Tree | None = None, cells: int = 4096) -> DataFrame:
    """Place every row of ``docs(doc_id, text)`` and number the rows of each shard from 0.

    Slots: rows are dealt into ``cells`` hash cells a shard, numbered inside their cell by a window, and moved up
    by the running count of the cells before. The table of those counts has shards x ``cells`` rows at most, which
    bounds what is broadcast whatever the input; no window holds a whole shard.

    Nulls: a null text has size 1 and the checksum of no bytes; a null doc_id is a key of its own. Rows that repeat
    get slots of their own. An empty table gives no rows; other columns are ignored.
    """
    tree = tree or topology()
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        place(key, tree).alias("shard"),
        place(key, grown(tree)).alias("grown_shard"),
    ).withColumn("_cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("shard", "_cell").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "_cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_start") + F.col("_rank")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
