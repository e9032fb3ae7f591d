"""Files on any file system that Spark reads: listings, atomic writes, append-only raw sources, stale temporary files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.text import slug

LISTED = "path string, name string, folder boolean, depth int, size long, mtime long"


def _system(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    system, own = _system(spark, path)
    return system.exists(own)


def listing(spark: SparkSession, root: str, depth: int = 6, skipped: tuple[str, ...] = (), hidden: bool = False, most: int | None = None) -> Iterator[tuple]:
    """Rows of ``LISTED`` for what stands under a folder, to a depth; paths are relative to it, in order of folders.

    Names in ``skipped`` are not gone into, nor hidden folders unless asked for. A folder that can't be read is empty.
    """
    system, top = _system(spark, root)
    todo, given = [(top, "", 0)], 0
    while todo:
        folder, prefix, level = todo.pop(0)
        try:
            found = sorted(((s.getPath().getName(), s) for s in system.listStatus(folder)), key=lambda x: x[0])
        except Exception:  # noqa: BLE001  not there, or not allowed
            continue
        for name, status in found:
            path = f"{prefix}{name}"
            yield path, name, status.isDirectory(), level, status.getLen(), status.getModificationTime()
            given += 1
            if most is not None and given >= most:
                return
            if status.isDirectory() and level < depth and name not in skipped and (hidden or not name.startswith(".")):
                todo.append((status.getPath(), f"{path}/", level + 1))


def listed(spark: SparkSession, root: str, **limits) -> DataFrame:
    """``listing`` as a table."""
    return spark.createDataFrame(list(listing(spark, root, **limits)), LISTED)


def stale_temporary(files: DataFrame, now_ms: int, older_ms: int = 600_000, depth: int = 6, most: int = 20) -> DataFrame:
    """Temporary files that interrupted writes have left: named so, and not touched for a while."""
    old = F.col("mtime") < now_ms - older_ms
    return files.where(~F.col("folder") & F.contains("name", F.lit(".tmp-")) & old & (F.col("depth") <= depth)).orderBy("path").limit(most)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file in place of what has its name: written beside it, then renamed, so that nobody reads half of it."""
    system, own = _system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp-{uuid.uuid4().hex[:8]}-{int(time.time() * 1000)}")
    system.mkdirs(own.getParent())
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else own.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(beside, own, options)


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small file."""
    system, own = _system(spark, path)
    stream = system.open(own)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_raw(spark: SparkSession, folder: str, rows: DataFrame) -> list[str]:
    """Raw sources into ``folder``, never over one that is there: the names that they got.

    ``rows``: day, title, topic, text, ord. Names are date and slug; one that is taken gets the first eight digits of
    the text's hash, then a number. Sources are few (one ingest's), so they are written one by one.
    """
    named = rows.select("ord", "day", slug(F.col("topic"), 40).alias("topic"), slug(F.col("title")).alias("slug"), "text", F.substring(F.sha2("text", 256), 1, 8).alias("sha8"))
    out = []
    for r in named.orderBy("ord").toLocalIterator():
        base = f"{r['topic']}/{r['day']}-{r['slug']}"
        name, n = f"{base}.md", 1
        while exists(spark, f"{folder}/{name}"):
            name = f"{base}-{r['sha8']}.md" if n == 1 else f"{base}-{r['sha8']}-{n}.md"
            n += 1
        write_text(spark, f"{folder}/{name}", r["text"])
        out.append(name)
    return out
