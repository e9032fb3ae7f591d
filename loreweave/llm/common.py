"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from loreweave.session import spread

#: The ASCII whitespace that separates words in every contract here: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any file system works; a small one is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a session that runs in one process (tests) gets a temporary one where none is named.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loreweave-checkpoint-"))
    return named or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Hold batches of rows that go to Python workers to about ``size`` bytes, where the session allows more.

    Spark counts 10,000 rows to a batch, whatever their length; a batch stands in memory on both sides.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not str(now).isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def release() -> None:
    """Give freed memory of this Python worker back to the system; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """A function over batches that gives memory back when its task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def map_rows(docs: DataFrame, run: Callable, fields: list) -> DataFrame:
    """``docs`` through a function over Arrow batches, whose columns go by place: names of any kind come through."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    placed = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    out = placed.mapInArrow(tidy(run), T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)]))
    return out.toDF(*[f.name for f in fields])


def map_text(docs: DataFrame, change: Callable[[dict[str, list]], list[str | None]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with texts made anew, batch by batch in Arrow; n_chars follows where it is a column.

    ``change`` gets the columns text and ``drop`` as lists; the columns ``drop`` go.
    """
    import pyarrow as pa

    names = docs.columns
    kept = [k for k, name in enumerate(names) if name not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=True))
            new = change({name: columns[name].to_pylist() for name in ("text", *drop)})
            columns["text"] = pa.array(new, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in new], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[names[k]] for k in kept], names=[f"c{at}" for at in range(len(kept))])

    return map_rows(docs, run, [docs.schema.fields[k] for k in kept])
