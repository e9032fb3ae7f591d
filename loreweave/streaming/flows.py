"""Structured Streaming forms of what the logs do: appends, refreshes, debounces, suppression, attribution."""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType, TimestampType


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling (or sliding) windows, with a watermark. An extension, not a parity claim."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Gap sessions of users. An extension: episodes are told by the data, not by gaps."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def once(rows: DataFrame, *keys: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark: a commit is taken up once, an open review isn't queued twice."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


#: The store that event-time timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows that are kept as one value of the state, rows that are given on at once, bytes that are packed at once, and buckets of keys.
HELD, OUT, PACKED, BUCKETS = 1 << 16, 1 << 16, 32 << 20, 1024

#: A step takes a state and a row (a named tuple; ts in microseconds) and gives the state after it and the rows it makes.
Step = Callable[[Any, Any], tuple[Any, list[tuple]]]


def _block(table: pa.Table) -> bytes:
    """Rows as one value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> Iterator[pa.Table]:
    """The rows of one value: blocks, one after the other."""
    source = pa.BufferReader(value)
    while source.tell() < source.size():
        yield pa.ipc.open_stream(source).read_all()


def _blocks(parts: list[pa.RecordBatch], timed: bool) -> pa.RecordBatch:
    """(bucket, first, last, rows) of each bucket in ``parts``: its rows as a block, its first time (0 if a row has none) and its last."""
    table = pa.Table.from_batches(parts)
    table = table.take(pc.sort_indices(table, sort_keys=[("bucket__", "ascending")])).combine_chunks()
    bucket, own = table["bucket__"].to_numpy(), table.drop_columns(["bucket__"])
    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    first = last = pa.nulls(len(start), pa.int64())
    if timed:
        none = pc.is_null(own["ts"]).to_numpy()
        ts = pc.fill_null(own["ts"], 0).to_numpy()
        first = pa.array(np.where(np.logical_or.reduceat(none, start), 0, np.minimum.reduceat(ts, start)))
        last = pa.array(np.maximum.reduceat(np.where(none, np.iinfo(np.int64).min, ts), start), mask=np.logical_and.reduceat(none, start))
    rows = [_block(own.slice(at, end - at)) for at, end in zip(start.tolist(), [*start[1:].tolist(), len(bucket)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[start]), first, last, pa.array(rows, pa.binary())], names=["bucket__", "first__", "last__", "rows__"])


class InOrder(StatefulProcessor):
    """Walks each key's rows in order, however they were dealt over batches.

    With event time a row waits until the watermark has reached it, so everything before it has come; rows go through
    ``step`` by time and then ``order``. A key that has been silent for ``idle`` milliseconds of event time is ended:
    ``finish`` gives its last rows and its state goes, as it does at once where ``spent`` says that the state is as good as none.
    Without event time a batch's rows are sorted and taken as they come, and state stays. Keys stand together in buckets;
    rows come, move and wait as packed blocks of columns (see ``_blocks``), so neither a row nor a key costs messages to the
    store or a conversion before it is walked. ``held``: the columns, the key first; ``nulls``: where rows come as they are, of
    columns that frames can't hold nulls in, the column that says where they were.
    """

    def __init__(self, held: list[str], nulls: dict[str, str], out: list[str], step: Step, order: tuple[str, ...], timed: bool, idle: int | None, finish: Callable | None, spent: Callable | None) -> None:
        self.names, self.nulls, self.out = held, nulls, out
        self.step, self.order, self.timed, self.idle, self.finish, self.spent = step, (held[0], *(("ts",) if timed else ()), *order), timed, idle, finish, spent

    def init(self, handle) -> None:
        self.handle = handle
        self.row = namedtuple("row", self.names, rename=True)
        self.when = self.names.index("ts") if self.timed else None
        self.held = handle.getListState("held", "rows binary")
        self.now = handle.getValueState("states", "packed binary")  # how far the bucket was walked; of each key its state and its last row's milliseconds

    def _ms(self, row: tuple) -> int:
        return 0 if row[self.when] is None else row[self.when] // 1000

    def _sorted(self, table: pa.Table) -> Iterator[tuple]:
        """The rows in order, nulls first; a part of them at a time is Python's."""
        table = table.take(pc.sort_indices(table, sort_keys=[(n, "ascending") for n in self.order], null_placement="at_start"))
        for at in range(0, table.num_rows, OUT):
            yield from map(self.row._make, zip(*[table[n].slice(at, OUT).to_pylist() for n in self.names], strict=True))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(self.out, zip(*rows, strict=True), strict=True)})

    def _walk(self, states: dict, rows: pa.Table) -> Iterator[pd.DataFrame]:
        made: list[tuple] = []
        for key, own in groupby(self._sorted(rows), itemgetter(0)):
            state, row = states.get(key, (None,))[0], None
            for row in own:
                state, new = self.step(state, row)
                if new:
                    made += [(key, *values) for values in new]
                    if len(made) >= OUT:
                        yield self._frame(made)
                        made = []
            states[key] = (state, self._ms(row) if self.timed else None)
        if made:
            yield self._frame(made)

    def _states(self) -> tuple[int | None, dict]:
        return pickle.loads(self.now.get()[0]) if self.now.exists() else (None, {})

    def _save(self, walked: int | None, states: dict) -> None:
        if states:
            self.now.update((pickle.dumps((walked, states)),))
        else:
            self.now.clear()

    def _came(self, rows: pd.DataFrame) -> tuple[bytes, int]:
        """What came, rows or blocks of them, as one value, and its first time in microseconds."""
        if "rows__" in rows.columns:
            return b"".join(rows["rows__"]), int(rows["first__"].min()) if self.timed else 0
        table = pa.table({n: pa.array(rows[n], mask=rows[self.nulls[n]].to_numpy() if n in self.nulls else None, from_pandas=True) for n in self.names})
        first = pc.min(pc.fill_null(table["ts"], 0)).as_py() if self.timed else 0
        return b"".join(_block(table.slice(at, HELD)) for at in range(0, table.num_rows, HELD)), first

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = [frame for frame in rows if len(frame)]
        if not frames:
            return
        value, first = self._came(pd.concat(frames))
        if self.timed:
            self.held.appendValue((value,))
            self.handle.registerTimer(max(first // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            _, states = self._states()
            yield from self._walk(states, pa.concat_tables(_unpacked(value)).combine_chunks())
            self._save(None, states)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        blocks = [table for r in self.held.get() for table in _unpacked(r[0])] if self.held.exists() else []
        (walked, states), waiting, timers = self._states(), set(), []
        if blocks:
            held = pa.concat_tables(blocks).combine_chunks()
            none = pc.is_null(held["ts"])
            due = pc.fill_null(pc.less(held["ts"], (reached + 1) * 1000), True)
            later = held.filter(pc.invert(due))
            if later.num_rows < held.num_rows:
                # what the bucket was walked past before it came is late
                ready = held.filter(due if walked is None else pc.and_(due, pc.or_(none, pc.fill_null(pc.greater(held["ts"], walked * 1000), True))))
                yield from self._walk(states, ready)
                self.held.clear()
                for at in range(0, later.num_rows, HELD):
                    self.held.appendValue((_block(later.slice(at, HELD)),))
            if later.num_rows:
                waiting = set(pc.unique(later[self.names[0]]).to_pylist())
                timers.append(pc.min(later["ts"]).as_py() // 1000)
        ended: list[tuple] = []
        for k, (state, last) in list(states.items()):
            if k in waiting:
                continue
            if self.spent is not None and self.spent(state):
                del states[k]
            elif self.idle is not None and last + self.idle <= reached:
                ended += [(k, *values) for values in (self.finish(state) if self.finish else ())]
                del states[k]
            elif self.idle is not None:
                timers.append(last + self.idle)
        if ended:
            yield self._frame(ended)
        self._save(reached, states)
        if timers:
            self.handle.registerTimer(min(timers))

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, key: str, out: str, step: Step, order: tuple[str, ...] = (), late: str = "0 seconds", idle: str | None = None, finish: Callable | None = None, spent: Callable | None = None) -> DataFrame:
    """``rows`` by key through ``InOrder``; event time is the column ts where there is one.

    Inside, times are microseconds as Spark counts them, whatever the time zone of a worker. Each task packs its rows by
    bucket before they are dealt: what Spark hands to Python one by one is blocks, not rows. No row within ``late`` is lost.
    """
    timed = "ts" in rows.columns
    made = StructType.fromDDL(out)
    # as Spark reads the interval, so that months and years are refused as it refuses them for watermarks
    pause = None if idle is None else int(rows.sparkSession.sql("select interval " + idle).head()[0].total_seconds() * 1000)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    named = [key, *[n for n in kinds if n != key]]

    def value(n: str) -> Column:
        return F.unix_micros(n).alias(n) if isinstance(kinds[n], TimestampType) else F.col(n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                size += batch.nbytes
            if size > PACKED:
                yield _blocks(parts, timed)
                parts, size = [], 0
        if parts:
            yield _blocks(parts, timed)

    times = {f.name for f in made.fields if isinstance(f.dataType, TimestampType)}
    inner = StructType([StructField(f.name, LongType() if f.name in times else f.dataType) for f in made.fields])
    inside = rows.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket__"), *map(value, named))
    packed = inside.mapInArrow(pack, "bucket__ long, first__ long, last__ long, rows__ binary")
    if timed:
        packed = packed.withColumn("last__", F.timestamp_micros("last__")).withWatermark("last__", late)
    walker = InOrder(named, {}, inner.names, step, order, timed, pause, finish, spent)
    walked = packed.groupBy("bucket__").transformWithStateInPandas(walker, inner, "Append", "EventTime" if timed else "None")
    return walked.select(*[F.timestamp_micros(f.name).alias(f.name) if f.name in times else F.col(f.name) for f in made.fields])


def open_reviews(items: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Events (key, ts, op, id) of a review queue as they change it: an item opens unless its key is open already; a
    resolution closes its key, so that it may open again. Only open keys have state; rows over ``late`` behind are lost."""

    def step(state, r):
        now = bool(state[0]) if state else False
        if r.op == "enqueue" and not now:
            return (True,), [(r.ts, "opened", r.id)]
        if r.op == "resolve" and now:
            return (False,), [(r.ts, "closed", r.id)]
        return (now,), []

    return _stateful(items, "key", "key string, ts timestamp, change string, id string", step, ("id",), late, spent=lambda state: not state[0])


def changed_queries(asks: DataFrame, late: str = "0 seconds", idle: str | None = "1 day") -> DataFrame:
    """Asks (session, ts, query) whose query differs from the session's previous one; after ``idle`` a session starts anew."""

    def step(state, r):
        return (r.query,), [] if state and state[0] == r.query else [(r.ts, r.query)]

    return _stateful(asks, "session", "session string, ts timestamp, query string", step, ("query",), late, idle)


def debounced(events: DataFrame, minutes: int = 10, late: str = "0 seconds", idle: str | None = "1 day") -> DataFrame:
    """Events (session, ts, messages) that may start a capture: a new number of messages, and the pause since the last one
    kept. After ``idle`` a session starts anew."""

    def step(state, r):
        last, count = state if state else (None, -1)
        now = r.ts // 1_000_000
        if r.messages != count and (last is None or now - last >= minutes * 60):
            return (now, r.messages), [(r.ts, r.messages)]
        return (last, count), []

    return _stateful(events, "session", "session string, ts timestamp, messages long", step, ("messages",), late, idle)


def live_episodes(messages: DataFrame, late: str = "0 seconds", idle: str | None = "1 day") -> DataFrame:
    """Episodes (session, episode, end_reason) as they close, from messages (session, ord, role, stop_reason; ts).

    With ts, messages are taken in that order once the watermark is past them, and a session that is silent for ``idle``
    ends, its open episode as ``eof``. Without it a batch's messages are taken by ord as they come.
    """

    def step(state, r):
        episode, opened, closed = state if state else (0, False, True)
        done = []
        if r.role == "user":
            if opened:
                done.append((episode, "steered"))
            episode, opened, closed = episode + 1, True, False
        elif r.role == "assistant":
            if closed:
                episode, opened = episode + 1, True
            stop = "stop" if r.stop_reason is None else r.stop_reason
            closed = stop not in ("toolUse", "pending")
            if closed:
                done.append((episode, "settled" if stop == "stop" else "interrupted"))
                opened = False
        return (episode, opened, closed), done

    return _stateful(messages, "session", "session string, episode long, end_reason string", step, ("ord",), late, idle, finish=lambda state: [(state[0], "eof")] if state[1] else [])


def attributed(events: DataFrame, spans: DataFrame, late: str = "1 hour", longest: str = "3 hours") -> DataFrame:
    """Stream-stream interval join: events within the spans of their session, up to ``longest`` after a span's start.

    Both sides have watermarks and spans a greatest length, so state ends. A span's events after ``longest`` are not
    attributed: name one that no span exceeds.
    """
    e = events.withWatermark("ts", late).alias("e")
    s = spans.withWatermark("started", late).alias("s")
    inside = F.expr(f"e.session = s.session and e.ts >= s.started and e.ts <= s.ended and e.ts <= s.started + interval {longest}")
    return e.join(s, inside).select("e.session", "e.event_id", "s.episode")


def refresh_index(pages: DataFrame, store, wiki: str, embedder, checkpoint: str, claims: DataFrame | None = None):
    """A streaming query that keeps a chunk store current: each batch embeds only new or changed chunks.

    ``claims`` (a table: path, id, text, status) are read anew with each batch, for its pages; without them the claims'
    chunks in the store stay as they are. ``pages`` may be a log of changes (``sources.changes``: path, seq, gone, text):
    of each path the batch's last change counts, and all chunks of pages that are gone go, their claims' too.
    """
    from loreweave.models import embed
    from loreweave.operators.chunking import chunks, index_diff
    from loreweave.sources.changes import latest
    from loreweave.sources.markdown import pages as page_rows

    def apply(batch: DataFrame, _: int) -> None:
        left = None
        if {"gone", "seq"} <= set(batch.columns):
            last = latest(batch).checkpoint()
            read, left = page_rows(last.where("not gone").select("path", "text")), last.where("gone").select("path")
            batch = read.select("path", "title", F.col("body").alias("text"))
        now = chunks(batch, claims)
        kept = store.hashes(wiki, embedder.fingerprint())
        stored = kept.join(batch.select("path").distinct(), "path", "left_semi")
        # settled before anything is written: a plan cannot read the files that its own changes replace
        todo = index_diff(now, stored if claims is not None else stored.where("kind <> 'claim'")).checkpoint()
        new = now.join(todo.where("action = 'embed'").select("path", "key"), ["path", "key"], "left_semi")
        fixed = {"wiki": wiki, "fingerprint": embedder.fingerprint(), "model": "hashing", "updated_at": ""}
        rows = embed(new, embedder).withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn("dim", F.lit(embedder.dims))
        gone = todo.where("action = 'remove'").select(F.lit(wiki).alias("wiki"), F.lit(embedder.fingerprint()).alias("fingerprint"), "path", "key")
        if left is not None:
            gone = gone.unionByName(kept.join(left, "path", "left_semi").select(F.lit(wiki).alias("wiki"), F.lit(embedder.fingerprint()).alias("fingerprint"), "path", "key"))
        store.apply(rows, gone)

    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
