"""Registered queries that run as streams: the rows of a table come in three shuffled batches, and a last one that moves the
watermark past all of them. The SQL says what they must give, as if everything had been there at once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.session import shared_folder
from loreweave.streaming import flows

from .base import query

#: Longer than any table's rows reach, and shorter than the pause before the row that ends the stream.
LATE, AFTER = "3000 days", "6000 days"


def streamed(rows: DataFrame, flow: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """What ``flow`` gives for ``rows`` (with ts) as a stream of files; rows whose ts is null are left out."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = rows.where("ts is not null")
    each = spark.sparkContext.defaultParallelism  # files of a batch
    rows.repartition(3 * each, F.xxhash64(*rows.columns)).write.parquet(f"{folder}/in")
    time.sleep(0.1)  # files are taken by their time
    last = spark.read.parquet(f"{folder}/in").agg(F.max("ts").alias("ts")).where("ts is not null")
    end = last.select(*[(F.col("ts") + F.expr(f"interval {AFTER}") if c == "ts" else F.lit("~end" if c == key else None).cast(t)).alias(c) for c, t in rows.dtypes])
    end.select(rows.columns).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/in")
    made = flow(source).where(F.col(key) != "~end")
    made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


@query(
    "streamed_debounce",
    """with recursive e as (select session, ts, messages, floor(epoch(ts))::bigint as s, row_number() over (partition by session order by ts, messages) as k from capture_events where ts is not null),
    w as (select session, k, ts, messages, true as kept, s as last, messages as count from e where k = 1
     union all select e.session, e.k, e.ts, e.messages, e.messages <> w.count and e.s - w.last >= 600, case when e.messages <> w.count and e.s - w.last >= 600 then e.s else w.last end,
      case when e.messages <> w.count and e.s - w.last >= 600 then e.messages else w.count end from w join e on e.session = w.session and e.k = w.k + 1)
    select session, epoch_us(ts) as at, messages from w where kept""",
)
def streamed_debounce(read):
    return streamed(read("capture_events"), lambda s: flows.debounced(s, 10, LATE, None), "session").select("session", F.unix_micros("ts").alias("at"), "messages")


@query("streamed_changed_queries", "select session, epoch_us(ts) as at, query from (select *, lag(query) over (partition by session order by ts, query) as before from asks_in_time) where before is null or before <> query")
def streamed_changed_queries(read):
    return streamed(read("asks_in_time"), lambda s: flows.changed_queries(s, LATE, None), "session").select("session", F.unix_micros("ts").alias("at"), "query")


@query(
    "streamed_reviews",
    """select key, epoch_us(ts) as at, case when op = 'enqueue' then 'opened' else 'closed' end as change, id from (select *, lag(op) over (partition by key order by ts, id) as before from review_events)
    where op = 'enqueue' and coalesce(before, '') <> 'enqueue' or op = 'resolve' and before = 'enqueue'""",
)
def streamed_reviews(read):
    return streamed(read("review_events"), lambda s: flows.open_reviews(s, LATE), "key").select("key", F.unix_micros("ts").alias("at"), "change", "id")


@query(
    "streamed_episodes",
    """with m as (select session, ord, role, coalesce(stop_reason, 'stop') as stop, lead(role) over w as next, coalesce(lag(role = 'assistant' and coalesce(stop_reason, 'stop') not in ('toolUse', 'pending')) over w, true) as fresh from timed_messages where role in ('user', 'assistant') window w as (partition by session order by ord)),
    n as (select *, sum(case when role = 'user' or fresh then 1 else 0 end) over (partition by session order by ord) as episode, role = 'assistant' and stop not in ('toolUse', 'pending') as closing from m),
    l as (select * from n qualify row_number() over (partition by session, episode order by ord desc) = 1)
    select session, episode::bigint as episode, case when closing then case when stop = 'stop' then 'settled' else 'interrupted' end when next = 'user' then 'steered' else 'eof' end as end_reason from l""",
)
def streamed_episodes(read):
    return streamed(read("timed_messages"), lambda s: flows.live_episodes(s, LATE, "1 day"), "session")
