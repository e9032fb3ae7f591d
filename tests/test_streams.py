"""Streams with event time: order over batches and Arrow batches, endings, and state that goes."""

import random
import time

from pyspark.sql import functions as F

from loreweave.streaming import flows

MESSAGES = "session string, ord long, ts string, role string, stop_reason string"


def _files(spark, tmp_path, name, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / name))
        time.sleep(0.05)
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
    return df.withColumn("ts", F.to_timestamp("ts")) if "ts" in df.columns else df


def _run(df, spark, name):
    query = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect(), query


def _plain(messages):
    """Episodes of one session, walked in order."""
    out, episode, opened, closed = [], 0, False, True
    for _, _, _, role, stop in messages:
        if role == "user":
            out += [(episode, "steered")] if opened else []
            episode, opened, closed = episode + 1, True, False
        else:
            if closed:
                episode, opened = episode + 1, True
            closed = (stop or "stop") not in ("toolUse", "pending")
            if closed:
                out.append((episode, "settled" if (stop or "stop") == "stop" else "interrupted"))
                opened = False
    return out + ([(episode, "eof")] if opened else [])


def test_rows_of_a_key_over_batches_are_walked_in_order_and_end(spark, tmp_path):
    r = random.Random(5)
    made = {s: [(s, i, f"2026-01-01 10:{i:02d}:00", r.choice(["user", "assistant", "assistant"]), r.choice([None, "stop", "toolUse", "aborted"])) for i in range(30)] for s in "abc"}
    rows = [m for own in made.values() for m in own]
    r.shuffle(rows)
    later = [[("~", 0, "2026-01-09 00:00:00", "user", None)], [("~", 1, "2026-01-19 00:00:00", "user", None)]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        source = _files(spark, tmp_path, "m", [rows[::3], rows[1::3], rows[2::3], *later], MESSAGES)
        got, query = _run(flows.live_episodes(source, "2 hours", "1 hour"), spark, "timed_episodes")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for s, own in made.items():
        assert sorted((x.episode, x.end_reason) for x in got if x.session == s) == sorted(_plain(own))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # what the last key still holds; the others are gone


def test_without_time_a_batch_is_sorted_whole(spark, tmp_path):
    r = random.Random(6)
    own = [("s", i, None, r.choice(["user", "assistant"]), r.choice(["stop", "toolUse"])) for i in range(30)]
    mixed = own[:]
    r.shuffle(mixed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        source = _files(spark, tmp_path, "n", [[(m[0], m[1], m[3], m[4]) for m in mixed]], "session string, ord long, role string, stop_reason string")
        got, _ = _run(flows.live_episodes(source), spark, "plain_episodes")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted((x.episode, x.end_reason) for x in got) == sorted(x for x in _plain(own) if x[1] != "eof")


def test_late_rows_debounce_in_time_and_closed_reviews_leave_no_state(spark, tmp_path):
    e = "session string, ts string, messages long"
    source = _files(spark, tmp_path, "e", [[("s", "2026-01-01 10:20:00", 4)], [("s", "2026-01-01 10:00:00", 3)], [("s", "2026-01-01 10:05:00", 9), ("~", "2026-01-05 10:00:00", 1)]], e)
    got, _ = _run(flows.debounced(source, 10, "1 day"), spark, "late_debounce")
    assert [(x.session, x.messages) for x in got] == [("s", 3), ("s", 4)]
    items = [("k", "2026-01-01 10:00:00", "enqueue", "1"), ("k", "2026-01-01 10:02:00", "resolve", "1"), ("l", "2026-01-01 10:03:00", "enqueue", "2")]
    end = [("m", "2026-01-03 10:00:00", "resolve", "9")]
    source = _files(spark, tmp_path, "r", [items[1:], items[:1], end], "key string, ts string, op string, id string")
    got, query = _run(flows.open_reviews(source, "1 hour"), spark, "late_reviews")
    assert sorted((x.key, x.change, x.id) for x in got) == [("k", "closed", "1"), ("k", "opened", "1"), ("l", "opened", "2")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # l is open; m waits for its time
