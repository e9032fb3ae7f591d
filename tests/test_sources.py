"""Sources, the chunk store and the streaming flows on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loreweave.models import HashingEmbedder
from loreweave.operators import lint
from loreweave.sources import code, discover, files, git, logs, markdown
from loreweave.sources.store import STATE, ChunkStore
from loreweave.streaming import flows

PAGE = """---
title: "A: page"
tags: [one, two]
summary: null
count: 3
# a remark
claims:
  - id: c1
    text: first claim
    files: [src/a.ts]
    support: 0.9
  - id: c2
    text: 'second ''claim'''
---
# Body
text
"""


def test_front_matter_round_trip():
    data, body = markdown.parse("﻿" + PAGE)
    assert data["title"] == "A: page" and data["tags"] == ["one", "two"] and data["summary"] is None and data["count"] == 3
    assert data["claims"] == [{"id": "c1", "text": "first claim", "files": ["src/a.ts"], "support": 0.9}, {"id": "c2", "text": "second 'claim'"}]
    assert body == "# Body\ntext\n"
    assert markdown.parse(markdown.serialize(data, body)) == (data, body)
    assert markdown.parse("no front matter") == ({}, "no front matter")


def test_scan_and_contents(spark, tmp_path):
    for path, text in {"a/x.md": PAGE, "raw/r.md": "raw", "b.md": "plain", "a/n.txt": "no"}.items():
        file = tmp_path / "wiki" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    pages = markdown.pages(markdown.scan(spark, str(tmp_path / "wiki"))).cache()
    assert sorted((r.path, r.title, r.topic) for r in pages.collect()) == [("a/x.md", "A: page", "a"), ("b.md", None, "general")]
    claims = {r.id: (r.files, r.support) for r in markdown.claims(pages).collect()}
    assert claims == {"c1": (["src/a.ts"], 0.9), "c2": ([], None)}
    lines = pages.select(markdown.contents_line().alias("text"))
    got = {r.path: r.tags for r in markdown.contents(lines.where("text like '%a/x.md%'")).collect()}
    assert got == {"a/x.md": ["one", "two"]}
    markdown.write_contents(pages, str(tmp_path / "toc"))
    assert spark.read.text(str(tmp_path / "toc")).count() == 2


def test_logs_leave_bad_lines_out(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"ts":"1","op":"ask","pages":["a"]}\nnot json\n{"ts":"2","op":"toc"}\n')
    rows = logs.read(spark, str(tmp_path / "m.jsonl"), "metrics")
    assert sorted(r.op for r in rows.collect()) == ["ask", "toc"]
    logs.append(rows, str(tmp_path / "out"))
    assert logs.read(spark, str(tmp_path / "out"), "metrics").count() == 2


def test_transcripts(spark, tmp_path):
    entries = [{"type": "session", "cwd": "/x"}, {"type": "message", "id": "a", "message": {"role": "user", "content": [{"type": "text", "text": "hi"}]}}, {"type": "message", "id": "b", "parentId": "a", "message": {"role": "assistant", "stopReason": "stop", "usage": {"input": 2, "output": 3, "cost": {"total": 0.5}}}}]
    (tmp_path / "s.jsonl").write_text("\n".join([json.dumps(entries[0]), "{oops", *map(json.dumps, entries[1:])]) + "\n")
    lines = logs.transcripts(spark, str(tmp_path / "s.jsonl")).cache()
    assert [r.warning for r in lines.where("warning is not null").collect()] == ["line 2: unparseable JSON, skipped"]
    got = logs.messages(lines).orderBy("ord").collect()
    assert [(r.role, r.text, r.total_tokens, r.cost) for r in got] == [("user", "hi", 0, 0.0), ("assistant", None, 5, 0.5)]


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    assert not store.any()
    row = {"path": "p", "key": "k", "wiki": "w", "fingerprint": "f", "hash": "1"}

    def rows(*changes):
        empty = store.read().limit(0)
        df = spark.createDataFrame([{**row, **c} for c in changes], "path string, key string, wiki string, fingerprint string, hash string")
        return empty.unionByName(df, allowMissingColumns=True)

    store.upsert(rows({}, {"key": "l"}, {"wiki": "v"}))
    store.upsert(rows({"hash": "2"}))
    assert sorted((r.key, r.hash) for r in store.hashes("w", "f").collect()) == [("k", "2"), ("l", "1")]
    store.delete(rows({"key": "l"}).select("wiki", "fingerprint", "path", "key"))
    assert [(r.wiki, r.chunks) for r in store.counts().collect()] == [("v", 1), ("w", 1)]
    store.delete(rows({}).select("wiki", "fingerprint", "path", "key"))  # a partition's last chunk
    assert [(r.wiki, r.chunks) for r in store.counts().collect()] == [("v", 1)]
    store.upsert(rows({"fingerprint": "a b/c"}, {"fingerprint": "g"}, {"wiki": "v", "fingerprint": "g"}))
    store.purge_others("w", "g")
    assert [(r.wiki, r.fingerprint) for r in store.counts().collect()] == [("v", "f"), ("v", "g"), ("w", "g")]
    store.purge("v")
    assert [(r.wiki, r.fingerprint) for r in store.counts().collect()] == [("w", "g")]
    state = spark.createDataFrame([("w", "g", "m", 8, 1, "t1"), ("e", "g", "m", 8, 0, "t1")], STATE)
    store.set_state(state)
    store.set_state(state.where("wiki = 'w'").withColumn("updated_at", F.lit("t2")))
    assert sorted((r.wiki, r.updated_at) for r in store.state().collect()) == [("e", "t1"), ("w", "t2")]
    assert store.warm("e", "g") and store.warm("w", "g") and not store.warm("w", "f") and not store.warm("x", "g")


def _stream(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / name))
    return spark.readStream.schema(schema).json(str(tmp_path / name))


def _drain(df, spark, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_stateful_flows(spark, tmp_path):
    asks = _stream(spark, tmp_path, "asks", [("s", "2026-01-01 10:00:00", "a"), ("s", "2026-01-01 10:01:00", "a"), ("s", "2026-01-01 10:02:00", "b")], "session string, ts string, query string")
    got = _drain(flows.changed_queries(asks.withColumn("ts", F.to_timestamp("ts"))), spark, "asks")
    assert sorted(r["query"] for r in got) == ["a", "b"]
    events = _stream(spark, tmp_path, "ev", [("s", "2026-01-01 10:00:00", 3), ("s", "2026-01-01 10:05:00", 4), ("s", "2026-01-01 10:20:00", 4), ("s", "2026-01-01 10:31:00", 4)], "session string, ts string, messages long")
    got = _drain(flows.debounced(events.withColumn("ts", F.to_timestamp("ts"))), spark, "ev")
    assert sorted(r.messages for r in got) == [3, 4]
    m = _stream(spark, tmp_path, "msg", [("s", 0, "user", None), ("s", 1, "assistant", "stop"), ("s", 2, "assistant", "error"), ("s", 3, "user", None), ("s", 4, "user", None)], "session string, ord long, role string, stop_reason string")
    got = _drain(flows.live_episodes(m), spark, "msg")
    assert sorted((r.episode, r.end_reason) for r in got) == [(1, "settled"), (2, "interrupted"), (3, "steered")]


def test_windows_and_first_rows(spark, tmp_path):
    schema = "event_id long, ts string, user_id long, event_type string, value double"
    rows = [(i, f"2026-01-01 1{i % 3}:00:00", i % 2, "x", 1.0) for i in range(6)]
    events = _stream(spark, tmp_path, "w", rows, schema).withColumn("ts", F.to_timestamp("ts"))
    assert sum(r.n for r in _drain(flows.windowed_counts(events), spark, "w", "complete")) == 6
    assert len(_drain(flows.once(events, "user_id"), spark, "once")) == 2
    assert sum(r.n for r in _drain(flows.user_sessions(events), spark, "us", "complete")) == 6


def test_index_refresh(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    pages = _stream(spark, tmp_path, "pages", [("p.md", "t", "word " * 40)], "path string, title string, text string")
    flows.refresh_index(pages, store, "w", HashingEmbedder(8), str(tmp_path / "cp")).awaitTermination()
    assert [(r.key, len(r.embedding)) for r in store.read().collect()] == [("section:overview", 8)]
    claims = spark.createDataFrame([("p.md", "c1", "a claim", "verified")], "path string, id string, text string, status string")
    again = _stream(spark, tmp_path, "pages2", [("p.md", "t", "other " * 40)], "path string, title string, text string")
    flows.refresh_index(again, store, "w", HashingEmbedder(8), str(tmp_path / "cp2"), claims).awaitTermination()
    third = _stream(spark, tmp_path, "pages3", [("p.md", "t", "third " * 40)], "path string, title string, text string")
    flows.refresh_index(third, store, "w", HashingEmbedder(8), str(tmp_path / "cp3")).awaitTermination()  # without claims theirs stay
    assert sorted((r.key, r.text.split()[0]) for r in store.read().collect()) == [("claim:c1", "a"), ("section:overview", "third")]


def test_reviews_open_once(spark, tmp_path):
    rows = [("k", "2026-01-01 10:00:00", "enqueue", "1"), ("k", "2026-01-01 10:01:00", "enqueue", "2"), ("k", "2026-01-01 10:02:00", "resolve", "1"), ("k", "2026-01-01 10:03:00", "enqueue", "3")]
    events = _stream(spark, tmp_path, "reviews", rows, "key string, ts string, op string, id string").withColumn("ts", F.to_timestamp("ts"))
    got = _drain(flows.open_reviews(events), spark, "reviews")
    assert sorted((r.change, r.id) for r in got) == [("closed", "1"), ("opened", "1"), ("opened", "3")]


def test_files_are_written_whole_and_raw_ones_never_over(spark, tmp_path):
    root = str(tmp_path)
    files.write_text(spark, f"{root}/a/b.txt", "one\n")
    files.write_text(spark, f"{root}/a/b.txt", "zwei ü\n")
    assert (tmp_path / "a/b.txt").read_text() == "zwei ü\n" and files.read_text(spark, f"{root}/a/b.txt") == "zwei ü\n"
    raw = spark.createDataFrame([("2026-01-01", "A b!", "Some Topic", "x", 1), ("2026-01-01", "a B", "some topic", "y", 2), ("2026-01-01", "a B", "some topic", "y", 3)], "day string, title string, topic string, text string, ord int")
    names = files.write_raw(spark, f"{root}/raw", raw)
    sha = hashlib.sha256(b"y").hexdigest()[:8]
    assert names == ["some-topic/2026-01-01-a-b.md", f"some-topic/2026-01-01-a-b-{sha}.md", f"some-topic/2026-01-01-a-b-{sha}-2.md"]
    (tmp_path / "x.tmp-1-2").write_text("")
    (tmp_path / ".hid").mkdir()
    (tmp_path / ".hid/y.tmp-1").write_text("")
    listed = files.listed(spark, root)
    assert {r.path for r in listed.collect()} >= {"a/b.txt", "x.tmp-1-2", ".hid"} and ".hid/y.tmp-1" not in {r.path for r in listed.collect()}
    now = int(listed.agg(F.max("mtime").alias("m")).head()["m"])
    assert [r.path for r in files.stale_temporary(listed, now + 700_000).collect()] == ["x.tmp-1-2"]
    assert files.stale_temporary(listed, now).count() == 0


def test_collections_are_discovered(spark, tmp_path):
    for path in ("one/docs/wiki/wiki/index.md", "one/docs/wiki/wiki/a.md", "one/docs/wiki/raw/s.md", "two/.wiki-state/x", "two/sub/wiki/index.md", "three/.wiki.json", "three/kb/wiki/p.md", "three/kb/raw/r.md", "node_modules/wiki/index.md", ".h/wiki/index.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text('{"wikiRoot": "kb"}' if path.endswith(".json") else "x")
    found = discover.scan(spark, [str(tmp_path)])
    got = {r.root[len(str(tmp_path)) :]: (r.name, r.marker, r.pages, r.raw_sources) for r in found.collect()}
    assert got == {"/one/docs/wiki": ("one", "docs-layout", 1, 1), "/two": ("two", "state-dir", 0, 0), "/three/kb": ("kb", "project-config", 1, 1)}
    assert discover.scan(spark, [str(tmp_path)], depth=1).count() == 2
    registry = spark.createDataFrame([("uno", f"{tmp_path}/one/docs/wiki/", True), ("gone", "/nowhere", True)], "name string, root string, enabled boolean")
    states = spark.createDataFrame([("uno", 7, "m", "t")], "name string, chunks long, model string, updated_at string")
    rows = [(r.name, r.registered, r.missing, r.chunks) for r in discover.discovered(found, registry, states).collect()]
    assert sorted(rows, key=str) == [("gone", True, True, None), ("kb", False, False, None), ("two", False, False, None), ("uno", True, False, 7)]


def test_code_is_scanned(spark, tmp_path):
    texts = {"src/a/x.ts": 'import {y} from "../b/y";\nimport "./z"\nconst q = require( \'../c\' )', "src/b/y.ts": "", "src/c/i.ts": "", "lib/m/t.py": "from .k import z\nimport os.path\n", "main.py": "", "tests/test_a.py": "", "node_modules/q/i.js": "", ".git/x.js": "", "readme.md": ""}
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    rows = code.scan(spark, str(tmp_path))
    assert {r.path for r in rows.collect()} == {"src/a/x.ts", "src/b/y.ts", "src/c/i.ts", "lib/m/t.py", "main.py", "tests/test_a.py"}
    specs = code.imports(rows)
    assert sorted((r.path, r.spec) for r in specs.collect()) == [("lib/m/t.py", ".k"), ("lib/m/t.py", "os.path"), ("src/a/x.ts", "../b/y"), ("src/a/x.ts", "../c"), ("src/a/x.ts", "./z")]
    assert {(r.src_module, r.dst_module) for r in lint.import_edges(specs, rows.select("path")).collect()} == {("src/a", "src/b")}
    one = code.counts(rows).head()
    assert (one["files"], one.test_files, one.entry_points) == (6, 1, ["main.py"])
    listed = spark.createDataFrame([("go.mod",), ("packages/a/package.json",), ("x/package.json",), ("package.json",)], "path string")
    assert [r.path for r in code.manifests(listed).collect()] == ["go.mod", "package.json", "packages/a/package.json"]


def test_history_comes_from_git(spark, tmp_path):
    folder = str(tmp_path)
    if git.run(folder, "init", "-q") is None:
        pytest.skip("no git here")
    commit = ("-c", "user.name=a", "-c", "user.email=a@b.c", "commit", "-q", "-m")
    (tmp_path / "a.txt").write_text("1\n2\n")
    git.run(folder, "add", ".")
    git.run(folder, *commit, "one")
    first = git.head(folder)
    (tmp_path / "a.txt").write_text("1\n3\n")
    (tmp_path / "b.txt").write_text("x\n")
    git.run(folder, "add", ".")
    git.run(folder, *commit, "two")
    assert sorted(r.path for r in git.changed(spark, folder, first).collect()) == ["a.txt", "b.txt"]
    assert "+3" in git.diff(folder, first, "HEAD", ["a.txt"], 10_000) and git.diff(folder, first, "HEAD", ["a.txt"], 9).endswith("[... diff truncated ...]")
    assert sorted((r.subject, r.path, r.added, r.deleted) for r in git.history(spark, folder).collect()) == [("one", "a.txt", 2, 0), ("two", "a.txt", 1, 1), ("two", "b.txt", 1, 0)]
    assert git.head(str(tmp_path / "none")) is None and git.changed(spark, folder, "nothing").count() == 0


def test_session_headers_and_retrievals(spark, tmp_path):
    for name, lines in {"a": ['{"type":"session","cwd":"/P","timestamp":"t1"}', '{"type":"message"}'], "b": ['{"type":"session","cwd":"/p","timestamp":"t2"}'], "c": ["broken"], "d": ['{"type":"message"}']}.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    from loreweave.operators import sessions

    got = sessions.projects(logs.headers(spark, f"{tmp_path}/*.jsonl", "here")).collect()
    assert [(r.cwd, r.root, r.sessions, r.first_ts, r.last_ts) for r in got] == [("/p", "here", 2, "t1", "t2")]
    (tmp_path / "m.log").write_text('{"ts":"t","op":"ask","query":"q","pages":["a"]}\n{"op":"ask","query":"r"}\n{"ts":"t","op":"toc"}\n')
    assert [(r["query"], r.pages) for r in logs.retrievals(spark, f"{tmp_path}/m.log").collect()] == [("q", ["a"])]
