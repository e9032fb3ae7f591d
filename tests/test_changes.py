"""Changes of a folder of pages: what a poll finds, what a stream of them does to the chunk store."""

import os

import pytest

from loreweave.models import HashingEmbedder
from loreweave.sources import changes
from loreweave.sources.changes import PageChanges
from loreweave.sources.store import ChunkStore
from loreweave.streaming import flows

LONG = "word " * 40


def _write(root, path, text, stamp):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(f"---\ntitle: {path}\n---\n{text}\n")
    os.utime(file, (stamp, stamp))


def test_differences_of_two_listings(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", None)], "path string, stamp string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", None)], "path string, stamp string")
    assert sorted(map(tuple, changes.differences(before, now).collect())) == [("b", False), ("d", True), ("e", False)]
    assert changes.differences(now, now).count() == 0


def test_the_last_change_of_a_path_counts(spark):
    rows = [("a", 1, False, "s", "x"), ("a", 2, True, None, None), ("b", 1, True, None, None), ("b", 3, False, "t", "y"), ("b", 3, False, "t", "y"), ("c", 2, False, None, None)]
    got = changes.latest(spark.createDataFrame(rows, changes.CHANGE)).collect()
    assert sorted(map(tuple, got)) == [("a", 2, True, None, None), ("b", 3, False, "t", "y"), ("c", 2, False, None, None)]


def test_pages_that_go_leave_the_store_with_the_next_batch(spark, tmp_path):
    root, log, store = tmp_path / "wiki", PageChanges(spark, str(tmp_path / "wiki"), str(tmp_path / "log")), ChunkStore(spark, str(tmp_path / "chunks"))

    def refresh(claims=None):
        flows.refresh_index(log.stream(), store, "w", HashingEmbedder(8), str(tmp_path / "checkpoint"), claims).awaitTermination()
        return sorted((r.path, r.key) for r in store.read().collect())

    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        log.poll()  # no folder is not an empty one
    for k, path in enumerate(("a.md", "b c.md", "sub/d.md", "raw/no.md")):
        _write(root, path, LONG, 1_700_000_000 + k)
    claims = spark.createDataFrame([("b c.md", "c1", "a claim of the page", "verified")], "path string, id string, text string, status string")
    assert log.poll() == 3 and log.poll() == 0
    assert refresh(claims) == [("a.md", "section:overview"), ("b c.md", "claim:c1"), ("b c.md", "section:overview"), ("sub/d.md", "section:overview")]
    (root / "b c.md").unlink()
    _write(root, "a.md", "other " * 40, 1_700_000_100)
    assert log.poll() == 2
    assert refresh() == [("a.md", "section:overview"), ("sub/d.md", "section:overview")]  # claims of a page that is gone go with it
    assert store.read().where("path = 'a.md'").head().text.startswith("other")
    (root / "sub/d.md").unlink()
    assert log.poll() == 1
    _write(root, "sub/d.md", "again " * 40, 1_600_000_000)  # gone and back, with an older time, before any batch
    assert log.poll() == 1
    assert refresh() == [("a.md", "section:overview"), ("sub/d.md", "section:overview")]
    assert store.read().where("path = 'sub/d.md'").head().text.startswith("again")


def test_a_poll_that_dies_before_its_listing_is_made_up_for(spark, tmp_path, monkeypatch):
    root, log = tmp_path / "wiki", PageChanges(spark, str(tmp_path / "wiki"), str(tmp_path / "log"))
    _write(root, "a.md", LONG, 1_700_000_000)
    monkeypatch.setattr(log.seen, "commit", lambda work: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        log.poll()
    monkeypatch.undo()
    (root / "a.md").unlink()
    _write(root, "b.md", LONG, 1_700_000_001)
    again = PageChanges(spark, str(root), str(tmp_path / "log"))
    assert again.poll() == 2  # the page that only the log knew is gone
    assert again.poll() == 0
    rows = spark.read.schema(changes.CHANGE).parquet(str(tmp_path / "log/changes"))
    assert sorted((r.path, r.gone) for r in changes.latest(rows).collect()) == [("a.md", True), ("b.md", False)]
