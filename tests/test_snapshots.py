"""Tables as snapshots: a killed write, two writers, readers that hold what they opened, and the chunk store on them."""

import threading

import pytest

from loreweave.sources.snapshots import Change, Conflict, Snapshot, SnapshotTable
from loreweave.sources.store import ChunkStore

SCHEMA = "k string, n long"


def _table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])


def _put(table, spark, *rows, notes=None):
    return table.commit(lambda now: Change(table.write(spark.createDataFrame(rows, SCHEMA)), notes or {}))


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_replace_partitions_and_old_readers_stay(spark, tmp_path):
    t = _table(spark, tmp_path)
    assert _rows(t.read()) == [] and t.latest() == Snapshot()
    odd = 'a "b"/ü\\\x1f'
    _put(t, spark, ("a", 1), ("a", 2), (odd, 3), (None, 4), notes={"x": 1})
    before = t.latest()
    held = t.read(before)
    _put(t, spark, ("a", 5), notes={"x": None, "y": [1]})
    assert set(_rows_any(t.read())) == {("a", 5), (odd, 3), (None, 4)}
    assert set(_rows_any(held)) == {("a", 1), ("a", 2), (odd, 3), (None, 4)}
    assert t.latest().notes == {"y": [1]} and before.notes == {"x": 1}
    assert _rows(t.read(keep=lambda k: k == (odd,))) == [(odd, 3)]
    t.commit(lambda now: Change({("a",): []}))
    assert set(_rows_any(t.read())) == {(odd, 3), (None, 4)}
    assert t.vacuum(keep=1, older_ms=-1000) == 1  # the second folder of a; the first one is still in use
    assert set(_rows_any(t.read())) == {(odd, 3), (None, 4)}


def _rows_any(df):
    return [tuple(r) for r in df.collect()]


def test_a_kill_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    t = _table(spark, tmp_path)
    _put(t, spark, ("a", 1))

    def die(now):
        raise KeyboardInterrupt

    monkeypatch.setattr(t, "_publish", die)
    with pytest.raises(KeyboardInterrupt):
        _put(t, spark, ("a", 2))
    monkeypatch.undo()
    assert _rows(_table(spark, tmp_path).read()) == [("a", 1)]
    assert t.vacuum(keep=1, older_ms=-1000) == 1 and _rows(t.read()) == [("a", 1)]


@pytest.mark.parametrize("local", [True, False])
def test_writers_that_meet_lose_nothing(spark, tmp_path, local):
    t = _table(spark, tmp_path)
    t._local = local  # both ways of putting a manifest in place
    _put(t, spark, ("a", 0), ("b", 0))
    calls = []

    def add(own, key, amount):
        def work(now):
            calls.append(key)
            old = own.read(now, lambda k: k == (key,)).collect()
            if len(calls) == 1:  # another writer comes first
                _put(_table(spark, tmp_path), spark, ("b", 7))
            return Change(own.write(spark.createDataFrame([(key, r["n"] + amount) for r in old], SCHEMA)))

        return own.commit(work)

    add(t, "a", 1)  # another partition's change: both stay, worked out once
    assert calls == ["a"] and _rows(t.read()) == [("a", 1), ("b", 7)]
    calls.clear()
    add(t, "b", 1)  # the same partition: worked out again from what the other left
    assert calls == ["b", "b"] and _rows(t.read()) == [("a", 1), ("b", 8)]
    assert not t._publish(Snapshot(t.latest().number)) and t.latest().number == 5


def test_many_writers_at_once(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"))

    def rows(*keys):
        made = [("p", k, "w", "f", k) for k in keys]
        return store.read().limit(0).unionByName(spark.createDataFrame(made, "path string, key string, wiki string, fingerprint string, hash string"), allowMissingColumns=True)

    errors = []

    def write(i):
        try:
            ChunkStore(spark, str(tmp_path / "chunks")).upsert(rows(f"k{i}", "same"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors
    assert sorted(r.key for r in store.read().collect()) == ["k0", "k1", "k2", "k3", "same"]
    assert store.table.latest().number == 4


def test_a_writer_gives_up_in_the_end(spark, tmp_path):
    t = _table(spark, tmp_path)
    _put(t, spark, ("a", 0))

    def work(now):
        _put(_table(spark, tmp_path), spark, ("a", now.number))
        return Change({("a",): []})

    with pytest.raises(Conflict):
        t.commit(work, attempts=2)


def test_one_transaction_holds_chunks_and_state(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    empty = store.read().limit(0)
    made = spark.createDataFrame([("p", "k", "w", "f", "1"), ("p", "l", "w", "f", "1"), ("q", "k", "w", "old", "1")], "path string, key string, wiki string, fingerprint string, hash string")
    store.upsert(empty.unionByName(made, allowMissingColumns=True))
    state = spark.createDataFrame([("w", "f", "m", 8, 2, "t")], "wiki string, fingerprint string, model string, dim int, chunks long, updated_at string")
    new = empty.unionByName(made.where("key = 'k' and fingerprint = 'f'").selectExpr("path", "key", "wiki", "fingerprint", "'2' as hash"), allowMissingColumns=True)
    gone = made.where("key = 'l'").select("wiki", "fingerprint", "path", "key")
    monkeypatch.setattr(store.table, "_publish", lambda now: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.apply(new, gone, [("w", "old")], state)
    assert store.read().count() == 3 and store.state().count() == 0
    monkeypatch.undo()
    store.apply(new, gone, [("w", "old")], state)
    assert [(r.key, r.hash, r.fingerprint) for r in store.read().collect()] == [("k", "2", "f")]
    assert [(r.wiki, r.chunks) for r in store.state().collect()] == [("w", 2)] and store.warm("w", "f") and not store.warm("w", "old")
