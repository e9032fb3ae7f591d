"""The chunk store: a snapshot table partitioned by wiki and fingerprint, with each wiki's index state beside its chunks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators.chunking import counts, upsert

from .snapshots import Change, Snapshot, SnapshotTable

CHUNK = "path string, key string, kind string, claim_id string, status string, title string, text string, hash string, model string, dim int, embedding array<float>, updated_at string, wiki string, fingerprint string"

STATE = "wiki string, fingerprint string, model string, dim int, chunks long, updated_at string"

KEYS = ["wiki", "fingerprint", "path", "key"]


class ChunkStore:
    """A missing folder is an empty store. Every method that changes it is one transaction: see ``snapshots``.

    Changes rewrite the partitions that they touch. Any number of writers may work at once; a reader keeps the snapshot
    that it opened.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        if folder.startswith("\\\\"):
            raise ValueError("network paths of this form are refused")
        self.spark, self.folder = spark, folder
        self.table = SnapshotTable(spark, folder, CHUNK, ["wiki", "fingerprint"])

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self.table.read(snapshot)

    def hashes(self, wiki: str, fingerprint: str, paths: list[str] | None = None) -> DataFrame:
        """The keys and hashes of a wiki's chunks; other wikis' files aren't opened."""
        rows = self.table.read(keep=lambda k: k == (wiki, fingerprint))
        return (rows.where(F.col("path").isin(paths)) if paths is not None else rows).select("path", "key", "kind", "hash")

    def apply(self, rows: DataFrame | None = None, gone: DataFrame | None = None, dropped: Iterable[tuple[str, str]] | None = None, states: DataFrame | None = None) -> Snapshot:
        """One transaction: ``rows`` in place of those with their keys, ``gone`` (wiki, fingerprint, path, key) away,
        partitions ``dropped`` as a whole, and ``states`` in place of those of their wikis.

        What goes is settled first, so a row that is both new and gone stays. The new rows are worked out once: a retry
        after a conflict reads them from where the first try wrote them.
        """
        names = [f.name for f in self.table.schema.fields]
        fresh = self.table.write(rows.select(*names)) if rows is not None else {}
        going = gone.select(*KEYS).distinct().checkpoint() if gone is not None else None
        less = {tuple(r) for r in going.select("wiki", "fingerprint").distinct().collect()} if going is not None else set()  # partitions
        noted = {f"state:{r['wiki']}": r.asDict() for r in states.select(*[c.split()[0] for c in STATE.split(", ")]).collect()} if states is not None else {}  # a row a wiki
        away = {tuple(k): [] for k in dropped or ()}

        def work(now: Snapshot) -> Change:
            touched = (set(fresh) | less) - set(away)
            mixed = {k for k in touched if k in now.parts}
            parts = {k: fresh[k] for k in touched - mixed if k in fresh}
            if mixed:
                old = self.table.read(now, mixed.__contains__)
                if going is not None:
                    old = old.join(going, KEYS, "left_anti")
                if own := [p for k in mixed for p in fresh.get(k, ())]:
                    old = upsert(old, self.spark.read.schema(self.table.schema).parquet(*[f"{self.folder}/{p}" for p in own]), tuple(KEYS))
                parts |= {k: [] for k in mixed} | self.table.write(old)
            return Change(parts | away, noted)

        return self.table.commit(work)

    def upsert(self, rows: DataFrame) -> None:
        """Rows in place of those with their keys, in the partitions that they fall into."""
        self.apply(rows=rows)

    def delete(self, gone: DataFrame) -> None:
        """Rows gone by (wiki, fingerprint, path, key)."""
        self.apply(gone=gone)

    def _purge(self, away, notes: dict | None = None) -> None:
        self.table.commit(lambda now: Change({k: [] for k in now.parts if away(k)}, notes or {}, everything=True))

    def purge(self, wiki: str) -> None:
        """All chunks of a wiki gone, whatever their fingerprint, and its state."""
        self._purge(lambda k: k[0] == wiki, {f"state:{wiki}": None})

    def purge_others(self, wiki: str, fingerprint: str) -> None:
        """A wiki's chunks of other fingerprints gone."""
        self._purge(lambda k: k[0] == wiki and k[1] != fingerprint)

    def state(self) -> DataFrame:
        """(wiki, fingerprint, model, dim, chunks, updated_at): what each wiki was last indexed with; a row a wiki."""
        held = [v for k, v in self.table.latest().notes.items() if k.startswith("state:")]
        return self.spark.createDataFrame([tuple(v[c.split()[0]] for c in STATE.split(", ")) for v in held], STATE)

    def set_state(self, rows: DataFrame) -> None:
        """States in place of those of their wikis."""
        self.apply(states=rows)

    def warm(self, wiki: str, fingerprint: str) -> bool:
        """Whether a wiki was indexed with a fingerprint: its state says so (even if it has no chunks), or chunks do."""
        now = self.table.latest()
        return now.notes.get(f"state:{wiki}", {}).get("fingerprint") == fingerprint or (wiki, fingerprint) in now.parts

    def counts(self) -> DataFrame:
        return counts(self.read())

    def any(self) -> bool:
        """Whether any wiki has chunks or a state."""
        now = self.table.latest()
        return bool(now.parts) or any(k.startswith("state:") for k in now.notes)

    def vacuum(self, keep: int = 2, older_ms: int = 24 * 3600 * 1000) -> int:
        """Old snapshots and what no snapshot names away; see ``SnapshotTable.vacuum``."""
        return self.table.vacuum(keep, older_ms)
