"""A stream of raw source records kept as a current table, and a snapshot after each batch.

An extension: there is nothing like it upstream. Each batch is upserted by record id, latest arrival
last; a record that does not come again is not a deletion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraledger.operators.matching import reconcile_providers
from terraledger.operators.normalize import normalize
from terraledger.plans.snapshot import Snapshot, SnapshotStore
from terraledger.plans.synthesis import assemble
from terraledger.session import reachable, written


class Ledger:
    """State: state/<n> has the current records after n batches, and snapshots their syntheses."""

    def __init__(self, spark: SparkSession, path: str, source: dict, enabled: bool = True) -> None:
        self.spark, self.path, self.source, self.enabled = reachable(spark), path.rstrip("/"), source, enabled
        self.store = SnapshotStore(spark, f"{self.path}/snapshots")

    def _state(self, n: int) -> str:
        return f"{self.path}/state/{n}"

    def upsert(self, batch: DataFrame, n: int) -> Snapshot:
        """foreachBatch: the state after batch n comes from that before it, so a repeated batch repeats its result."""
        new = normalize(batch, self.source, quarantine=True).filter("invalid is null").drop("invalid")
        new = new.groupBy("id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "id"]), F.struct("provenance.source_updated_at", "provenance.observed_at", "fingerprint")).alias("r")).select("id", "r.*")
        old = self.spark.read.parquet(self._state(n - 1)) if n > 0 and self.store._exists(self._state(n - 1)) else None
        kept = new if old is None else old.join(new.select("id"), "id", "left_anti").unionByName(new)
        kept.write.mode("overwrite").parquet(self._state(n))
        records = self.spark.read.parquet(self._state(n))
        providers = sorted(r[0] for r in records.select("provider_id").distinct().collect())  # one a source
        decisions = written(reconcile_providers(records, providers), "decisions") if self.enabled and len(providers) > 1 else None
        rows = [{"provider_id": p, "dataset_id": self.source["dataset_id"], "operator": self.source["operator"], "license_id": self.source["license_id"], "attribution": self.source["attribution"], "homepage": "", "status": "available", "record_count": records.filter(F.col("provider_id") == p).count(), "coverage": None, "warnings": [], "error": None, "metrics": None} for p in providers]
        snapshot = assemble(self.spark, records, rows, decisions)
        self.store.save(snapshot)
        return snapshot

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run upsert() for each batch of a stream with the raw columns."""
        return stream.writeStream.foreachBatch(lambda df, n: self.upsert(df, n) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
