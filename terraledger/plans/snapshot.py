"""A synthesis as a set of tables, its fingerprint, and where it is kept."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraledger.functions.text import canonical
from terraledger.types import SCHEMA_VERSION, SYNTHESIS_VERSION

TABLES = ("entities", "source_records", "claims", "provenance", "relationships", "decisions", "resolution", "provider_summary", "coverage", "attributions")
#: Fields that say when and how fast, at any depth; neither fingerprint nor difference sees them.
VOLATILE = ("retrieved_at", "duration_ms", "metrics")


@dataclass
class Snapshot:
    """Tables by name; meta has versions, fingerprint, request and totals."""

    tables: dict[str, DataFrame]
    meta: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.tables[name]
        raise AttributeError(name)

    @property
    def fingerprint(self) -> str:
        return self.meta.get("fingerprint", "")

    def save(self, path: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = next(iter(self.tables.values())).sparkSession
        spark.createDataFrame([(json.dumps(self.meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Snapshot:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return Snapshot({t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"]}, meta)


def _stable(df: DataFrame) -> list[str]:
    """Columns without the volatile ones; nested ones are cleaned by _clean()."""
    return sorted(c for c in df.columns if c not in VOLATILE)


def row_hash(df: DataFrame, skip: tuple[str, ...] = ()):
    """SHA-256 of a row's JSON with sorted columns, without volatile fields and map order."""
    cols = []
    for c in _stable(df):
        if c in skip:
            continue
        kind = df.schema[c].dataType.simpleString()
        x = F.col(c)
        if kind.startswith("map<"):
            x = F.transform(F.array_sort(F.map_keys(x)), lambda k: F.concat_ws("=", k, F.to_json(F.struct(F.col(c)[k].alias("v")))))
        elif kind.startswith("struct<") and "retrieved_at" in kind:
            x = x.dropFields("retrieved_at")
        cols.append(x.alias(c))
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def fingerprint(tables: dict[str, DataFrame]) -> str:
    """A hash of all rows of the tables that a synthesis decides, whatever their order, times of retrieval and measures.

    Row hashes are added up as four whole numbers a table, so nothing but these comes to the driver.
    """
    parts = {}
    for name in ("entities", "source_records", "claims", "provenance", "relationships", "decisions", "provider_summary"):
        if name not in tables:
            continue
        h = tables[name].select(row_hash(tables[name]).alias("h"))
        words = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
        got = h.agg(F.count("*"), *words).first()
        parts[name] = [str(x) for x in got]
    return hashlib.sha256(canonical(parts).encode()).hexdigest()


def meta(tables: dict[str, DataFrame], request: dict, totals: dict) -> dict:
    return {"schema_version": SCHEMA_VERSION, "synthesis_version": SYNTHESIS_VERSION, "fingerprint": fingerprint(tables), "request": request, "totals": totals, "tables": sorted(tables)}


class SnapshotStore:
    """Immutable snapshots by fingerprint in a folder of any store that Spark reaches; the last one saved is the latest."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def save(self, snapshot: Snapshot) -> dict:
        """Tables first, then the pointer, so that a reader never sees half a snapshot; saving again changes nothing."""
        at = f"{self.path}/{_checked(snapshot.fingerprint)}"
        if not self._exists(f"{at}/meta/_SUCCESS"):
            snapshot.save(at)
        self.spark.createDataFrame([(snapshot.fingerprint,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/latest")
        return {"fingerprint": snapshot.fingerprint, "path": at}

    def load(self, fingerprint: str | None = None) -> Snapshot | None:
        """A snapshot, or the latest; None where there is none."""
        if fingerprint is None:
            if not self._exists(f"{self.path}/latest/_SUCCESS"):
                return None
            fingerprint = self.spark.read.text(f"{self.path}/latest").first()[0]
        at = f"{self.path}/{_checked(fingerprint)}"
        return Snapshot.load(self.spark, at) if self._exists(at) else None

    def list(self) -> list[str]:
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if len(n) == 64 and all(c in "0123456789abcdef" for c in n))

    def history(self, limit: int = 20) -> list[dict]:
        """The last snapshots saved, newest first; limit is kept within 1 and 1000."""
        fs, _ = self._fs(self.path)
        jvm = self.spark.sparkContext._jvm
        times = sorted(((fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")).getModificationTime(), n) for n in self.list()), reverse=True)
        return [{"fingerprint": n, "saved_ms": t} for t, n in times[: min(1000, max(1, int(limit or 20)))]]

    def apply_incremental(self, before: Snapshot | None, after: Snapshot) -> dict:
        """The difference from before, and after saved."""
        from .diff import diff_snapshots

        d = diff_snapshots(before, after)
        return {"diff": d, "saved": self.save(after)}


def _checked(fingerprint: str) -> str:
    if len(fingerprint) != 64 or any(c not in "0123456789abcdef" for c in fingerprint):
        raise ValueError("a fingerprint has 64 hexadecimal digits")
    return fingerprint
