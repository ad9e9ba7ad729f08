"""Snapshots and their current state in PostGIS, through a client that the host supplies."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from .diff import COLLECTIONS, diff_document, diff_snapshots
from .exporters import to_document
from .snapshot import Snapshot


class PostgisStore:
    """client.execute(sql, params) -> list of rows; one transaction for each save, under an advisory lock.

    A save compares with the last snapshot stored, deletes what was removed and upserts what was added
    or changed; rows are written in batches from partitions' iterators, never as one collection.
    """

    def __init__(self, client, schema: str = "terraledger", world_id: str = "default", batch: int = 500) -> None:
        if not callable(getattr(client, "execute", None)):
            raise TypeError("a PostGIS store needs a client with execute(sql, params)")
        if not re.fullmatch(r"[a-z_][a-z0-9_]*", schema):
            raise ValueError("a schema name has lower-case letters, digits and underscores")
        self.client, self.schema, self.world, self.batch = client, schema, world_id, batch

    def initialize(self) -> None:
        run, s = self.client.execute, self.schema
        run("CREATE EXTENSION IF NOT EXISTS postgis", ())
        run(f"CREATE SCHEMA IF NOT EXISTS {s}", ())
        run(f"CREATE TABLE IF NOT EXISTS {s}.snapshots (world_id text, fingerprint text, document jsonb NOT NULL, saved_at timestamptz DEFAULT now(), PRIMARY KEY (world_id, fingerprint))", ())
        for t in COLLECTIONS:
            shape = ", geom geometry(Geometry, 4326)" if t in ("entities", "source_records") else ""
            run(f"CREATE TABLE IF NOT EXISTS {s}.{t} (world_id text, id text, body jsonb NOT NULL{shape}, PRIMARY KEY (world_id, id))", ())
            if shape:
                run(f"CREATE INDEX IF NOT EXISTS {t}_geom ON {s}.{t} USING gist (geom)", ())

    def _last(self) -> tuple[str, dict] | None:
        rows = self.client.execute(f"SELECT fingerprint, document FROM {self.schema}.snapshots WHERE world_id = %s ORDER BY saved_at DESC LIMIT 1", (self.world,))
        return (rows[0][0], rows[0][1]) if rows else None

    def load(self, fingerprint: str | None = None) -> dict | None:
        """A snapshot document, or the last one."""
        if fingerprint is None:
            last = self._last()
            return last[1] if last else None
        rows = self.client.execute(f"SELECT document FROM {self.schema}.snapshots WHERE world_id = %s AND fingerprint = %s", (self.world, fingerprint))
        return rows[0][0] if rows else None

    def history(self, limit: int = 20) -> list:
        most = min(1000, max(1, int(limit or 20)))
        return self.client.execute(f"SELECT fingerprint, saved_at FROM {self.schema}.snapshots WHERE world_id = %s ORDER BY saved_at DESC LIMIT %s", (self.world, most))

    def save(self, snapshot: Snapshot, before: Snapshot | None = None) -> dict:
        """Store a snapshot and bring the current state to it. before, where the caller has its tables, saves rewriting what did not change."""
        run, s = self.client.execute, self.schema
        run("BEGIN", ())
        try:
            run("SELECT pg_advisory_xact_lock(hashtext(%s))", (f"{s}:{self.world}",))
            last = self._last()
            known = before if before is not None and last and before.fingerprint == last[0] else None
            d = diff_snapshots(known, snapshot)
            if known is None:
                for t in COLLECTIONS:
                    run(f"DELETE FROM {s}.{t} WHERE world_id = %s", (self.world,))
            for t in COLLECTIONS:
                gone = (r[0] for r in d[t].filter("change = 'removed'").select("id").toLocalIterator())
                self._each(gone, lambda ids, t=t: run(f"DELETE FROM {s}.{t} WHERE world_id = %s AND id = ANY(%s)", (self.world, ids)))
                table = snapshot.tables[t]
                shape = "geometry" in table.columns
                new = table.join(d[t].filter("change <> 'removed'").select("id"), "id", "left_semi").select("id", F.to_json(F.struct(*table.columns)), *(["geometry"] if shape else []))
                self._each(new.toLocalIterator(), lambda rows, t=t, shape=shape: self._upsert(t, rows, shape))
            doc = to_document(snapshot)
            run(f"INSERT INTO {s}.snapshots (world_id, fingerprint, document) VALUES (%s, %s, %s) ON CONFLICT (world_id, fingerprint) DO UPDATE SET saved_at = now()", (self.world, snapshot.fingerprint, json.dumps(doc)))
            run("COMMIT", ())
        except BaseException:
            run("ROLLBACK", ())
            raise
        return {"fingerprint": snapshot.fingerprint, "diff": diff_document(d)}

    def apply_incremental(self, before: Snapshot | None, after: Snapshot) -> dict:
        """The stored state decides; before only spares work if it is that state."""
        return self.save(after, before)

    def _each(self, rows, use) -> None:
        held = []
        for r in rows:
            held.append(r)
            if len(held) >= self.batch:
                use(held)
                held = []
        if held:
            use(held)

    def _upsert(self, t: str, rows: list, shape: bool) -> None:
        one = "(%s, %s, %s, ST_SetSRID(ST_GeomFromGeoJSON(%s), 4326))" if shape else "(%s, %s, %s)"
        cols, put = ("world_id, id, body, geom", "body = EXCLUDED.body, geom = EXCLUDED.geom") if shape else ("world_id, id, body", "body = EXCLUDED.body")
        values = [v for r in rows for v in (self.world, *r)]
        self.client.execute(f"INSERT INTO {self.schema}.{t} ({cols}) VALUES {', '.join([one] * len(rows))} ON CONFLICT (world_id, id) DO UPDATE SET {put}", tuple(values))
