"""FlatGeobuf export: features are encoded in parallel, the file is their stream behind one header.

The few FlatBuffers tables of the format are written directly: a table is its vtable, its fields in
place, and behind them what its offsets point at.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from .exporters import geojson_features
from .snapshot import Snapshot

# Fixed values of the format.
MAGIC = bytes([0x66, 0x67, 0x62, 0x03, 0x66, 0x67, 0x62, 0x00])
GEOMETRY = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}
BOOL, DOUBLE, STRING, JSON = 2, 10, 11, 12


def _align(buffer: bytearray, n: int) -> None:
    buffer.extend(b"\0" * (-len(buffer) % n))


def _table(buffer: bytearray, fields: list) -> int:
    """Append a table; fields are None or (kind, value) by id. Kinds: a struct code for a scalar, or text, table, tables, and a code with [] for a vector."""
    present = [i for i, f in enumerate(fields) if f is not None]
    scalar = lambda kind: kind if kind in "bBhHiIqQdf?" else "I"
    places, size = {}, 4
    for i in sorted(present, key=lambda i: -struct.calcsize(scalar(fields[i][0]))):
        n = struct.calcsize(scalar(fields[i][0]))
        size += -size % n
        places[i] = size
        size += n
    _align(buffer, 8)
    count = max(present, default=-1) + 1
    vtable = len(buffer)
    buffer.extend(struct.pack(f"<HH{count}H", 4 + 2 * count, size, *[places.get(i, 0) for i in range(count)]))
    _align(buffer, 8)
    start = len(buffer)
    buffer.extend(b"\0" * size)
    struct.pack_into("<i", buffer, start, start - vtable)
    for i in present:
        kind, value = fields[i]
        at = start + places[i]
        if kind in "bBhHiIqQdf?" and len(kind) == 1:
            struct.pack_into(f"<{kind}", buffer, at, value)
            continue
        struct.pack_into("<I", buffer, at, _child(buffer, kind, value) - at)
    return start


def _child(buffer: bytearray, kind: str, value) -> int:
    if kind == "table":
        return _table(buffer, value)
    if kind == "tables":
        _align(buffer, 4)
        start = len(buffer)
        buffer.extend(struct.pack("<I", len(value)) + b"\0" * 4 * len(value))
        for i, v in enumerate(value):
            at = start + 4 + 4 * i
            struct.pack_into("<I", buffer, at, _table(buffer, v) - at)
        return start
    if kind == "text":
        raw = value.encode()
        _align(buffer, 4)
        start = len(buffer)
        buffer.extend(struct.pack("<I", len(raw)) + raw + b"\0")
        return start
    code = kind[0]  # a vector of scalars, its first value aligned to its size
    n = struct.calcsize(code)
    while (len(buffer) + 4) % max(n, 4):
        buffer.append(0)
    start = len(buffer)
    buffer.extend(struct.pack(f"<I{len(value)}{code}", len(value), *value))
    return start


def _sized(fields: list) -> bytes:
    """A table as a buffer of its own behind its size."""
    buffer = bytearray(4)
    struct.pack_into("<I", buffer, 0, _table(buffer, fields))
    return struct.pack("<I", len(buffer)) + bytes(buffer)


def _geometry(g: dict) -> list:
    kind = g["type"]
    if kind == "GeometryCollection":
        return [None] * 6 + [("B", GEOMETRY[kind]), ("tables", [_geometry(p) for p in g["geometries"]])]
    c = g["coordinates"]
    if kind == "MultiPolygon":
        return [None] * 6 + [("B", GEOMETRY[kind]), ("tables", [_geometry({"type": "Polygon", "coordinates": p}) for p in c])]
    lines = c if kind in ("Polygon", "MultiLineString") else [[c]] if kind == "Point" else [c]
    points = [p for line in lines for p in line]
    ends, n = [], 0
    for line in lines:
        n += len(line)
        ends.append(n)
    xy = [float(v) for p in points for v in p[:2]]
    z = [float(p[2]) for p in points] if points and all(len(p) > 2 for p in points) else None
    return [("I[]", ends) if len(lines) > 1 else None, ("d[]", xy), ("d[]", z) if z else None, None, None, None, ("B", GEOMETRY[kind])]


def feature(text: str, columns: list[tuple[str, int]]) -> bytes:
    """One encoded feature of a GeoJSON feature text."""
    f = json.loads(text)
    values, out = {"id": f.get("id"), **f["properties"]}, bytearray()
    for i, (name, kind) in enumerate(columns):
        v = values.get(name)
        if v is None:
            continue
        out += struct.pack("<H", i)
        if kind == DOUBLE:
            out += struct.pack("<d", v)
        elif kind == BOOL:
            out += struct.pack("<?", v)
        else:
            raw = (v if kind == STRING else json.dumps(v, separators=(",", ":"))).encode()
            out += struct.pack("<I", len(raw)) + raw
    return _sized([("table", _geometry(f["geometry"])), ("B[]", bytes(out)) if out else None])


def header(columns: list[tuple[str, int]], count: int, name: str) -> bytes:
    cols = [[("text", n), ("B", t)] for n, t in columns]
    crs = [("text", "EPSG"), ("i", 4326)]
    return _sized([("text", name), None, ("B", 0), None, None, None, None, ("tables", cols), ("Q", count), ("H", 0), ("table", crs)])


def stream(s: Snapshot, name: str = "terraledger") -> Iterator[bytes]:
    """The file's bytes. Columns are the properties that occur, each of one kind, or JSON where kinds differ."""
    features = geojson_features(s.entities)
    props = F.from_json(F.get_json_object("feature", "$.properties"), "map<string,variant>")
    kinds = features.select(F.explode(props).alias("k", "v")).groupBy("k").agg(F.array_sort(F.collect_set(F.schema_of_variant("v"))).alias("t"))
    number = ("BIGINT", "DOUBLE")

    def kind(types: list[str]) -> int:
        if types == ["STRING"]:
            return STRING
        if types == ["BOOLEAN"]:
            return BOOL
        return DOUBLE if all(t in number or t.startswith("DECIMAL") for t in types) else JSON

    # One row a property name, which a snapshot's schema bounds.
    columns = [("id", STRING)] + sorted((r.k, kind([t for t in r.t if t != "VOID"])) for r in kinds.collect() if r.k != "id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([feature(t, columns) for t in b.column(1).to_pylist()], pa.binary())], ["id", "body"])

    yield MAGIC + header(columns, features.count(), name)
    for r in features.mapInArrow(encode, "id string, body binary").orderBy("id").select("body").toLocalIterator():
        yield bytes(r[0])


def write(s: Snapshot, path: str) -> None:
    with open(path, "wb") as f:
        for part in stream(s):
            f.write(part)
