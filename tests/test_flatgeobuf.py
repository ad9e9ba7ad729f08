"""A small reader of the format's tables, written from its schema, reads back what is written."""

import json
import struct

from terraledger.plans import flatgeobuf as fgb
from terraledger.plans.snapshot import Snapshot


class Table:
    def __init__(self, data, at):
        self.d, self.at = data, at
        self.v = at - struct.unpack_from("<i", data, at)[0]

    def place(self, i):
        size = struct.unpack_from("<H", self.d, self.v)[0]
        o = struct.unpack_from("<H", self.d, self.v + 4 + 2 * i)[0] if 4 + 2 * i < size else 0
        return self.at + o if o else None

    def scalar(self, i, code, default=0):
        p = self.place(i)
        return default if p is None else struct.unpack_from("<" + code, self.d, p)[0]

    def ref(self, i):
        p = self.place(i)
        return None if p is None else p + struct.unpack_from("<I", self.d, p)[0]

    def vector(self, i, code):
        p = self.ref(i)
        return None if p is None else list(struct.unpack_from(f"<{struct.unpack_from('<I', self.d, p)[0]}{code}", self.d, p + 4))

    def text(self, i):
        p = self.ref(i)
        n = struct.unpack_from("<I", self.d, p)[0]
        return self.d[p + 4 : p + 4 + n].decode()

    def table(self, i):
        return Table(self.d, self.ref(i))

    def tables(self, i):
        p = self.ref(i)
        n = struct.unpack_from("<I", self.d, p)[0]
        return [Table(self.d, q + struct.unpack_from("<I", self.d, q)[0]) for q in range(p + 4, p + 4 + 4 * n, 4)]


def geometry(t):
    kind = {v: k for k, v in fgb.GEOMETRY.items()}[t.scalar(6, "B")]
    if kind in ("MultiPolygon", "GeometryCollection"):
        parts = [geometry(p) for p in t.tables(7)]
        return {"type": kind, "geometries": parts} if kind == "GeometryCollection" else {"type": kind, "coordinates": [p["coordinates"] for p in parts]}
    xy = t.vector(1, "d")
    points = [list(p) for p in zip(xy[::2], xy[1::2])]
    if kind == "Point":
        return {"type": kind, "coordinates": points[0]}
    if kind in ("LineString", "MultiPoint"):
        return {"type": kind, "coordinates": points}
    ends = t.vector(0, "I") or [len(points)]
    return {"type": kind, "coordinates": [points[a:b] for a, b in zip([0, *ends], ends)]}


def read(data):
    assert data[:8] == fgb.MAGIC
    at, tables = 8, []
    while at < len(data):
        n = struct.unpack_from("<I", data, at)[0]
        body = data[at + 4 : at + 4 + n]
        tables.append(Table(body, struct.unpack_from("<I", body, 0)[0]))
        at += 4 + n
    head, *features = tables
    columns = [(c.text(0), c.scalar(1, "B")) for c in head.tables(7)]
    out = []
    for f in features:
        raw, props, p = bytes(f.vector(1, "B") or b""), {}, 0
        while p < len(raw):
            name, kind = columns[struct.unpack_from("<H", raw, p)[0]]
            p += 2
            if kind == fgb.DOUBLE:
                props[name], p = struct.unpack_from("<d", raw, p)[0], p + 8
            elif kind == fgb.BOOL:
                props[name], p = struct.unpack_from("<?", raw, p)[0], p + 1
            else:
                n = struct.unpack_from("<I", raw, p)[0]
                v = raw[p + 4 : p + 4 + n].decode()
                props[name], p = (v if kind == fgb.STRING else json.loads(v)), p + 4 + n
        out.append((geometry(f.table(0)), props))
    return head, out


SHAPES = [
    {"type": "Point", "coordinates": [1.5, -2.0]},
    {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 1.0]]},
    {"type": "Polygon", "coordinates": [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 1.0]]]},
    {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]], [[[5.0, 5.0], [6.0, 5.0], [6.0, 6.0], [5.0, 5.0]]]]},
    {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1.0, 2.0]}, {"type": "MultiPoint", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}]},
]


def test_round_trip(spark, tmp_path):
    rows = [(f"e{i}", "poi", "source", [("n", f"x{i}", "p")], json.dumps(g), ["c"], {"name": f'"Ü {i}"', "height": str(i), "mixed": '"a"' if i else "1"}, [], [], (1,)) for i, g in enumerate(SHAPES)]
    e = spark.createDataFrame(rows, "id string, type string, identity_scope string, aliases array<struct<namespace:string,id:string,provider_id:string>>, geometry string, claim_ids array<string>, resolved map<string,string>, relationships array<string>, conflicts array<string>, evidence_summary struct<source_count:long>")
    fgb.write(Snapshot({"entities": e}), str(tmp_path / "x.fgb"))
    head, got = read((tmp_path / "x.fgb").read_bytes())
    assert head.text(0) == "terraledger" and head.scalar(8, "Q") == 5 and head.scalar(9, "H", 16) == 0 and head.table(10).scalar(1, "i") == 4326
    assert [g for g, _ in got] == SHAPES
    for i, (_, p) in enumerate(got):
        assert p["id"] == f"e{i}" and p["name"] == f"Ü {i}" and p["height"] == float(i) and p["mixed"] == ("a" if i else 1) and p["_tl:aliases"] == [f"n:x{i}"]
