"""Coordinate systems by name, each a pair of column functions to and from longitude and latitude."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OUTPUT = "OGC:CRS84"
_MERCATOR_RADIUS = 6378137.0
_DEGREE = math.pi / 180


@dataclass(frozen=True)
class Crs:
    """forward: its own coordinates from lon, lat; inverse: lon, lat from its own. Both take and give two columns.

    numeric is the inverse on arrays, which geometries are moved by; plain arithmetic on columns works on
    arrays as well, so it is only needed where inverse calls column functions.
    """

    forward: Callable[[Column, Column], tuple[Column, Column]]
    inverse: Callable[[Column, Column], tuple[Column, Column]]
    numeric: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None

    def numbers(self) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        return self.numeric or self.inverse


def _same(x: Column, y: Column) -> tuple[Column, Column]:
    return x, y


def _log(v: Column) -> Column:
    """The logarithm as of IEEE numbers: -inf of 0 and NaN of less, where Spark's gives null."""
    return F.when(v > 0, F.log(v)).when(v == 0, F.lit(-math.inf)).when(v < 0, F.lit(math.nan))


def _to_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    # Beyond the poles there is no such point: NaN.
    return x * (_MERCATOR_RADIUS * _DEGREE), _MERCATOR_RADIUS * _log(F.tan(F.lit(math.pi / 4) + y * (_DEGREE / 2)))


def _from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x / (_MERCATOR_RADIUS * _DEGREE), (2 * F.atan(F.exp(y / _MERCATOR_RADIUS)) - math.pi / 2) / _DEGREE


def _from_mercator_numbers(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x / (_MERCATOR_RADIUS * _DEGREE), (2 * np.arctan(np.exp(y / _MERCATOR_RADIUS)) - math.pi / 2) / _DEGREE


_known: dict[str, Crs] = {
    "OGC:CRS84": Crs(_same, _same),
    "EPSG:4326": Crs(_same, _same),
    "EPSG:3857": Crs(_to_mercator, _from_mercator, _from_mercator_numbers),
}


def _name(name: str | None) -> str:
    return str(name or "").strip().upper()


def register_crs(name: str, crs: Crs) -> str:
    """Add or replace a system. Name and functions are required."""
    key = _name(name)
    if not key or not isinstance(crs, Crs):
        raise TypeError("a coordinate system needs a name and its two functions")
    _known[key] = crs
    return key


def known_crs(name: str) -> bool:
    return _name(name) in _known


def crs_snapshot() -> dict:
    return {"output_crs": OUTPUT, "output_axis_order": "longitude-latitude", "registered": sorted(_known)}


def transform_xy(x: Column, y: Column, source: str, output: str = OUTPUT) -> tuple[Column, Column]:
    for name in (source, output):
        if not known_crs(name):
            raise ValueError(f"unknown coordinate system {_name(name) or '(none)'}; add it with register_crs()")
    return _known[_name(output)].forward(*_known[_name(source)].inverse(x, y))


def _moved(geometry: dict, numeric: Callable) -> dict:
    """A geometry with all positions moved, members of collections included; further ordinates stay."""
    out = dict(geometry)
    todo = [out]
    while todo:
        g = todo.pop()
        if isinstance(g.get("geometries"), list):
            g["geometries"] = [dict(m) if isinstance(m, dict) else m for m in g["geometries"]]
            todo += [m for m in g["geometries"] if isinstance(m, dict)]
        if isinstance(g.get("coordinates"), list):
            flat: list[list] = []

            def copied(v: list) -> list:
                if v and not isinstance(v[0], list):
                    flat.append(list(v))
                    return flat[-1]
                return [copied(x) if isinstance(x, list) else x for x in v]

            g["coordinates"] = copied(g["coordinates"])
            pairs = [p for p in flat if len(p) > 1 and all(isinstance(v, (int, float)) for v in p[:2])]
            if pairs:
                x, y = numeric(np.array([float(p[0]) for p in pairs]), np.array([float(p[1]) for p in pairs]))
                for p, a, b in zip(pairs, x.tolist(), y.tolist()):
                    p[0], p[1] = a, b
    return out


def transform_geojson(geojson: Column, source: Column, names: list[str] | None = None) -> Column:
    """Geometry text in longitude and latitude; source is a column of system names.

    Identities pass by; the other systems are moved by one Arrow function, collections at any depth
    included. It holds the systems that are registered when the plan is made. A name that is not known
    raises when such a row is read.
    """
    chosen = [_name(n) for n in names] if names is not None else sorted(_known)
    same = [n for n in chosen if _known[n].inverse is _same]
    others = {n: _known[n].numbers() for n in chosen if n not in same}
    key = F.upper(F.trim(source))

    @F.pandas_udf("string")
    def f(texts: pd.Series, keys: pd.Series) -> pd.Series:
        def one(text: str | None, name: str) -> str | None:
            if text is None:
                return None
            try:
                g = json.loads(text)
            except ValueError:
                return text
            return json.dumps(_moved(g, others[name]), separators=(",", ":")) if isinstance(g, dict) else text

        return pd.Series([one(t, k) for t, k in zip(texts, keys)], dtype=object)

    out = F.when(geojson.isNull(), F.lit(None).cast("string")).when(key.isin(*same), geojson)
    if others:
        mine = key.isin(*others)
        out = out.when(mine, f(F.when(mine, geojson), key))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown coordinate system: "), F.coalesce(key, F.lit("(none)")))))
