import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

#: Customers of small tables, and of tables so large that their grid has rows at the pole (240,000) and beyond.
KEYS = [*range(0, 45), 2000, 2013, *range(239_960, 240_085), 240_401, 480_017, 700_011, 899_999]


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """A folder whose customers lie on both sides of the pole."""
    d = tmp_path_factory.mktemp("far")
    rows = {"c_custkey": KEYS, "c_name": [f"Customer {k}" for k in KEYS], "c_nationkey": [k % 25 for k in KEYS], "c_acctbal": [k / 4 for k in KEYS], "c_mktsegment": [("A", "B", "C")[k % 3] for k in KEYS]}
    pq.write_table(pa.table(rows).cast(pa.schema([("c_custkey", pa.int64()), ("c_name", pa.string()), ("c_nationkey", pa.int32()), ("c_acctbal", pa.float64()), ("c_mktsegment", pa.string())])), f"{d}/customer.parquet")
    return str(d)


def both(spark, sf, name):
    """Rows of a query and of its SQL, as texts (nan equals nan, but not null)."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{sf}/customer.parquet')")
    return sorted(map(repr, map(tuple, entry.queries()[name](spark, sf).collect()))), sorted(map(repr, c.execute(entry.oracle_sql()[name]).fetchall()))


def test_boxes_have_no_northern_end(spark, far):
    got, want = both(spark, far, "q_bbox_filter")
    assert got == want and "(899999,)" not in got and "(240050,)" in got


def test_metres_beyond_the_pole(spark, far):
    got, want = both(spark, far, "q_mercator_roundtrip")
    assert got == want and sum("nan" in r for r in got) == 49 and not any("None" in r for r in got)


def test_geometries_beyond_the_pole(spark, far):
    got, want = both(spark, far, "q_transform_geojson")
    assert got == want and not any("None" in r for r in got)


def test_candidates_at_and_beyond_the_pole(spark, far):
    """Every place of the row at the pole is near all others there, none beyond it is near anything; no side is broadcast, however well it packs."""
    got, want = both(spark, far, "q_spatial_candidates")
    assert got == want and any("240039" in r for r in got) and not any("480017" in r for r in got)
    plan = entry.queries()["q_spatial_candidates"](spark, far)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
