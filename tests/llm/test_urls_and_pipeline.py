import datetime as dt

import pytest

from terraledger.llm import url_filters as U
from terraledger.llm.queries import ORACLES, QUERIES

D = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def entries(spark, rows):
    return spark.createDataFrame([(p, a, c, x, None if t is None else D(t)) for p, a, c, x, t in rows], U.ENTRY)


LOG = [
    ("bad.example", "block", "spam", "add", 0), ("bad.example", "block", "spam", "remove", 50), ("bad.example", "block", "malware", "add", 80),
    ("shop.bad.example", "allow", "ok", "add", 10), ("News.example/x/y", "block", "adult", "add", 5), ("bad.example", "block", "spam", "add", 0),
    (None, "block", "spam", "add", 0), ("late.example", "block", "spam", "add", None),
]


def test_intervals(spark):
    got = {(r.pattern, r.category, r.since, r.until) for r in U.intervals(entries(spark, LOG)).collect()}
    assert got == {("bad.example", "spam", D(0), D(50)), ("bad.example", "malware", D(80), None), ("shop.bad.example", "ok", D(10), None), ("news.example/x/y", "adult", D(5), None)}


@pytest.mark.parametrize("limit", [0, 1000])
def test_judge(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "BROADCAST_ROWS", limit)
    rows = [
        (1, "http://bad.example/", 20, "block"), (2, "https://u:p@WWW.Bad.Example.:8080/a?b#c", 50, "none"), (3, "http://a.bad.example", 90, "block"), (4, "http://shop.bad.example/x", 20, "allow"),
        (5, "http://shop.bad.example/x", 5, "block"), (6, "http://news.example/x/y/z?q", 9, "block"), (7, "http://news.example/x/yy", 9, "none"), (8, "http://notbad.example/", 20, "none"),
        (9, None, 3, "none"), (10, "", 3, "none"), (11, "mailto:x", 3, "none"), (12, "http://bad.example/", None, "none"), (None, "http://bad.example/", 20, "block"), (1, "http://bad.example/", 20, "block"),
        (13, "http://bad.example/" + "a/" * 20_000, 20, "block"),
    ]
    captures = spark.createDataFrame([(i, u, None if t is None else D(t)) for i, u, t, _ in rows], "id long, url string, fetched_at timestamp").selectExpr("*", "1 as u", "'x' as pattern")
    got = U.judge(captures, entries(spark, LOG)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]), x[2])
    assert sorted([(r.id, r.url, r.verdict) for r in got], key=key) == sorted([(i, u, v) for i, u, _, v in rows], key=key)
    assert U.judge(captures.limit(0), entries(spark, LOG)).count() == 0
    assert U.judge(captures, entries(spark, LOG).limit(0)).filter("verdict <> 'none'").count() == 0
    assert U.allowed(captures, entries(spark, LOG)).count() == sum(v != "block" for *_, v in rows)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline_stages(spark, docs, none, tmp_path):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (table, none.select(table.columns)):
        at = start
        for i, (_, stage) in enumerate(c.STAGES):
            out = str(tmp_path / f"{id(start)}-{i}")
            stage(spark, at, "").write.parquet(out)
            at = spark.read.parquet(out)
            if i < 4:
                assert at.columns == table.columns
    folder = tmp_path / "sf"
    table.write.parquet(str(folder / "documents.parquet"))
    pieces = c.run(spark, str(folder)).collect()
    assert {p.doc_id for p in pieces} >= {4} and all(p.length <= 2048 for p in pieces)
