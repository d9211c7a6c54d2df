import os

import duckdb
import pytest

from tidewright.plans import catalog, results, round_trips

FOLDER = "/root/testdata/sf0.001"
SUMMARIES = ("benchmark_summary", "weak_scaling_summary", "timing_breakdown", "rank_metrics", "pixel_columns", "dense_cubic", "dense_linear", "group_segments")
QUERIES = {**round_trips.QUERIES, **results.QUERIES, **{q: catalog.QUERIES[q] for q in SUMMARIES}}
SQL = {**catalog.SQL, **round_trips.SQL, **results.SQL}


def same(a, b):
    return all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6 for x, y in zip(a, b, strict=True))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "nation", "orders", "customer", "supplier"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = db.sql(SQL[name])
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((v is None, str(v) if isinstance(v, str) else v or 0) for v in r)
    a = sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key)
    b = sorted(want.fetchall(), key=key)
    assert len(a) == len(b) > 0
    assert all(same(x, y) for x, y in zip(a, b, strict=True)), [(x, y) for x, y in zip(a, b, strict=True) if not same(x, y)][:3]
