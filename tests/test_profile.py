"""The one-pass profile against the exact one, within its stated errors."""

import bisect

import pytest
from pyspark.sql import functions as F

from kpiloom.operators.profile import profile_frame, profile_sketched
from kpiloom.sources.tables import derive_test_tables

from .test_plans import plan

EXACT = ["column", "kind", "nil_pct", "earliest", "latest", "min", "max", "avg", "sd", "zero_fraction"]
SF = "/root/testdata/sf0.1"


def test_facts_in_one_scan_within_the_stated_errors(spark):
    df = derive_test_tables(spark, SF).reservations.select(
        "id", "client_id", "created_at", "status", F.col("total_price").cast("double").alias("price"), "representative_id", "date")
    got = profile_sketched(df)
    p = plan(got)
    assert p.count("FileScan parquet") == 1 and "Window" not in p and "Join" not in p
    exact = {r["column"]: r for r in profile_frame(df).collect()}
    n = df.count()
    for r in got.collect():
        e = exact[r["column"]]
        for c in EXACT:
            assert r[c] == pytest.approx(e[c], rel=1e-6) if isinstance(e[c], float) else r[c] == e[c], (r["column"], c)
        assert abs(r["distinct_count"] - e["distinct_count"]) <= (0 if e["distinct_count"] <= 2**14 else 0.032 * e["distinct_count"])
        if e["distinct_count"] <= 7500:
            assert (r["mode_fraction"], r["top3_fraction"]) == (e["mode_fraction"], e["top3_fraction"])
        else:
            assert abs((r["mode_fraction"] or 0) - e["mode_fraction"]) <= 1 / 2800 + 1e-6
    for c in ("price", "id", "client_id"):
        values = sorted(x[0] for x in df.select(c).where(F.col(c).isNotNull()).collect())
        row = next(r for r in got.collect() if r["column"] == c)
        for q, name in ((0.25, "q1"), (0.75, "q3")):
            lo, hi = bisect.bisect_left(values, row[name] - 1e-6), bisect.bisect_right(values, row[name] + 1e-6)
            assert lo / len(values) - 0.0015 <= q <= hi / len(values) + 0.0015, (c, name)
    assert n > 50_000


def test_empty_null_and_text_columns(spark):
    df = spark.createDataFrame([(None, None, None), (1, "a", None), (1, "b", None), (None, "a", None)], "x int, s string, `d.t` date")
    rows = {r["column"]: r for r in profile_sketched(df).collect()}
    assert (rows["x"]["distinct_count"], rows["x"]["nil_pct"], rows["x"]["q1"], rows["x"]["mode_fraction"]) == (1, 0.5, 1.0, 0.5)
    assert (rows["s"]["kind"], rows["s"]["distinct_count"], rows["s"]["top3_fraction"], rows["s"]["zero_fraction"]) == ("text", 2, 0.75, None)
    assert (rows["d.t"]["distinct_count"], rows["d.t"]["nil_pct"], rows["d.t"]["earliest"], rows["d.t"]["mode_fraction"]) == (0, 1.0, None, None)
    assert profile_sketched(df.limit(0)).collect() == []
