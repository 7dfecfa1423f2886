"""Distinct counts from stored days: ids of all sizes, any range, replaced months, sketch errors."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from kpiloom.functions.exprs import month_start
from kpiloom.operators.segments import indiv_new_vs_returning
from kpiloom.params import FIXTURE
from kpiloom.plans import distinct_store
from kpiloom.sources.tables import derive_test_tables

SF = "/root/testdata/sf0.1"


def frame(spark, rows):
    return spark.createDataFrame(rows, "day date, id bigint")


def test_any_range_of_ids_of_all_sizes(spark):
    rng = random.Random(4)
    ids = [None, 0, 1, -1, 32767, 32768, 32769, -32768, 2**32, 2**32 + 5, 2**63 - 1, -(2**63), *range(500, 540)]
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(90)), rng.choice(ids)) for _ in range(3000)]
    days = distinct_store.day_bitmaps(frame(spark, rows + [(None, 5)])).cache()
    for lo, hi in [(0, 90), (10, 11), (0, 7), (33, 71)]:
        a, b = dt.date(2024, 1, 1) + dt.timedelta(days=lo), dt.date(2024, 1, 1) + dt.timedelta(days=hi)
        some = days.where((F.col("day") >= F.lit(a)) & (F.col("day") < F.lit(b)))
        (got,) = distinct_store.rolled_up(some, F.lit("all")).collect()
        own = [r for r in rows if a <= r[0] < b]
        assert (got.n, got.ids, got.days) == (len(own), len({i for _, i in own} - {None}), len({x for x, _ in own}))
    days.unpersist()


def test_months_are_replaced_alone(spark, tmp_path):
    class Rows(dict):
        __getattr__ = dict.__getitem__

    first = [(dt.date(2024, 1, 5), 1), (dt.date(2024, 1, 6), 2), (dt.date(2024, 2, 1), 1)]
    table = lambda rows: Rows(attendances=frame(spark, rows).withColumnsRenamed({"day": "date", "id": "representative_id"}))
    root = str(tmp_path)
    distinct_store.write_sets(table(first), FIXTURE, root, ["present"])
    at = {f: os.path.getmtime(f) for f in glob.glob(f"{root}/metric=present/month=2024-01/*.parquet")}
    later = [(dt.date(2024, 1, 5), 77), (dt.date(2024, 2, 2), 3), (dt.date(2024, 2, 3), 4)]
    distinct_store.write_sets(table(later), FIXTURE, root, ["present"], months=["2024-02"])
    assert at == {f: os.path.getmtime(f) for f in glob.glob(f"{root}/metric=present/month=2024-01/*.parquet")}
    got = distinct_store.rolled_up(distinct_store.read_days(spark, root, "present"), month_start("day")).orderBy("period").collect()
    assert [(r.period.month, r.ids) for r in got] == [(1, 2), (2, 2)]
    only = distinct_store.read_days(spark, root, "present", dt.date(2024, 2, 1), dt.date(2024, 2, 3))
    assert [r.day for r in only.collect()] == [dt.date(2024, 2, 2)]
    assert "month=2024-01" not in " ".join(only.inputFiles()) or "PartitionFilters: [" in only._jdf.queryExecution().toString()


def test_sketch_error_against_exact_counts(spark, tmp_path):
    """With 2^10 entries counts of thousands are approximate: within four standard errors (12.5 %) of the exact ones.
    The default has 2^14, and is exact here."""
    t = derive_test_tables(spark, SF)
    t = t.replace(reservations=t.reservations_long)
    exact = {r["month"]: r for r in indiv_new_vs_returning(t, FIXTURE).collect()}
    rows = distinct_store.SETS["individuals"](t, FIXTURE)
    total = rows.select("id").distinct().count()
    assert total > 4 * 2**10
    coarse = distinct_store.sketched(distinct_store.day_sketches(rows, 10), F.lit("all"), 10).select(F.theta_sketch_estimate("sketch")).first()[0]
    assert coarse != total and abs(coarse - total) <= 4 * total / 2**5
    fine = distinct_store.indiv_new_vs_returning_sketch(t, FIXTURE).collect()
    assert [(r.month, r.new_customers, r.returning_customers) for r in fine] == [
        (m, exact[m]["new_customers"], exact[m]["returning_customers"]) for m in sorted(exact)]


@pytest.mark.parametrize("name", ["present", "executing", "active"])
def test_stored_days_are_read_instead_of_facts(spark, tmp_path, name):
    t = derive_test_tables(spark, "/root/testdata/sf0.001")
    root = distinct_store.write_sets(t, FIXTURE, str(tmp_path), [name])
    df = distinct_store.rolled_up(distinct_store.read_days(spark, root, name), month_start("day"))
    assert "props" not in df._jdf.queryExecution().executedPlan().toString()
    want = distinct_store.SETS[name](t, FIXTURE).where("day is not null").groupBy(month_start("day").alias("m")).agg(F.countDistinct("id"))
    assert {tuple(r) for r in df.select("period", "ids").collect()} == {tuple(r) for r in want.collect()}
