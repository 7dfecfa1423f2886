"""Stored reports: reruns of a month, failed publications, versions. Facts by month: pruning by a table of bounds."""

import datetime as dt
import glob
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kpiloom.operators.growth import growth_orders, growth_sales
from kpiloom.params import FIXTURE
from kpiloom.plans.monthly import within_bounds, write_monthly
from kpiloom.plans.report_store import ReportStore
from kpiloom.sources.tables import derive_test_tables

from .conftest import SF_SMALL
from .test_plans import plan


def report(spark, rows, schema="day date, n bigint"):
    return spark.createDataFrame(rows, schema)


JAN, FEB = (dt.date(2024, 1, 9), 1), (dt.date(2024, 2, 9), 2)


def test_a_rerun_of_a_month_leaves_other_files_alone(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path))
    assert store.version() is None
    store.publish({"a": report(spark, [JAN, FEB]), "b": report(spark, [(5,)], "total bigint")})
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/data/**/*.parquet", recursive=True)}
    store.publish({"a": report(spark, [(dt.date(2024, 1, 9), 99), (dt.date(2024, 2, 9), 77)])}, months=["2024-02"])
    assert files.items() <= {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/data/**/*.parquet", recursive=True)}.items()
    assert {tuple(r) for r in store.read("a").collect()} == {JAN, (dt.date(2024, 2, 9), 77)}
    assert not any("part=2024-01" in f for f in glob.glob(f"{tmp_path}/data/a/version=2/*"))
    assert [tuple(r) for r in store.read("b").collect()] == [(5,)] and store.reports() == ["a", "b"]
    assert {tuple(r) for r in store.read("a", 1).collect()} == {JAN, FEB}
    # a month that has no rows any more goes
    store.publish({"a": report(spark, [])}, months=["2024-01"])
    assert [tuple(r) for r in store.read("a").collect()] == [(dt.date(2024, 2, 9), 77)]
    store.publish({"a": report(spark, [])})
    assert store.read("a").collect() == [] and store.read("a").columns == ["day", "n"]
    with pytest.raises(KeyError):
        store.read("c")


def test_a_failed_publication_leaves_the_old_board(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path))
    store.publish({"a": report(spark, [JAN]), "b": report(spark, [FEB])})
    broken = report(spark, [FEB]).withColumn("n", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(PySparkException):
        store.publish({"a": report(spark, [FEB]), "b": broken})
    assert store.version() == 1
    assert [tuple(r) for r in store.read("a").collect()] == [JAN] and [tuple(r) for r in store.read("b").collect()] == [FEB]
    store.publish({"a": report(spark, [FEB])})  # takes the number of the failed one
    assert store.version() == 2 and [tuple(r) for r in store.read("a").collect()] == [FEB]


def test_published_reports_read_back_as_they_are(spark, tmp_path):
    t = derive_test_tables(spark, SF_SMALL)
    t = t.replace(reservations=t.reservations_long)
    results = {"orders": growth_orders(t, FIXTURE), "sales": growth_sales(t, FIXTURE.with_(grain="monthly"))}
    store = ReportStore(spark, str(tmp_path))
    store.publish(results)
    for name, own in results.items():
        assert store.read(name).orderBy("period").collect() == own.collect()
        assert [f.dataType for f in store.read(name).schema] == [f.dataType for f in own.schema]


@pytest.fixture(scope="module")
def monthly(spark, tmp_path_factory):
    t = derive_test_tables(spark, SF_SMALL)
    t = t.replace(reservations=t.reservations_long)
    return t, write_monthly(t, str(tmp_path_factory.mktemp("monthly")))


def bounds(spark, tmp_path, *rows):
    spark.createDataFrame(rows, "lo date, hi date").write.parquet(str(tmp_path / "bounds"))
    return spark.read.parquet(str(tmp_path / "bounds"))


def test_only_months_within_the_bounds_are_read(spark, tmp_path, monthly):
    t, facts = monthly
    lo, hi = dt.date(1995, 5, 20), dt.date(1995, 8, 1)
    own = within_bounds(facts.reservations, bounds(spark, tmp_path, (lo, hi)))
    assert "dynamicpruning" in plan(own).lower()
    want = t.reservations.where((F.col("created_at") >= F.lit(lo)) & (F.col("created_at") < F.lit(hi)))
    assert own.drop("month").exceptAll(want).count() == 0 and own.count() == want.count() > 0
    assert {r.month for r in own.select("month").distinct().collect()} == {"1995-05", "1995-06", "1995-07"}
    # a scan that touched another month would fail
    root = facts.reservations.inputFiles()[0].split("/month=")[0].removeprefix("file://")
    for f in glob.glob(f"{root}/month=1996-01/*.parquet"):
        with open(f, "wb") as broken:
            broken.write(b"not parquet")
    assert own.count() == want.count()
    with pytest.raises((PySparkException, Py4JJavaError), match="1996-01"):
        facts.reservations.agg(F.sum("id")).collect()


def test_odd_bounds(spark, tmp_path_factory, monthly):
    _, facts = monthly
    folder = lambda: tmp_path_factory.mktemp("b")
    day = dt.date(1995, 5, 20)
    assert within_bounds(facts.reservations, bounds(spark, folder(), (None, day))).count() == 0
    assert within_bounds(facts.reservations, bounds(spark, folder(), (day, day))).count() == 0
    assert within_bounds(facts.reservations, bounds(spark, folder())).count() == 0
    with pytest.raises(PySparkException, match="more than one row"):
        within_bounds(facts.reservations, bounds(spark, folder(), (day, day), (day, day))).count()
