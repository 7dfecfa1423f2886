"""Identities between reports and the production source path."""

import datetime as dt

from pyspark.sql import functions as F

from kpiloom.operators import growth, okr, scoreboard, segments
from kpiloom.params import FIXTURE
from kpiloom.plans.catalog import QUERIES
from kpiloom.plans.materialize import refresh_first_activity
from kpiloom.sources.tables import SCHEMAS, Tables, derive_test_tables

from .conftest import SF_ORACLE, SF_SMALL


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_single_plus_package_is_total(spark):
    t = derive_test_tables(spark, SF_SMALL)
    pk = {r["period"]: r["package_orders"] for r in rows(growth.growth_package_orders(t, FIXTURE))}
    sg = {r["period"]: r["single_orders"] for r in rows(growth.growth_single_orders(t, FIXTURE))}
    tot = {r["period"]: r["orders"] for r in rows(growth.growth_orders(t, FIXTURE))}
    assert tot and all(pk[k] + sg[k] == tot[k] for k in tot)


def test_cumulative_last_row_is_global_total(spark):
    t = derive_test_tables(spark, SF_SMALL)
    cum = rows(growth.growth_orders(t, FIXTURE.with_(grain="cumulative")))
    total = t.reservations.where(F.col("deleted_at").isNull()).count()
    assert cum[-1]["orders"] == total


def test_repeat_is_orders_minus_first_orders(spark):
    t = derive_test_tables(spark, SF_SMALL)
    rep = rows(growth.growth_repeat(t, FIXTURE.with_(grain="cumulative")))[-1]["repeat_orders"]
    live = t.reservations.where(F.col("deleted_at").isNull())
    assert rep == live.count() - live.select("client_id").distinct().count()


def test_new_plus_returning_is_active(spark):
    t = derive_test_tables(spark, SF_SMALL)
    for r in rows(scoreboard.okr_scoreboard_daily(t, FIXTURE)):
        assert r["new_customers"] + r["returning_customers"] == r["active_customers"]
        assert r["washes_new_cust"] + r["washes_returning_cust"] in (r["completed_washes"], 0)


def test_matrix_is_pivot_of_weekly_scoreboard(spark):
    t = derive_test_tables(spark, SF_SMALL)
    weekly = {r["period"]: r for r in rows(scoreboard.okr_scoreboard_weekly(t, FIXTURE))}
    matrix = {r["indicator"]: r for r in rows(scoreboard.okr_scoreboard_weekly_matrix(t, FIXTURE))}
    for wk, r in weekly.items():
        assert matrix["02 total orders"][wk] == float(r["total_orders"])
        assert matrix["13 signups"][wk] == float(r["signups"])


def test_b2b_and_individual_partition_the_orders(spark):
    t = derive_test_tables(spark, SF_SMALL)
    b = rows(segments.b2b_washes(t, FIXTURE))[0]["washes"]
    i = rows(segments.indiv_washes(t, FIXTURE))[0]["washes"]
    live = t.reservations.where(F.col("deleted_at").isNull() & F.col("client_id").isNotNull())
    assert b + i == live.count()


def test_okr_daily_sum_matches_monthly(spark):
    t = derive_test_tables(spark, SF_SMALL)
    daily = sum(r["orders"] for r in rows(okr.okr_orders(t, FIXTURE.with_(grain="daily"))))
    monthly = sum(r["orders"] for r in rows(okr.okr_orders(t, FIXTURE.with_(grain="monthly"))))
    assert daily == monthly


def test_reports_run_on_parquet_tables(spark, tmp_path):
    """Write the derived tables as Parquet datasets and read them back the production way."""
    t = derive_test_tables(spark, SF_SMALL)
    for n in SCHEMAS:
        t[n].write.parquet(str(tmp_path / n))
    prod = Tables.from_parquet(spark, str(tmp_path))
    a = sorted(map(tuple, scoreboard.okr_scoreboard_daily(prod, FIXTURE).collect()))
    b = sorted(map(tuple, scoreboard.okr_scoreboard_daily(t, FIXTURE).collect()))
    assert a == b


def test_materialized_first_activity_follows_late_changes_and_gives_same_scoreboard(spark, tmp_path):
    t = derive_test_tables(spark, SF_ORACLE)
    # at the first refresh no order of the first half was completed yet, and none of the rest was there
    cut = dt.datetime(2024, 1, 15)
    early = t.reservations.where(F.col("created_at") < F.lit(cut)).withColumn("status", F.lit(1))
    first = spark.read.parquet(refresh_first_activity(spark, t.replace(reservations=early), root=str(tmp_path)))
    second = spark.read.parquet(refresh_first_activity(spark, t, root=str(tmp_path)))
    assert sorted(map(tuple, first.collect())) != sorted(map(tuple, second.collect()))
    a = sorted(map(tuple, scoreboard.okr_scoreboard_daily(t.replace(first_activity=second), FIXTURE).collect()))
    b = sorted(map(tuple, QUERIES["okr_scoreboard_daily"].run(spark, SF_ORACLE).collect()))
    assert a == b


def test_weekly_worker_load_from_shared_pass_equals_standalone(spark):
    """S14 in the weekly scoreboard comes from (period, NULL client, worker) groups of the shared
    aggregate; it equals the standalone worker-load component, also with NULL statuses."""
    from pyspark.sql import functions as F

    from kpiloom.operators.scoreboard import Grain, efficiency_component, first_activity, orders_customers_washes

    t = derive_test_tables(spark, SF_SMALL)
    r = t.reservations.withColumn("status", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("status")))
    t = t.replace(reservations=r)
    g = Grain(FIXTURE, weekly=True)
    cols = ["day", "assigned", "asg_washers", "executed", "exec_washers"]
    got = orders_customers_washes(t, first_activity(t), g).select(*cols).where(F.col("assigned") > 0)
    want = efficiency_component(t, g).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() > 0


def test_experiment_single_pass_equals_separate_aggregates(spark):
    """M51's one-scan orders + completed aggregate equals the two standalone aggregates (full outer
    join on the day), with NULL package flags, statuses and workers injected. The two count-based
    columns are compared after COALESCE(…, 0): M51 coalesces one and divides by the other."""
    from pyspark.sql import functions as F

    from kpiloom.operators import experiment as X

    t = derive_test_tables(spark, SF_SMALL)
    r = (t.reservations
         .withColumn("use_package", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("use_package")))
         .withColumn("status", F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("status")))
         .withColumn("representative_id",
                     F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("representative_id"))))
    t = t.replace(reservations=r)
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    cols = ["total_orders", "single_orders", "package_orders", "late_night", "completed"]
    want = X._orders(t, FIXTURE).join(X._completed(t, FIXTURE), "d", "full_outer").select(
        "d", *cols, z("wasted"), z("reps"))
    got = X._orders_and_completed(t, FIXTURE).select("d", *cols, z("wasted"), z("reps"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
