"""First activity kept by increments: random late changes, what is written, failed writes, plans."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from kpiloom.operators.scoreboard import okr_scoreboard_daily, okr_scoreboard_weekly
from kpiloom.params import FIXTURE
from kpiloom.plans.activity_queries import incremental_store
from kpiloom.plans.activity_store import ActivityStore, signed_changes
from kpiloom.sources.tables import derive_test_tables

from .conftest import SF_SMALL
from .test_plans import plan

ROWS = "client_id bigint, act string"


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows, key=str), ROWS)


def minima(rows):
    out = {}
    for client, act in rows:
        out[client] = min(out.get(client, act), act)
    return out


def stored(store):
    return {r.client_id: r.fa for r in store.table().collect()}


def test_random_late_changes_equal_a_rebuild(spark, tmp_path):
    """Orders are added, taken back, moved and repeated; days may be text that is no date."""
    rng = random.Random(5)
    days = [f"2024-01-{d:02d}" for d in range(1, 29)] + ["2024-1-5", "soon", "0000-00-00"]
    clients = [None, *range(40)]
    state = [(rng.choice(clients), rng.choice(days)) for _ in range(200)]
    store = ActivityStore(spark, str(tmp_path), buckets=8)
    store.rebuild(frame(spark, state))
    assert stored(store) == minima(state)
    for step in range(5):
        before = list(state)
        rng.shuffle(state)
        state = state[rng.randrange(60):] + [(rng.choice(clients), rng.choice(days)) for _ in range(rng.randrange(40))]
        if step == 2:  # some clients lose all they have
            state = [r for r in state if r[0] not in (None, 3, 4, 5)]
        store.apply(signed_changes(frame(spark, before), frame(spark, state)))
        assert stored(store) == minima(state)
        if step == 3:
            store.compact()
            assert stored(store) == minima(state) and len(store.versions()) == 1
    counts = {(r.client_id, r.act): r.n for r in store.counts().collect()}
    assert counts == {r: state.count(r) for r in state}


def test_only_changed_clients_are_written(spark, tmp_path):
    store = ActivityStore(spark, str(tmp_path), buckets=4)
    state = [(c, f"2024-01-{1 + c % 9:02d}") for c in range(300)]
    store.rebuild(frame(spark, state))
    full = sorted(glob.glob(f"{tmp_path}/first/version=0/**/*.parquet", recursive=True))
    at = {f: os.path.getmtime(f) for f in full}
    store.apply(signed_changes(frame(spark, state), frame(spark, state[1:] + [(7, "2023-12-31")])))
    assert {f: os.path.getmtime(f) for f in full} == at
    patch = spark.read.parquet(f"{tmp_path}/first/version=1")
    assert {(r.client_id, r.fa) for r in patch.collect()} == {(0, None), (7, "2023-12-31")}
    assert 0 not in stored(store) and stored(store)[7] == "2023-12-31" and len(stored(store)) == 299
    # nothing has changed: no version
    assert store.apply(signed_changes(frame(spark, state), frame(spark, state))) == 1 and store.versions() == [0, 1]


def test_a_version_without_commit_does_not_exist(spark, tmp_path):
    store = ActivityStore(spark, str(tmp_path), buckets=4)
    with pytest.raises(ValueError, match="empty"):
        store.apply(frame(spark, [(1, "2024-01-01")]).withColumn("n", F.lit(1)))
    store.rebuild(frame(spark, [(1, "2024-01-05"), (2, "2024-01-06")]))
    with pytest.raises(ValueError, match="not against its state"):
        store.apply(frame(spark, [(1, "2024-02-05")]).withColumn("n", F.lit(-1)))
    assert stored(store) == {1: "2024-01-05", 2: "2024-01-06"} and store.versions() == [0]
    store.apply(frame(spark, [(2, "2024-01-01")]).withColumn("n", F.lit(1)))  # takes the number of the failed one
    assert stored(store) == {1: "2024-01-05", 2: "2024-01-01"} and store.versions() == [0, 1]


@pytest.mark.parametrize("op, whole_history", [(okr_scoreboard_daily, 1), (okr_scoreboard_weekly, 1)])
def test_scoreboards_from_the_store_do_not_read_history(spark, op, whole_history):
    """One scan of each fact table less, and the same rows."""
    t = derive_test_tables(spark, SF_SMALL)
    from_store = op(t.replace(first_activity=incremental_store(t).table()), FIXTURE)
    plain = op(t, FIXTURE)
    count = lambda df, column: sum("FileScan parquet" in ln and column in ln for ln in plan(df).splitlines())
    assert count(from_store, "o_orderkey") == count(plain, "o_orderkey") - whole_history
    assert count(from_store, "props") == count(plain, "props") - whole_history
    assert [tuple(r) for r in from_store.collect()] == [tuple(r) for r in plain.collect()]


def test_rows_without_client_are_dealt_out_over_the_join(spark):
    """The join key of rows without a client is their own: no task gets all of them."""
    from kpiloom.operators.scoreboard import Grain, first_activity, orders_customers_washes

    t = derive_test_tables(spark, SF_SMALL)
    t = t.replace(reservations=t.reservations.withColumn("client_id", F.when(F.col("id") % 2 == 0, F.col("client_id"))))
    j = orders_customers_washes(t, first_activity(t), Grain(FIXTURE, True))
    joins = [ln for ln in plan(j).splitlines() if "Join" in ln and "_key" in ln]
    assert joins and all("_none" in ln for ln in joins)
