"""Event time: several batches, late rows, state that is dropped, runs that go on."""

import datetime as dt

from pyspark.sql import functions as F

from kpiloom.params import FIXTURE
from kpiloom.streaming.event_time import daily_orders, run_event_time, weekly_washes

SCHEMA = "id bigint, created_at timestamp, use_package int"
HOUR = dt.timedelta(hours=1)


def arrive(spark, folder, number, rows):
    """One file; the stream reads them in the order of their times."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/part={number}")


def at(day, hour=12):
    return dt.datetime(2024, 1, day, hour)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def by_day(rows):
    out = {}
    for _, t, _ in rows:
        out[t.date()] = out.get(t.date(), 0) + 1
    return out


def test_days_are_final_and_late_rows_are_kept_apart(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    batches = [[(1, at(1), 0), (2, at(2), 1)], [(3, at(2, 13), 0), (4, at(1, 23), 0), (5, at(5), 0)],
               [(6, at(1), 0), (7, at(3), 1), (8, at(6), 0), (9, at(4, 3), 0)]]
    for i, rows in enumerate(batches):
        arrive(spark, folder, i, rows)
    run = run_event_time(stream(spark, folder), daily_orders(FIXTURE), root, files_per_trigger=1)
    # newest times before the third batch: the 5th, noon; days that ended by the 4th, noon are over: the 1st to 3rd
    late = {r.id for r in run.late.collect()}
    assert late == {6, 7}
    accepted = [r for b in batches for r in b if r[0] not in late]
    closed = {d: n for d, n in by_day(accepted).items() if d < dt.date(2024, 1, 5)}  # ended by the 5th, noon
    assert {r.period: r.orders for r in run.final.collect()} == closed
    assert run.final.count() == len(closed)  # each once
    operators = [o for p in run.progress for o in p["stateOperators"]]
    assert sum(o["numRowsDroppedByWatermark"] for o in operators) == 0
    assert sum(o["numRowsRemoved"] for o in operators) == len(closed)
    assert operators[-1]["numRowsTotal"] == len(by_day(accepted)) - len(closed)

    # a later run goes on: the open days are closed, what is too late goes to the side
    arrive(spark, folder, 3, [(10, at(5, 1), 0), (11, at(20), 1), (12, at(2), 0)])
    again = run_event_time(stream(spark, folder), daily_orders(FIXTURE), root, files_per_trigger=1)
    assert {r.id for r in again.late.collect()} == {6, 7, 12}
    accepted += [(10, at(5, 1), 0), (11, at(20), 1)]
    assert {r.period: r.orders for r in again.final.collect()} == {d: n for d, n in by_day(accepted).items() if d < dt.date(2024, 1, 19)}
    assert [o["numRowsTotal"] for p in again.progress for o in p["stateOperators"]][-1] == 1


def test_weeks_equal_the_batch_query_on_what_was_accepted(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + 7 * i * HOUR, i % 3 % 2) for i in range(160)]
    for i in range(8):
        arrive(spark, folder, i, rows[20 * i:20 * i + 20] + [(1000 + i, start + 5 * HOUR, 0)])
    run = run_event_time(stream(spark, folder), weekly_washes(FIXTURE), root)
    late = {r.id for r in run.late.collect()}
    assert late and all(i >= 1000 for i in late) and 1000 not in late
    accepted = spark.createDataFrame([r for r in rows + [(1000 + i, start + 5 * HOUR, 0) for i in range(8)] if r[0] not in late], SCHEMA)
    week = F.date_add(F.lit(FIXTURE.anchor), (F.floor(F.datediff("created_at", F.lit(FIXTURE.anchor)) / 7) * 7).cast("int"))
    want = accepted.groupBy(week.alias("w")).agg(F.sum(1 - F.col("use_package")), F.sum("use_package"), F.count("*"))
    want = {tuple(r) for r in want.where(F.date_add("w", 7) <= F.lit(rows[-1][1] - dt.timedelta(days=1))).collect()}
    assert len(want) == 6 and {tuple(r) for r in run.final.collect()} == want


def test_an_empty_folder_gives_no_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, 0, [])
    run = run_event_time(stream(spark, folder), daily_orders(FIXTURE), str(tmp_path / "run"))
    assert run.final.collect() == [] and run.late.collect() == []
