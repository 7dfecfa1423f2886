"""Streams with event time: final rows once, bounded state, and a table of rows that came too late.

Two streaming queries, one after the other, each with its checkpoint:

1. ``route`` splits what arrives. A row is late if its period ended at least ``delay`` before the newest creation time
   of the batches before its own. Late rows go to a side table, where a correction can pick them up; the others to the
   accepted rows. The newest time of each batch is stored with it, so a repeated batch is split the same way.
2. ``append_periods`` aggregates the accepted rows with a watermark of the same delay, in append mode: a period is
   written once, when the watermark has passed its end, and its state is dropped. Rows that were accepted are never
   behind that watermark, as it is never ahead of the times that the rows were split by.

State is a row for each open period: with a delay of a day and weekly periods, two. Periods that are still open at the
end stay in the state and are written by a later run over newer files.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kpiloom.functions.exprs import bsum, in_range
from kpiloom.params import Params
from kpiloom.session import ensure_checkpoint_dir
from kpiloom.sources.tables import reservations_from_events
from kpiloom.streaming.weekly import EPOCH, events_stream

DELAY = dt.timedelta(days=1)


def _finish(query: StreamingQuery) -> list[dict]:
    """Wait for all that is there now; the progress of each batch."""
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return [json.loads(p.json) for p in query.recentProgress]


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Periods:
    """Tumbling periods of ``days`` days from ``start``, and what is counted in them."""

    days: int
    start: dt.date
    aggregates: Callable[[], list[Column]]

    def window(self, column: str) -> Column:
        return F.window(column, f"{self.days} days", f"{self.days} days", f"{(self.start - EPOCH).days % self.days} days")


@dataclass
class EventTimeRun:
    """``final``: a row for each closed period (period, aggregates). ``late``: the rows that were not accepted.
    ``progress``: of the batches of the aggregating query in this run."""

    final: DataFrame
    late: DataFrame
    progress: list[dict] = field(default_factory=list)


def route(rows: DataFrame, root: str, periods: Periods, delay: dt.timedelta) -> None:
    """Split the stream ``rows`` (with ``created_at``) into ``accepted`` and ``late`` under ``root``."""
    spark = rows.sparkSession

    def split(batch: DataFrame, number: int) -> None:
        newest = _read(spark, f"{root}/newest", "newest timestamp, batch int").where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        ended = periods.window("created_at").getField("end")
        late = F.lit(False) if newest is None else ended <= F.lit(newest - delay)
        batch.persist()
        batch.where(~late).write.mode("overwrite").parquet(f"{root}/accepted/batch={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        batch.agg(F.max("created_at").alias("newest")).write.mode("overwrite").parquet(f"{root}/newest/batch={number}")
        batch.unpersist()

    _finish(rows.writeStream.foreachBatch(split).option("checkpointLocation", f"{root}/checkpoint-route")
            .trigger(availableNow=True).start())


def append_periods(accepted: DataFrame, root: str, periods: Periods, delay: dt.timedelta) -> list[dict]:
    """Write closed periods of the stream ``accepted`` to ``root/final``; the progress of the batches."""
    counted = (accepted.withWatermark("created_at", f"{int(delay.total_seconds())} seconds")
               .groupBy(periods.window("created_at").alias("w")).agg(*periods.aggregates()))
    flat = counted.select(F.to_date("w.start").alias("period"), *[c for c in counted.columns if c != "w"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/final/batch={number}")

    return _finish(flat.writeStream.outputMode("append").foreachBatch(write)
                   .option("checkpointLocation", f"{root}/checkpoint-append").trigger(availableNow=True).start())


def run_event_time(rows: DataFrame, periods: Periods, root: str, delay: dt.timedelta = DELAY,
                   files_per_trigger: int | None = None) -> EventTimeRun:
    """Process what is there now of the stream ``rows``; ``root`` is a folder that the cluster shares. A later call with
    the same ``root`` goes on where this one ended. ``files_per_trigger`` bounds the batches of the second query."""
    spark = rows.sparkSession
    rows = rows.withColumn("created_at", F.col("created_at").cast("timestamp"))
    route(rows, root, periods, delay)
    reader = spark.readStream.schema(rows.schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    accepted = reader.parquet(f"{root}/accepted/batch=*")
    progress = append_periods(accepted, root, periods, delay)
    shown = accepted.groupBy(periods.window("created_at").alias("w")).agg(*periods.aggregates())
    schema = shown.select(F.to_date("w.start").alias("period"), *[c for c in shown.columns if c != "w"]).schema
    return EventTimeRun(_read(spark, f"{root}/final/batch=*", schema), _read(spark, f"{root}/late/batch=*", rows.schema), progress)


def weekly_washes(p: Params) -> Periods:
    """M61."""
    return Periods(7, p.anchor, lambda: [
        bsum(F.col("use_package") == 0).alias("single_washes"), bsum(F.col("use_package") == 1).alias("package_washes"),
        F.count(F.lit(1)).alias("total_paid_washes")])


def daily_orders(p: Params) -> Periods:
    """M02."""
    return Periods(1, EPOCH, lambda: [F.count(F.lit(1)).alias("orders")])


def _from_events(spark: SparkSession, sf_dir: str, periods: Periods, lo: dt.date | None = None) -> DataFrame:
    rows = reservations_from_events(events_stream(spark, sf_dir)).where(F.col("deleted_at").isNull())
    if lo is not None:
        rows = rows.where(in_range(F.col("created_at").cast("timestamp"), lo))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kpiloom-event-time/{uuid.uuid4().hex}"
    return run_event_time(rows, periods, root).final


def stream_weekly_washes_final(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """M61 of the weeks that ended at least ``DELAY`` before the newest order."""
    return _from_events(spark, sf_dir, weekly_washes(p), p.anchor).withColumnRenamed("period", "week_start").orderBy("week_start")


def stream_daily_orders_final(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """M02 of the days that ended at least ``DELAY`` before the newest order."""
    return _from_events(spark, sf_dir, daily_orders(p)).orderBy("period")
