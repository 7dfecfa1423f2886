"""Weekly paid washes (M61) and order counts (M02) as Structured Streaming jobs.

The source reports are re-run batch SQL; the streaming form keeps the per-week (or
per-day) aggregate in the state store and refreshes it incrementally as new fact files
arrive. ``trigger(availableNow=True)`` processes everything present and stops, so the
job is checkpointed and restartable (an executor or driver loss replays from the
checkpoint), and can be checked against the batch operator.

State is one row per period, bounded by the calendar; complete mode keeps every period, so a late row of
any age still counts. Each micro-batch writes the whole (small) result under its own number in the shared
checkpoint folder named by ``spark.checkpoint.dir``: a result that was returned is never overwritten, and
a replayed batch writes its own folder again.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions.exprs import bsum, in_range
from kpiloom.params import Params
from kpiloom.session import ensure_checkpoint_dir
from kpiloom.sources.tables import RAW_SCHEMAS, reservations_from_events

EPOCH = dt.date(1970, 1, 1)


def _week_window(col: str, anchor: dt.date):
    """7-day tumbling windows aligned to the anchor (window starts are epoch-aligned
    plus a start offset)."""
    offset = (anchor - EPOCH).days % 7
    return F.window(col, "7 days", "7 days", f"{offset} days")


def _event_time(df: DataFrame) -> DataFrame:
    """Windows over TIMESTAMP (with local time zone); the session time zone is UTC."""
    return df.withColumn("created_at", F.col("created_at").cast("timestamp"))


def weekly_paid_washes_stream(reservations: DataFrame, p: Params) -> DataFrame:
    """Streaming aggregate: week_start, single / package / total washes since the anchor."""
    r = _event_time(reservations).where(F.col("deleted_at").isNull() & in_range("created_at", p.anchor))
    return (r.groupBy(_week_window("created_at", p.anchor).alias("w"))
            .agg(bsum(F.col("use_package") == 0).alias("single_washes"),
                 bsum(F.col("use_package") == 1).alias("package_washes"),
                 F.count(F.lit(1)).alias("total_paid_washes"))
            .select(F.to_date(F.col("w.start")).alias("week_start"), "single_washes", "package_washes",
                    "total_paid_washes"))


def daily_orders_stream(reservations: DataFrame, p: Params) -> DataFrame:
    r = _event_time(reservations).where(F.col("deleted_at").isNull())
    return (r.groupBy(F.window("created_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("orders"))
            .select(F.to_date(F.col("w.start")).alias("period"), "orders"))


def run_available_now(spark: SparkSession, agg: DataFrame, name: str, timeout_s: int | None = None,
                      location: str | None = None) -> DataFrame:
    """Run a streaming aggregate to completion over the data present now; return the result table.

    With a stable ``location`` (a folder in the shared checkpoint area) later runs only read
    files that arrived since the previous run and update the kept state; without one, each
    run starts from an empty state in a fresh folder. A source without files gives no rows.
    ``timeout_s`` is the caller's choice; by default the run takes as long as its data needs."""
    root = location or ensure_checkpoint_dir(spark).rstrip("/") + f"/kpiloom-stream/{name}-{uuid.uuid4().hex[:12]}"
    out, ckpt = f"{root}/result", f"{root}/checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (agg.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).queryName(f"{name}_{uuid.uuid4().hex[:6]}").start())
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    try:
        results = spark.read.parquet(out)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], agg.schema)
    last = results.agg(F.max("batch")).first()[0]
    return spark.read.schema(agg.schema).parquet(f"{out}/batch={last if last is not None else 0}")


def events_stream(spark: SparkSession, src: str, table: str = "events.parquet",
                  files_per_trigger: int | None = None) -> DataFrame:
    """The event table of a folder, one file or a folder of part files, as a file stream (new files are picked
    up by later runs). ``files_per_trigger`` bounds a micro-batch; by default one takes all that is there."""
    reader = spark.readStream.schema(RAW_SCHEMAS["events"])
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a pattern, so that Spark does not take a single file for the base folder of partitions
    return reader.parquet(f"{src}/{table[:-1]}[{table[-1]}]")


def stream_weekly_paid_washes(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    agg = weekly_paid_washes_stream(reservations_from_events(events_stream(spark, sf_dir)), p)
    return run_available_now(spark, agg, "weekly_paid_washes").orderBy("week_start")


def stream_daily_orders(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    agg = daily_orders_stream(reservations_from_events(events_stream(spark, sf_dir)), p)
    return run_available_now(spark, agg, "daily_orders").orderBy("period")
