"""Incremental refresh: the streaming aggregate over files arriving in two batches equals the
batch report over all of them, and a rerun without new files changes nothing."""

import datetime as dt

from pyspark.sql import functions as F

from kpiloom.operators.weekly import weekly_paid_washes
from kpiloom.params import FIXTURE
from kpiloom.sources.tables import RAW_SCHEMAS, derive_test_tables, reservations_from_events
from kpiloom.streaming.weekly import events_stream, run_available_now, weekly_paid_washes_stream

from .conftest import SF_SMALL


def test_incremental_weekly_stream_matches_batch(spark, tmp_path):
    events = spark.read.schema(RAW_SCHEMAS["events"]).parquet(f"{SF_SMALL}/events.parquet")
    src, loc = str(tmp_path / "src"), str(tmp_path / "stream")
    cut = dt.datetime(2024, 1, 15)
    events.where(F.col("ts") < F.lit(cut)).repartition(3).write.parquet(f"{src}/events.parquet")

    def run():
        agg = weekly_paid_washes_stream(reservations_from_events(events_stream(spark, src)), FIXTURE)
        return sorted(map(tuple, run_available_now(spark, agg, "wk", location=loc).collect()))

    first = run()
    events.where(F.col("ts") >= F.lit(cut)).repartition(2).write.mode("append").parquet(f"{src}/events.parquet")
    second = run()
    third = run()  # no new files
    batch = sorted(map(tuple, weekly_paid_washes(derive_test_tables(spark, SF_SMALL), FIXTURE).collect()))
    assert second == batch and third == batch and first != batch


def test_stream_of_an_empty_source_has_no_rows(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    agg = weekly_paid_washes_stream(reservations_from_events(events_stream(spark, str(tmp_path))), FIXTURE)
    out = run_available_now(spark, agg, "wk", location=str(tmp_path / "stream"))
    assert out.columns == agg.columns and out.count() == 0


class _Ctx:
    def __init__(self, master, ckpt=None):
        self.master, self._ckpt, self.set_to = master, ckpt, None

    def getCheckpointDir(self):
        return self._ckpt

    def setCheckpointDir(self, d):
        self.set_to = d


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, k, default=None):
        return self.values.get(k, default)


class _Session:
    def __init__(self, master, conf=None, ckpt=None):
        self.sparkContext, self.conf = _Ctx(master, ckpt), _Conf(conf or {})


def test_checkpoint_dir_comes_from_the_session_and_never_falls_back_on_a_cluster():
    import pytest

    from kpiloom.session import ensure_checkpoint_dir

    assert ensure_checkpoint_dir(_Session("yarn", ckpt="hdfs://nn/ckpt")) == "hdfs://nn/ckpt"
    s = _Session("k8s://api", {"spark.checkpoint.dir": "s3a://shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "s3a://shared/ckpt" and s.sparkContext.set_to == "s3a://shared/ckpt"
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("spark://master:7077"))
    local = _Session("local[2]")
    assert ensure_checkpoint_dir(local) == local.sparkContext.set_to  # scratch folder only in local mode
