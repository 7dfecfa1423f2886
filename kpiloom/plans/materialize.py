"""Materialized helper table of the scoreboards: all-time first activity per client.

``refresh_first_activity`` rebuilds it from all history, once for any number of reports; they pick it up
through ``Tables.replace(first_activity=...)`` and then read one month of facts. Where two states of the
tables (or the rows that changed) are at hand, ``plans/activity_store.py`` keeps it by exact increments.

Writes go to a new versioned directory and are read back from it, which cuts the lineage
(the cluster can lose executors without recomputing history) and never overwrites the
table a running report is reading.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import SparkSession

from kpiloom.functions.windows import min_day_text
from kpiloom.operators.activity import first_activity_rows
from kpiloom.session import ensure_checkpoint_dir
from kpiloom.sources.tables import Tables


def refresh_first_activity(spark: SparkSession, t: Tables, root: str | None = None) -> str:
    """Write first activity per client; returns the new version's path."""
    fa = min_day_text(first_activity_rows(t), "client_id", "act", "fa")
    base = (root or ensure_checkpoint_dir(spark)).rstrip("/")
    path = f"{base}/kpiloom-first-activity/v-{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    fa.write.parquet(path)
    return path
