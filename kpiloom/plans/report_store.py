"""Stored board results by period, in versions.

Under one folder that the cluster shares::

    data/<report>/version=V/part=P/   rows of a report for month P ('all': a report without periods), never changed
    boards/version=V                  one file: which part of which report is in which version, and its columns

``publish`` writes parts first and the board file last. A reader takes the newest board file and only the parts that it
names, so it sees a board as it was published or the one before, never half of one; a publication that fails leaves no
board file. Publishing some months writes those parts and points to the older versions for all others.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of period columns, as the reports call them.
PERIODS = ("period", "day", "month", "week", "week_start")
_ENTRY = "report string, part string, at int, columns string, version int"


class ReportStore:
    """One publisher at a time; readers at any time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _boards(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_ENTRY).parquet(f"{self.root}/boards")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def version(self) -> int | None:
        """The newest published version."""
        boards = self._boards()
        return None if boards is None else boards.agg(F.max("version")).first()[0]

    def _entries(self, version: int | None) -> list:
        """A row for each part of each report of a version: bounded by reports and months."""
        return [] if version is None else self._boards().where(F.col("version") == version).collect()

    def publish(self, results: dict[str, DataFrame], months: Iterable[str] | None = None) -> int:
        """Store reports as the next version. ``months`` ('YYYY-MM'): only these periods of them are written; reports
        without a period column are written whole. Other reports stay as they are. Returns the version."""
        before = self._entries(self.version())
        version = 1 + max((self.version() or 0), 0)
        months = None if months is None else sorted(months)
        kept = [e for e in before if e.report not in results]
        new = []
        for name, rows in results.items():
            period = next((c for c in PERIODS if c in rows.columns), None)
            part = F.lit("all") if period is None else F.coalesce(F.date_format(F.col(period).cast("date"), "yyyy-MM"), F.lit("none"))
            own = rows.withColumn("part", part)
            if months is not None and period is not None:
                own = own.where(F.col("part").isin(months))
                kept += [e for e in before if e.report == name and e.part not in months]
            path = f"{self.root}/data/{name}/version={version}"
            own.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
            parts = self.spark.read.schema("part string").option("basePath", path).parquet(path).distinct().collect()
            new += [(name, p.part, version, rows.schema.json()) for p in parts] or [(name, None, version, rows.schema.json())]
        entries = [(e.report, e.part, e.at, e.columns) for e in kept if e.part is not None] + new
        board = self.spark.createDataFrame(entries, "report string, part string, at int, columns string")
        board.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/boards/version={version}")
        return version

    def read(self, report: str, version: int | None = None) -> DataFrame:
        """A report as published in a version (the newest, if None), in no particular order."""
        own = [e for e in self._entries(version or self.version()) if e.report == report]
        if not own:
            raise KeyError(f"no report {report!r} in the store")
        schema = T.StructType.fromJson(json.loads(max(own, key=lambda e: e.at).columns))
        paths = [f"{self.root}/data/{report}/version={e.at}/part={e.part}" for e in own if e.part is not None]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def reports(self, version: int | None = None) -> list[str]:
        return sorted({e.report for e in self._entries(version or self.version())})
