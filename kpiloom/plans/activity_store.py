"""First activity per client (S02) kept up to date by exact increments.

A minimum cannot be taken back: when the order behind a client's first day is cancelled, deleted or moved, the
next day is needed. So the store keeps how many activity rows each (client, day) has. A change is a signed count:
rows that came to count add one, rows that no longer count (a late cancellation, a deletion, a moved date) take one
away. First activity is the smallest day whose counts sum to more than zero.

Layout, under one folder that the cluster shares::

    counts/version=V/bucket=B   (client_id, act, n)   signed counts of change V; version 0 is a full build
    first/version=V/bucket=B    (client_id, fa)       clients whose first day V has set; NULL: none is left
    commits/version=V                                 written last, so a version without it does not exist

A change reads the counts of the buckets that its clients are in, and writes rows of those clients only. Readers
take each client's row of its newest version. ``compact`` folds the versions into one full one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions.windows import min_day_text
from kpiloom.operators.activity import first_activity_rows
from kpiloom.session import ensure_checkpoint_dir
from kpiloom.sources.tables import Tables

BUCKETS = 256


def signed_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(client_id, act, n) with n <> 0: how often each activity row has come (above 0) or gone between two states.

    What EXCEPT ALL gives in both directions, from one partial aggregate over both states. States may be parts of the
    tables (say, the months that changed), as long as both are the same part."""
    rows = before.select("client_id", "act", F.lit(-1).alias("n")).unionByName(
        after.select("client_id", "act", F.lit(1).alias("n")))
    return rows.groupBy("client_id", "act").agg(F.sum("n").alias("n")).where("n <> 0")


class ActivityStore:
    """The stored table. A NULL client is a client like any other. One writer at a time; readers at any time."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.root = (root or ensure_checkpoint_dir(spark).rstrip("/") + "/kpiloom-first-activity-store").rstrip("/")

    def versions(self) -> list[int]:
        """Committed versions since the last full one, oldest first."""
        try:
            found = self.spark.read.schema("full boolean, version int").parquet(f"{self.root}/commits").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        full = max((r.version for r in found if r.full), default=-1)
        return sorted(r.version for r in found if r.version >= full)

    def _read(self, part: str, columns: str) -> DataFrame:
        return self.spark.read.schema(f"{columns}, version int, bucket int").option(
            "basePath", f"{self.root}/{part}").parquet(*[f"{self.root}/{part}/version={v}" for v in self.versions()])

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("client_id"), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, part: str, version: int) -> None:
        """One or a few files for each bucket; a failed attempt's files are replaced."""
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{part}/version={version}")

    def _commit(self, version: int, full: bool) -> int:
        self.spark.range(1).select(F.lit(full).alias("full")).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/commits/version={version}")
        return version

    def _next(self) -> int:
        return max(self.versions(), default=-1) + 1

    def rebuild(self, rows: DataFrame) -> int:
        """A full version from all activity rows (client_id, act); returns its number."""
        version = self._next()
        self._write(self._bucketed(rows.groupBy("client_id", "act").agg(F.count(F.lit(1)).alias("n"))), "counts", version)
        counts = self.spark.read.schema("client_id bigint, act string, n bigint, bucket int").parquet(
            f"{self.root}/counts/version={version}")
        self._write(self._bucketed(min_day_text(counts, "client_id", "act", "fa")), "first", version)
        return self._commit(version, True)

    def counts(self) -> DataFrame:
        """(client_id, act, n) with n > 0: activity rows now."""
        rows = self._read("counts", "client_id bigint, act string, n bigint")
        return rows.groupBy("client_id", "act").agg(F.sum("n").alias("n")).where("n > 0")

    def apply(self, changes: DataFrame) -> int:
        """Add signed changes (client_id, act, n); returns the new version's number, or the present one if there are
        none. Only clients with a change are written."""
        if not self.versions():
            raise ValueError("the store is empty: build it with rebuild() first")
        version = self._next()
        self._write(self._bucketed(changes), "counts", version)
        written = self.spark.read.schema("client_id bigint, act string, n bigint, bucket int").parquet(
            f"{self.root}/counts/version={version}")
        touched = [r.bucket for r in written.select("bucket").distinct().collect()]  # of at most ``buckets``
        if not touched:
            return version - 1
        clients = written.select(F.col("client_id").alias("changed")).distinct()
        before = self._read("counts", "client_id bigint, act string, n bigint").where(F.col("bucket").isin(touched))
        now = (before.select("client_id", "act", "n").unionByName(written.select("client_id", "act", "n"))
               .join(clients, F.col("client_id").eqNullSafe(F.col("changed")), "left_semi")
               .groupBy("client_id", "act").agg(F.sum("n").alias("n")))
        if now.where("n < 0").limit(1).count():
            raise ValueError("changes take away more rows than the store holds: they are not against its state")
        # clients whose last activity row has gone keep a row with a NULL day
        first = min_day_text(now.withColumn("act", F.when(F.col("n") > 0, F.col("act"))), "client_id", "act", "fa")
        self._write(self._bucketed(first), "first", version)
        return self._commit(version, False)

    def refresh(self, before: Tables, after: Tables) -> int:
        """Carry the store from one state of the source tables (or of the same part of them) to another."""
        return self.apply(signed_changes(first_activity_rows(before), first_activity_rows(after)))

    def table(self) -> DataFrame:
        """(client_id, fa) of clients with any activity: what a full build would give."""
        rows = self._read("first", "client_id bigint, fa string")
        newest = rows.groupBy("client_id").agg(F.max(F.struct("version", "fa")).alias("x"))
        return newest.where("x.fa IS NOT NULL").select("client_id", "x.fa")

    def compact(self) -> int:
        """Fold all versions into one full version; older folders are no longer read."""
        counts, first = self.counts(), self.table()
        version = self._next()
        self._write(self._bucketed(counts), "counts", version)
        self._write(self._bucketed(first), "first", version)
        return self._commit(version, True)
