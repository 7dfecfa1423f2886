"""Source tables of the reports.

``Tables`` is a lazy name -> DataFrame map. Production data is read with
``Tables.from_parquet`` (one Parquet dataset per table, ideally partitioned by
event month so date predicates prune files) or ``Tables.from_jdbc``.
``derive_test_tables`` builds the same schemas from the driver's TPC-H-ish test
tables (FIXTURES.md); every derivation is a narrow projection (no shuffle), so
column pruning and filter pushdown still reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "reservations": (
        "id bigint, client_id bigint, created_at timestamp, date string, status int, use_package int, "
        "total_price string, representative_id bigint, representative_start_at timestamp, "
        "representative_end_at timestamp, deleted_at timestamp, city_id bigint, area_id bigint, "
        "subscription_id bigint"
    ),
    "reservations_long": (
        "id bigint, client_id bigint, created_at timestamp, status int, use_package int, "
        "total_price string, deleted_at timestamp"
    ),
    "package_subscriptions": (
        "id bigint, client_id bigint, status int, created_at timestamp, cost decimal(10,2), "
        "deleted_at timestamp, package_id bigint"
    ),
    "packages": "id bigint, is_customized int",
    "clients": "id bigint, username string, type int, created_at timestamp",
    "attendances": "date date, representative_id bigint",
    "reservation_service": "reservation_id bigint, is_product int, is_deleted int",
    "cities": "id bigint, name string",
    "areas": "id bigint, name string, city_id bigint",
    "companies": "id bigint, created_at timestamp",
    "corporate_wash_leads": "id bigint, created_at timestamp, contact_status int",
    "reviews": "id bigint, created_at timestamp, score int, deleted_at timestamp",
    "client_complaints": "id bigint, created_at timestamp, answer_at timestamp, deleted_at timestamp",
    "user_area_availability_alert_logs": "id bigint, created_at timestamp",
}


def typed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the column types of ``SCHEMAS[name]``. A column that is missing, or of a type that would change values
    on the way (text for a time, a double for a key), raises ValueError, instead of a report that is silently wrong; whole
    numbers are widened or narrowed (an overflow is an error under ANSI), timestamps and decimals cast."""
    if name not in SCHEMAS:
        return rows
    whole, times = ("tinyint", "smallint", "int", "bigint", "boolean"), ("timestamp", "timestamp_ntz")
    have = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out, wrong = [], []
    for f in T.StructType.fromDDL(SCHEMAS[name]).fields:
        want, got = f.dataType.simpleString(), have.get(f.name)
        if got == want:
            out.append(F.col(f.name))
        elif got is not None and ((want in whole and got in whole) or (want in times and got in times)
                                  or (want == "date" and got in times)
                                  or (want.startswith("decimal") and (got.startswith("decimal") or got in whole))
                                  or (f.name == "total_price" and (got.startswith("decimal") or got in ("double", *whole)))):
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            wrong.append(f"{f.name} is {got or 'missing'}, not {want}")
    if wrong:
        raise ValueError(f"table {name}: {'; '.join(wrong)}")
    fixed = {f.name for f in T.StructType.fromDDL(SCHEMAS[name]).fields}
    return rows.select(*out, *[c for c in rows.columns if c not in fixed])


class Tables:
    """Lazily resolved source tables. ``t.reservations`` or ``t["reservations"]``."""

    def __init__(self, loaders: dict[str, Callable[[], DataFrame]]):
        self._loaders = dict(loaders)
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name not in self._loaders:
                raise KeyError(f"unknown table {name!r}")
            self._cache[name] = self._loaders[name]()
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def replace(self, **tables: DataFrame | Callable[[], DataFrame]) -> "Tables":
        """A copy with some tables swapped (e.g. reservations=reservations_long)."""
        loaders = dict(self._loaders)
        for k, v in tables.items():
            loaders[k] = v if callable(v) else (lambda v=v: v)
        out = Tables(loaders)
        for k, v in self._cache.items():
            if k not in tables:
                out._cache[k] = v
        return out

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, names: list[str] | None = None) -> "Tables":
        """One Parquet dataset per table under ``root`` (``root/<table>``), checked against ``SCHEMAS`` when it is first
        used. Columns beyond the schema, such as partition columns, stay."""
        names = names or list(SCHEMAS)
        return cls({n: (lambda n=n: typed(spark.read.parquet(f"{root}/{n}"), n)) for n in names})

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, props: dict, partitioning: dict | None = None) -> "Tables":
        """Read the operational database directly; ``partitioning[table]`` =
        (column, lower, upper, num_partitions) splits big tables into parallel range reads."""
        partitioning = partitioning or {}

        def load(n: str) -> DataFrame:
            if n in partitioning:
                col, lo, hi, k = partitioning[n]
                return typed(spark.read.jdbc(url, n, column=col, lowerBound=lo, upperBound=hi,
                                             numPartitions=k, properties=props), n)
            return typed(spark.read.jdbc(url, n, properties=props), n)

        return cls({n: (lambda n=n: load(n)) for n in SCHEMAS})


# ---------------------------------------------------------------------------
# Test-table derivations (FIXTURES.md), written as SQL expression strings: each
# projection is one call into the JVM (parsed there), not one call per Column node.
# Fixed values of the derivation:
T0 = "TIMESTAMP '2024-01-01 00:00:00'"
# ---------------------------------------------------------------------------

# Integer ``k`` of the one-key ``props`` document (``{"k": 69}``). A regex extract is about
# 2x cheaper per row than a JSON parse and gives the same value on this shape (the DuckDB
# oracle uses a real JSON extraction, so every oracle check confirms it).
K_EXPR = """try_cast(regexp_extract(props, '"k"\\\\s*:\\\\s*(-?\\\\d+)', 1) AS INT)"""


def _t0_plus_days(n: str) -> str:
    return f"timestampadd(DAY, CAST({n} AS INT), {T0})"


# cast(price/1000 as decimal(10,2)) done in exact integer cents (half up)
COST_EXPR = ("CAST(CAST(floor((CAST(round(o_totalprice * 100) AS BIGINT) + 5) / 10) AS DECIMAL(12,0)) * 0.01BD "
             "AS DECIMAL(10,2))")

RESERVATION_EXPRS = [
    "CAST(event_id AS BIGINT) AS id",
    "CAST(user_id AS BIGINT) AS client_id",
    "ts AS created_at",
    "CASE WHEN k % 25 = 0 THEN CAST(NULL AS STRING) WHEN k % 25 = 1 THEN '' "
    "ELSE date_format(ts, 'yyyy-MM-dd') END AS date",
    "CASE WHEN event_type = 'error' THEN 6 WHEN event_type = 'signup' THEN 1 ELSE 3 END AS status",
    "CASE WHEN k % 5 < 2 THEN 1 ELSE 0 END AS use_package",
    "CAST(value AS STRING) AS total_price",
    "CAST(CASE WHEN k % 20 = 0 THEN NULL ELSE user_id % 8 END AS BIGINT) AS representative_id",
    "timestampadd(MINUTE, 5, ts) AS representative_start_at",
    "CASE WHEN k % 33 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) "
    "ELSE timestampadd(MINUTE, CAST(5 + k % 30 AS INT), ts) END AS representative_end_at",
    "CASE WHEN k = 99 THEN ts END AS deleted_at",
    "CAST(user_id % 5 AS BIGINT) AS city_id",
    "CAST(user_id % 25 AS BIGINT) AS area_id",
    "CAST(CASE WHEN k % 5 < 2 THEN event_id % 1000 END AS BIGINT) AS subscription_id",
]


def reservations_from_events(events: DataFrame) -> DataFrame:
    """reservations derived from events (works on batch and streaming frames)."""
    return events.selectExpr("*", f"{K_EXPR} AS k").selectExpr(*RESERVATION_EXPRS)


# Schemas of the driver's raw test tables; passing them skips footer-based schema inference.
RAW_SCHEMAS: dict[str, str] = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def derive_test_tables(spark: SparkSession, sf_dir: str) -> Tables:
    def raw(n: str) -> DataFrame:
        return spark.read.schema(RAW_SCHEMAS[n]).parquet(f"{sf_dir}/{n}.parquet")

    def with_k(df: DataFrame) -> DataFrame:
        return df.selectExpr("*", f"{K_EXPR} AS k")

    def reservations() -> DataFrame:
        return reservations_from_events(raw("events"))

    def reservations_long() -> DataFrame:
        return raw("orders").selectExpr(
            "CAST(o_orderkey AS BIGINT) AS id", "CAST(o_custkey AS BIGINT) AS client_id",
            "CAST(o_orderdate AS TIMESTAMP) AS created_at",
            "CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 WHEN 'P' THEN 6 END AS status",
            "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS use_package",
            "CAST(o_totalprice AS STRING) AS total_price", "CAST(NULL AS TIMESTAMP) AS deleted_at")

    def package_subscriptions() -> DataFrame:
        return raw("orders").selectExpr(
            "CAST(o_orderkey AS BIGINT) AS id", "CAST(o_custkey % 150 AS BIGINT) AS client_id",
            "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS status",
            f"{_t0_plus_days('o_orderkey % 30')} AS created_at", f"{COST_EXPR} AS cost",
            f"CASE WHEN o_orderkey % 10 = 0 THEN {_t0_plus_days('1')} END AS deleted_at",
            "CAST(o_orderkey % 200 AS BIGINT) AS package_id")

    def packages() -> DataFrame:
        return raw("part").selectExpr(
            "CAST(p_partkey AS BIGINT) AS id",
            "CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS is_customized")

    def clients() -> DataFrame:
        return raw("customer").selectExpr(
            "CAST(c_custkey AS BIGINT) AS id", "c_name AS username",
            "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS type",
            f"{_t0_plus_days('c_custkey % 30')} AS created_at")

    def attendances() -> DataFrame:
        return raw("events").where("event_type = 'view'").selectExpr(
            "to_date(ts) AS date", "CAST(user_id % 8 AS BIGINT) AS representative_id")

    def reservation_service() -> DataFrame:
        return raw("lineitem").selectExpr(
            "CAST(l_orderkey AS BIGINT) AS reservation_id",
            "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS is_product",
            "CASE WHEN l_linestatus = 'F' AND l_linenumber >= 5 THEN 1 ELSE 0 END AS is_deleted")

    def cities() -> DataFrame:
        return raw("region").selectExpr(
            "CAST(r_regionkey AS BIGINT) AS id",
            """format_string('{"en": "%s", "ar": "%s"}', r_name, lower(r_name)) AS name""")

    def areas() -> DataFrame:
        return raw("nation").selectExpr(
            "CAST(n_nationkey AS BIGINT) AS id", "n_name AS name", "CAST(n_regionkey AS BIGINT) AS city_id")

    def companies() -> DataFrame:
        return raw("supplier").selectExpr(
            "CAST(s_suppkey AS BIGINT) AS id", f"{_t0_plus_days('s_suppkey % 30')} AS created_at")

    def corporate_wash_leads() -> DataFrame:
        return raw("customer").where("c_mktsegment = 'MACHINERY'").selectExpr(
            "CAST(c_custkey AS BIGINT) AS id", f"{_t0_plus_days('c_custkey % 30')} AS created_at",
            "CAST(c_custkey % 3 AS INT) AS contact_status")

    def reviews() -> DataFrame:
        return with_k(raw("events").where("event_type = 'view'")).selectExpr(
            "CAST(event_id AS BIGINT) AS id", "ts AS created_at", "CAST(1 + k % 5 AS INT) AS score",
            "CASE WHEN k = 99 THEN ts END AS deleted_at")

    def client_complaints() -> DataFrame:
        return with_k(raw("events").where("event_type = 'error'")).selectExpr(
            "CAST(event_id AS BIGINT) AS id", "ts AS created_at",
            "CASE WHEN k % 4 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) "
            "ELSE timestampadd(MINUTE, CAST(k * 37 AS INT), ts) END AS answer_at",
            "CASE WHEN k = 99 THEN ts END AS deleted_at")

    def user_area_availability_alert_logs() -> DataFrame:
        return raw("events").where("event_type = 'signup'").selectExpr(
            "CAST(event_id AS BIGINT) AS id", "ts AS created_at")

    loaders = {f.__name__: f for f in (
        reservations, reservations_long, package_subscriptions, packages, clients, attendances,
        reservation_service, cities, areas, companies, corporate_wash_leads, reviews,
        client_complaints, user_area_availability_alert_logs)}
    return Tables(loaders)
