"""DuckDB twins of the test-table derivations (FIXTURES.md), inlined as CTEs.

Only the driver's raw tables are registered in DuckDB, so each oracle query is
prefixed with the derived views it reads.
"""

from __future__ import annotations

import re

K = "cast(json_extract_string(props, '$.k') as integer)"
T0 = "TIMESTAMP '2024-01-01 00:00:00'"

VIEWS: dict[str, str] = {
    "reservations": f"""
SELECT cast(event_id AS BIGINT) AS id, cast(user_id AS BIGINT) AS client_id, ts AS created_at,
  CASE WHEN {K} % 25 = 0 THEN NULL WHEN {K} % 25 = 1 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS "date",
  CASE WHEN event_type = 'error' THEN 6 WHEN event_type = 'signup' THEN 1 ELSE 3 END AS status,
  CASE WHEN {K} % 5 < 2 THEN 1 ELSE 0 END AS use_package,
  cast(value AS VARCHAR) AS total_price,
  CASE WHEN {K} % 20 = 0 THEN NULL ELSE cast(user_id % 8 AS BIGINT) END AS representative_id,
  ts + to_minutes(5) AS representative_start_at,
  CASE WHEN {K} % 33 = 0 THEN NULL ELSE ts + to_minutes(cast(5 + {K} % 30 AS INTEGER)) END AS representative_end_at,
  CASE WHEN {K} = 99 THEN ts END AS deleted_at,
  cast(user_id % 5 AS BIGINT) AS city_id, cast(user_id % 25 AS BIGINT) AS area_id,
  CASE WHEN {K} % 5 < 2 THEN cast(event_id % 1000 AS BIGINT) END AS subscription_id
FROM events""",
    "reservations_long": """
SELECT cast(o_orderkey AS BIGINT) AS id, cast(o_custkey AS BIGINT) AS client_id,
  cast(o_orderdate AS TIMESTAMP) AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 WHEN 'P' THEN 6 END AS status,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS use_package,
  cast(o_totalprice AS VARCHAR) AS total_price, cast(NULL AS TIMESTAMP) AS deleted_at
FROM orders""",
    "package_subscriptions": f"""
SELECT cast(o_orderkey AS BIGINT) AS id, cast(o_custkey % 150 AS BIGINT) AS client_id,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS status,
  {T0} + to_days(cast(o_orderkey % 30 AS INTEGER)) AS created_at,
  cast(cast((cast(round(o_totalprice * 100) AS BIGINT) + 5) // 10 AS DECIMAL(12,0)) * 0.01 AS DECIMAL(10,2)) AS cost,
  CASE WHEN o_orderkey % 10 = 0 THEN {T0} + to_days(1) END AS deleted_at,
  cast(o_orderkey % 200 AS BIGINT) AS package_id
FROM orders""",
    "packages": """
SELECT cast(p_partkey AS BIGINT) AS id,
  CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS is_customized
FROM part""",
    "clients": f"""
SELECT cast(c_custkey AS BIGINT) AS id, c_name AS username,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS type,
  {T0} + to_days(cast(c_custkey % 30 AS INTEGER)) AS created_at
FROM customer""",
    "attendances": """
SELECT cast(ts AS DATE) AS "date", cast(user_id % 8 AS BIGINT) AS representative_id
FROM events WHERE event_type = 'view'""",
    "reservation_service": """
SELECT cast(l_orderkey AS BIGINT) AS reservation_id,
  CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS is_product,
  CASE WHEN l_linestatus = 'F' AND l_linenumber >= 5 THEN 1 ELSE 0 END AS is_deleted
FROM lineitem""",
    "cities": """
SELECT cast(r_regionkey AS BIGINT) AS id,
  '{"en": "' || r_name || '", "ar": "' || lower(r_name) || '"}' AS name
FROM region""",
    "areas": """
SELECT cast(n_nationkey AS BIGINT) AS id, n_name AS name, cast(n_regionkey AS BIGINT) AS city_id
FROM nation""",
    "companies": f"""
SELECT cast(s_suppkey AS BIGINT) AS id, {T0} + to_days(cast(s_suppkey % 30 AS INTEGER)) AS created_at
FROM supplier""",
    "corporate_wash_leads": f"""
SELECT cast(c_custkey AS BIGINT) AS id, {T0} + to_days(cast(c_custkey % 30 AS INTEGER)) AS created_at,
  cast(c_custkey % 3 AS INTEGER) AS contact_status
FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "reviews": f"""
SELECT cast(event_id AS BIGINT) AS id, ts AS created_at, cast(1 + {K} % 5 AS INTEGER) AS score,
  CASE WHEN {K} = 99 THEN ts END AS deleted_at
FROM events WHERE event_type = 'view'""",
    "client_complaints": f"""
SELECT cast(event_id AS BIGINT) AS id, ts AS created_at,
  CASE WHEN {K} % 4 = 0 THEN NULL ELSE ts + to_minutes(cast({K} * 37 AS INTEGER)) END AS answer_at,
  CASE WHEN {K} = 99 THEN ts END AS deleted_at
FROM events WHERE event_type = 'error'""",
    "user_area_availability_alert_logs": """
SELECT cast(event_id AS BIGINT) AS id, ts AS created_at
FROM events WHERE event_type = 'signup'""",
}

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def with_views(sql: str, alias: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the derived views it mentions (one WITH clause).
    ``alias`` maps a view name to the derivation that backs it (e.g. the long
    reservations history standing in for ``reservations``)."""
    alias = alias or {}
    words = set(_WORD.findall(sql))
    used = [n for n in VIEWS if n in words]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[alias.get(n, n)].strip()})" for n in used)
    body = sql.strip()
    if body[:5].upper() == "WITH " or body[:5].upper() == "WITH\n":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
