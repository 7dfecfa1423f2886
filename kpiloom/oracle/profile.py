"""Oracle SQL for M66: the same statistics as UNION ALL of one SELECT per column."""

from __future__ import annotations

from kpiloom.oracle.common import div, rnd


def _num(col):
    x = f"cast({col} AS DOUBLE)"
    return f"""SELECT '{col}' AS "column", 'number' AS kind, NULL AS earliest, NULL AS latest,
  {rnd(f'MIN({x})', 6)} AS min, {rnd(f'quantile_cont({x}, 0.25)', 6)} AS q1,
  {rnd(f'quantile_cont({x}, 0.75)', 6)} AS q3, {rnd(f'MAX({x})', 6)} AS max, {rnd(f'AVG({x})', 6)} AS avg,
  {rnd(f'stddev_samp({x})', 6)} AS sd,
  {rnd(f"(SUM(power({x} - mu, 3)) / COUNT({x})) / power(SUM(power({x} - mu, 2)) / COUNT({x}), 1.5)", 6)} AS skewness,
  {rnd(f"(SUM(power({x} - mu, 4)) / COUNT({x})) / power(SUM(power({x} - mu, 2)) / COUNT({x}), 2) - 3", 6)} AS excess_kurtosis,
  {rnd(div(f'COUNT(CASE WHEN {x} = 0 THEN 1 END)', 'COUNT(*)'), 6)} AS zero_fraction
FROM (SELECT *, AVG(cast({col} AS DOUBLE)) OVER () AS mu FROM card) c"""


def _date(col):
    return f"""SELECT '{col}' AS "column", 'datetime' AS kind, strftime(MIN({col}), '%Y-%m-%d') AS earliest,
  strftime(MAX({col}), '%Y-%m-%d') AS latest, NULL AS min, NULL AS q1, NULL AS q3, NULL AS max, NULL AS avg,
  NULL AS sd, NULL AS skewness, NULL AS excess_kurtosis, NULL AS zero_fraction FROM card"""


def _freq(col):
    v = f"cast({col} AS VARCHAR)"
    return f"""SELECT '{col}' AS "column", COUNT(DISTINCT {v}) AS distinct_count,
  {rnd(div(f'COUNT(*) - COUNT({col})', 'COUNT(*)'), 6)} AS nil_pct,
  (SELECT {rnd(div('MAX(cnt)', '(SELECT COUNT(*) FROM card)'), 6)} FROM
     (SELECT COUNT(*) AS cnt FROM card WHERE {col} IS NOT NULL GROUP BY {v})) AS mode_fraction,
  (SELECT {rnd(div('SUM(cnt)', '(SELECT COUNT(*) FROM card)'), 6)} FROM
     (SELECT COUNT(*) AS cnt FROM card WHERE {col} IS NOT NULL GROUP BY {v} ORDER BY cnt DESC LIMIT 3)) AS top3_fraction
FROM card"""


def profile_columns(p):
    from kpiloom.oracle.okr import package_share

    card = package_share(p.with_(grain="monthly"))
    stats = "\nUNION ALL ".join([_date("month"), _num("package_orders"), _num("package_pct")])
    freqs = "\nUNION ALL ".join([_freq("month"), _freq("package_orders"), _freq("package_pct")])
    return f"""WITH card AS ({card}),
st AS ({stats}),
fr AS ({freqs})
SELECT st."column", st.kind, fr.distinct_count, fr.nil_pct, st.earliest, st.latest,
  cast(st.min AS DOUBLE) AS min, cast(st.q1 AS DOUBLE) AS q1, cast(st.q3 AS DOUBLE) AS q3,
  cast(st.max AS DOUBLE) AS max, cast(st.avg AS DOUBLE) AS avg, cast(st.sd AS DOUBLE) AS sd,
  cast(st.skewness AS DOUBLE) AS skewness, cast(st.excess_kurtosis AS DOUBLE) AS excess_kurtosis,
  cast(st.zero_fraction AS DOUBLE) AS zero_fraction, fr.mode_fraction, fr.top3_fraction
FROM st JOIN fr ON fr."column" = st."column" ORDER BY st."column\""""


def profile_columns_sketch(p):
    """A sketch gives values that occur: quartiles without interpolation."""
    return profile_columns(p).replace("quantile_cont", "quantile_disc")


PROFILE_SQL = {"profile_columns": profile_columns, "profile_columns_sketch": profile_columns_sketch}
