"""Every registered query against its DuckDB oracle on the smallest test tables
(the driver repeats this at sf0.01). Identities between queries are checked too."""

import pytest

from kpiloom.plans.catalog import QUERIES
from kpiloom.plans.verify import compare

from .conftest import SF_SMALL

NAMES = sorted(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck_small, name):
    q = QUERIES[name]
    df = q.run(spark, SF_SMALL)
    sql = q.oracle_sql()
    if sql is None:
        assert df.count() >= 0
        return
    r = compare(df, duck_small, sql)
    assert r["ok"], r


def test_every_query_has_oracle():
    missing = [n for n, q in QUERIES.items() if q.oracle is None]
    assert not missing or set(missing) <= {"profile_columns", "profile_reservations_sketch"} | {n for n in missing if n.startswith("stream_")}, missing
