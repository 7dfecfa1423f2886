"""Compare output column types of every query with its oracle (Spark vs DuckDB)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kpiloom.plans.catalog import QUERIES  # noqa: E402
from kpiloom.plans.verify import duck_connect  # noqa: E402
from kpiloom.session import local_session  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "string": "VARCHAR",
                 "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = local_session()
con = duck_connect(sf)
bad = 0
for name, q in QUERIES.items():
    sql = q.oracle_sql()
    if sql is None:
        continue
    df = q.run(spark, sf)
    s = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rel = con.sql(sql)
    d = dict(zip(rel.columns, [str(t) for t in rel.types]))
    diffs = {c: (s[c], d.get(c)) for c in s if SPARK_TO_DUCK.get(s[c], s[c].upper()) != d.get(c)}
    if diffs:
        bad += 1
        print(name, diffs)
print("type mismatches:", bad)
