"""Sources are checked against their schemas when they are read."""

import pytest
from pyspark.sql import functions as F

from kpiloom.operators.growth import growth_sales
from kpiloom.params import FIXTURE
from kpiloom.sources.tables import SCHEMAS, Tables, derive_test_tables, typed

from .conftest import SF_SMALL
from .test_plans import formatted


def test_derived_tables_have_their_schemas(spark):
    t = derive_test_tables(spark, SF_SMALL)
    for name in SCHEMAS:
        assert typed(t[name], name).columns == t[name].columns, name


def test_wrong_types_are_errors_and_harmless_ones_are_cast(spark, tmp_path):
    t = derive_test_tables(spark, SF_SMALL)
    good = t.reservations.withColumn("status", F.col("status").cast("smallint")).withColumn(
        "total_price", F.col("total_price").cast("decimal(12,4)")).withColumn("month", F.lit("2024-01"))
    good.write.parquet(str(tmp_path / "good" / "reservations"))
    read = Tables.from_parquet(spark, str(tmp_path / "good"))
    assert dict(read.reservations.dtypes)["status"] == "int" and "month" in read.reservations.columns
    assert growth_sales(read, FIXTURE).collect() == growth_sales(t, FIXTURE).collect()
    f = formatted(growth_sales(read, FIXTURE.dated("past 3 days")))
    assert "GreaterThanOrEqual(created_at," in f  # the check keeps filters on their way to the scan

    bad = t.reservations.withColumn("created_at", F.col("created_at").cast("string")).drop("deleted_at")
    bad.write.parquet(str(tmp_path / "bad" / "reservations"))
    read = Tables.from_parquet(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="created_at is string, not timestamp; deleted_at is missing"):
        growth_sales(read, FIXTURE)


def test_a_key_as_double_is_an_error(spark):
    t = derive_test_tables(spark, SF_SMALL)
    with pytest.raises(ValueError, match="client_id is double"):
        typed(t.reservations.withColumn("client_id", F.col("client_id").cast("double")), "reservations")
