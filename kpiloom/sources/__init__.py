from kpiloom.sources.tables import SCHEMAS, Tables, derive_test_tables

__all__ = ["SCHEMAS", "Tables", "derive_test_tables"]
