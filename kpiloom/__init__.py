"""kpiloom: business KPI reports as composable Spark DataFrame operators.

Every operator has the signature ``op(t: Tables, p: Params) -> DataFrame`` and is a
declarative Spark plan (no collect, no driver loops); Catalyst and AQE choose the
physical strategy.
"""

from kpiloom.params import Params
from kpiloom.sources.tables import Tables

__all__ = ["Params", "Tables"]
