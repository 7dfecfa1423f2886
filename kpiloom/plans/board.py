"""Dashboards: one parameter object fanned out to many reports (P5), and the result sink.

``run_board`` only builds lazy DataFrames; nothing runs until a result is written or
collected, and each report scans its own columns with its own pushed-down date range.
``run_fused`` takes the cards' parts from one scan of each source table instead
(plans/fused.py).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from kpiloom.params import Params
from kpiloom.plans.fused import Card, FusedBoard
from kpiloom.session import ensure_checkpoint_dir
from kpiloom.sources.tables import Tables

Operator = Callable[[Tables, Params], DataFrame]


def run_board(ops: dict[str, Operator] | Iterable[Operator], t: Tables, p: Params) -> dict[str, DataFrame]:
    """Bind every operator of a board to the same tables and parameters."""
    items = ops.items() if isinstance(ops, dict) else ((op.__name__, op) for op in ops)
    return {name: op(t, p) for name, op in items}


def run_fused(cards: Iterable[Card], t: Tables, p: Params, root: str | None = None) -> dict[str, DataFrame]:
    """The cards of a board from one scan of each table: what ``run_board`` returns for them. The scans run here, once;
    their results, a row for each period, are written to a new folder under ``root`` (default: the shared checkpoint
    folder)."""
    board = FusedBoard(cards, t, p)
    spark = next(iter(board.frames.values())).sparkSession
    base = (root or ensure_checkpoint_dir(spark)).rstrip("/")
    return board.store(f"{base}/kpiloom-board-{uuid.uuid4().hex}").results()


def write_board(results: dict[str, DataFrame], root: str, mode: str = "overwrite") -> dict[str, str]:
    """Persist each report result as Parquet under ``root/<report>`` (a shared folder on a cluster)."""
    paths = {}
    for name, df in results.items():
        path = f"{root.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(path)
        paths[name] = path
    return paths


def growth_board() -> dict[str, Operator]:
    """The ten growth cards driven by one granularity/date filter."""
    from kpiloom.operators.growth import GROWTH

    return dict(GROWTH)


def okr_board() -> dict[str, Operator]:
    """The monthly / daily OKR cards."""
    from kpiloom.operators.okr import OKR

    return {k: v for k, v in OKR.items() if k != "sales_last_n_days"}


def okr_board_long(t: Tables, p: Params) -> DataFrame:
    """M11 to M24 as (card, period, metric, value), from one scan of each source table."""
    from kpiloom.operators.okr_cards import OKR_CARDS

    return FusedBoard(OKR_CARDS, t, p).long().orderBy("card", "period", "metric")


def growth_orders_stored(t: Tables, p: Params) -> DataFrame:
    """M02 read back from a report store: the board is published, one month of it is published again, and the newest
    version is read."""
    from kpiloom.operators.growth import GROWTH
    from kpiloom.plans.report_store import ReportStore

    spark = t.reservations.sparkSession
    store = ReportStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/kpiloom-reports-{uuid.uuid4().hex}")
    cards = {name: GROWTH[name] for name in ("growth_orders", "growth_sales")}
    store.publish(run_board(cards, t, p))
    store.publish(run_board(cards, t, p), months=[f"{p.today:%Y-%m}"])
    return store.read("growth_orders").orderBy("period")
