"""A board in one scan of each source table (P5).

Cards over one table differ in the rows they count and in what they compute, but share the table, the date column
and the period. ``Card`` states the parts: which rows, which sums and counts, which distinct keys, and the columns
made of them. ``fuse`` puts the parts of all cards of a table into one group-by: each part only sees its card's
rows, and a period belongs to a card if one of its rows fell into it. Distinct keys are grouping columns of a first
level, so that they are counted over one row for each (period, keys), not over facts.

The fused frame has one row a period. It can be stored (``FusedBoard.store``), and each card is a projection of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions.exprs import apply_date_filter, period
from kpiloom.params import Params
from kpiloom.sources.tables import Tables


@dataclass(frozen=True)
class Card:
    """``rows``: the card's rows of the table (all, if None). ``sums``: name -> summed expression; the sum of no
    value is NULL. ``counts``: name -> counted expression (rows, if None). ``distinct``: name -> grouping key
    (of ``KEYS``). ``columns``: output name -> expression over the parts' names."""

    name: str
    table: str
    columns: Callable[[], dict[str, Column]]
    rows: Callable[[], Column] | None = None
    sums: dict[str, Callable[[], Column]] = field(default_factory=dict)
    counts: dict[str, Callable[[], Column] | None] = field(default_factory=dict)
    distinct: dict[str, str] = field(default_factory=dict)
    live: bool = True
    date: str = "created_at"
    grains: tuple[str, ...] = ("daily", "monthly")


#: Grouping keys of distinct counts: name -> expression.
KEYS: dict[str, Callable[[], Column]] = {
    "worker": lambda: F.col("representative_id"),
    "worked_day": lambda: F.to_date("created_at"),
}


def _part(card: Card, name: str) -> str:
    return f"{card.name}:{name}"


def fuse(cards: Iterable[Card], t: Tables, p: Params) -> dict[tuple, DataFrame]:
    """(table, live, date column) -> one row for each period, with the parts of all its cards. ``p`` binds the grain and
    the date range to each card's date column."""
    groups: dict[tuple, list[Card]] = {}
    for card in cards:
        groups.setdefault((card.table, card.live, card.date), []).append(card)
    return {key: _fuse(own, apply_date_filter(t[key[0]], key[2], p), p) for key, own in groups.items()}


def _fuse(cards: list[Card], rows: DataFrame, p: Params) -> DataFrame:
    first = cards[0]
    if first.live:
        rows = rows.where(F.col("deleted_at").isNull())
    if all(c.rows is not None for c in cards):  # rows of no card are not read
        rows = rows.where(reduce(lambda a, b: a | b, (c.rows() for c in cards)))
    of = lambda c, x: x if c.rows is None else F.when(c.rows(), x)
    keys = sorted({k for c in cards for k in c.distinct.values()})
    level, names = [], []
    for c in cards:
        level.append(F.count(of(c, F.lit(1))).alias(_part(c, "rows")))
        level += [F.sum(of(c, x())).alias(_part(c, n)) for n, x in c.sums.items()]
        level += [F.count(of(c, F.lit(1) if x is None else x())).alias(_part(c, n)) for n, x in c.counts.items()]
        names += [_part(c, n) for n in ("rows", *c.sums, *c.counts)]
    by = period(first.date, p.effective_grain, p.anchor).alias("period")
    if not keys:
        return rows.groupBy(by).agg(*level)
    narrow = rows.groupBy(by, *[KEYS[k]().alias(f"key:{k}") for k in keys]).agg(*level)
    distinct = [F.countDistinct(F.when(F.col(f"`{_part(c, 'rows')}`") > 0, F.col(f"`key:{k}`"))).alias(_part(c, n))
                for c in cards for n, k in c.distinct.items()]
    return narrow.groupBy("period").agg(*[F.sum(f"`{n}`").alias(n) for n in names], *distinct)


def _columns(card: Card, fused: DataFrame) -> DataFrame:
    """period and the card's parts under their own names, in the card's periods."""
    parts = [*card.sums, *card.counts, *card.distinct]
    return fused.where(F.col(f"`{_part(card, 'rows')}`") > 0).select(
        "period", *[F.col(f"`{_part(card, n)}`").alias(n) for n in parts])


class FusedBoard:
    """Cards over shared scans. ``frames`` are lazy until ``store`` has written them."""

    def __init__(self, cards: Iterable[Card], t: Tables, p: Params):
        self.p = p
        self.cards = {c.name: c for c in cards if p.effective_grain in c.grains}
        self.frames = fuse(self.cards.values(), t, p)

    def store(self, root: str) -> FusedBoard:
        """Write each fused frame once under ``root`` (a new folder that the cluster shares), so that any number of cards
        read rows of periods and no facts."""
        for i, (key, frame) in enumerate(sorted(self.frames.items())):
            path = f"{root.rstrip('/')}/{key[0]}-{i}"
            frame.write.parquet(path)
            self.frames[key] = frame.sparkSession.read.schema(frame.schema).parquet(path)
        return self

    def card(self, name: str) -> DataFrame:
        """What the card's own query returns: its period column, named by the grain, and its columns, by period."""
        c = self.cards[name]
        key = {"daily": "day", "monthly": "month", "weekly": "week"}.get(self.p.effective_grain, "period")
        rows = _columns(c, self.frames[c.table, c.live, c.date])
        return rows.select(F.col("period").alias(key), *[x.alias(n) for n, x in c.columns().items()]).orderBy(key)

    def results(self) -> dict[str, DataFrame]:
        return {name: self.card(name) for name in self.cards}

    def long(self) -> DataFrame:
        """All cards as (card, period, metric, value): one plan with one scan of each table."""
        frames = []
        for key, frame in self.frames.items():
            rows = []
            for c in (c for c in self.cards.values() if (c.table, c.live, c.date) == key):
                own = {n: F.col(f"`{_part(c, n)}`") for n in (*c.sums, *c.counts, *c.distinct)}
                shown = F.struct(*[x.alias(n) for n, x in own.items()]).alias("x") if own else None
                rows.append((c, shown))
            # a card's columns are expressions over its parts, so each card gets its parts as columns of a struct
            wide = frame.select("period", *[F.when(F.col(f"`{_part(c, 'rows')}`") > 0, s).alias(c.name) for c, s in rows])
            for c, _ in rows:
                wide = _with_card(wide, c)
            frames.append(wide.select("period", F.explode(F.concat(*[F.col(c.name) for c, _ in rows])).alias("r"))
                          .select("r.card", "period", "r.metric", "r.value"))
        return reduce(lambda a, b: a.unionByName(b), frames)


def _with_card(wide: DataFrame, c: Card) -> DataFrame:
    """Replace the struct of a card's parts by its (card, metric, value) rows; none where it has no period."""
    inside = [f"{n}" for n in (*c.sums, *c.counts, *c.distinct)]
    opened = wide.select("*", *[F.col(f"`{c.name}`.`{n}`").alias(n) for n in inside])
    values = F.array(*[F.struct(F.lit(c.name).alias("card"), F.lit(n).alias("metric"), x.cast("double").alias("value"))
                       for n, x in c.columns().items()])
    empty = F.array().cast("array<struct<card:string,metric:string,value:double>>")
    rows = F.when(F.col(f"`{c.name}`").isNotNull(), values).otherwise(empty)
    return opened.withColumn("_rows", rows).drop(c.name, *inside).withColumnRenamed("_rows", c.name)
