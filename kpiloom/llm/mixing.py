"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents lie in key order, and a
distributed prefix sum of their sizes says where the source's budget ends: budget div size whole
epochs, then the documents before the cut, then a part of the one that the cut goes through.

The key is uniform, so its leading bits are equal ranges of the order. Prefix sums have two levels:
over the ranges of a source, and inside a range. With about sqrt(rows) ranges both hold about
sqrt(rows) rows a group, whatever share of the rows one source has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpiloom.llm.shared import materialize, row_digest, run_folder

#: Weights by the source's rank, repeating, and the limits of the mix.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; 0 for null."""
    blanked = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blanked, " "), lambda w: w != "")).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """32 uniform bits from the id and the seed, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))),
                              1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, folder: str, share: float, most: float,
                   weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size) -> source, source_size, target.

    The weights go round by code point order of the sources, null last: a distributed rank (range
    sort, then an offset for each range). Targets start as the weighted shares; a source above
    ``most`` times its size stops there and the rest is shared anew, until none is above. Each round
    is one aggregate over the sources and only two sums reach the driver."""
    spark = sizes.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    ranged = materialize(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()),
                         f"{folder}/sources")
    starts = (ranged.groupBy("part").agg(F.count("*").alias("n"))
              .withColumn("start", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = materialize(ranged.join(starts, "part").select(
        "source", "source_size", weight.cast("long").alias("weight")), f"{folder}/weights")

    cap = F.col("source_size") * most
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * level
        n, held, left = ranked.agg(F.count(F.when(full, 1)), F.sum(F.when(full, cap)),
                                   F.sum(F.when(~full, F.col("weight")))).first()
        if not left:
            level = math.inf
        if n == stopped or not left:
            break
        stopped, level = n, max(level, (total - (held or 0.0)) / left)
    target = F.least(cap, F.col("weight") * F.lit(float(level)))
    return ranked.select("source", F.col("source_size"), target.cast("double").alias("target"))


def mix(docs: DataFrame, *, size: Column | None = None, seed: str = "mix-1", share: float = SHARE,
        most_epochs: int = MOST_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source; other columns are ignored): doc_id, source,
    size, source_size, target (its source's), taken (words that the mix takes, repeats counted).

    ``size``: a document's size as a column, by default its words. Every source takes exactly
    floor(target) words; no document more than ``most_epochs`` times its size. Null text and empty
    text have size 0 and take 0. A null source is a source of its own, last in rank; a null doc_id
    is a value like any other. Repeated rows count as documents of their own; rows alike in id,
    source and size are kept as one row with a count until their prefix sums are known, so they
    cannot fill a group. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "mix")
    keyed = materialize(
        docs.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).alias("size"))
        .groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
        .withColumn("key", random_key(F.col("doc_id"), seed)), f"{folder}/sizes")
    words = F.col("size") * F.col("copies")
    sizes = keyed.groupBy("source").agg(F.sum(words).alias("source_size"))
    targets = source_targets(sizes, folder, share, most_epochs, weights)

    ranges = max(1, math.isqrt(keyed.count()))
    keyed = keyed.withColumn("range", F.shiftright(F.col("key") * ranges, 32))
    outer = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (keyed.groupBy("source", "range").agg(F.sum(words).alias("words"))
               .select(F.col("source").alias("s"), F.col("range").alias("r"),
                       F.coalesce(F.sum("words").over(outer), F.lit(0)).alias("before_range"))
               .join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source"))
    inner = (Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
             .rowsBetween(Window.unboundedPreceding, -1))
    placed = (keyed.withColumn("inside", F.coalesce(F.sum(words).over(inner), F.lit(0)))
              .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 10000"))))
              .withColumn("copy", F.explode(F.sequence(F.col("block") * 10_000, F.least(
                  F.col("copies") - 1, F.col("block") * 10_000 + 9_999)))))  # no array grows with the copies
    epochs = F.expr("floor(target) div greatest(source_size, 1L)")
    rest = F.floor("target") - epochs * F.col("source_size")
    before = F.col("before_range") + F.col("inside") + F.col("copy") * F.col("size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed documents, with the columns of ``docs`` (doc_id, text, source, n_chars, ...) whatever their names: a row
    for each whole epoch, and for the document that the cut goes through its first words. ``n_chars``, if there, is that
    of the new text.

    ``mixed`` is what ``mix`` returns for ``docs``. Rows alike in id, source and size share their takes: the largest go
    to the rows of smallest digest. Null and empty texts have size 0 and are not taken; null ids and sources are values
    like any other; repeated rows take what is due to each. An empty table, or a mix that takes nothing, gives no rows.

    Takes are dealt out over digests and counts of equal rows; texts are joined to them at the end, once for each group
    of equal rows."""
    folder = run_folder(docs.sparkSession, "applied")
    key = F.sha1(F.to_json(F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("n"))))
    # what stands beside the user's columns is in two structs, so no name can clash
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_digest(docs).alias("row"))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_digest(docs).alias("row")).filter("size > 0")
    equal = sized.select(key.alias("key"), "size", "row").groupBy("key", "size", "row").agg(F.count("*").alias("copies"))
    takes = mixed.filter("taken > 0").select(key.alias("key"), "taken").groupBy("key", "taken").agg(F.count("*").alias("copies"))
    before = lambda *order: F.coalesce(F.sum("copies").over(
        Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # equal rows, and takes of one size, are stretches of the rows alike; a stretch of each meets where they overlap
    left = equal.withColumn("a", before("row")).withColumn("b", F.col("a") + F.col("copies")).drop("copies")
    right = takes.withColumn("c", before(F.col("taken").desc())).withColumn("d", F.col("c") + F.col("copies")).drop("copies")
    met = left.join(right, "key").withColumn("n", F.least("b", "d") - F.greatest("a", "c")).filter("n > 0")
    whole, part = F.expr("taken div size"), F.col("taken") % F.col("size")
    dealt = met.select("row", F.explode(F.array(F.struct((F.col("n") * whole).alias("n"), F.lit(0).cast("long").alias("cut")),
                                                F.struct(F.when(part > 0, F.col("n")).otherwise(0).alias("n"), part.alias("cut")))).alias("x"))
    dealt = materialize(dealt.select("row", "x.n", "x.cut").filter("n > 0").groupBy("row", "cut").agg(F.sum("n").alias("n")), f"{folder}/takes")
    # one of the equal rows, and it as often as it is taken, in blocks so that no array grows with that
    one = held.join(dealt.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    block = 10_000
    rows = (one.join(dealt, "row").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))))
            .withColumn("copy", F.explode(F.sequence(F.col("block") * block, F.least(F.col("n") - 1, F.col("block") * block + block - 1)))))
    # the first words with the white space before each
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)),
                               1, F.col("cut").cast("int")), "")
    out = rows.select("doc", F.when(F.col("cut") == 0, F.col("doc.text")).otherwise(cut).alias("words"))
    new = {"text": F.col("words")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("words").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
