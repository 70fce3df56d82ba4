"""Mixing of sources to target weights by repetition rates and hash-seeded copies, drawn evenly over each source's sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD_PATTERN, by_place, only
from tidewatch.llm.ordering import ROW_BITS, in_order, ranges
from tidewatch.runtime import materialize

WEIGHTS = (3, 1, 2)
EPOCHS = 1.5
MOST = 2


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Columns source, source_size, weight. Sources are numbered by code point, null last, without one task that sees
    them all: sorted ranges are counted, then numbered from the sum of the counts before them."""
    spark = sizes.sparkSession
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranged = in_order(totals, F.col("source").asc_nulls_last())
    offsets, total = [], 0
    for number, n in ranges(ranged):
        offsets.append((number, total))
        total += n
    starts = spark.createDataFrame(offsets, "part long, start long")
    part = F.shiftright("at", ROW_BITS)
    index = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (index % len(weights) + 1).cast("int"))
    return (ranged.withColumn("part", part).join(starts, "part")
            .select("source", "source_size", weight.cast("double").alias("weight")))


def targets(sources: DataFrame, epochs: float = EPOCHS, most: int = MOST) -> DataFrame:
    """Adds target: `epochs` times all sizes, shared by weight, at most `most` times a source's size. The level (words per
    weight) rises until no further source is above its ceiling; each round is one aggregate of two numbers."""
    sources = materialize(sources, "weights")
    ceiling = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level >= ceiling
        row = sources.agg(F.sum(F.when(above, ceiling)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("open"),
                          F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == full or not row["open"]:
            break
        full, level = row["n"], (epochs * total - (row["held"] or 0)) / row["open"]
    return sources.withColumn("target", F.least(ceiling.cast("double"), F.col("weight") * level)
                              if row["open"] else ceiling.cast("double"))


def draw_of(key: Column, seed: int) -> Column:
    """60 bits of a hash of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 15), 16, 10).cast("long")


def _drawn(sizes: DataFrame, seed: int) -> DataFrame:
    """Adds size_class (about a quarter of a doubling, rising with size) and draw. Rows of one id draw alike, rows without
    an id by their text."""
    bits = F.length(F.bin("size"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return sizes.withColumns({"size_class": (bits * 8 + F.call_function("shiftright", F.col("size") * 8, bits)).cast("int"),
                              "draw": draw_of(key, seed)})


def cutoffs(sizes: DataFrame, goals: DataFrame, seed: int = 7) -> DataFrame:
    """Columns goal_source, source_size, target, rate, goal_class, cut: a document of the source and size class gets one
    copy more than floor(rate) if its draw is at most `cut` (null: none does).

    Every document has the fraction of the rate as its probability. The draws of a source are spread evenly over its size
    classes: with C documents up to a class and one seeded number u of the source, floor(C * fraction + u) of them get the
    copy, those with the smallest draws of each class. So what a source takes departs from its target by about one
    document, not by the spread of independent draws. Ranks of draws come from counted sorted ranges, so neither a hot
    source nor a hot class meets one task.
    """
    ranged = in_order(sizes.select("source", "size_class", "draw"), F.col("source").asc_nulls_last(), F.col("size_class"), F.col("draw"))
    part = F.shiftright("at", ROW_BITS)
    held = materialize(ranged.groupBy("source", "size_class", part.alias("part")).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")), "draws")
    # One row for each class and source, one more for each range: small whatever the number of documents.
    class_before = Window.partitionBy("source", "size_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    classes = held.groupBy("source", "size_class").agg(F.sum("n").alias("n"))
    up_to = Window.partitionBy("source").orderBy("size_class").rowsBetween(Window.unboundedPreceding, 0)
    fraction = F.col("rate") - F.floor("rate")
    u = draw_of(F.coalesce("source", F.lit("")), seed).cast("double") / float(1 << 60)
    c = F.sum("n").over(up_to)
    wanted = (classes.withColumn("c", c).join(goals, F.col("source").eqNullSafe(F.col("goal_source")))
              .withColumn("wanted", (F.floor(F.col("c") * fraction + u) - F.floor((F.col("c") - F.col("n")) * fraction + u)).cast("long"))
              .select("goal_source", "source_size", "target", "rate", F.col("size_class").alias("goal_class"), "wanted"))
    before = held.withColumn("before", F.coalesce(F.sum("n").over(class_before), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("goal_source")) & (F.col("size_class") == F.col("goal_class"))
    inside = (F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("n"))
    at = materialize(before.join(wanted, same & inside).select(
        "goal_source", "goal_class", (F.col("first_at") + F.col("wanted") - F.col("before") - 1).alias("at")), "cuts")
    cut = ranged.join(at, "at").select(F.col("goal_source").alias("cut_source"), F.col("goal_class").alias("cut_class"), F.col("draw").alias("cut"))
    found = wanted.join(cut, F.col("goal_source").eqNullSafe(F.col("cut_source")) & (F.col("goal_class") == F.col("cut_class")), "left")
    return materialize(found.select("goal_source", "source_size", "target", "rate", "goal_class", "cut"), "cutoffs")


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: int = MOST) -> DataFrame:
    """Columns goal_source, source_size, target, rate for each source of `sizes` (source, size). Written once, so its
    size is known: the optimizer broadcasts it only below its threshold."""
    goals = targets(source_weights(sizes, weights), epochs, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return materialize(goals.select(F.col("source").alias("goal_source"), "source_size", "target", rate.alias("rate")), "rates")


def _copies() -> Column:
    return (F.floor("rate") + F.when(F.col("draw") <= F.col("cut"), 1).otherwise(0)).cast("int")


def _sized(documents: DataFrame, seed: int) -> DataFrame:
    typed = only(documents, "doc_id", "source", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return materialize(_drawn(typed.withColumn("size", size_of(F.col("text"))), seed).drop("text"), "sizes")


def _same_class() -> Column:
    return F.col("source").eqNullSafe(F.col("goal_source")) & (F.col("size_class") == F.col("goal_class"))


def plan_mix(documents: DataFrame, seed: int = 7, **settings) -> DataFrame:
    """Columns doc_id, source, size, source_size, target, rate, copies: one row for every row of `documents`.

    Size is the number of words (null text: 0). Rows of one id, source and size class draw alike, so repeated rows get
    equal copies; rows without an id draw by their text. A source without words has target and rate 0. Null is a source of
    its own, the last one. Extra columns are ignored; an empty table gives an empty result.
    """
    sizes = _sized(documents, seed)
    goals = cutoffs(sizes, rates(sizes, **settings), seed)
    return (sizes.join(goals, _same_class(), "left").withColumn("copies", _copies())
            .select("doc_id", "source", "size", "source_size", "target", "rate", "copies"))


def mix(documents: DataFrame, seed: int = 7, **settings) -> DataFrame:
    """The documents as the mix takes them: each row as many times as planned, with all its own columns."""
    sizes = _sized(documents, seed)
    goals = cutoffs(sizes, rates(sizes, **settings), seed).select("goal_source", "goal_class", "rate", "cut")
    placed, [doc, source, text] = by_place(documents, "doc_id", "source", "text")
    typed = placed.withColumns({"doc_id": F.col(doc).cast("long"), "source": F.col(source).cast("string"), "text": F.col(text).cast("string")})
    drawn = _drawn(typed.withColumn("size", size_of(F.col("text"))), seed)
    joined = drawn.join(goals, _same_class()).withColumn("copies", _copies()).where("copies > 0")
    return (joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*placed.columns).toDF(*documents.columns))
