"""Mixing sources to target weights by capped water-filling.

Targets share the corpus by weight, but none exceeds max_epochs times its source; the excess is shared again by
weight until none does. The fixed point has a closed form: order sources by capacity per unit of weight, and the
capped ones are a prefix of that order. Only one row per source goes through that order, never a document.

A source's documents are then repeated whole, floor(target / size) times each, and a seeded part of them once
more: each document has a place on a circle by a seeded hash, and those in an arc of the wanted length are taken.
Where the arc starts is chosen per source, among OFFSETS places, so that the words come nearest to the target.
Nothing is sorted or gathered by source: all of it is sums that Spark combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, small_side

OFFSETS = 128
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """sources (source, source_size, weight) with target double.

    Without any size all targets are 0. The windows are over one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda c: F.sum(c).over(order) - F.col(c)
    s = sources.withColumns({"_left": F.sum("source_size").over(everything) - max_epochs * before("source_size"), "_w": F.sum("weight").over(everything) - before("weight")})
    s = s.withColumn("_capped", F.col("_left") * F.col("weight") >= max_epochs * F.col("source_size") * F.col("_w"))
    capped = lambda c: F.sum(F.when(F.col("_capped"), F.col(c)).otherwise(0)).over(everything)
    s = s.withColumns({"_free": F.sum("source_size").over(everything) - max_epochs * capped("source_size"), "_fw": F.sum("weight").over(everything) - capped("weight")})
    share = (F.col("_free") * F.col("weight")).cast("double") / F.col("_fw")
    return s.select("source", "source_size", "weight", F.when(F.col("_capped"), (max_epochs * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def cycle_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, source_size) with weights in turn by code point, null last."""
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (n % len(weights) + 1).cast("int")).cast("long"))


def _place(seed: int) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def _in_arc(offset: Column) -> Column:
    at = F.col("_u") + offset
    return (at - F.floor(at) < F.col("_f")).cast("long")


def _joined(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with their source's row of goals, whose columns start with _goal."""
    return rows.join(small_side(goals), F.col("source").eqNullSafe(F.col("_goal_source"))).drop("_goal_source")


def plan(rows: DataFrame, scratch: Scratch, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """Per source of rows (source, size, _u): _goal_source, _goal_size, _goal_target, _r, _f and _offset, stored."""
    goals = water_fill(cycle_weights(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights), max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = scratch.save(goals.select(F.col("source").alias("_goal_source"), F.col("source_size").alias("_goal_size"), F.col("target").alias("_goal_target"), ratio.alias("_r")).withColumn("_f", F.col("_r") - F.floor("_r")), "targets")
    sums = _joined(rows, goals).groupBy("source").agg(F.first("_f").alias("_f1"), F.first("_goal_size").alias("_all"), *[F.sum(F.col("size") * _in_arc(F.lit(i / OFFSETS))).alias(f"_o{i}") for i in range(OFFSETS)])
    misses = F.array(*[F.struct(F.abs(F.col(f"_o{i}") - F.col("_all") * F.col("_f1")).alias("miss"), F.lit(i).alias("i")) for i in range(OFFSETS)])
    best = sums.select(F.col("source").alias("_s3"), (F.array_min(misses)["i"] / OFFSETS).alias("_offset"))
    return scratch.save(goals.join(best, F.col("_goal_source").eqNullSafe(F.col("_s3"))).drop("_s3"), "plan")


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 7, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row per row of docs: doc_id, source, size, source_size, target, times, taken.

    size is the number of words (null text: 0); times is how often the mix repeats the document, taken the words
    that makes. A null source is a source of its own. Equal seeds give equal results; rows repeated under one
    doc_id are taken together.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), _place(seed).alias("_u")), "sizes")
    out = _joined(rows, plan(rows, scratch, max_epochs, weights)).withColumn("times", (F.floor("_r") + _in_arc(F.col("_offset"))).cast("long"))
    return out.select("doc_id", "source", "size", F.col("_goal_size").alias("source_size"), F.col("_goal_target").alias("target"), "times", (F.col("times") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, max_epochs: int = 3, seed: int = 7, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs with each row as often as mix() takes it, all columns kept; rows it takes no time are left out."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(docs.select("source", word_count(F.col("text")).alias("size"), _place(seed).alias("_u")), "sizes")
    whole = docs.select("source", _place(seed).alias("_u"), F.struct(*docs.columns).alias("_row"))
    times = (F.floor("_r") + _in_arc(F.col("_offset"))).cast("int")
    out = _joined(whole, plan(rows, scratch, max_epochs, weights)).withColumn("_times", times).where("_times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_row.*")
