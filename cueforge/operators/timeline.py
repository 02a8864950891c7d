"""Operators over cut lists: rebased times, captions, overlays, cut checks.

A cut list is rows of ranges (edl, rid, source, start, end), rid giving their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import CHUNK_ENDS, caption_text, srt_timestamp, strip


def offsets(ranges: DataFrame, order: list[str] | None = None) -> DataFrame:
    """ranges with offset: the summed lengths of the ranges before in the same list. Nothing is validated: a negative length counts as such."""
    before = Window.partitionBy("edl").orderBy(*(order or ["rid"])).rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("end") - F.col("start")
    return ranges.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def range_faults(ranges: DataFrame, listing: DataFrame) -> DataFrame:
    """Ranges (edl, rid, path, start, end) that can't be shown, with the reason: a file that the listing (path) lacks, then an end that isn't after the start."""
    r = ranges.join(listing.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    why = F.when(F.col("_there").isNull(), F.concat(F.lit("video not found: "), F.col("path"))).when(~F.coalesce(F.col("end") > F.col("start"), F.lit(False)), F.lit("end must be > start"))
    return r.select("edl", "rid", why.alias("reason")).where("reason is not null")


def output_length(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("edl").agg(F.sum(F.col("end") - F.col("start")).alias("length"), F.count(F.lit(1)).alias("n_ranges"))


def words_in_ranges(ranges: DataFrame, tokens: DataFrame) -> DataFrame:
    """Words of each range: equal source and half-open overlap; a word may belong to several ranges.

    Only tokens of type word with both times count. Ranges of sources without tokens have no words.
    """
    w = tokens.where("type = 'word' and start is not null and end is not null").select("source", "pos", "text", F.col("start").alias("ws"), F.col("end").alias("we"))
    return ranges.join(w, "source").where("we > start and ws < end")


def caption_chunks(ranged: DataFrame, max_words: int) -> DataFrame:
    """Chunks (edl, rid, chunk, ws, we, text, words ...) of a range's words: full at max_words, or ended by a mark."""
    keys = ["edl", "rid"]
    t = ranged.withColumn("said", strip(F.coalesce("text", F.lit("")))).where("said <> ''")
    t = t.withColumn("_ends", F.when(F.instr(F.lit(CHUNK_ENDS), F.substring("said", -1, 1)) > 0, 1).otherwise(0))
    w = Window.partitionBy(*keys).orderBy("pos")
    t = t.withColumn("_run", F.coalesce(F.sum("_ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("pos")) - 1) / max_words))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), " ")
    c = t.groupBy(*keys, "_run", "_part").agg(F.min("pos").alias("first_pos"), F.min_by("ws", "pos").alias("ws"), F.max_by("we", "pos").alias("we"), joined.alias("text"), F.count(F.lit(1)).alias("n_words"), *[F.first(c).alias(c) for c in ("source", "start", "end", "offset") if c in ranged.columns])
    return c.withColumn("chunk", F.row_number().over(Window.partitionBy(*keys).orderBy("first_pos"))).drop("_run", "_part", "first_pos")


def cues(ranges: DataFrame, tokens: DataFrame, max_words: int, uppercase: bool, least: float = 400) -> DataFrame:
    """Caption cues (edl, cue, out_start, out_end, text) on the output timeline.

    A chunk is clamped to its range and moved by the range's offset; one without length gets the least. Cues are
    numbered by start, ties by range and chunk.
    """
    c = caption_chunks(words_in_ranges(offsets(ranges), tokens), max_words)
    moved = lambda t: F.greatest(F.lit(0), t - F.col("start")) + F.col("offset")
    c = c.withColumn("out_start", moved(F.greatest("start", "ws"))).withColumn("_e", moved(F.least("end", "we")))
    c = c.withColumn("out_end", F.when(F.col("_e") <= F.col("out_start"), F.col("out_start") + least).otherwise(F.col("_e")))
    text = caption_text(F.col("text"))
    n = F.row_number().over(Window.partitionBy("edl").orderBy("out_start", "rid", "chunk"))
    return c.select("edl", n.alias("cue"), "out_start", "out_end", (F.upper(text) if uppercase else text).alias("text"))


def srt_lines(cued: DataFrame, per_ms: int = 1) -> DataFrame:
    """Lines (edl, cue, line, text) of a subtitle file: number, times, text, blank."""
    at = lambda c: srt_timestamp(F.rint(F.col(c) * per_ms))
    lines = F.array(F.col("cue").cast("string"), F.concat(at("out_start"), F.lit(" --> "), at("out_end")), F.col("text"), F.lit(""))
    return cued.select("edl", "cue", F.posexplode(lines).alias("line", "text"))


def overlays_at(overlays: DataFrame, times: DataFrame) -> DataFrame:
    """Per time (edl, t): n_active overlays (edl, idx, start, duration) that cover it, both ends included, and the top one, the last in order."""
    hit = times.join(overlays, "edl").where((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("start") + F.col("duration")))
    return hit.groupBy("edl", "t").agg(F.count(F.lit(1)).alias("n_active"), F.max("idx").alias("top"))


def cuts_inside_words(ranges: DataFrame, tokens: DataFrame) -> DataFrame:
    """Range edges that lie strictly inside a word: (edl, rid, edge, at, pos)."""
    edges = ranges.select("edl", "rid", "source", F.inline(F.array(F.struct(F.lit("start").alias("edge"), F.col("start").alias("at")), F.struct(F.lit("end").alias("edge"), F.col("end").alias("at")))))
    w = tokens.where("type = 'word'").select("source", "pos", F.col("start").alias("ws"), F.col("end").alias("we"))
    return edges.join(w, "source").where("at > ws and at < we").select("edl", "rid", "edge", "at", "pos")


def cut_padding(ranges: DataFrame, tokens: DataFrame, low: float = 30, high: float = 200) -> DataFrame:
    """Per range with words: the room between its edges and its first and last word, and whether both are within bounds."""
    w = words_in_ranges(ranges, tokens).groupBy("edl", "rid", "start", "end").agg(F.min("ws").alias("first"), F.max("we").alias("last"))
    head, tail = F.col("first") - F.col("start"), F.col("end") - F.col("last")
    return w.select("edl", "rid", head.alias("head"), tail.alias("tail"), (head.between(low, high) & tail.between(low, high)).alias("padded"))


def over_budget(ranges: DataFrame, budgets: DataFrame) -> DataFrame:
    """Planned length against a budget (edl, budget): (edl, length, budget, over)."""
    return output_length(ranges).join(budgets, "edl").select("edl", "length", "budget", (F.col("length") > F.col("budget")).alias("over"))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no result yet: existence counts, not content."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def ease_out_cubic(t: Column) -> Column:
    return 1 - F.pow(1 - t, F.lit(3))


def ease_in_out_cubic(t: Column) -> Column:
    return F.when(t < 0.5, 4 * t * t * t).otherwise(1 - F.pow(-2 * t + 2, F.lit(3)) / 2)
