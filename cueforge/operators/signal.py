"""Operators over samples and frame statistics: envelopes, peaks, grading decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import fixed


def envelope(clips: DataFrame, samples: int) -> DataFrame:
    """Root mean square per bucket, normalised by the clip's largest: (clip, bucket, rms) with exactly `samples` buckets.

    clips has (clip, pcm array<double>). A bucket is n div samples values, at least one; what is left over is
    dropped, missing buckets are 0. The largest is taken after that.
    """
    w = F.greatest(F.lit(1), F.floor(F.size("pcm") / samples)).cast("int")
    c = clips.select("clip", F.coalesce("pcm", F.array().cast("array<double>")).alias("pcm")).withColumn("w", w)
    n = F.floor(F.size("pcm") / F.col("w"))
    bucket = lambda i: F.when(i < n, F.sqrt(F.aggregate(F.slice("pcm", i * F.col("w") + 1, F.col("w")), F.lit(0.0), lambda a, x: a + x * x) / F.col("w"))).otherwise(F.lit(0.0))
    c = c.select("clip", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), bucket).alias("env")).withColumn("top", F.array_max("env"))
    return c.select("clip", "top", F.posexplode("env").alias("bucket", "v")).select("clip", "bucket", F.when(F.col("top") > 0, F.col("v") / F.col("top")).otherwise(F.col("v")).alias("rms"))


def peak_dbfs(frames: DataFrame) -> DataFrame:
    """Peak level per clip of 16-bit samples (clip, sample): (clip, peak, dbfs); silence is minus infinity."""
    s = F.col("sample").cast("int")
    p = frames.groupBy("clip").agg(F.greatest(F.max(s), -F.min(s)).alias("peak"))
    return p.select("clip", "peak", F.when(F.col("peak") > 0, 20 * F.log10(F.col("peak") / 32768.0)).otherwise(F.lit(float("-inf"))).alias("dbfs"))


def silent_tracks(peaks: DataFrame, floor: float = -60.0) -> DataFrame:
    """Tracks (clip, track, dbfs) below the floor, with the other tracks of the clip that aren't."""
    heard = peaks.where(F.col("dbfs") >= floor).groupBy("clip").agg(F.array_sort(F.collect_list("track")).alias("others"))
    return peaks.where(F.col("dbfs") < floor).join(heard, "clip", "left").select("clip", "track", F.coalesce(F.array_join("others", ","), F.lit("")).alias("others"))


# Neutral findings, and the bounds and steps of the automatic grade.
NEUTRAL_Y, NEUTRAL_RANGE, NEUTRAL_SAT, NO_RANGE, DEPTH = 0.5, 0.72, 0.25, 0.7, 8
CONTRAST = {"flat": 0.65, "from": 0.50, "width": 0.15, "most": 1.08, "drop": 0.05, "plain": 1.03, "low": 0.94, "high": 1.08}
GAMMA = {"dark": 0.42, "from": 0.30, "width": 0.12, "most": 1.10, "drop": 0.08, "bright": 0.60, "bright_gamma": 0.97, "low": 0.94, "high": 1.10}
SATURATION = {"dull": 0.18, "dull_value": 1.04, "rich": 0.38, "rich_value": 0.96, "plain": 0.98, "low": 0.94, "high": 1.06}
LEAST_STEP = 0.005


def _scaled(grouped: DataFrame) -> DataFrame:
    """Means (clip, y, lo, hi, s, depth) on a scale of 1. Without luma all three take neutral values; without a range or saturation that one does."""
    top = F.pow(F.lit(2.0), F.coalesce("depth", F.lit(DEPTH))) - 1
    none = F.col("y").isNull()
    return grouped.select("clip", F.when(none, NEUTRAL_Y).otherwise(F.col("y") / top).alias("y_mean"), F.when(none, NEUTRAL_RANGE).otherwise(F.coalesce((F.col("hi") - F.col("lo")) / top, F.lit(NO_RANGE))).alias("y_range"), F.when(none, NEUTRAL_SAT).otherwise(F.coalesce(F.col("s") / top, F.lit(NEUTRAL_SAT))).alias("sat_mean"))


def clip_stats(frames: DataFrame) -> DataFrame:
    """Means of frame statistics (clip, frame, depth, yavg, ymin, ymax, satavg) on a scale of 1: (clip, y_mean, y_range, sat_mean). The last known depth counts for all frames; without a frame column, the largest."""
    order = F.col("frame" if "frame" in frames.columns else "depth")
    last = F.max_by("depth", F.when(F.col("depth").isNotNull(), order))
    return _scaled(frames.groupBy("clip").agg(F.avg("yavg").alias("y"), F.avg("ymin").alias("lo"), F.avg("ymax").alias("hi"), F.avg("satavg").alias("s"), last.alias("depth")))


def line_stats(values: DataFrame) -> DataFrame:
    """The same of parsed statistics lines (clip, line_no, key, value), each series by itself; depths are whole numbers, the last one counts."""
    mean = lambda key: F.avg(F.when(F.col("key") == key, F.col("value")))
    is_depth = F.col("key") == "YBITDEPTH"
    last = F.max_by(F.when(is_depth, F.col("value").cast("int")), F.when(is_depth, F.col("line_no")))
    return _scaled(values.groupBy("clip").agg(mean("YAVG").alias("y"), mean("YMIN").alias("lo"), mean("YMAX").alias("hi"), mean("SATAVG").alias("s"), last.alias("depth")))


def sample_rate(n: Column, duration: Column) -> Column:
    """Frames a second to look at n frames of a clip, within 0.5 and 10."""
    return F.greatest(F.lit(0.5), F.least(n / F.greatest(duration, F.lit(0.1)), F.lit(10.0)))


def auto_grade(stats: DataFrame) -> DataFrame:
    """A correction per clip of (clip, y_mean, y_range, sat_mean): contrast, gamma, saturation and the filter that applies them.

    Flat clips get contrast, dark ones gamma, dull ones saturation; values within 0.005 of 1 are left out.
    """
    share = lambda c, k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - k["from"]) / k["width"]))
    within = lambda x, k: F.greatest(F.lit(k["low"]), F.least(F.lit(k["high"]), x))
    c, g, t = CONTRAST, GAMMA, SATURATION
    s = stats.withColumns({
        "contrast": within(F.when(F.col("y_range") < c["flat"], c["most"] - c["drop"] * share("y_range", c)).otherwise(c["plain"]), c),
        "gamma": within(F.when(F.col("y_mean") < g["dark"], g["most"] - g["drop"] * share("y_mean", g)).when(F.col("y_mean") > g["bright"], g["bright_gamma"]).otherwise(1.0), g),
        "saturation": within(F.when(F.col("sat_mean") < t["dull"], t["dull_value"]).when(F.col("sat_mean") > t["rich"], t["rich_value"]).otherwise(t["plain"]), t),
    })
    term = lambda c: F.when(F.abs(F.col(c) - 1) > LEAST_STEP, F.concat(F.lit(f"{c}="), fixed(F.col(c), 3)))
    terms = F.concat_ws(":", term("contrast"), term("gamma"), term("saturation"))
    return s.withColumn("filter", F.when(terms == "", F.lit("")).otherwise(F.concat(F.lit("eq="), terms)))
