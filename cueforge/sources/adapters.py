"""The engine's entities from the driver's tables, in whole milliseconds, so that both engines compute alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of text that a task takes: some 180,000 words, of which each sort of a chain of windows holds a row.
TASK_BYTES = 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str, variant: str = "plain") -> DataFrame:
    """Words of conversations on a made timeline, by conv_id. The variant "sparse" has null speakers and events.

    Turns are dealt by source before they become words, to tasks whose number follows the bytes of text: windows by
    source need no other exchange, and what one task sorts stays the same as the table grows.
    """
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), "turn", "role", "text")
    size = t.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = min(spark.sparkContext.defaultParallelism, 8 * size // TASK_BYTES)  # small tables use all cores
    c = t.repartition(max(few, size // TASK_BYTES) + 1, "source").select("source", "turn", "role", F.posexplode(F.split("text", r"[ \n]+")).alias("i", "text")).where("text <> ''")
    by_turn = Window.partitionBy("source").orderBy("turn", "i")
    pos = F.col("pos")
    c = c.withColumn("pos", F.row_number().over(by_turn))
    at = pos.cast("long")  # a source may have words enough for products beyond 32 bits
    gap = F.when((at * 7919 + F.col("source") * 104729) % 11 == 0, 700).when((at * 31 + F.col("source")) % 5 == 0, 500).otherwise(80)
    c = c.withColumn("dur", 60 * F.length("text") + 40)
    end = F.sum(F.col("dur") + gap).over(Window.partitionBy("source").orderBy("turn", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sparse = variant == "sparse"
    kind = F.when(pos % 13 == 0, "audio_event").otherwise("word") if sparse else F.lit("word")
    speaker = F.when(pos % 7 != 0, F.col("role")) if sparse else F.col("role")
    return c.withColumn("end", end).select("source", "pos", kind.alias("type"), "text", (F.col("end") - F.col("dur")).alias("start"), "end", speaker.alias("speaker"))


def ranges(toks: DataFrame) -> DataFrame:
    """Three cuts per source, as a list of its own: they fall inside words."""
    mx = toks.groupBy("source").agg(F.max("end").alias("mx"))
    r = mx.select("source", "mx", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("rid"))
    at = lambda k: F.floor((3 * F.col("rid") + k) * F.col("mx") / 10)
    return r.select(F.col("source").alias("edl"), "rid", "source", at(0).alias("start"), at(2).alias("end"))


def views(toks: DataFrame) -> DataFrame:
    """The middle half of each source."""
    mx = F.max("end")
    return toks.groupBy("source").agg(F.floor(mx / 4).alias("lo"), F.floor(3 * mx / 4).alias("hi"))


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("edl"), F.col("event_id").alias("idx"), ((F.col("event_id") * 7919) % 60000).alias("start"), F.floor(F.col("value") * 10).alias("duration"))


def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames per user whose means reach every grading rule; levels are on the clip's own scale."""
    u, top = F.col("user_id"), F.when(F.col("user_id") % 2 == 0, 255.0).otherwise(1023.0)
    depth = F.when(u % 2 == 0, 8).otherwise(10)
    level = lambda base, step, m: (base + step * (u % m)) * top
    mid, span = level(0.25, 0.005, 90), level(0.45, 0.004, 80)
    return table(spark, sf_dir, "events").select(u.alias("clip"), F.col("event_id").alias("frame"), depth.alias("depth"), mid.alias("yavg"), (mid - span / 2).alias("ymin"), (mid + span / 2).alias("ymax"), level(0.10, 0.004, 90).alias("satavg"))


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip"), F.col("embedding").cast("array<double>").alias("pcm"))


def stream_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, width, height, rotation, transfer, avg_rate, nominal_rate) made of part."""
    k = F.col("p_partkey")
    rates = F.element_at(F.array(*[F.lit(x) for x in ("30000/1001", "0/0", "25", "60/1", "29.97", "24000/1001", "junk")]), (k % 7 + 1).cast("int"))
    transfer = F.when(F.col("p_type").startswith("PROMO"), "smpte2084").when(F.col("p_type").startswith("ECONOMY"), "arib-std-b67").otherwise("bt709")
    return table(spark, sf_dir, "part").select(k.alias("clip"), F.lit(120).alias("width"), (F.lit(100) + F.col("p_size")).alias("height"), ((k % 4) * 90 - 180).cast("double").alias("rotation"), transfer.alias("transfer"), rates.alias("avg_rate"), F.when(k % 3 == 0, "50/2").otherwise("0/0").alias("nominal_rate"))
