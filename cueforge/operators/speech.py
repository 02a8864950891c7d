"""Operators over timed tokens: phrases, gaps, silences, labels.

Tokens are rows (source, pos, type, text, start, end, speaker); pos is their order. Times may be of any numeric
unit, thresholds are in the same unit. All windows of a step share the partitioning by source, so that a chain of
them costs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import close_marks, fixed, format_duration, format_time, speaker_tag, token_text


def _kind() -> Column:
    return F.coalesce(F.col("type"), F.lit("word"))


def phrases(tokens: DataFrame, threshold: float, silent: bool = False) -> DataFrame:
    """Phrases (source, phrase, start, end, text, speaker): breaks at gaps of threshold or more and at speaker changes.

    A speaker only changes against the phrase's first token, and null never counts as a change. A spacing token
    of threshold or more breaks too. The end is the last token's, not the latest. Blank phrases are left out, but
    their tokens still count as previous ends. phrase numbers the rest per source from 1.
    With silent, a source whose tokens (with a start, other than spacing) make blank phrases only has one row of nulls.
    """
    by_pos = Window.partitionBy("source").orderBy("pos")
    far = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = tokens.withColumn("_k", _kind())
    t = t.withColumn("_sp", F.sum(F.when((F.col("_k") == "spacing") & (F.col("end") - F.col("start") >= threshold), 1).otherwise(0)).over(far))
    t = t.where((F.col("_k") != "spacing") & F.col("start").isNotNull()).withColumn("_end", F.coalesce("end", "start"))
    gap = (F.col("start") - F.lag("_end").over(by_pos) >= threshold) | (F.col("_sp") != F.lag("_sp").over(by_pos))
    t = t.withColumn("_island", F.sum(F.when(gap, 1).otherwise(0)).over(far))
    within = Window.partitionBy("source", "_island").orderBy("pos")
    lead = F.first("speaker").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.last("speaker", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    turn = lead.isNotNull() & F.col("speaker").isNotNull() & before.isNotNull() & (F.col("speaker") != before)
    t = t.withColumn("_turn", F.when(turn, 1).otherwise(0))
    t = t.withColumn("_part", F.sum("_turn").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    said = token_text(F.col("_k"), F.col("text"))
    words = F.transform(F.array_sort(F.collect_list(F.when(F.col("_said").isNotNull(), F.struct("pos", "_said")))), lambda x: x["_said"])
    p = t.withColumn("_said", said).groupBy("source", "_island", "_part").agg(
        F.min("pos").alias("first_pos"), F.min_by("start", "pos").alias("start"), F.max_by("_end", "pos").alias("end"),
        close_marks(F.array_join(words, " ")).alias("text"), F.min_by(F.struct("speaker"), "pos")["speaker"].alias("speaker"),
    )
    if not silent:
        return p.where("text <> ''").select("source", F.row_number().over(Window.partitionBy("source").orderBy("first_pos")).alias("phrase"), "start", "end", "text", "speaker")
    heard = F.col("text") != ""
    p = p.withColumn("phrase", F.row_number().over(Window.partitionBy("source").orderBy(heard.desc(), "first_pos")))
    return p.where(heard | (F.col("phrase") == 1)).select("source", *[F.when(heard, F.col(c)).alias(c) for c in ("phrase", "start", "end", "text", "speaker")])


def takes(phrased: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Per source of sources: n_phrases and duration (last end less first start, 0 without phrases).

    Without sources, per source of phrased: its silent ones may be there as rows of nulls.
    """
    t = phrased.groupBy("source").agg(F.count("phrase").alias("n_phrases"), (F.max_by("end", "phrase") - F.min_by("start", "phrase")).alias("duration"))
    return (t if sources is None else sources.join(t, "source", "left")).fillna({"n_phrases": 0, "duration": 0})


def packed_lines(phrased: DataFrame, sources: DataFrame | None = None, per_second: int = 1000) -> DataFrame:
    """Lines (source, line, text) of the packed transcript per source: heading, phrases or a remark, blank line.

    Without sources, those of phrased: its silent ones may be there as rows of nulls, and nothing is dealt out for a join.
    """
    every = Window.partitionBy("source")
    first, last = F.min_by("start", "phrase").over(every), F.max_by("end", "phrase").over(every)
    rows = phrased if sources is None else sources.select("source").join(phrased, "source", "left")
    rows = rows.withColumns({"_n": F.count("phrase").over(every), "_d": F.coalesce((last - first) / per_second, F.lit(0.0))})
    line = lambda n, text: F.struct(n.cast("int").alias("line"), text.alias("text"))
    head = line(F.lit(0), F.concat(F.lit("## "), F.col("source").cast("string"), F.lit("  (duration: "), format_duration(F.col("_d")), F.lit(", "), F.col("_n").cast("string"), F.lit(" phrases)")))
    said = F.concat(F.lit("  ["), format_time(F.col("start") / per_second), F.lit("-"), format_time(F.col("end") / per_second), F.lit("]"), speaker_tag(F.col("speaker")), F.lit(" "), F.col("text"))
    body = line(F.greatest(F.coalesce("phrase", F.lit(1)), F.lit(1)), F.coalesce(said, F.lit("  _no speech detected_")))
    lone = F.col("phrase").isNull()
    lines = F.array(F.when(lone | (F.col("phrase") == 1), head), body, F.when(lone | (F.col("phrase") == F.col("_n")), line(F.greatest(F.col("_n"), F.lit(1)) + 1, F.lit(""))))
    return rows.select("source", F.inline(F.array_compact(lines)))


def with_spacing(words: DataFrame) -> DataFrame:
    """Words with a spacing token before each that starts after the previous one's end; pos is renumbered.

    Words without times or text are dropped first, so that a gap spans them.
    """
    w = Window.partitionBy("source").orderBy("pos")
    kept = words.where(F.col("start").isNotNull() & F.col("end").isNotNull() & token_text(F.lit("word"), F.col("text")).isNotNull())
    prev = kept.withColumn("_prev", F.lag("end").over(w)).withColumn("_gap", F.coalesce(F.col("start") > F.col("_prev"), F.lit(False)))
    far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = prev.withColumn("_at", (F.row_number().over(w) + F.sum(F.col("_gap").cast("int")).over(far)).cast("int"))
    null = lambda t: F.lit(None).cast(t)
    kinds = dict(words.dtypes)
    word = F.struct(F.col("_at").alias("pos"), "type", "text", "start", "end", "speaker")
    space = F.struct((F.col("_at") - 1).alias("pos"), F.lit("spacing").alias("type"), null("string").alias("text"), F.col("_prev").cast(kinds["start"]).alias("start"), F.col("start").cast(kinds["end"]).alias("end"), null("string").alias("speaker"))
    return at.select("source", F.inline(F.when(F.col("_gap"), F.array(space, word)).otherwise(F.array(word))))


def flatten_segments(segments: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """Aligned segments (source, segments array<struct<words array<struct<word,start,end>>,speaker>>) as tokens with spacing.

    speakers (source, seg_idx, speaker), if given, wins over a segment's own speaker, even where it has none.
    Times are rounded to 3 places, spacing keeps the unrounded ones.
    """
    s = segments.select("source", F.posexplode("segments").alias("seg_idx", "seg"))
    if speakers is not None:
        s = s.join(speakers, ["source", "seg_idx"], "left")
    else:
        s = s.withColumn("speaker", F.col("seg.speaker"))
    w = s.select("source", "seg_idx", "speaker", F.posexplode("seg.words").alias("word_idx", "w"))
    pos = F.row_number().over(Window.partitionBy("source").orderBy("seg_idx", "word_idx"))
    t = w.select("source", pos.alias("pos"), F.lit("word").alias("type"), token_text(F.lit("word"), F.col("w.word")).alias("text"), F.col("w.start").cast("double").alias("start"), F.col("w.end").cast("double").alias("end"), "speaker")
    third = lambda c: F.when(F.col("type") == "word", fixed(F.col(c), 3).cast("double")).otherwise(F.col(c)).alias(c)
    return with_spacing(t).select("source", "pos", "type", "text", third("start"), third("end"), "speaker")


def in_view(tokens: DataFrame, views: DataFrame) -> DataFrame:
    """Tokens of any type with both times that overlap a view (source, lo, hi), half open."""
    return tokens.where("start is not null and end is not null").join(views, "source").where("end > lo and start < hi")


def silences(tokens: DataFrame, views: DataFrame, threshold: float, only_heard: bool = False) -> DataFrame:
    """Gaps (source, start, end) of threshold or more between tokens within each view (source, lo, hi).

    A gap runs from the latest end so far, and one may trail. A view without tokens is one gap, unless
    only_heard, where it has none.
    """
    t = in_view(tokens, views)
    heard = t.select("source").distinct()
    t = t.where(_kind() != "spacing").select("source", "pos", F.greatest("lo", "start").alias("s"), "end", "lo")
    ends = (views.join(heard, "source", "left_semi") if only_heard else views).select("source", F.lit(2147483647).cast(dict(t.dtypes)["pos"]).alias("pos"), F.col("hi").alias("s"), F.col("hi").alias("end"), "lo")
    before = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.unionByName(ends).withColumn("prev", F.greatest("lo", F.coalesce(F.max("end").over(before), F.col("lo"))))
    return t.where(F.col("s") - F.col("prev") >= threshold).select("source", F.col("prev").alias("start"), F.col("s").alias("end"))


def silence_class(length_ms: Column) -> Column:
    """How well a silence takes a cut: clean from 400 ms, usable from 150, else unsafe."""
    return F.when(length_ms >= 400, "clean").when(length_ms >= 150, "usable").otherwise("unsafe")


def to_pixel(t: Column, lo: Column, hi: Column, x0: int, span: int) -> Column:
    """Where a time falls in a strip, cut towards zero."""
    return (F.lit(x0) + (t - lo) / F.greatest((hi - lo).cast("double"), F.lit(1e-6)) * span).cast("int")


def labels(tokens: DataFrame, views: DataFrame, x0: int = 50, span: int = 1400, shortest: float = 50, apart: int = 28) -> DataFrame:
    """Word labels that are drawn: (source, pos, x). Each stands at least so far right of the last one drawn.

    Whether a label is drawn depends on the decision before, so each view's labels are folded in order.
    """
    t = in_view(tokens, views).where((F.col("type") == "word") & token_text(F.lit("word"), F.col("text")).isNotNull() & (F.col("end") - F.col("start") >= shortest))
    center = F.floor((to_pixel(F.col("start"), F.col("lo"), F.col("hi"), x0, span) + to_pixel(F.col("end"), F.col("lo"), F.col("hi"), x0, span)) / 2).cast("int")
    per = t.select("source", F.struct("pos", center.alias("x")).alias("l")).groupBy("source").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    kind = "array<struct<pos:int,x:int>>"
    zero = F.struct(F.lit(-9999).alias("last"), F.array().cast(kind).alias("kept"))
    fold = F.aggregate("ls", zero, lambda a, l: F.when(l["x"] - a["last"] >= apart, F.struct(l["x"].alias("last"), F.concat(a["kept"], F.array(F.struct(l["pos"].cast("int").alias("pos"), l["x"].alias("x")))).alias("kept"))).otherwise(a))
    return per.select("source", F.inline(fold["kept"]))


def ruler(views: DataFrame, x0: int = 50, span: int = 1400, ticks: int = 6) -> DataFrame:
    """Ticks (source, i, x, t) at equal shares of a view."""
    i = F.col("i")
    return views.select("source", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(ticks))).alias("i")).select("source", "i", (F.lit(x0) + (i / ticks * span).cast("int")).alias("x"), (F.col("lo") + i / ticks * (F.col("hi") - F.col("lo"))).alias("t"))


def frame_times(views: DataFrame, n: int) -> DataFrame:
    """Sampled times (source, i, t): both ends and evenly between; one time is the middle; less than one counts as one."""
    n = max(n, 1)
    lo, hi, i = F.col("lo").cast("double"), F.col("hi").cast("double"), F.col("i")
    t = (lo + hi) / 2.0 if n == 1 else lo + i * ((hi - lo) / (n - 1))
    return views.select("source", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("source", "i", t.alias("t"))


def strip_layout(frames: DataFrame, height: int = 180, strip: int = 1300, gap: int = 4) -> DataFrame:
    """Per source of frames (source, i, width, height): scaled widths, total_width and drawn x positions.

    Frames get the given height; a total wider than the strip shrinks all by one factor, floored per frame.
    """
    w = (F.lit(height) * (F.col("width") / F.col("height"))).cast("int")
    f = frames.withColumn("w", w)
    every = Window.partitionBy("source")
    f = f.withColumn("total_width", F.sum("w").over(every) + (F.count(F.lit(1)).over(every) - 1) * gap)
    scale = F.when(F.col("total_width") > strip, strip / F.col("total_width")).otherwise(F.lit(1.0))
    f = f.withColumn("scale", scale).withColumn("drawn", (F.col("w") * F.col("scale")).cast("int"))
    step = F.when(F.col("scale") < 1, F.greatest(F.lit(2), (F.lit(gap) * F.col("scale")).cast("int"))).otherwise(gap)
    before = Window.partitionBy("source").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return f.select("source", "i", "drawn", F.col("total_width").cast("long").alias("total_width"), (F.lit(50) + F.coalesce(F.sum(F.col("drawn") + step).over(before), F.lit(0))).cast("long").alias("x"))
