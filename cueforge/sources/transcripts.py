"""Readers of transcripts, cut lists, listings and tool outputs; schemas are fixed, so nothing is inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import strip

TRANSCRIPT = "words array<struct<type: string, text: string, start: double, end: double, speaker_id: string>>, engine string, language_code string, num_speakers_hint int"
EDL = "version int, sources map<string, string>, ranges array<struct<source: string, start: double, end: double, beat: string, quote: string, reason: string, note: string>>, grade string, overlays array<struct<file: string, start_in_output: double, duration: double>>, subtitles string, total_duration_s double"
#: Video suffixes, fixed values; the test is case-sensitive.
VIDEO_SUFFIXES = (".mp4", ".MP4", ".mov", ".MOV", ".mkv", ".MKV", ".avi", ".AVI", ".m4v")
#: What a loudness measurement must hold, fixed values.
LOUDNESS_KEYS = ("input_i", "input_tp", "input_lra", "input_thresh", "target_offset")


def _stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Tokens (source, pos, type, text, start, end, speaker) of a folder of JSON transcripts; source is the file's stem. A file without words has no rows."""
    t = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    w = t.select(_stem().alias("source"), F.posexplode("words").alias("pos", "w"))
    return w.select("source", "pos", "w.type", "w.text", "w.start", "w.end", F.col("w.speaker_id").alias("speaker"))


def transcript_sources(spark: SparkSession, path: str) -> DataFrame:
    """The sources a folder has transcripts of."""
    return spark.read.schema(TRANSCRIPT).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).select(_stem().alias("source")).distinct()


def transcript_listing(spark: SparkSession, path: str) -> DataFrame:
    """The transcripts of a folder (source) in order of their names; a missing or empty folder is an error at once."""
    try:
        found = transcript_sources(spark, path)
        none = found.isEmpty()
    except AnalysisException as e:
        raise FileNotFoundError(f"no folder {path}") from e
    if none:
        raise FileNotFoundError(f"no transcripts in {path}")
    return found.orderBy("source")


def edl_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Ranges (edl, rid, source, path, start, end, note) of cut lists. A range of an unknown source raises an error when read."""
    e = spark.read.schema(EDL).option("multiLine", True).json(path)
    r = e.select(_stem().alias("edl"), "sources", F.posexplode("ranges").alias("rid", "r"))
    file = F.try_element_at("sources", F.col("r.source"))
    known = F.when(file.isNull(), F.raise_error(F.concat(F.lit("unknown source "), F.coalesce("r.source", F.lit("null"))))).otherwise(file)
    return r.select("edl", "rid", "r.source", known.alias("path"), "r.start", "r.end", segment_note(F.col("r.beat"), F.col("r.note")).alias("note"))


def edl_overlays(spark: SparkSession, path: str) -> DataFrame:
    e = spark.read.schema(EDL).option("multiLine", True).json(path)
    return e.select(_stem().alias("edl"), F.posexplode("overlays").alias("idx", "o")).select("edl", "idx", "o.file", F.col("o.start_in_output").alias("start"), "o.duration")


def videos(spark: SparkSession, path: str) -> DataFrame:
    """Video files of a folder, not of those below, by path; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path).select("path", "length")
    return f.where(F.regexp_extract("path", r"\.[^./]*$", 0).isin(*VIDEO_SUFFIXES)).orderBy("path")


def script_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files, stripped; an empty one raises an error when read."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text"))
    return t.select("path", F.when(F.col("text") == "", F.raise_error(F.concat(F.lit("empty script "), F.col("path")))).otherwise(F.col("text")).alias("text"))


def segment_note(beat: Column, note: Column) -> Column:
    return F.coalesce(F.when(beat != "", beat), note, F.lit(""))


def frame_values(lines: DataFrame) -> DataFrame:
    """Frame statistics (clip, key, value, and line_no if given) of lines (clip, line) as key=value; what follows the last = counts, malformed values are left out."""
    key = F.regexp_extract("line", r"lavfi\.signalstats\.(YBITDEPTH|YAVG|YMIN|YMAX|SATAVG)", 1)
    value = F.when(F.contains("line", F.lit("=")), F.substring_index("line", "=", -1).try_cast("double"))
    kept = [c for c in ("line_no",) if c in lines.columns]
    return lines.select("clip", *kept, key.alias("key"), value.alias("value")).where("key <> '' and value is not null")


def loudness(outputs: DataFrame) -> DataFrame:
    """The last JSON object of tool outputs (clip, stderr): (clip, measured map), null unless it has every needed key."""
    s = F.col("stderr")
    start, end = F.length(s) - F.locate("{", F.reverse(s)) + 1, F.length(s) - F.locate("}", F.reverse(s)) + 1
    block = F.when((F.locate("{", s) > 0) & (F.locate("}", s) > 0) & (end > start), F.expr("substring(stderr, length(stderr) - locate('{', reverse(stderr)) + 1, locate('{', reverse(stderr)) - locate('}', reverse(stderr)) + 1)"))
    m = F.from_json(block, "map<string, string>")
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in LOUDNESS_KEYS]), F.map_keys(m)))
    return outputs.select("clip", F.when(missing == 0, m).alias("measured"))


PROBE = "streams array<struct<width: string, height: string, side_data_list: array<struct<rotation: string>>>>"


def stream_shape(probe: Column) -> Column:
    """(width, height, rotation) of a probe's JSON: the first stream, the first rotation of its side data, 0 without any; null if a part is missing or malformed."""
    first = F.get(F.from_json(probe, PROBE)["streams"], 0)
    turns = F.filter(F.transform(first["side_data_list"], lambda x: x["rotation"]), lambda r: r.isNotNull())
    turn = F.coalesce(F.get(turns, 0), F.lit("0")).try_cast("double")
    side = lambda name: first[name].try_cast("double").cast("int")
    whole = side("width").isNotNull() & side("height").isNotNull() & turn.isNotNull() & ~F.isnan(turn) & (F.abs(turn) < float("inf"))
    return F.when(whole, F.struct(side("width").alias("width"), side("height").alias("height"), turn.alias("rotation")))


def probed_transfer(output: Column) -> Column:
    """The colour transfer that a probe's output names; null for a failed probe."""
    return F.nullif(strip(output), F.lit(""))


def probed_duration(output: Column, default: float | None = 10.0) -> Column:
    """Seconds that a probe's output says; else the default."""
    return F.coalesce(strip(output).try_cast("double"), F.lit(default).cast("double"))


def track_count(listing: Column) -> Column:
    """Lines of a listing that aren't blank."""
    return F.size(F.filter(F.split(listing, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s", "") != ""))


def resolved_path(path: Column, base: Column, exists_in_base: Column, exists_in_parent: Column) -> Column:
    """Absolute as it is; else in base if there, else in base's parent if there, else in base."""
    parent = F.regexp_replace(base, r"/[^/]*$", "")
    return F.when(path.startswith("/"), path).when(~exists_in_base & exists_in_parent, F.concat_ws("/", parent, path)).otherwise(F.concat_ws("/", base, path))


def normal_path(path: Column) -> Column:
    """An absolute path without empty, . and .. parts."""
    step = lambda kept, part: F.when(part.isin("", "."), kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def resolve_paths(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """wanted (id, path, base) with resolved: the first candidate that the listing (path) has, by two joins to it; see resolved_path()."""
    in_base, in_parent = normal_path(F.concat_ws("/", "base", "path")), normal_path(F.concat_ws("/", "base", F.lit(".."), "path"))
    there = lambda name: listing.select(F.col("path").alias(name)).distinct().withColumn(f"{name}_there", F.lit(True))
    w = wanted.withColumns({"_a": in_base, "_b": in_parent}).join(there("_a"), "_a", "left").join(there("_b"), "_b", "left")
    found = F.when(F.col("path").startswith("/"), F.col("path")).when(F.col("_a_there").isNull() & F.col("_b_there").isNotNull(), F.col("_b")).otherwise(F.col("_a"))
    return w.select(*wanted.columns, found.alias("resolved"))
