"""Registered queries that go through files: they write them into the shared folder, read them back with the readers, and have the SQL of what was written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _PHR, _RANGES, _TOK, PHRASE_GAP, _phrases_sql, _sql, query
from .operators import speech
from .session import session_with
from .sources import adapters, sinks, transcripts, wav
from .streaming import incremental

#: Bytes of file contents that a Python worker holds at once, a larger file apart.
BATCH_BYTES = "8388608"


def _folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one only on a local master where that is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return f"{found.rstrip('/')}/cueforge-files-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="cueforge-files-")


def _writer(spark: SparkSession) -> SparkSession:
    """The session for files to be written."""
    return session_with(spark, spark__sql__execution__arrow__maxBytesPerBatch=BATCH_BYTES)


def _written(files: DataFrame, folder: str) -> str:
    sinks.write_files(files, folder).agg(F.sum("size")).first()
    return folder


def _transcript_files(spark, d, ascii_only=False) -> str:
    t = sinks.transcript_json(adapters.tokens(_writer(spark), d, "sparse"), "made")
    json = sinks.ascii_json(F.col("json")) if ascii_only else F.col("json")
    return _written(t.select(F.concat(F.col("source").cast("string"), F.lit(".json")).alias("name"), json.alias("content")), _folder(spark))


_READ = _sql('SELECT source::VARCHAR AS source, (pos - 1)::INTEGER AS pos, type, text, "start"::DOUBLE AS "start", "end"::DOUBLE AS "end", speaker FROM sparse', _TOK)


@query("read_transcripts", _READ)
def read_transcripts(spark, d):
    return transcripts.transcripts(spark, _transcript_files(spark, d))


@query("read_transcripts_ascii", _READ.replace("speaker FROM sparse", "speaker, true AS escaped FROM sparse"))
def read_transcripts_ascii(spark, d):
    """The same from files that escape what isn't ASCII."""
    folder = _transcript_files(spark, d, ascii_only=True)
    plain = spark.read.text(folder, wholetext=True).agg(F.bool_and(F.col("value").rlike(r"^[\x00-\x7F]*$")).alias("x"))
    return transcripts.transcripts(spark, folder).withColumn("escaped", plain.scalar())


@query("transcript_listing", "SELECT DISTINCT conv_id::VARCHAR AS source FROM conversations")
def transcript_listing(spark, d):
    return transcripts.transcript_listing(spark, _transcript_files(spark, d))


@query("read_edl", _sql("""SELECT edl::VARCHAR AS edl, rid, source::VARCHAR AS source, 'raw/' || source || '.mov' AS path, "start"::DOUBLE AS "start", "end"::DOUBLE AS "end", CASE rid WHEN 0 THEN 'hook' WHEN 1 THEN 'a note' ELSE '' END AS note FROM ranges""", _TOK, _RANGES))
def read_edl(spark, d):
    r = adapters.ranges(adapters.tokens(spark, d)).withColumn("source", F.col("source").cast("string"))
    one = F.struct("rid", "source", "start", "end", F.when(F.col("rid") == 0, "hook").otherwise("").alias("beat"), F.when(F.col("rid") == 1, "a note").alias("note"))
    lists = r.groupBy("edl").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("rid")).alias("ranges"), F.map_from_entries(F.collect_set(F.struct("source", F.concat(F.lit("raw/"), F.col("source"), F.lit(".mov"))))).alias("sources"))
    return transcripts.edl_ranges(spark, _written(lists.select(F.concat(F.col("edl").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct("sources", "ranges")).alias("content")), _folder(spark)))


@query("read_videos", """SELECT name, length(name)::BIGINT AS length FROM (SELECT 'n' || n_nationkey || ['.mp4', '.MOV', '.M4V', '.txt', '.mkv'][n_nationkey % 5 + 1] AS name FROM nation) WHERE name NOT LIKE '%.M4V' AND name NOT LIKE '%.txt'""")
def read_videos(spark, d):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".MOV", ".M4V", ".txt", ".mkv")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    files = adapters.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), suffix).alias("name"))
    below = files.select(F.concat(F.lit("below/"), "name").alias("name"))
    found = transcripts.videos(spark, _written(files.union(below).withColumn("content", F.element_at(F.split("name", "/"), -1)), _folder(spark)))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("read_scripts", "SELECT 'r' || r_regionkey || '.txt' AS name, trim(r_name) AS text FROM region")
def read_scripts(spark, d):
    files = adapters.table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit("\n  "), "r_name", F.lit(" \t\n")).alias("content"))
    return transcripts.script_text(spark, _written(files, _folder(spark))).select(F.element_at(F.split("path", "/"), -1).alias("name"), "text")


@query("read_wav", "SELECT vec_id AS clip, len(embedding)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda x: abs(round(x::DOUBLE * 20000)) / 32768)), 9) AS loud, NULL::VARCHAR AS fault FROM embeddings")
def read_wav(spark, d):
    clips = adapters.pcm(_writer(spark), d).select(F.concat(F.col("clip").cast("string"), F.lit(".wav")).alias("name"), F.transform("pcm", lambda x: F.round(x * 20000).cast("int")).alias("samples"))
    c = wav.wav_clips(spark, _written(wav.wav_files(clips), _folder(spark)))
    return c.select(F.regexp_extract("clip", r"(\d+)\.wav$", 1).cast("long").alias("clip"), F.size("pcm").alias("n"), F.round(F.aggregate("pcm", F.lit(0.0), lambda a, x: a + F.abs(x)), 9).alias("loud"), "fault")


@query("packed_file", _sql("""SELECT source, string_agg(text, chr(10) ORDER BY line) || chr(10) AS text FROM (SELECT source, 0 AS line, '## ' || source AS text FROM phr GROUP BY source UNION ALL SELECT source, phrase, text FROM phr) GROUP BY source""", _TOK, _phrases_sql("plain")))
def packed_file(spark, d):
    """Text files of lines in order, one per source, read back as wholes."""
    p = speech.phrases(adapters.tokens(spark, d), PHRASE_GAP)
    said = F.struct(F.col("phrase").alias("line"), "text")
    head = F.struct(F.lit(0).alias("line"), F.concat(F.lit("## "), F.col("source").cast("string")).alias("text"))
    lines = p.select("source", F.inline(F.when(F.col("phrase") == 1, F.array(head, said)).otherwise(F.array(said))))
    folder = _folder(spark)
    sinks.write_lines(lines, folder, ["line"], key="source")
    return spark.read.text(folder, wholetext=True).select("source", F.col("value").alias("text")).withColumn("source", F.col("source").cast("long"))


@query("stream_packed", _sql(_PHR.replace("SELECT source,", "SELECT source::VARCHAR AS source,").replace('"start", "end"', '"start"::DOUBLE AS "start", "end"::DOUBLE AS "end"'), _TOK, _phrases_sql("sparse")))
def stream_packed(spark, d):
    """Transcript files through a stream that packs each once; a second run finds nothing new."""
    src, out = _transcript_files(spark, d), _folder(spark)
    for _ in range(2):
        incremental.packed_stream(spark, src, f"{out}/packed", f"{out}/log", PHRASE_GAP).awaitTermination()
    return spark.read.parquet(f"{out}/packed").select("source", "phrase", "start", "end", "text", "speaker")
