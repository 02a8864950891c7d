"""Writers: transcripts, packed text, subtitles, concat lists."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, order: list[str], key: str | None = None) -> None:
    """Lines' text in order, as one file, or one per key under key=...: files are what their readers take as a whole.

    A file is written by one task, so lines without a key must fit one: a subtitle file or a listing, not a corpus.
    Lines that are dealt by the key already stay where they are.
    """
    if key:
        n = F.row_number().over(Window.partitionBy(key).orderBy(*order))  # asks for all of a key in order, and for an exchange only if need be
        lines.withColumn("_n", n).where("_n > 0").select(key, "text").write.mode("overwrite").partitionBy(key).text(path)
    else:
        lines.orderBy(*order).select("text").coalesce(1).write.mode("overwrite").text(path)


def ascii_json(json: Column) -> Column:
    """JSON with every character beyond ASCII escaped, those beyond 16 bits as two halves."""
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    code = lambda c: F.ascii(c)
    halves = lambda c: F.concat(four(F.shiftright(code(c) - 0x10000, 10) + 0xD800), four((code(c) - 0x10000).bitwiseAND(0x3FF) + 0xDC00))
    return F.array_join(F.transform(F.split(json, ""), lambda c: F.when(code(c) < 127, c).when(code(c) < 0x10000, four(code(c))).otherwise(halves(c))), "")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes files (name, content binary) into a folder that all tasks reach, each as a whole; returns what was written (name, size).

    A batch is held while its files are written, without copies of their contents: spark.sql.execution.arrow.maxBytesPerBatch bounds it.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        made = set()
        for b in batches:
            sizes = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                target = f"{root}/{name}"
                if (parent := target.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                held = content.as_buffer() or b""
                with fs.open_output_stream(target) as f:
                    f.write(held)
                sizes.append(len(held))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["name", "size"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(put, "name string, size long")


def transcript_json(tokens: DataFrame, engine: str) -> DataFrame:
    """(source, json) per source: words in order, the engine's name."""
    w = F.struct("pos", F.struct("type", "text", "start", "end", F.col("speaker").alias("speaker_id")).alias("w"))
    t = tokens.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(w)), lambda x: x["w"]).alias("words"))
    return t.select("source", F.to_json(F.struct("words", F.lit(engine).alias("engine")), {"pretty": "true"}).alias("json"))


def concat_list(segments: DataFrame) -> DataFrame:
    """Lines (edl, rid, text) for the concat reader of segments (edl, rid, path)."""
    return segments.select("edl", "rid", F.concat(F.lit("file '"), F.col("path"), F.lit("'")).alias("text"))


def summary(phrased: DataFrame) -> DataFrame:
    """One row: sources, phrases and summed lengths."""
    per = phrased.groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.max_by("end", "phrase") - F.min_by("start", "phrase")).alias("d"))
    return per.agg(F.count(F.lit(1)).alias("n_sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_phrases"), F.coalesce(F.sum("d"), F.lit(0)).alias("duration"))
