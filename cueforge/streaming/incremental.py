"""Incremental runs: each new transcript file is packed once, whatever was packed before stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.speech import phrases
from ..session import session_with
from ..sources.transcripts import TRANSCRIPT

LISTING_TASKS = 16


def packed_stream(spark: SparkSession, path: str, out: str, checkpoint: str, threshold: float = 0.5, files_per_batch: int = 1000):
    """A query that adds phrases of transcript files to out as they arrive; a restart goes on from the checkpoint.

    A file is a whole transcript, so no state crosses batches. A file that changes later is not read again.
    Spark lists a batch's files with a task for each; LISTING_TASKS share them instead, in a session of the stream's own.
    """
    own = session_with(spark, spark__sql__sources__parallelPartitionDiscovery__parallelism=str(LISTING_TASKS))
    t = own.readStream.schema(TRANSCRIPT).option("multiLine", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).json(path)
    w = t.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("source"), F.posexplode("words").alias("pos", "w")).select("source", "pos", "w.type", "w.text", "w.start", "w.end", F.col("w.speaker_id").alias("speaker"))

    def add(batch: DataFrame, batch_id: int) -> None:
        phrases(batch, threshold).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return w.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
