"""The corpus pipeline over the table documents: judge, deduplicate, mix, tokenise.

The dedup stages narrow the rows down by row number, which the stored table of the stage before gives: what goes is a table of numbers, broadcast if it is short and
joined by sort-merge if not. Each row stays or goes by itself, whether its doc_id is null, repeated or its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.llm import bpe, exact_dedup, mixing, quality, shingle_join
from cueforge.llm.common import Scratch, small_side, stored, unused

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: run()'s rows cannot be had from SQL: the classifier is trained.
ORACLE_SQL = None


def _one_of_each(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], group: str, *first: Column) -> DataFrame:
    """docs with one row of each group that judge finds: the first by the given columns, then by doc_id (null last) and row.

    judge sees row numbers in place of doc_id, so that each row has a decision of its own. The table that a stage before has
    stored is read several times; no copy of it is kept.
    """
    scratch = Scratch(docs.sparkSession)
    number = unused(docs, "_row")
    rows = stored(docs, scratch, "rows").withColumn(number, F.monotonically_increasing_id())
    judged = judge(rows.select(F.col(number).alias("doc_id"), "text")).withColumnRenamed("doc_id", "_n")
    named = judged.join(rows.select(F.col(number).alias("_n"), F.col("doc_id")).hint("merge"), "_n")
    named = scratch.save(named.select("_n", F.col(group).alias("_group"), F.struct(*first, F.col("doc_id").isNull().alias("no_id"), "doc_id", "_n").alias("place")), "judged")
    stays = named.groupBy("_group").agg(F.min("place").alias("place")).select(F.col("place._n").alias("_n"))
    gone = scratch.save(named.select("_n").join(stays.hint("merge"), "_n", "left_anti"), "gone")
    scratch.drop("judged")
    return rows.join(small_side(gone.withColumnRenamed("_n", number)), number, "left_anti").select(*docs.columns)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _one_of_each(docs, exact_dedup.exact_groups, "text_sha256", (-F.col("n_chars")).alias("shorter"))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _one_of_each(docs, shingle_join.near_duplicates, "component_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN, verify=True)


STAGES = [("quality classifier", judge_quality), ("exact dedup", drop_exact), ("n-gram Jaccard join", drop_near), ("mixing sources to target weights", mix_sources), ("byte-level BPE encoding and decoding", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next: doc_id, n_tokens, ids."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage-{k}")
            if k and k < len(STAGES) - 1:
                scratch.drop(f"stage-{k - 1}")
    return docs
