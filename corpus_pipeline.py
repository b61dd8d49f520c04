"""From raw documents to packed sequences: quality rules, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and all rows of docs; all but the last return the columns of documents. Rows are told apart by doc_id with their text; of rows that repeat
both, the near-duplicate stage keeps one. Every stage's operator states how it takes nulls, empty and long texts and empty tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.llm import common
from tidebook.llm.common import stored, table
from tidebook.llm.join import classes
from tidebook.llm.mixing import mixed_documents
from tidebook.llm.packing import packed
from tidebook.llm.quality import judged
from tidebook.llm.repeats import removed


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__h": F.xxhash64("text")})


#: Tables that the stages run so far have written for themselves.
_LEFT: list[str] = []


def _stage(f):
    """A stage begins by deleting what earlier stages wrote for themselves, unless its docs still read it: write a stage's result before running the next."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _LEFT[:] = common.drop_unused(spark, _LEFT, docs)
        before = len(common.STORED)
        out = f(spark, docs, sf_dir)
        _LEFT.extend(common.STORED[before:])
        return out

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the quality rules reject goes."""
    verdict = judged(docs.select("doc_id", "text", "lang")).filter("kept").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__id"), F.col("_h").alias("__h")).distinct()
    return _keyed(docs).join(verdict, ["__id", "__h"], "left_semi").select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the n-gram join, the document with the smallest id stays."""
    stay = classes(docs).filter(F.col("doc_id").isNull() | (F.col("component_id") == F.col("doc_id"))).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__id"), F.col("h").alias("__h")).distinct()
    rows = _keyed(docs.filter("doc_id is not null")).join(stay, ["__id", "__h"], "left_semi")
    once = rows.withColumn("__row", F.row_number().over(Window.partitionBy("__id", "__h").orderBy("__id"))).filter("__row = 1")
    return once.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a passage of 50 bytes or more that an earlier document has goes."""
    left = removed(docs, with_text=True)
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that the mixture takes, as documents."""
    return mixed_documents(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's sequence and place."""
    return packed(docs.select("doc_id", "text")).drop("ids")


STAGES = [("quality rules", quality), ("n-gram jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("mixing to target weights", mixing), ("best-fit packing", packing)]

#: SQL can't express stages 2 to 5 (token ids, pseudorandom draws, classes by whole texts); the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else stored(docs, f"pipeline-{k}"), sf_dir)
    return docs
