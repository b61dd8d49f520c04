"""op10: every document's quality, by its text and its site."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import table
from tidebook.llm.site import THRESHOLD, classifier, posteriors
from tidebook.llm.toxicity import bucket


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict; a document's host is its source and its path its language. Labels of rows whose crc32(doc_id) mod 4 is 3 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    held = F.coalesce(bucket(F.col("doc_id"), 4) == 3, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held)
    out = posteriors(docs, labels, classifier(docs.filter(~held), labels))
    return out.select("doc_id", held.alias("held_out"), "path_rate", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
