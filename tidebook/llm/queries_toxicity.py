"""op3: every document's toxicity."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import table
from tidebook.llm.toxicity import THRESHOLD, bucket, fitted, scored


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction; rows whose crc32(doc_id) mod 3 is 1 are held out of training."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = bucket(F.col("doc_id"), 3) == 1
    model, fit = fitted(docs.filter(~held), labels.filter(~held))
    out = scored(docs, model, fit)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")
