"""op7: every document's language."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import table
from tidebook.llm.language import fitted, identified
from tidebook.llm.toxicity import bucket


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score; rows whose crc32(doc_id) mod 4 is 2 are held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return identified(docs, fitted(docs.filter(~held))).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")
