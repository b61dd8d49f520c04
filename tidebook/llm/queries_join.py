"""op6: classes of all documents by shingle likeness."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import table
from tidebook.llm.join import classes


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's set size and class."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
