"""op8: repeated passages of all documents."""

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm.common import table
from tidebook.llm.repeats import removed


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to earlier ones."""
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("_h")
