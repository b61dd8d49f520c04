"""op2: all documents, packed."""

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm.common import table
from tidebook.llm.packing import packed


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece's sequence and place in it."""
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids")
