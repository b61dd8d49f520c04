"""op1: the mixture of all documents, by document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import table
from tidebook.llm.mixing import mixture


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mixture takes of each document."""
    sizes, taken, _ = mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    words = taken.groupBy("key").agg(F.sum("length").alias("taken"))
    return sizes.join(words, "key", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
