"""Message counts, spans, completeness, activity, and what kind of venue a session is from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators.tape import ALL_TYPES, BOOK_TYPES, COMPARED_TYPES, TICK_TYPES


def by_type(tape: DataFrame) -> DataFrame:
    """mtype, n for all 23 types, zeros too."""
    spark: SparkSession = tape.sparkSession
    types = spark.range(1).select(F.explode(F.array(*map(F.lit, ALL_TYPES))).alias("mtype"))
    return types.join(tape.groupBy("mtype").agg(F.count(F.lit(1)).alias("n")), "mtype", "left").select("mtype", F.coalesce("n", F.lit(0)).alias("n"))


def span(tape: DataFrame) -> DataFrame:
    """First and last time, last type and system code, messages after end of hours, and whether the session is complete (its last message is a system event C)."""
    ended = F.min(F.when((F.col("mtype") == "S") & (F.col("code") == "E"), F.col("seq")))
    last = F.max(F.struct("seq", "ts_ns", "mtype", "code"))
    one = tape.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "ts_ns")).alias("first"), last.alias("last"), ended.alias("ended"))
    return one.select("n", F.col("first.ts_ns").alias("first_ts"), F.col("last.ts_ns").alias("last_ts"), F.col("last.mtype").alias("last_type"), F.coalesce((F.col("last.mtype") == "S") & (F.col("last.code") == "C"), F.lit(False)).alias("complete"), F.col("ended").isNotNull().alias("saw_end_of_hours"))


def four_counts(tape: DataFrame) -> DataFrame:
    """The four message counts that must not be mixed."""
    n = lambda types: F.coalesce(F.sum(F.col("mtype").isin(types).cast("long")), F.lit(0))
    return tape.agg(F.count(F.lit(1)).alias("framed"), n(BOOK_TYPES).alias("book_affecting"), n(COMPARED_TYPES[:3] + COMPARED_TYPES[3:]).alias("compared"), n(TICK_TYPES).alias("book_messages"))


def activity(tape: DataFrame) -> DataFrame:
    """locate, stock, n: book-affecting messages of each symbol."""
    return tape.filter(F.col("mtype").isin(BOOK_TYPES)).groupBy("locate").agg(F.count(F.lit(1)).alias("n"), F.max_by("stock", "seq").alias("stock"))


def busiest(tape: DataFrame, n: int) -> DataFrame:
    """The n busiest symbols, ties to the larger locate."""
    return activity(tape).orderBy(F.desc("n"), F.desc("locate")).limit(n)


def venue_profile(tape: DataFrame) -> DataFrame:
    """Auction evidence and the verdict it gives."""
    q = F.col("mtype") == "Q"
    one = lambda c: F.coalesce(F.sum((q & (F.col("code") == c)).cast("long")), F.lit(0))
    p = tape.agg(F.count(F.lit(1)).alias("messages"), one("O").alias("opening"), one("C").alias("closing"), F.coalesce(F.sum((F.col("mtype") == "I").cast("long")), F.lit(0)).alias("imbalances"), F.coalesce(F.sum(F.when(q, F.col("qty"))), F.lit(0)).alias("cross_shares"))
    auction = (F.col("imbalances") > 0) & (F.col("opening") > 0) & (F.col("closing") > 0)
    none = (F.col("imbalances") == 0) & (F.col("opening") == 0) & (F.col("closing") == 0)
    return p.withColumn("verdict", F.when(auction, "auctions").when(none, "no auctions").otherwise("ambiguous"))


def age_buckets(mods: DataFrame) -> DataFrame:
    """How old the named order is at each modification, by bucket; unseen: no live order."""
    age = F.col("ts_ns") - F.col("start_ts")
    b = F.when(~F.col("found"), "unseen").when(age < 1_000_000, "<1ms").when(age < 10_000_000, "1-10ms").when(age < 100_000_000, "10-100ms").when(age <= 1_000_000_000, "100ms-1s").otherwise(">1s")
    return mods.groupBy("mtype", b.alias("age")).agg(F.count(F.lit(1)).alias("n"))


def directory(tape: DataFrame) -> DataFrame:
    """locate, stock: the last directory entry of each symbol."""
    return tape.filter("mtype = 'R'").groupBy("locate").agg(F.max_by("stock", "seq").alias("stock"))


def named_activity(tape: DataFrame) -> DataFrame:
    """activity() under the directory's names; '?' where it has none. A directory has a row for each symbol, 65,535 at most."""
    return activity(tape).drop("stock").join(F.broadcast(directory(tape)), "locate", "left").select("locate", F.coalesce("stock", F.lit("?")).alias("stock"), "n")


def after_hours(tape: DataFrame) -> DataFrame:
    """Messages after the end of hours: all (the message that ends them isn't one), and those of the ten types that tick the book."""
    ended = tape.filter("mtype = 'S' and code = 'E'").agg(F.min("seq").alias("ended"))
    t = tape.join(F.broadcast(ended), F.col("seq") > F.col("ended"), "inner")  # one row on the right
    return t.agg(F.count(F.lit(1)).alias("all_types"), F.coalesce(F.sum(F.col("mtype").isin(TICK_TYPES).cast("long")), F.lit(0)).alias("ticks"))


def subcent(tape: DataFrame) -> DataFrame:
    """mtype, priced, subcent: prices that aren't whole cents."""
    return tape.filter("price is not null").groupBy("mtype").agg(F.count(F.lit(1)).alias("priced"), F.sum((F.col("price") % 100 != 0).cast("long")).alias("subcent"))
