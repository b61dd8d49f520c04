"""Crossed and locked observations, and what excuses them.

The book is observed after each add, and after each modification (a replacement that finds its order is observed twice, one that doesn't not at all). The excuse is the first
that holds: no trading action yet; operational halt; not trading; awaiting a reopening; else it is unexplained. A reopening opens when trading follows another state, and ends
at the next cross, at the next observation that is neither crossed nor locked, or, found at a crossed or locked one, after CAP_NS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.operators.tape import CLOSE_NS, OPEN_NS

CAP_NS = 100_000_000


def observations(tape: DataFrame, inside: DataFrame, mods: DataFrame, venue: str = "Q") -> DataFrame:
    """Operational halts count where they are of this venue's market. Per message that matters to the gate: weight (observations), the inside, state so far and the reopening it may be in."""
    found = mods.filter("mtype = 'U'").select("seq", F.col("found").alias("_found"))
    m = tape.select("seq", "locate", "ts_ns", "mtype", "code", "market").join(found, "seq", "left").join(inside.select("seq", "bid", "ask"), "seq")
    weight = F.when(F.col("mtype").isin("A", "F", "E", "C", "X", "D"), 1).when((F.col("mtype") == "U") & F.col("_found"), 2).otherwise(0)
    both = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    m = m.withColumn("weight", F.when(both, weight).otherwise(0))
    by = Window.partitionBy("locate").orderBy("seq")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("state", F.last(F.when(F.col("mtype") == "H", F.col("code")), ignorenulls=True).over(so_far))
    m = m.withColumn("halt", F.last(F.when((F.col("mtype") == "h") & (F.col("market") == venue), F.col("code")), ignorenulls=True).over(so_far) == "H")
    before = F.last(F.when(F.col("mtype") == "H", F.col("code")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("mtype") == "H") & (F.col("code") == "T") & before.isNotNull() & (before != "T")
    m = m.withColumn("opens", F.coalesce(opens, F.lit(False)))
    m = m.withColumn("reopening", F.sum(F.col("opens").cast("int")).over(so_far)).withColumn("opened_ts", F.last(F.when(F.col("opens"), F.col("ts_ns")), ignorenulls=True).over(so_far))
    bad = (F.col("weight") > 0) & (F.col("bid") >= F.col("ask"))
    clean = (F.col("weight") > 0) & (F.col("bid") < F.col("ask"))
    late = F.col("ts_ns") - F.col("opened_ts") > CAP_NS
    m = m.withColumns({"bad": F.coalesce(bad, F.lit(False)), "clean": F.coalesce(clean, F.lit(False)), "late": F.coalesce(late, F.lit(False))})
    closes = (F.col("mtype") == "Q") | F.col("clean") | (F.col("bad") & F.col("late"))
    within = Window.partitionBy("locate", "reopening").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("awaiting", (F.col("reopening") > 0) & ~F.col("opens") & (F.coalesce(F.sum(closes.cast("int")).over(within), F.lit(0)) == 0))


def excuses(obs: DataFrame) -> DataFrame:
    """kind, excuse: observations, those in continuous hours, symbols, worst depth."""
    o = obs.filter("bad")
    halt = F.coalesce("halt", F.lit(False))
    why = F.when(F.col("state").isNull(), "before first action").when(halt, "operational halt").when(F.col("state") != "T", "not trading").when(F.col("awaiting") & ~F.col("late"), "awaiting reopen").otherwise("unexplained")
    kind = F.when(F.col("bid") > F.col("ask"), "crossed").otherwise("locked")
    hours = (F.col("ts_ns") >= OPEN_NS) & (F.col("ts_ns") < CLOSE_NS)
    return o.groupBy(kind.alias("kind"), why.alias("excuse")).agg(F.sum("weight").alias("observations"), F.sum(F.when(hours, F.col("weight")).otherwise(0)).alias("continuous"), F.countDistinct("locate").alias("symbols"), F.max(F.col("bid") - F.col("ask")).alias("worst"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))


def reopenings(obs: DataFrame) -> DataFrame:
    """Windows opened, capped, and the longest that a cross or a clean observation ended."""
    ended = F.col("awaiting") & ((F.col("mtype") == "Q") | F.col("clean"))
    return obs.agg(F.coalesce(F.sum(F.col("opens").cast("long")), F.lit(0)).alias("opened"), F.coalesce(F.sum((F.col("awaiting") & F.col("bad") & F.col("late")).cast("long")), F.lit(0)).alias("capped"), F.coalesce(F.max(F.when(ended, F.greatest(F.lit(0), F.col("ts_ns") - F.col("opened_ts")))), F.lit(0)).alias("longest_ns"))
