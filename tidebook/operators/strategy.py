"""A maker that quotes one lot on the signal's side at each window's close and leaves at the next close's mid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values, dollars a share: rebates for adding on tape C, on tapes A and B, and at the top tier.
ADD_C, ADD_AB, ADD_TOP = 0.0015, 0.0020, 0.00305


def tape_of(category: Column) -> Column:
    """The consolidated tape of a market category."""
    return F.when(category.isin("Q", "G", "S"), "C").when(category == "N", "A").when(category.isin("A", "P", "Z", "V"), "B").otherwise("?")


def quotes(windows: DataFrame) -> DataFrame:
    """One for each usable window whose imbalance has a sign: side, price, spread, and the next close's seq and mid."""
    by = Window.partitionBy("locate").orderBy("wid")
    w = windows.withColumns({"exit_seq": F.lead("close_seq").over(by), "exit_mid": F.lead("mid").over(by)})
    buy = F.col("queue_imbalance") > 0
    return w.filter("usable and queue_imbalance <> 0").select(F.col("close_seq").alias("seq"), "locate", "exit_seq", "exit_mid", F.when(buy, "B").otherwise("S").alias("side"), F.when(buy, F.col("bid")).otherwise(F.col("ask")).alias("price"), "spread")


def quote_fills(quoted: DataFrame, moved: DataFrame, rule4: bool) -> DataFrame:
    """quoted, with whether the exact queue model fills it by the next close. Quotes of a symbol don't overlap, so each event meets the one that is open: the last before it."""
    q = quoted.select("locate", "seq", F.struct("seq", "side", "price", "exit_seq").alias("q"), F.lit(None).cast("struct<side:string,price:bigint,kind:string,start_seq:bigint>").alias("e"))
    e = moved.filter("kind <> 'cancel'").select("locate", "seq", F.lit(None).cast(q.schema["q"].dataType).alias("q"), F.struct("side", "price", "kind", "start_seq").alias("e"))
    w = Window.partitionBy("locate").orderBy("seq", F.col("q").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = q.unionByName(e).withColumn("q", F.last("q", ignorenulls=True).over(w)).filter("e is not null and q is not null and seq > q.seq and (q.exit_seq is null or seq <= q.exit_seq) and e.side = q.side")
    worse = F.when(F.col("e.side") == "B", F.col("e.price") < F.col("q.price")).otherwise(F.col("e.price") > F.col("q.price"))
    at = F.col("e.price") == F.col("q.price")
    fill = ((F.col("e.kind") == "exec") & (worse | (at & (F.col("e.start_seq") > F.col("q.seq"))))) | ((F.col("e.kind") == "print") & at & F.lit(rule4))
    hit = m.filter(fill).select("locate", F.col("q.seq").alias("quote"), "seq").groupBy("locate", "quote").agg(F.min("seq").alias("fill_seq"))
    return quoted.join(hit.withColumnRenamed("quote", "seq"), ["locate", "seq"], "left")


def pnl(filled_quotes: DataFrame, category: Column | None = None) -> DataFrame:
    """Quotes, fills, gross per fill in half-spreads and dollars, and net of the rebate, uniform, top and by tape."""
    g = F.when(F.col("side") == "B", F.col("exit_mid") - F.col("price")).otherwise(F.col("price") - F.col("exit_mid"))
    done = F.col("fill_seq").isNotNull() & F.col("exit_seq").isNotNull()
    n = F.sum(done.cast("long"))
    per = lambda x: F.sum(F.when(done, x)) / F.greatest(n, F.lit(1))
    rebate = F.when(tape_of(category if category is not None else F.lit("Q")).isin("A", "B"), ADD_AB).otherwise(ADD_C)
    p = filled_quotes.agg(F.count(F.lit(1)).alias("quotes"), n.alias("fills"), F.coalesce(per(F.when(F.col("spread") > 0, g / (F.col("spread") / 2.0)).otherwise(0.0)), F.lit(0.0)).alias("hs"), F.coalesce(per(g / 10000.0), F.lit(0.0)).alias("dollars"), F.coalesce(per(rebate), F.lit(0.0)).alias("by_tape"))
    return p.select("quotes", "fills", F.round(F.col("fills") / F.col("quotes"), 6).alias("fill_rate"), F.round("hs", 6).alias("gross_halfspreads"), F.round("dollars", 8).alias("gross_dollars"), F.round(F.col("dollars") + ADD_C, 8).alias("net_base"), F.round(F.col("dollars") + ADD_TOP, 8).alias("net_top"), F.round(F.col("dollars") + F.col("by_tape"), 8).alias("net_by_tape"))
