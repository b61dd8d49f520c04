"""Feature windows: a fixed number of inside updates of a symbol, without overlap, labelled by the next window's move.

An update's number among its symbol's updates fixes its window, (k - 1) div N; what happens between updates belongs to the window that is open, k div N.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.operators.census import busiest
from tidebook.operators.tape import CLOSE_NS, OPEN_NS, TICK_TYPES

FEATURES = ["ofi", "queue_imbalance", "micro_dev", "trade_sign"]


def touches(tape: DataFrame, inside: DataFrame, mods: DataFrame, n: int) -> DataFrame:
    """Every touch and trading action with its window: previous and present inside, update flag, order-flow term, signed and total executed shares."""
    found = mods.filter(F.col("mtype").isin("E", "C")).select("seq", F.when(F.col("found"), F.when(F.col("own_side") == "B", -1).otherwise(1)).otherwise(0).alias("sign"))
    m = tape.filter(F.col("mtype").isin(*TICK_TYPES, "H")).select("seq", "locate", "ts_ns", "mtype", "qty", "code")
    m = m.join(inside.select("seq", "bid", "ask", "bid_qty", "ask_qty"), "seq").join(found, "seq", "left")
    valid = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    by = Window.partitionBy("locate").orderBy("seq")
    # trading actions aren't touches: the previous inside is that of the previous touch
    touch = F.col("mtype") != "H"
    m = m.withColumn("now", F.when(valid & touch, F.struct("bid", "ask", "bid_qty", "ask_qty"))).withColumn("touch", touch)
    m = m.withColumn("before", F.when(touch, F.lag("now").over(Window.partitionBy("locate", "touch").orderBy("seq"))))
    changed = ~((F.col("now.bid") == F.col("before.bid")) & (F.col("now.ask") == F.col("before.ask")) & (F.col("now.bid_qty") == F.col("before.bid_qty")) & (F.col("now.ask_qty") == F.col("before.ask_qty")))
    m = m.withColumn("update", F.coalesce(F.col("now").isNotNull() & F.col("before").isNotNull() & changed, F.lit(False)))
    e = lambda cond, x: F.when(cond, x).otherwise(0)
    flow = e(F.col("now.bid") >= F.col("before.bid"), F.col("now.bid_qty")) - e(F.col("now.bid") <= F.col("before.bid"), F.col("before.bid_qty")) - e(F.col("now.ask") <= F.col("before.ask"), F.col("now.ask_qty")) + e(F.col("now.ask") >= F.col("before.ask"), F.col("before.ask_qty"))
    m = m.withColumn("e", F.when(F.col("update"), flow)).withColumn("depth", F.when(F.col("update"), (F.col("now.bid_qty") + F.col("now.ask_qty")) / 2.0))
    m = m.withColumn("k", F.sum(F.col("update").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    k_before = F.col("k") - F.col("update").cast("long")
    halted = F.last(F.when(F.col("mtype") == "H", F.col("code")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == "H"
    executed = F.col("mtype").isin("E", "C")
    return m.withColumns({
        "wid": F.expr(f"(k - cast(update as bigint)) div {n}"),
        "last_of": F.col("update") & (F.col("k") % n == 0),
        "stained": (F.col("mtype") == "H") | (F.col("update") & F.coalesce(halted, F.lit(False))),
        "signed": F.when(executed, F.col("sign") * F.col("qty")).otherwise(0),
        "total": F.when(executed, F.col("qty")).otherwise(0),
        "nth": k_before % n,
    })


def closed(touched: DataFrame, n: int, lag1: bool = False) -> DataFrame:
    """locate, wid: every full window at its close, with features and whether it is usable. lag1: order flow and imbalance as of one update earlier."""
    last = F.max(F.when(F.col("last_of"), F.struct("seq", "ts_ns", "now", "before", "e", "depth")))
    w = touched.groupBy("locate", "wid").agg(
        last.alias("last"), F.sum("e").alias("flow"), F.sum("depth").alias("depth"), F.sum("signed").alias("signed"), F.sum("total").alias("total"), F.max(F.col("stained").cast("int")).alias("stained"), F.min(F.when(F.col("update"), F.col("ts_ns"))).alias("start_ts"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    ).filter("last is not null")
    bid, ask, qb, qa = (F.col(f"last.now.{x}") for x in ("bid", "ask", "bid_qty", "ask_qty"))
    mid, spread, q = (bid + ask) / 2.0, ask - bid, qb + qa
    usable = (F.col("start_ts") >= OPEN_NS) & (F.col("last.ts_ns") < CLOSE_NS) & (F.col("stained") == 0) & (q > 0) & (spread > 0)
    count, flow, depth, at = (n - 1, F.col("flow") - F.col("last.e"), F.col("depth") - F.col("last.depth"), "before") if lag1 else (n, F.col("flow"), F.col("depth"), "now")
    mean_depth = depth / count if count else F.lit(0.0)
    fb, fa = F.col(f"last.{at}.bid_qty"), F.col(f"last.{at}.ask_qty")
    return w.select(
        "locate", "wid", F.col("last.seq").alias("close_seq"), F.col("last.ts_ns").alias("close_ts"), usable.alias("usable"),
        F.when(mean_depth > 0, flow / mean_depth).otherwise(0.0).alias("ofi"), F.when(fb + fa > 0, (fb - fa) / (fb + fa)).otherwise(0.0).alias("queue_imbalance"),
        F.when(q > 0, ((qa * bid + qb * ask) / q - mid) / 100.0).otherwise(0.0).alias("micro_dev"), F.when(F.col("total") > 0, F.col("signed") / F.col("total")).otherwise(0.0).alias("trade_sign"),
        mid.alias("mid"), spread.alias("spread"), bid.alias("bid"), ask.alias("ask"), qb.alias("bid_qty"), qa.alias("ask_qty"), "first_seq", "last_seq",
    )


def labelled(windows: DataFrame) -> DataFrame:
    """Rows of two usable windows in a row: the features of the first, the move to the second."""
    by = Window.partitionBy("locate").orderBy("wid")
    nxt = windows.withColumns({"n_wid": F.lead("wid").over(by), "n_usable": F.lead("usable").over(by), "n_mid": F.lead("mid").over(by), "n_seq": F.lead("close_seq").over(by), "n_first": F.lead("first_seq").over(by)})
    rows = nxt.filter("usable and n_usable and n_wid = wid + 1")
    label = F.col("n_mid") - F.col("mid")
    return rows.select("locate", "wid", "close_seq", "close_ts", "n_seq", F.col("last_seq").alias("feat_last_msg"), F.col("n_first").alias("label_first_msg"), F.col("n_seq").alias("label_last_msg"), *FEATURES, (F.col("mid") / 10000.0).alias("mid"), (F.col("spread") / 100.0).alias("spread_ticks"), (label / 100.0).alias("label_ticks"), (label / (F.col("spread") / 2.0)).alias("label_halfspreads"))


def of_universe(features: DataFrame, tape: DataFrame, n: int) -> DataFrame:
    """The rows of the n busiest symbols (n is bounded: a universe)."""
    return features.join(F.broadcast(busiest(tape, n).select("locate")), "locate", "left_semi")
