"""Microstructure aggregates: flow by symbol, lifetimes, sizes, spread and depth by minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.operators.tape import CLOSE_NS, OPEN_NS, TICK_TYPES

#: Two histogram buckets per decade; edges come from repeated multiplication by this fixed value.
STEP = 3.1622776601683795
LIFETIMES, FILL_TIMES = (1.0, 24), (1e6, 12)


def edges(first: float, n: int) -> list[float]:
    out = [first]
    for _ in range(n):
        out.append(out[-1] * STEP)
    return out


def log_bucket(ns: Column, first: float, n: int) -> Column:
    """The bucket of a duration: how many of the inner edges it has reached."""
    return sum((F.when(ns.cast("double") >= e, 1).otherwise(0) for e in edges(first, n)[1:n]), F.lit(0))


def low(bucket: Column, first: float, n: int) -> Column:
    return F.element_at(F.array(*map(F.lit, edges(first, n))), (bucket + 1).cast("int"))


def exits(eps: DataFrame) -> DataFrame:
    """Removed orders with exit and life_ns."""
    gone = eps.filter("end_by is not null and end_by <> 'duplicate'")
    by = F.col("end_by")
    exit_ = F.when(by == "U", "replaced").when(by.isin("E", "C") & (F.col("executed") == F.col("shares0")), "filled").when(by.isin("E", "C") | (F.col("executed") > 0), "partial_then_gone").otherwise("cancelled")
    return gone.select("ref", "locate", exit_.alias("exit"), F.greatest(F.lit(0), F.col("end_ts") - F.col("start_ts")).alias("life_ns"))


def lifetimes(eps: DataFrame) -> DataFrame:
    """exit, bucket, low_ns, n."""
    b = log_bucket(F.col("life_ns"), *LIFETIMES)
    return exits(eps).groupBy("exit", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).withColumn("low_ns", low(F.col("bucket"), *LIFETIMES))


def exit_shares(hist: DataFrame) -> DataFrame:
    """Share of each exit and of lives under a second."""
    total = F.sum("n")
    share = lambda e: (100.0 * F.coalesce(F.sum(F.when(F.col("exit") == e, F.col("n"))), F.lit(0)) / total)
    return hist.agg(total.alias("removed"), share("cancelled").alias("pct_cancelled"), share("replaced").alias("pct_replaced"), share("filled").alias("pct_filled"), share("partial_then_gone").alias("pct_partial"), (100.0 * F.coalesce(F.sum(F.when(F.col("low_ns") < 1e9, F.col("n"))), F.lit(0)) / total).alias("pct_under_1s"))


def median_of_histogram(hist: DataFrame, key: str, first: float, n: int, within: bool) -> DataFrame:
    """key, median: of bucket counts (key, bucket, n). The first bucket that half of the mass reaches: its geometric middle, or (within) interpolated on the log scale inside it."""
    run = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.select(key, "bucket", "n", (F.sum("n").over(run) / F.sum("n").over(Window.partitionBy(key))).alias("cum"))
    h = h.withColumn("below", F.coalesce(F.lag("cum").over(Window.partitionBy(key).orderBy("bucket")), F.lit(0.0)))
    h = h.filter("cum >= 0.5 and below < 0.5")
    lo, hi = low(F.col("bucket"), first, n), low(F.col("bucket") + 1, first, n)
    value = lo * F.pow(hi / lo, (0.5 - F.col("below")) / (F.col("cum") - F.col("below"))) if within else F.sqrt(lo * hi)
    return h.select(key, value.alias("median"))


def sizes(tape: DataFrame) -> DataFrame:
    """shares_low, shares_high (null: open), n: sizes of adds and replacements, exact below 1,000, by hundreds below 100,000."""
    q = F.col("qty")
    lo = F.when(q < 1000, q).when(q < 100_000, F.floor(q / 100) * 100).otherwise(100_000)
    s = tape.filter(F.col("mtype").isin("A", "F", "U")).groupBy(lo.cast("long").alias("shares_low")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("shares_low", F.when(F.col("shares_low") < 1000, F.col("shares_low") + 1).when(F.col("shares_low") < 100_000, F.col("shares_low") + 100).alias("shares_high"), "n")


def lots(sizes_: DataFrame) -> DataFrame:
    """Odd, round and mixed lots, the modal size; the open bin is left out."""
    s = sizes_.filter("shares_high is not null")
    total = F.sum("n")
    odd, even = F.sum(F.when(F.col("shares_low") < 100, F.col("n")).otherwise(0)), F.sum(F.when((F.col("shares_low") % 100 == 0) & (F.col("shares_low") > 0), F.col("n")).otherwise(0))
    return s.agg(total.alias("orders"), (100.0 * odd / total).alias("pct_odd"), (100.0 * even / total).alias("pct_round"), (100.0 * (total - odd - even) / total).alias("pct_mixed"), F.max(F.struct("n", (-F.col("shares_low")).alias("s"))).alias("top")).select("orders", "pct_odd", "pct_round", "pct_mixed", (-F.col("top.s")).alias("modal_size"))


def flow(tape: DataFrame, mods: DataFrame) -> DataFrame:
    """locate with the counts and shares of its flow. A replacement counts for its order's symbol, and removes what rests of it."""
    m = tape.select("seq", "locate", "mtype", "qty").join(mods.select("seq", "found", "own_locate", "rests"), "seq", "left")
    m = m.withColumn("locate", F.when((F.col("mtype") == "U") & F.col("found"), F.col("own_locate")).otherwise(F.col("locate")))
    n = lambda *t: F.sum(F.col("mtype").isin(*t).cast("long"))
    shares = lambda *t: F.coalesce(F.sum(F.when(F.col("mtype").isin(*t), F.col("qty"))), F.lit(0))
    return m.groupBy("locate").agg(
        n("A", "F").alias("adds"), n("E", "C").alias("executes"), n("X").alias("cancels"), n("D").alias("deletes"), n("U").alias("replaces"), n("P").alias("trades"),
        shares("A", "F", "U").alias("shares_added"), shares("E", "C").alias("shares_executed"),
        (shares("X") + F.coalesce(F.sum(F.when((F.col("mtype") == "U") & F.col("found"), F.col("rests"))), F.lit(0))).alias("shares_cancelled"), shares("P").alias("shares_nondisplayed"),
    )


def cancel_to_trade(flow_: DataFrame, least_adds: int) -> DataFrame:
    """Quartiles over symbols of removals per execution, with and without replacements."""
    a = flow_.filter((F.col("executes") > 0) & (F.col("adds") >= least_adds))
    ratio, wide = (F.col("deletes") + F.col("cancels")) / F.col("executes"), (F.col("deletes") + F.col("cancels") + F.col("replaces")) / F.col("executes")
    p = lambda x, q: F.percentile(x, F.lit(q))
    return a.agg(F.count(F.lit(1)).alias("symbols"), p(ratio, 0.5).alias("median"), p(ratio, 0.25).alias("p25"), p(ratio, 0.75).alias("p75"), p(wide, 0.5).alias("with_replaces"))


def sample_points(tape: DataFrame, every_ns: int) -> DataFrame:
    """seq, ts_ns: the first message in each cell of a grid anchored at the first message in hours."""
    t = tape.filter(F.col("mtype").isin(TICK_TYPES) & (F.col("ts_ns") >= OPEN_NS) & (F.col("ts_ns") < CLOSE_NS)).select("seq", "ts_ns")
    start = t.agg(F.min("ts_ns").alias("t0"))
    return t.crossJoin(F.broadcast(start)).groupBy(F.floor((F.col("ts_ns") - F.col("t0")) / every_ns).alias("cell")).agg(F.min(F.struct("seq", "ts_ns")).alias("m")).select("m.seq", "m.ts_ns")  # one row on the right


def spread_depth(tape: DataFrame, inside: DataFrame, every_ns: int) -> DataFrame:
    """locate, minute: samples, two-sided ones, mean spread (cents), share of one-cent spreads, mean sizes and orders at the inside."""
    points = sample_points(tape, every_ns)
    symbols = tape.select("locate").distinct()
    asked = symbols.crossJoin(points)  # every symbol is sampled at every point: that is the result's own size
    known = inside.select("locate", "seq", F.struct("bid", "ask", "bid_qty", "ask_qty", "bid_orders", "ask_orders").alias("state"), F.lit(None).cast("long").alias("ts_ns"), F.lit(False).alias("ask_"))
    both = known.unionByName(asked.select("locate", "seq", F.lit(None).cast(known.schema["state"].dataType).alias("state"), "ts_ns", F.lit(True).alias("ask_")))
    w = Window.partitionBy("locate").orderBy("seq", "ask_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = both.withColumn("state", F.last("state", ignorenulls=True).over(w)).filter("ask_").select("locate", F.floor((F.col("ts_ns") - OPEN_NS) / 60_000_000_000).alias("minute"), "state.*").filter("bid is not null and ask is not null")
    good = F.col("ask") > F.col("bid")
    spread = F.floor((F.col("ask") - F.col("bid")) / 100)
    n_good = F.sum(good.cast("long"))
    mean = lambda x: F.coalesce(F.sum(F.when(good, x)), F.lit(0)) / F.greatest(n_good, F.lit(1))
    return s.groupBy("locate", "minute").agg(
        F.count(F.lit(1)).alias("samples"), n_good.alias("two_sided"), F.round(mean(spread), 6).alias("mean_spread"), F.round(mean((spread == 1).cast("long")), 6).alias("one_tick"),
        F.round(mean(F.col("bid_qty")), 6).alias("bid_shares"), F.round(mean(F.col("ask_qty")), 6).alias("ask_shares"), F.round(mean(F.col("bid_orders")), 6).alias("bid_orders"), F.round(mean(F.col("ask_orders")), 6).alias("ask_orders"),
    )


def segments(minutes: DataFrame) -> DataFrame:
    """Means over the session's first and last half hour and midday of the sample-weighted spread per minute, and over the session weighted by symbols."""
    m = minutes.filter("two_sided > 0").groupBy("minute").agg((F.sum(F.col("mean_spread") * F.col("two_sided")) / F.sum("two_sided")).alias("spread"), F.countDistinct("locate").alias("symbols"))
    part = lambda cond: F.round(F.avg(F.when(cond, F.col("spread"))), 6)
    return m.agg(F.max("symbols").alias("symbols"), part(F.col("minute") < 30).alias("open_30min"), part((F.col("minute") >= 150) & (F.col("minute") < 240)).alias("midday"), part(F.col("minute") >= 360).alias("close_30min"), F.round(F.sum(F.col("spread") * F.col("symbols")) / F.sum("symbols"), 6).alias("session"))
