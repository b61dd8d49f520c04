"""A message tape derived from the events table: one message for each event, in feed semantics.

Columns: seq, locate, ts_ns, mtype, ref, new_ref, side, price, qty, stock, code, match, market. `plain` has the seven book-changing types; `full` turns some adds
into trading actions, operational halts, trades, crosses and priced executions, and lets prices cross. `session` is `plain` with what a whole session has besides: modifications that name
replacements (chains of them), references that are used again, dead or live, system events, a directory, trades at fractions of a cent, halts of which some are of another market, and messages after the end of hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SYMBOLS = 8
OPEN_NS, CLOSE_NS = 34_200_000_000_000, 57_600_000_000_000
BOOK_TYPES = ["A", "F", "E", "C", "X", "D", "U"]
TICK_TYPES = ["A", "F", "E", "C", "X", "D", "U", "P", "Q", "B"]
COMPARED_TYPES = ["S", "R", "H", "h", *TICK_TYPES]
ALL_TYPES = list("SRHYLVWKJhAFECXDUPQBINO")
NEW_REF = 1_000_000_000


def _type(c: Column, kind: Column, full: bool) -> Column:
    error = F.when(c % 4 == 0, "X").when(c % 4 == 3, "U").otherwise("D")
    if not full:
        return F.when(kind.isin("view", "purchase"), "A").when(kind == "signup", "F").when(kind == "click", "E").otherwise(error)
    view = F.when(c % 23 == 0, "P").when(c % 23 == 1, "Q").when(c % 23 == 2, "H").when(c % 23 == 3, "h").when(c % 23 == 4, "B").otherwise("A")
    return F.when(kind == "view", view).when(kind == "purchase", "A").when(kind == "signup", "F").when(kind == "click", F.when(c % 7 == 0, "C").otherwise("E")).otherwise(error)


def _session_type(c: Column, kind: Column) -> Column:
    """Few halts and trades, so that most windows live."""
    view = F.when(c % 101 == 0, "P").when(c % 503 == 1, "H").when(c % 503 == 2, "h").otherwise("A")
    return F.when(kind == "view", view).otherwise(_type(c, kind, False))


def _frame(n: Column) -> Column:
    """The messages around those of n events, whose seqs are even: (seq, locate, ts_ns, mtype, stock, code)."""
    row = lambda seq, locate, ts, kind, stock, code: F.struct(seq.cast("long").alias("seq"), F.lit(locate).alias("locate"), F.lit(ts).cast("long").alias("ts_ns"), F.lit(kind).alias("mtype"), F.lit(stock).cast("string").alias("stock"), F.lit(code).cast("string").alias("code"))
    head = [row(F.lit(1), 0, OPEN_NS - 4, "S", None, "O"), *[row(F.lit(1 + k), k, OPEN_NS - 3, "R", f"SYM{k}", "Q") for k in range(1, SYMBOLS)], row(F.lit(10), 0, OPEN_NS - 2, "S", None, "S"), row(F.lit(11), 0, OPEN_NS - 1, "S", None, "Q")]  # the last symbol has no entry
    tail = [row(2 * n - 79, 0, CLOSE_NS, "S", None, "M"), row(2 * n - 39, 0, CLOSE_NS + 1, "S", None, "E"), row(2 * n + 31, 1, CLOSE_NS + 2, "R", "SYM1B", "Q"), row(2 * n + 33, 0, CLOSE_NS + 3, "S", None, "C")]
    return F.array(*head, *tail)


def tape(spark: SparkSession, sf_dir: str, variant: str = "plain") -> DataFrame:
    full, session = variant == "full", variant == "session"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    c = F.round(F.col("value") * 100).cast("long")
    e = e.select(
        (2 * F.col("event_id") + 20 if session else F.col("event_id") + 1).alias("seq"),
        (F.col("user_id") % SYMBOLS + 1).cast("int").alias("locate"),
        (F.lit(OPEN_NS) + F.expr("(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01', cast(ts AS TIMESTAMP_NTZ)) * 13000) div 1440")).alias("ts_ns"),
        c.alias("c"),
        (_session_type(c, F.col("event_type")) if session else _type(c, F.col("event_type"), full)).alias("mtype"),
    )
    add = F.col("mtype").isin("A", "F")
    before = Window.partitionBy("locate").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("nb", F.coalesce(F.sum(add.cast("long")).over(before), F.lit(0)))
    wants = F.col("mtype").isin("E", "C", "X", "D", "U") & (F.col("nb") > 0)
    e = e.withColumn("target", F.when(wants, F.col("nb") - F.col("c") % F.least(F.col("nb"), F.lit(20))))
    e = e.withColumn("own", F.col("seq"))
    if session:  # some adds use the reference of an earlier one again
        again = F.when(add & (F.col("c") % 13 == 0) & (F.col("nb") > 40), F.col("nb") - 30 - F.col("c") % 5)
        first = e.filter(add).select(F.col("locate").alias("l"), (F.col("nb") + 1).alias("k"), F.col("seq").alias("used"))
        e = e.withColumn("again", again).join(first, (F.col("locate") == F.col("l")) & (F.col("again") == F.col("k")), "left").drop("l", "k", "again").withColumn("own", F.coalesce("used", "own")).drop("used")
    # the add that a modify names is the target-th of its symbol
    named = e.filter(add).select(F.col("locate").alias("l"), (F.col("nb") + 1).alias("k"), F.col("own").alias("named"), (F.col("c") % 2 == 0).alias("named_bid"))
    e = e.join(named, (F.col("locate") == F.col("l")) & (F.col("target") == F.col("k")), "left").drop("l", "k")
    if session:  # some modifications name one of the symbol's last replacements
        e = e.withColumn("nu", F.coalesce(F.sum((F.col("mtype") == "U").cast("long")).over(before), F.lit(0)))
        chained = F.when(wants & (F.col("c") % 5 < 3) & (F.col("nu") > 0), F.col("nu") - F.col("c") % F.least(F.col("nu"), F.lit(4)))
        new = e.filter("mtype = 'U'").select(F.col("locate").alias("l"), (F.col("nu") + 1).alias("k"), (F.col("seq") + NEW_REF).alias("renamed"))
        e = e.withColumn("chained", chained).join(new, (F.col("locate") == F.col("l")) & (F.col("chained") == F.col("k")), "left").drop("l", "k", "chained", "nu").withColumn("named", F.coalesce("renamed", "named")).drop("renamed")
    half = F.floor(F.col("c") / 2)
    bid = F.when(F.col("mtype") == "U", F.coalesce("named_bid", F.lit(True))).otherwise(F.col("c") % 2 == 0)  # a replacement stays on its order's side
    if full:
        price = F.when(bid, 1_000_000 + 100 * (half % 9 - 5)).otherwise(1_000_000 + 100 * (half % 9 - 3))
    else:
        price = F.when(bid, 1_000_000 - 100 * (half % 5)).otherwise(1_000_100 + 100 * (half % 5))
    code = F.when(F.col("mtype") == "H", F.element_at(F.array(*map(F.lit, "HPQT")), (F.floor(F.col("c") / 23) % 4 + 1).cast("int"))).when(F.col("mtype") == "h", F.when(F.floor(F.col("c") / 23) % 2 == 0, "H").otherwise("T")).when(F.col("mtype") == "Q", F.element_at(F.array(*map(F.lit, "OCHI")), (F.floor(F.col("c") / 23) % 4 + 1).cast("int")))
    price = price + F.when(F.col("mtype") == "P", F.col("c") % 3 * 25).otherwise(0) if session else price
    out = e.select(
        "seq",
        "locate",
        "ts_ns",
        "mtype",
        F.when(add, F.col("own")).otherwise(F.col("named")).alias("ref"),
        F.when(F.col("mtype") == "U", F.col("seq") + NEW_REF).alias("new_ref"),
        F.when(add, F.when(F.col("c") % 2 == 0, "B").otherwise("S")).alias("side"),
        F.when(add | F.col("mtype").isin("U", "P", "C", "Q"), price.cast("long")).alias("price"),
        F.when(~F.col("mtype").isin("D", "H", "h", "B"), F.when(F.col("mtype") == "Q", 100 * (F.floor(F.col("c") / 10) % 3)).otherwise(100 * (1 + F.floor(F.col("c") / 10) % 7))).cast("long").alias("qty"),
        F.concat(F.lit("SYM"), F.col("locate")).alias("stock"),
        code.alias("code"),
        F.col("c").alias("match"),
        F.when(F.col("mtype") == "h", F.when(F.lit(session) & (F.floor(F.col("c") / 46) % 2 == 0), "B").otherwise("Q")).alias("market"),
    )
    if not session:
        return out
    around = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.explode(_frame(F.col("n"))).alias("x")).select("x.*")  # a dozen rows
    return out.unionByName(around, allowMissingColumns=True)
