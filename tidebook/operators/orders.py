"""Order episodes: the life of each resting order, from set operations alone.

A reference's rows, its starts (adds, and replacements that name it as the new reference) and the messages that modify it, are ordered by seq; the number of starts so far is its
episode. Within an episode a running sum of reductions tells what rests before each message, hence which messages find a live order. A replacement's episode exists only if the old
order was alive: each is linked to the one it replaces, and the links are followed to the add at their root in rounds that double the distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REDUCE = ["E", "C", "X"]


def reference_rows(tape: DataFrame) -> DataFrame:
    """A row for each start and each modification: ref, seq, episode, what rests before it, and whether it finds its order alive (if the episode exists)."""
    add = F.col("mtype").isin("A", "F")
    common = ["seq", "ts_ns", "mtype", "locate", "qty"]
    starts = tape.filter(add).select("ref", *common, "side", "price", F.lit(1).alias("start"), F.lit(None).cast("long").alias("old_ref"))
    again = tape.filter("mtype = 'U'").select(F.col("new_ref").alias("ref"), *common, F.lit(None).cast("string").alias("side"), "price", F.lit(1).alias("start"), F.col("ref").alias("old_ref"))
    mods = tape.filter(F.col("mtype").isin(*REDUCE, "D", "U")).select("ref", *common, F.lit(None).cast("string").alias("side"), F.lit(None).cast("long").alias("price"), F.lit(0).alias("start"), F.lit(None).cast("long").alias("old_ref"))
    rows = starts.unionByName(again).unionByName(mods)
    by_ref = Window.partitionBy("ref").orderBy("seq", F.col("start").desc())
    rows = rows.withColumn("episode", F.sum("start").over(by_ref.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = Window.partitionBy("ref", "episode").orderBy("seq", F.col("start").desc())
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    reduces = (F.col("start") == 0) & F.col("mtype").isin(*REDUCE)
    rows = rows.withColumns({
        "shares0": F.first(F.when(F.col("start") == 1, F.col("qty")), ignorenulls=True).over(own),
        "gone": F.coalesce(F.sum(F.when(reduces, F.col("qty"))).over(before), F.lit(0)),
        "n_reduced": F.coalesce(F.sum(reduces.cast("int")).over(before), F.lit(0)),
        "ended": F.coalesce(F.max(((F.col("start") == 0) & F.col("mtype").isin("D", "U")).cast("int")).over(before), F.lit(0)),
    })
    alive = (F.col("episode") > 0) & F.col("ref").isNotNull() & (F.col("ended") == 0) & ((F.col("n_reduced") == 0) | (F.col("gone") < F.col("shares0")))
    return rows.withColumn("alive", (F.col("start") == 0) & F.coalesce(alive, F.lit(False))).withColumn("rests", F.greatest(F.lit(0), F.col("shares0") - F.col("gone")))


def rooted(rows: DataFrame, rounds: int | None = None) -> DataFrame:
    """The episodes that exist: ref, episode, locate, side, price, shares0, start_seq, start_ts, via (A, F or U). rounds: how often links are doubled; None: until all lead to an add."""
    starts = rows.filter("start = 1")
    adds = starts.filter("mtype <> 'U'").select("ref", "episode", "locate", "side", "price", F.col("qty").alias("shares0"), F.col("seq").alias("start_seq"), F.col("ts_ns").alias("start_ts"), F.col("mtype").alias("via"))
    child = starts.filter("mtype = 'U'").select("ref", "episode", "price", F.col("qty").alias("shares0"), F.col("seq").alias("start_seq"), F.col("ts_ns").alias("start_ts"), "old_ref")
    parent = rows.filter("start = 0 and mtype = 'U' and alive").select(F.col("ref").alias("up_ref"), F.col("episode").alias("up_episode"), F.col("seq").alias("start_seq"))
    child = child.join(parent, (child.old_ref == parent.up_ref) & (child.start_seq == parent.start_seq)).select(child["*"], "up_ref", "up_episode").drop("old_ref")
    k = 0
    while rounds is None or k < rounds:
        up = child.select(F.col("ref").alias("r"), F.col("episode").alias("e"), F.col("up_ref").alias("next_ref"), F.col("up_episode").alias("next_episode"))
        open_links = child.join(up, (F.col("up_ref") == F.col("r")) & (F.col("up_episode") == F.col("e")), "left")
        if rounds is None and open_links.filter("r is not null").isEmpty():
            break
        child = open_links.withColumn("up_ref", F.coalesce("next_ref", "up_ref")).withColumn("up_episode", F.coalesce("next_episode", "up_episode")).drop("r", "e", "next_ref", "next_episode")
        k += 1
    root = adds.select(F.col("ref").alias("up_ref"), F.col("episode").alias("up_episode"), "locate", "side")
    replaced = child.join(root, ["up_ref", "up_episode"]).select("ref", "episode", "locate", "side", "price", "shares0", "start_seq", "start_ts", F.lit("U").alias("via"))
    return adds.unionByName(replaced)


def modifications(rows: DataFrame, eps: DataFrame) -> DataFrame:
    """rows: reference_rows(), eps: rooted(). Every E, C, X, D and U with what it found: found (is there a live order), own_* of that order, rests, taken, over, emptied."""
    mods = rows.filter("start = 0").select("ref", "episode", "seq", "ts_ns", "mtype", "locate", "qty", "alive", "rests")
    own = eps.select("ref", "episode", F.col("locate").alias("own_locate"), F.col("side").alias("own_side"), F.col("price").alias("own_price"), "start_seq", "start_ts", "shares0")
    mods = mods.join(own, ["ref", "episode"], "left").withColumn("found", F.coalesce(F.col("alive") & F.col("start_seq").isNotNull(), F.lit(False)))
    reduces = F.col("mtype").isin(*REDUCE)
    mods = mods.withColumn("taken", F.when(F.col("found"), F.when(reduces, F.least("qty", "rests")).otherwise(F.col("rests"))))
    return mods.withColumns({"over": F.coalesce(F.col("found") & reduces & (F.col("qty") > F.col("rests")), F.lit(False)), "emptied": F.coalesce(F.col("found") & reduces & (F.col("qty") >= F.col("rests")), F.lit(False))})


def episodes(mods: DataFrame, eps: DataFrame) -> DataFrame:
    """mods: modifications(), eps: rooted(). The episodes with end_seq, end_ts, end_by (null: still live), executed, cancelled, remaining."""
    last = mods.filter("found").groupBy("ref", "episode").agg(
        F.max(F.when(F.col("emptied") | F.col("mtype").isin("D", "U"), F.struct("seq", "ts_ns", "mtype"))).alias("end"),
        F.sum(F.when(F.col("mtype").isin("E", "C"), F.col("taken")).otherwise(0)).alias("executed"),
        F.sum(F.when(F.col("mtype") == "X", F.col("taken")).otherwise(0)).alias("cancelled"),
    )
    eps = eps.join(last, ["ref", "episode"], "left")
    after = F.lead("start_seq").over(Window.partitionBy("ref").orderBy("episode"))
    after_ts = F.lead("start_ts").over(Window.partitionBy("ref").orderBy("episode"))
    eps = eps.withColumns({"_next": after, "_next_ts": after_ts}).withColumn("end", F.when(F.col("end").isNotNull(), F.col("end")).when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("seq"), F.col("_next_ts").alias("ts_ns"), F.lit("duplicate").alias("mtype"))))
    return eps.select(
        "ref", "episode", "locate", "side", "price", "shares0", "start_seq", "start_ts", "via",
        F.col("end.seq").alias("end_seq"), F.col("end.ts_ns").alias("end_ts"), F.col("end.mtype").alias("end_by"),
        F.coalesce("executed", F.lit(0)).alias("executed"), F.coalesce("cancelled", F.lit(0)).alias("cancelled"),
    ).withColumn("remaining", F.when(F.col("end_by").isNull(), F.col("shares0") - F.col("executed") - F.col("cancelled")).otherwise(F.lit(0)))


def effects(tape: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """modifications() and episodes() of a tape."""
    rows = reference_rows(tape)
    roots = rooted(rows, rounds)
    mods = modifications(rows, roots)
    return mods, episodes(mods, roots)


def deltas(mods: DataFrame, eps: DataFrame) -> DataFrame:
    """What each message changes at its level: locate, side, price, seq, ts_ns, shares, orders (signed)."""
    born = eps.select("locate", "side", "price", F.col("start_seq").alias("seq"), F.col("start_ts").alias("ts_ns"), F.col("shares0").alias("shares"), F.lit(1).alias("orders"))
    gone = F.when(F.col("emptied") | F.col("mtype").isin("D", "U"), -1).otherwise(0)
    less = mods.filter("found").select(F.col("own_locate").alias("locate"), F.col("own_side").alias("side"), F.col("own_price").alias("price"), "seq", "ts_ns", (-F.col("taken")).alias("shares"), gone.alias("orders"))
    twice = eps.filter("end_by = 'duplicate'").select("locate", "side", "price", F.col("end_seq").alias("seq"), F.col("end_ts").alias("ts_ns"), (F.col("executed") + F.col("cancelled") - F.col("shares0")).alias("shares"), F.lit(-1).alias("orders"))
    return born.unionByName(less).unionByName(twice)
