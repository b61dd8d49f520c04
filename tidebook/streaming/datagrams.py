"""Sequenced datagrams: delivery once and in order from lossy, duplicated lines, as a batch and as a stream.

A packet holds messages first .. first + count - 1 of a session. Delivery expects the number after the last it delivered. What lies before it is a duplicate and is trimmed; what was skipped is a
gap, and a late packet for a gap is a duplicate. A heartbeat (count 0) tells the next number: ahead of the expected one, it is a gap too. A packet that is cut short (whole is false) delivers
nothing, but the gap before it counts. The end of the session (count 65535) and packets whose header names another session change nothing. After its first gap a session is stale for good.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECEIVED = "session string, arrival long, outcome string, delivered long, missed long, stale boolean"
END = 65535


def packets(tape: DataFrame, size: int) -> DataFrame:
    """A tape cut into packets on two lines, each losing its own, some of them heartbeats, cut short or of another session: session (symbol), header (the session it names), arrival, first, count, whole."""
    n = F.row_number().over(Window.partitionBy("locate").orderBy("seq"))
    k = tape.select("locate", n.alias("n")).groupBy("locate", F.floor((F.col("n") - 1) / size).alias("k")).agg(F.min("n").cast("long").alias("first"), F.count(F.lit(1)).alias("count"))
    name = F.concat(F.lit("S"), F.col("locate"))
    a = k.filter(F.col("k") % 10 != 3).select(name.alias("session"), name.alias("header"), (2 * F.col("k")).alias("arrival"), "first", F.when(F.col("k") % 17 == 9, 0).otherwise(F.col("count")).alias("count"), F.lit(True).alias("whole"))
    b = k.filter(F.col("k") % 7 != 3).select(name.alias("session"), F.when(F.col("k") % 13 == 6, "X").otherwise(name).alias("header"), (2 * F.col("k") + 5).alias("arrival"), "first", "count", (F.col("k") % 11 != 5).alias("whole"))
    end = k.groupBy("locate").agg((2 * F.max("k") + 7).alias("arrival"), F.max(F.col("first") + F.col("count")).alias("first")).select(name.alias("session"), name.alias("header"), "arrival", "first", F.lit(END).cast("long").alias("count"), F.lit(True).alias("whole"))
    return a.unionByName(b).unionByName(end)


def _outcome(other, count, whole, missed, got) -> str:
    if other:
        return "other_session"
    if count == END:
        return "end_of_session"
    if not whole:
        return "malformed"
    if not count:
        return "gap" if missed else "heartbeat"
    return "duplicate" if not got else "gap" if missed else "trimmed" if got < count else "in_order"


def received(packets_: DataFrame) -> DataFrame:
    """RECEIVED for each packet, in order of arrival: the next expected number is one past the furthest end so far."""
    own, other = F.col("header") == F.col("session"), F.col("header") != F.col("session")
    counts = own & (F.col("count") != END)
    end = F.when(~counts, 0).when(~F.col("whole"), F.col("first") - 1).otherwise(F.col("first") + F.col("count") - 1)
    by = Window.partitionBy("session").orderBy("arrival")
    p = packets_.withColumn("expected", F.coalesce(F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    p = p.withColumns({"missed": F.when(counts, F.greatest(F.lit(0), F.col("first") - F.col("expected"))).otherwise(0), "got": F.when(counts & F.col("whole"), F.greatest(F.lit(0), F.least(F.col("count"), F.col("first") + F.col("count") - F.col("expected")))).otherwise(0)})
    outcome = F.when(other, "other_session").when(F.col("count") == END, "end_of_session").when(~F.col("whole"), "malformed").when(F.col("count") == 0, F.when(F.col("missed") > 0, "gap").otherwise("heartbeat")).when(F.col("got") == 0, "duplicate").when(F.col("missed") > 0, "gap").when(F.col("got") < F.col("count"), "trimmed").otherwise("in_order")
    stale = F.max(F.col("missed") > 0).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return p.select("session", "arrival", outcome.alias("outcome"), F.col("got").cast("long").alias("delivered"), F.col("missed").cast("long").alias("missed"), stale.alias("stale"))


def stream(packets_: DataFrame) -> DataFrame:
    """The same on a stream of packets: the expected number, and whether there was a gap, are each session's state."""

    def receive(key, frames, state):
        expected, stale = state.get if state.exists else (1, False)
        rows = []
        for f in frames:
            for arrival, header, first, count, whole in f.sort_values("arrival")[["arrival", "header", "first", "count", "whole"]].itertuples(index=False):
                counts = header == key[0] and count != END
                missed = max(0, first - expected) if counts else 0
                got = max(0, min(count, first + count - expected)) if counts and whole else 0
                stale = bool(stale or missed)
                rows.append((key[0], arrival, _outcome(header != key[0], count, whole, missed, got), got, missed, stale))
                if counts:
                    expected = max(expected, first + count if whole else first)
        state.update((int(expected), bool(stale)))
        yield pd.DataFrame(rows, columns=["session", "arrival", "outcome", "delivered", "missed", "stale"])

    return packets_.groupBy("session").applyInPandasWithState(receive, RECEIVED, "expected long, stale boolean", "append", "NoTimeout")
