"""Synthetic passive orders under five models of the queue.

A placement joins the inside of a symbol's side after a message. What can move it are the events of its side at its price, and the first execution at a worse price. Events and placements
of a symbol's side meet in one task, as arrays in order; each placement is a range of its level's events, and the models walk all ranges at once, an event of each at a time. No pair of a
placement and an event is ever a row. A range ends where the order's life does, and, for fills, at the first execution at a worse price, since that fills the order anyway.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.functions.draws import drawn
from tidebook.operators.levels import FAR
from tidebook.operators.micro import FILL_TIMES, log_bucket, low
from tidebook.operators.tape import TICK_TYPES

MODELS = ["exact", "conservative", "optimistic", "proportional", "bernoulli"]
#: Edges of the reporting buckets and of the fine grid, in shares ahead at entry.
DEPTH_EDGES = [0, 100, 500, 2000, 10000, 50000]
AHEAD_EDGES = [0, 1, 50, 100, 200, 300, 500, 800, 1200, 2000, 3000, 5000, 8000, 12000, 20000, 35000, 60000, 100000]
HORIZONS_S = [1, 10, 60]


def edge_bucket(x: Column, edges: list[int]) -> Column:
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0))


def placements(inside: DataFrame, every: int) -> DataFrame:
    """One at each every-th message whose symbol is two-sided, bids and offers in turn: seq (its name), locate, ts_ns, side, price, depth, spread."""
    buy = F.col("turn") % 2 == 0
    p = inside.filter((F.col("seq") % every == 0) & F.col("bid").isNotNull() & F.col("ask").isNotNull()).withColumn("turn", F.col("seq") / every)
    return p.select("seq", "locate", "ts_ns", F.when(buy, "B").otherwise("S").alias("side"), F.when(buy, F.col("bid")).otherwise(F.col("ask")).alias("price"), F.when(buy, F.col("bid_qty")).otherwise(F.col("ask_qty")).alias("depth"), (F.col("ask") - F.col("bid")).alias("spread"))


def first_tick(due: DataFrame, tape: DataFrame, bucket_ns: int = 60_000_000_000, least_seq: bool = False) -> DataFrame:
    """due: id, due_ts. With tick_seq: the first message of any symbol at or after due_ts in order of time (least_seq: in order of seq, should time run back); null: none. Looks in the
    due bucket by a window over its messages and what is due, then at the later buckets by one row of each."""
    t = tape.filter(F.col("mtype").isin(TICK_TYPES)).groupBy(F.col("ts_ns").alias("at_ts")).agg(F.min("seq").alias("seq")).withColumn("bucket", F.expr(f"at_ts div {bucket_ns}"))
    heads = t.groupBy("bucket").agg((F.min("seq") if least_seq else F.min_by("seq", "at_ts")).alias("head"))  # a row for each bucket of time
    d = due.select("id", "due_ts", F.expr(f"due_ts div {bucket_ns}").alias("bucket"))
    both = t.select("bucket", "at_ts", "seq", F.lit(None).cast(due.schema["id"].dataType).alias("id")).unionByName(d.select("bucket", F.col("due_ts").alias("at_ts"), F.lit(None).cast("long").alias("seq"), "id"))
    after = Window.partitionBy("bucket").orderBy(F.desc("at_ts"), F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("own", (F.min("seq") if least_seq else F.last("seq", ignorenulls=True)).over(after)).filter("id is not null")
    asked = d.select("bucket").distinct().unionByName(heads.select("bucket")).distinct()
    rest = Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    later = asked.join(heads, "bucket", "left").withColumn("next", (F.min("head") if least_seq else F.first("head", ignorenulls=True)).over(rest)).select("bucket", "next")
    return own.join(later, "bucket", "left").select("id", F.col("at_ts").alias("due_ts"), (F.least("own", "next") if least_seq else F.coalesce("own", "next")).alias("tick_seq"))


def events(mods: DataFrame, states: DataFrame, tape: DataFrame) -> DataFrame:
    """What can move a placement: kind (exec, cancel), its raw quantity, price, when its order came, and the level's shares after it. And prints (kind print)."""
    m = mods.filter("found")
    kind = F.when(F.col("mtype").isin("E", "C"), "exec").otherwise("cancel")
    qty = F.when(F.col("mtype").isin("E", "C", "X"), F.col("qty")).otherwise(F.col("rests"))
    e = m.select("seq", "ts_ns", F.col("own_locate").alias("locate"), F.col("own_side").alias("side"), F.col("own_price").alias("price"), kind.alias("kind"), qty.alias("qty"), "start_seq")
    after = states.select("locate", "side", "price", "seq", F.col("shares").alias("after"))
    e = e.join(after, ["locate", "side", "price", "seq"], "left")
    prints = tape.filter("mtype = 'P'").select("seq", "ts_ns", "locate", F.explode(F.array(F.lit("B"), F.lit("S"))).alias("side"), "price", F.lit("print").alias("kind"), "qty", F.lit(None).cast("long").alias("start_seq"), F.lit(None).cast("long").alias("after"))
    return e.unionByName(prints)


def alive(placed: DataFrame, tape: DataFrame, life_ns: int) -> DataFrame:
    """placed, with last_seq: the message at which the order's life ends, its own fills included (FAR: none)."""
    ends = first_tick(placed.select(F.col("seq").alias("id"), (F.col("ts_ns") + life_ns).alias("due_ts")), tape, least_seq=True)
    return placed.join(ends.select(F.col("id").alias("seq"), F.coalesce("tick_seq", F.lit(FAR)).alias("last_seq")), "seq")


#: Kinds of rows that meet in a task.
_PLACED, _EXEC, _CANCEL, _PRINT = range(4)


def _met(placed: DataFrame, moved: DataFrame):
    """Placements (shares ahead in qty, last_seq in start_seq, spread in after) and events, by symbol and side."""
    kind = F.when(F.col("kind") == "exec", _EXEC).when(F.col("kind") == "cancel", _CANCEL).otherwise(_PRINT)
    p = placed.select("locate", "side", F.lit(_PLACED).alias("kind"), "seq", "ts_ns", "price", F.col("depth").alias("qty"), F.col("last_seq").alias("start_seq"), F.col("spread").alias("after"))
    return p.unionByName(moved.select("locate", "side", kind.alias("kind"), "seq", "ts_ns", "price", "qty", "start_seq", "after")).groupBy("locate", "side")


def _longs(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _doubles(rows: pa.Table, name: str) -> np.ndarray:
    """No number for null."""
    return rows[name].combine_chunks().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


class _Side:
    """The placements of a symbol's side, and its events by price and then seq."""

    def __init__(self, rows: pa.Table) -> None:
        kind = _longs(rows, "kind")
        rows = rows.append_column("k", pa.array(kind))
        placed, events = rows.filter(pa.array(kind == _PLACED)), rows.filter(pa.array(kind != _PLACED))
        self.placed = placed = placed.sort_by("seq")
        self.seq, self.price, self.depth, self.last = _longs(placed, "seq"), _longs(placed, "price"), _doubles(placed, "qty"), _longs(placed, "start_seq")
        events = events.filter(events["price"].is_valid())
        order = np.lexsort((_longs(events, "seq"), _longs(events, "price")))
        events = events.take(pa.array(order))
        self.at, self.at_ts, self.at_price, self.start, self.kind = (_longs(events, c) for c in ("seq", "ts_ns", "price", "start_seq", "k"))
        self.qty, self.after = _doubles(events, "qty"), _doubles(events, "after")
        self.buy = len(placed) > 0 and placed["side"][0].as_py() == "B"
        # a level's events, and those up to a seq, by one search in a key of price and seq
        self._seqs, self._prices = np.sort(self.at), np.unique(self.at_price)
        self._key = self._place(self.at_price) * (len(self.at) + 1) + np.searchsorted(self._seqs, self.at)
        self.first = self._up_to(self.seq)

    def _place(self, price: np.ndarray) -> np.ndarray:
        return np.searchsorted(self._prices, price)

    def _up_to(self, seq: np.ndarray) -> np.ndarray:
        """For each placement, where its level's events after seq begin (empty levels: a range of none)."""
        known = np.isin(self.price, self._prices)
        return np.where(known, np.searchsorted(self._key, self._place(self.price) * (len(self.at) + 1) + np.searchsorted(self._seqs, seq, "right")), 0)

    def until(self, seq: np.ndarray) -> np.ndarray:
        return np.maximum(self.first, self._up_to(seq))

    def through(self) -> np.ndarray:
        """For each placement, the first execution at a worse price in its life (-1: none). From the last event back, those stay that no earlier one with a price as bad hides."""
        e = np.flatnonzero(self.kind == _EXEC)
        e = e[np.argsort(self.at[e], kind="stable")]
        sign = -1 if self.buy else 1
        bad, at, asked = (sign * self.at_price[e]).tolist(), self.at[e].tolist(), (sign * self.price).tolist()
        out, kept, best, j = np.full(len(self.seq), -1), [], [], len(e) - 1  # best: -bad of kept, ascending
        for i in range(len(self.seq) - 1, -1, -1):
            while j >= 0 and at[j] > self.seq[i]:
                while best and best[-1] >= -bad[j]:
                    best.pop(), kept.pop()
                best.append(-bad[j]), kept.append(j)
                j -= 1
            k = bisect_left(best, -asked[i])
            if k and at[kept[k - 1]] <= self.last[i]:
                out[i] = e[kept[k - 1]]
        return out

    def walk(self, till: np.ndarray, step) -> np.ndarray:
        """Goes through the events of all placements' ranges, one of each at a time, until step(placements, events) says so: the event where it did (-1: nowhere)."""
        out = np.full(len(self.seq), -1)
        on = np.flatnonzero(self.first < till)
        at = self.first[on]
        while on.size:
            hit = step(on, at)
            out[on[hit]] = at[hit]
            at = at + 1
            left = ~hit & (at < till[on])
            on, at = on[left], at[left]
        return out

    def fold(self, model: str, seed: int):
        """A step that moves the shares believed ahead and stops at an execution with none."""
        ahead = self.depth.copy()

        def step(on: np.ndarray, at: np.ndarray) -> np.ndarray:
            a, q, executed, cancelled = ahead[on], self.qty[at], self.kind[at] == _EXEC, self.kind[at] == _CANCEL
            less = np.fmax(0.0, a - q)
            if model == "conservative":
                moved = a
            elif model == "optimistic":
                moved = less
            else:
                before = self.after[at] + q
                if model == "proportional":
                    moved = np.where(before > 0, np.fmax(0.0, a - q * (a / before)), a)
                else:
                    moved = np.where(cancelled & (before > 0) & self._coins(seed, on, at, a, before, cancelled), less, a)
            ahead[on] = np.where(executed, less, np.where(cancelled, moved, a))
            return executed & (a <= 0)

        return step

    def _coins(self, seed: int, on, at, a, before, asked) -> np.ndarray:
        """Whether the draw of a placement and event (functions.draws) is below the shares ahead; drawn where that isn't certain."""
        size = np.fmax(1, np.nan_to_num(before)).astype(np.int64)
        ahead = np.floor(a).astype(np.int64)
        yes = ahead >= size
        open_ = np.flatnonzero(asked & ~yes & (ahead > 0))
        if open_.size:
            md5 = hashlib.md5
            bits = b"".join([md5(b"%d-%d-%d" % (seed, s, e)).digest()[:4] for s, e in zip(self.seq[on[open_]].tolist(), self.at[at[open_]].tolist())])
            yes[open_] = np.frombuffer(bits, ">u4").astype(np.int64) % size[open_] < ahead[open_]
        return yes

    def filled(self, model: str, till: np.ndarray, seed: int) -> np.ndarray:
        if model == "exact":
            return self.walk(till, lambda on, at: (self.kind[at] == _EXEC) & (self.start[at] > self.seq[on]))
        return self.walk(till, self.fold(model, seed))


_FILLS = "seq long, locate int, side string, price long, ts_ns long, depth long, spread long, model string, seed long, fill_seq long, fill_ts long, reason string"


def fills(placed: DataFrame, moved: DataFrame, rule4: bool = False, seeds: tuple[int, ...] = (20190130,), models: list[str] = MODELS) -> DataFrame:
    """placed: alive(). A row for each placement and model (bernoulli: and seed): fill_seq, fill_ts (null: expired) and reason."""
    runs = [(m, s) for m in models for s in (seeds if m == "bernoulli" else seeds[:1])]

    def of_side(rows: pa.Table) -> pa.Table:
        x = _Side(rows)
        none = np.iinfo(np.int64).max
        when = lambda i: np.where(i >= 0, np.append(x.at, none)[i], none)
        through = x.through()
        till = x.until(np.minimum(x.last, when(through)))
        printed = x.walk(till, lambda on, at: x.kind[at] == _PRINT) if rule4 else np.full(len(x.seq), -1)
        out = []
        with np.errstate(all="ignore"):
            for model, seed in runs:
                own = x.filled(model, till, seed)
                fill = np.minimum(np.minimum(when(own), when(through)), when(printed))
                got = fill < none
                by = np.where(fill == when(own), own, np.where(fill == when(through), through, printed))
                reason = np.where(~got, "expired", np.where(fill == when(through), "trade_through", np.where(fill == when(printed), "non_displayed_print", "execution_behind")))
                ts = np.append(x.at_ts, 0)[by]
                n = len(x.seq)
                out.append(pa.table([x.placed["seq"], x.placed["locate"], x.placed["side"], x.placed["price"], x.placed["ts_ns"], x.placed["qty"], x.placed["after"], pa.array([model] * n, pa.string()), pa.array(np.full(n, seed, np.int64)), pa.array(fill, mask=~got), pa.array(ts, pa.int64(), mask=~got), pa.array(reason.astype(object), pa.string())], names=_FILL_NAMES))
        return pa.concat_tables(out)

    return _met(placed, moved).applyInArrow(of_side, _FILLS)


_FILL_NAMES = [c.split()[0] for c in _FILLS.split(", ")]


def rates(filled: DataFrame) -> DataFrame:
    """Placed, filled and the rate by model; by model and depth; by model and fine bin; by model and symbol (grouping: which)."""
    f = filled.select("model", F.col("locate").alias("symbol"), edge_bucket(F.col("depth"), DEPTH_EDGES).alias("depth_bucket"), edge_bucket(F.col("depth"), AHEAD_EDGES).alias("bin"), F.col("fill_seq").isNotNull().cast("long").alias("f"))
    f.createOrReplaceTempView("_tidebook_fills")
    return f.sparkSession.sql("""SELECT model, depth_bucket, bin, symbol, CASE grouping_id() WHEN 7 THEN 'pooled' WHEN 3 THEN 'depth' WHEN 5 THEN 'bin' ELSE 'symbol' END AS `by`,
        count(*) AS placed, sum(f) AS filled, round(sum(f) / count(*), 6) AS fill_rate FROM _tidebook_fills GROUP BY GROUPING SETS ((model), (model, depth_bucket), (model, bin), (model, symbol))""").select("model", "depth_bucket", "bin", "symbol", "by", "placed", "filled", "fill_rate")


def bias(filled: DataFrame) -> DataFrame:
    """Each model's fill rate against the exact one."""
    r = filled.groupBy("model").agg(F.count(F.lit(1)).alias("placed"), F.sum(F.col("fill_seq").isNotNull().cast("long")).alias("filled"))
    exact = r.filter("model = 'exact'").select((F.col("filled") / F.col("placed")).alias("exact"))
    rate = F.col("filled") / F.col("placed")
    return r.crossJoin(F.broadcast(exact)).select("model", "placed", "filled", F.round(rate, 6).alias("fill_rate"), F.round(rate - F.col("exact"), 6).alias("bias"), F.round((rate - F.col("exact")) / F.col("exact"), 6).alias("relative_bias"))  # one row on the right


def time_to_fill(filled: DataFrame) -> DataFrame:
    b = log_bucket(F.col("fill_ts") - F.col("ts_ns"), *FILL_TIMES)
    return filled.filter("fill_seq is not null").groupBy("model", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).withColumn("low_ns", low(F.col("bucket"), *FILL_TIMES))


def reasons(filled: DataFrame) -> DataFrame:
    return filled.groupBy("model", "reason").agg(F.count(F.lit(1)).alias("n"))


def cancel_attribution(placed: DataFrame, moved: DataFrame) -> DataFrame:
    """By depth at entry: shares cancelled at the price while an order lived, how many were of orders ahead, and how many the proportional model takes to be. Its shares ahead move as
    its fold moves them, filled or not."""

    def of_side(rows: pa.Table) -> pa.Table:
        x = _Side(rows)
        a = x.depth.copy()
        total, ahead, assumed = np.zeros((3, len(a)))

        def step(on: np.ndarray, at: np.ndarray) -> np.ndarray:
            q, before = x.qty[at], x.after[at] + x.qty[at]
            c, share = (x.kind[at] == _CANCEL) & (before > 0), a[on] / before
            total[on] += np.where(c, q, 0.0)
            ahead[on] += np.where(c & ~(x.start[at] > x.seq[on]), q, 0.0)
            assumed[on] += np.where(c, q * np.fmin(1.0, share), 0.0)
            a[on] = np.where(c, np.fmax(0.0, a[on] - q * share), np.where(x.kind[at] == _EXEC, np.fmax(0.0, a[on] - q), a[on]))
            return np.zeros(len(on), bool)

        with np.errstate(all="ignore"):
            x.walk(x.until(x.last), step)
        return pa.table([x.placed["qty"], pa.array(total), pa.array(ahead), pa.array(assumed)], names=["depth", "total", "ahead", "assumed"])

    d = _met(placed, moved).applyInArrow(of_side, "depth long, total double, ahead double, assumed double").withColumn("depth_bucket", edge_bucket(F.col("depth"), DEPTH_EDGES))
    return d.groupBy("depth_bucket").agg(F.count(F.lit(1)).alias("placed"), F.sum("total").alias("cancelled"), F.sum("ahead").alias("ahead"), F.round(F.sum("assumed"), 3).alias("assumed"))


def values(filled: DataFrame, inside: DataFrame, tape: DataFrame) -> DataFrame:
    """For each fill and horizon: the signed move of the mid from the fill price, at the first message of any symbol that is due. Without one, or without a two-sided book then, no row."""
    f = filled.filter("fill_seq is not null").withColumn("h", F.explode(F.array(*[F.lit(h).cast("long") for h in HORIZONS_S]))).withColumn("id", F.concat_ws("-", "seq", "model", "h"))
    due = first_tick(f.select("id", (F.col("fill_ts") + F.col("h") * 1_000_000_000).alias("due_ts")), tape).filter("tick_seq is not null")
    f = f.join(due.select("id", "tick_seq"), "id")
    known = inside.select("locate", "seq", F.struct("bid", "ask").alias("at"), F.lit(None).cast("string").alias("id"))
    asked = f.select("locate", F.col("tick_seq").alias("seq"), F.lit(None).cast(known.schema["at"].dataType).alias("at"), "id")
    w = Window.partitionBy("locate").orderBy("seq", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = known.unionByName(asked).withColumn("at", F.last("at", ignorenulls=True).over(w)).filter("id is not null").select("id", F.col("at.bid").alias("b"), F.col("at.ask").alias("a"))
    v = f.join(got, "id").filter("b is not null and a is not null")
    mid = (F.col("b") + F.col("a")) / 2.0
    edge = F.when(F.col("side") == "B", mid - F.col("price")).otherwise(F.col("price") - mid)
    return v.select("seq", "model", "h", "depth", "spread", edge.alias("value"), F.when(F.col("spread") > 0, edge / (F.col("spread") / 2.0)).otherwise(0.0).alias("value_hs"))


def mean_values(valued: DataFrame) -> DataFrame:
    """By model and horizon: fills, and the mean value in ticks and in half-spreads (fills at no spread count in both denominators)."""
    return valued.groupBy("model", F.col("h").alias("horizon_s")).agg(F.count(F.lit(1)).alias("fills"), F.round(F.avg(F.col("value") / 100.0), 6).alias("mean_ticks"), F.round(F.sum("value_hs") / F.count(F.lit(1)), 6).alias("mean_halfspreads"))


def by_symbol(filled: DataFrame, models: list[str]) -> DataFrame:
    """locate, placed, and each model's fill rate in a column of its own."""
    return filled.groupBy("locate").pivot("model", models).agg(F.round(F.avg(F.col("fill_seq").isNotNull().cast("double")), 6)).join(filled.filter(F.col("model") == models[0]).groupBy("locate").agg(F.count(F.lit(1)).alias("placed")), "locate")


def curve(filled: DataFrame, least_placed: int, least_symbols: int) -> DataFrame:
    """The exact model's fill rate by fine bin: mean shares ahead, whether the bin is kept, and, among the kept ones, the second difference on their uneven grid."""
    b = edge_bucket(F.col("depth"), AHEAD_EDGES)
    c = filled.filter("model = 'exact'").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("placed"), F.countDistinct("locate").alias("symbols"), F.avg("depth").alias("x"), F.avg(F.col("fill_seq").isNotNull().cast("double")).alias("r"))
    c = c.withColumn("kept", (F.col("placed") >= least_placed) & (F.col("symbols") >= least_symbols))
    w = Window.partitionBy("kept").orderBy("bin")  # a row for each bin
    up, down = (F.lead("r").over(w) - F.col("r")) / (F.lead("x").over(w) - F.col("x")), (F.col("r") - F.lag("r").over(w)) / (F.col("x") - F.lag("x").over(w))
    bend = 2 * (up - down) / (F.lead("x").over(w) - F.lag("x").over(w))
    return c.select("bin", "placed", "symbols", F.round("x", 6).alias("mean_ahead"), F.round("r", 6).alias("fill_rate"), "kept", F.round(F.when(F.col("kept"), bend * 1e6), 6).alias("bend"))


def label(edges: list[int]) -> Column:
    """The name of a bucket, lo-hi, from its number in column bin."""
    names = [f"{lo}-{hi}" for lo, hi in zip(edges, edges[1:])] + [f"{edges[-1]}+"]
    return F.element_at(F.array(*map(F.lit, names)), F.col("bin") + 1)


def schedule(tape: DataFrame, inside: DataFrame, universe: DataFrame, mean_gap_ns: int, refresh_ns: int, open_ns: int, seed: int, most: int = 64) -> DataFrame:
    """Placements at exponential gaps: k, seq (the first tick that is due), locate, side, price, depth, overrun. universe: locate, rank.

    Every refresh_ns, at the first tick, the universe's symbols whose inside is two-sided then, in rank order, are those that may be picked until the next refresh; a pick and a coin are drawn
    for each placement. What one tick has beyond `most` due placements is dropped and marked as overrun. A symbol that isn't two-sided when picked gets no placement (price null)."""
    spark = tape.sparkSession
    t = tape.filter(F.col("mtype").isin(TICK_TYPES)).select("seq", "ts_ns")
    last = t.agg(F.max("ts_ns")).first()[0] or open_ns
    n = int(1.5 * (last - open_ns) / mean_gap_ns) + 100
    gap = F.floor(-F.log((drawn(F.lit(seed), F.col("k"), F.lit("gap")) + 0.5) / 4294967296.0) * mean_gap_ns).cast("long")
    due = spark.range(n).withColumnRenamed("id", "k").withColumn("due_ts", F.lit(open_ns) + F.sum(gap).over(Window.orderBy("k"))).filter(F.col("due_ts") <= last)  # one session's placements
    ticked = first_tick(due.select(F.col("k").alias("id"), "due_ts"), tape).filter("tick_seq is not null").select(F.col("id").alias("k"), F.col("tick_seq").alias("seq"), "due_ts")
    # refreshes: at each, whether each symbol of the universe is two-sided
    rounds = spark.range(int((last - open_ns) // refresh_ns) + 1).select(F.col("id"), (F.lit(open_ns) + F.col("id") * refresh_ns).alias("due_ts"))
    fresh = first_tick(rounds, tape).filter("tick_seq is not null").groupBy(F.col("tick_seq").alias("seq")).agg(F.max("id").alias("round"))
    asked = fresh.crossJoin(F.broadcast(universe)).select("locate", "rank", "seq", "round")  # rounds x universe, both bounded
    eligible = _inside_at(asked, inside).filter("bid is not null and ask is not null").groupBy(F.col("seq").alias("fresh_seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "locate"))), lambda x: x["locate"]).alias("symbols"))
    both = ticked.select("seq", "k", F.lit(None).cast("array<int>").alias("symbols")).unionByName(eligible.select(F.col("fresh_seq").alias("seq"), F.lit(None).cast("long").alias("k"), "symbols"))
    both = both.withColumn("symbols", F.last("symbols", ignorenulls=True).over(Window.orderBy("seq", F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("k is not null and size(symbols) > 0")
    picked = both.select("k", "seq", F.expr("symbols").alias("symbols"), F.row_number().over(Window.partitionBy("seq").orderBy("k")).alias("nth"))
    picked = picked.select("k", "seq", F.get("symbols", (drawn(F.lit(seed), F.col("k"), F.lit("pick")) % F.size("symbols")).cast("int")).alias("locate"), F.when(drawn(F.lit(seed), F.col("k"), F.lit("coin")) % 2 == 0, "B").otherwise("S").alias("side"), (F.col("nth") > most).alias("overrun"))
    got = _inside_at(picked, inside)
    ok = F.col("bid").isNotNull() & F.col("ask").isNotNull() & ~F.col("overrun")
    buy = F.col("side") == "B"
    return got.select("k", "seq", "locate", "side", F.when(ok, F.when(buy, F.col("bid")).otherwise(F.col("ask"))).alias("price"), F.when(ok, F.when(buy, F.col("bid_qty")).otherwise(F.col("ask_qty"))).alias("depth"), "overrun")


def _inside_at(asked: DataFrame, inside: DataFrame) -> DataFrame:
    """asked: locate, seq and more. With the symbol's inside after message seq of any symbol."""
    known = inside.select("locate", "seq", F.struct("bid", "ask", "bid_qty", "ask_qty").alias("at"), F.lit(None).cast(f"struct<{','.join(f'{n}:{t}' for n, t in asked.dtypes)}>").alias("ask_row"))
    rows = asked.select("locate", "seq", F.lit(None).cast(known.schema["at"].dataType).alias("at"), F.struct(*asked.columns).alias("ask_row"))
    w = Window.partitionBy("locate").orderBy("seq", F.col("ask_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = known.unionByName(rows).withColumn("at", F.last("at", ignorenulls=True).over(w)).filter("ask_row is not null")
    return got.select("ask_row.*", "at.bid", "at.ask", "at.bid_qty", "at.ask_qty")
