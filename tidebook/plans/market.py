"""Registered queries over the tape: census, book, gate, microstructure, windows, queue and strategy, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import census, gate, levels, micro, orders, queue, strategy, windows
from tidebook.operators.tape import tape
from tidebook.plans import sql as S
from tidebook.plans.stage import kept

WINDOW, EVERY, LIFE_NS, SAMPLE_NS = 10, 25, 600_000_000_000, 60_000_000_000
SQL_MODELS = ["exact", "conservative", "optimistic", "proportional"]


class Book:
    """The stages that several queries share, each made when asked for and written once: a later stage's plan begins at the tables before it."""

    def __init__(self, spark: SparkSession, sf_dir: str, variant: str = "plain") -> None:
        self.variant = variant
        self._source = tape(spark, sf_dir, variant)
        self._made: dict[str, DataFrame] = {}

    def _kept(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = kept(make(), name)
        return self._made[name]

    tape = property(lambda self: self._kept("tape", lambda: self._source))
    messages = property(lambda self: self.tape.select("seq", "locate", "ts_ns", "mtype"))
    rows = property(lambda self: self._kept("rows", lambda: orders.reference_rows(self.tape)))
    roots = property(lambda self: self._kept("roots", lambda: orders.rooted(self.rows)))
    mods = property(lambda self: self._kept("mods", lambda: orders.modifications(self.rows, self.roots)))
    eps = property(lambda self: self._kept("eps", lambda: orders.episodes(self.mods, self.roots)))

    def effects(self):
        return self.mods, self.eps

    states = property(lambda self: self._kept("states", lambda: levels.level_states(orders.deltas(*self.effects()))))
    inside = property(lambda self: self._kept("inside", lambda: levels.inside(self.messages, self.states)))

    touches = property(lambda self: self._kept("touches", lambda: windows.touches(self.tape, self.inside, self.mods, WINDOW)))

    def windows(self, lag1: bool = False) -> DataFrame:
        return self._kept(f"windows-{lag1}", lambda: windows.closed(self.touches, WINDOW, lag1))

    def features(self, lag1: bool = False) -> DataFrame:
        return windows.labelled(self.windows(lag1))

    def alive(self) -> DataFrame:
        return self._kept("alive", lambda: queue.alive(queue.placements(self.inside, EVERY), self.tape, LIFE_NS))

    def moved(self) -> DataFrame:
        return queue.events(self.mods, self.states, self.tape)

    def fills(self, rule4: bool = False, models: list[str] | None = None, seeds: tuple[int, ...] = (20190130,)) -> DataFrame:
        return self._kept(f"fills-{rule4}-{'-'.join(models or ['all'])}-{len(seeds)}", lambda: queue.fills(self.alive(), self.moved(), rule4, seeds, models or SQL_MODELS))

    def values(self) -> DataFrame:
        return self._kept("values", lambda: queue.values(self.fills(), self.inside, self.tape))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, variant: str = "plain"):
    """Registers a function of a Book."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Book(spark, sf_dir, variant))
        if oracle:
            SQL[name] = oracle
        return f

    return put


def _book(select: str, *more: str, variant: str = "plain") -> str:
    return S.query(select, S.ORDERS, S.LEVELS, S.INSIDE, *more, variant=variant)


_LIFE, _FILL = micro.edges(*micro.LIFETIMES), micro.edges(*micro.FILL_TIMES)
_WIN = S.windows(WINDOW)
_QUEUE = (S.queue(EVERY, LIFE_NS), S.fills(SQL_MODELS))
_TYPES = ", ".join(f"('{t}')" for t in "SRHYLVWKJhAFECXDUPQBINO")

# --- census -------------------------------------------------------------------

query("census_by_type", S.query(f"SELECT k.mtype, count(t.seq) AS n FROM (VALUES {_TYPES}) k(mtype) LEFT JOIN tape t USING (mtype) GROUP BY k.mtype", variant="full"), "full")(lambda b: census.by_type(b.tape))
query("census_span", S.query("SELECT count(*) AS n, arg_min(ts_ns, seq) AS first_ts, arg_max(ts_ns, seq) AS last_ts, arg_max(mtype, seq) AS last_type, coalesce(arg_max(mtype, seq) = 'S' AND arg_max(code, seq) = 'C', false) AS complete, count(*) FILTER (mtype = 'S' AND code = 'E') > 0 AS saw_end_of_hours FROM tape"))(lambda b: census.span(b.tape))
query("census_four_counts", S.query(f"SELECT count(*) AS framed, count(*) FILTER (mtype IN ('A', 'F', 'E', 'C', 'X', 'D', 'U')) AS book_affecting, count(*) FILTER (mtype IN ('S', 'R', 'H', 'h') OR mtype IN {S.TICKS}) AS compared, count(*) FILTER (mtype IN {S.TICKS}) AS book_messages FROM tape", variant="full"), "full")(lambda b: census.four_counts(b.tape))
query("symbol_activity_topk", S.query("SELECT locate, count(*) AS n, arg_max(stock, seq) AS stock FROM tape WHERE mtype IN ('A', 'F', 'E', 'C', 'X', 'D', 'U') GROUP BY locate ORDER BY n DESC, locate DESC LIMIT 5"))(lambda b: census.busiest(b.tape, 5))
query("venue_profile", S.query("SELECT *, CASE WHEN imbalances > 0 AND opening > 0 AND closing > 0 THEN 'auctions' WHEN imbalances = 0 AND opening = 0 AND closing = 0 THEN 'no auctions' ELSE 'ambiguous' END AS verdict FROM (SELECT count(*) AS messages, count(*) FILTER (mtype = 'Q' AND code = 'O') AS opening, count(*) FILTER (mtype = 'Q' AND code = 'C') AS closing, count(*) FILTER (mtype = 'I') AS imbalances, coalesce(sum(qty) FILTER (mtype = 'Q'), 0)::BIGINT AS cross_shares FROM tape)", variant="full"), "full")(lambda b: census.venue_profile(b.tape))
query("order_age_buckets", S.query("SELECT mtype, CASE WHEN NOT found THEN 'unseen' WHEN ts_ns - start_ts < 1000000 THEN '<1ms' WHEN ts_ns - start_ts < 10000000 THEN '1-10ms' WHEN ts_ns - start_ts < 100000000 THEN '10-100ms' WHEN ts_ns - start_ts <= 1000000000 THEN '100ms-1s' ELSE '>1s' END AS age, count(*) AS n FROM mods GROUP BY ALL", S.ORDERS))(lambda b: census.age_buckets(b.mods))

# --- the book -------------------------------------------------------------------

_EPS = "ref, locate, side, price, shares0, start_seq, start_ts, via, end_seq, end_ts, end_by, executed, cancelled, remaining"
query("order_episodes", S.query(f"SELECT {_EPS} FROM eps", S.ORDERS))(lambda b: b.eps.select(*_EPS.split(", ")))
query("orphans_by_type", S.query("SELECT mtype, count(*) AS n FROM mods WHERE NOT found GROUP BY mtype", S.ORDERS))(lambda b: b.mods.filter("not found").groupBy("mtype").agg(F.count(F.lit(1)).alias("n")))
query("book_counters", S.query("SELECT count(*) FILTER (emptied) AS removed_at_zero, count(*) FILTER (over) AS over_executed, (SELECT count(*) FROM eps WHERE end_seq IS NULL) AS live, (SELECT count(*) FROM tape WHERE mtype = 'Q' AND qty = 0) AS zero_share_crosses, (SELECT count(DISTINCT locate) FROM tape) AS symbols FROM mods", S.ORDERS, variant="full"), "full")(
    lambda b: b.mods.agg(F.sum(F.col("emptied").cast("long")).alias("removed_at_zero"), F.sum(F.col("over").cast("long")).alias("over_executed"))
    .crossJoin(b.eps.agg(F.sum(F.col("end_seq").isNull().cast("long")).alias("live")))
    .crossJoin(b.tape.agg(F.sum(((F.col("mtype") == "Q") & (F.col("qty") == 0)).cast("long")).alias("zero_share_crosses"), F.countDistinct("locate").alias("symbols")))  # one row each
)
query("level_depth_running", S.query("SELECT * FROM states", S.ORDERS, S.LEVELS))(lambda b: b.states)
query("level_snapshot_at_end", S.query("SELECT locate, side, price, sum(remaining)::BIGINT AS shares, count(*) AS orders FROM eps WHERE end_seq IS NULL GROUP BY ALL", S.ORDERS))(lambda b: levels.fifo(b.eps).drop("refs"))
query("fifo_at_end", S.query("SELECT locate, side, price, string_agg(ref::VARCHAR, ',' ORDER BY start_seq, ref) AS queue FROM eps WHERE end_seq IS NULL GROUP BY ALL", S.ORDERS))(lambda b: levels.fifo(b.eps).select("locate", "side", "price", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("queue")))
query("level_asof_lookup", S.query("SELECT p.seq, p.locate, s.side, s.price, s.shares, s.orders FROM (SELECT seq, locate FROM tape WHERE seq % 100 = 0) p JOIN states s ON s.locate = p.locate AND s.orders > 0 AND s.seq <= p.seq AND p.seq < s.until", S.ORDERS, S.LEVELS))(
    lambda b: b.tape.filter("seq % 100 = 0").select("seq", "locate").alias("p").join(b.states.filter("orders > 0").alias("s"), (F.col("s.locate") == F.col("p.locate")) & (F.col("s.seq") <= F.col("p.seq")) & (F.col("p.seq") < F.col("s.until"))).select("p.seq", "p.locate", "s.side", "s.price", "s.shares", "s.orders")
)
query("level_asof_every_message")(lambda b: levels.at_every(b.tape.select("seq", "locate"), b.states))  # the lookup above for every message
_INS = "seq, locate, ts_ns, mtype, bid, ask, bid_qty, ask_qty, bid_orders, ask_orders"
query("inside_after_every_message", _book(f"SELECT {_INS} FROM ins"))(lambda b: b.inside)
query("book_invariants", S.query("SELECT count(*) AS states, count(*) FILTER (orders < 0 OR shares < 0) AS negative, count(*) FILTER (orders = 0 AND shares <> 0) AS empty_with_shares, count(*) FILTER (orders > 0 AND shares = 0) AS orders_without_shares, (SELECT count(*) FROM (SELECT locate, side, price, sum(remaining) AS r, count(*) AS c FROM eps WHERE end_seq IS NULL GROUP BY ALL) x JOIN states s ON s.locate = x.locate AND s.side = x.side AND s.price = x.price AND s.until = 4611686018427387904 WHERE s.shares <> x.r OR s.orders <> x.c) AS levels_off FROM states", S.ORDERS, S.LEVELS))(
    lambda b: b.states.agg(F.count(F.lit(1)).alias("states"), F.sum(((F.col("orders") < 0) | (F.col("shares") < 0)).cast("long")).alias("negative"), F.sum(((F.col("orders") == 0) & (F.col("shares") != 0)).cast("long")).alias("empty_with_shares"), F.sum(((F.col("orders") > 0) & (F.col("shares") == 0)).cast("long")).alias("orders_without_shares"))
    .crossJoin(levels.fifo(b.eps).select("locate", "side", "price", F.col("shares").alias("r"), F.col("orders").alias("c")).join(b.states.filter(F.col("until") == levels.FAR), ["locate", "side", "price"]).filter("shares <> r or orders <> c").agg(F.count(F.lit(1)).alias("levels_off")))  # one row each
)
query("window_overflow_rate", _book("SELECT w AS width, round(avg((abs(m.price - coalesce(CASE m.side WHEN 'B' THEN i.bid ELSE i.ask END, m.price)) // 100 >= w)::INTEGER), 6) AS overflow FROM mods m JOIN ins i USING (seq), (VALUES (1), (2), (4)) v(w) WHERE m.found GROUP BY w", variant="full"), "full")(
    lambda b: b.mods.filter("found").select("seq", F.col("own_side").alias("side"), F.col("own_price").alias("price")).join(b.inside.select("seq", "bid", "ask"), "seq").withColumn("away", F.floor(F.abs(F.col("price") - F.coalesce(F.when(F.col("side") == "B", F.col("bid")).otherwise(F.col("ask")), F.col("price"))) / 100)).withColumn("width", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).groupBy("width").agg(F.round(F.avg((F.col("away") >= F.col("width")).cast("int")), 6).alias("overflow"))
)

# --- the gate -------------------------------------------------------------------

_WHY = "CASE WHEN state IS NULL THEN 'before first action' WHEN halt THEN 'operational halt' WHEN state <> 'T' THEN 'not trading' WHEN awaiting AND NOT late THEN 'awaiting reopen' ELSE 'unexplained' END"
query("crossed_locked_excuses", _book(f"SELECT CASE WHEN bid > ask THEN 'crossed' ELSE 'locked' END AS kind, {_WHY} AS excuse, sum(weight)::BIGINT AS observations, sum(CASE WHEN ts_ns >= 34200000000000 AND ts_ns < 57600000000000 THEN weight ELSE 0 END)::BIGINT AS continuous, count(DISTINCT locate) AS symbols, max(bid - ask) AS worst, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts FROM obs WHERE bad GROUP BY 1, 2", S.GATE, variant="full"), "full")(lambda b: gate.excuses(gate.observations(b.tape, b.inside, b.mods)))
query("reopening_windows", _book("SELECT coalesce(sum(opens::BIGINT), 0)::BIGINT AS opened, count(*) FILTER (awaiting AND bad AND late) AS capped, coalesce(max(greatest(0, ts_ns - opened_ts)) FILTER (awaiting AND (mtype = 'Q' OR clean)), 0) AS longest_ns FROM obs", S.GATE, variant="full"), "full")(lambda b: gate.reopenings(gate.observations(b.tape, b.inside, b.mods)))

# --- microstructure ---------------------------------------------------------------

query("micro_symbols", S.query("SELECT * FROM flow", S.ORDERS, S.FLOW, variant="full"), "full")(lambda b: micro.flow(b.tape, b.mods))
query("order_lifetime_histogram", S.query("SELECT exit, bucket, n, low_ns FROM hist", S.ORDERS, S.exits(_LIFE)))(lambda b: micro.lifetimes(b.eps))
query("exit_shares", S.query("SELECT sum(n)::BIGINT AS removed, " + ", ".join(f"round(100.0::DOUBLE * coalesce(sum(n) FILTER (exit = '{e}'), 0) / sum(n), 6) AS {c}" for e, c in (("cancelled", "pct_cancelled"), ("replaced", "pct_replaced"), ("filled", "pct_filled"), ("partial_then_gone", "pct_partial"))) + ", round(100.0::DOUBLE * coalesce(sum(n) FILTER (low_ns < 1e9), 0) / sum(n), 6) AS pct_under_1s FROM hist", S.ORDERS, S.exits(_LIFE)))(
    lambda b: micro.exit_shares(micro.lifetimes(b.eps)).select("removed", *[F.round(c, 6).alias(c) for c in ("pct_cancelled", "pct_replaced", "pct_filled", "pct_partial", "pct_under_1s")])
)
query("median_lifetime_geometric", S.query(S.median("hist", "exit", _LIFE, False), S.ORDERS, S.exits(_LIFE)))(lambda b: micro.median_of_histogram(micro.lifetimes(b.eps), "exit", *micro.LIFETIMES, False).select("exit", F.round("median", 3).alias("median")))
query("median_lifetime_interpolated", S.query(S.median("hist", "exit", _LIFE, True), S.ORDERS, S.exits(_LIFE)))(lambda b: micro.median_of_histogram(micro.lifetimes(b.eps), "exit", *micro.LIFETIMES, True).select("exit", F.round("median", 3).alias("median")))
query("order_sizes", S.query("SELECT * FROM sizes", S.SIZES))(lambda b: micro.sizes(b.tape))
query("order_sizes_lots", S.query("SELECT sum(n)::BIGINT AS orders, round(100.0::DOUBLE * coalesce(sum(n) FILTER (shares_low < 100), 0) / sum(n), 6) AS pct_odd, round(100.0::DOUBLE * coalesce(sum(n) FILTER (shares_low % 100 = 0 AND shares_low > 0), 0) / sum(n), 6) AS pct_round, round(100.0::DOUBLE * (sum(n) - coalesce(sum(n) FILTER (shares_low < 100), 0) - coalesce(sum(n) FILTER (shares_low % 100 = 0 AND shares_low > 0), 0)) / sum(n), 6) AS pct_mixed, (SELECT shares_low FROM sizes ORDER BY n DESC, shares_low LIMIT 1) AS modal_size FROM sizes WHERE shares_high IS NOT NULL", S.SIZES))(
    lambda b: micro.lots(micro.sizes(b.tape)).select("orders", *[F.round(c, 6).alias(c) for c in ("pct_odd", "pct_round", "pct_mixed")], "modal_size")
)
query("order_sizes_top12", S.query("SELECT shares_low, n FROM sizes ORDER BY n DESC, shares_low LIMIT 12", S.SIZES))(lambda b: micro.sizes(b.tape).orderBy(F.desc("n"), "shares_low").limit(12).select("shares_low", "n"))
query("cancel_to_trade", S.query("SELECT count(*) AS symbols, round(quantile_cont((deletes + cancels)::DOUBLE / executes, 0.5), 6) AS median, round(quantile_cont((deletes + cancels)::DOUBLE / executes, 0.25), 6) AS p25, round(quantile_cont((deletes + cancels)::DOUBLE / executes, 0.75), 6) AS p75, round(quantile_cont((deletes + cancels + replaces)::DOUBLE / executes, 0.5), 6) AS with_replaces FROM flow WHERE executes > 0 AND adds >= 50", S.ORDERS, S.FLOW))(
    lambda b: micro.cancel_to_trade(micro.flow(b.tape, b.mods), 50).select("symbols", *[F.round(c, 6).alias(c) for c in ("median", "p25", "p75", "with_replaces")])
)
query("spread_depth_by_minute", _book("SELECT * FROM mins", S.minutes(SAMPLE_NS)))(lambda b: micro.spread_depth(b.tape, b.inside, SAMPLE_NS))
query("spread_session_segments", _book("SELECT max(symbols) AS symbols, round(avg(spread) FILTER (minute < 30), 6) AS open_30min, round(avg(spread) FILTER (minute >= 150 AND minute < 240), 6) AS midday, round(avg(spread) FILTER (minute >= 360), 6) AS close_30min, round(sum(spread * symbols) / sum(symbols), 6) AS session FROM (SELECT minute, sum(mean_spread * two_sided) / sum(two_sided) AS spread, count(DISTINCT locate) AS symbols FROM mins WHERE two_sided > 0 GROUP BY minute)", S.minutes(SAMPLE_NS)))(lambda b: micro.segments(micro.spread_depth(b.tape, b.inside, SAMPLE_NS)))

# --- windows ----------------------------------------------------------------------

_F = ("ofi", "queue_imbalance", "micro_dev", "trade_sign", "mid", "spread_ticks", "label_ticks", "label_halfspreads")
_rounded = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
for _name, _variant in (("feature_windows", "plain"), ("feature_windows_halts", "session")):
    query(_name, _book(f"SELECT locate, wid, close_ts, {_rounded(_F)} FROM feat", _WIN, variant=_variant), _variant)(lambda b: b.features().select("locate", "wid", "close_ts", *[F.round(n, 6).alias(n) for n in _F]))
query("feature_windows_lag1", _book("SELECT locate, wid, round(ofi_lag1, 6) AS ofi, round(queue_imbalance_lag1, 6) AS queue_imbalance, round(micro_dev, 6) AS micro_dev, round(trade_sign, 6) AS trade_sign FROM feat", _WIN))(lambda b: b.features(lag1=True).select("locate", "wid", *[F.round(n, 6).alias(n) for n in _F[:4]]))
query("window_outcomes", _book("SELECT locate, count(*) AS windows, count(*) FILTER (usable) AS usable, count(*) FILTER (start_bad) AS out_of_hours FROM (SELECT *, NOT (close_ts < 57600000000000) AS start_bad FROM win) GROUP BY locate", _WIN, variant="full"), "full")(lambda b: b.windows().groupBy("locate").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.col("usable").cast("long")).alias("usable"), F.sum((F.col("close_ts") >= 57_600_000_000_000).cast("long")).alias("out_of_hours")))

# --- queue --------------------------------------------------------------------------

_Q = "seq, locate, side, price, depth, fill_seq, reason"
for _m in SQL_MODELS:
    query(f"queue_{_m}", _book(f"SELECT {_Q} FROM fl", _QUEUE[0], S.fills([_m])))(lambda b, m=_m: b.fills(models=[m]).select(*_Q.split(", ")))
query("queue_rule4", _book(f"SELECT model, {_Q} FROM fl", _QUEUE[0], S.fills(SQL_MODELS, True), variant="full"), "full")(lambda b: b.fills(rule4=True).select("model", *_Q.split(", ")))
query("fill_rate_grouping_sets", _book(f"SELECT model, depth_bucket, bin, symbol, CASE grouping_id(depth_bucket, bin, symbol) WHEN 7 THEN 'pooled' WHEN 3 THEN 'depth' WHEN 5 THEN 'bin' ELSE 'symbol' END AS \"by\", count(*) AS placed, sum(f)::BIGINT AS filled, round(sum(f)::DOUBLE / count(*), 6) AS fill_rate FROM (SELECT model, locate AS symbol, {S._buckets('depth', queue.DEPTH_EDGES[1:])} AS depth_bucket, {S._buckets('depth', queue.AHEAD_EDGES[1:])} AS bin, (fill_seq IS NOT NULL)::INTEGER AS f FROM fl) GROUP BY GROUPING SETS ((model), (model, depth_bucket), (model, bin), (model, symbol))", *_QUEUE))(lambda b: queue.rates(b.fills()))
query("bias_vs_exact", _book("SELECT model, placed, filled, round(r, 6) AS fill_rate, round(r - e, 6) AS bias, round((r - e) / e, 6) AS relative_bias FROM (SELECT *, filled::DOUBLE / placed AS r, max(filled::DOUBLE / placed) FILTER (model = 'exact') OVER () AS e FROM (SELECT model, count(*) AS placed, count(fill_seq) AS filled FROM fl GROUP BY model))", *_QUEUE))(lambda b: queue.bias(b.fills()))
query("fill_reasons", _book("SELECT model, reason, count(*) AS n FROM fl GROUP BY ALL", *_QUEUE))(lambda b: queue.reasons(b.fills()))
_TTF = f"ttf AS (SELECT model, bucket, count(*) AS n, [{', '.join(repr(e) + '::DOUBLE' for e in _FILL)}][bucket + 1] AS low_ns FROM (SELECT model, {S._buckets('(fill_ts - ts_ns)::DOUBLE', [repr(e) + '::DOUBLE' for e in _FILL[1:-1]])} AS bucket FROM fl WHERE fill_seq IS NOT NULL) GROUP BY model, bucket)"
query("time_to_fill_histogram", _book("SELECT model, bucket, n, low_ns FROM ttf", *_QUEUE, _TTF))(lambda b: queue.time_to_fill(b.fills()))
query("median_time_to_fill", _book(S.median("ttf", "model", _FILL, True), *_QUEUE, _TTF))(lambda b: micro.median_of_histogram(queue.time_to_fill(b.fills()), "model", *micro.FILL_TIMES, True).select("model", F.round("median", 3).alias("median")))
# --- strategy -------------------------------------------------------------------------

_PNL = """qt AS (SELECT close_seq AS seq, locate, lead_seq AS exit_seq, lead_mid AS exit_mid, CASE WHEN queue_imbalance > 0 THEN 'B' ELSE 'S' END AS side, CASE WHEN queue_imbalance > 0 THEN bid ELSE ask END AS price, spread FROM (SELECT *, lead(close_seq) OVER w AS lead_seq, lead(mid) OVER w AS lead_mid FROM win WINDOW w AS (PARTITION BY locate ORDER BY wid)) WHERE usable AND queue_imbalance <> 0),
qf AS (SELECT q.*, (SELECT min(m.seq) FROM mods m WHERE m.found AND m.mtype IN ('E', 'C') AND m.locate = q.locate AND m.side = q.side AND m.seq > q.seq AND (q.exit_seq IS NULL OR m.seq <= q.exit_seq) AND ((m.price = q.price AND m.start_seq > q.seq) OR (q.side = 'B' AND m.price < q.price) OR (q.side = 'S' AND m.price > q.price))) AS fill_seq FROM qt q),
qg AS (SELECT *, CASE side WHEN 'B' THEN exit_mid - price ELSE price - exit_mid END AS g, fill_seq IS NOT NULL AND exit_seq IS NOT NULL AS done FROM qf),
qh AS (SELECT count(*) AS quotes, count(*) FILTER (done) AS fills, coalesce(sum(CASE WHEN spread > 0 THEN g / (spread / 2.0::DOUBLE) ELSE 0 END) FILTER (done), 0) / greatest(1, count(*) FILTER (done)) AS hs, coalesce(sum(g / 10000.0::DOUBLE) FILTER (done), 0) / greatest(1, count(*) FILTER (done)) AS dollars FROM qg)"""
query("maker_strategy_pnl", _book("SELECT quotes, fills, round(fills::DOUBLE / quotes, 6) AS fill_rate, round(hs, 6) AS gross_halfspreads, round(dollars, 8) AS gross_dollars, round(dollars + 0.0015::DOUBLE, 8) AS net_base, round(dollars + 0.00305::DOUBLE, 8) AS net_top, round(dollars + CASE WHEN fills > 0 THEN 0.0015::DOUBLE ELSE 0 END, 8) AS net_by_tape FROM qh", _WIN, _PNL))(lambda b: strategy.pnl(strategy.quote_fills(strategy.quotes(b.windows()), queue.events(b.mods, b.states, b.tape), False)))
