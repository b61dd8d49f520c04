"""Registered queries over a whole session's tape, of values and schedules, and of resampling, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import census, levels, queue, windows
from tidebook.operators.tape import OPEN_NS
from tidebook.operators.windows import FEATURES
from tidebook.plans import sql as S
from tidebook.plans.market import _EPS, _INS, _QUEUE, _WIN, EVERY, LIFE_NS, Book, _book
from tidebook.stats import inference

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, variant: str = "session"):
    """Registers a function of a Book."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Book(spark, sf_dir, variant))
        if oracle:
            SQL[name] = oracle
        return f

    return put


def _one(select: str, *parts: str, variant: str = "session") -> str:
    return S.query(select, *parts, variant=variant)


def _bits(*key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('-', {', '.join(key)})), 1, 8))::BIGINT"


# --- a whole session: chains of replacements, references used again, system events, a directory -------------

query("census_span_session", _one("SELECT count(*) AS n, arg_min(ts_ns, seq) AS first_ts, arg_max(ts_ns, seq) AS last_ts, arg_max(mtype, seq) AS last_type, coalesce(arg_max(mtype, seq) = 'S' AND arg_max(code, seq) = 'C', false) AS complete, count(*) FILTER (mtype = 'S' AND code = 'E') > 0 AS saw_end_of_hours FROM tape"))(lambda b: census.span(b.tape))
query("after_end_of_hours", _one(f"SELECT count(*) AS all_types, count(*) FILTER (mtype IN {S.TICKS}) AS ticks FROM tape WHERE seq > (SELECT min(seq) FROM tape WHERE mtype = 'S' AND code = 'E')"))(lambda b: census.after_hours(b.tape))
query("symbol_directory", _one("SELECT a.locate, coalesce(d.stock, '?') AS stock, a.n FROM (SELECT locate, count(*) AS n FROM tape WHERE mtype IN ('A', 'F', 'E', 'C', 'X', 'D', 'U') GROUP BY locate) a LEFT JOIN (SELECT locate, arg_max(stock, seq) AS stock FROM tape WHERE mtype = 'R' GROUP BY locate) d USING (locate)"))(lambda b: census.named_activity(b.tape))
query("subcent_prices", _one("SELECT mtype, count(*) AS priced, count(*) FILTER (price % 100 <> 0) AS subcent FROM tape WHERE price IS NOT NULL GROUP BY mtype"))(lambda b: census.subcent(b.tape))
query("order_episodes_session", _one(f"SELECT {_EPS} FROM eps", S.ORDERS))(lambda b: b.eps.select(*_EPS.split(", ")))
query("orphans_by_type_session", _one("SELECT mtype, count(*) AS n FROM mods WHERE NOT found GROUP BY mtype", S.ORDERS))(lambda b: b.mods.filter("not found").groupBy("mtype").agg(F.count(F.lit(1)).alias("n")))
query("exits_by_origin_session", _one("SELECT via, coalesce(end_by, 'live') AS end_by, count(*) AS n, sum(executed)::BIGINT AS executed, sum(remaining)::BIGINT AS remaining FROM eps GROUP BY 1, 2", S.ORDERS))(lambda b: b.eps.groupBy("via", F.coalesce("end_by", F.lit("live")).alias("end_by")).agg(F.count(F.lit(1)).alias("n"), F.sum("executed").alias("executed"), F.sum("remaining").alias("remaining")))
query("level_depth_session", _one("SELECT * FROM states", S.ORDERS, S.LEVELS))(lambda b: b.states)
query("inside_session", _book(f"SELECT {_INS} FROM ins", variant="session"))(lambda b: b.inside)
_HALF = "(SELECT max(seq) // 2 FROM tape)"
_FIFO = f"SELECT x.locate, x.side, x.price, sum(x.shares0 - coalesce(g.t, 0))::BIGINT AS shares, count(*) AS orders FROM eps x LEFT JOIN (SELECT ref, start_seq, sum(taken) AS t FROM mods WHERE found AND seq <= {_HALF} GROUP BY ALL) g ON g.ref = x.ref AND g.start_seq = x.start_seq WHERE x.start_seq <= {_HALF} AND coalesce(x.end_seq, 4611686018427387904) > {_HALF} GROUP BY ALL"
_AT = "SELECT locate, side, price, shares, orders FROM states WHERE orders > 0 AND seq <= {at} AND {at} < until"


def _half(b: Book) -> int:
    return (b.tape.agg(F.max("seq")).first()[0] or 0) // 2


query("level_snapshot_at_seq", _one(_FIFO, S.ORDERS))(lambda b: levels.fifo(b.eps, b.mods, _half(b)).drop("refs"))
query("book_diff", _one(f"SELECT locate, side, price, CASE WHEN b.shares IS NULL THEN 'only_a' WHEN a.shares IS NULL THEN 'only_b' ELSE 'changed' END AS what, a.shares AS shares_a, b.shares AS shares_b FROM ({_AT.format(at=_HALF)}) a FULL JOIN (SELECT locate, side, price, sum(remaining)::BIGINT AS shares, count(*) AS orders FROM eps WHERE end_seq IS NULL GROUP BY ALL) b USING (locate, side, price) WHERE a.shares IS DISTINCT FROM b.shares OR a.orders IS DISTINCT FROM b.orders", S.ORDERS, S.LEVELS))(
    lambda b: levels.difference(levels.at_message(b.states, _half(b)), levels.fifo(b.eps).drop("refs"))
)


def _differential(b: Book):
    """The book of running states against the book of episodes at eight messages: levels compared, and levels that differ."""
    last = b.tape.agg(F.max("seq")).first()[0] or 0
    out = None
    for k in range(1, 9):
        at = last * k // 8
        one, other = levels.at_message(b.states, at), levels.fifo(b.eps, b.mods, at).drop("refs")
        row = one.agg(F.count(F.lit(1)).alias("levels")).crossJoin(levels.difference(one, other).agg(F.count(F.lit(1)).alias("differ"))).select(F.lit(at).cast("long").alias("at_seq"), "levels", "differ")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


query("book_differential", _one("SELECT at_seq, count(s.seq) AS levels, 0::BIGINT AS differ FROM (SELECT (SELECT max(seq) FROM tape) * k // 8 AS at_seq FROM range(1, 9) r(k)) LEFT JOIN states s ON s.orders > 0 AND s.seq <= at_seq AND at_seq < s.until GROUP BY at_seq", S.ORDERS, S.LEVELS))(_differential)
_TEXT = lambda cs: "concat_ws('|', " + ", ".join(f"coalesce({c}::VARCHAR, '-')" for c in cs) + ")"
_EFFECT = ["seq", "mtype", "ref", "found", "taken"]
query("effect_digest", _one(f"SELECT mtype, count(*) AS n, sum(('0x' || substr(md5({_TEXT(_EFFECT)}), 1, 8))::BIGINT)::BIGINT AS digest FROM mods GROUP BY mtype", S.ORDERS))(lambda b: levels.digest(b.mods, _EFFECT, ["mtype"]))
_LEVEL = ["locate", "side", "price", "seq", "shares", "orders"]
query("book_digest", _one(f"SELECT side, count(*) AS n, sum(('0x' || substr(md5({_TEXT(_LEVEL)}), 1, 8))::BIGINT)::BIGINT AS digest FROM states GROUP BY side", S.ORDERS, S.LEVELS))(lambda b: levels.digest(b.states, _LEVEL, ["side"]))

# --- windows: audit columns and the universe ----------------------------------------------------------------

query("feature_audit", _book("SELECT locate, wid, feat_last_msg, label_first_msg, label_last_msg FROM feat", _WIN, variant="session"))(lambda b: b.features().select("locate", "wid", "feat_last_msg", "label_first_msg", "label_last_msg"))
query("leakage_ordering", _book("SELECT count(*) AS checked, count(*) FILTER (feat_last_msg >= label_first_msg) AS late_features, count(*) FILTER (label_first_msg > label_last_msg) AS empty_labels, min(label_first_msg - feat_last_msg) AS least_gap FROM feat", _WIN, variant="session"))(
    lambda b: b.features().agg(F.count(F.lit(1)).alias("checked"), F.sum((F.col("feat_last_msg") >= F.col("label_first_msg")).cast("long")).alias("late_features"), F.sum((F.col("label_first_msg") > F.col("label_last_msg")).cast("long")).alias("empty_labels"), F.min(F.col("label_first_msg") - F.col("feat_last_msg")).alias("least_gap"))
)
_TOP = lambda n: f"(SELECT locate FROM tape WHERE mtype IN ('A', 'F', 'E', 'C', 'X', 'D', 'U') GROUP BY locate ORDER BY count(*) DESC, locate DESC LIMIT {n})"
query("universe_features", _book(f"SELECT locate, count(*) AS n, round(avg(label_ticks), 6) AS mean_label FROM feat WHERE locate IN {_TOP(3)} GROUP BY locate", _WIN), "plain")(lambda b: windows.of_universe(b.features(), b.tape, 3).groupBy("locate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label_ticks"), 6).alias("mean_label")))

# --- queue: values, curve, seeds, schedule --------------------------------------------------------------------

_VAL = f"""tk AS (SELECT ts_ns, min(seq) AS seq FROM tape WHERE mtype IN {S.TICKS} GROUP BY ts_ns),
va0 AS (SELECT f.seq, f.locate, f.side, f.price, f.depth, f.spread, f.model, h, f.fill_ts + h * 1000000000 AS due FROM fl f, (VALUES (1::BIGINT), (10), (60)) v(h) WHERE f.fill_seq IS NOT NULL),
va1 AS (SELECT va0.*, tk.seq AS tick FROM va0 ASOF JOIN tk ON tk.ts_ns >= va0.due),
val AS (SELECT v.seq, v.model, v.h, v.depth, v.spread, CASE v.side WHEN 'B' THEN (i.bid + i.ask) / 2.0::DOUBLE - v.price ELSE v.price - (i.bid + i.ask) / 2.0::DOUBLE END AS value FROM va1 v ASOF JOIN ins i ON i.locate = v.locate AND i.seq <= v.tick WHERE i.bid IS NOT NULL AND i.ask IS NOT NULL)"""
_HS = "CASE WHEN spread > 0 THEN value / (spread / 2.0::DOUBLE) ELSE 0 END"
query("value_at_horizon", _book(f"SELECT seq, model, h AS horizon_s, round(value, 6) AS value, round({_HS}, 6) AS value_hs FROM val", *_QUEUE, _VAL), "plain")(lambda b: b.values().select("seq", "model", F.col("h").alias("horizon_s"), F.round("value", 6).alias("value"), F.round("value_hs", 6).alias("value_hs")))
query("mean_value_per_fill", _book(f"SELECT model, h AS horizon_s, count(*) AS fills, round(avg(value / 100.0::DOUBLE), 6) AS mean_ticks, round(sum({_HS}) / count(*), 6) AS mean_halfspreads FROM val GROUP BY ALL", *_QUEUE, _VAL), "plain")(lambda b: queue.mean_values(b.values()))
_MODELS = ["exact", "conservative", "optimistic", "proportional"]
query("fill_rate_by_symbol", _book("SELECT locate, count(*) FILTER (model = 'exact') AS placed, " + ", ".join(f"round(avg((fill_seq IS NOT NULL)::INTEGER) FILTER (model = '{m}'), 6) AS {m}" for m in _MODELS) + " FROM fl GROUP BY locate", *_QUEUE), "plain")(lambda b: queue.by_symbol(b.fills(), _MODELS))
_BIN = S._buckets("depth", queue.AHEAD_EDGES[1:])
_CURVE = f"""cu AS (SELECT bin, count(*) AS placed, count(DISTINCT locate) AS symbols, avg(depth) AS x, avg(f) AS r, count(*) >= 10 AND count(DISTINCT locate) >= 3 AS kept FROM (SELECT {_BIN} AS bin, depth, locate, (fill_seq IS NOT NULL)::INTEGER AS f FROM fl WHERE model = 'exact') GROUP BY bin)"""
_BEND = "2 * ((lead(r) OVER w - r) / (lead(x) OVER w - x) - (r - lag(r) OVER w) / (x - lag(x) OVER w)) / (lead(x) OVER w - lag(x) OVER w)"
query("fill_curve", _book(f"SELECT bin, placed, symbols, round(x, 6) AS mean_ahead, round(r, 6) AS fill_rate, kept, round(CASE WHEN kept THEN bend * 1e6 END, 6) AS bend FROM (SELECT *, {_BEND} AS bend FROM cu WINDOW w AS (PARTITION BY kept ORDER BY bin))", *_QUEUE, _CURVE), "plain")(lambda b: queue.curve(b.fills(models=["exact"]), 10, 3))


def _adjusted(b: Book):
    f = b.fills(models=["exact"]).groupBy(queue.edge_bucket(F.col("depth"), queue.AHEAD_EDGES).alias("bin"), "locate").agg(F.count(F.lit(1)).alias("placed"), F.sum(F.col("fill_seq").isNotNull().cast("long")).alias("filled"))
    rows = inference.adjusted_curve([tuple(r) for r in f.collect()])  # bins x symbols
    return b.tape.sparkSession.createDataFrame([(int(k), round(v, 6)) for k, v in rows], "bin int, fill_rate double").withColumn("ahead", queue.label(queue.AHEAD_EDGES))


query("fill_curve_adjusted", variant="plain")(_adjusted)
_SEEDS = [20190130, 1, 2]


def _seed_rates(b: Book):
    f = b.fills(models=["exact", "bernoulli"], seeds=tuple(_SEEDS)).groupBy("model", "seed").agg(F.avg(F.col("fill_seq").isNotNull().cast("double")).alias("r"))
    r = f.filter("model = 'bernoulli'").crossJoin(F.broadcast(f.filter("model = 'exact'").select(F.col("r").alias("e"))))  # one row on the right
    return r.agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.min("r"), 6).alias("least"), F.round(F.max("r"), 6).alias("most"), F.round(F.max("r") - F.min("r"), 6).alias("spread"), (F.bool_and(F.col("r") >= F.col("e")) | F.bool_and(F.col("r") <= F.col("e"))).alias("same_sign"))


_BERN = "LEFT JOIN thr USING (seq)"
query("seed_spread", _book(f"SELECT count(*) AS seeds, round(avg(r), 6) AS mean, round(min(r), 6) AS least, round(max(r), 6) AS most, round(max(r) - min(r), 6) AS spread, bool_and(r >= e) OR bool_and(r <= e) AS same_sign FROM (SELECT seed, avg((least(bernoulli, through) IS NOT NULL)::INTEGER) AS r, avg((least(exact, through) IS NOT NULL)::INTEGER) AS e FROM bern {_BERN} GROUP BY seed)", _QUEUE[0], S.seeded(_SEEDS)), "plain")(_seed_rates)
query("queue_bernoulli", _book(f"SELECT p.seq, p.locate, p.side, p.price, p.depth, least(bernoulli, through) AS fill_seq, CASE WHEN least(bernoulli, through) IS NULL THEN 'expired' WHEN least(bernoulli, through) = through THEN 'trade_through' ELSE 'execution_behind' END AS reason FROM pl p JOIN bern USING (seq) {_BERN}", _QUEUE[0], S.seeded(_SEEDS[:1])), "plain")(lambda b: b.fills(models=["bernoulli"]).select("seq", "locate", "side", "price", "depth", "fill_seq", "reason"))
query("cancel_attribution", _book(f"SELECT {S._buckets('depth', queue.DEPTH_EDGES[1:])} AS depth_bucket, count(*) AS placed, sum(total) AS cancelled, sum(ahead) AS ahead, round(sum(assumed), 3) AS assumed FROM att GROUP BY 1", _QUEUE[0], S.CANCELS), "plain")(lambda b: queue.cancel_attribution(b.alive(), b.moved()))
_GAP, _FRESH, _UNIVERSE, _SEED = 5_000_000_000, 60_000_000_000, 5, 77
_SCHEDULE = f"""lim AS (SELECT max(ts_ns) AS last FROM tape WHERE mtype IN {S.TICKS}),
tk AS (SELECT ts_ns, min(seq) AS seq FROM tape WHERE mtype IN {S.TICKS} GROUP BY ts_ns),
un AS (SELECT locate, row_number() OVER (ORDER BY count(*) DESC, locate DESC) AS rank FROM tape WHERE mtype IN ('A', 'F', 'E', 'C', 'X', 'D', 'U') GROUP BY locate ORDER BY rank LIMIT {_UNIVERSE}),
du AS (SELECT k, {OPEN_NS} + sum(floor(-ln(({_bits(str(_SEED), "k", "'gap'")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE) * {_GAP})::BIGINT) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS due FROM range(0, (SELECT (1.5 * (last - {OPEN_NS}) / {_GAP})::BIGINT + 100 FROM lim)) r(k)),
dt AS (SELECT k, tk.seq FROM du ASOF JOIN tk ON tk.ts_ns >= du.due),
fr AS (SELECT DISTINCT tk.seq FROM (SELECT {OPEN_NS} + j * {_FRESH} AS due FROM range(0, (SELECT (last - {OPEN_NS}) // {_FRESH} + 1 FROM lim)) r(j)) x ASOF JOIN tk ON tk.ts_ns >= x.due),
el AS (SELECT x.seq, list(x.locate ORDER BY x.rank) AS symbols FROM (SELECT fr.seq, un.* FROM fr, un) x ASOF JOIN ins i ON i.locate = x.locate AND i.seq <= x.seq WHERE i.bid IS NOT NULL AND i.ask IS NOT NULL GROUP BY x.seq),
pk AS (SELECT k, dt.seq, el.symbols[{_bits(str(_SEED), "k", "'pick'")} % len(el.symbols) + 1] AS locate, CASE WHEN {_bits(str(_SEED), "k", "'coin'")} % 2 = 0 THEN 'B' ELSE 'S' END AS side, row_number() OVER (PARTITION BY dt.seq ORDER BY k) > 64 AS overrun FROM dt ASOF JOIN el ON el.seq <= dt.seq),
sc AS (SELECT p.k, p.seq, p.locate, p.side, CASE WHEN i.bid IS NOT NULL AND i.ask IS NOT NULL AND NOT p.overrun THEN CASE p.side WHEN 'B' THEN i.bid ELSE i.ask END END AS price, CASE WHEN i.bid IS NOT NULL AND i.ask IS NOT NULL AND NOT p.overrun THEN CASE p.side WHEN 'B' THEN i.bid_qty ELSE i.ask_qty END END AS depth, p.overrun FROM pk p ASOF JOIN ins i ON i.locate = p.locate AND i.seq <= p.seq)"""


def _schedule(b: Book):
    from pyspark.sql.window import Window

    top = census.busiest(b.tape, _UNIVERSE).select("locate", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("locate"))).alias("rank"))
    return queue.schedule(b.tape, b.inside, top, _GAP, _FRESH, OPEN_NS, _SEED)


query("placement_schedule", _book("SELECT * FROM sc", _SCHEDULE), "plain")(_schedule)

# --- statistics -------------------------------------------------------------------------------------------

_MOVED = "feat WHERE label_ticks <> 0"


def _drawn(clusters: str, key: str, sums: list[str], replications: int, seed: int, by: str = "") -> str:
    """bt: sums over clusters drawn anew, replication by replication."""
    return f"""nm AS (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS no, count(*) OVER () AS g FROM (SELECT DISTINCT {key} FROM {clusters})),
dr AS (SELECT rep, {_bits(str(seed), "rep", "j")} % (SELECT max(g) FROM nm) AS no FROM range({replications}) a(rep), range((SELECT max(g) FROM nm)) b(j)),
bt AS (SELECT rep{by}, {", ".join(f"sum({s})::DOUBLE AS {s}" for s in sums)} FROM dr JOIN nm USING (no) JOIN {clusters} USING ({key}) GROUP BY rep{by})"""


_PER = f"clu AS (SELECT locate, sum((sign(ofi) = sign(label_ticks))::INTEGER)::DOUBLE AS s, count(*) AS c FROM {_MOVED} GROUP BY locate)"
_Z = inference.Z_ALPHA
query("accuracy_estimate", _book(f"SELECT n, g AS clusters, round(m, 6) AS mean, round(robust, 6) AS cluster_se, round(boot, 6) AS bootstrap_se, round(greatest(robust, boot), 6) AS se, round(m - {_Z} * greatest(robust, boot), 6) AS low, round(m + {_Z} * greatest(robust, boot), 6) AS high FROM (SELECT max(n)::BIGINT AS n, count(*) AS g, max(m) AS m, sqrt(count(*)::DOUBLE / (count(*) - 1) * sum((s - c * m) * (s - c * m))) / max(n) AS robust, (SELECT stddev_samp(s / c) FROM bt) AS boot FROM (SELECT *, sum(c) OVER () AS n, sum(s) OVER () / sum(c) OVER () AS m FROM clu))", _WIN, _PER, _drawn("clu", "locate", ["s", "c"], 200, 7)), "plain")(lambda b: inference.estimate(b.features().filter("label_ticks <> 0"), inference.hit("ofi"), "locate"))
_SUMS = ["xy", "xx", "yy", "sy", "n"]
_XY = f"clu AS (SELECT locate, sum(ofi * label_halfspreads) AS xy, sum(ofi * ofi) AS xx, sum(label_halfspreads * label_halfspreads) AS yy, sum(label_halfspreads) AS sy, count(*) AS n FROM {_MOVED} GROUP BY locate)"
_R2 = "1 - (yy - 2 * (xy / nullif(xx, 0)) * xy + (xy / nullif(xx, 0)) * (xy / nullif(xx, 0)) * xx) / nullif(yy - sy * sy / n, 0)"
query("r2_errors", _book(f"SELECT max(n2)::BIGINT AS n, count(*) AS clusters, round(max(r2), 6) AS r2, (SELECT round(stddev_samp({_R2}), 6) FROM bt) AS bootstrap_se, round(sqrt(count(*)::DOUBLE / (count(*) - 1) * sum(psi * psi)), 6) AS influence_se FROM (SELECT *, ((yy - 2 * m * sy + n * m * m) * (1 - r2) - (yy - 2 * beta * xy + beta * beta * xx)) / base AS psi FROM clu, (SELECT sum(n) AS n2, sum(xy) / sum(xx) AS beta, sum(sy) / sum(n) AS m, sum(yy) - sum(sy) * sum(sy) / sum(n) AS base, 1 - (sum(yy) - 2 * (sum(xy) / sum(xx)) * sum(xy) + (sum(xy) / sum(xx)) * (sum(xy) / sum(xx)) * sum(xx)) / (sum(yy) - sum(sy) * sum(sy) / sum(n)) AS r2 FROM clu))", _WIN, _XY, _drawn("clu", "locate", _SUMS, 200, 11)), "plain")(
    lambda b: inference.r_squared_errors(b.features().filter("label_ticks <> 0"), "ofi", "label_halfspreads", "locate")
)
_ERR = f"""er AS (SELECT feature, max(n)::BIGINT AS n, count(*) AS clusters, max(m) AS accuracy, CASE WHEN count(*) > 1 THEN sqrt(count(*)::DOUBLE / (count(*) - 1) * sum((s - c * m) * (s - c * m))) / max(n) END AS se
  FROM (SELECT *, sum(c) OVER w AS n, sum(s) OVER w / sum(c) OVER w AS m FROM (SELECT feature, locate, sum((sign(f) = sign(label_ticks))::INTEGER)::DOUBLE AS s, count(*) AS c FROM (SELECT locate, label_ticks, unnest([{", ".join(f"'{f}'" for f in FEATURES)}]) AS feature, unnest([{", ".join(FEATURES)}]) AS f FROM {_MOVED}) GROUP BY ALL) WINDOW w AS (PARTITION BY feature)) GROUP BY feature)"""
_POWER = inference.Z_ALPHA + inference.Z_POWER
query("power_table", _book(f"SELECT feature, planned, round({_POWER} * se * sqrt(clusters / planned::DOUBLE), 6) AS detectable FROM er, (VALUES (5), (20), (60), (250)) v(planned)", _WIN, _ERR), "plain")(lambda b: inference.power_table(inference.errors_by_feature(b.features(), FEATURES, "locate"), [5, 20, 60, 250]))
query("feature_selection", _book(f"SELECT feature, clusters, round(ratio, 6) AS ratio, k = 1 AND clusters >= 5 AS chosen FROM (SELECT *, row_number() OVER (ORDER BY ratio, feature) AS k FROM (SELECT *, {_POWER} * se / (0.05::DOUBLE / (SELECT avg(abs(label_halfspreads)) FROM {_MOVED})) AS ratio FROM er))", _WIN, _ERR), "plain")(
    lambda b: inference.selection(inference.errors_by_feature(b.features(), FEATURES, "locate"), b.features().filter("label_ticks <> 0").agg(F.avg(F.abs("label_halfspreads")).alias("m")), 5)
)
_REPS = 19
_PERM = f"""pm0 AS (SELECT rep, locate, label_ticks, {", ".join(FEATURES)}, row_number() OVER (PARTITION BY rep, locate ORDER BY wid) AS here, row_number() OVER (PARTITION BY rep, locate ORDER BY {_bits("3", "rep", "wid")}, wid) AS there FROM feat, range({_REPS}) r(rep) WHERE label_ticks <> 0),
pm1 AS (SELECT a.rep, a.label_ticks, b.label_ticks AS other, unnest([{", ".join(f"'{f}'" for f in FEATURES)}]) AS feature, unnest([{", ".join(f"a.{f}" for f in FEATURES)}]) AS f FROM pm0 a JOIN pm0 b ON b.rep = a.rep AND b.locate = a.locate AND b.there = a.here),
pm AS (SELECT feature, round(any_value(own), 6) AS accuracy, round(avg(nul), 6) AS null_mean, (1 + count(*) FILTER (nul >= own)) / (1 + count(*))::DOUBLE AS p FROM (SELECT feature, rep, avg((sign(f) = sign(label_ticks))::INTEGER) AS own, avg((sign(f) = sign(other))::INTEGER) AS nul FROM pm1 GROUP BY ALL) GROUP BY feature)"""
query("permutation_null", _book("SELECT feature, accuracy, null_mean, round(p, 6) AS p FROM pm", _WIN, _PERM), "plain")(lambda b: inference.permuted_accuracies(b.features(), FEATURES, _REPS).withColumn("p", F.round("p", 6)))
query("holm_adjust", _book("SELECT feature AS name, p, round(least(1.0, max(p * (6 - k)) OVER (ORDER BY p, feature ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM (SELECT *, row_number() OVER (ORDER BY p, feature) AS k FROM pm)", _WIN, _PERM), "plain")(lambda b: inference.holm(inference.permuted_accuracies(b.features(), FEATURES, _REPS).select(F.col("feature").alias("name"), "p"), 5))
_LAG = {"ofi": "ofi_lag1", "queue_imbalance": "queue_imbalance_lag1"}
query("leakage_lag", _book(" UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg((sign({f}) = sign(label_ticks))::INTEGER), 6) AS base, round(avg((sign({g}) = sign(label_ticks))::INTEGER), 6) AS lagged, round(avg((sign({g}) = sign(label_ticks))::INTEGER) - avg((sign({f}) = sign(label_ticks))::INTEGER), 6) AS change FROM {_MOVED}" for f, g in _LAG.items()), _WIN), "plain")(
    lambda b: inference.errors_by_feature(b.features(), [*_LAG], "locate").select("feature", F.col("accuracy").alias("base")).join(inference.errors_by_feature(b.features(lag1=True), [*_LAG], "locate").select("feature", F.col("accuracy").alias("lagged")), "feature").select("feature", F.round("base", 6).alias("base"), F.round("lagged", 6).alias("lagged"), F.round(F.col("lagged") - F.col("base"), 6).alias("change"))
)
_SYM = "clu AS (SELECT locate, model, count(*) AS placed, count(fill_seq) AS filled FROM fl GROUP BY ALL)"


def _bias_errors(b: Book):
    per = b.fills().groupBy("locate", "model").agg(F.count(F.lit(1)).alias("placed"), F.sum(F.col("fill_seq").isNotNull().cast("long")).alias("filled"))
    r = inference.resampled(per, "locate", ["placed", "filled"], 200, 13).select("rep", "model", (F.col("filled") / F.col("placed")).alias("r"))
    d = r.join(r.filter("model = 'exact'").select("rep", F.col("r").alias("e")), "rep").filter("model <> 'exact'").withColumn("d", F.col("r") - F.col("e"))
    return d.groupBy("model").agg(F.round(F.avg("d"), 6).alias("mean_bias"), F.round(F.stddev_samp("d"), 6).alias("se"), F.round(F.percentile("d", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("d", F.lit(0.975)), 6).alias("high"))


query("symbol_bootstrap_bias", _book("SELECT model, round(avg(d), 6) AS mean_bias, round(stddev_samp(d), 6) AS se, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM (SELECT a.model, a.filled / a.placed - e.filled / e.placed AS d FROM bt a JOIN bt e ON e.rep = a.rep AND e.model = 'exact' WHERE a.model <> 'exact') GROUP BY model", *_QUEUE, _SYM, _drawn("clu", "locate", ["placed", "filled"], 200, 13, ", model")), "plain")(_bias_errors)
