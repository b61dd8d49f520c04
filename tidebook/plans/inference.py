"""Registered queries of the statistics, source and stream layers, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidebook.functions.layout import LENGTHS
from tidebook.operators.tape import tape
from tidebook.operators.windows import FEATURES
from tidebook.plans import sql as S
from tidebook.plans.market import Book, _book, _WIN
from tidebook.sources import frames
from tidebook.stats import inference
from tidebook.streaming import datagrams

QUERIES: dict = {}
SQL: dict[str, str] = {}

_hits = "CASE WHEN label_ticks <> 0 THEN (sign({f}) = sign(label_ticks))::INTEGER END"
QUERIES["directional_accuracy"] = lambda spark, d: inference.accuracies(Book(spark, d).features(), FEATURES)
SQL["directional_accuracy"] = _book(" UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) FILTER (label_ticks <> 0) AS n, round(avg({_hits.format(f=f)}), 6) AS accuracy, round(avg(sign({f}) * label_halfspreads), 6) AS value, round(avg(CASE WHEN label_ticks <> 0 THEN ({f} > 0)::INTEGER END) * avg(CASE WHEN label_ticks <> 0 THEN (label_ticks > 0)::INTEGER END) + avg(CASE WHEN label_ticks <> 0 THEN ({f} < 0)::INTEGER END) * avg(CASE WHEN label_ticks <> 0 THEN (label_ticks < 0)::INTEGER END), 6) AS null_accuracy FROM feat" for f in FEATURES), _WIN)
QUERIES["cluster_se"] = lambda spark, d: inference.clustered(Book(spark, d).features().filter("label_ticks <> 0"), inference.hit("ofi"), ["locate"])
SQL["cluster_se"] = _book("SELECT n::BIGINT AS n, count(*) AS clusters, round(max(m), 6) AS mean, round(CASE WHEN count(*) > 1 THEN sqrt(count(*)::DOUBLE / (count(*) - 1) * sum((s - c * m) * (s - c * m))) / max(n) END, 6) AS se FROM (SELECT *, sum(c) OVER () AS n, sum(s) OVER () / sum(c) OVER () AS m FROM (SELECT locate, sum((sign(ofi) = sign(label_ticks))::INTEGER)::DOUBLE AS s, count(*) AS c FROM feat WHERE label_ticks <> 0 GROUP BY locate)) GROUP BY n", _WIN)
QUERIES["ols_r2"] = lambda spark, d: inference.r_squared(Book(spark, d).features().filter("label_ticks <> 0"), "ofi", "label_halfspreads")
SQL["ols_r2"] = _book("SELECT n, round(xy / xx, 6) AS beta, round(((yy - sy * sy / n) - (yy - 2 * (xy / xx) * xy + (xy / xx) * (xy / xx) * xx)) / (yy - sy * sy / n), 6) AS r2 FROM (SELECT count(*) AS n, sum(ofi * label_halfspreads) AS xy, sum(ofi * ofi) AS xx, sum(label_halfspreads * label_halfspreads) AS yy, sum(label_halfspreads) AS sy FROM feat WHERE label_ticks <> 0)", _WIN)

def _series(spark, d):
    """The hit series of each symbol, in order (a number for each moved window)."""
    f = Book(spark, d).features().filter("label_ticks <> 0").select("locate", "wid", inference.hit("queue_imbalance").alias("h")).toPandas().sort_values(["locate", "wid"])
    return [g["h"].to_numpy() for _, g in f.groupby("locate")]


def stationary_bootstrap(spark, d):
    x = _series(spark, d)
    block = max(map(inference.block_length, x), default=1.0)
    se = inference.stationary_bootstrap_se(spark, x, block, 1000) if x else float("nan")
    return spark.createDataFrame([(float(block), se, float(np.concatenate(x).mean()) if x else None)], "block double, se double, mean double")


QUERIES["stationary_bootstrap"] = stationary_bootstrap
_CODED = ["type", "locate", "ts_ns", "ref", "new_ref", "side", "price", "shares", "match"]
QUERIES["frames_decode"] = lambda spark, d: frames.decoded(frames.frames(frames.encoded(tape(spark, d, "full")))).select("session", "seq", *[F.col(c).alias("mtype" if c == "type" else c) for c in _CODED])
SQL["frames_decode"] = S.query("SELECT 'S' || locate AS session, row_number() OVER (PARTITION BY locate ORDER BY seq) AS seq, mtype, locate::BIGINT AS locate, ts_ns, CASE WHEN mtype IN ('A', 'F', 'E', 'C', 'X', 'D', 'U', 'P') THEN coalesce(ref, 0) END AS ref, new_ref, CASE WHEN mtype = 'P' THEN '' ELSE side END AS side, CASE WHEN mtype IN ('A', 'F', 'C', 'U', 'P', 'Q') THEN price END AS price, CASE WHEN mtype IN ('A', 'F', 'E', 'C', 'X', 'U', 'P', 'Q') THEN qty END AS shares, CASE WHEN mtype IN ('E', 'C', 'P', 'Q', 'B') THEN \"match\" END AS \"match\" FROM tape", variant="full")
_LENGTH = "CASE mtype " + " ".join(f"WHEN '{t}' THEN {n + 2}" for t, n in LENGTHS.items()) + " END"


def parse_statistics(spark, d):
    """Of damaged sessions: what is framed, skipped and left."""
    sessions = frames.damaged(frames.encoded(tape(spark, d, "full")))
    return frames.parse_statistics(frames.frames(sessions), sessions)


QUERIES["parse_statistics"] = parse_statistics
SQL["parse_statistics"] = S.query(f"SELECT 'S' || locate AS session, count(*) AS ok, (locate % 3 = 0)::BIGINT AS unknown_type, (locate % 2 = 1)::BIGINT AS length_mismatch, (locate % 2 = 0)::BIGINT AS end_marker, (locate % 4 = 1)::BIGINT AS truncated, CASE WHEN locate % 2 = 0 THEN 'end_marker' WHEN locate % 4 = 1 THEN 'truncated' ELSE 'exhausted' END AS ended, locate % 3 <> 0 AND locate % 2 = 0 AS clean, (sum({_LENGTH}) + CASE WHEN locate % 2 = 1 THEN 11 ELSE 0 END + CASE WHEN locate % 3 = 0 THEN 7 ELSE 0 END + CASE WHEN locate % 2 = 0 THEN 7 ELSE 0 END + CASE WHEN locate % 4 = 1 THEN 3 ELSE 0 END)::BIGINT AS bytes, (CASE WHEN locate % 2 = 0 THEN 5 ELSE 0 END)::BIGINT AS trailing FROM tape GROUP BY locate", variant="full")
QUERIES["directory_decode"] = lambda spark, d: frames.decoded(frames.frames(frames.encoded(tape(spark, d, "session")))).filter("type in ('R', 'S', 'h')").select("session", "seq", F.col("type").alias("mtype"), "ts_ns", "stock", "market_category", "code", "market", "action")
SQL["directory_decode"] = S.query("SELECT * FROM (SELECT 'S' || locate AS session, row_number() OVER (PARTITION BY locate ORDER BY seq) AS seq, mtype, ts_ns, CASE WHEN mtype <> 'S' THEN stock END AS stock, CASE WHEN mtype = 'R' THEN code END AS market_category, CASE WHEN mtype = 'S' THEN code END AS code, CASE WHEN mtype = 'h' THEN market END AS market, CASE WHEN mtype = 'h' THEN code END AS action FROM tape) WHERE mtype IN ('R', 'S', 'h')", variant="session")
QUERIES["datagram_delivery"] = lambda spark, d: datagrams.received(datagrams.packets(tape(spark, d), 7))
_EXPECT = "CASE WHEN header <> session OR count = 65535 THEN 0 WHEN NOT whole THEN first - 1 ELSE first + count - 1 END"
SQL["datagram_delivery"] = S.query(
    f"""SELECT session, arrival, outcome, delivered, missed, max((missed > 0)::INTEGER) OVER (PARTITION BY session ORDER BY arrival ROWS UNBOUNDED PRECEDING) = 1 AS stale FROM (SELECT session, arrival,
    CASE WHEN header <> session THEN 'other_session' WHEN count = 65535 THEN 'end_of_session' WHEN NOT whole THEN 'malformed' WHEN count = 0 THEN CASE WHEN gap > 0 THEN 'gap' ELSE 'heartbeat' END WHEN got = 0 THEN 'duplicate' WHEN gap > 0 THEN 'gap' WHEN got < count THEN 'trimmed' ELSE 'in_order' END AS outcome,
    CASE WHEN header = session AND count <> 65535 AND whole THEN got ELSE 0 END AS delivered, CASE WHEN header = session AND count <> 65535 THEN gap ELSE 0 END AS missed
  FROM (SELECT *, greatest(0, first - expected) AS gap, greatest(0, least(count, first + count - expected)) AS got FROM (SELECT *, coalesce(max({_EXPECT}) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS expected FROM pk)))""",
    "pk0 AS (SELECT locate, (n - 1) // 7 AS k, min(n) AS first, count(*) AS count FROM (SELECT locate, row_number() OVER (PARTITION BY locate ORDER BY seq) AS n FROM tape) GROUP BY ALL)",
    "pk AS (SELECT 'S' || locate AS session, 'S' || locate AS header, 2 * k AS arrival, first, CASE WHEN k % 17 = 9 THEN 0 ELSE count END AS count, true AS whole FROM pk0 WHERE k % 10 <> 3 UNION ALL SELECT 'S' || locate, CASE WHEN k % 13 = 6 THEN 'X' ELSE 'S' || locate END, 2 * k + 5, first, count, k % 11 <> 5 FROM pk0 WHERE k % 7 <> 3 UNION ALL SELECT 'S' || locate, 'S' || locate, 2 * max(k) + 7, max(first + count), 65535, true FROM pk0 GROUP BY locate)",
)


def universe_overlap(spark, d):
    """Symbols among the five busiest users of even and of odd days."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", (F.dayofmonth("ts") % 2).alias("odd"))
    top = lambda k: e.filter(F.col("odd") == k).groupBy("user_id").count().orderBy(F.desc("count"), F.desc("user_id")).limit(50).select("user_id")
    return top(0).intersect(top(1)).agg(F.count(F.lit(1)).alias("common"))


QUERIES["universe_overlap"] = universe_overlap
SQL["universe_overlap"] = "WITH c AS (SELECT user_id, day(ts) % 2 AS odd, count(*) AS n FROM events GROUP BY ALL) SELECT count(*) AS common FROM ((SELECT user_id FROM c WHERE odd = 0 ORDER BY n DESC, user_id DESC LIMIT 50) INTERSECT (SELECT user_id FROM c WHERE odd = 1 ORDER BY n DESC, user_id DESC LIMIT 50))"
