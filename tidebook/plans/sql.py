"""The tape and the book in DuckDB SQL: the common table expressions that the oracles are made of."""

from __future__ import annotations

_E = """e AS (SELECT event_id + 1 AS seq, (user_id % 8 + 1)::INTEGER AS locate,
  34200000000000 + ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 13000) // 1440 AS ts_ns, cast(round(value * 100) AS BIGINT) AS c, event_type FROM events)"""
_ERROR = "CASE c % 4 WHEN 0 THEN 'X' WHEN 3 THEN 'U' ELSE 'D' END"
_PLAIN = f"CASE WHEN event_type IN ('view', 'purchase') THEN 'A' WHEN event_type = 'signup' THEN 'F' WHEN event_type = 'click' THEN 'E' ELSE {_ERROR} END"
_FULL = f"""CASE WHEN event_type = 'view' THEN CASE c % 23 WHEN 0 THEN 'P' WHEN 1 THEN 'Q' WHEN 2 THEN 'H' WHEN 3 THEN 'h' WHEN 4 THEN 'B' ELSE 'A' END
  WHEN event_type = 'purchase' THEN 'A' WHEN event_type = 'signup' THEN 'F' WHEN event_type = 'click' THEN CASE WHEN c % 7 = 0 THEN 'C' ELSE 'E' END ELSE {_ERROR} END"""
_PRICE = {
    "plain": "CASE WHEN bid THEN 1000000 - 100 * ((c // 2) % 5) ELSE 1000100 + 100 * ((c // 2) % 5) END",
    "full": "CASE WHEN bid THEN 1000000 + 100 * ((c // 2) % 9 - 5) ELSE 1000000 + 100 * ((c // 2) % 9 - 3) END",
}


def tape(variant: str = "plain") -> str:
    if variant == "session":
        return _session()
    return f"""{_E},
t1 AS (SELECT *, {_FULL if variant == "full" else _PLAIN} AS mtype FROM e),
t2 AS (SELECT *, coalesce(sum((mtype IN ('A', 'F'))::BIGINT) OVER (PARTITION BY locate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS nb FROM t1),
t3 AS (SELECT *, seq AS own, NULL::BIGINT AS renamed, CASE WHEN mtype IN ('E', 'C', 'X', 'D', 'U') AND nb > 0 THEN nb - c % least(nb, 20) END AS target FROM t2),
tape AS ({_rows(_PRICE[variant], "'Q'")})"""


def _rows(price: str, market: str, subcent: str = "") -> str:
    return f"""SELECT t3.seq, t3.locate, t3.ts_ns, t3.mtype, CASE WHEN t3.mtype IN ('A', 'F') THEN t3.own ELSE coalesce(t3.renamed, a.own) END AS ref, CASE WHEN t3.mtype = 'U' THEN t3.seq + 1000000000 END AS new_ref,
  CASE WHEN t3.mtype IN ('A', 'F') THEN CASE WHEN t3.c % 2 = 0 THEN 'B' ELSE 'S' END END AS side,
  CASE WHEN t3.mtype IN ('A', 'F', 'U', 'P', 'C', 'Q') THEN {price.replace("c //", "t3.c //").replace("bid", "CASE WHEN t3.mtype = 'U' THEN coalesce(a.c % 2 = 0, true) ELSE t3.c % 2 = 0 END")} {subcent} END::BIGINT AS price,
  CASE WHEN t3.mtype NOT IN ('D', 'H', 'h', 'B') THEN CASE WHEN t3.mtype = 'Q' THEN 100 * ((t3.c // 10) % 3) ELSE 100 * (1 + (t3.c // 10) % 7) END END::BIGINT AS qty,
  'SYM' || t3.locate AS stock,
  CASE t3.mtype WHEN 'H' THEN ['H', 'P', 'Q', 'T'][(t3.c // 23) % 4 + 1] WHEN 'h' THEN CASE WHEN (t3.c // 23) % 2 = 0 THEN 'H' ELSE 'T' END WHEN 'Q' THEN ['O', 'C', 'H', 'I'][(t3.c // 23) % 4 + 1] END AS code, t3.c AS "match",
  CASE WHEN t3.mtype = 'h' THEN {market} END AS market
  FROM t3 LEFT JOIN t3 a ON a.locate = t3.locate AND a.mtype IN ('A', 'F') AND a.nb + 1 = t3.target"""


def _session() -> str:
    kind = f"CASE WHEN event_type = 'view' THEN CASE WHEN c % 101 = 0 THEN 'P' WHEN c % 503 = 1 THEN 'H' WHEN c % 503 = 2 THEN 'h' ELSE 'A' END ELSE {_PLAIN} END"
    head = ["(1, 0, -4, 'S', NULL, 'O')", *[f"({1 + k}, {k}, -3, 'R', 'SYM{k}', 'Q')" for k in range(1, 8)], "(10, 0, -2, 'S', NULL, 'S')", "(11, 0, -1, 'S', NULL, 'Q')"]
    tail = ["(2 * n - 79, 0, 0, 'S', NULL, 'M')", "(2 * n - 39, 0, 1, 'S', NULL, 'E')", "(2 * n + 31, 1, 2, 'R', 'SYM1B', 'Q')", "(2 * n + 33, 0, 3, 'S', NULL, 'C')"]
    rows = lambda base, xs: " UNION ALL ".join(f"SELECT {s}, {l}::INTEGER, {base} + {t}, '{k}', NULL::BIGINT, NULL::BIGINT, NULL, NULL::BIGINT, NULL::BIGINT, {stock}, '{code}', NULL::BIGINT, NULL FROM cnt" for s, l, t, k, stock, code in (x[1:-1].replace("'", "").split(", ") for x in xs) for stock in [stock if stock == "NULL" else f"'{stock}'"])  # noqa: E731, E741
    before = "OVER (PARTITION BY locate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{_E.replace("event_id + 1 AS seq", "2 * event_id + 20 AS seq")},
cnt AS (SELECT count(*) AS n FROM events),
t1 AS (SELECT *, {kind} AS mtype FROM e),
t2 AS (SELECT *, coalesce(sum((mtype IN ('A', 'F'))::BIGINT) {before}, 0)::BIGINT AS nb, coalesce(sum((mtype = 'U')::BIGINT) {before}, 0)::BIGINT AS nu FROM t1),
t2a AS (SELECT x.*, coalesce(y.seq, x.seq) AS own FROM t2 x LEFT JOIN t2 y ON x.mtype IN ('A', 'F') AND x.c % 13 = 0 AND x.nb > 40 AND y.locate = x.locate AND y.mtype IN ('A', 'F') AND y.nb + 1 = x.nb - 30 - x.c % 5),
t3 AS (SELECT x.*, y.seq + 1000000000 AS renamed, CASE WHEN x.mtype IN ('E', 'C', 'X', 'D', 'U') AND x.nb > 0 THEN x.nb - x.c % least(x.nb, 20) END AS target
  FROM t2a x LEFT JOIN t2a y ON x.mtype IN ('E', 'C', 'X', 'D', 'U') AND x.nb > 0 AND x.c % 5 < 3 AND x.nu > 0 AND y.locate = x.locate AND y.mtype = 'U' AND y.nu + 1 = x.nu - x.c % greatest(1, least(x.nu, 4))),
tape AS ({_rows(_PRICE["plain"], "CASE WHEN (t3.c // 46) % 2 = 0 THEN 'B' ELSE 'Q' END", "+ CASE WHEN t3.mtype = 'P' THEN t3.c % 3 * 25 ELSE 0 END")}
  UNION ALL {rows(34200000000000, head)} UNION ALL {rows(57600000000000, tail)})"""


#: Each start's life is worked out as if its order existed; then a recursion from the adds, along the replacements that end a life, says which exist.
ORDERS = """st AS (SELECT ref, seq AS start_seq, ts_ns AS start_ts, locate, side, price, qty AS shares0, mtype AS via FROM tape WHERE mtype IN ('A', 'F')
  UNION ALL SELECT new_ref, seq, ts_ns, NULL, NULL, price, qty, 'U' FROM tape WHERE mtype = 'U'),
m0 AS (SELECT t.seq, t.ts_ns, t.mtype, t.qty, t.ref, s.start_seq, s.shares0 FROM (SELECT * FROM tape WHERE mtype IN ('E', 'C', 'X', 'D', 'U')) t ASOF LEFT JOIN st s ON s.ref = t.ref AND s.start_seq < t.seq),
m1 AS (SELECT *, coalesce(sum(CASE WHEN mtype IN ('E', 'C', 'X') THEN qty END) OVER b, 0)::BIGINT AS gone, coalesce(bool_or(mtype IN ('D', 'U')) OVER b, false) AS ended FROM m0 WINDOW b AS (PARTITION BY ref, start_seq ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m2 AS (SELECT *, coalesce(start_seq IS NOT NULL AND NOT ended AND gone < shares0, false) AS alive FROM m1),
ex AS (WITH RECURSIVE r AS (SELECT ref, start_seq, locate, side FROM st WHERE via <> 'U' UNION ALL
    SELECT c.ref, c.start_seq, r.locate, r.side FROM r JOIN m2 p ON p.ref = r.ref AND p.start_seq = r.start_seq AND p.mtype = 'U' AND p.alive JOIN st c ON c.via = 'U' AND c.start_seq = p.seq) SELECT * FROM r),
ep0 AS (SELECT st.ref, ex.locate, ex.side, st.price, st.shares0, st.start_seq, st.start_ts, st.via, lead(st.start_seq) OVER w AS next_seq, lead(st.start_ts) OVER w AS next_ts FROM st JOIN ex ON ex.ref = st.ref AND ex.start_seq = st.start_seq WINDOW w AS (PARTITION BY st.ref ORDER BY st.start_seq)),
mods AS (SELECT * EXCLUDE (alive), found AND mtype IN ('E', 'C', 'X') AND qty > shares0 - gone AS over, found AND mtype IN ('E', 'C', 'X') AND qty >= shares0 - gone AS emptied,
    CASE WHEN found THEN CASE WHEN mtype IN ('E', 'C', 'X') THEN least(qty, shares0 - gone) ELSE shares0 - gone END END AS taken, greatest(0, shares0 - gone) AS rests
  FROM (SELECT m2.*, x.locate, x.side, x.price, x.start_ts, alive AND x.ref IS NOT NULL AS found FROM m2 LEFT JOIN ep0 x ON x.ref = m2.ref AND x.start_seq = m2.start_seq)),
ends AS (SELECT ref, start_seq, max(seq) FILTER (emptied OR mtype IN ('D', 'U')) AS end_seq, sum(CASE WHEN mtype IN ('E', 'C') THEN taken ELSE 0 END)::BIGINT AS executed, sum(CASE WHEN mtype = 'X' THEN taken ELSE 0 END)::BIGINT AS cancelled FROM mods WHERE found GROUP BY ref, start_seq),
eps AS (SELECT x.ref, x.locate, x.side, x.price, x.shares0, x.start_seq, x.start_ts, x.via, coalesce(n.end_seq, x.next_seq) AS end_seq, coalesce(g.ts_ns, x.next_ts) AS end_ts, coalesce(g.mtype, CASE WHEN x.next_seq IS NOT NULL THEN 'duplicate' END) AS end_by,
    coalesce(n.executed, 0) AS executed, coalesce(n.cancelled, 0) AS cancelled, CASE WHEN g.mtype IS NULL AND x.next_seq IS NULL THEN x.shares0 - coalesce(n.executed, 0) - coalesce(n.cancelled, 0) ELSE 0 END AS remaining
  FROM ep0 x LEFT JOIN ends n ON n.ref = x.ref AND n.start_seq = x.start_seq LEFT JOIN tape g ON g.seq = n.end_seq),
deltas AS (SELECT locate, side, price, start_seq AS seq, start_ts AS ts_ns, shares0 AS shares, 1 AS orders FROM eps
  UNION ALL SELECT locate, side, price, seq, ts_ns, -taken, CASE WHEN emptied OR mtype IN ('D', 'U') THEN -1 ELSE 0 END FROM mods WHERE found
  UNION ALL SELECT locate, side, price, end_seq, end_ts, executed + cancelled - shares0, -1 FROM eps WHERE end_by = 'duplicate')"""

LEVELS = """lv AS (SELECT locate, side, price, seq, sum(shares)::BIGINT AS ds, sum(orders)::BIGINT AS dn FROM deltas GROUP BY ALL),
states AS (SELECT locate, side, price, seq, (sum(ds) OVER w)::BIGINT AS shares, (sum(dn) OVER w)::BIGINT AS orders, lead(seq, 1, 4611686018427387904) OVER (PARTITION BY locate, side, price ORDER BY seq) AS until
  FROM lv WINDOW w AS (PARTITION BY locate, side, price ORDER BY seq ROWS UNBOUNDED PRECEDING))"""

INSIDE = """ins AS (SELECT t.seq, t.locate, t.ts_ns, t.mtype, max(s.price) FILTER (s.side = 'B') AS bid, min(s.price) FILTER (s.side = 'S') AS ask,
    arg_max(s.shares, s.price) FILTER (s.side = 'B') AS bid_qty, arg_min(s.shares, s.price) FILTER (s.side = 'S') AS ask_qty, arg_max(s.orders, s.price) FILTER (s.side = 'B') AS bid_orders, arg_min(s.orders, s.price) FILTER (s.side = 'S') AS ask_orders
  FROM tape t LEFT JOIN states s ON s.locate = t.locate AND s.orders > 0 AND s.seq <= t.seq AND t.seq < s.until GROUP BY ALL)"""


def query(select: str, *parts: str, variant: str = "plain") -> str:
    """WITH the tape and these parts, the select."""
    return "WITH " + ",\n".join([tape(variant), *parts]) + "\n" + select


TICKS = "('A', 'F', 'E', 'C', 'X', 'D', 'U', 'P', 'Q', 'B')"


def windows(n: int) -> str:
    """tch: touches with their window; win: full windows at their close; feat: labelled rows."""
    return f"""tc0 AS (SELECT t.seq, t.locate, t.ts_ns, t.mtype, t.qty, t.code, i.bid, i.ask, i.bid_qty, i.ask_qty, i.bid IS NOT NULL AND i.ask IS NOT NULL AND t.mtype <> 'H' AS valid,
    CASE WHEN m.found THEN CASE m.side WHEN 'B' THEN -1 ELSE 1 END ELSE 0 END AS sign FROM tape t JOIN ins i USING (seq) LEFT JOIN mods m ON m.seq = t.seq AND m.mtype IN ('E', 'C') WHERE t.mtype IN {TICKS} OR t.mtype = 'H'),
tc1 AS (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bid_qty) OVER w AS pbq, lag(ask_qty) OVER w AS paq, coalesce(lag(valid) OVER w, false) AS pv FROM tc0 WINDOW w AS (PARTITION BY locate, mtype <> 'H' ORDER BY seq)),
tc2 AS (SELECT *, valid AND pv AND NOT (bid = pb AND ask = pa AND bid_qty = pbq AND ask_qty = paq) AS upd FROM tc1),
tc3 AS (SELECT *, (sum(upd::BIGINT) OVER w)::BIGINT AS k, last_value(CASE WHEN mtype = 'H' THEN code END IGNORE NULLS) OVER w = 'H' AS halted,
    (CASE WHEN bid >= pb THEN bid_qty ELSE 0 END) - (CASE WHEN bid <= pb THEN pbq ELSE 0 END) - (CASE WHEN ask <= pa THEN ask_qty ELSE 0 END) + (CASE WHEN ask >= pa THEN paq ELSE 0 END) AS e, (bid_qty + ask_qty) / 2.0::DOUBLE AS depth
  FROM tc2 WINDOW w AS (PARTITION BY locate ORDER BY seq ROWS UNBOUNDED PRECEDING)),
tch AS (SELECT *, (k - upd::BIGINT) // {n} AS wid, upd AND k % {n} = 0 AS last_of, mtype = 'H' OR (upd AND coalesce(halted, false)) AS stained FROM tc3),
wi0 AS (SELECT locate, wid, max(seq) FILTER (last_of) AS close_seq, sum(e) FILTER (upd)::DOUBLE AS flow, sum(depth) FILTER (upd) AS depth, sum(CASE WHEN mtype IN ('E', 'C') THEN sign * qty ELSE 0 END)::DOUBLE AS signed,
    sum(CASE WHEN mtype IN ('E', 'C') THEN qty ELSE 0 END)::DOUBLE AS total, bool_or(stained) AS stained, min(ts_ns) FILTER (upd) AS start_ts, min(seq) AS first_seq, max(seq) AS last_seq FROM tch GROUP BY ALL),
win AS (SELECT w.locate, w.wid, w.close_seq, c.ts_ns AS close_ts, w.start_ts >= 34200000000000 AND c.ts_ns < 57600000000000 AND NOT w.stained AND c.bid_qty + c.ask_qty > 0 AND c.ask > c.bid AS usable,
    CASE WHEN w.depth / {n} > 0 THEN w.flow / (w.depth / {n}) ELSE 0 END AS ofi, (c.bid_qty - c.ask_qty)::DOUBLE / (c.bid_qty + c.ask_qty) AS queue_imbalance,
    CASE WHEN (w.depth - c.depth) / {n - 1} > 0 THEN (w.flow - c.e) / ((w.depth - c.depth) / {n - 1}) ELSE 0 END AS ofi_lag1, (c.pbq - c.paq)::DOUBLE / (c.pbq + c.paq) AS queue_imbalance_lag1,
    ((c.ask_qty * c.bid + c.bid_qty * c.ask)::DOUBLE / (c.bid_qty + c.ask_qty) - (c.bid + c.ask) / 2.0::DOUBLE) / 100.0::DOUBLE AS micro_dev, CASE WHEN w.total > 0 THEN w.signed / w.total ELSE 0 END AS trade_sign,
    (c.bid + c.ask) / 2.0::DOUBLE AS mid, c.ask - c.bid AS spread, c.bid, c.ask, c.bid_qty, c.ask_qty, w.first_seq, w.last_seq
  FROM wi0 w JOIN tch c ON c.seq = w.close_seq WHERE w.close_seq IS NOT NULL),
wn AS (SELECT *, lead(wid) OVER w AS n_wid, lead(usable) OVER w AS n_usable, lead(mid) OVER w AS n_mid, lead(close_seq) OVER w AS n_seq, lead(first_seq) OVER w AS n_first FROM win WINDOW w AS (PARTITION BY locate ORDER BY wid)),
feat AS (SELECT locate, wid, close_seq, close_ts, n_seq, last_seq AS feat_last_msg, n_first AS label_first_msg, n_seq AS label_last_msg, ofi, queue_imbalance, micro_dev, trade_sign, ofi_lag1, queue_imbalance_lag1, mid / 10000.0::DOUBLE AS mid, spread / 100.0::DOUBLE AS spread_ticks, (n_mid - mid) / 100.0::DOUBLE AS label_ticks, (n_mid - mid) / (spread / 2.0::DOUBLE) AS label_halfspreads
  FROM wn WHERE usable AND n_usable AND n_wid = wid + 1)"""


GATE = """ob0 AS (SELECT t.seq, t.locate, t.ts_ns, t.mtype, t.code, t.market, i.bid, i.ask, CASE WHEN i.bid IS NULL OR i.ask IS NULL THEN 0 WHEN t.mtype IN ('A', 'F', 'E', 'C', 'X', 'D') THEN 1 WHEN t.mtype = 'U' AND m.found THEN 2 ELSE 0 END AS weight
  FROM tape t JOIN ins i USING (seq) LEFT JOIN mods m ON m.seq = t.seq AND m.mtype = 'U'),
ob1 AS (SELECT *, last_value(CASE WHEN mtype = 'H' THEN code END IGNORE NULLS) OVER w AS state, coalesce(last_value(CASE WHEN mtype = 'h' AND market = 'Q' THEN code END IGNORE NULLS) OVER w = 'H', false) AS halt,
    last_value(CASE WHEN mtype = 'H' THEN code END IGNORE NULLS) OVER (PARTITION BY locate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM ob0 WINDOW w AS (PARTITION BY locate ORDER BY seq ROWS UNBOUNDED PRECEDING)),
ob2 AS (SELECT *, coalesce(mtype = 'H' AND code = 'T' AND was <> 'T', false) AS opens FROM ob1),
ob3 AS (SELECT *, sum(opens::INTEGER) OVER w AS reopening, last_value(CASE WHEN opens THEN ts_ns END IGNORE NULLS) OVER w AS opened_ts FROM ob2 WINDOW w AS (PARTITION BY locate ORDER BY seq ROWS UNBOUNDED PRECEDING)),
ob4 AS (SELECT *, weight > 0 AND bid >= ask AS bad, weight > 0 AND bid < ask AS clean, coalesce(ts_ns - opened_ts > 100000000, false) AS late FROM ob3),
obs AS (SELECT *, reopening > 0 AND NOT opens AND coalesce(sum((mtype = 'Q' OR clean OR (bad AND late))::INTEGER) OVER (PARTITION BY locate, reopening ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS awaiting FROM ob4)"""


def _buckets(x: str, edges: list) -> str:
    return "(" + " + ".join(f"({x} >= {e})::INTEGER" for e in edges) + ")"


def exits(edges: list[float]) -> str:
    """ex: removed orders with exit and life; hist: counts by exit and bucket."""
    table = "[" + ", ".join(f"{e!r}::DOUBLE" for e in edges) + "]"
    return f"""ex AS (SELECT ref, locate, CASE WHEN end_by = 'U' THEN 'replaced' WHEN end_by IN ('E', 'C') AND executed = shares0 THEN 'filled' WHEN end_by IN ('E', 'C') OR executed > 0 THEN 'partial_then_gone' ELSE 'cancelled' END AS exit, greatest(0, end_ts - start_ts) AS life_ns FROM eps WHERE end_by IS NOT NULL),
hist AS (SELECT exit, bucket, count(*) AS n, {table}[bucket + 1] AS low_ns FROM (SELECT exit, {_buckets("life_ns::DOUBLE", [repr(e) + "::DOUBLE" for e in edges[1:-1]])} AS bucket FROM ex) GROUP BY exit, bucket)"""


def median(source: str, key: str, edges: list[float], within: bool) -> str:
    """A select: the median of each key's histogram."""
    table = "[" + ", ".join(f"{e!r}::DOUBLE" for e in edges) + "]"
    lo, hi = f"{table}[bucket + 1]", f"{table}[bucket + 2]"
    value = f"{lo} * pow({hi} / {lo}, (0.5 - below) / (cum - below))" if within else f"sqrt({lo} * {hi})"
    return f"""SELECT {key}, round({value}, 3) AS median FROM (SELECT *, coalesce(lag(cum) OVER (PARTITION BY {key} ORDER BY bucket), 0) AS below FROM
  (SELECT {key}, bucket, sum(n) OVER (PARTITION BY {key} ORDER BY bucket ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER (PARTITION BY {key}) AS cum FROM {source})) WHERE cum >= 0.5 AND below < 0.5"""


FLOW = """flow AS (SELECT locate, sum((mtype IN ('A', 'F'))::BIGINT)::BIGINT AS adds, sum((mtype IN ('E', 'C'))::BIGINT)::BIGINT AS executes, sum((mtype = 'X')::BIGINT)::BIGINT AS cancels, sum((mtype = 'D')::BIGINT)::BIGINT AS deletes, sum((mtype = 'U')::BIGINT)::BIGINT AS replaces, sum((mtype = 'P')::BIGINT)::BIGINT AS trades,
    coalesce(sum(qty) FILTER (mtype IN ('A', 'F', 'U')), 0)::BIGINT AS shares_added, coalesce(sum(qty) FILTER (mtype IN ('E', 'C')), 0)::BIGINT AS shares_executed, (coalesce(sum(qty) FILTER (mtype = 'X'), 0) + coalesce(sum(rests) FILTER (mtype = 'U' AND found), 0))::BIGINT AS shares_cancelled, coalesce(sum(qty) FILTER (mtype = 'P'), 0)::BIGINT AS shares_nondisplayed
  FROM (SELECT t.locate, t.mtype, t.qty, m.found, m.rests FROM tape t LEFT JOIN mods m USING (seq)) GROUP BY locate)"""

SIZES = """sizes AS (SELECT shares_low, CASE WHEN shares_low < 1000 THEN shares_low + 1 WHEN shares_low < 100000 THEN shares_low + 100 END AS shares_high, count(*) AS n
  FROM (SELECT CASE WHEN qty < 1000 THEN qty WHEN qty < 100000 THEN qty // 100 * 100 ELSE 100000 END AS shares_low FROM tape WHERE mtype IN ('A', 'F', 'U')) GROUP BY shares_low)"""


def minutes(every_ns: int) -> str:
    return f"""sp0 AS (SELECT seq, ts_ns, (ts_ns - min(ts_ns) OVER ()) // {every_ns} AS cell FROM tape WHERE mtype IN {TICKS} AND ts_ns >= 34200000000000 AND ts_ns < 57600000000000),
sp1 AS (SELECT min(seq) AS seq, min(ts_ns) AS ts_ns FROM sp0 GROUP BY cell),
sp2 AS (SELECT s.locate, (p.ts_ns - 34200000000000) // 60000000000 AS minute, i.* EXCLUDE (seq, locate, ts_ns, mtype) FROM sp1 p CROSS JOIN (SELECT DISTINCT locate FROM tape) s ASOF JOIN ins i ON i.locate = s.locate AND i.seq <= p.seq WHERE i.bid IS NOT NULL AND i.ask IS NOT NULL),
mins AS (SELECT locate, minute, count(*) AS samples, count(*) FILTER (ask > bid) AS two_sided, round(coalesce(sum((ask - bid) // 100) FILTER (ask > bid), 0)::DOUBLE / greatest(count(*) FILTER (ask > bid), 1), 6) AS mean_spread,
    round(coalesce(sum(((ask - bid) // 100 = 1)::INTEGER) FILTER (ask > bid), 0)::DOUBLE / greatest(count(*) FILTER (ask > bid), 1), 6) AS one_tick, round(coalesce(sum(bid_qty) FILTER (ask > bid), 0)::DOUBLE / greatest(count(*) FILTER (ask > bid), 1), 6) AS bid_shares,
    round(coalesce(sum(ask_qty) FILTER (ask > bid), 0)::DOUBLE / greatest(count(*) FILTER (ask > bid), 1), 6) AS ask_shares, round(coalesce(sum(bid_orders) FILTER (ask > bid), 0)::DOUBLE / greatest(count(*) FILTER (ask > bid), 1), 6) AS bid_orders,
    round(coalesce(sum(ask_orders) FILTER (ask > bid), 0)::DOUBLE / greatest(count(*) FILTER (ask > bid), 1), 6) AS ask_orders FROM sp2 GROUP BY locate, minute)"""


def queue(every: int, life_ns: int) -> str:
    """pl: placements; qe: the events each sees; base: fills by trade-through and of the exact model."""
    return f"""pl0 AS (SELECT seq, locate, ts_ns, CASE WHEN (seq // {every}) % 2 = 0 THEN 'B' ELSE 'S' END AS side, bid, ask, bid_qty, ask_qty FROM ins WHERE seq % {every} = 0 AND bid IS NOT NULL AND ask IS NOT NULL),
pl AS (SELECT seq, locate, ts_ns, side, CASE side WHEN 'B' THEN bid ELSE ask END AS price, CASE side WHEN 'B' THEN bid_qty ELSE ask_qty END AS depth, ask - bid AS spread, coalesce((SELECT min(t.seq) FROM tape t WHERE t.mtype IN {TICKS} AND t.ts_ns >= pl0.ts_ns + {life_ns}), 4611686018427387904) AS last_seq FROM pl0),
ev AS (SELECT m.seq, m.ts_ns, m.locate, m.side, m.price, CASE WHEN m.mtype IN ('E', 'C') THEN 'exec' ELSE 'cancel' END AS kind, CASE WHEN m.mtype IN ('E', 'C', 'X') THEN m.qty ELSE m.rests END AS qty, m.start_seq, s.shares AS after
  FROM mods m LEFT JOIN states s ON s.locate = m.locate AND s.side = m.side AND s.price = m.price AND s.seq = m.seq WHERE m.found
  UNION ALL SELECT seq, ts_ns, locate, unnest(['B', 'S']), price, 'print', qty, NULL, NULL FROM tape WHERE mtype = 'P'),
qe AS (SELECT p.seq, p.side, p.price, p.depth, e.seq AS "at", e.ts_ns AS at_ts, CASE WHEN e.price = p.price THEN e.kind ELSE 'through' END AS kind, e.qty::DOUBLE AS qty, e.start_seq > p.seq AS behind, e.after::DOUBLE AS after
  FROM pl p JOIN ev e ON e.locate = p.locate AND e.side = p.side AND e.seq > p.seq AND e.seq <= p.last_seq AND (e.price = p.price OR (e.kind = 'exec' AND ((p.side = 'B' AND e.price < p.price) OR (p.side = 'S' AND e.price > p.price))))),
thr AS (SELECT seq, min("at") FILTER (kind = 'through') AS through, min("at") FILTER (kind = 'exec' AND behind) AS exact, min("at") FILTER (kind = 'print') AS printed FROM qe GROUP BY seq),
cum AS (SELECT seq, "at", kind, depth, coalesce(sum(CASE WHEN kind = 'exec' THEN qty ELSE 0 END) OVER w, 0) AS execs, coalesce(sum(CASE WHEN kind IN ('exec', 'cancel') THEN qty ELSE 0 END) OVER w, 0) AS alls FROM qe WINDOW w AS (PARTITION BY seq ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cl AS (SELECT seq, min("at") FILTER (kind = 'exec' AND execs >= depth) AS conservative, min("at") FILTER (kind = 'exec' AND alls >= depth) AS optimistic FROM cum GROUP BY seq),
nth AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY "at") AS i FROM qe WHERE kind IN ('exec', 'cancel')),
prop AS (WITH RECURSIVE r AS (SELECT seq, 0::BIGINT AS i, depth::DOUBLE AS a, NULL::BIGINT AS fill FROM pl UNION ALL
    SELECT r.seq, n.i, CASE WHEN n.kind = 'exec' THEN greatest(0, r.a - n.qty) WHEN n.after + n.qty > 0 THEN greatest(0, r.a - n.qty * (r.a / (n.after + n.qty))) ELSE r.a END, CASE WHEN r.fill IS NULL AND n.kind = 'exec' AND r.a <= 0 THEN n."at" ELSE r.fill END FROM r JOIN nth n ON n.seq = r.seq AND n.i = r.i + 1) SELECT seq, max(fill) AS proportional FROM r GROUP BY seq)"""


def seeded(seeds: list[int]) -> str:
    """bern: fills of the Bernoulli model for each seed, by draws that depend on seed, placement and event."""
    coin = "('0x' || substr(md5(r.seed || '-' || r.seq || '-' || n.\"at\"), 1, 8))::BIGINT % greatest(1, (n.after + n.qty)::BIGINT) < floor(r.a)"
    return f"""bern AS (WITH RECURSIVE r AS (SELECT seq, s AS seed, 0::BIGINT AS i, depth::DOUBLE AS a, NULL::BIGINT AS fill FROM pl, (SELECT unnest({seeds}) AS s) UNION ALL
    SELECT r.seq, r.seed, n.i, CASE WHEN n.kind = 'exec' THEN greatest(0, r.a - n.qty) WHEN n.after + n.qty > 0 AND {coin} THEN greatest(0, r.a - n.qty) ELSE r.a END, CASE WHEN r.fill IS NULL AND n.kind = 'exec' AND r.a <= 0 THEN n."at" ELSE r.fill END
    FROM r JOIN nth n ON n.seq = r.seq AND n.i = r.i + 1) SELECT seed, seq, max(fill) AS bernoulli FROM r GROUP BY seed, seq)"""


CANCELS = """att AS (WITH RECURSIVE r AS (SELECT seq, depth, 0::BIGINT AS i, depth::DOUBLE AS a, 0::DOUBLE AS total, 0::DOUBLE AS ahead, 0::DOUBLE AS assumed FROM pl UNION ALL
    SELECT r.seq, r.depth, n.i, CASE WHEN n.kind = 'exec' THEN greatest(0, r.a - n.qty) WHEN n.after + n.qty > 0 THEN greatest(0, r.a - n.qty * (r.a / (n.after + n.qty))) ELSE r.a END,
      r.total + CASE WHEN n.kind = 'cancel' AND n.after + n.qty > 0 THEN n.qty ELSE 0 END, r.ahead + CASE WHEN n.kind = 'cancel' AND n.after + n.qty > 0 AND NOT n.behind THEN n.qty ELSE 0 END,
      r.assumed + CASE WHEN n.kind = 'cancel' AND n.after + n.qty > 0 THEN n.qty * least(1, r.a / (n.after + n.qty)) ELSE 0 END
    FROM r JOIN nth n ON n.seq = r.seq AND n.i = r.i + 1) SELECT seq, depth, max(total) AS total, max(ahead) AS ahead, max(assumed) AS assumed FROM r GROUP BY seq, depth)"""


def fills(models: list[str], rule4: bool = False) -> str:
    """fl: a row for each placement and model."""
    one = " UNION ALL ".join(f"SELECT seq, '{m}' AS model, least({m}, through{', printed' if rule4 else ''}) AS fill_seq, through, {'printed' if rule4 else 'NULL::BIGINT'} AS printed FROM pl LEFT JOIN thr USING (seq) LEFT JOIN cl USING (seq){' LEFT JOIN prop USING (seq)' if m == 'proportional' else ''}" for m in models)
    return f"""fl AS (SELECT p.seq, p.locate, p.side, p.price, p.ts_ns, p.depth, p.spread, f.model, f.fill_seq, t.ts_ns AS fill_ts, CASE WHEN f.fill_seq IS NULL THEN 'expired' WHEN f.fill_seq = f.through THEN 'trade_through' WHEN f.fill_seq = f.printed THEN 'non_displayed_print' ELSE 'execution_behind' END AS reason
  FROM ({one}) f JOIN pl p USING (seq) LEFT JOIN tape t ON t.seq = f.fill_seq)"""
