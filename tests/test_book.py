"""The book against a step-by-step fold, one script for each rule, and the registered queries against their SQL."""

import glob
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidebook.operators import levels, orders
from tidebook.plans import registry

COLUMNS = "seq long, locate int, ts_ns long, mtype string, ref long, new_ref long, side string, price long, qty long, stock string, code string, match long, market string"
T0 = 34_200_000_000_000
SF = "/root/testdata/sf0.001"


def tape(spark, rows):
    """rows: (mtype, locate, ref, new_ref, side, price, qty)."""
    return spark.createDataFrame([(i + 1, r[1], T0 + 1000 * i, r[0], r[2], r[3], r[4], r[5], r[6], None, None, None, None) for i, r in enumerate(rows)], COLUMNS)


def fold(rows):
    """The book after every message, message by message: (bid, ask, bid_qty, ask_qty), and orphan counts."""
    live, out, orphans = {}, [], {}
    for k, locate, ref, new, side, price, qty in rows:
        if k in "AF":
            live[ref] = [locate, side, price, qty]
        elif ref not in live:
            orphans[k] = orphans.get(k, 0) + 1
        elif k in "ECX":
            live[ref][3] -= min(qty, live[ref][3])
            if live[ref][3] == 0:
                del live[ref]
        elif k == "D":
            del live[ref]
        elif k == "U":
            o = live.pop(ref)
            live[new] = [o[0], o[1], price, qty]
        best = []
        for s, f in (("B", max), ("S", min)):
            own = [o for o in live.values() if o[0] == locate and o[1] == s]
            p = f((o[2] for o in own), default=None)
            best.append((p, sum(o[3] for o in own if o[2] == p) if own else None))
        out.append((best[0][0], best[1][0], best[0][1], best[1][1]))
    return out, orphans, live


def built(spark, rows, rounds=None):
    t = tape(spark, rows)
    mods, eps = orders.effects(t, rounds)
    states = levels.level_states(orders.deltas(mods, eps))
    ins = levels.inside(t.select("seq", "locate"), states).orderBy("seq").collect()
    return [(r.bid, r.ask, r.bid_qty, r.ask_qty) for r in ins], mods, eps


A = lambda ref, side="B", price=1_500_000, qty=500: ("A", 1, ref, None, side, price, qty)
M = lambda k, ref, qty=None, new=None, price=None: (k, 1, ref, new, None, price, qty)

SCRIPTS = {
    "cumulative execute": [A(1), M("E", 1, 100), M("E", 1, 150)],
    "zero without delete": [A(1), M("E", 1, 500), A(2, "S", 1_500_100)],
    "delete after zero is an orphan": [A(1), M("X", 1, 500), M("D", 1)],
    "over-execution does not wrap": [A(1), A(2), M("E", 1, 900)],
    "replace keeps the side": [A(1), A(2, "S", 1_500_100), M("U", 1, 200, 7, 1_499_900)],
    "replace unknown is an orphan": [A(1), M("U", 9, 200, 7, 1_499_900), M("E", 7, 100)],
    "chained replaces": [A(1), M("U", 1, 300, 2, 1_499_900), M("U", 2, 400, 3, 1_499_800), M("E", 3, 100), M("D", 2), M("U", 3, 50, 4, 1_500_000), M("X", 4, 50)],
    "sides independent": [A(1), A(2, "S", 1_500_100), M("D", 1), M("D", 2)],
    "reused reference": [A(1), M("D", 1), A(1, "S", 1_500_200, 100), M("E", 1, 40)],
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_script(spark, name):
    got, mods, _ = built(spark, SCRIPTS[name])
    want, orphans, _ = fold(SCRIPTS[name])
    assert got == want
    assert {r.mtype: r["count"] for r in mods.filter("not found").groupBy("mtype").count().collect()} == orphans


def test_random_flow(spark):
    rng = random.Random(5)
    rows, refs, nxt = [], [], 1
    for _ in range(400):
        roll, locate = rng.randrange(100), rng.randrange(1, 4)
        if roll < 45 or not refs:
            rows.append(("A", locate, nxt, None, rng.choice("BS"), 1_500_000 + 100 * rng.randrange(8), 100 * rng.randrange(1, 6)))
            refs.append((nxt, locate))
            nxt += 1
            continue
        ref, own = rng.choice(refs)
        k = rng.choice("EECXDU")
        if k == "U":
            rows.append(("U", own, ref, nxt, None, 1_500_000 + 100 * rng.randrange(8), 100 * rng.randrange(1, 6)))
            refs.append((nxt, own))
            nxt += 1
        else:
            rows.append((k, own, ref, None, None, None, None if k == "D" else 100 * rng.randrange(1, 6)))
    got, _, eps = built(spark, rows)
    want, _, live = fold(rows)
    assert got == want
    assert {(r.ref, r.remaining) for r in eps.filter("end_seq is null").collect()} == {(k, v[3]) for k, v in live.items()}


def test_duplicate_live_add_wins(spark):
    _, _, eps = built(spark, [A(1), A(1, "S", 1_500_300, 200)])
    got = {(r.episode, r.end_by, r.remaining) for r in eps.collect()}
    assert got == {(1, "duplicate", 0), (2, None, 200)}


def test_fifo_order(spark):
    _, _, eps = built(spark, [A(5), A(3), A(4), M("U", 5, 100, 9, 1_500_000)])
    assert levels.fifo(eps).first().refs == [3, 4, 9]


def test_fifo_at_a_message(spark):
    rows = [A(1, qty=500), A(2, qty=300), M("E", 1, 200), A(3, "S", 1_500_100, 400), M("U", 2, 100, 7, 1_500_000), M("X", 1, 50), M("D", 1), A(9, qty=70)]
    _, mods, eps = built(spark, rows)
    for at in range(1, len(rows) + 1):
        _, _, live = fold(rows[:at])
        want = {}
        for locate, side, price, qty in live.values():
            shares, n = want.get((locate, side, price), (0, 0))
            want[locate, side, price] = (shares + qty, n + 1)
        got = {(r.locate, r.side, r.price): (r.shares, r.orders) for r in levels.fifo(eps, mods, at).collect()}
        assert got == want, at
    d = {(r.price, r.what) for r in levels.difference(levels.fifo(eps, mods, 3), levels.fifo(eps)).collect()}
    assert d == {(1_500_000, "changed"), (1_500_100, "only_b")}


def test_adjusted_curve_takes_the_symbols_out():
    from tidebook.stats import inference

    cells = [(b, s, 100 * (1 + (b * s) % 3), 0) for b in range(4) for s in range(3)]
    cells = [(b, s, n, n * (0.1 * b + 0.05 * s)) for b, s, n, _ in cells]  # rates without interaction
    share = {s: sum(n for _, t, n, _ in cells if t == s) for s in range(3)}
    level = sum(0.05 * s * n for s, n in share.items()) / sum(share.values())
    assert all(abs(r - (0.1 * b + level)) < 1e-9 for b, r in inference.adjusted_curve(cells))


FAST = ["census_by_type", "census_span", "symbol_activity_topk", "venue_profile", "order_episodes", "orphans_by_type", "inside_after_every_message", "crossed_locked_excuses", "micro_symbols", "order_sizes_lots", "cancel_to_trade", "order_episodes_session", "symbol_directory", "after_end_of_hours", "subcent_prices", "effect_digest", "book_differential", "leakage_ordering", "queue_bernoulli", "cancel_attribution", "fill_curve", "placement_schedule", "permutation_null", "parse_statistics", "directory_decode", "datagram_delivery"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    norm = lambda d: d.apply(lambda c: c.astype(float).round(6) if c.dtype.kind in "if" else c)
    assert rows(norm(got)) == rows(norm(want))


def test_levels_after_every_message(spark):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM '{p}'")
    got = [tuple(r) for r in registry.QUERIES["level_asof_every_message"](spark, SF).collect()]
    states = con.sql(registry.SQL["level_depth_running"]).df()
    tape = registry.QUERIES["inside_after_every_message"](spark, SF).select("seq", "locate").toPandas()
    con.register("st", states)
    con.register("tp", tape)
    want = con.sql("SELECT p.seq, p.locate, s.side, s.price, s.shares, s.orders FROM tp p JOIN st s ON s.locate = p.locate AND s.orders > 0 AND s.seq <= p.seq AND p.seq < s.until").fetchall()
    assert len({r[0] for r in got}) > len(tape) // 2
    assert sorted(got) == sorted(want)
    assert sorted(r for r in got if r[0] % 100 == 0) == sorted(con.sql(registry.SQL["level_asof_lookup"]).fetchall())


def test_levels_at_gaps_and_block_edges(spark):
    messages = [(s, 1) for s in (1, 511, 512, 513, 2000, 2000, 5000)] + [(700, 2)]
    states = [(1, "B", 10, 1, 5, 1, 512), (1, "B", 10, 512, 0, 0, 2000), (1, "B", 10, 2000, 7, 2, levels.FAR), (1, "S", 11, 513, 3, 1, 514), (2, "S", 9, 9000, 1, 1, levels.FAR)]
    st = spark.createDataFrame(states, "locate int, side string, price long, seq long, shares long, orders long, until long")
    want = [(q, loc, s[1], s[2], s[4], s[5]) for q, loc in messages for s in states if s[0] == loc and s[5] > 0 and s[3] <= q < s[6]]
    assert sorted(map(tuple, levels.at_every(spark.createDataFrame(messages, "seq long, locate int"), st).collect())) == sorted(want)
    assert levels.at_every(spark.createDataFrame([], "seq long, locate int"), st).count() == 0
