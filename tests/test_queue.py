"""The queue models where a tape's time runs back, where many orders live at once, and on random events against a plain fold."""

import hashlib
import random

import duckdb
import pytest

from tidebook.operators import levels, queue
from tidebook.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def again(tmp_path_factory):
    """The events four times over, with new ids and the old times: lives that end before they begin, and some without an end."""
    d = str(tmp_path_factory.mktemp("again"))
    duckdb.sql(f"COPY (SELECT event_id + k * (SELECT max(event_id) + 1 FROM '{SF}/events.parquet') AS event_id, * EXCLUDE (event_id) FROM '{SF}/events.parquet', range(4) r(k) ORDER BY 1) TO '{d}/events.parquet' (FORMAT parquet)")
    return d


@pytest.mark.parametrize("name", ["fill_reasons", "seed_spread", "value_at_horizon", "cancel_attribution", "queue_rule4"])
def test_time_running_back_equals_sql(spark, again, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{again}/events.parquet'")
    got, want = registry.QUERIES[name](spark, again).toPandas(), con.sql(registry.SQL[name]).df()
    cols = sorted(got.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    norm = lambda d: d.apply(lambda c: c.astype(float).round(6) if c.dtype.kind in "if" else c)
    assert rows(norm(got)) == rows(norm(want))


def test_first_tick(spark):
    ticks = [(1, 100), (2, 100), (3, 250), (4, 90), (5, 900), (6, 300)]
    tape = spark.createDataFrame([(s, t, "A") for s, t in ticks] + [(7, 260, "H")], "seq long, ts_ns long, mtype string")
    due = [0, 90, 91, 100, 101, 251, 260, 300, 301, 900, 901, 5000]
    asked = spark.createDataFrame(list(enumerate(due)), "id long, due_ts long")
    in_time = {i: min(((t, s) for s, t in ticks if t >= d), default=(None, None))[1] for i, d in enumerate(due)}
    in_seq = {i: min((s for s, t in ticks if t >= d), default=None) for i, d in enumerate(due)}
    for width in (1, 100, 10_000):
        assert {r.id: r.tick_seq for r in queue.first_tick(asked, tape, width).collect()} == in_time
        assert {r.id: r.tick_seq for r in queue.first_tick(asked, tape, width, least_seq=True).collect()} == in_seq


def plain(p, events, model, seed):
    """(fill of the model, first worse execution, first print) of one order, event by event."""
    seq, price, depth, last, buy = p
    a, fill, through, printed = float(depth), None, None, None
    for at, kind, eprice, qty, start, after in events:
        if not seq < at <= last:
            continue
        if eprice != price:
            if kind == "exec" and (eprice < price) == buy and through is None:
                through = at
            continue
        if kind == "print":
            printed = printed or at
        elif kind == "exec":
            hit = start > seq if model == "exact" else a <= 0
            fill = fill or (at if hit else None)
            a = max(0.0, a - qty)
        elif model == "optimistic":
            a = max(0.0, a - qty)
        elif model == "proportional" and after + qty > 0:
            a = max(0.0, a - qty * (a / (after + qty)))
        elif model == "bernoulli" and after + qty > 0:
            if int(hashlib.md5(f"{seed}-{seq}-{at}".encode()).hexdigest()[:8], 16) % (after + qty) < int(a):
                a = max(0.0, a - qty)
    return fill, through, printed


@pytest.mark.parametrize("side", "BS")
def test_fills_as_plain_folds(spark, side):
    rng = random.Random(5)
    events = [(at, rng.choice(["exec", "cancel", "cancel", "print"]), rng.choice([10, 10, 10, 11, 12]) if rng.random() < 0.97 else rng.choice([9, 13]), rng.randint(0, 9), at - rng.randint(1, 30), rng.randint(0, 40)) for at in sorted(rng.sample(range(1, 2000), 900))]
    orders = [(s, rng.choice([9, 10, 11, 12, 14]), rng.randint(0, 60), s + rng.choice([-5, 0, 3, 40, 400, 2**61]), side == "B") for s in rng.sample(range(0, 2100), 400)]
    placed = spark.createDataFrame([(s, 1, s * 10, side, p, d, 1, last) for s, p, d, last, _ in orders], "seq long, locate int, ts_ns long, side string, price long, depth long, spread long, last_seq long")
    moved = spark.createDataFrame([(at, at * 10, 1, side, p, k, q, st, af) for at, k, p, q, st, af in events], "seq long, ts_ns long, locate int, side string, price long, kind string, qty long, start_seq long, after long")
    for rule4 in (False, True):
        got = {(r.seq, r.model, r.seed): (r.fill_seq, r.fill_ts, r.reason) for r in queue.fills(placed, moved, rule4, seeds=(3, 4)).collect()}
        assert len(got) == len(orders) * 6
        for o in orders:
            for model, seed in [(m, 3) for m in queue.MODELS] + [("bernoulli", 4)]:
                own, through, printed = plain(o, events, model, seed)
                fill = min((x for x in (own, through, printed if rule4 else None) if x is not None), default=None)
                reason = "expired" if fill is None else "trade_through" if fill == through else "non_displayed_print" if rule4 and fill == printed else "execution_behind"
                assert got[o[0], model, seed] == (fill, fill and fill * 10, reason)


def test_orders_without_events_and_events_without_orders(spark):
    placed = spark.createDataFrame([(5, 1, 50, "B", 10, 3, 1, 2**62)], "seq long, locate int, ts_ns long, side string, price long, depth long, spread long, last_seq long")
    moved = spark.createDataFrame([(7, 70, 1, "S", 10, "exec", 1, 6, 0)], "seq long, ts_ns long, locate int, side string, price long, kind string, qty long, start_seq long, after long")
    assert [(r.model, r.fill_seq, r.reason) for r in queue.fills(placed, moved, models=["exact"]).collect()] == [("exact", None, "expired")]


@pytest.mark.parametrize("block", [1, 7, 64, 10**6])
def test_best_levels_by_blocks(spark, block):
    rng = random.Random(2)
    changes = sorted({(rng.randint(0, 300), rng.choice("BS"), rng.randint(1, 6)) for _ in range(250)})
    states = []
    for seq, side, price in changes:
        later = [s for s, d, p in changes if (d, p) == (side, price) and s > seq]
        n = rng.choice([0, 0, 1, 2])
        states.append((1, side, price, seq, 10 * n, n, min(later, default=levels.FAR)))
    want = []
    for seq, side in sorted({(s, d) for s, d, _ in changes}):
        on = [x for x in states if x[1] == side and x[3] <= seq < x[6] and x[5] > 0]
        best = (max if side == "B" else min)(on, key=lambda x: x[2], default=None)
        want.append((1, side, seq) + ((best[2], best[4], best[5]) if best else (None, None, None)))
    st = spark.createDataFrame(states, "locate int, side string, price long, seq long, shares long, orders long, until long")
    assert sorted(map(tuple, levels.best_levels(st, block).collect()), key=str) == sorted(want, key=str)
    assert levels.best_levels(st.limit(0), block).count() == 0
