"""Framing, decoding, datagrams as batch and stream, and the statistics that have no SQL."""

import numpy as np

from tidebook.functions.layout import HEADER, LAYOUTS, LENGTHS, fields
from tidebook.sources import frames
from tidebook.stats import inference
from tidebook.streaming import datagrams


def frame(kind, size=None):
    n = LENGTHS.get(kind, 15) if size is None else size
    return n.to_bytes(2, "big") + kind.encode() + bytes(n - 1)


def test_layouts_tile_their_bodies():
    for kind, (size, spec) in LAYOUTS.items():
        at = 0
        for _, offset, n, _ in fields(HEADER) + fields(spec):
            assert offset == at, kind
            at += n
        assert at == size, kind


def test_framing_goes_on_after_bad_frames():
    data = frame("D", 9) + frame("?") + frame("D") + b"\0\0"
    assert [s for _, s, _ in frames.split(data)] == ["length_mismatch", "unknown_type", "ok", "end_marker"]
    assert [s for _, s, _ in frames.split(frame("A")[:-3])] == ["truncated"]
    zero = b"\0\0" + frame("D")[2:]
    assert [s for _, s, _ in frames.split(zero * 2, prefixed=False)] == ["ok", "ok"]
    assert frames.framing(frame("A") * 3) and not frames.framing(zero * 3)


def test_batch_and_stream_deliver_alike(spark, tmp_path):
    say = [(1, 3), (1, 3), (3, 4), (9, 2), (7, 2), (11, 0), (14, 0), (14, 2), (18, 1, "S", False), (18, 1), (19, 65535), (99, 1, "X"), (19, 2)]
    rows = [("S", x[2] if len(x) > 2 else "S", i, x[0], x[1], x[3] if len(x) > 3 else True) for i, x in enumerate(say)] + [("T", "T", 0, 4, 1, True)]
    p = spark.createDataFrame(rows, "session string, header string, arrival long, first long, count long, whole boolean")
    batch = {(r.session, r.arrival): (r.outcome, r.delivered, r.missed, r.stale) for r in datagrams.received(p).collect()}
    want = [("in_order", 3, 0), ("duplicate", 0, 0), ("trimmed", 3, 0), ("gap", 2, 2), ("duplicate", 0, 0), ("heartbeat", 0, 0), ("gap", 0, 3), ("in_order", 2, 0), ("malformed", 0, 2), ("in_order", 1, 0), ("end_of_session", 0, 0), ("other_session", 0, 0), ("in_order", 2, 0)]
    assert batch == {("S", i): (*x, i >= 3) for i, x in enumerate(want)} | {("T", 0): ("gap", 1, 3, True)}
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = datagrams.stream(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("delivered").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.session, r.arrival): (r.outcome, r.delivered, r.missed, r.stale) for r in spark.table("delivered").collect()} == batch


def test_files_are_read_as_sessions(spark, tmp_path):
    data = frame("D") * 3 + frame("?") + b"\0\0xy"
    (tmp_path / "one.bin").write_bytes(data)
    sessions = frames.read_files(spark, str(tmp_path / "*.bin"))
    got = frames.parse_statistics(frames.frames(sessions), sessions).first()
    assert (got.session, got.ok, got.unknown_type, got.ended, got.bytes, got.trailing, got.clean) == ("one.bin", 3, 1, "end_marker", len(data), 2, False)
    assert frames.digests(sessions).first().bytes == len(data)


def test_bootstrap_error_is_that_of_a_mean(spark):
    x = np.random.default_rng(1).normal(size=2000)
    se = inference.stationary_bootstrap_se(spark, [x[:900], x[900:]], 1.0, 400)
    assert abs(se / (x.std() / np.sqrt(2000)) - 1) < 0.15
    assert inference.block_length(x) < 6
    slow = np.convolve(np.random.default_rng(2).normal(size=3000), np.ones(40), "valid")
    assert inference.block_length(slow) > 20


def test_small_numbers():
    assert inference.verdict(0.6, 0.55, 0.65, 0.55) == "HOLDS"
    assert inference.verdict(0.5, 0.49, 0.51, 0.55) == "FAILS"
    assert abs(inference.one_sided_p(1.959963985, 1.0, 0.0) - 0.025) < 1e-9
    assert abs(inference.bars(0.9686)[0] - 0.5516) < 1e-4
