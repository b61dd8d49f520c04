"""Length-framed sessions: splitting bytes into frames, decoding bodies into one wide table, and encoding a tape for tests.

Framing is sequential within a session, so a session is one unit of reading; all after it is parallel. The prefix alone decides where the next frame begins: a frame of an unknown
type, or of a wrong length for its type, is counted and skipped. A zero prefix ends the session; a frame cut short ends it as truncated.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidebook.functions.layout import HEADER, LAYOUTS, LENGTHS, fields, read, write

FRAME = "session string, seq long, offset long, status string, body binary"
STATUSES = ("ok", "unknown_type", "length_mismatch", "end_marker", "truncated")


def split(data: bytes, prefixed: bool = True):
    """(offset, status, body) of each frame. prefixed False: prefixes are zero and the type gives the length; an unknown type ends the session."""
    at, n = 0, len(data)
    while at + 2 <= n:
        size = int.from_bytes(data[at : at + 2], "big")
        kind = chr(data[at + 2]) if at + 2 < n else ""
        if prefixed and size == 0:
            yield at, "end_marker", None
            return
        if not prefixed:
            size = LENGTHS.get(kind, 0)
            if not size:
                yield at, "unknown_type" if kind else "truncated", None
                return
        if at + 2 + size > n:
            yield at, "truncated", None
            return
        body = data[at + 2 : at + 2 + size]
        yield at, "ok" if LENGTHS.get(kind) == size else "unknown_type" if kind not in LENGTHS else "length_mismatch", body
        at += 2 + size


def framing(head: bytes, probe: int = 64) -> bool:
    """Whether the session is length-prefixed (also where both forms fit)."""

    def good(prefixed: bool) -> bool:
        seen = [(at, s) for _, (at, s, _) in zip(range(probe), split(head, prefixed))]
        fits = all(s in ("ok", "end_marker", "truncated") for _, s in seen) and seen[:1] != [] and seen[0][1] == "ok"
        return fits and (prefixed or all(head[at : at + 2] == bytes(2) for at, _ in seen))

    return good(True) or not good(False)


def frames(sessions: DataFrame) -> DataFrame:
    """sessions: session, data (binary). FRAME."""

    def cut(batches):
        for b in batches:
            for name, data in zip(b.column("session").to_pylist(), b.column("data").to_pylist()):
                rows = [(name, k + 1, *f) for k, f in enumerate(split(data or b"", framing((data or b"")[:4096])))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["session", "seq", "offset", "status", "body"])

    return sessions.select("session", "data").mapInArrow(cut, FRAME)


class FeedSource(DataSource):
    """spark.read.format("feed").load(path): the frames of every file that the path names on a file system that the executors share."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema):
        return FeedReader(self.options)


class FeedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"].removeprefix("file:")

    def partitions(self):
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition):
        import os

        with open(partition.value, "rb") as f:
            data = f.read()
        for k, (at, status, body) in enumerate(split(data, framing(data[:4096]))):
            yield os.path.basename(partition.value), k + 1, at, status, body


def decoded(framed: DataFrame) -> DataFrame:
    """session, seq, the header and every field of any type; null where a type lacks it."""
    body, kind = F.col("body"), F.decode(F.substring("body", 1, 1), "US-ASCII")
    names: dict[str, list] = {}
    for t, (_, spec) in LAYOUTS.items():
        for name, at, n, k in fields(spec):
            names.setdefault(name, []).append((t, at, n, k))
    columns = []
    for name, places in names.items():
        c = F
        for t, at, n, k in places:
            c = c.when(kind == t, read(body, at, n, k))
        columns.append(c.alias(name))
    head = [read(body, at, n, k).alias(name) for name, at, n, k in fields(HEADER)]
    return framed.filter("status = 'ok'").select("session", "seq", *head, *columns)


def parse_statistics(framed: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """By session: frames by status, how it ended, and whether it is clean. With the sessions: also their bytes, and those after the last frame."""
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    after = F.max(F.col("offset") + 2 + F.coalesce(F.octet_length("body"), F.lit(0)))
    ended = F.max(F.when(F.col("status").isin("end_marker", "truncated"), F.col("status")))
    got = framed.groupBy("session").agg(*[n(s) for s in STATUSES], F.coalesce(ended, F.lit("exhausted")).alias("ended"), after.alias("_after")).withColumn("clean", (F.col("unknown_type") == 0) & (F.col("length_mismatch") == 0) & (F.col("truncated") == 0))
    if sessions is None:
        return got.drop("_after")
    got = got.join(sessions.select("session", F.octet_length("data").cast("long").alias("bytes")), "session")
    return got.withColumn("trailing", F.when(F.col("ended") == "end_marker", F.col("bytes") - F.col("_after")).otherwise(F.lit(0))).drop("_after")


def read_files(spark, path: str) -> DataFrame:
    """session (the file's name), data: whole files, by Spark's own reader and so from any store that it reads; a file is one session, of 2 GB at most."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("session"), F.col("content").alias("data"))


def digests(sessions: DataFrame) -> DataFrame:
    """session, bytes and SHA-256 of each session's data."""
    return sessions.select("session", F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("sha256"))


def damaged(sessions: DataFrame) -> DataFrame:
    """Sessions S<n> with bad frames, for tests of what is counted: before the messages, one of a wrong length (odd n) and one of an unknown type (n a multiple of 3);
    after them, an end marker with bytes behind it (even n), or a frame cut short (n = 4 k + 1)."""
    n = F.substring("session", 2, 9).cast("int")
    part = lambda when, text: F.when(when, F.lit(text)).otherwise("")
    before = F.concat(part(n % 2 == 1, "000944" + "00" * 8), part(n % 3 == 0, "00053F" + "00" * 4))
    behind = F.concat(part(n % 2 == 0, "0000" + "AB" * 5), part(n % 4 == 1, "002441"))
    return sessions.select("session", F.unhex(F.concat(before, F.hex("data"), behind)).alias("data"))


def encoded(tape: DataFrame) -> DataFrame:
    """A tape as sessions, one for each symbol: session, data."""
    given = {"type": F.col("mtype"), "locate": F.col("locate"), "tracking": F.lit(0xBEEF), "ts_ns": F.col("ts_ns"), "shares": F.col("qty"), "code": F.col("code"), "state": F.col("code"), "action": F.col("code"), "cross_type": F.col("code"), "market": F.coalesce("market", F.lit("Q")), "market_category": F.col("code"), "printable": F.lit("Y")}
    given |= {c: F.col(c) for c in ("ref", "new_ref", "side", "price", "stock", "match")}
    whole = F
    for t, (size, spec) in LAYOUTS.items():
        hexed = F.concat(F.lit(f"{size:04X}"), *[write(given.get(name, F.lit(None).cast("string")), n, k) for name, _, n, k in fields(HEADER) + fields(spec)])
        whole = whole.when(F.col("mtype") == t, hexed)
    rows = tape.select("locate", "seq", whole.alias("x"))
    return rows.groupBy("locate").agg(F.array_sort(F.collect_list(F.struct("seq", "x"))).alias("xs")).select(F.concat(F.lit("S"), F.col("locate")).alias("session"), F.unhex(F.array_join(F.transform("xs", lambda s: s["x"]), "")).alias("data"))
