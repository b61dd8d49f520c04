"""What the training-data operators share: tables, the shared work folder, byte-level word and shingle hashing."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset: one in the warehouse, or, in a single JVM, in the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        alone = master == "local" or master.startswith("local[")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Where stored() has written, in order.
STORED: list[str] = []


def drop_unused(spark: SparkSession, paths: list[str], docs: DataFrame) -> list[str]:
    """Deletes those stored tables that docs doesn't read; returns the rest."""
    used = docs.inputFiles()
    keep = [p for p in paths if any(p.rpartition("/")[2] in u for u in used)]
    jvm = spark.sparkContext._jvm
    for p in set(paths) - set(keep):
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return keep


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    STORED.append(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """array<string> of the words; null text: none. JVM only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


# --- bytes of an Arrow column -------------------------------------------------

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and len + 1 offsets into them; null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at


def pieces(offsets: np.ndarray, most: int = 1 << 21):
    """Runs [i, j) of rows of at most that many bytes (a longer row is a run of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 21)
            inv = pow(self.BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.BASE, np.uint64))])
                self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inv, np.uint64))])
        return self.up, self.down


POWERS = Powers()


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that lie back to back in buf (offsets from 0): each word's start, end and row."""
    inside = ~_SPACES[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside
    start = np.flatnonzero(inside & (~before[:-1] | cut[:-1]))
    after = np.zeros(len(buf) + 1, bool)
    after[:-1] = inside
    end = np.flatnonzero(inside & (~after[1:] | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each span, by differences of one running polynomial sum."""
    up, down = POWERS.get(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


_STEP = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 5):
    """For each row: the sorted 64-bit hashes of its distinct shingles of lower-cased words (fewer words: the whole sequence as one; none: empty)."""
    buf = _LOWER[buf]
    start, end, row = word_spans(buf, offsets)
    h = word_hashes(buf, start, end)
    first = np.searchsorted(row, np.arange(len(offsets)), "left")
    joined = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        joined += h[k : len(h) - width + 1 + k] * (_STEP[k % 5] + np.uint64(2 * (k // 5)))
    joined = mix(joined)
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            yield np.unique(joined[a : b - width + 1])
        elif b > a:
            steps = np.array([_STEP[k % 5] for k in range(b - a)], np.uint64)
            yield mix(np.add.reduce(h[a:b] * steps, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


# --- arrays that travel in binary columns -----------------------------------------


def packed32(x: np.ndarray, ascending: bool = False) -> bytes:
    """32-bit numbers by byte planes (ascending: their differences), which a shuffle's compression then finds short."""
    x = np.asarray(x).astype("<i4")
    return np.diff(x, prepend=np.int32(0)).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() if ascending else x.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked32(raw: bytes, ascending: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()
    return np.cumsum(x, dtype=np.int32) if ascending else x


_ZSTD = pa.Codec("zstd", 3)


def zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True) if raw else b""


def unzipped(raw: bytes) -> bytes:
    return _ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True) if raw else b""


def zipped32(x: np.ndarray, ascending: bool = False) -> bytes:
    return zipped(packed32(x, ascending))


def unzipped32(raw: bytes, ascending: bool = False) -> np.ndarray:
    return unpacked32(unzipped(raw), ascending)
