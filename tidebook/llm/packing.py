"""Best-fit packing by sums of squares.

Each document becomes its token ids and an end id. A longer document than a sequence is cut into pieces of the full length, but for a shorter first one. Full
pieces fill a sequence each. The others (one for each document at most) are dealt by a hash of doc_id and ids to groups of about GROUP, and each group is packed by itself:
a piece goes where the sum over all gaps of (open sequences with that gap)**2 becomes smallest, and no sequence is opened above the
group's lower bound while the piece fits into an open one. The larger part comes in a pseudorandom order, the smaller pieces, largest first, after it; in one of the ORDERS, the smaller
pieces take the smallest gap that holds them. The order that needs the fewest sequences counts: no more than best fit, largest first, in all that was tried.

A null text counts as empty: its only id is the end id. The vocabulary's added tokens in a text have their own ids. Ties go to the smallest gap. Rows that repeat are packed once each. An empty table gives
no sequences. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.tokens import default_path, encoding

LENGTH, END_ID, GROUP = 2048, 0, 20_000
#: Ways to pack a group: the share of its largest pieces that come in a pseudorandom order, and the share from which on a piece takes the smallest gap.
ORDERS = ((0.3, 2.0), (0.0, 2.0), (0.0, 0.4))

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"


def token_pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document."""
    path = tokenizer or default_path()

    def cut(batches):
        enc = encoding(path, added=True)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*enc.encode(text or "", allowed_special="all"), END_ID], "<u4")
                first = len(ids) % length or min(len(ids), length)
                edges = [0, *range(first, len(ids) + 1, length)]
                for k in range(len(edges) - 1):
                    raw = ids[edges[k] : edges[k + 1]].tobytes()
                    rows.append((doc, k, edges[k], edges[k + 1] - edges[k], zlib.crc32(raw), raw if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, PIECE)], schema=PIECE)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PLACED.split(", sequence_id")[0])


def pack_sizes(sizes: np.ndarray, order: np.ndarray, capacity: int, tight: float = 2.0) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum-of-squares packing of sizes below capacity. Returns each one's bin and offset, and the number of bins. From the share `tight` of the pieces on, of the gaps that hold a piece the smallest takes it."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    never = np.int64(1) << 60
    least, used = -(-int(sizes.sum()) // capacity), 0
    for nth, i in enumerate(order):
        s = int(sizes[i])
        # the sum's change: a bin leaves gap g and, unless it is full then, comes to gap g - s
        change = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = never
        if used < least:
            change[-1] = 2 * count[capacity - s] + 1
        k = int(np.argmin(change))
        if nth >= tight * len(order):
            k = int(np.argmax(count[s:] > 0)) if count[s:].any() else len(change) - 1
        gap = capacity if change[k] == never else s + k
        if gap == capacity:
            b, used = used, used + 1
        else:
            b = open_with[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_with[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, used


def best(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The packing of sizes below length that needs the fewest sequences, of the ORDERS."""
    down, tries = np.argsort(-sizes, kind="stable"), []
    for share, tight in ORDERS:
        large = int(len(sizes) * share)
        tries.append(pack_sizes(sizes, np.concatenate([np.random.Generator(np.random.PCG64(len(sizes))).permutation(down[:large]), down[large:]]), length, tight))
    return min(tries, key=lambda t: t[2])


def packed(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null unless with_ids), sequence_id, offset: a row for each piece."""
    groups = max(1, -(-docs.count() // group))  # from the tables' footers
    pieces = token_pieces(docs, length, tokenizer, with_ids).withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))

    def place(key, t):
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")])
        sizes = t.column("length").to_numpy()
        part = np.flatnonzero(sizes < length)
        bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        bins[part], offsets[part], used = best(sizes[part], length)
        full = sizes == length
        bins[full] = used + np.arange(full.sum())
        bins += (key[0].as_py() if hasattr(key[0], "as_py") else int(key[0])) << 40
        return t.drop_columns(["_group"]).append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets))

    return pieces.groupBy("_group").applyInArrow(place, PLACED)
