"""Repeated passages by a sparse suffix array, refined by bucket pointers.

Suffixes start in buckets by their first 16 bytes: a bucket's name is 64 bits made from those of shorter strings, id(2q, i) = f(id(q, i), id(q, i + q)) for
q = 1, 2, 4, 8. Each 50-byte string is filed under one suffix that starts in it, its anchor: the last of those with the least name among its 35 suffixes that
have 16 bytes in it. That choice depends on the string alone, so equal strings are filed under equal suffixes at equal places, and only anchors, about one in 18 suffixes, travel.

1. Anchors are dealt out by ranges of bucket names and sorted. A bucket whose suffixes come from one text only is finished. (What a batch of rows can settle by itself isn't
   sent again for each of its rows: a frequent bucket comes once from each batch.) Names travel as 32 bits within their range: two that fall together only keep a bucket open.
2. The strings filed under the other anchors come together by range, with their bytes. There, each suffix of them points to its bucket of 16 bytes. Buckets are refined in rounds by sorting
   on the pointers of later offsets: (i, i + 16) gives the buckets of 32 bytes, and those updated pointers, at (i, i + 18), give the buckets of 50. A suffix alone in its bucket is finished and leaves
   the rounds, with all strings that hold it. Strings that end in one bucket are compared byte by byte. Those that aren't in the smallest doc_id that the bucket has are repeats; the bytes
   they cover are removed.

Whole equal texts (by 128 bits of their SHA-256) are one text: its first document stands for it, and the others, from 50 bytes on, are removed altogether. Null counts as empty; texts under 50 bytes lose nothing. Rows with a null
doc_id are neither before nor after another: they keep everything. Rows with equal ids aren't before each other. Rows that repeat get one result each. An empty table gives no rows.
Columns other than doc_id and text stay as they are; names beginning with __rep_ are the operator's own. Texts of any length are worked on in parts of SEGMENT bytes that overlap by 49.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.llm.common import mix, pieces, stored, unzipped, unzipped32, utf8, zipped, zipped32

LENGTH, GRAM = 50, 16
HALF = 2 * GRAM  # what a pointer covers after the first round
SPAN = LENGTH - GRAM + 1  # suffixes of a string that have a whole gram in it
SEGMENT, ANCHORS_IN_RANGE, LEAST_RANGES, REFINED_BYTES = 1 << 17, 2_000_000, 24, 1 << 22
_LATER = [(0, 0x9E3779B97F4A7C15), (GRAM, 0xBF58476D1CE4E5B9), (2 * GRAM, 0x94D049BB133111EB), (LENGTH - GRAM, 0xD6E8FEB86659FD93)]
_FACTOR = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 4: 0xD6E8FEB86659FD93, 8: 0x9FB21C651E98DF25}
ID = 16  # bytes of a text's name

ASKED = "part int, kind int, h binary, row binary, at binary, n binary, sub binary, context binary, ids binary, firsts binary"
_ASKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((k, pa.binary()) for k in ("h", "row", "at", "n", "sub", "context", "ids", "firsts"))])


def gram_ids(buf: np.ndarray) -> np.ndarray:
    """The bucket name of each suffix that has GRAM bytes."""
    h = buf.astype(np.uint64) + np.uint64(1)
    for q, c in _FACTOR.items():
        h = h[:-q] * np.uint64(c) + h[q:]
    return mix(h)


def anchored(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts back to back: all names; the starts of all 50-byte strings; and their anchors."""
    if len(buf) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_ids(buf)
    low = np.uint64(0xFFFFFFFF)
    v = (h | low) ^ np.arange(len(h), dtype=np.uint64)  # half a name, and a place that is less the later it is
    for k in (1, 2, 4, 8, 16, SPAN - 32):
        v = np.minimum(v[k:], v[:-k])
    inside = np.ones(len(v), bool)
    for e in offsets[1:].tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    start = np.flatnonzero(inside)
    return h, start, ((v[start] & low) ^ low).astype(np.int64)


def chunks(buf: np.ndarray, at: np.ndarray):
    """Runs of whole texts, or parts of a long one: bytes, offsets, the row of each text, and where in its text a part begins."""
    for i, j in pieces(at, SEGMENT):
        if j == i + 1 and at[j] - at[i] > SEGMENT:
            for base in range(0, int(at[j] - at[i]) - LENGTH + 1, SEGMENT):
                part = buf[at[i] + base : min(at[j], at[i] + base + SEGMENT + LENGTH - 1)]
                yield part, np.array([0, len(part)]), np.array([i]), base
        else:
            yield buf[at[i] : at[j]], at[i : j + 1] - at[i], np.arange(i, j), 0


def anchor_runs(buf: np.ndarray, at: np.ndarray):
    """For each chunk: bytes, base, and of each anchor its name, row, place, and the first and last start of the strings filed under it (places in the chunk)."""
    for part, offsets, rows, base in chunks(buf, at):
        h, start, anchor = anchored(part, offsets)
        if not len(start):
            continue
        text = np.searchsorted(offsets, start, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        last = np.concatenate([new[1:], [len(start)]]) - 1
        inner = offsets[text[new]]
        yield part, base - inner, h[anchor[new]], rows[text[new]], anchor[new], start[new], start[last]


def _range(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _any_range(ids: np.ndarray, parts: int) -> int:
    """Where a batch sends what it has settled by itself."""
    return int.from_bytes(ids[0].tobytes()[:4], "little") % parts


def _split(part: np.ndarray):
    """Places of equal parts: (part, places)."""
    order, edge = _groups(part)
    for a, b in zip(edge, [*edge[1:], len(order)]):
        yield int(part[order[a]]), order[a:b]


def _ids(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), f"V{ID}")


def _asked(part, kind, ids, row, at, h=b"", n=b"", sub=b"", context=b"", firsts=None):
    own, index = np.unique(row, return_inverse=True)
    return (part, kind, h, zipped32(index, True), zipped32(at, True), n, sub, context, ids[own].tobytes(), zipped(b"" if firsts is None else firsts[own].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()))


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_ASKED), _ASKED)], schema=_ASKED)


def _groups(key: np.ndarray):
    """Sorted order (stable) and the start of each run of equal keys."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def _mixed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether its key has two values; and an item of each key."""
    order = np.argsort(key)
    k, v = key[order], value[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    out = np.zeros(len(key), bool)
    if len(edge):
        two = np.minimum.reduceat(v, edge) != np.maximum.reduceat(v, edge)
        out[order] = np.repeat(two, np.diff(np.concatenate([edge, [len(k)]])))
    return out, order[edge]


def open_suffixes(texts: DataFrame, parts: int) -> DataFrame:
    """texts: id, text, each text once. id, at: the places of each text's anchors whose buckets have other texts too (several rows for a text)."""

    def ask(batches):
        for b in batches:
            buf, at = utf8(b.column("text"))
            ids = _ids(b.column("id"))
            runs = [(h, row, anchor + base) for _, base, h, row, anchor, _, _ in anchor_runs(buf, at)]
            if not runs:
                continue
            h, row, place = (np.concatenate([r[k] for r in runs]) for k in range(3))
            sure, one = _mixed(h, row)
            sent = ~sure
            sent[one] = True  # one of each bucket that is settled here, for the others
            k = np.flatnonzero(sure)
            out = [_asked(_any_range(ids, parts), 1, ids, row[k], place[k])] if len(k) else []
            chosen = np.flatnonzero(sent)
            for p, k in _split(_range(h[chosen], parts)):
                k = chosen[k]
                out.append(_asked(p, 0, ids, row[k], place[k], h=h[k].astype("<u4").tobytes()))
            yield _batch(out)

    def answer(key, t):
        kinds, own, h, ident, at, sure = [], [], [], [], [], []
        for kind, x, row, place, ids in zip(*(t.column(k).to_pylist() for k in ("kind", "h", "row", "at", "ids"))):
            row = unzipped32(row, True).astype(np.int64)
            ident.append(row + (len(own) << 32))  # each text comes from one batch, so other blobs' rows are other texts
            own.append(np.frombuffer(ids, f"V{ID}"))
            at.append(unzipped32(place, True))
            h.append(np.frombuffer(x, "<u4") if kind == 0 else np.zeros(len(row), np.uint32))
            sure.append(np.full(len(row), kind == 1))
        h, ident, at, keep = map(np.concatenate, (h, ident, at, sure))
        asked = np.flatnonzero(~keep)
        keep[asked] = _mixed(h[asked], ident[asked])[0]
        keep = np.flatnonzero(keep)
        out = [(own[i >> 32][i & 0xFFFFFFFF].tobytes(), at[keep[k]].astype("<i4").tobytes()) for i, k in _split(ident[keep])]
        return pa.table({"id": pa.array([x[0] for x in out], pa.binary()), "at": pa.array([x[1] for x in out], pa.binary())})

    return texts.select("id", "text").mapInArrow(ask, ASKED).groupBy("part").applyInArrow(answer, "id binary, at binary")


def _ranked(key: np.ndarray) -> np.ndarray:
    """Bucket pointers: the number of each key's bucket, -1 where it is alone in it."""
    order = np.argsort(key)
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    edge = np.flatnonzero(new)
    size = np.diff(np.concatenate([edge, [len(k)]]))
    out = np.empty(len(key), np.int64)
    out[order] = np.where(np.repeat(size, size) > 1, np.cumsum(new) - 1, -1)
    return out


def _runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)


def _refine(pointer: np.ndarray, at: np.ndarray, later: int) -> np.ndarray:
    """Sorts the suffixes at `at` on the pointers of themselves and of the suffixes `later` bytes on; a finished one finishes those that hold it. Their new pointers."""
    a, b = pointer[at], pointer[at + later]
    rest = np.flatnonzero((a >= 0) & (b >= 0))
    out = np.full(len(at), -1, np.int64)
    if len(rest):
        out[rest] = _ranked(a[rest] * np.int64(len(pointer)) + b[rest])
    return out


def same_strings(raw: bytes, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts back to back, each with `count` strings of LENGTH bytes from `begin` on: all starts, and for each the number of the bucket of its string, -1 where no other start has that string."""
    buf, start = np.frombuffer(raw, np.uint8), _runs(begin, count)
    bucket, name = np.full(len(start), -1, np.int64), gram_ids(buf)
    # counted by some bits of a sum of its names, most strings are alone from the start; the rounds have the others' suffixes only
    total = sum((name[start + later] * np.uint64(c) for later, c in _LATER), np.zeros(len(start), np.uint64))
    bits = max(10, len(start).bit_length())
    total = (total >> np.uint64(64 - bits)).astype(np.int64)
    rest = np.flatnonzero(np.bincount(total, minlength=1 << bits)[total] > 1)
    pointer, wanted = np.full(len(buf), -1, np.int64), np.zeros(len(buf), bool)
    for later in (0, GRAM, LENGTH - HALF, LENGTH - GRAM):
        wanted[start[rest] + later] = True
    at = np.flatnonzero(wanted)
    if len(at):
        pointer[at] = _ranked(name[at])
    wanted[:] = False
    for later in (0, LENGTH - HALF):
        wanted[start[rest] + later] = True
    at = np.flatnonzero(wanted)
    refined = _refine(pointer, at, GRAM)
    pointer[:] = -1
    pointer[at] = refined
    bucket[rest] = _refine(pointer, start[rest], LENGTH - HALF)
    # names are 64 bits of a hash: what fell together is compared by its bytes
    rest = np.flatnonzero(bucket >= 0)
    if len(rest):
        word = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        order = rest[np.argsort(bucket[rest], kind="stable")]
        alike = bucket[order[1:]] == bucket[order[:-1]]
        a, b = start[order[:-1][alike]], start[order[1:][alike]]
        differ = np.zeros(len(a), bool)
        for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
            differ |= word[a + k] != word[b + k]
        if differ.any():
            wrong = rest[np.isin(bucket[rest], bucket[order[1:][alike][differ]])]
            strings: dict[bytes, list[int]] = {}
            for i in wrong.tolist():
                strings.setdefault(raw[start[i] : start[i] + LENGTH], []).append(i)
            for k, own in enumerate(strings.values()):
                bucket[own] = len(buf) + k if len(own) > 1 else -1
    return start, bucket


def repeats(texts: DataFrame, parts: int) -> DataFrame:
    """texts: id, first (doc_id), text, places (array of binary: its open suffixes). id, at, till: the repeated stretches (several rows for a text; stretches may meet)."""

    def ask(batches):
        for b in batches:
            buf, at = utf8(b.column("text"))
            ids, firsts = _ids(b.column("id")), b.column("first").to_numpy(zero_copy_only=False)
            opened = [np.unique(np.frombuffer(b"".join(x), "<i4")).astype(np.int64) + (np.int64(k) << 32) for k, x in enumerate(b.column("places").to_pylist())]
            opened = np.concatenate([*opened, np.zeros(0, np.int64)])
            runs, contexts = [], []
            for part, base, h, row, anchor, lo, hi in anchor_runs(buf, at):
                key = (row.astype(np.int64) << 32) + anchor + base
                k = np.searchsorted(opened, key)
                k[k == len(opened)] = 0
                chosen = np.flatnonzero(opened[k] == key) if len(opened) else np.zeros(0, np.int64)
                raw = part.tobytes()
                contexts += [raw[i : j + LENGTH] for i, j in zip(lo[chosen].tolist(), hi[chosen].tolist())]
                runs.append((h[chosen], row[chosen], (lo + base)[chosen], (hi - lo + 1)[chosen]))
            if not contexts:
                continue
            h, row, place, count = (np.concatenate([r[k] for r in runs]) for k in range(4))
            # a context that a smaller doc_id of this batch has too is settled here
            seen: dict[bytes, int] = {}
            sure = np.zeros(len(h), bool)
            for i in np.argsort(firsts[row], kind="stable").tolist():
                if seen.setdefault(contexts[i], firsts[row[i]]) < firsts[row[i]]:
                    sure[i] = True
            seen.clear()
            k = np.flatnonzero(sure)
            out = [_asked(_any_range(ids, parts), 1, ids, row[k], place[k], n=zipped(count[k].astype(np.uint8).tobytes()))] if len(k) else []
            chosen = np.flatnonzero(~sure)
            for p, k in _split(_range(h[chosen], parts)):
                k = chosen[k]
                out.append(_asked(p, 0, ids, row[k], place[k], n=zipped(count[k].astype(np.uint8).tobytes()), sub=(h[k] >> np.uint64(8)).astype(np.uint8).tobytes(), context=zipped(b"".join([contexts[i] for i in k.tolist()])), firsts=firsts))
            yield _batch(out)

    def answer(key, t):
        own, ident, first, place, count, sub, sure, context = [], [], [], [], [], [], [], []
        for kind, row, at, n, s, raw, ids, firsts in zip(*(t.column(k).to_pylist() for k in ("kind", "row", "at", "n", "sub", "context", "ids", "firsts"))):
            row = unzipped32(row, True).astype(np.int64)
            ident.append(row + (len(own) << 32))
            own.append(np.frombuffer(ids, f"V{ID}"))
            place.append(unzipped32(at, True).astype(np.int64))
            count.append(np.frombuffer(unzipped(n), np.uint8).astype(np.int64))
            sure.append(np.full(len(row), kind == 1))
            first.append(np.ascontiguousarray(np.frombuffer(unzipped(firsts), np.uint8).reshape(8, -1).T).view("<i8").ravel()[row] if kind == 0 else np.zeros(len(row), np.int64))
            sub.append(np.frombuffer(s, np.uint8) if kind == 0 else np.zeros(len(row), np.uint8))
            context.append(unzipped(raw) if kind == 0 else b"")
        ident, first, place, count, sub, sure = map(np.concatenate, (ident, first, place, count, sub, sure))
        found = [(ident[sure], place[sure], place[sure] + count[sure] + LENGTH - 1)]
        asked = np.flatnonzero(~sure)
        whole = b"".join(context)
        del context
        till = np.cumsum(count[asked] + LENGTH - 1)
        since = till - (count[asked] + LENGTH - 1)
        shares = min(256, 1 + len(whole) // REFINED_BYTES)
        share = (sub[asked].astype(np.int64) * shares) >> 8
        for s in range(shares):  # equal strings have equal anchors, and so one share
            mine = np.flatnonzero(share == s)
            if not len(mine):
                continue
            # equal contexts are one, of the smallest doc_id that has it
            names: dict[bytes, int] = {}
            no = np.fromiter((names.setdefault(whole[i:j], len(names)) for i, j in zip(since[mine].tolist(), till[mine].tolist())), np.int64, len(mine))
            e = asked[mine]
            lowest = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(lowest, no, first[e])
            size = np.fromiter(map(len, names), np.int64, len(names))
            begin, n = np.cumsum(size) - size, size - (LENGTH - 1)
            _, bucket = same_strings(b"".join(names), begin, n)
            names.clear()
            least = np.repeat(lowest, n)  # of each start, the smallest doc_id that has its string
            rest = np.flatnonzero(bucket >= 0)
            if len(rest):
                order, edge = _groups(bucket[rest])
                least[rest[order]] = np.repeat(np.minimum.reduceat(least[rest[order]], edge), np.diff(np.concatenate([edge, [len(order)]])))
            entry = np.repeat(np.arange(len(e)), n[no])
            step = np.arange(len(entry)) - np.repeat(np.cumsum(n[no]) - n[no], n[no])
            again = np.flatnonzero(first[e][entry] > least[(np.cumsum(n) - n)[no][entry] + step])
            if len(again):
                entry, at = e[entry[again]], step[again]
                new = np.flatnonzero(np.concatenate([[True], (entry[1:] != entry[:-1]) | (at[1:] != at[:-1] + 1)]))
                last = np.concatenate([new[1:], [len(again)]]) - 1
                found.append((ident[entry[new]], place[entry[new]] + at[new], place[entry[new]] + at[last] + LENGTH))
        ident, at, till = (np.concatenate([f[k] for f in found]) for k in range(3))
        text, group = np.unique(ident, return_inverse=True)
        a, z = merged((group << 32) + at, (group << 32) + till)  # of all texts at once: groups lie apart
        edge = np.searchsorted(a >> 32, np.arange(len(text) + 1))
        a, z = (a & 0xFFFFFFFF).astype("<i4"), (z & 0xFFFFFFFF).astype("<i4")
        out = [(own[i >> 32][i & 0xFFFFFFFF].tobytes(), a[j:k].tobytes(), z[j:k].tobytes()) for i, j, k in zip(text.tolist(), edge[:-1].tolist(), edge[1:].tolist())]
        return pa.table({n: pa.array([x[k] for x in out], pa.binary()) for k, n in enumerate(("id", "at", "till"))})

    return texts.select("id", "first", "text", "places").mapInArrow(ask, ASKED).groupBy("part").applyInArrow(answer, "id binary, at binary, till binary")


def merged(at: np.ndarray, till: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the stretches cover."""
    order = np.argsort(at, kind="stable")
    at, till = at[order], np.maximum.accumulate(till[order])
    new = np.flatnonzero(np.concatenate([[True], at[1:] > till[:-1]])) if len(at) else np.zeros(0, np.int64)
    return at[new], till[np.concatenate([new[1:], [len(at)]])[: len(new)] - 1]


def maximal(found: DataFrame) -> DataFrame:
    """id, cut: the maximal removed runs of each text."""

    def join(batches):
        kind = pa.list_(pa.struct([("at", pa.int32()), ("till", pa.int32())]))
        for b in batches:
            out = []
            for runs in b.column("runs").to_pylist():
                at, till = merged(*(np.frombuffer(b"".join(r[k] for r in runs), "<i4") for k in ("at", "till")))
                out.append([{"at": a, "till": z} for a, z in zip(at.tolist(), till.tolist())])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], names=["id", "cut"])

    return found.groupBy("id").agg(F.collect_list(F.struct("at", "till")).alias("runs")).mapInArrow(join, "id binary, cut array<struct<at:int,till:int>>")


def without(raw: Column, cut: Column) -> Column:
    """What is left of a binary without the runs in cut, as a string of those bytes."""
    edges = F.concat(F.array(F.lit(0)), F.transform(cut, lambda r: r["till"]))
    ends = F.concat(F.transform(cut, lambda r: r["at"]), F.array(F.octet_length(raw)))
    return F.array_join(F.zip_with(edges, ends, lambda i, j: F.substring(raw, i + 1, j - i).cast("string")), "")


def _whole_characters(raw: Column, cut: Column) -> Column:
    """The runs, widened to whole UTF-8 characters."""
    inner = lambda at: F.hex(F.substring(raw, at + 1, F.lit(1))).rlike("^[89AB]")
    back = lambda at: F.when(~inner(at), at).when(~inner(at - 1), at - 1).when(~inner(at - 2), at - 2).otherwise(at - 3)
    on = lambda at: F.when(~inner(at), at).when(~inner(at + 1), at + 1).when(~inner(at + 2), at + 2).otherwise(at + 3)
    return F.transform(cut, lambda r: F.struct(back(r["at"]).alias("at"), on(r["till"]).alias("till")))


def removed(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """docs' columns but text, with n_bytes, n_removed, n_spans, kept_sha256 for each row; with_text: also text, what is left of it (characters of which a byte goes, go; null stays null)."""
    own = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    name = F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2 * ID))
    known = docs.withColumns({"__rep_id": name, "__rep_bytes": F.octet_length(text).cast("long"), "__rep_doc": F.col("doc_id").cast("long")})
    rows = stored(known.select(*own, "__rep_id", "__rep_bytes", "__rep_doc", F.sha2(text.cast("binary"), 256).alias("__rep_sha")), "repeats-rows")
    firsts = stored(rows.filter("__rep_doc is not null").groupBy("__rep_id").agg(F.min("__rep_doc").alias("__rep_first"), F.first("__rep_bytes").alias("n")), "repeats-firsts")
    size = firsts.agg(F.sum("n")).first()[0] or 0
    parts = max(LEAST_RANGES, -(-int(size * 2 / (SPAN + 1)) // ANCHORS_IN_RANGE))

    # each text once, of its first document (a map task sends a text once), dealt out by id; all that follows uses this exchange
    long = known.filter(F.col("__rep_doc").isNotNull() & (F.col("__rep_bytes") >= LENGTH) & F.col("__rep_id").isNotNull()).select(F.col("__rep_id").alias("id"), F.col("__rep_doc").alias("first"), "text")
    once = long.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("first"))).filter("_k = 1").select("id", "first", "text")
    suffixes = open_suffixes(once, parts).groupBy("id").agg(F.collect_list("at").alias("places"))  # of one text each
    found = repeats(once.join(suffixes, "id"), parts)
    cut = maximal(found)
    raw = F.col("text").cast("binary")
    part = once.join(cut, "id").select("id", "cut", F.sha2(without(raw, F.col("cut")).cast("binary"), 256).alias("cut_sha"), *([without(raw, _whole_characters(raw, F.col("cut"))).alias("cut_text")] if with_text else []))
    lost = F.aggregate("cut", F.lit(0).cast("long"), lambda s, r: s + r["till"] - r["at"])
    part = part.select("id", lost.alias("lost"), F.size("cut").alias("spans"), *[c for c in part.columns if c not in ("id", "cut")])

    out = rows.join(firsts.select("__rep_id", "__rep_first"), "__rep_id", "left").withColumn("__rep_copy", F.coalesce((F.col("__rep_doc") > F.col("__rep_first")) & (F.col("__rep_bytes") >= LENGTH), F.lit(False)))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    result = lambda n, spans, sha: [F.col("__rep_bytes").alias("n_bytes"), n.cast("long").alias("n_removed"), spans.cast("long").alias("n_spans"), sha.alias("kept_sha256")]
    names = [*own, *(["text"] if with_text else [])]
    # copies go altogether; they don't meet the text that they are copies of
    copies = out.filter("__rep_copy").select(*own, *([F.lit("").alias("text")] if with_text else []), *result(F.col("__rep_bytes"), F.lit(1), empty))
    rest = out.filter("not __rep_copy").withColumn("id", F.when(F.col("__rep_doc").isNotNull(), F.col("__rep_id")))
    if not with_text:
        rest = rest.join(part, "id", "left")
        return copies.unionByName(rest.select(*own, *result(F.coalesce("lost", F.lit(0)), F.coalesce("spans", F.lit(0)), F.coalesce("cut_sha", "__rep_sha"))))
    whole = docs.select("*", text.alias("__rep_t")).filter(F.col("doc_id").isNull() | (F.octet_length("__rep_t") < LENGTH))
    whole = whole.select(*names, *[c.alias(n) for c, n in ((F.octet_length("__rep_t").cast("long"), "n_bytes"), (F.lit(0).cast("long"), "n_removed"), (F.lit(0).cast("long"), "n_spans"), (F.sha2(F.col("__rep_t").cast("binary"), 256), "kept_sha256"))])
    texts = once.join(part.drop("cut"), "id", "left").select("id", F.coalesce("cut_text", "text").alias("text"), "lost", "spans", "cut_sha")
    rest = rest.filter(F.col("id").isNotNull() & (F.col("__rep_bytes") >= LENGTH)).join(texts, "id")
    return copies.unionByName(rest.select(*names, *result(F.coalesce("lost", F.lit(0)), F.coalesce("spans", F.lit(0)), F.coalesce("cut_sha", "__rep_sha")))).unionByName(whole)
