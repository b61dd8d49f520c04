"""N-gram Jaccard self-join with set-relation skipping.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Documents of one set are a node. All sets are put in one order: by hash, but shingles that many documents share (a
bounded table, see frequent()) come last, the most frequent one last of all. Two sets that are alike enough share a shingle among the first n - ceil(4n/5) + 1 of each, so the index lists,
for every shingle of those prefixes, the nodes that have it, with the place it has there. Two sets are compared by the size of their symmetric difference d, a metric: they link when 9 d <= n + m.

1. Relations between sets. Nodes that share one of three least hashes are compared with the least node among them. Links make classes; each node keeps the nearest set that it was linked with, its
   leader, and the difference from it.
2. Index-level skipping. A list that holds the same sets as the list of an earlier shingle (as those of a shared passage do) is left out, and so is a list of one class. In the open lists, nodes are first compared with two nodes of the list: one drawn by a hash, and the one in which the shingle stands first, which has the fewest rare shingles: among copies with
   edits of their own, that is what they are copies of. This joins most classes. Then lists are cut into blocks by size, each with the least size, the best position of its entries (as the overlap that it still allows) and its classes; a probing set skips a
   block by those, and the pairs within the others pass the same bounds one by one.
3. Answer-level skipping. A pair's leaders are compared by their sketches, once for all pairs that have these leaders. A set's answer follows from its leader's: where the leaders
   differ by more than the two sets' own differences from them and a link allow, the pair can't link and isn't compared.

What is left is compared by whole sets, so no link between classes is lost. (A sketch has the parity of a set's members in each of its places: two sets differ by at least as
much as their sketches.) The classes of all links are found by alternating star contractions, in tables.

Null and empty texts have an empty set and link with nothing. Fewer than five words: the whole sequence as one shingle. Null ids get classes of their own.
Repeated ids count as one document each row. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import mix, pieces, shingle_sets, stored, unzipped, unzipped32, utf8, zipped, zipped32

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
LEAST_PLACES, MINIMA = 512, 3
TOKENS_IN_RANGE, LEAST_RANGES = 2_000_000, 24
#: Shingles that come last in the order: so many at most, of those that a batch of rows has so often at least. Any order gives the same links.
FREQUENT, LEAST_IN_BATCH, BATCH_BYTES = 524_288, 3, 1 << 24
SUMMARY = "doc_id long, h long, n long, node long, minima array<long>, wide binary, often binary"
POSTING = "token long, node long, n long, at long"


def _hashed(batch):
    """The sets of a batch's texts: the batch's rows from i to j, and their sets, in parts that hold BATCH_BYTES of text (or one row)."""
    buf, at = utf8(batch.column("text"))
    for i, j in pieces(at, BATCH_BYTES):
        yield batch.slice(i, j - i), [s for a, b in pieces(at[i : j + 1]) for s in shingle_sets(buf[at[i + a] : at[i + b]], at[i + a : i + b + 1] - at[i + a], SHINGLE)]


def node_of(s: np.ndarray) -> int:
    """A set's name: 64 bits of its members' sum, product-mixed."""
    if not len(s):
        return 0
    both = np.array([np.add.reduce(mix(s)), np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15))], np.uint64)
    return int(mix(np.array([mix(both[:1])[0] ^ both[1] ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0


def parities(s: np.ndarray) -> np.ndarray:
    """A set's parity sketch: of each place (by the hash; LEAST_PLACES or the power of two from twice the set's size) whether it has an odd number of members."""
    size = max(LEAST_PLACES, 1 << (2 * max(1, len(s)) - 1).bit_length())
    return (np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The same sketch at a smaller power of two of places."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0) if len(bits) > size else bits


def views(col: pa.Array, kind) -> list[np.ndarray]:
    """Each row's bytes as numbers, where the batch has them: a batch of pairs of long sets is held once."""
    if not len(col):
        return []
    _, at, data = col.buffers()
    at = np.frombuffer(at, np.int32 if pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1].tolist()
    return [np.frombuffer(data, kind, (j - i) // np.dtype(kind).itemsize, i) if j > i else np.zeros(0, kind) for i, j in zip(at, at[1:])]


def _concat(xs, kind=np.uint64) -> np.ndarray:
    return np.concatenate([*xs, np.zeros(0, kind)])


def summaries(docs: DataFrame) -> DataFrame:
    """One row for each document: the size and name of its set, its least hashes and its sketch; and one for each batch (n = -1): the shingles that it has often."""

    def summarise(batches):
        for b, sets in (x for b in batches for x in _hashed(b)):
            minima = [int(mix(s + np.uint64(k)).min().view(np.int64)) if len(s) else 0 for s in sets for k in range(MINIMA)]
            token, times = np.unique(_concat(sets), return_counts=True)
            often = times >= LEAST_IN_BATCH
            blob = token[often].tobytes() + times[often].astype("<u4").tobytes()
            n = len(sets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, MINIMA * (n + 1) + 1, MINIMA), pa.int32()), pa.array([*minima, *[0] * MINIMA], pa.int64()))
            columns = [b.column("doc_id").cast(pa.int64()).to_pylist() + [None], b.column("h").to_pylist() + [0], [len(s) for s in sets] + [-1], [node_of(s) for s in sets] + [0]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), lists, pa.array([*(np.packbits(parities(s)).tobytes() for s in sets), b""], pa.binary()), pa.array([*[None] * n, zipped(blob)], pa.binary())], names=["doc_id", "h", "n", "node", "minima", "wide", "often"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(summarise, SUMMARY)


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of all batches' frequent shingles, the FREQUENT most frequent (bounded; 8 MB): sorted, with their ranks from 1."""

    def each(batches):
        for b in batches:
            for raw in map(unzipped, b.column("often").to_pylist()):
                k = len(raw) // 12
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<i8", k)), pa.array(np.frombuffer(raw, "<u4", k, 8 * k).astype(np.int64))], names=["token", "times"])

    top = rows.filter("n = -1").select("often").mapInArrow(each, "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT).select("token").toArrow()
    token = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], (len(token) - np.arange(len(token)))[order]


def ordered(s: np.ndarray, token: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the common order."""
    if not len(token) or not len(s):
        return s
    k = np.minimum(np.searchsorted(token, s), len(token) - 1)
    often = token[k] == s
    return np.concatenate([s[~often], s[often][np.argsort(rank[k[often]])]])


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, items (sorted): the sets of the documents in wanted (doc_id, h, node). A repeated id's texts are told apart by their hashes."""

    def whole(batches):
        for b, own in (x for b in batches for x in _hashed(b)):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "items"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(wanted, ["doc_id", "h"]).select("node", "text").mapInArrow(whole, "node long, items binary")


def sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (x, y: nodes) with the sets' sizes a, c, and far: by their sketches, they differ by so much at least."""
    wide = nodes.select("node", "n", "wide")

    def measure(batches):
        for b in batches:
            far = []
            for s, t in zip(views(b.column("s"), np.uint8), views(b.column("t"), np.uint8)):
                s, t = np.unpackbits(s), np.unpackbits(t)
                size = min(len(s), len(t))
                far.append(int(np.count_nonzero(folded(s, size) != folded(t, size))))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("x", "y", "a", "c")), pa.array(far, pa.int64())], names=["x", "y", "a", "c", "far"])

    both = pairs.join(wide.toDF("x", "a", "s"), "x").join(wide.toDF("y", "c", "t"), "y")
    return both.filter(_sizes("a", "c")).select("x", "y", "a", "c", "s", "t").mapInArrow(measure, "x long, y long, a long, c long, far long")


def _sizes(a: str, c: str) -> Column:
    """Sizes that allow the likeness."""
    return (DENOMINATOR * F.col(a) >= NUMERATOR * F.col(c)) & (DENOMINATOR * F.col(c) >= NUMERATOR * F.col(a))


def _near(differ: Column, a: Column, c: Column) -> Column:
    """Whether sets of these sizes may link that differ by so much (or more)."""
    return (DENOMINATOR + NUMERATOR) * differ <= (DENOMINATOR - NUMERATOR) * (a + c)


def compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (x, y: nodes), those that link, with how much they differ. First by their sketches, which few unlike pairs pass, then by the whole sets."""
    pairs = stored(sketched(pairs, nodes).filter(_near(F.col("far"), F.col("a"), F.col("c"))).select("x", "y"), "join-pairs")
    used = pairs.select("x").union(pairs.select("y")).distinct().toDF("node")
    wanted = nodes.join(used, "node", "left_semi").select(F.col("rep").alias("doc_id"), F.col("rep_h").alias("h"), "node")
    n = wanted.count()
    sets = stored(sets_of(docs, F.broadcast(wanted) if n <= 1_000_000 else wanted).dropDuplicates(["node"]), "join-sets")

    def meet(batches):
        for b in batches:
            keep, differ = [], []
            for k, (s, t) in enumerate(zip(views(b.column("s"), np.uint64), views(b.column("t"), np.uint64))):
                d = len(s) + len(t) - 2 * len(np.intersect1d(s, t, assume_unique=True))
                if (DENOMINATOR + NUMERATOR) * d <= (DENOMINATOR - NUMERATOR) * (len(s) + len(t)):
                    keep.append(k)
                    differ.append(d)
            found = b.select(["x", "y"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(differ, pa.int64())], names=["x", "y", "d"])

    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("items").alias("s")), "x").join(sets.select(F.col("node").alias("y"), F.col("items").alias("t")), "y")
    return stored(both.select("x", "y", "s", "t").mapInArrow(meet, "x long, y long, d long"), "join-links")


def components(edges: DataFrame) -> DataFrame:
    """edges: x, y. Returns node, root: the least node that each node is connected with. Large-star and small-star contractions until nothing changes."""
    e = stored(edges.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "stars")
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).alias("s")).select("s.u", "s.v").distinct()
        e = stored(e, "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.toDF("node", "root")
        state = now


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR)) + 1e-9).cast("int")


def index_lists(docs: DataFrame, total: int, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, node, n, at for every token that two nodes have in their prefixes. total: the prefixes' members in all.

    Tokens travel in arrays, by ranges of their hashes, as 32 bits within their range (tokens that fall together give one list of more pairs to look at). A token that several nodes of a batch
    of rows share is settled there: one of them goes to the token's range, to meet the other batches', and the rest go on as they are, so that a frequent token comes to its range once
    from each batch.
    """
    parts = max(LEAST_RANGES, -(-total // TOKENS_IN_RANGE))
    shared = docs.sparkSession.sparkContext.broadcast(often)  # FREQUENT at most

    def ask(batches):
        token_often, rank = shared.value
        for _, sets in (x for b in batches for x in _hashed(b)):
            first: dict[int, tuple[np.ndarray, int]] = {}
            for s in sets:
                if len(s):
                    name = node_of(s)
                    if name not in first:
                        first[name] = ordered(s, token_often, rank)[: prefix_length(len(s))], len(s)
            if not first:
                continue
            node, n = np.array([*first], np.int64), np.array([x[1] for x in first.values()], np.int64)
            size = np.array([len(x[0]) for x in first.values()])
            token = _concat(x[0] for x in first.values())
            first.clear()
            row = np.repeat(np.arange(len(node)), size)
            at = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            part = ((token >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            token = (part << 32) | (token >> np.uint64(32)).astype(np.int64)
            order = np.argsort(token, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
            width = np.diff(np.concatenate([edge, [len(token)]]))
            several = np.zeros(len(token), bool)
            several[order] = np.repeat(width > 1, width)
            sent = np.zeros(len(token), bool)
            sent[order[edge]] = True
            out = []

            def put(p, kind, k, name):
                own, index = np.unique(row[k], return_inverse=True)
                out.append((p, kind, name, zipped32(index, True), zipped32(at[k]), several[k].tobytes(), node[own].tobytes(), zipped32(n[own])))

            rest = np.flatnonzero(~sent)
            if len(rest):
                put(int(node[0] % parts), 1, rest, zipped(token[rest].tobytes()))
            k = np.flatnonzero(sent)
            k = k[np.argsort(part[k], kind="stable")]
            for own in np.split(k, np.flatnonzero(np.diff(part[k])) + 1):
                put(int(part[own[0]]), 0, own, (token[own] & 0xFFFFFFFF).astype("<u4").tobytes())
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "kind", "token", "row", "at", "several", "nodes", "sizes"])

    def answer(key, t):
        token, node, n, at, keep, asked = [], [], [], [], [], []
        for part, kind, x, r, a, several, own, sizes in zip(*(t.column(c).to_pylist() for c in ("part", "kind", "token", "row", "at", "several", "nodes", "sizes"))):
            r = unzipped32(r, True)
            token.append(np.frombuffer(unzipped(x), "<i8") if kind else np.frombuffer(x, "<u4").astype(np.int64) | (part << 32))
            node.append(np.frombuffer(own, "<i8")[r])
            n.append(unzipped32(sizes)[r])
            at.append(unzipped32(a))
            keep.append(np.frombuffer(several, bool))
            asked.append(np.full(len(r), kind == 0))
        token, node, n, at, keep, asked = map(np.concatenate, (token, node, n, at, keep, asked))
        keep, asked = keep.copy(), np.flatnonzero(asked)
        if len(asked):
            order = asked[np.argsort(token[asked])]
            edge = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
            two = np.minimum.reduceat(node[order], edge) != np.maximum.reduceat(node[order], edge)
            keep[order] |= np.repeat(two, np.diff(np.concatenate([edge, [len(order)]])))
        k = np.flatnonzero(keep)
        return pa.table({"token": token[k], "node": node[k], "n": n[k].astype(np.int64), "at": at[k].astype(np.int64)})

    blobs = docs.filter("doc_id is not null").select("text").mapInArrow(ask, "part int, kind int, token binary, row binary, at binary, several binary, nodes binary, sizes binary")
    return blobs.groupBy("part").applyInArrow(answer, POSTING).distinct()


def _unlike(lists: DataFrame) -> DataFrame:
    """The lists without those that hold the same sets as a list of an earlier shingle. The order is common to all sets, so the earlier shingle stands before the later one in each of them, and the
    first shingle that two sets share is never of a list that goes."""
    held = lists.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("a"), F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 24)).alias("b"), F.sum("at").alias("place"))
    first = held.groupBy("m", "a", "b").agg(F.min(F.struct("place", "token")).alias("first")).select("first.token")
    return lists.join(first, "token", "left_semi")


def _in_classes(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists that have two classes or more, with each node's class."""
    known = lists.select("token", "node", "n", "at").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    opened = known.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("token")
    return known.join(opened, "token", "left_semi")


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents: doc_id, h, n, node; nodes: node, n, rep (its smallest doc_id), rep_h (the hash of its text), wide, minima; links: x, y - verified links that connect what is connected (not all pairs within a class)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = stored(summaries(docs), "join-summaries")
    real = rows.filter("n > 0 and doc_id is not null")
    nodes = real.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min_by("h", F.struct("doc_id", "h")).alias("rep_h"), F.first("n").alias("n"))
    # what is the same for all documents of a node comes from one of them
    nodes = stored(nodes.join(real.select("node", F.col("doc_id").alias("rep"), F.col("h").alias("rep_h"), "wide", "minima").dropDuplicates(["node", "rep", "rep_h"]), ["node", "rep", "rep_h"]), "join-nodes")
    prefix = F.col("n") - F.ceil(F.lit(NUMERATOR) * F.col("n") / DENOMINATOR) + 1
    total = nodes.agg(F.sum(prefix)).first()[0] or 0
    lists = stored(_unlike(stored(index_lists(docs, int(total), frequent(rows)), "join-postings")), "join-lists")

    # 1. relations
    least = nodes.select("node", F.posexplode("minima").alias("k", "value"))
    heads = least.groupBy("k", "value").agg(F.min("node").alias("x"), F.max("node").alias("last")).filter("x <> last").drop("last")
    links = compared(least.join(heads, ["k", "value"]).filter("x <> node").select("x", F.col("node").alias("y")).distinct(), docs, nodes)
    leaders = stored(links.groupBy(F.col("y").alias("node")).agg(F.min(F.struct("d", "x")).alias("near")).select("node", F.col("near.x").alias("leader"), F.col("near.d").alias("off")), "join-leaders")

    # 2. the lists that are open
    links = links.select("x", "y")
    lists = stored(_in_classes(lists, components(links)), "join-open")
    one = F.struct("node", "root", "n")
    heads = lists.groupBy("token").agg(F.array(F.min_by(one, F.struct("at", "node")), F.min_by(one, F.xxhash64("node"))).alias("heads"))
    drawn = lists.join(heads, "token").select("node", "n", "root", F.explode("heads").alias("head")).filter(F.col("root") != F.col("head.root")).select("node", "n", F.col("head.node").alias("other"), F.col("head.n").alias("m")).filter(_sizes("n", "m"))
    links = links.union(compared(drawn.select(F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y")).distinct(), docs, nodes).select("x", "y"))
    known = stored(_in_classes(lists, components(links)).withColumn("block", size_class(F.col("n"))), "join-open")
    rest = lambda n, at: (DENOMINATOR + NUMERATOR) * (n - at) - NUMERATOR * n  # noqa: E731  four times the largest size that the position allows the other set
    blocks = known.groupBy("token", "block").agg(F.min("n").alias("least_n"), F.max(rest(F.col("n"), F.col("at"))).alias("position"), F.min("root").alias("low"), F.max("root").alias("high"))
    blocks = blocks.groupBy("token").agg(F.collect_list(F.struct("block", "least_n", "position", "low", "high")).alias("blocks"))  # a block for each quarter more of size
    reach = lambda x: (rest(F.col("n"), F.col("at")) >= NUMERATOR * F.greatest(x["least_n"], F.col("n"))) & (x["position"] >= NUMERATOR * F.col("n"))
    alone = lambda x: (x["low"] == x["high"]) & (x["low"] == F.col("root"))
    probe = known.join(blocks, "token").withColumn("into", F.transform(F.filter("blocks", lambda x: x["block"].between(F.col("block"), F.col("block") + 1) & reach(x) & ~alone(x)), lambda x: x["block"])).filter(F.size("into") > 0).drop("blocks")
    a, b = probe.alias("a"), known.alias("b")
    ahead = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.node") < F.col("b.node")))
    bound = (rest(F.col("a.n"), F.col("a.at")) >= NUMERATOR * F.col("b.n")) & (rest(F.col("b.n"), F.col("b.at")) >= NUMERATOR * F.col("a.n"))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.array_position(F.col("a.into"), F.col("b.block")) > 0) & ahead & (F.col("a.root") != F.col("b.root")) & bound & _sizes("a.n", "b.n"))
    pairs = stored(pairs.select(F.col("a.node").alias("x"), F.col("b.node").alias("y"), F.col("a.n").alias("a"), F.col("b.n").alias("c")).distinct(), "join-candidates")

    # 3. answers by the leaders'
    leader = lambda k: leaders.select(F.col("node").alias(k), F.col("leader").alias(f"{k}_leader"), F.col("off").alias(f"{k}_off"))
    led = pairs.join(leader("x"), "x", "left").join(leader("y"), "y", "left").withColumns({f"{k}_{c}": F.coalesce(f"{k}_{c}", F.col(k) if c == "leader" else F.lit(0)) for k in "xy" for c in ("leader", "off")})
    led = stored(led.filter((F.col("x_leader") != F.col("x")) | (F.col("y_leader") != F.col("y"))), "join-led")
    answers = sketched(led.select(F.col("x_leader").alias("x"), F.col("y_leader").alias("y")).distinct(), nodes).select(F.col("x").alias("x_leader"), F.col("y").alias("y_leader"), "far")
    # leaders whose sizes rule a link out have no sketch answer: their sets are compared
    never = led.join(answers, ["x_leader", "y_leader"]).filter(~_near(F.col("far") - F.col("x_off") - F.col("y_off"), F.col("a"), F.col("c"))).select("x", "y")
    last = compared(pairs.select("x", "y").join(never, ["x", "y"], "left_anti"), docs, nodes)
    return rows.filter("n >= 0").select("doc_id", "h", "n", "node"), nodes, links.union(last.select("x", "y"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), n, component_id: the smallest doc_id that links lead to, the document's own included."""
    rows, nodes, links = linked(docs)
    roots = components(links)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(first, "root").select("node", "component_id", F.lit(True).alias("any"))
    out = rows.join(named, "node", "left")
    return out.select("doc_id", "h", "n", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
