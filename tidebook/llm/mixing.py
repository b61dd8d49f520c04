"""Mixing sources to target weights.

The words of each source, its documents in a pseudorandom order, are cut into blocks of a fixed length. The mixture is a row of
slots in output shards. How many slots of a shard each source fills is a multinomial draw, conditioned on the totals that the
targets fix: a tree of multivariate hypergeometric splits, so that each shard finds its own draw without the others. The j-th slot of a
source maps to epoch j div n and, through that epoch's pseudorandom permutation of 0..n-1, to a block. Slots and blocks are joined by (source, index).

Null or empty texts have no words: they are in no block and are taken 0 times. Documents without a source form a source of their
own (null, last in order). Repeated ids and rows count as documents of their own by their position in the order (ties by text hash).
An empty table gives an empty mixture. Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidebook.llm.common import SPACE, WORD, stored

BLOCK_WORDS, SHARD_SLOTS, CHUNKS, MOST_EPOCHS, SEED = 128, 4096, 1024, 3, 20240229
#: A source's documents are numbered by chunks of so many rows on the average; there are CHUNKS of them at least.
CHUNK_ROWS = 20_000
#: The library's hypergeometric sampler takes fewer items than this; drawn_from() draws from more by ratio of uniforms.
_SAMPLER_MOST = 10**9


def n_words(text: Column) -> Column:
    """Words of a text, null: 0; counts the places where a word begins, without an array of the words."""
    t = F.coalesce(text, F.lit(""))
    spaced = F.regexp_replace(t, SPACE, " ")
    inner = F.length(spaced) - F.length(F.translate(spaced, " ", ""))
    lead = F.when(F.startswith(spaced, F.lit(" ")), 1).otherwise(0)
    tail = F.when(F.endswith(spaced, F.lit(" ")), 1).otherwise(0)
    return F.when(F.length(F.trim(spaced)) == 0, F.lit(0)).otherwise(inner - lead - tail + 1).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources: source, source_size. Adds target: sources by code point, null last, weigh 1, 2, 3, repeating; no target is over three times
    its source's size, and what is over goes to the others by weight. As a level: target = min(cap, level * weight), where the
    sources that reach their caps are those of least cap / weight. One row for each source, so one window over them all."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("weight", (F.row_number().over(w) - 1) % 3 + 1).withColumn("cap", MOST_EPOCHS * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    s = (
        s.withColumn("capped", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("capped")) / F.col("open_weight"))
        # the first source in this order whose cap is not reached fixes the level
        .withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
        .withColumn("level", F.first("fits", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given places: a four-round Feistel network on the next even power of two, walked until it falls below n."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.PCG64(key)).integers(0, 2**63, 4, dtype=np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = x = (left << np.uint64(half)) | right
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def drawn_from(rng: np.random.Generator, good: int, bad: int, take: int, most: int = _SAMPLER_MOST) -> int:
    """How many of `good` are among `take` items drawn from good + bad without replacement, whatever their number (Stadlober's ratio of uniforms on the logarithm of the probability)."""
    n = good + bad
    if not take or not good:
        return 0
    if not bad or take == n:
        return min(good, take)
    if n < most:
        return int(rng.hypergeometric(good, bad, take))
    low, high = max(0, take - bad), min(good, take)
    mean, spread = take * (good / n), math.sqrt(take * (good / n) * (bad / n) * ((n - take) / (n - 1)) + 0.5)
    top = min(high, max(low, ((take + 1) * (good + 1)) // (n + 2)))

    def steps(x: int, total: int, k: int) -> float:
        """log of C(total, top + k) / C(total, top), where it is summed as a difference of logarithms of factorials."""
        return math.lgamma(x + 1) + math.lgamma(total - x + 1) - math.lgamma(x + k + 1) - math.lgamma(total - x - k + 1)

    while True:
        u = 1.0 - rng.random()  # fixed values: the width of the hat
        x = mean + 0.5 + (1.7155277699214135 * spread + 0.8989161620588988) * (rng.random() - 0.5) / u
        k = math.floor(x)
        if low <= k <= high and 2 * math.log(u) <= steps(top, good, k - top) + steps(take - top, bad, top - k):
            return k


def shard_draw(counts: np.ndarray, shards: int, shard: int, seed: int, most: int = _SAMPLER_MOST) -> tuple[np.ndarray, np.ndarray]:
    """How many slots of this shard each source fills, and how many of its slots lie in earlier shards. Halves the row of shards again and again; a
    node's draw depends on the seed and the node alone, so all shards agree and their draws add up to counts."""
    counts, before, lo, hi = counts.astype(np.int64), np.zeros(len(counts), np.int64), 0, shards
    total = int(counts.sum())
    first, last = 0, total  # slots of this node
    while hi - lo > 1:
        mid = (lo + hi) // 2
        cut = total * mid // shards
        take = cut - first
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left, open_, rest = np.zeros_like(counts), last - first, take
        for s, n in enumerate(counts.tolist()):  # source by source, each given those before it
            left[s] = drawn_from(rng, n, open_ - n, rest, most)
            open_, rest = open_ - n, rest - int(left[s])
        if shard < mid:
            counts, hi, last = left, mid, cut
        else:
            before, counts, lo, first = before + left, counts - left, mid, cut
    return counts, before


SLOT = T.StructType([T.StructField(n, k) for n, k in (("shard", T.LongType()), ("slot", T.IntegerType()), ("source_no", T.IntegerType()), ("epoch", T.IntegerType()), ("block", T.LongType()))])


def slots(spark: SparkSession, plan: list, shards: int, seed: int = SEED) -> DataFrame:
    """plan: (blocks, slots) of each source. One row for each slot of the mixture: the block that fills it."""
    blocks, counts = (np.array([p[k] for p in plan], np.int64) for k in (0, 1))

    def draw(batches):
        schema = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source_no", pa.int32()), ("epoch", pa.int32()), ("block", pa.int64())])
        for batch in batches:
            for shard in batch.column(0).to_numpy():
                take, before = shard_draw(counts, shards, int(shard), seed)
                who = np.repeat(np.arange(len(take)), take)
                order = np.random.Generator(np.random.PCG64([seed, int(shard), 7])).permutation(len(who))
                epoch, block = np.zeros(len(who), np.int32), np.zeros(len(who), np.int64)
                for s in np.flatnonzero(take):
                    at = who == s
                    j = before[s] + np.arange(take[s])
                    epoch[at] = j // blocks[s]
                    for e in np.unique(j // blocks[s]):
                        mine = np.flatnonzero(at)[j // blocks[s] == e]
                        block[mine] = permuted(j[j // blocks[s] == e] % blocks[s], int(blocks[s]), seed + 1_000_003 * int(s) + int(e))
                place = np.empty(len(who), np.int32)
                place[order] = np.arange(len(who))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), shard, np.int64)), pa.array(place), pa.array(who.astype(np.int32)), pa.array(epoch), pa.array(block)], schema=schema)

    return spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInArrow(draw, SLOT)


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: doc_id, text, source. Returns
    sizes: a row for each document, with key (its number in this run), size, source_size, target, _h (its text's hash);
    taken: shard, slot, epoch, key, start, length - the words of the document that the slot holds, in its order;
    sources: source, source_size, target, blocks, slots.
    """
    spark = docs.sparkSession
    chunks = max(CHUNKS, -(-docs.count() // CHUNK_ROWS))  # from the tables' footers
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_h"))
    d = d.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_h"), F.lit(chunks)).cast("int"))
    d = stored(d, "mix-sizes")  # the texts are read once
    per_chunk = d.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"), F.count(F.lit(1)).alias("chunk_rows"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.withColumn("chunk_start", F.coalesce(F.sum("chunk_size").over(ahead), F.lit(0)))
    sources = targets(per_chunk.groupBy("source").agg(F.sum("chunk_size").cast("long").alias("source_size")))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    per_block = F.col("source_size") / F.greatest(F.col("blocks"), F.lit(1))
    sources = sources.withColumn("slots", F.when(F.col("blocks") > 0, F.least(MOST_EPOCHS * F.col("blocks"), F.round(F.col("target") / per_block).cast("long"))).otherwise(F.lit(0).cast("long")))
    sources = stored(sources.withColumn("source_no", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")), "mix-sources")
    plan = [(max(1, r.blocks), r.slots) for r in sources.orderBy("source_no").collect()]  # a row for each source
    shards = max(1, -(-sum(p[1] for p in plan) // shard_slots))

    within = Window.partitionBy("source", "chunk").orderBy(F.xxhash64(F.lit(seed), "doc_id", "_h"), "doc_id", "_h").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    starts = F.broadcast(per_chunk.select("source", "chunk", "chunk_start")) if len(plan) * chunks <= 200_000 else per_chunk.select("source", "chunk", "chunk_start")
    placed = d.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("_no", F.row_number().over(Window.partitionBy("source", "chunk").orderBy(F.xxhash64(F.lit(seed), "doc_id", "_h"), "doc_id", "_h")))
    placed = placed.alias("a").join(starts.alias("b"), same & (F.col("a.chunk") == F.col("b.chunk"))).select("a.*", (F.col("b.chunk_start") + F.col("a._before")).alias("at"))
    small = F.broadcast(sources) if len(plan) <= 100_000 else sources
    placed = placed.alias("a").join(small.alias("b"), same).select("a.doc_id", "a.size", "a.at", "b.source_size", "b.target", "b.source_no", "a._h", F.concat_ws("-", "b.source_no", "a.chunk", "a._no").alias("key"))
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    segments = placed.filter("size > 0").select("key", "source_no", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("at"), F.col("block") * block_words)
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    segments = segments.select("key", "source_no", "block", (low - F.col("at")).alias("start"), (high - low).alias("length"))
    # the planner can't see how many slots a shard has: without the hint it would broadcast them
    taken = slots(spark, plan, shards, seed).hint("merge").join(segments, ["source_no", "block"]).select("shard", "slot", "epoch", "key", "start", "length")
    return placed.select("key", "doc_id", "size", "source_size", "target", "_h"), taken, sources


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mixture as documents: each piece that a slot takes is a row of docs' columns, with that piece as its text (whole words, with the white space between them)."""
    sizes, taken, _ = mixture(docs, **kw)
    names = docs.columns
    pieces = taken.join(sizes.select("key", F.col("doc_id").alias("__mix_id"), F.col("_h").alias("__mix_h")), "key")
    per_doc = pieces.groupBy("__mix_id", "__mix_h").agg(F.sort_array(F.collect_list(F.struct("shard", "slot", "start", "length"))).alias("__mix_taken"))  # a document's own pieces: its size / block_words * 3 at most
    # rows that repeat an id with its text share their pieces: the first of them is cut
    first = docs.withColumn("__mix_t", F.xxhash64("text")).withColumn("__mix_row", F.row_number().over(Window.partitionBy("doc_id", "__mix_t").orderBy("doc_id"))).filter("__mix_row = 1")
    joined = first.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__mix_id")) & (F.col("__mix_t") == F.col("__mix_h"))).select(*names, "__mix_taken")
    out = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField("text", T.StringType())])

    def cut(batches):
        import re

        word = re.compile(WORD)
        for batch in batches:
            rows, texts = [], []
            for i, (text, taken) in enumerate(zip(batch.column("text").to_pylist(), batch.column("__mix_taken").to_pylist())):
                spans = [m.span() for m in word.finditer(text or "")]
                for t in taken:
                    rows.append(i)
                    texts.append(text[spans[t["start"]][0] : spans[t["start"] + t["length"] - 1][1]])
            kept = batch.select([f.name for f in out.fields[:-1]]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], names=[f.name for f in out.fields])

    cut_out = joined.mapInArrow(cut, out)
    if "n_chars" in names:
        cut_out = cut_out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut_out.select(*names)
