"""Document fingerprints by spot signatures, in DataFrame expressions only.

A text's words are the runs of letters and digits of its lower-cased form. At each anchor (a very common word) a signature is the anchor with the next
CHAIN content words, words that are not common, of the WINDOW words after it. The set of a text's signatures, each as the first 8 hex digits of its MD5, is its fingerprint: the
sorted signatures written one after the other. A text without an anchor has one signature, of the whole text. The likeness of two texts is the Jaccard coefficient of
their sets.

Null counts as empty text; the empty text has the signature of the empty string. Equal texts have equal fingerprints. Rows that repeat get one result each. An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.llm.common import stored

#: Words that anchor signatures, and further common words that no chain takes.
ANCHORS = ["a", "das", "de", "der", "die", "du", "el", "et", "in", "is", "la", "le", "of", "que", "the", "to", "und", "was", "zu"]
OTHERS = ["and", "at", "auf", "by", "del", "den", "des", "ein", "en", "est", "for", "from", "im", "it", "las", "les", "los", "mit", "no", "on", "or", "os", "por", "qui", "se", "sich", "that", "this", "un", "une", "von", "with", "y"]
CHAIN, WINDOW = 2, 6
GAPS = r"[^\p{L}\p{N}]+"
SIGNATURE = 8


def _md5(x: Column) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, SIGNATURE)


def spots(text: Column) -> Column:
    """array<string>: the words of a text."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), GAPS, " ")), " ")


def signatures(words: Column, text: Column) -> Column:
    """array<string>: the sorted distinct signatures of a text whose spots() are words."""
    content = lambda y: ~y.isin(ANCHORS + OTHERS)
    chain = lambda i: F.array_join(F.slice(F.filter(F.slice(words, i + 2, WINDOW), content), 1, CHAIN), " ")
    found = F.filter(F.transform(words, lambda x, i: F.when(x.isin(ANCHORS), _md5(F.concat_ws(" ", x, chain(i))))), lambda s: s.isNotNull())
    return F.sort_array(F.array_distinct(F.when(F.exists(words, lambda x: x.isin(ANCHORS)), found).otherwise(F.array(_md5(F.concat(F.lit("="), text))))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def fingerprint(signatures: Column) -> Column:
    return F.array_join(signatures, "")


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("kid"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("h")]


def ranked(docs: DataFrame) -> DataFrame:
    """Rows that repeat an id with its text are one here: doc_id, kid (doc_id, or the least number for null), h (a hash of the text and of doc_id being null), n (code points), copies, and rank from 0 by
    descending doc_id (null last, ties by h), without a window over all rows: ranges, ranks within each, and the ranges' running counts."""
    ids = docs.select("doc_id", *_key(), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).groupBy("kid", "h").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    order = [F.col("kid").desc(), F.col("h")]
    ids = stored(ids.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()), "fingerprint-order")
    sizes = ids.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))  # a row for each partition
    starts = sizes.select("chunk", F.coalesce(F.sum("rows").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ids.join(starts, "chunk").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("chunk").orderBy(*order)) - 1).select("doc_id", "kid", "h", "n", "copies", "rank")


def compared(docs: DataFrame) -> DataFrame:
    """Every document with its signatures, those of its edited text, those of the next document, and the edited text's SHA-256. Of rows that repeat an id with its text, each but the last is followed by its like."""
    order = stored(ranked(docs), "fingerprint-ranks")
    total = order.count()
    before = order.select(F.col("kid").alias("to_kid"), F.col("h").alias("to_h"), F.floor(F.col("n") / 2).cast("int").alias("need"), F.pmod(F.col("rank") + 1, F.lit(max(1, total))).alias("rank"))
    order = order.join(before, "rank").drop("rank")
    # the texts are dealt out once, by (kid, h); a map task sends rows that repeat both once
    text = docs.select(*_key(), F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("_k", F.row_number().over(Window.partitionBy("kid", "h").orderBy("kid"))).filter("_k = 1").drop("_k")
    rows = text.join(order, ["kid", "h"])
    # the words are a column of their own: inside signatures() they would be made anew for every word
    rows = rows.withColumn("w", spots(F.col("text"))).withColumn("sigs", signatures(F.col("w"), F.col("text"))).drop("w")
    # each text sends its beginning, as much as is asked for, and its signatures to the one before it
    sent = rows.select(F.col("to_kid").alias("kid"), F.col("to_h").alias("h"), F.expr("left(text, need)").alias("beginning"), F.col("sigs").alias("next_sigs"))
    got = rows.select("doc_id", "kid", "h", "n", "copies", "text", "sigs").join(sent, ["kid", "h"])
    half = F.floor(F.col("n") / 2).cast("int")
    case = lambda beginning, sigs, times: F.struct(beginning.alias("beginning"), sigs.alias("next_sigs"), times.cast("int").alias("times"))
    last, inner = case(F.col("beginning"), F.col("next_sigs"), F.lit(1)), case(F.substring(F.col("text"), F.lit(1), half), F.col("sigs"), F.col("copies") - 1)
    got = got.select("doc_id", "n", "sigs", F.substring(F.col("text"), F.lit(1), (F.col("n") - half).cast("int")).alias("kept"), F.explode(F.when(F.col("copies") > 1, F.array(last, inner)).otherwise(F.array(last))).alias("c"))
    got = got.select("doc_id", "n", "sigs", F.concat("kept", "c.beginning").alias("edited"), F.col("c.next_sigs").alias("next_sigs"), F.col("c.times").alias("times"))
    got = got.withColumn("w", spots(F.col("edited")))
    got = got.select("doc_id", F.col("n").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sigs", signatures(F.col("w"), F.col("edited")).alias("edited_sigs"), "next_sigs", "times")
    return got.withColumn("_i", F.explode(F.sequence(F.lit(1), "times"))).drop("_i", "times")


def near_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """prints: doc_id, sigs (sorted sets). The pairs a < b of class representatives with a likeness of `least` or more; a class is the documents of one set, and its
    representative, with which membership is given by an equal set, is its smallest doc_id.

    Sets are partitioned by length, at the powers of 1 / least: only neighbouring partitions can hold likely pairs. A set meets others by the signatures of its prefix, which every
    pair that is alike enough shares one of; before a pair is compared, it must also pass the bound that the places of the shared signature set.
    """
    reps = prints.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("sigs"))
    reps = stored(reps.withColumn("part", F.floor(F.log(F.col("n")) / F.log(F.lit(1 / least)) + 1e-9).cast("int")), "fingerprint-classes")
    prefix = F.slice("sigs", 1, (F.col("n") - F.ceil(least * F.col("n")) + 1).cast("int"))
    index = reps.select("doc_id", "n", "part", F.posexplode(prefix).alias("at", "sig"))
    probe = index.select("doc_id", "n", "at", "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    most = 1 + F.least(F.col("a.n") - F.col("a.at") - 1, F.col("b.n") - F.col("b.at") - 1)
    enough = most >= F.ceil(least / (1 + least) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    pairs = probe.alias("a").join(index.alias("b"), (F.col("a.sig") == F.col("b.sig")) & (F.col("a.part") == F.col("b.part")) & ordered & (F.col("a.n") >= least * F.col("b.n")) & enough)
    pairs = pairs.select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).distinct()
    sets = reps.select("doc_id", "sigs")
    pairs = pairs.join(sets.toDF("x", "s"), "x").join(sets.toDF("y", "t"), "y").withColumn("likeness", likeness(F.col("s"), F.col("t"))).filter(F.col("likeness") >= least)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")
