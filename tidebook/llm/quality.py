"""Quality rules by distribution divergence, in DataFrame expressions only.

Two histograms describe a document: its characters by class (upper case, digits, symbols, marks, white space, the rest) and its words by common word of its
language (COMMON, and one place for all other words). A language's reference is the sum over its documents that pass the base rules and
look alike. A document is kept if the Jensen-Shannon distance (base 2, its square root) of each histogram to the reference is at most the limit; the
guards leave a histogram unjudged where the text is too short for it: under MIN_CHARS characters in words, under MIN_WORDS words.

The base rules count words, symbols, repeated lines and words in repeated 5-word windows; a document fails them under 10 words, or with more
than a fifth of its words in repeated windows. Null and empty texts have no words and fail. A null language, or one without a list, is compared by the words of all lists
and with the reference of its own documents. An empty table gives no rows; repeated rows and ids count each. Windows are compared by 64-bit hashes within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import SPACE, stored, words

#: Very common words of each language.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
UPPER, DIGIT, SYMBOL, MARK = r"\p{Lu}", "[0-9]", r"[#*$%&|<>]", r"[.,;:!?'\"()_-]"
MIN_CHARS, MIN_WORDS = 300, 100
FIRST_CHARS_DISTANCE, MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE = 0.2, 0.21, 0.24
LANGUAGES_BROADCAST = 10_000


def base(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, lang. The counts of the base rules, and both histograms (chars, common: arrays)."""
    d = docs.select("doc_id", "lang", F.xxhash64("text").alias("_h"), F.coalesce("text", F.lit("")).alias("t")).withColumn("w", words(F.col("t")))
    d = d.withColumn("n", F.size("w").cast("long"))
    d = d.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(5)])
    d = d.withColumn("win", F.when(F.col("n") >= 5, F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 5), window)).otherwise(F.array().cast("array<bigint>")))
    # only texts with a repeated window sort theirs
    d = d.withColumn("again", F.size(F.array_distinct("win")) < F.size("win"))
    d = d.withColumn("by_hash", F.when(F.col("again"), F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("by_hash", j)["h"] == x["h"], F.lit(False))
    d = d.withColumn("at", F.when(F.col("again"), F.sort_array(F.transform(F.filter("by_hash", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("at", i + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("lines", lines)
    d = d.withColumn("low", F.transform("w", F.lower))
    union = sorted({w for ws in COMMON.values() for w in ws})
    lists = F.lit(union)
    for lang, ws in COMMON.items():
        lists = F.when(F.col("lang") == lang, F.lit(ws)).otherwise(lists)
    d = d.withColumn("hits", F.filter("low", lambda w: w.isin(union))).withColumn("list", lists)
    d = d.select(
        "doc_id",
        "lang",
        "_h",
        F.col("n").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("list", lambda v: F.size(F.filter("hits", lambda x: x == v)).cast("long")).alias("found"),
        F.length("t").cast("long").alias("_n"),
        *[F.regexp_count("t", F.lit(p)).cast("long").alias(f"_{k}") for k, p in (("upper", UPPER), ("digit", DIGIT), ("mark", MARK))],
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    space = F.col("_n") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("n_symbols") - F.col("_mark")
    chars = F.array("_upper", "_digit", "n_symbols", "_mark", space, rest)
    others = F.col("n_words") - F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", "lang", "_h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), chars.alias("chars"), F.concat("found", F.array(others)).alias("common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")
    pairs = F.zip_with(p, q, lambda a, b: F.struct((a / total(p)).alias("a"), (b / total(q)).alias("b")))

    def term(x: Column, mean: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / mean)).otherwise(F.lit(0.0))

    part = F.transform(pairs, lambda x: (term(x["a"], (x["a"] + x["b"]) / 2) + term(x["b"], (x["a"] + x["b"]) / 2)) / 2)
    summed = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), summed)))


def reference(counts: DataFrame, name: str) -> DataFrame:
    """lang, ref_<name>: the sums of that histogram over each language's documents."""
    long = counts.select("lang", F.posexplode(name).alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    return long.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias(f"ref_{name}"))


def with_reference(counts: DataFrame, refs: DataFrame) -> DataFrame:
    refs = stored(refs, "quality-reference").withColumnRenamed("lang", "_lang")
    if refs.count() <= LANGUAGES_BROADCAST:
        refs = F.broadcast(refs)
    return counts.join(refs, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")


def judged(docs: DataFrame) -> DataFrame:
    """base(), with chars_distance, words_distance, kept and _h, the text's hash. The references are made twice: from what passes the base rules, then from that of it whose
    characters are within FIRST_CHARS_DISTANCE of the first, so that junk doesn't set the standard."""
    counts = stored(base(docs), "quality")  # a few numbers of each document; the texts are read once
    ok = counts.filter(~F.col("base_failed"))
    near = with_reference(ok, reference(ok, "chars")).filter(F.coalesce(distance(F.col("chars"), F.col("ref_chars")) <= FIRST_CHARS_DISTANCE, F.lit(True))).drop("ref_chars")
    d = with_reference(with_reference(counts, reference(near, "chars")), reference(near, "common"))
    d = d.withColumn("chars_distance", distance(F.col("chars"), F.col("ref_chars"))).withColumn("words_distance", distance(F.col("common"), F.col("ref_common")))
    near = ((F.col("word_chars") < MIN_CHARS) | F.coalesce(F.col("chars_distance") <= MAX_CHARS_DISTANCE, F.lit(True))) & ((F.col("n_words") < MIN_WORDS) | F.coalesce(F.col("words_distance") <= MAX_WORDS_DISTANCE, F.lit(True)))
    return d.select("doc_id", "_h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_distance", "words_distance", (~F.col("base_failed") & near).alias("kept"))
