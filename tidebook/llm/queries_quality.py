"""op4: quality rules over all documents, and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm.common import table
from tidebook.llm.quality import COMMON, DIGIT, FIRST_CHARS_DISTANCE, MARK, MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE, MIN_CHARS, MIN_WORDS, SYMBOL, UPPER, judged


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and the verdict for each document."""
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("chars_distance", "words_distance", "_h")


def sql(source: str = "documents", what: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept") -> str:
    """DuckDB SQL of the same rules on a table with doc_id (unique), text, lang."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    mark = MARK.replace("'", "''").replace('\\"', '"')
    union = quoted(sorted({w for ws in COMMON.values() for w in ws}))
    lists = " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in COMMON.items())
    shares = lambda a: f"list_transform({a}, lambda x: x / list_sum({a})::DOUBLE)"
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({shares(p)}, {shares(q)}), lambda x: (CASE WHEN x[1] > 0 THEN x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0 END) / 2))))"
    reference = lambda a, t, where: f"SELECT lang, list(n ORDER BY k) AS ref FROM (SELECT lang, k, sum({a}[k])::BIGINT AS n FROM {t}, range(1, 60) AS s(k) WHERE k <= len({a}) AND {where} GROUP BY ALL) GROUP BY lang"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains({union}, x)) AS hits FROM {source}),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS five, lead(x, 4) OVER o IS NOT NULL AS whole FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g WHERE whole),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, range(0, 5) AS s(k) WHERE n >= 2 GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, length(t) AS n_all,
  length(t) - length(regexp_replace(t, '{UPPER}', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '{DIGIT}', '', 'g')) AS digit, length(t) - length(regexp_replace(t, '{mark}', '', 'g')) AS mark,
  list_transform(CASE lang {lists} ELSE {union} END, lambda v: len(list_filter(hits, lambda x: x = v))) AS found
  FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  [upper, digit, n_symbols, mark, n_all - word_chars, word_chars - upper - digit - n_symbols - mark] AS chars, list_append(found, n_words - list_sum(found)::BIGINT) AS common FROM b),
c1 AS ({reference("chars", "f", "NOT base_failed")}),
f1 AS (SELECT f.* FROM f LEFT JOIN c1 ON f.lang IS NOT DISTINCT FROM c1.lang WHERE NOT base_failed AND coalesce({js("chars", "c1.ref")} <= {FIRST_CHARS_DISTANCE}, true)),
rc AS ({reference("chars", "f1", "true")}),
rw AS ({reference("common", "f1", "true")}),
j AS (SELECT f.*, {js("chars", "rc.ref")} AS chars_distance, {js("common", "rw.ref")} AS words_distance
  FROM f LEFT JOIN rc ON f.lang IS NOT DISTINCT FROM rc.lang LEFT JOIN rw ON f.lang IS NOT DISTINCT FROM rw.lang),
k AS (SELECT *, NOT base_failed AND (word_chars < {MIN_CHARS} OR coalesce(chars_distance <= {MAX_CHARS_DISTANCE}, true)) AND (n_words < {MIN_WORDS} OR coalesce(words_distance <= {MAX_WORDS_DISTANCE}, true)) AS kept FROM j)
SELECT {what} FROM k"""


SQL = sql()
