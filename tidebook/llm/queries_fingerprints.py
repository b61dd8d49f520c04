"""op5: fingerprints of all documents and of their edited texts, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import table
from tidebook.llm.fingerprints import ANCHORS, CHAIN, GAPS, OTHERS, SIGNATURE, WINDOW, compared, fingerprint, likeness


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fingerprints and their likeness to the edited text's and the next document's."""
    d = compared(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def _sql() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    words = lambda t: f"string_split(trim(regexp_replace(lower({t}), '{GAPS}', ' ', 'g'), ' '), ' ')"

    def sigs(name: str, source: str, text: str) -> str:
        return f"""{name}w AS (SELECT doc_id, {text} AS x, {words(text)} AS w FROM {source}),
{name}s AS (SELECT doc_id, CASE WHEN list_has_any(w, {quoted(ANCHORS)}) THEN list_sort(list_distinct(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains({quoted(ANCHORS)}, w[i])),
  lambda i: left(md5(concat_ws(' ', w[i], array_to_string(list_filter(w[i + 1:i + {WINDOW}], lambda y: NOT list_contains({quoted(ANCHORS + OTHERS)}, y))[1:{CHAIN}], ' '))), {SIGNATURE})))) ELSE [left(md5('=' || x), {SIGNATURE})] END AS s FROM {name}w)"""

    like = lambda a, b: f"len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, lead(doc_id) OVER (ORDER BY doc_id DESC) AS after, max(doc_id) OVER () AS top FROM d),
e AS (SELECT o.doc_id, o.n, o.t, b.doc_id AS next_id, left(o.t, o.n - o.n // 2) || CASE WHEN o.n // 2 > 0 THEN left(b.t, o.n // 2) ELSE '' END AS edited FROM o JOIN d b ON b.doc_id = coalesce(o.after, o.top)),
{sigs("a", "d", "t")},
{sigs("b", "e", "edited")}
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, array_to_string(a.s, '') AS fingerprint, array_to_string(b.s, '') AS edited_fingerprint, {like("a.s", "b.s")} AS near_edited, {like("a.s", "c.s")} AS near_next
FROM e JOIN "as" a USING (doc_id) JOIN bs b USING (doc_id) JOIN "as" c ON c.doc_id = e.next_id""".replace("\nas AS", '\n"as" AS')


SQL = _sql()
