"""Document quality by hierarchical empirical Bayes.

Evidence. A logistic classifier on a text's rates (FEATURES), fitted on at most TRAIN_ROWS labelled rows by a hash of doc_id, gives each document its
log-likelihood ratio: its log-odds less those of the base rate.
Sites. Every document counts for its host and its path with its label, where it may be learnt from, or else with the classifier's probability. A host's rate is shrunk
towards the global rate, a path's towards its host's, each by a concentration (so many documents' worth) that the method of moments finds in the spread of the groups' rates
beyond chance. A document leaves its own count out.
Posterior. The log-odds of the document's path plus the document's evidence.

Host and path are columns (host_path() takes them from a URL; op10 takes source and language). A null host or path is a group of its own. Null and empty texts have the
classifier's evidence for an empty text. Without labels of both kinds there is no evidence and every rate is one half. A table of no rows gives none. Repeated rows count each; of several
labels of a document the largest counts. Columns other than doc_id, text, host, path are ignored.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import pieces, stored, utf8

TRAIN_ROWS, RIDGE, THRESHOLD, GROUPS_BROADCAST = 20_000, 1.0, 0.5, 100_000
CONCENTRATION = (2.0, 10_000.0)
_BYTES = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&<>", "bar": b"|", "mark": b"!?", "line": b"\n"}
FEATURES = 11


def rates(buf: np.ndarray, at: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    size = np.maximum(1, np.diff(at)).astype(float)
    counts = np.zeros((len(_BYTES), len(texts)))
    for i, j in pieces(at):
        edge = at[i : j + 1] - at[i]
        for k, chosen in enumerate(_BYTES.values()):
            flag = np.zeros(256, np.uint8)
            flag[list(chosen)] = 1
            total = np.zeros(edge[-1] + 1, np.int64)
            np.cumsum(flag[buf[at[i] : at[j]]], out=total[1:])
            counts[k, i:j] = total[edge[1:]] - total[edge[:-1]]
    upper, digit, symbol, bar, mark, line = counts
    n, different, adjacent = np.ones(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    for i, t in enumerate(texts):
        w = (t or "").split()
        n[i], different[i], adjacent[i] = max(1, len(w)), len(set(w)), sum(map(operator.eq, w, w[1:]))
    log_n = np.log1p(n)
    return np.stack([log_n, upper / size, digit / size, np.sqrt(symbol / n), np.sqrt(bar / n), np.sqrt(mark / n), line / n, size / n / 10, adjacent / n, different / n, different / n * log_n], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> dict:
    """Newton steps on standardised features with a ridge."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / sd], 1)
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], RIDGE)
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    base = (y.sum() + 0.5) / (len(y) + 1)
    return {"mean": mean, "sd": sd, "w": w, "base": math.log(base / (1 - base))}


def classifier(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """From docs (doc_id, text) and labels (doc_id, quality), both less what is held out."""
    lab = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    lab = lab.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(1, labels.count()))))
    sample = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")  # about `rows` rows at most

    def extract(batches):
        for b in batches:
            x = rates(*utf8(b.column("text")), b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column("quality").cast(pa.int32()), b.column("h")], names=["x", "y", "h"])

    # repeated ids bring more rows than labels: the first by a hash come to the driver
    got = sample.select("text", "quality", F.xxhash64("doc_id", "text", F.lit(31)).alias("h")).mapInArrow(extract, "x array<double>, y int, h long").orderBy("h").limit(rows).toPandas()
    y = got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    return fit_logistic(np.stack(got["x"].to_list()), y)


def evidence(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs (doc_id, host, path, text) with llr and p, without text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers

    def weigh(batches):
        m = shared.value
        for b in batches:
            if m is None:
                llr = p = np.zeros(b.num_rows) + 0.0
                p = p + 0.5
            else:
                x = rates(*utf8(b.column("text")), b.column("text").to_pylist())
                s = np.clip(((x - m["mean"]) / m["sd"]) @ m["w"][1:] + m["w"][0], -12, 12)
                llr, p = s - m["base"], 1 / (1 + np.exp(-s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("host"), b.column("path"), pa.array(llr), pa.array(p)], names=["doc_id", "host", "path", "llr", "p"])

    return docs.select("doc_id", F.col("host").cast("string"), F.col("path").cast("string"), "text").mapInArrow(weigh, "doc_id long, host string, path string, llr double, p double")


def concentration(groups: DataFrame, rate: Column) -> float:
    """groups: n, k (sums), with the rate each is shrunk to: the number m of documents' worth for which the groups' spread is what a beta prior m gives."""
    r = F.col("k") / F.col("n")
    got = groups.filter("n > 1").agg(F.sum(F.col("n") * (r - rate) ** 2).alias("spread"), F.sum(F.col("n") * rate * (1 - rate)).alias("chance"), F.sum(rate * (1 - rate)).alias("once")).first()
    if not got or not got.chance:
        return CONCENTRATION[1]
    # E[n (r - rate)^2] = rate (1 - rate) (1 + (n - 1) / (m + 1))
    extra = (got.spread - got.once) / max(1e-12, got.chance - got.once)
    return min(CONCENTRATION[1], max(CONCENTRATION[0], 1 / extra - 1)) if extra > 0 else CONCENTRATION[1]


def posteriors(docs: DataFrame, labels: DataFrame, model: dict | None) -> DataFrame:
    """docs: doc_id, host, path, text; labels: those that may be used. doc_id, host_rate, path_rate, llr, score."""
    lab = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("double").alias("_y"))
    e = stored(evidence(docs, model), "site-evidence")
    e = e.join(lab, F.col("doc_id") == F.col("_id"), "left").withColumn("count", F.coalesce("_y", "p")).drop("_id", "_y")
    paths = stored(e.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("count").alias("k")), "site-paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "site-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = (total.k + 0.5) / (total.n + 1) if total and total.n else 0.5
    m_host = concentration(hosts, F.lit(rate))
    shrunk = hosts.withColumn("rate", (F.col("k") + m_host * rate) / (F.col("n") + m_host))
    named = shrunk.select(F.col("host").alias("_host"), F.col("n").alias("host_n"), F.col("k").alias("host_k"), "rate")
    both = stored(paths.join(named, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "site-groups")
    m_path = concentration(both, F.col("rate"))
    groups = both.count()
    both = both.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "k", "host_n", "host_k")
    d = e.join(F.broadcast(both) if groups <= GROUPS_BROADCAST else both, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    # the document's own count is left out
    d = d.withColumn("host_rate", (F.col("host_k") - F.col("count") + m_host * rate) / (F.col("host_n") - 1 + m_host))
    d = d.withColumn("path_rate", (F.col("k") - F.col("count") + m_path * F.col("host_rate")) / (F.col("n") - 1 + m_path))
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("path_rate")))
    return d.select("doc_id", "host_rate", "path_rate", "llr", (1 / (1 + F.exp(-(F.log(p / (1 - p)) + F.col("llr"))))).alias("score"))


def host_path(url: Column) -> tuple[Column, Column]:
    """The host (less www. and m.) and the first segment of the path of a URL; null where there is none."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^(www|m)\.", "")
    first = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/([^/]*)", 1)
    return host, F.when(first != "", first)
