"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased text's characters, hashed to FEATURES places; a feature's value is its share of the text's n-grams times its inverse document
frequency (over all rows that may be learnt from). Weights come from follow-the-regularised-leader steps with an elastic net (L1 leaves most
weights zero) on at most TRAIN_PER_LANGUAGE rows of each language, by a hash of doc_id; a fifth of those rows is left out to fit the temperature.

A null text, or one without a letter, is `und` with score 0. Rows without a language or text are not learnt from; with nothing to learn from, every text is `und`.
Ties go to the first language in code-point order. Repeated rows count each. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEATURES, TRAIN_PER_LANGUAGE = 1 << 15, 1000
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.05, 0.01, 4, 40.0
UNKNOWN = "und"


def grams(text: str) -> list[np.ndarray]:
    """The places of the text's n-grams, by order."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(3):
        h = (h[: max(0, len(c) - n)] * np.uint32(0x01000193)) ^ (c[n:] * np.uint32(0x9E3779B1) + np.uint32(n + 1))
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(17))
    return out


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the documents each feature occurs (place FEATURES: the number of documents)."""

    def count(batches):
        df = np.zeros(FEATURES + 1, np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                seen = np.zeros(FEATURES, bool)
                for g in grams(text or ""):
                    seen[g] = True
                df[:-1] += seen
                df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["feature", "n"])

    got = docs.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1, np.int64)
    df[got["feature"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return df[:-1], int(df[-1])


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """rows: feature places, values, class. FTRL-proximal with an elastic net; one update for each row and epoch."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(FEATURES))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        s = logits / math.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    low, high, r = -4.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fitted(learn: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> dict:
    """learn: doc_id, text, lang of the rows that may be learnt from. Returns languages, table (FEATURES x languages: idf * weight * SCALE / temperature)."""
    learn = learn.filter("lang is not null and text is not null")
    known = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    langs = sorted(known)
    if not langs:
        return {"languages": [], "table": np.zeros((FEATURES, 0), np.float32)}
    df, n_docs = document_frequencies(learn)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    # a share of each language by a hash of the row, a little more than is wanted, and of that the first rows: rows that repeat are cut off by each task
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in known.items() for v in (k, int(1_000_000 * min(1.0, (1.2 * per_language + 100) / n)))]), F.col("lang"))
    drawn = learn.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text", F.lit(5)).alias("key")).filter(F.pmod("key", F.lit(1_000_000)) < share)
    sample = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).filter(F.col("rank") <= per_language)
    sample = sample.select("text", F.array_position(F.lit(langs), F.col("lang")).alias("y"), F.xxhash64("doc_id", F.lit(6)).alias("h"))

    def extract(batches):
        for b in batches:
            out = []
            for text, y, h in zip(*(b.column(k).to_pylist() for k in ("text", "y", "h"))):
                at, count = np.unique(np.concatenate(grams(text)), return_counts=True)
                if len(at):
                    out.append((at.astype("<u4").tobytes(), (count / count.sum()).astype("<f4").tobytes(), y - 1, h))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["at", "tf", "y", "h"])

    def train(key, t):
        t = t.sort_by([("h", "ascending")])
        rows = []
        for at, tf, y in zip(*(t.column(k).to_pylist() for k in ("at", "tf", "y"))):
            at = np.frombuffer(at, "<u4").astype(np.int64)
            rows.append((at, np.frombuffer(tf, "<f4") * idf[at] * SCALE, y))
        rest = rows[4::5] or rows
        w = train_ftrl([r for i, r in enumerate(rows) if i % 5 != 4] or rows, len(langs))
        t = temperature(np.array([x @ w[at] for at, x, _ in rest]), np.array([y for *_, y in rest]))
        table = (idf[:, None] * w * SCALE / t).astype("<f4")
        return pa.table({"model": pa.array([table.tobytes()], pa.binary())})

    got = sample.mapInArrow(extract, "at binary, tf binary, y long, h long").withColumn("one", F.lit(0)).groupBy("one").applyInArrow(train, "model binary").first()
    table = np.frombuffer(got.model, "<f4").reshape(FEATURES, len(langs)) if got else np.zeros((FEATURES, len(langs)), np.float32)
    return {"languages": langs, "table": table}


def identified(docs: DataFrame, model: dict) -> DataFrame:
    """docs' doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages floats

    def predict(batches):
        langs, table = shared.value["languages"], shared.value["table"]
        for b in batches:
            lang, score = [], []
            for text in b.column("text").to_pylist():
                if not langs or not has_letter(text):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                total, n = np.zeros(len(langs)), 0
                for g in grams(text):
                    count = np.bincount(g, minlength=FEATURES) if len(g) > 4 * FEATURES else None
                    total += count @ table if count is not None else table[g].sum(axis=0, dtype=np.float64)
                    n += len(g)
                s = total / max(1, n)
                p = np.exp(s - s.max())
                p /= p.sum()
                lang.append(langs[int(np.argmax(p))])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
