"""Toxic passages by maximum-scoring segments.

Training. Of the labelled rows allowed, at most TRAIN_ROWS (a bounded sample by hash of doc_id), in how many toxic and how many other documents does each
word, and each prefix of a word of 3 to 8 characters, occur? Log-odds with a Dirichlet prior in proportion to the pooled frequency, brought Z
standard errors nearer to nought; kept where that is LEAST or more, or -LEAST or less, at most MODEL_SIZE features of either sign by z.
Scoring. A word's score is the largest of its features' log-odds; with evidence against only, the strongest of that, to -AGAINST; -DRIFT without a feature. One linear scan over the whole text finds all maximal scoring segments.
Calibration. Scores of segments of other documents have an extreme-value tail: a segment of score S has E = K n exp(-lambda S) among n words;
lambda is the positive root of the moment equation of the non-toxic word scores and K matches the segments that non-toxic training documents
have. Significant segments (E < E_MOST) are passages; the sum of their -ln E goes through a logistic curve fitted on the training rows.

Null and empty texts have no passage and the curve's least value as score. Without labels of both kinds every score is the base rate. Ties
go to the earlier segment. Columns other than doc_id and text (labels: doc_id, toxic) are ignored; labels that are null or belong to no document are not used, and
of several labels of a document the largest counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import stored

TRAIN_ROWS, MODEL_SIZE, LABELS_BROADCAST = 20_000, 50_000, 2_000_000
PRIOR, Z, LEAST, DRIFT, AGAINST, PREFIXES = 50.0, 1.64, 1.0, 0.35, 2.0, range(3, 9)
#: A passage is significant if fewer than this many of its score are expected by chance in a text of that length.
E_MOST = 1.0
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")


def features(word: str) -> list[str]:
    """The word itself and its proper prefixes."""
    return [f"={word}", *(word[:k] for k in PREFIXES if k <= len(word))]


def segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text whose words score -drift but at the given positions; linear time: every segment points to the nearest earlier one that
    begins at a smaller sum, so no walk passes a segment twice."""
    found: list[tuple] = []  # first, last, sum before it, sum through it, the nearest earlier one with a smaller sum before it
    total, at = 0.0, -1
    for p, s in zip(positions, scores):
        total -= drift * (p - at - 1)
        at = p
        if s <= 0:
            total += s
            continue
        first, left, right = p, total, total + s
        total = right
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((first, p, left, right, j))
                break
            k, first, left, j = j, found[j][0], found[j][2], found[j][4]
            del found[k:]  # they make one segment with all between them
    return [(a, b, r - left) for a, b, left, r, _ in found]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The labelled documents to learn from: text, toxic. At most about `rows` of them, by a hash of doc_id."""
    lab = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    lab = lab.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(1, n))))
    return docs.select("doc_id", "text").join(F.broadcast(lab) if min(n, rows) <= LABELS_BROADCAST else lab, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def log_odds(sample: DataFrame, size: int = MODEL_SIZE) -> dict[str, float]:
    """feature -> what it adds to a word's score; at most `size` of them."""

    def count(batches):
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                found = set(chain.from_iterable(map(features, set(_WORD.findall((text or "").lower())))))
                (toxic if y else clean).update(found)
                n[0 if y else 1] += 1
        names = [*toxic.keys() | clean.keys()]
        yield pa.RecordBatch.from_arrays([pa.array(["", *names]), pa.array([n[0], *(toxic[x] for x in names)], pa.int64()), pa.array([n[1], *(clean[x] for x in names)], pa.int64())], names=["feature", "toxic", "clean"])

    counts = stored(sample.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "tox-counts")
    n = counts.filter("feature = ''").first()
    if n is None or not n.toxic or not n.clean:
        return {}
    n1, n2 = float(n.toxic), float(n.clean)
    share = (F.col("toxic") + F.col("clean")) / (n1 + n2)
    a, b = F.col("toxic") + PRIOR * share, F.col("clean") + PRIOR * share
    delta = F.log(a / (n1 + PRIOR - a + 1e-9)) - F.log(b / (n2 + PRIOR - b + 1e-9))
    error = F.sqrt(1 / a + 1 / b)
    # what is left of the log-odds, on either side of nought, after Z errors
    signed = counts.filter("feature <> ''").withColumns({"z": delta / error, "odds": F.when(delta > 0, delta - Z * error).otherwise(delta + Z * error)})
    toxic = signed.filter((F.col("toxic") >= 3) & (F.col("odds") >= LEAST)).orderBy(F.desc("z"), "feature").limit(size)
    clean = signed.filter((F.col("clean") >= 3) & (F.col("odds") <= -LEAST)).orderBy("z", "feature").limit(size)
    return {r.feature: r.odds for r in toxic.unionByName(clean).select("feature", "odds").collect()}


class Scorer:
    """Word scores with a bounded memory of the words seen."""

    def __init__(self, model: dict[str, float], drift: float = DRIFT) -> None:
        self.model, self.drift, self.seen = model, drift, {}

    def of(self, word: str) -> float:
        odds = [self.model[f] for f in features(word) if f in self.model]
        s = max(odds, default=0.0)
        if s <= 0:  # only evidence against: the strongest, bounded, where it is more than a neutral word's
            s = max(min(odds, default=0.0), -AGAINST)
            s = s if s < -self.drift else 0.0
        if len(self.seen) > 300_000:
            self.seen.clear()
        self.seen[word] = s
        return s

    def text(self, text: str | None) -> tuple[int, list[int], list[float]]:
        """Number of words, and where and how much words score."""
        words = _WORD.findall((text or "").lower())
        get = self.seen.get
        at, scores = [], []
        for i, s in enumerate(map(get, words)):
            if s is None:
                s = self.of(words[i])
            if s:
                at.append(i)
                scores.append(s)
        return len(words), at, scores


def evidence(n: int, found: list, tail: tuple[float, float]) -> float:
    """The sum of -ln E of the significant segments."""
    lam, log_k = tail
    return sum(max(0.0, math.log(E_MOST) + lam * s - log_k - math.log(max(n, 1))) for *_, s in found)


def calibrate(sample: DataFrame, model: dict[str, float]) -> dict:
    """lambda, ln K and the logistic curve, from sums over the training rows: word scores and segment scores in bins, then evidence in bins."""

    def scan(batches):
        scorer, bins = Scorer(model), Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                n, at, scores = scorer.text(text)
                bins["n", y, 0] += n
                bins["docs", y, 0] += 1
                for s in scores:
                    bins["word", y, round(s * 20)] += 1
                for *_, s in segments(at, scores, DRIFT):
                    bins["segment", y, min(2000, int(s * 5))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in bins]), pa.array([k[1] for k in bins], pa.int32()), pa.array([k[2] for k in bins], pa.int32()), pa.array(bins.values(), pa.int64())], names=["kind", "toxic", "bin", "n"])

    def totals(df):
        return {(r.kind, r.toxic, r.bin): r.n for r in df.groupBy("kind", "toxic", "bin").agg(F.sum("n").alias("n")).collect()}  # a few thousand bins at most

    got = totals(sample.mapInArrow(scan, "kind string, toxic int, bin int, n long"))
    words = max(1, got.get(("n", 0, 0), 0))
    scored = [(b / 20, v / words) for (kind, y, b), v in got.items() if kind == "word" and y == 0]
    neutral = 1 - sum(p for _, p in scored)

    def moment(lam: float) -> float:
        return neutral * math.exp(-lam * DRIFT) + sum(p * math.exp(min(500, lam * s)) for s, p in scored) - 1

    low, high = 1e-3, 1.0
    while moment(high) < 0 and high < 4:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 0 else (low, mid)
    lam = max(0.05, low)
    # segments of non-toxic documents by score: the largest K that any threshold asks for, from thresholds with enough of them
    own = sorted(((b / 5, v) for (kind, y, b), v in got.items() if kind == "segment" and y == 0), reverse=True)
    over, log_k = 0, math.log(1 / words)
    for s, v in own:
        over += v
        if over >= 20:
            log_k = max(log_k, math.log(over / words) + lam * s)
    tail = (lam, log_k)

    def weigh(batches):
        scorer, bins = Scorer(model), Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                n, at, scores = scorer.text(text)
                bins["evidence", y, min(4000, math.ceil(evidence(n, segments(at, scores, DRIFT), tail) * 10))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in bins]), pa.array([k[1] for k in bins], pa.int32()), pa.array([k[2] for k in bins], pa.int32()), pa.array(bins.values(), pa.int64())], names=["kind", "toxic", "bin", "n"])

    got = totals(sample.mapInArrow(weigh, "kind string, toxic int, bin int, n long"))
    x = np.log1p(np.array([b / 10 for _, _, b in got], float))
    y, w = np.array([y for _, y, _ in got], float), np.array([*got.values()], float)
    base = (w @ y + 0.5) / (w.sum() + 1)
    a, c = math.log(base / (1 - base)), 0.0
    for _ in range(50):  # Newton steps with a weak ridge
        p = 1 / (1 + np.exp(-(a + c * x)))
        g = np.array([w @ (y - p), w @ ((y - p) * x) - 1e-2 * c])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 1e-6, v @ x], [v @ x, v @ (x * x) + 1e-2]])
        step = np.linalg.solve(h, g)
        a, c = a + float(np.clip(step[0], -2, 2)), c + float(np.clip(step[1], -2, 2))
    return {"tail": tail, "curve": (a, max(0.0, c))}


def scored(docs: DataFrame, model: dict[str, float], fit: dict, with_passages: bool = False) -> DataFrame:
    """docs' doc_id with score, n_passages, evidence and (with_passages) the passages: first and last word, score, E."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, fit))  # MODEL_SIZE features at most
    kind = "doc_id long, score double, n_passages int, evidence double, passages array<struct<first_word:int,last_word:int,score:double,e_value:double>>"
    passage = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def score(batches):
        model, fit = shared.value
        scorer, (lam, log_k), (a, c) = Scorer(model), fit["tail"], fit["curve"]
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                n, at, scores = scorer.text(text)
                found = segments(at, scores, DRIFT)
                sure = [(f, last, s, math.exp(log_k + math.log(n) - lam * s)) for f, last, s in found if math.log(E_MOST) + lam * s - log_k - math.log(n) > 0]
                e = evidence(n, found, (lam, log_k))
                rows.append((1 / (1 + math.exp(-(a + c * math.log1p(e)))), len(sure), e, [dict(zip(("first_word", "last_word", "score", "e_value"), s)) for s in sure] if with_passages else None))
            cols = [*zip(*rows)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], passage)], names=["doc_id", "score", "n_passages", "evidence", "passages"])

    return docs.select("doc_id", "text").mapInArrow(score, kind)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict[str, float], dict]:
    sample = stored(train(docs, labels, rows), "tox-sample")  # bounded by `rows`
    model = log_odds(sample)
    return model, calibrate(sample, model)


def bucket(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))
