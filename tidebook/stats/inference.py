"""Inference on feature windows: accuracies, cluster-robust errors, bootstraps, block lengths, multiple testing.

Sums over windows are grouped aggregates; what comes to the driver is a number for each cluster or session. Bootstrap replications are dealt out to tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.functions.draws import drawn

#: Normal quantiles for a 95 % interval and for 80 % power.
Z_ALPHA, Z_POWER = 1.959963985, 0.841621234


def over(a: Column, b: Column) -> Column:
    """a / b of doubles as SQL has it: infinite, or not a number, over nought."""
    a = a.cast("double")
    zero = F.when(a > 0, F.when(F.isnan(a), a).otherwise(math.inf)).when(a < 0, -math.inf).when(a == 0, math.nan)
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b.cast("double")))


def hit(feature: str) -> Column:
    """Whether the feature has the label's sign; a zero feature misses."""
    return (F.signum(feature) == F.signum("label_ticks")).cast("double")


def accuracies(features: DataFrame, names: list[str]) -> DataFrame:
    """feature, n, accuracy over windows that moved, the value per window over all, and the accuracy that chance pairing has."""
    long = features.select("label_ticks", "label_halfspreads", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("f")) for n in names])).alias("x")).select("label_ticks", "label_halfspreads", "x.*")
    moved = F.col("label_ticks") != 0
    share = lambda c: F.avg(F.when(moved, c.cast("double")))
    null = share(F.col("f") > 0) * share(F.col("label_ticks") > 0) + share(F.col("f") < 0) * share(F.col("label_ticks") < 0)
    return long.groupBy("feature").agg(F.sum(moved.cast("long")).alias("n"), F.round(share(F.signum("f") == F.signum("label_ticks")), 6).alias("accuracy"), F.round(F.avg(F.signum("f") * F.col("label_halfspreads")), 6).alias("value"), F.round(null, 6).alias("null_accuracy"))


def clustered(rows: DataFrame, value: Column, cluster: list[str]) -> DataFrame:
    """n, clusters, mean and its cluster-robust error, corrected for few clusters (null: under two)."""
    v = rows.select(*cluster, value.alias("v"))
    per = v.groupBy(*cluster).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"))
    one = per.agg(F.sum("s").alias("s"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("g"))
    d = per.crossJoin(F.broadcast(one.select((F.col("s") / F.col("n")).alias("m"), "n", "g")))  # one row on the right
    q = d.groupBy("m", "n", "g").agg(F.sum((F.col("s") - F.col("c") * F.col("m")) ** 2).alias("q"))
    return q.select("n", F.col("g").alias("clusters"), F.round("m", 6).alias("mean"), F.round(F.when(F.col("g") > 1, F.sqrt(F.col("g") / (F.col("g") - 1) * F.col("q")) / F.col("n")), 6).alias("se"))


def r_squared(rows: DataFrame, x: str, y: str) -> DataFrame:
    """The slope without intercept, and the squared-error reduction against the mean as a share (no number where no y differs from the others)."""
    s = rows.agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("sy"), F.count(F.lit(1)).alias("n"))
    beta = over(F.col("xy"), F.col("xx"))
    b = F.col("yy") - over(F.col("sy") * F.col("sy"), F.col("n"))
    e = F.col("yy") - 2 * beta * F.col("xy") + beta * beta * F.col("xx")
    return s.select("n", F.round(beta, 6).alias("beta"), F.round(over(b - e, b), 6).alias("r2"))


def holm(p: DataFrame, family: int) -> DataFrame:
    """p: name, p. Step-down adjusted values over a family of fixed size."""
    w = Window.orderBy("p", "name")  # a handful of tests
    a = p.withColumn("k", F.row_number().over(w)).withColumn("x", F.col("p") * (family - F.col("k") + 1))
    return a.select("name", "p", F.round(F.least(F.lit(1.0), F.max("x").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))), 9).alias("adjusted"))


def one_sided_p(point: float, se: float, null: float) -> float:
    return 0.5 * math.erfc((point - null) / se / math.sqrt(2)) if se > 0 else math.nan


def verdict(point: float, low: float, high: float, bar: float) -> str:
    return "HOLDS" if point > bar and low > 0.5 else "FAILS" if high < bar else "INCONCLUSIVE"


def bars(mean_move: float) -> tuple[float, float]:
    """The accuracy and the R2 that are worth a twentieth of a half-spread a window."""
    return 0.5 + 0.05 / mean_move, math.sin(math.pi * 0.05 / mean_move) ** 2


def detectable(se: float, have: int, planned: int) -> float:
    """The least effect found with 80 % power at the planned number of independent units."""
    return (Z_ALPHA + Z_POWER) * se * math.sqrt(have / planned) if planned > 0 and have > 0 else math.nan


def block_length(x: np.ndarray) -> float:
    """Politis and White's automatic block length of the stationary bootstrap (2004, corrected 2009): flat-top lag window, bandwidth by the first run of insignificant autocorrelations."""
    n = len(x)
    if n < 4 or np.ptp(x) == 0:
        return 1.0
    d = x - x.mean()
    run, most = max(5, int(math.sqrt(math.log10(n)))), min(n - 1, int(math.ceil(math.sqrt(n))) + max(5, int(math.sqrt(math.log10(n)))))
    auto = np.array([d[: n - k] @ d[k:] / n for k in range(most + 1)])
    small = np.abs(auto[1:] / auto[0]) < 2 * math.sqrt(math.log10(n) / n)
    m = next((k for k in range(len(small)) if small[k : k + run].all() and len(small[k : k + run]) == run), None)
    m = most if m is None else max(1, m)
    band = min(2 * m, most)
    k = np.arange(-band, band + 1)
    r = auto[np.abs(k)] * np.clip(2 * (1 - np.abs(k) / band), 0, 1)
    g, s = float(np.abs(k) @ r), float(r.sum())
    return float(min(max(1.0, (2 * g * g / (2 * s * s)) ** (1 / 3) * n ** (1 / 3)), math.ceil(min(3 * math.sqrt(n), n / 3)))) if s else 1.0


def stationary_bootstrap_se(spark: SparkSession, sessions: list[np.ndarray], block: float, replications: int, seed: int = 20191030, tasks: int = 16) -> float:
    """The error of the pooled mean of the sessions' series; blocks of geometric length wrap around within their session. Each replication has a stream of its own."""
    sums = [np.concatenate([[0.0], np.cumsum(np.concatenate([x, x]))]) for x in sessions if len(x)]
    shared = spark.sparkContext.broadcast(sums)  # two numbers for each window of the sessions given

    def draw(batches):
        for b in batches:
            out = []
            for r in b["id"]:
                rng, total, size = np.random.default_rng([seed, int(r)]), 0.0, 0
                for s in shared.value:
                    n = len(s) // 2
                    left = n
                    while left > 0:
                        lens = np.minimum(rng.geometric(1 / max(block, 1.0), max(1, int(left / block) + 1)), n)
                        lens = lens[: int(np.searchsorted(np.cumsum(lens), left)) + 1]
                        lens[-1] -= max(0, int(lens.sum()) - left)
                        at = rng.integers(0, n, len(lens))
                        total += float((s[at + lens] - s[at]).sum())
                        left -= int(lens.sum())
                    size += n
                out.append(total / size)
            yield pd.DataFrame({"mean": out})

    return float(spark.range(0, replications, 1, tasks).mapInPandas(draw, "mean double").agg(F.stddev_samp("mean")).first()[0])


# --- resampling whole clusters, by draws that depend on seed, replication and place alone -------------------


def resampled(clusters: DataFrame, key: str, sums: list[str], replications: int, seed: int) -> DataFrame:
    """clusters: a row for each cluster (and, with further columns, for each group within it). rep, further columns, and each sum over as many clusters as there are, drawn with
    replacement. The same clusters are drawn for all groups, so that differences between groups are paired. Replications x clusters rows; clusters are sessions or symbols."""
    names = clusters.select(key).distinct()
    numbered = names.withColumn("_no", F.row_number().over(Window.orderBy(key)) - 1)
    size = names.agg(F.count(F.lit(1)).alias("_g"))
    draws = clusters.sparkSession.range(replications).withColumnRenamed("id", "rep").crossJoin(F.broadcast(size)).withColumn("_j", F.explode(F.when(F.col("_g") > 0, F.sequence(F.lit(0).cast("long"), F.col("_g") - 1))))
    draws = draws.select("rep", (drawn(F.lit(seed), F.col("rep"), F.col("_j")) % F.col("_g")).alias("_no"))
    groups = [c for c in clusters.columns if c not in (key, *sums)]
    return draws.join(F.broadcast(numbered), "_no").join(clusters, key).groupBy("rep", *groups).agg(*[F.sum(c).alias(c) for c in sums])


def estimate(rows: DataFrame, value: Column, cluster: str, replications: int = 200, seed: int = 7) -> DataFrame:
    """n, clusters, mean, the cluster-robust and the bootstrap error, the larger of them, and the interval it gives: one row, also of no rows (nulls) and of one cluster (no number)."""
    per = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    boot = resampled(per, cluster, ["s", "c"], replications, seed).agg(F.stddev_samp(F.col("s") / F.col("c")).alias("boot"))
    one = per.agg(F.sum("s").alias("s"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("g")).select("n", "g", over(F.col("s"), F.col("n")).alias("m"))
    q = per.crossJoin(F.broadcast(one)).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("g"), F.max("m").alias("m"), F.sum((F.col("s") - F.col("c") * F.col("m")) ** 2).alias("q"))  # one row on the right
    e = q.crossJoin(F.broadcast(boot)).withColumn("robust", F.sqrt(over(F.col("g"), F.col("g") - 1) * F.col("q")) / F.col("n")).withColumn("se", F.greatest("robust", "boot"))
    return e.select("n", F.col("g").alias("clusters"), F.round("m", 6).alias("mean"), F.round("robust", 6).alias("cluster_se"), F.round("boot", 6).alias("bootstrap_se"), F.round("se", 6).alias("se"), F.round(F.col("m") - Z_ALPHA * F.col("se"), 6).alias("low"), F.round(F.col("m") + Z_ALPHA * F.col("se"), 6).alias("high"))


def _products(rows: DataFrame, x: str, y: str, cluster: str) -> DataFrame:
    return rows.groupBy(cluster).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("sy"), F.count(F.lit(1)).alias("n"))


def _r2() -> Column:
    beta = F.try_divide("xy", "xx")
    base = F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    return 1 - F.try_divide(F.col("yy") - 2 * beta * F.col("xy") + beta * beta * F.col("xx"), base)


def r_squared_errors(rows: DataFrame, x: str, y: str, cluster: str, replications: int = 200, seed: int = 11) -> DataFrame:
    """R2 with its bootstrap error (both of its sums are drawn anew, together) and its error by the clusters' influence on the ratio."""
    per = _products(rows, x, y, cluster)
    boot = resampled(per, cluster, ["xy", "xx", "yy", "sy", "n"], replications, seed).agg(F.stddev_samp(_r2()).alias("boot"))
    one = per.agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy", "sy", "n")]).select(F.col("n").alias("_n"), "xy", "xx", "yy", over(F.col("xy"), F.col("xx")).alias("beta"), over(F.col("sy"), F.col("n")).alias("m"), (F.col("yy") - over(F.col("sy") * F.col("sy"), F.col("n"))).alias("base"))
    one = one.select("_n", "beta", "m", "base", (1 - over(F.col("yy") - 2 * F.col("beta") * F.col("xy") + F.col("beta") * F.col("beta") * F.col("xx"), F.col("base"))).alias("r2"))
    d = per.crossJoin(F.broadcast(one))  # one row on the right
    left = F.col("yy") - 2 * F.col("beta") * F.col("xy") + F.col("beta") * F.col("beta") * F.col("xx")
    own = F.col("yy") - 2 * F.col("m") * F.col("sy") + F.col("n") * F.col("m") * F.col("m")
    q = d.withColumn("psi", over(own * (1 - F.col("r2")) - left, F.col("base"))).agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("g"), F.max("r2").alias("r2"), F.sum(F.col("psi") * F.col("psi")).alias("q")).crossJoin(F.broadcast(boot))
    return q.select(F.col("_n").alias("n"), F.col("g").alias("clusters"), F.round("r2", 6).alias("r2"), F.round("boot", 6).alias("bootstrap_se"), F.round(F.sqrt(over(F.col("g"), F.col("g") - 1) * F.col("q")), 6).alias("influence_se"))


def errors_by_feature(features: DataFrame, names: list[str], cluster: str) -> DataFrame:
    """feature, n, clusters, accuracy, se (cluster-robust) over windows that moved."""
    long = features.filter("label_ticks <> 0").select(cluster, "label_ticks", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("f")) for n in names])).alias("x")).select(cluster, "x.feature", (F.signum("x.f") == F.signum("label_ticks")).cast("double").alias("h"))
    per = long.groupBy("feature", cluster).agg(F.sum("h").alias("s"), F.count(F.lit(1)).alias("c"))
    of = Window.partitionBy("feature")
    d = per.withColumns({"n": F.sum("c").over(of), "g": F.count(F.lit(1)).over(of)}).withColumn("m", F.sum("s").over(of) / F.col("n"))
    q = d.groupBy("feature", "n", "g", "m").agg(F.sum((F.col("s") - F.col("c") * F.col("m")) ** 2).alias("q"))
    return q.select("feature", "n", F.col("g").alias("clusters"), F.col("m").alias("accuracy"), F.when(F.col("g") > 1, F.sqrt(F.col("g") / (F.col("g") - 1) * F.col("q")) / F.col("n")).alias("se"))


def power_table(errors: DataFrame, planned: list[int]) -> DataFrame:
    """For each feature and planned number of clusters: the least effect found with 80 % power."""
    return errors.withColumn("planned", F.explode(F.array(*map(F.lit, planned)))).select("feature", "planned", F.round((Z_ALPHA + Z_POWER) * F.col("se") * F.sqrt(F.col("clusters") / F.col("planned")), 6).alias("detectable"))


def selection(errors: DataFrame, mean_move: DataFrame, least_clusters: int) -> DataFrame:
    """Each feature's detectable effect against the bar that is worth trading (bars()), and which one is chosen: the least ratio, ties by name; none where there are fewer clusters than asked for."""
    d = errors.crossJoin(F.broadcast(mean_move))  # mean_move: m, one row
    ratio = (Z_ALPHA + Z_POWER) * F.col("se") / (0.05 / F.col("m"))
    d = d.withColumn("ratio", ratio).withColumn("k", F.row_number().over(Window.orderBy("ratio", "feature")))  # a row for each feature
    return d.select("feature", "clusters", F.round("ratio", 6).alias("ratio"), ((F.col("k") == 1) & (F.col("clusters") >= least_clusters)).alias("chosen"))


def permuted_accuracies(features: DataFrame, names: list[str], replications: int, seed: int = 3) -> DataFrame:
    """feature, accuracy, null_mean, p: labels are dealt anew within each symbol, in the order of draws, replications times; p counts the replications that do as well."""
    moved = features.filter("label_ticks <> 0").select("locate", "wid", "label_ticks", *names)
    rows = moved.crossJoin(features.sparkSession.range(replications).withColumnRenamed("id", "rep"))  # replications times the rows, by definition
    here = Window.partitionBy("rep", "locate").orderBy("wid")
    there = Window.partitionBy("rep", "locate").orderBy(drawn(F.lit(seed), F.col("rep"), F.col("wid")), "wid")
    rows = rows.withColumns({"_at": F.row_number().over(here), "_to": F.row_number().over(there)})
    dealt = rows.select("rep", "locate", F.col("_to").alias("_at"), F.col("label_ticks").alias("other"))
    long = rows.join(dealt, ["rep", "locate", "_at"]).select("rep", "label_ticks", "other", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("f")) for n in names])).alias("x"))
    per = long.groupBy("x.feature", "rep").agg(F.avg((F.signum("x.f") == F.signum("label_ticks")).cast("double")).alias("own"), F.avg((F.signum("x.f") == F.signum("other")).cast("double")).alias("null"))
    return per.groupBy("feature").agg(F.round(F.first("own"), 6).alias("accuracy"), F.round(F.avg("null"), 6).alias("null_mean"), ((1 + F.sum((F.col("null") >= F.col("own")).cast("long"))) / (1 + F.count(F.lit(1)))).alias("p"))


def adjusted_curve(cells: list[tuple[int, int, int, int]]) -> list[tuple[int, float]]:
    """cells: (bin, symbol, placed, filled). Each bin's fill rate with the symbols' own levels taken out: least squares weighted by placed on dummies of bins and symbols, the
    symbols' effects weighted to nought. At most bins x symbols cells, both bounded."""
    bins, symbols = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    w = np.array([c[2] for c in cells], float)
    y = np.array([c[3] / c[2] for c in cells])
    x = np.zeros((len(cells), len(bins) + len(symbols)))
    for i, (b, s, *_) in enumerate(cells):
        x[i, bins.index(b)] = x[i, len(bins) + symbols.index(s)] = 1
    share = np.array([sum(c[2] for c in cells if c[1] == s) for s in symbols], float)
    beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    level = float(beta[len(bins) :] @ share / share.sum())
    return [(b, float(v + level)) for b, v in zip(bins, beta)]
