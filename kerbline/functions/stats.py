"""Statistics as expressions and small plans; resampling and fits as grouped kernels."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

Z95 = 1.959964


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """(lo, hi) of a share, four places, null without rows."""
    p, den = k / n, 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return F.when(n > 0, F.struct(F.round(F.greatest(F.lit(0.0), mid - half), 4).alias("lo"), F.round(F.least(F.lit(1.0), mid + half), 4).alias("hi")))


def edge_bin(x: Column, edges: list[float]) -> Column:
    """Number of edges that a value reaches."""
    out = F.lit(0)
    for i, e in enumerate(edges, 1):
        out = F.when(x >= e, i).otherwise(out)
    return out


def index_edges(df: DataFrame, column: str, n: int) -> DataFrame:
    """One row: values at places floor(count * j / n) of the sorted column (A27). Places are ranks in a
    table of distinct values in buckets of magnitude: bucket counts' running sum gives offsets, and only a bucket's
    distinct values are sorted together."""
    s = df.select(F.col(column).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    s = s.withColumn("b", magnitude(F.col("v")))
    per = s.groupBy("b").agg(F.sum("c").alias("t"))
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct magnitude bucket
    per = per.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0))).withColumn("n", F.sum("t").over(Window.partitionBy()))
    inner = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    r = s.join(per, "b").withColumn("to", F.col("before") + F.sum("c").over(inner)).withColumn("from", F.col("to") - F.col("c"))
    at = F.array(*[F.struct(F.lit(j).alias("j"), F.floor(F.col("n") * j / n).alias("i")) for j in range(1, n)])
    hit = r.select("v", "from", "to", F.explode(at).alias("a")).where("a.i >= `from` and a.i < `to`")
    return hit.agg(F.transform(F.array_sort(F.collect_list(F.struct("a.j", "v"))), lambda x: x["v"]).alias("edges"))


def confusion(truth: Column, pred: Column) -> list[Column]:
    c = lambda x, n: F.count_if(x).alias(n)
    return [c(truth & pred, "tp"), c(~truth & pred, "fp"), c(truth & ~pred, "fn"), c(~truth & ~pred, "tn")]


def div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(0.0)


def binary(df: DataFrame) -> DataFrame:
    """precision, recall, specificity, f1, mcc and balanced accuracy beside tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r, s = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fp)
    return df.withColumns({"precision": p, "recall": r, "specificity": s, "f1": div(2 * p * r, p + r), "mcc": mcc(tp, fp, fn, tn), "balanced_accuracy": F.when((tp + fn > 0) & (tn + fp > 0), (r + s) / 2)})


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def by_score(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Per distinct score (p positives, n negatives): what the ranking statistics need, combined before the shuffle."""
    return df.groupBy(F.col(score).alias("s")).agg(F.count_if(truth).alias("p"), F.count_if(~F.col(truth)).alias("n"))


def auroc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Area under the ROC curve, ties one half (X3, W18): negatives below plus half of the equal ones."""
    d = running(by_score(df, score, truth), "s", {"n": "below"}, own=False)
    total = d.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return total.select((F.col("u") / F.when(F.col("np") * F.col("nn") > 0, F.col("np") * F.col("nn"))).alias("auroc"), "np", "nn")


def hanley_mcneil(a: Column, p: Column, n: Column) -> Column:
    """Standard error of an AUROC."""
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    return F.sqrt((a * (1 - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)) / (p * n))


def _running(df: DataFrame, score: str, truth: str) -> DataFrame:
    return running(by_score(df, score, truth), "s", {"p": "tp", "n": "fp"}, descending=True)


def average_precision(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Step-wise area under precision and recall, ties as one step."""
    d = _running(df, score, truth)
    return d.agg((F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")).alias("average_precision"))


def best_threshold(df: DataFrame, score: str, truth: str) -> DataFrame:
    """(threshold, mcc): the observed score that does best, ties to the higher."""
    d = _running(df, score, truth).crossJoin(F.broadcast(by_score(df, score, truth).agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))))
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    d = d.withColumn("mcc", mcc(tp, fp, F.col("np") - tp, F.col("nn") - fp))
    best = F.max(F.struct("mcc", "s"))
    return d.agg(best.alias("b")).select(F.col("b.s").alias("threshold"), "b.mcc")


def cut_at_recall(df: DataFrame, score: str, truth: str, recall: float) -> DataFrame:
    """One row `cut`: the highest score at or above which that share of the positives lies (Q16)."""
    d = _running(df.where(truth), score, truth)
    need = d.agg(F.ceil(F.lit(recall) * F.sum("p")).alias("need"))
    return d.crossJoin(F.broadcast(need)).where("tp >= need").agg(F.max("s").alias("cut"))


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p-value of discordant counts (X10): each binomial term from the one before, in logarithms."""
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    first = -n * math.log(2)
    zero = F.struct(first.alias("term"), F.exp(first).alias("tail"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (a["tail"] + F.exp(term)).alias("tail"))

    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1), k), zero, step)["tail"]).otherwise(F.exp(first))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def calibration_error(df: DataFrame, prob: str, truth: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins."""
    b = df.groupBy(F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("conf"), F.avg(F.col(truth).cast("double")).alias("acc"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two categorical columns, from the cross table."""
    t = df.groupBy(a, b).agg(F.count("*").alias("n"))
    n = t.agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    ma, mb = t.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("x")), t.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("y"))
    chance = ma.join(mb, "c").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("e"))
    po, pe = F.col("same") / F.col("t"), F.col("e") / (F.col("t").cast("double") * F.col("t"))
    return n.crossJoin(chance).select(po.alias("agreement"), pe.alias("chance"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def weighted_kappa(df: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """Quadratic weighted kappa of classes 0..k-1 (X15): sums and products only, no cross of rows."""
    d = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    s = d.agg(F.count("*").alias("n"), F.sum(F.pow(F.col("a") - F.col("b"), 2)).alias("o"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.expr("a * a")).alias("saa"), F.sum(F.expr("b * b")).alias("sbb"))
    e = F.col("saa") + F.col("sbb") - 2 * F.col("sa") * F.col("sb") / F.col("n")
    return s.select(F.when(e > 0, 1 - F.col("o") / e).alias("kappa"))


def errors(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean absolute error, bias, RMSE and limits of agreement."""
    d = F.col(x) - F.col(y)
    s = df.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.stddev_samp(d).alias("sd"))
    return s.withColumn("lower", F.col("bias") - 1.96 * F.col("sd")).withColumn("upper", F.col("bias") + 1.96 * F.col("sd"))


def magnitude(c: Column) -> Column:
    """A bucket that grows with the value: 64 to a factor of e, at most some 93,000 for all doubles."""
    return F.floor(F.signum(c) * F.log1p(F.abs(c) * 1e6) * 64)


def running(df: DataFrame, value: str, sums: dict[str, str], descending: bool = False, own: bool = True) -> DataFrame:
    """df, one row per value, with running sums {column: name} in the order of the value, with or without the row's own.

    Sums run within buckets of magnitude and are shifted by the totals of the buckets before, a bounded table that is
    broadcast; no task sorts all values.
    """
    d = df.withColumn("__b", magnitude(F.col(value)))
    order = (lambda c: F.desc(c)) if descending else F.col
    total = d.groupBy("__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.orderBy(order("__b")).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("__b", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums])
    inner = Window.partitionBy("__b").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    d = d.join(F.broadcast(total), "__b").withColumns({n: F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"__o_{c}") for c, n in sums.items()})
    return d.drop("__b", *[f"__o_{c}" for c in sums])


def ordinal_rank(df: DataFrame, column: str, name: str, *ties: str) -> DataFrame:
    """df with the 1-based rank of a number among all rows, ties by the columns named.

    Rows are numbered within buckets of magnitude and shifted by the counts of the buckets below, so one task sorts
    one bucket and not the table; the table of buckets has a bound, so it is broadcast. A value that very many rows
    share stays in one bucket, as its ties must be put in order.
    """
    d = df.withColumn("__b", magnitude(F.col(column)))
    per = d.groupBy("__b").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__below"))
    n = F.row_number().over(Window.partitionBy("__b").orderBy(column, *ties))
    return d.join(F.broadcast(per), "__b").withColumn(name, n + F.col("__below")).drop("__b", "__below")


def spearman(df: DataFrame, x: str, y: str, *ties: str) -> DataFrame:
    """Correlation of ordinal ranks, ties by the columns named."""
    d = ordinal_rank(ordinal_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "__x", *ties), y, "__y", *ties)
    return d.agg(F.corr("__x", "__y").alias("rho"))


def threshold_table(df: DataFrame, score: str, truth: str, cuts: list[float]) -> DataFrame:
    """accepted, wrong through, caught and load per threshold (X18). Thresholds are a short literal list."""
    ok = F.col(truth)
    t = df.select(score, truth, F.explode(F.array(*map(F.lit, cuts))).alias("t"))
    g = t.groupBy("t").agg(F.count_if(F.col(score) >= F.col("t")).alias("accepted"), F.count_if((F.col(score) >= F.col("t")) & ~ok).alias("wrong_through"), F.count_if((F.col(score) < F.col("t")) & ~ok).alias("caught"), F.count_if((F.col(score) < F.col("t")) & ok).alias("wasted"), F.count("*").alias("n"))
    return g.withColumn("load", (F.col("n") - F.col("accepted")) / F.col("n"))


def summary(column: str) -> list[Column]:
    """n, mean, population sd, min, p50, p90, max."""
    return [F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.min(column).alias("min"), F.percentile(column, 0.5).alias("p50"), F.percentile(column, 0.9).alias("p90"), F.max(column).alias("max")]


def ks_distance(df: DataFrame, value: str, side: str) -> DataFrame:
    """Largest gap between two samples' distribution functions; `side` is true for one of them."""
    d = df.groupBy(F.col(value).alias("v")).agg(F.count_if(side).alias("a"), F.count_if(~F.col(side)).alias("b"))
    tot = d.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    c = running(d, "v", {"a": "ca", "b": "cb"}).crossJoin(F.broadcast(tot))
    return c.agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("d"))


# ---- resampling and fits: sequential draws of a seeded generator, so one task per group


#: Clusters that one task resamples.
CLUSTERS = 20_000


def resampled(df: DataFrame, cluster: str, sums: list[str], draws: int, seed: int, by: str | None) -> DataFrame:
    """(group, __draw, sums): column sums of each draw of whole clusters, draw -1 the table itself.

    Clusters are summed first, then dealt into buckets of about CLUSTERS. How many of a draw's clusters fall into each
    bucket is one seeded multinomial that every task repeats; each task draws its bucket's share and sends one sum per
    draw, so neither clusters nor items gather in one task.
    """
    key = F.col(by).cast("string") if by else F.lit("")
    per = df.groupBy(key.alias("group"), cluster).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in sums])
    n = per.groupBy("group").agg(F.ceil(F.count("*") / CLUSTERS).alias("__buckets"))
    per = per.join(n, "group").withColumn("__bucket", F.pmod(F.xxhash64(cluster), F.col("__buckets")))
    sizes = per.groupBy("group", "__bucket").agg(F.count("*").alias("__n")).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("__bucket", "__n"))).alias("__sizes"))
    per = per.join(sizes.select("group", F.col("__sizes.__bucket").alias("__at"), F.col("__sizes.__n").alias("__n")), "group")

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(cluster)
        rows, n = pdf[sums].to_numpy(), np.asarray(pdf["__n"].iloc[0])
        at = int(np.flatnonzero(np.asarray(pdf["__at"].iloc[0]) == pdf["__bucket"].iloc[0])[0])
        share = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=draws)[:, at]
        rng, out, step = np.random.default_rng([seed, at]), [rows.sum(axis=0)[None, :]], max(1, 4_000_000 // len(rows))
        for i in range(0, draws, step):
            out.append(rng.multinomial(share[i : i + step], np.full(len(rows), 1 / len(rows))) @ rows)
        return pd.DataFrame({"group": pdf["group"].iloc[0], "__draw": np.arange(-1, draws), **dict(zip(sums, np.concatenate(out).T, strict=True))})

    part = per.groupBy("group", "__bucket").applyInPandas(resample, "group string, __draw long, " + ", ".join(f"{c} double" for c in sums))
    return part.groupBy("group", "__draw").agg(*[F.sum(c).alias(c) for c in sums])


def bootstrap(df: DataFrame, cluster: str, sums: list[str], stat: Callable[[dict[str, float]], float], draws: int = 2000, seed: int = 0, by: str | None = None) -> DataFrame:
    """Percentile interval of a statistic of column sums with whole clusters resampled."""

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        each = {int(d): stat(dict(zip(sums, v, strict=True))) for d, *v in pdf[["__draw", *sums]].itertuples(index=False)}
        vals = sorted(v for d, v in each.items() if d >= 0 and v == v)
        at = lambda q: vals[int(q * (len(vals) - 1))] if vals else math.nan
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "point": [each[-1]], "lo": [at(0.025)], "hi": [at(0.975)], "draws": [len(vals)]})

    return resampled(df, cluster, sums, draws, seed, by).groupBy("group").applyInPandas(interval, "group string, point double, lo double, hi double, draws long")


def paired_bootstrap(df: DataFrame, cluster: str, sums: list[str], one: Callable[[dict[str, float]], float], two: Callable[[dict[str, float]], float], draws: int = 2000, seed: int = 0, by: str | None = None) -> DataFrame:
    """(group, delta, lo, hi, p, draws): two less one on the same resamples of whole clusters (X9). p is twice the
    share of draws on the other side of zero, 1 at most; draws in which either is undefined don't count."""

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(d), dict(zip(sums, v, strict=True))) for d, *v in pdf[["__draw", *sums]].itertuples(index=False)]
        each = {d: two(v) - one(v) for d, v in rows}
        vals, point = sorted(v for d, v in each.items() if d >= 0 and v == v), each[-1]
        at = lambda q: vals[int(q * (len(vals) - 1))] if vals else math.nan
        other = sum(v <= 0 if point >= 0 else v >= 0 for v in vals)
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "delta": [point], "lo": [at(0.025)], "hi": [at(0.975)], "p": [min(1.0, 2 * other / len(vals)) if vals else math.nan], "draws": [len(vals)]})

    return resampled(df, cluster, sums, draws, seed, by).groupBy("group").applyInPandas(compared, "group string, delta double, lo double, hi double, p double, draws long")


def platt(scores, yes, no, steps: int = 100, ridge: float = 1e-2) -> tuple[float, float] | None:
    """Slope and offset of a logistic map of the score's logit, by damped Newton steps (X11). yes and no say how often
    each score stands with a true and a false label."""
    import numpy as np

    y, m = np.asarray(yes, dtype=float), np.asarray(yes, dtype=float) + np.asarray(no, dtype=float)
    if not 0 < y.sum() < m.sum():
        return None
    p = np.clip(np.asarray(scores, dtype=float), 1e-6, 1 - 1e-6)
    x, w = np.log(p / (1 - p)), np.array([1.0, 0.0])
    X = np.stack([x, np.ones_like(x)], axis=1)
    loss = lambda w: float(m @ np.logaddexp(0, X @ w) - y @ (X @ w) + 0.5 * ridge * w[0] ** 2)
    now = loss(w)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-(X @ w)))
        g = X.T @ (m * q - y) + np.array([ridge * w[0], 0.0])
        h = (X * (m * q * (1 - q))[:, None]).T @ X + np.diag([ridge, 1e-9])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        if size <= 1e-6:
            break
        w, moved = w - size * step, float(np.abs(size * step).sum())
        now = loss(w)
        if moved < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_platt(df: DataFrame, by: str, score: str, truth: str) -> DataFrame:
    """(by, slope, offset) per group. Equal scores are counted first, so a task meets a group's distinct scores."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        got = platt(pdf["s"], pdf["p"], pdf["q"])
        return pd.DataFrame({by: pdf[by].iloc[:1], "slope": [got[0] if got else None], "offset": [got[1] if got else None]})

    kind = df.schema[by].dataType.simpleString()
    per = df.groupBy(by, F.col(score).alias("s")).agg(F.count_if(truth).alias("p"), F.count_if(~F.col(truth)).alias("q"))
    return per.groupBy(by).applyInPandas(kernel, f"{by} {kind}, slope double, offset double")


def apply_platt(p: Column, a: Column, b: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.when(a.isNull(), p).otherwise(1 / (1 + F.exp(-(a * F.log(q / (1 - q)) + b))))


#: Blocks that one task pools at a time.
ISOTONIC_RUN = 50_000


def isotonic(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, x0, x1, fit, n): pooled adjacent violators of the mean of y over x (X21). Equal x are averaged first.

    Pooling parts of an ordered list and then what they gave is pooling the whole list, so ranges of x are pooled in
    tasks of their own. Where two ranges meet in blocks that violate the order, the second half of every range is
    pooled with the first half of the next, until none do; two rounds merge such blocks at least, so it ends. A group of any
    size lies over many tasks.
    """
    spark, at = df.sparkSession, scratch(df.sparkSession, "isotonic")
    names, kind = [by, "x0", "x1", "fit", "n", "part"], df.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, x0 double, x1 double, fit double, n double, part long"

    def pool(parts):
        blocks: list[list] = []  # of one group and range: the rows of a task are in order of range, group and x
        for pdf in parts:
            rows = []
            for g, a, b, m, n, part in pdf.itertuples(index=False, name=None):
                g = None if isinstance(g, float) and math.isnan(g) else g
                if blocks and (blocks[0][0] != g or blocks[0][5] != part):
                    rows += blocks
                    blocks = []
                blocks.append([g, a, b, m, n, part])
                while len(blocks) > 1 and blocks[-2][3] >= blocks[-1][3]:
                    q, p = blocks.pop(), blocks.pop()
                    blocks.append([g, p[1], q[2], (p[3] * p[4] + q[3] * q[4]) / (p[4] + q[4]), p[4] + q[4], part])
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(blocks, columns=names)

    v = F.col(x).cast("double")
    blocks = df.where(v.isNotNull() & F.col(y).isNotNull()).groupBy(by, v.alias("x0")).agg(F.avg(F.col(y).cast("double")).alias("fit"), F.count("*").cast("double").alias("n"))
    blocks.write.parquet(f"{at}/0")
    blocks = spark.read.parquet(f"{at}/0")
    ranged = blocks.repartitionByRange(max(1, -(-blocks.count() // ISOTONIC_RUN)), by, "x0")
    blocks = ranged.select(by, "x0", F.col("x0").alias("x1"), "fit", "n", F.spark_partition_id().cast("long").alias("part"))
    blocks = blocks.sortWithinPartitions("part", by, "x0")
    for k in range(1, 200):
        blocks.mapInPandas(pool, schema).write.parquet(f"{at}/{k}")
        done = spark.read.schema(schema).parquet(f"{at}/{k}")
        ends = done.groupBy(by, "part").agg(F.min_by("fit", "x0").alias("first"), F.max_by("fit", "x0").alias("last"))
        low = F.lag("last").over(Window.partitionBy(by).orderBy("part"))
        if ends.withColumn("low", low).where("low >= first").isEmpty():
            return done.drop("part")
        order = Window.partitionBy("part").orderBy(by, "x0")
        m = F.count("*").over(Window.partitionBy("part"))
        half = F.when(F.when(m > 1, 2 * F.row_number().over(order) > m).otherwise((F.col("part") + k) % 2 == 1), 1).otherwise(0)  # lone blocks meet in pairs
        blocks = done.withColumn("part", F.col("part") + half).repartition("part").sortWithinPartitions("part", by, "x0")
    raise RuntimeError("blocks still violate the order after 199 rounds")


def value_at_share(df: DataFrame, column: str, share: DataFrame, name: str) -> DataFrame:
    """One row `value`: that at place floor(share * count) of the sorted column (Q7). share has one row."""
    d = running(df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c")), "v", {"c": "to"})
    d = d.crossJoin(F.broadcast(d.agg(F.max("to").alias("n")))).crossJoin(F.broadcast(share))
    return d.where(F.col("to") > F.floor(F.col(name) * F.col("n"))).agg(F.min("v").alias("value"))


def grouped_cv(df: DataFrame, fold: str, k: int, score: str, truth: str) -> DataFrame:
    """(fold, n, brier_raw, brier_fit): a Platt fit on the other folds, judged on its own.

    Scores are pooled by value and fold before they meet in a task.
    """
    per = df.groupBy(fold, F.col(score).alias("s")).agg(F.count_if(truth).alias("p"), F.count_if(~F.col(truth)).alias("q"))
    spread = per.withColumn("held", F.explode(F.array(*map(F.lit, range(k)))))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        held = int(pdf.held.iloc[0])
        fit, own = pdf[pdf[fold] != held], pdf[pdf[fold] == held]
        got = platt(fit.s, fit.p, fit.q)
        brier = lambda f: float((own.p * (f - 1) ** 2 + own.q * f**2).sum() / max(1, (own.p + own.q).sum()))
        x = np.clip(own.s, 1e-6, 1 - 1e-6)
        cal = 1 / (1 + np.exp(-(got[0] * np.log(x / (1 - x)) + got[1]))) if got else own.s
        return pd.DataFrame({"fold": [held], "n": [int((own.p + own.q).sum())], "brier_raw": [brier(own.s)], "brier_fit": [brier(cal)]})

    return spread.groupBy("held").applyInPandas(kernel, "fold long, n long, brier_raw double, brier_fit double")


def leave_one_out(df: DataFrame, session: str, score: str, truth: str) -> DataFrame:
    """(session, threshold, tp, fp, fn, tn): the best threshold of the other sessions, applied to each (Q17).

    Running counts of all sessions less those of the held-out one give its threshold without refitting per session.
    """
    per = df.groupBy(session, F.col(score).alias("s")).agg(F.count_if(truth).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    grid = per.groupBy("s").agg(F.sum("p").alias("ap"), F.sum("n").alias("an"))
    cross = grid.crossJoin(F.broadcast(per.select(session).distinct()))  # sessions x distinct scores
    d = cross.join(per, [session, "s"], "left").fillna(0, ["p", "n"])
    w = Window.partitionBy(session).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(session)
    d = d.withColumn("tp", F.sum(F.col("ap") - F.col("p")).over(w)).withColumn("fp", F.sum(F.col("an") - F.col("n")).over(w))
    d = d.withColumn("np", F.sum(F.col("ap") - F.col("p")).over(tot)).withColumn("nn", F.sum(F.col("an") - F.col("n")).over(tot))
    c = lambda x: F.col(x).cast("double")
    d = d.withColumn("m", mcc(c("tp"), c("fp"), c("np") - c("tp"), c("nn") - c("fp")))
    best = d.groupBy(session).agg(F.max(F.struct("m", "s")).alias("b")).select(session, F.col("b.s").alias("threshold"))
    own = per.join(best, session)
    hit = F.col("s") >= F.col("threshold")
    part = lambda x, cond, n: F.sum(F.when(cond, F.col(x)).otherwise(0)).alias(n)
    return own.groupBy(session, "threshold").agg(part("p", hit, "tp"), part("n", hit, "fp"), part("p", ~hit, "fn"), part("n", ~hit, "tn"))
