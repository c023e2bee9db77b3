"""Extent of a defect from probe scores: candidate curves chosen by grouped cross-validation, their residual model,
bootstrap curves and the interval of a section's extent.

A curve is a monotone line through bins of the score. Everything a fit needs are sums over bins, so all folds and
candidates are fitted in one pass over the rows and the bootstrap works on sums per block, never on rows. Only built-in
functions; what is collected per group are a few numbers per bin.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

# Candidates in the order that ties go by, least rows of a stratum, clip of scores, frames that tau is
# for, points of the normal grid, share of a section that must be scored, least rows of a block in the residual model.
CANDIDATES, STRATUM, CLIP, REF_N, GRID, SCORED, BLOCK_ROWS = ("constant", "bins3", "bins5", "bins8", "bins3_label"), 30, 1e-4, 20, 41, 0.5, 10
LEVELS = {"bins3": 3, "bins5": 5, "bins8": 8, "bins3_label": 3}
#: P(Poisson(1) <= n): thresholds of a block's weight in a bootstrap draw.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: fits are small, and what stands on them would compute them again and again."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(q / (1 - q))


def bound(body, *values: Column) -> Column:
    """body(*values) with each value computed once; a plain reference inside a lambda is computed for every element."""
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(named), lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


def pooled(means: Column, weights: Column) -> Column:
    """Pooled adjacent violators of a few bins: the largest, over starts, of the smallest mean over ends."""

    def upto(v):
        return F.transform(F.sequence(F.lit(0), F.size(v)), lambda k: F.aggregate(F.slice(v, F.lit(1), k), F.lit(0.0), lambda a, b: a + b))

    def largest(w, wy):
        n = F.size(w) - 1
        mean = lambda j, k: (F.get(wy, k) - F.get(wy, j - 1)) / (F.get(w, k) - F.get(w, j - 1))
        low = lambda i: F.array_max(F.transform(F.sequence(F.lit(1), i), lambda j: F.array_min(F.transform(F.sequence(i, n), lambda k: mean(j, k)))))
        return F.transform(F.sequence(F.lit(1), n), low)

    return bound(lambda m, w: bound(largest, upto(w), upto(F.zip_with(m, w, lambda a, b: a * b))), means, weights)


def line(x: Column, xs: Column, ys: Column) -> Column:
    """ys interpolated at x, its ends held, never below 0; null without a line."""
    at = F.size(F.filter(xs, lambda e: e <= x))
    a, b = F.get(xs, at - 1), F.get(xs, at)
    ya, yb = F.get(ys, at - 1), F.get(ys, at)
    y = F.when(at == 0, F.get(ys, F.lit(0))).when(at >= F.size(xs), F.get(ys, F.size(ys) - 1)).otherwise(ya + (x - a) / (b - a) * (yb - ya))
    return F.when(xs.isNotNull() & ys.isNotNull(), F.greatest(F.lit(0.0), y))


def place(x: Column, edges: Column) -> Column:
    """Bin of x: the number of edges below it."""
    return F.size(F.filter(edges, lambda e: x > e))


def _curves(train: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    """(keys, fits): of each group of train(keys, x, y, flag) a map candidate -> (edges, x, y, n) per stratum."""
    strata = F.array(F.lit(-1), F.coalesce("flag", F.lit(-2)).cast("int")) if "bins3_label" in names else F.array(F.lit(-1))
    d = train.withColumn("stratum", F.explode(strata)).where("stratum > -2")
    probs = sorted({i / k for n, k in LEVELS.items() if n in names for i in range(1, k)})
    cut = d.groupBy(*keys, "stratum").agg(F.count("*").alias("rows"), F.avg("y").alias("mean"), F.percentile("x", F.array(*map(F.lit, probs))).alias("q"))
    edges = lambda k: F.array_sort(F.array_distinct(F.array(*[F.get("q", F.lit(probs.index(i / k))) for i in range(1, k)])))
    levels = sorted(set(LEVELS.values()))
    cut = cut.withColumn("cuts", F.map_from_arrays(F.array(*map(F.lit, levels)), F.array(*map(edges, levels))))
    b = d.join(cut.select(*keys, "stratum", "cuts"), [*keys, "stratum"]).select(*keys, "stratum", "x", "y", F.explode("cuts").alias("k", "edges"))
    b = b.groupBy(*keys, "stratum", "k", "edges", place(F.col("x"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.percentile("x", F.lit(0.5)).alias("c"))
    b = b.groupBy(*keys, "stratum", "k", "edges").agg(F.array_sort(F.collect_list(F.struct("bin", "c", "m", F.col("n").cast("double").alias("n")))).alias("bins"))
    b = b.where(F.size("bins") == F.size("edges") + 1)
    of = lambda f: F.transform("bins", lambda s: s[f])
    b = b.select(*keys, "stratum", "k", F.struct("edges", of("c").alias("x"), pooled(of("m"), of("n")).alias("y"), of("n").alias("n")).alias("fit"))
    b = b.join(cut.select(*keys, "stratum", "rows"), [*keys, "stratum"])
    fits = b.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "k", "stratum").alias("key"), F.struct("fit.*", "rows").alias("value")))).alias("fits"))
    unlabelled = train.groupBy(*keys).agg(F.count_if(F.col("flag").isNull()).alias("unlabelled"))
    return cut.where("stratum = -1").select(*keys, "mean").join(fits, keys, "left").join(unlabelled, keys)


def _predict(name: str, x: Column, flag: Column) -> Column:
    """What a candidate of a row's `fits` and `mean` says; null where it could not be fitted."""
    if name == "constant":
        return F.col("mean")
    k = LEVELS[name]
    if not name.endswith("_label"):
        f = F.col("fits")[f"{k}:-1"]
        return line(x, f["x"], f["y"])
    zero, one = F.col("fits")[f"{k}:0"], F.col("fits")[f"{k}:1"]
    fit = F.when(flag == 1, one).otherwise(zero)
    ok = (zero["rows"] >= STRATUM) & (one["rows"] >= STRATUM) & (F.col("unlabelled") == 0)
    return F.when(ok & flag.isNotNull(), line(x, fit["x"], fit["y"]))


def select(rows: DataFrame, folds: int = 5, names: tuple[str, ...] = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """rows(g, block, fold, score, y, flag) -> (choice per g, curves per g).

    Each block is in one fold, its rows' `fold` in 0..folds-1. Of the candidates that every training set can fit the
    one with the least mean absolute error of block means, out of fold, is chosen, ties to the first. choice has
    g, chosen, cv (error by candidate), n_frames, n_blocks, tau20, rho, sigma2: the residual model of the chosen one.
    curves has g, chosen, mean, fits: its fit on all rows. flag may be null; then bins by label are no candidate.
    """
    r = rows.select("g", "block", F.col("fold").cast("int").alias("fold"), logit(F.col("score")).alias("x"), F.col("y").cast("double").alias("y"), F.col("flag").cast("int").alias("flag"))
    held = F.sequence(F.lit(0), F.lit(folds))  # `folds` itself: the fit on all rows
    train = r.withColumn("held", F.explode(F.filter(held, lambda h: h != F.col("fold"))))
    curves = kept(_curves(train, ["g", "held"], names), "extent-curves")
    told = r.join(curves.withColumnRenamed("held", "fold"), ["g", "fold"])
    told = told.select("g", "block", "x", "y", *[_predict(n, F.col("x"), F.col("flag")).alias(n) for n in names])
    per = kept(told.groupBy("g", "block").agg(
        F.count("*").alias("n"), F.avg("y").alias("t"), *[F.when(F.count(n) == F.count("*"), F.avg(n)).alias(n) for n in names],
        *[F.sum((F.col("y") - F.col(n)) * (F.col("y") - F.col(n))).alias(f"{n}_2") for n in names],
    ), "extent-blocks")
    errors = [F.when(F.count(n) == F.count("*"), F.avg(F.abs(F.col(n) - F.col("t")))) for n in names]
    cv = per.groupBy("g").agg(F.create_map(*[x for n, e in zip(names, errors, strict=True) for x in (F.lit(n), e)]).alias("cv"), F.sum("n").alias("n_frames"), F.count("*").alias("n_blocks"))
    order = F.array_sort(F.filter(F.array(*[F.struct(F.round(F.col("cv")[n], 12).alias("e"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(names)]), lambda s: s["e"].isNotNull()))
    cv = cv.withColumn("chosen", F.get(order, F.lit(0))["name"])
    pick = lambda suffix: F.coalesce(*[F.when(F.col("chosen") == n, F.col(f"{n}{suffix}")) for n in names])
    per = per.join(cv.select("g", "chosen"), "g").select("g", "n", "t", pick("").alias("p"), pick("_2").alias("ss")).withColumn("m", F.col("t") - F.col("p"))
    root = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.col(c)))
    many = F.col("n") >= BLOCK_ROWS
    u = root("t") - root("p")
    one = per.groupBy("g").agg(
        F.sqrt(F.avg(F.when(many, u * u))).alias("tau20"), F.sum("n").alias("N"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mres"), F.sum("ss").alias("ss"),
        F.count_if(many).alias("B"), F.avg(F.when(many, F.col("n"))).alias("nbar"), F.sum(F.when(many, F.col("m"))).alias("m1"), F.sum(F.when(many, F.col("m") * F.col("m"))).alias("m2"),
    )
    sigma2 = F.greatest(F.lit(0.0), F.col("ss") - F.col("N") * F.col("mres") * F.col("mres")) / F.greatest(F.lit(1), F.col("N") - 1)
    one = one.withColumn("sigma2", sigma2)
    vb = (F.col("m2") - 2 * F.col("mres") * F.col("m1") + F.col("B") * F.col("mres") * F.col("mres")) / F.greatest(F.lit(1), F.col("B") - 1)
    rho = F.when((F.col("sigma2") > 0) & (F.col("B") > 0), F.when(F.col("nbar") > 1, (F.col("nbar") * vb / F.col("sigma2") - 1) / (F.col("nbar") - 1)).otherwise(1.0)).otherwise(1.0)
    one = one.select("g", F.coalesce("tau20", F.lit(0.0)).alias("tau20"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), rho)).alias("rho"), "sigma2")
    choice = kept(cv.join(one, "g"), "extent-choice")
    return choice, curves.where(F.col("held") == folds).drop("held").join(choice.select("g", "chosen"), "g")


def filled(n: Column, s: Column) -> Column:
    """Means of bins, those without rows with the mean of the nearest that has some, the left one of two, then pooled."""

    def means(n, s):
        all_ = F.sequence(F.lit(0), F.size(n) - 1)
        near = lambda i: F.array_min(F.transform(F.filter(all_, lambda j: F.get(n, j) > 0), lambda j: F.struct(F.abs(j - i).alias("d"), j.alias("j"))))["j"]
        return F.transform(all_, lambda i: bound(lambda j: F.coalesce(F.get(s, j) / F.get(n, j), F.lit(0.0)), near(i)))

    return bound(lambda n, s: pooled(means(n, s), F.transform(n, lambda c: F.greatest(c, F.lit(1.0)))), n, s)


def bootstrap(rows: DataFrame, curves: DataFrame, draws: int = 200, seed: int = 0) -> DataFrame:
    """(g, draw, stratum, ys): the chosen curves refitted with their edges fixed to resampled blocks.

    A block weighs a Poisson(1) number in a draw, by the hash of seed, draw, group and block, so a draw is the same on
    any number of tasks. Blocks are summed by bin first; a stratum of -1 stands for curves without labels."""
    c = curves.select("g", "chosen", "fits")
    d = rows.select("g", "block", logit(F.col("score")).alias("x"), F.col("y").cast("double").alias("y"), F.col("flag").cast("int").alias("flag")).join(c, "g")
    k = F.coalesce(*[F.when(F.col("chosen") == n, F.lit(str(v))) for n, v in LEVELS.items()], F.lit("0"))
    d = d.withColumn("stratum", F.when(F.col("chosen").endswith("_label"), F.col("flag")).otherwise(-1)).withColumn("edges", F.when(F.col("chosen") == "constant", F.array().cast("array<double>")).otherwise(F.try_element_at("fits", F.concat_ws(":", k, "stratum"))["edges"]))
    sums = d.groupBy("g", "block", "stratum", F.size("edges").alias("last"), place(F.col("x"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", "g", "block"), F.lit(1 << 52)) / float(1 << 52)
    w = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    b = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", w)
    b = b.groupBy("g", "draw", "stratum", "last", "bin").agg(F.sum(F.col("w") * F.col("n")).cast("double").alias("n"), F.sum(F.col("w") * F.col("s")).alias("s"))
    b = b.groupBy("g", "draw", "stratum", "last").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "s")))).alias("m"))
    bins = F.sequence(F.lit(0), F.col("last"))
    of = lambda f: F.transform(bins, lambda i: F.coalesce(F.try_element_at("m", i)[f], F.lit(0.0)))
    return kept(b.select("g", "draw", "stratum", filled(of("n"), of("s")).alias("ys")), "extent-draws")


def quantile(values: Column, q: float) -> Column:
    """Linear quantile of a sorted array."""
    at = (F.size(values) - 1) * F.lit(q)
    i = F.floor(at).cast("int")
    a, b = F.get(values, i), F.get(values, F.least(i + 1, F.size(values) - 1))
    return a + (at - i) * (b - a)


def spread(n: Column, rho: Column) -> Column:
    """Variance of a mean over n correlated frames as a multiple of that over REF_N (at most 1 / n beyond)."""
    m = F.greatest(F.lit(1.0), n.cast("double"))
    ref = (1.0 + (REF_N - 1) * rho) / REF_N
    return F.when(m <= REF_N, ((1.0 + (m - 1.0) * rho) / m) / ref).otherwise(REF_N / m)


def intervals(sections: DataFrame, choice: DataFrame, curves: DataFrame, boots: DataFrame, factor90: float = 1.0) -> DataFrame:
    """sections(g, section, score, length_m, flag) -> (g, section, n_frames, scored_m, coverage, mean, lo90, hi90).

    The section's mean on the chosen curve, and the 5th and 95th percentile over bootstrap curves and a normal grid of
    residuals on the square-root scale, wider by factor90 for frames of another domain. Rows without a score count for
    coverage alone; below SCORED of the length there is no estimate.
    """
    d = sections.withColumn("x", F.when(F.col("score").isNotNull() & (F.col("length_m") > 0), logit(F.col("score"))))
    has = F.col("x").isNotNull()
    whole = d.groupBy("g", "section").agg(F.sum("length_m").alias("total"), F.count_if(has).alias("n_frames"), F.coalesce(F.sum(F.when(has, F.col("length_m"))), F.lit(0.0)).alias("scored_m"))
    c = curves.select("g", "chosen", "mean", "fits")
    rows = d.where(has).join(c, "g")
    own = F.coalesce(*[F.when(F.col("chosen") == n, _chosen_line(n)) for n in CANDIDATES])
    point = rows.withColumn("p", own).groupBy("g", "section").agg((F.sum(F.col("p") * F.col("length_m")) / F.sum("length_m")).alias("mean"))
    k = F.coalesce(*[F.when(F.col("chosen") == n, F.lit(str(v))) for n, v in LEVELS.items()], F.lit("0"))
    stratum = F.when(F.col("chosen").endswith("_label"), F.col("flag")).otherwise(-1)
    rows = rows.withColumn("stratum", stratum).withColumn("xs", F.try_element_at("fits", F.concat_ws(":", k, "stratum"))["x"])
    # Of a section's rows a curve needs no more than the weight at each distinct score.
    rows = rows.groupBy("g", "section", "stratum", "xs", "x").agg(F.sum("length_m").alias("w"))
    curve = F.when(F.col("xs").isNull(), F.greatest(F.lit(0.0), F.get("ys", F.lit(0)))).otherwise(line(F.col("x"), F.col("xs"), F.col("ys")))
    means = rows.join(boots, ["g", "stratum"]).groupBy("g", "section", "draw").agg((F.sum(F.col("w") * curve) / F.sum("w")).alias("m"))
    means = means.groupBy("g", "section").agg(F.collect_list("m").alias("means"))
    z = [NormalDist().inv_cdf((i + 0.5) / GRID) for i in range(GRID)]
    d = whole.join(point, ["g", "section"], "left").join(means, ["g", "section"], "left").join(choice.select("g", "tau20", "rho"), "g")
    d = d.withColumn("tau", F.col("tau20") * F.sqrt(spread(F.col("n_frames"), F.col("rho")))).withColumn("coverage", F.when(F.col("total") > 0, F.col("scored_m") / F.col("total")).otherwise(0.0))
    vals = F.flatten(F.transform("means", lambda m: F.transform(F.array(*map(F.lit, z)), lambda e: F.pow(F.greatest(F.lit(0.0), F.sqrt(F.greatest(F.lit(0.0), m)) + F.col("tau") * e), 2))))
    if factor90 > 1:
        wider = [NormalDist().inv_cdf((i + 0.5) / GRID) for i in range(0, GRID, 4)]
        sd = math.log(factor90) / NormalDist().inv_cdf(0.95)
        vals = F.flatten(F.transform(vals, lambda v: F.transform(F.array(*map(F.lit, wider)), lambda e: v * F.exp(sd * e))))
    d = d.withColumn("vals", F.array_sort(vals)).withColumn("ok", (F.col("n_frames") > 0) & (F.col("coverage") >= SCORED - 1e-9))
    lo, hi = F.least(quantile(F.col("vals"), 0.05), F.col("mean")), F.greatest(quantile(F.col("vals"), 0.95), F.col("mean"))
    return d.select("g", "section", "n_frames", "scored_m", "coverage", *[F.when(F.col("ok"), c).alias(n) for c, n in ((F.col("mean"), "mean"), (lo, "lo90"), (hi, "hi90"))])


def _chosen_line(name: str) -> Column:
    """The chosen candidate's full fit at a row."""
    if name == "constant":
        return F.greatest(F.lit(0.0), F.col("mean"))
    key = F.concat_ws(":", F.lit(str(LEVELS[name])), F.col("flag") if name.endswith("_label") else F.lit(-1))
    fit = F.try_element_at("fits", key)
    return line(F.col("x"), fit["x"], fit["y"])
