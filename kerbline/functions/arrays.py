"""Array, map and number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Preview widths.
WIDTHS = (160, 320, 480, 640, 960, 1280, 1600, 1920)


def number(x: Column) -> Column:
    """A finite double of a number or numeric text, else null."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def lonlat(lon: Column, lat: Column) -> Column:
    """(lon, lat) at seven places, null when either is missing or out of range."""
    ok = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(ok, F.struct(F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat")))


def snap_width(w: Column) -> Column:
    """The smallest width offered that is no smaller, the largest beyond."""
    return F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, WIDTHS)), lambda x: x >= w)), F.lit(WIDTHS[-1]))


def best_score(scores: Column, keys: list[str]) -> Column:
    """Largest score over keys, missing ones zero."""
    return F.array_max(F.transform(F.array(*map(F.lit, keys)), lambda k: F.coalesce(F.try_element_at(scores, k), F.lit(0.0))))


def decide(scores: Column, groups: dict[str, list[str]], threshold: float) -> Column:
    """Names of groups whose best score reaches the threshold, strongest first."""
    rows = F.array(*[F.struct(best_score(scores, ks).alias("p"), F.lit(g).alias("name")) for g, ks in groups.items()])
    hit = F.filter(rows, lambda r: r["p"] >= threshold)
    order = F.array_sort(F.transform(hit, lambda r: F.struct((-r["p"]).alias("p"), r["name"].alias("name"))))
    return F.transform(order, lambda r: r["name"])


def strongest(scores: Column) -> Column:
    """(score, key) of a map's largest value."""
    return F.array_max(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("score"), e["key"].alias("key"))))


def combine(a: Column, b: Column, how: str) -> Column:
    """Two score maps key by key: max, mean, or mean of logits."""
    logit = lambda p: F.log(F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))))

    def one(_, x, y):
        x, y = F.coalesce(x, y), F.coalesce(y, x)
        if how == "max":
            return F.greatest(x, y)
        return (x + y) / 2 if how == "mean" else 1 / (1 + F.exp(-(logit(x) + logit(y)) / 2))

    return F.map_zip_with(a, b, one)


def geometric(logs: Column) -> Column:
    """(mean, joint) probability from log probabilities, nulls skipped, four places."""
    v = F.filter(logs, lambda x: x.isNotNull())
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(v) > 0, F.struct(F.round(F.exp(total / F.size(v)), 4).alias("mean"), F.round(F.exp(total), 4).alias("joint")))
