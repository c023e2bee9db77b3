"""Joins by distance through grid cells, and geometry columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0


def local_xy(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin, equirectangular."""
    import math

    return (lon - lon0) * (DEGREE_M * math.cos(math.radians(lat0))), (lat - lat0) * DEGREE_M


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the great circle."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def angle_difference(a: Column, b: Column) -> Column:
    """Degrees between two headings, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def bearing(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def _around(c: Column) -> Column:
    return F.sequence(c - 1, c + 1)


def radius_pairs(a: DataFrame, b: DataFrame, radius: float, x: str = "x", y: str = "y", suffix: str = "_b", by: tuple[str, ...] = (), wide: float = 1.0) -> DataFrame:
    """Pairs (row of a, row of b with suffixed names, d) within the radius, of equal columns `by`.

    Cells as wide as the radius, or `wide` times that: b stands in one, a asks those it reaches, nine at wide 1. An equi
    join on the cell spreads over the cluster; the adaptive skew join splits crowded cells. Wide cells repeat a less.
    """
    size = radius * wide
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    reach = lambda c: F.sequence(F.floor((F.col(c) - radius * (1 + 1e-9)) / size).cast("long"), F.floor((F.col(c) + radius * (1 + 1e-9)) / size).cast("long"))
    asks = (lambda c: _around(cell(c))) if wide == 1.0 else reach
    left = a.withColumn("__x", F.explode(asks(x))).withColumn("__y", F.explode(asks(y)))
    right = b.select(*by, *[F.col(c).alias(c + suffix) for c in b.columns if c not in by], cell(x).alias("__x"), cell(y).alias("__y"))
    d = F.sqrt(F.pow(F.col(x) - F.col(x + suffix), 2) + F.pow(F.col(y) - F.col(y + suffix), 2))
    return left.join(right, [*by, "__x", "__y"]).drop("__x", "__y").withColumn("d", d).where(F.col("d") <= radius)


def nearest(pairs: DataFrame, per: list[str], *ties: str) -> DataFrame:
    """The closest pair of each `per`, ties by the columns named."""
    best = F.min_by(F.struct(*pairs.columns), F.struct(F.col("d"), *map(F.col, ties)))
    return pairs.groupBy(*per).agg(best.alias("r")).select("r.*")


def mutual_nearest(pairs: DataFrame, a: str, b: str, groups: list[str]) -> DataFrame:
    """Pairs that are each other's closest within the groups."""
    one = Window.partitionBy(a, *groups).orderBy("d", b)
    two = Window.partitionBy(b, *groups).orderBy("d", a)
    return pairs.withColumn("__r", F.row_number().over(one)).withColumn("__s", F.row_number().over(two)).where("__r = 1 and __s = 1").drop("__r", "__s")


#: Points of a tile's first side, rows and columns of a block of distances, rows that a tile hands out at once.
TILE, BLOCK, HAND_OUT = 8192, (240, 480), 200_000


def _blocks(group, least: int) -> list[tuple[int, int]]:
    """Ranges of whole groups of a sorted column, each of at least so many rows where there are as many."""
    import numpy as np

    ends, out, start = [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)], [], 0
    for end in ends:
        if end - start >= least or end == len(group) and end > start:
            out.append((start, end))
            start = end
    return out


def _winners(a, b, radius: float, mutual: bool) -> Iterator:
    """(row of a, row of b): the closest b of every group of a later order for each own a, of a pair (J15), or where each
    is the other's closest (J14). a, b: dicts of x, y, order, group and own, sorted by order, group and name.

    A block of distances is dense, its winners are minima over the columns of a group, the rounded distance and the
    row's place in one number."""
    import numpy as np

    starts = lambda g: np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1])
    rows, columns = _blocks(a["group"], BLOCK[0]), _blocks(b["group"], BLOCK[1])
    for i0, i1 in rows:
        if not a["own"][i0:i1].any():
            continue
        for j0, j1 in columns:
            if b["order"][j1 - 1] <= a["order"][i0]:
                continue
            key, e = np.subtract.outer(a["x"][i0:i1], b["x"][j0:j1]), np.subtract.outer(a["y"][i0:i1], b["y"][j0:j1])
            key *= key
            e *= e
            key += e
            np.sqrt(key, out=key)
            out = key > radius
            if b["order"][j0] <= a["order"][i1 - 1]:
                out |= np.greater_equal.outer(a["order"][i0:i1], b["order"][j0:j1])
            size = float(max(i1 - i0, j1 - j0))
            key *= 1e6
            key += 0.5
            np.floor(key, out=key)
            key *= size
            key[out] = np.inf
            best = np.minimum.reduceat(np.add(key, np.arange(j1 - j0), out=e), starts(b["group"][j0:j1]), axis=1)
            i, t = np.nonzero(np.isfinite(best) & a["own"][i0:i1, None])
            j = np.fmod(best[i, t], size).astype(np.int64)
            if mutual:
                first = starts(a["group"][i0:i1])
                back = np.minimum.reduceat(np.add(key, np.arange(i1 - i0)[:, None], out=e), first, axis=0)
                of = np.searchsorted(first, i, side="right") - 1
                ok = np.fmod(back[of, j], size).astype(np.int64) == i
                i, j = i[ok], j[ok]
            yield i + i0, j + j0


def nearest_of_groups(points: DataFrame, radius: float, order: str, mutual: bool = False) -> DataFrame:
    """(a, other, b): of each point(segment_id, session_id, x, y, order) the closest point of every session of a later
    order within the radius, distances to six decimals, ties by segment_id (J15); with `mutual` only pairs (a, b) that are
    each other's closest in their sessions (J14). `order` is one number per session; rows without it or a place take no
    part.

    Pairs grow with the square of the sessions along a road, so none is shuffled: a tile holds the points of a cell, of
    some sessions where they are many, with all points that their answer depends on, and gives its own points' rows.
    """
    p = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(order).isNotNull()).select("segment_id", "session_id", F.col(order).alias("order"), "x", "y")
    cell, edge = 3.0 * radius, radius * (1 + 1e-9)
    reach = edge * (2 if mutual else 1)
    at = lambda c: F.floor(c / cell).cast("long")
    every = p
    for c in "xy":
        every = every.withColumn(f"c{c}", F.explode(F.sequence(at(F.col(c) - reach), at(F.col(c) + reach))))
    own = (at(F.col("x")) == F.col("cx")) & (at(F.col("y")) == F.col("cy"))
    inner = [F.col(c).between(F.col(f"c{c}") * cell - edge, (F.col(f"c{c}") + 1) * cell + edge) for c in "xy"]
    every = every.withColumn("own", own).withColumn("first", F.lit(True) if mutual else F.col("own")).withColumn("second", inner[0] & inner[1])
    count = every.groupBy("cx", "cy").agg(F.count_if("own").alias("mine"), F.count_if("first").alias("n")).where("mine > 0")
    every = every.join(count.select("cx", "cy", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), ["cx", "cy"])
    part = F.pmod(F.xxhash64("session_id"), F.col("parts")).cast("int")
    put = F.when(F.col("second"), F.sequence(F.lit(0), F.col("parts") - 1)).when(F.col("first"), F.array(part)).otherwise(F.array().cast("array<int>"))
    tiles = every.withColumn("part", F.explode(put)).withColumn("first", F.col("first") & (part == F.col("part")))
    tiles = tiles.select("cx", "cy", "part", "segment_id", "session_id", "order", "x", "y", "own", "first", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        all_ = pa.Table.from_batches(list(batches)).sort_by([("order", "ascending"), ("session_id", "ascending"), ("segment_id", "ascending")]).combine_chunks()
        names, sessions = all_["segment_id"].combine_chunks(), all_["session_id"].combine_chunks()
        code = sessions.dictionary_encode().indices.to_numpy()
        column = {c: all_[c].to_numpy() for c in ("x", "y", "order", "own")} | {"group": code}
        first, second = np.flatnonzero(all_["first"].to_numpy()), np.flatnonzero(all_["second"].to_numpy())
        held, n = [], 0

        def hand_out() -> pa.RecordBatch:
            i, j = pa.array(first[np.concatenate([h[0] for h in held])]), pa.array(second[np.concatenate([h[1] for h in held])])
            got = {"a": names.take(i), "b": names.take(j)} if mutual else {"a": names.take(i), "other": sessions.take(j), "b": names.take(j)}
            return pa.RecordBatch.from_pydict(got)

        if len(first) and len(second):
            for pair in _winners({c: v[first] for c, v in column.items()}, {c: v[second] for c, v in column.items()}, radius, mutual):
                held.append(pair)
                n += len(pair[0])
                if n >= HAND_OUT:
                    yield hand_out()
                    held, n = [], 0
        if n:
            yield hand_out()

    return tiles.groupBy("cx", "cy", "part").applyInArrow(run, "a string, b string" if mutual else "a string, other string, b string")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring, an array of (x, y)."""
    n = F.size(ring)
    def crosses(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])

    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))
    return F.size(hits) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Inside the first ring and outside the others."""
    inside = F.size(F.filter(rings, lambda r: in_ring(x, y, r)))
    return in_ring(x, y, F.get(rings, F.lit(0))) & (inside == 1)


def polygon_join(points: DataFrame, polygons: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """points with the columns of the first polygon (by polygon_no) that holds them.

    polygons(polygon_no, rings, x0, y0, x1, y1). A polygon stands in every cell of its box, a point in one, so the join
    gives a point its cell's polygons in order and no grouping of points follows.
    """
    side = lambda a, b: F.sequence(F.floor(F.col(a) / cell).cast("long"), F.floor(F.col(b) / cell).cast("long"))
    poly = polygons.withColumn("__x", F.explode(side("x0", "x1"))).withColumn("__y", F.explode(side("y0", "y1")))
    box = F.col("x0").alias("a"), F.col("y0").alias("b"), F.col("x1").alias("c"), F.col("y1").alias("d"), F.col("rings").alias("r")
    cells = poly.groupBy("__x", "__y").agg(F.sort_array(F.collect_list(F.struct("polygon_no", *box))).alias("__in"))
    pts = points.withColumn("__x", F.floor(F.col(x) / cell).cast("long")).withColumn("__y", F.floor(F.col(y) / cell).cast("long"))
    holds = lambda p: F.col(x).between(p["a"], p["c"]) & F.col(y).between(p["b"], p["d"]) & in_polygon(F.col(x), F.col(y), p["r"])
    hit = pts.join(cells, ["__x", "__y"]).withColumn("polygon_no", F.get(F.filter("__in", holds), F.lit(0))["polygon_no"])
    return hit.where("polygon_no is not null").drop("__x", "__y", "__in")


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of a ring; positive runs counter-clockwise."""
    n = F.size(ring)
    term = lambda i: F.get(ring, i)["x"] * F.get(ring, F.pmod(i + 1, n))["y"] - F.get(ring, F.pmod(i + 1, n))["x"] * F.get(ring, i)["y"]
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda a, v: a + v) / 2


def repair_ring(ring: Column) -> Column:
    """Neighbouring repeats dropped, counter-clockwise, closed; null under three different points."""
    keep = F.filter(ring, lambda p, i: F.get(ring, i - 1).isNull() | (F.get(ring, i - 1) != p))
    keep = F.when((F.size(keep) > 1) & (F.get(keep, F.lit(0)) == F.element_at(keep, -1)), F.slice(keep, F.lit(1), F.size(keep) - 1)).otherwise(keep)
    turned = F.when(ring_area(keep) < 0, F.reverse(keep)).otherwise(keep)
    return F.when(F.size(keep) >= 3, F.concat(turned, F.slice(turned, 1, 1)))


def box(points: Column) -> Column:
    """Bounding box of an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def tile_pixel(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator pixel of a point at a zoom."""
    size = 256.0 * (1 << zoom)
    s = F.sin(F.radians(lat))
    return (lon + 180.0) / 360.0 * size, (0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * size


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes over their union."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)
