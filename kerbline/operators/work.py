"""Work queues, choices and sequential picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The n oldest pending rows, marked processing (T6, Z1). A top-n: each task keeps n rows."""
    return queue.where("status = 'pending'").orderBy("created_at", "id").limit(n).withColumn("status", F.lit("processing"))


def recover(queue: DataFrame, as_of: Column, seconds: int = 300) -> DataFrame:
    """Claims older than the lease go back to pending with one more retry."""
    stale = (F.col("status") == "processing") & (F.unix_timestamp(as_of) - F.unix_timestamp("claimed_at") > seconds)
    return queue.withColumn("retry_count", F.when(stale, F.col("retry_count") + 1).otherwise(F.col("retry_count"))).withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def reset(rows: DataFrame, statuses: list[str], guard: Column) -> DataFrame:
    """Rows of these statuses that pass the guard become pending (Q4)."""
    return rows.withColumn("status", F.when(F.col("status").isin(*statuses) & guard, "pending").otherwise(F.col("status")))


def cascade_delete(rows: DataFrame, keys: DataFrame, key: str, busy: str = "processing") -> DataFrame:
    """rows without those of the keys, except keys of which a row is being worked on (Q3)."""
    held = rows.where(F.col("status") == busy).select(key).distinct()
    return rows.join(keys.join(held, key, "left_anti"), key, "left_anti")


def quota(df: DataFrame, group: str, cell: str, n: int, *order: Column) -> DataFrame:
    """The best row of each cell, then the best n of each group."""
    one = Window.partitionBy(group, cell).orderBy(*order)
    best = df.withColumn("__a", F.row_number().over(one)).where("__a = 1")
    return best.withColumn("__b", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__b") <= n).drop("__a", "__b")


def folds(df: DataFrame, block: str, k: int, salt: str) -> DataFrame:
    """(block, fold) of each block in the order of its salted hash (T10). One row per block is ranked."""
    w = Window.orderBy(F.md5(F.concat(F.lit(salt), F.col(block))))
    return df.select(block).distinct().select(block, ((F.row_number().over(w) - 1) % k).cast("long").alias("fold"))


def greedy_cover(df: DataFrame, keys: tuple[str, ...] = ("section",), size: float = 10.0) -> DataFrame:
    """(keys, session_id, order, metres): passes of each section, most classified metres first, then the latest day,
    then the id; a later pass adds only what is uncovered (T8).

    The order doesn't depend on what is covered, so every stretch between two neighbouring ends goes to the first pass
    over it: an interval join, a minimum and a sum. Passes that add nothing are left out.
    """
    k = list(keys)
    ok = df.where("ok and b > a")
    per = df.groupBy(*k, "session_id").agg(F.sum(F.when(F.col("ok"), F.col("b") - F.col("a")).otherwise(0.0)).alias("m"), F.max("day").alias("day"))
    per = per.withColumn("rank", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("m"), F.desc("day"), "session_id"))).select(*k, "session_id", "rank")
    ends = ok.select(*k, F.explode(F.array("a", "b")).alias("a0")).distinct()
    cells = ends.withColumn("a1", F.lead("a0").over(Window.partitionBy(*k).orderBy("a0"))).where("a1 is not null")
    passes = ok.join(per, [*k, "session_id"]).select(*k, "rank", F.col("a").alias("b0"), F.col("b").alias("b1"))
    first = overlap_join(cells, passes, k, size).groupBy(*k, "a0", "a1").agg(F.min("rank").alias("rank"))
    fresh = first.groupBy(*k, "rank").agg(F.sum(F.col("a1") - F.col("a0")).alias("metres"))
    order = F.row_number().over(Window.partitionBy(*k).orderBy("rank")) - 1
    return fresh.join(per, [*k, "rank"]).select(*k, "session_id", order.alias("order"), "metres")


def suppress(boxes: DataFrame, key: str, limit: float = 0.3, most: int = 4) -> DataFrame:
    """Boxes kept largest first while their overlap with each kept one is at most the limit.

    A key's boxes meet in one sorted array and a fold over it, so no key costs a call of Python. A box with an unknown
    side has no area: it comes last and overlaps none."""
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    area = F.when(~F.isnan(size), size)
    row = F.struct(*boxes.columns)
    ranked = F.struct(area.isNull().alias("none"), (-area).alias("less"), F.col("n").alias("n"), row.alias("b"))
    d = boxes.groupBy(key).agg(F.sort_array(F.collect_list(ranked)).alias("all"))

    def overlaps(p: Column, q: Column) -> Column:
        a, b = p["b"], q["b"]
        w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
        h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
        union = -p["less"] + -q["less"] - w * h
        return F.coalesce((union > 0) & (w * h / union > limit), F.lit(False))

    def step(kept: Column, p: Column) -> Column:
        more = (F.size(kept) < most) & ~F.exists(kept, lambda q: overlaps(p, q))
        return F.when(more, F.array_append(kept, p)).otherwise(kept)

    kept = F.aggregate("all", F.filter("all", lambda _: F.lit(False)), step)
    return d.select(F.explode(kept).alias("p")).select("p.b.*")


def merge_latest(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Keyed upsert: of each key the row with the latest stamp, new rows winning ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(stamp, "__new")).alias("r")).select(key, *[f"r.{c}" for c in rest if c != "__new"])
