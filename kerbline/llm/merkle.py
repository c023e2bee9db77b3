"""Merkle manifest of a data set: a tree per source over its rows, one tree over the sources, and a proof per row.

The node store is a set of Parquet tables partitioned by level. Leaves are range-sorted runs; a round streams runs of
FAN ** SPAN consecutive nodes of one level and writes the SPAN levels above them, and the next round reads only the
last of those. Proofs come back from the store from the top down: of a run, its levels and the path above it meet by
coordinate (tree, block, level, place) in one sorted scan. No task holds more than one run and its levels, whatever
the size of a source.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Nodes that become one node, and levels of one round: a run is FAN ** SPAN nodes.
FAN, SPAN = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of the parts set side by side."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its path give. A path has a step per level, each ended by `/`: the digests left of the
    own place, a dot, those right of it."""
    for step in path.split("/")[:-1]:
        left, right = step.split(".")
        leaf = digest(left, leaf, right)
    return leaf


def siblings(path: str) -> str:
    """The digests of a path, level by level, left to right."""
    return path.replace(".", "").replace("/", "")


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 over the fields, each `-` if null, else its UTF-8 length in bytes, a colon and its text."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def leaves(rows: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """(id, g, digest, tampered) per row; g is the group, null as '' and others after a mark, so that nulls stand first.

    tampered gives other values for some fields and `when` the rows that get them; elsewhere the column is null.
    """
    plain = {f: F.col(f"`{f}`") for f in fields}
    other = leaf_digest([(tampered or {}).get(f, c) for f, c in plain.items()])
    return rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("g"),
        leaf_digest(list(plain.values())).alias("digest"),
        F.when(when if when is not None else F.lit(False), other).alias("tampered"),
    )


def placed(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows(g, ...) with pos, their place among the rows of their g by `order` (nulls first), and n, their number.

    One range sort over g and order, so a group of any size lies over many tasks; rows alike in all of that are dealt
    by a number of their own. Places are the row numbers of the sorted partitions, shifted by the rows of the same g
    in earlier ones.
    """
    rows = rows.withColumn("__own", F.monotonically_increasing_id())
    runs = rows.repartitionByRange("g", *order, "__own").sortWithinPartitions("g", *order, "__own").drop("__own")
    runs = scratch.save(runs.withColumn("__at", F.monotonically_increasing_id()), f"{name}-sorted").withColumn("__part", F.shiftright("__at", 33))
    parts = runs.groupBy("g", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("g", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(Window.partitionBy("g")).alias("n"))
    out = runs.join(scratch.save(shift, f"{name}-parts"), ["g", "__part"])
    return scratch.save(out.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift"), f"{name}-placed")


def _by_block(batches):
    """Sorted rows as (g, block, list of rows), wherever a batch ends."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row[2:])
    if held:
        yield key, held


def _emit(rows, names: list[str], types: list, most: int = 8192):
    import pyarrow as pa

    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _levels(batches, base: int, span: int, fan: int):
    """The `span` levels above each run of level `base`; a tree's last level is its root."""
    import pyarrow as pa

    def rows():
        for (g, block), run in _by_block(batches):
            n, nodes = run[0][1], [r[2] for r in run]
            size = -(-n // fan**base)
            for up in range(1, span + 1):
                if size <= 1:
                    break
                size = -(-size // fan)
                nodes = [digest(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
                first = block * fan ** (span - up)
                for i, d in enumerate(nodes):
                    yield base + up, g, first + i, n, d, size == 1

    yield from _emit(rows(), ["level", "g", "pos", "n", "digest", "root"], [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()])


@dataclass
class Trees:
    """leaves(g, pos, n, digest, ...), rounds of nodes(level, g, pos, n, digest, root) bottom up, roots(g, digest, n)."""

    leaves: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame
    fan: int
    span: int


def build(placed_: DataFrame, scratch: Scratch, name: str, fan: int = FAN, span: int = SPAN) -> Trees:
    """A tree per g. Every `fan` consecutive nodes become one, the last run may have fewer, until one is left."""
    rounds, todo, base = [], placed_.where("n > 1").select("g", "pos", "n", "digest"), 0
    roots = placed_.where("n = 1").select("g", "digest", "n")
    while True:
        runs = todo.withColumn("block", F.floor(F.col("pos") / fan**span).cast("long")).select("g", "block", "pos", "n", "digest")
        runs = runs.repartition("g", "block").sortWithinPartitions("g", "block", "pos")
        made = scratch.save(runs.mapInArrow(partial(_levels, base=base, span=span, fan=fan), "level int, g string, pos long, n long, digest string, root boolean"), f"{name}-nodes-{base}", by=["level"])
        rounds.append(made)
        roots = roots.union(made.where("root").select("g", "digest", "n"))
        base += span
        todo = made.where((F.col("level") == base) & ~F.col("root")).select("g", "pos", "n", "digest")
        if todo.isEmpty():
            return Trees(placed_, rounds, roots, fan, span)


def height(n: int, fan: int) -> int:
    """Levels above n leaves."""
    up = 0
    while n > 1:
        n, up = -(-n // fan), up + 1
    return up


def _paths(batches, base: int, span: int, fan: int, told: bool):
    """Each block's item paths up to the root: their own levels first, then the block's own path. told: the items are
    rows, of which digests of path and folding leave the task instead of the path."""
    import pyarrow as pa

    def rows():
        for (g, block), run in _by_block(batches):
            _, n, above, _, _, subroot = run[0]  # level -1 sorts first
            levels = [[] for _ in range(span)]
            for level, _, d, *_ in run[1:]:
                levels[level - base].append(d)
            items, up = run[1 : 1 + len(levels[0])], min(span, height(n, fan) - base)
            for i, (_, pos, d, id_, tampered, _) in enumerate(items):
                steps, at = [], i
                for run_ in levels[:up]:
                    low = at - at % fan
                    steps.append("".join(run_[low:at]) + "." + "".join(run_[at + 1 : low + fan]) + "/")
                    at //= fan
                path = "".join(steps) + above
                yield (id_, d, subroot, digest(siblings(path)), fold(d if tampered is None else tampered, path)) if told else (g, pos, path, subroot)

    if told:
        yield from _emit(rows(), ["id", "leaf", "subroot", "proof_sha256", "folded_root"], [pa.int64(), *[pa.string()] * 4])
    else:
        yield from _emit(rows(), ["g", "pos", "path", "subroot"], [pa.string(), pa.int64(), pa.string(), pa.string()])


def paths(trees: Trees, above: DataFrame, scratch: Scratch, name: str, told: bool = False) -> DataFrame:
    """(g, pos, path, subroot) per leaf; above(g, n, path, subroot) is the path of each tree's root. With told the
    leaves have id and tampered, and (id, leaf, subroot, proof_sha256, folded_root) come out.

    From the last round down to the first: the paths of a round's items are the block paths of the round below.
    """
    fan, span = trees.fan, trees.span
    none = lambda kind: F.lit(None).cast(kind)
    tops = above.withColumn("round", F.greatest(F.lit(0), F.ceil(sum((F.when(F.col("n") > float(fan) ** k, 1).otherwise(0) for k in range(40)), F.lit(0)) / span) - 1).cast("int"))
    tops, lower = scratch.save(tops, f"{name}-tops"), None
    for k in reversed(range(len(trees.rounds))):
        base = k * span
        heads = tops.where(F.col("round") == k).select("g", F.lit(0).cast("long").alias("block"), "n", "path", "subroot")
        if lower is not None:
            heads = heads.union(lower.join(above.select("g", "n"), "g").select("g", F.col("pos").alias("block"), "n", "path", "subroot"))
        heads = heads.select("g", "block", F.lit(-1).alias("level"), F.col("n").alias("pos"), F.col("path").alias("digest"), none("long").alias("id"), none("string").alias("tampered"), "subroot")
        block = lambda level: F.floor(F.col("pos") / (float(fan) ** span / F.pow(F.lit(float(fan)), level - base))).cast("long")
        items = trees.leaves if k == 0 else trees.rounds[k - 1].where((F.col("level") == base) & ~F.col("root"))
        id_, tampered = (F.col("id"), F.col("tampered")) if k == 0 and told else (none("long"), none("string"))
        items = items.select("g", block(F.lit(base)).alias("block"), F.lit(base).alias("level"), "pos", "digest", id_.alias("id"), tampered.alias("tampered"), none("string").alias("subroot"))
        nodes = trees.rounds[k].where(F.col("level") < base + span).select("g", block(F.col("level")).alias("block"), "level", "pos", "digest", none("long").alias("id"), none("string").alias("tampered"), none("string").alias("subroot"))
        run = heads.union(items).union(nodes).repartition("g", "block").sortWithinPartitions("g", "block", "level", "pos")
        last = k == 0 and told
        got = run.mapInArrow(partial(_paths, base=base, span=span, fan=fan, told=last), "id long, leaf string, subroot string, proof_sha256 string, folded_root string" if last else "g string, pos long, path string, subroot string")
        lower = got if last else scratch.save(got, f"{name}-paths-{k}")
    return lower


def manifest(docs: DataFrame, scratch: Scratch, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", tampered: dict[str, Column] | None = None, when: Column | None = None, span: int = SPAN) -> tuple[Trees, Trees]:
    """The trees over the rows of each group, in ascending order of id, and the tree over the groups' roots."""
    rows = scratch.save(leaves(docs, fields, id_col, group_col, tampered, when), "leaves")
    groups = build(placed(rows, ["id", "digest"], scratch, "rows"), scratch, "rows", span=span)
    tops = groups.roots.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("n").alias("rows"), "digest")
    return groups, build(placed(tops, ["of"], scratch, "groups"), scratch, "groups", span=span)


def proofs(docs: DataFrame, scratch: Scratch, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", tampered: dict[str, Column] | None = None, when: Column | None = None, told: bool = True, span: int = SPAN) -> DataFrame:
    """Per row (id, leaf, subroot, root, proof_sha256, folded_root, verified), or (g, pos, path, subroot, root) with
    the whole path where told is False.

    A row's leaf is the sha256 of its fields; leaves of a group ascend by id (null first), equal ids by leaf, and
    repeated rows are leaves of their own. The null group is a group, ordered before all others. Fields may be null,
    empty or long; columns other than the fields are not read, so their names can't clash. An empty table has no root
    and gives no rows. tampered and `when` (null counts as no) say which rows are folded with other values;
    folded_root is what their leaf and the untampered siblings give, and verified whether that is the root.
    """
    groups, top = manifest(docs, scratch, fields, id_col, group_col, tampered, when, span)
    root = top.roots.first()
    root = None if root is None else root["digest"]
    none = F.lit(None).cast("string")
    up = paths(top, top.roots.select("g", "n", F.lit("").alias("path"), none.alias("subroot")), scratch, "groups")
    up = up.join(top.leaves.select("pos", "of", "rows", F.col("digest").alias("own")), "pos").select(F.col("of").alias("g"), F.col("rows").alias("n"), "path", F.col("own").alias("subroot"))
    got = paths(groups, scratch.save(up, "above"), scratch, "rows", told).withColumn("root", F.lit(root).cast("string"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root")) if told else got


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    bare = {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    got = proofs(docs, Scratch(spark, "op13"), tampered=bare, when=even & F.contains("text", F.lit("\n")))
    return got.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
t AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS bare FROM d),
c0 AS (SELECT i, CASE WHEN i % 2 = 1 THEN xor(3988292384, i // 2) ELSE i // 2 END AS c1 FROM range(256) r(i)),
c AS (SELECT i, c1, 1 AS k FROM c0 UNION ALL SELECT i, CASE WHEN c1 % 2 = 1 THEN xor(3988292384, c1 // 2) ELSE c1 // 2 END, k + 1 FROM c WHERE k < 8),
ct AS (SELECT list(c1 ORDER BY i) AS m FROM c WHERE k = 8),
e AS (SELECT t.*, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, x: CAST(xor(m[xor(a, x) % 256 + 1], a // 256) AS BIGINT)) AS crc FROM t, ct),
l AS (SELECT doc_id, g, leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN bare ELSE leaf END AS used,
  row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM e WINDOW w AS (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf)),
s AS (SELECT g, 0 AS level, pos, n, leaf AS h FROM l
  UNION ALL SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM s WHERE n > 1 GROUP BY g, level, pos // 3, n),
o AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM s WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, subroot AS h FROM o
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 3, n),
a AS (SELECT s.g, s.level, s.pos, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < s.pos), '') AS lo, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > s.pos), '') AS hi
  FROM s JOIN s o ON s.g = o.g AND s.level = o.level AND s.pos // 3 = o.pos // 3 WHERE s.n > 1 GROUP BY ALL),
b AS (SELECT s.level, s.pos, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < s.pos), '') AS lo, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > s.pos), '') AS hi
  FROM u s JOIN u o ON s.level = o.level AND s.pos // 3 = o.pos // 3 WHERE s.n > 1 GROUP BY ALL),
p AS (SELECT l.g, l.pos, 0 AS part, a.level, lo, hi FROM l JOIN a ON a.g = l.g AND a.pos = l.pos // CAST(power(3, a.level) AS BIGINT)
  UNION ALL SELECT l.g, l.pos, 1, b.level, lo, hi FROM l JOIN o ON o.g = l.g JOIN b ON b.pos = o.pos // CAST(power(3, b.level) AS BIGINT)),
q AS (SELECT g, pos, list(lo || '.' || hi ORDER BY part, level) AS steps FROM p GROUP BY g, pos),
f AS (SELECT l.doc_id, l.leaf, o.subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(steps, []) AS steps, used FROM l JOIN o ON o.g = l.g LEFT JOIN q ON q.g = l.g AND q.pos = l.pos),
z AS (SELECT *, list_reduce(list_prepend(used, steps), lambda x, y: sha256(split_part(y, '.', 1) || x || split_part(y, '.', 2))) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '.', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z
"""
