"""Secret scans: pattern spans, and corpus-wide ownership of candidate values."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, spread_join

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # [0-9a-f]+ takes whole runs, so the 16 may stand in the pattern
HINT = re.compile(r"(?:passw(?:or)?d|secret|token|api_?key)", re.I | re.A)
KINDS = ("assign", "access", "hex", "mixed")
#: What the base patterns miss: long runs of letters and digits of both cases, as keys in base64 or base62 look.
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])")
#: A value in the texts of so many owners, or in so many repositories, is an example that was copied around.
OWNERS, REPOSITORIES = 3, 20
#: What stands in values that were never secret, and the least bits per character of one that could be.
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|change_?me|your_?|insert|redacted|password|secret|x{4}|\*{3}|0{6}|1234567|abcdef[gh]", re.I)
LEAST_BITS = 2.2


def entropy(s: str) -> float:
    """Bits per character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, in order."""
    out = []
    if HINT.search(text):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def looks_live(value: str) -> bool:
    """Whether a value could be somebody's: no placeholder's words or runs, and not of a few characters over and over."""
    return not PLACEHOLDER.search(value) and entropy(value) >= LEAST_BITS


def more_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates beside the base: upper and lower case and digits in one run of high entropy that no base span
    touches. Base spans are in order of their start; both lists are walked once."""
    out, i, reach = [], 0, 0
    for m in MIXED.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach, i = max(reach, base[i][2]), i + 1
        v = m[0]
        if reach <= m.start() and re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and entropy(v) >= 3.5:
            out.append((m.start(), 3, m.end(), v))
    return out


def _scan(batches):
    import pyarrow as pa

    cand = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("h", pa.binary()), ("fit", pa.bool_())]))
    for b in batches:
        at = 0
        for run in slices([t or "" for t in b.column(2).to_pylist()]):
            rows = []
            for t in run:
                base = base_spans(t)
                rows.append([{"start": s, "kind": k, "end": e, "h": hashlib.blake2b(v.encode(), digest_size=16).digest(), "fit": looks_live(v)} for s, k, e, v in base + more_spans(t, base)])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(run)), b.column(1).slice(at, len(run)), pa.array(rows, cand)], names=["doc_id", "owner", "found"])
            at += len(run)


def candidates(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """(row, doc_id, owner, found) per row of docs."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{owner_col}`").cast("string").alias("owner"), F.col(f"`{text_col}`").cast("string").alias("text"))
    d = d.mapInArrow(_scan, "doc_id long, owner string, found array<struct<start:int,kind:int,end:int,h:binary,fit:boolean>>")
    return scratch.save(d.withColumn("row", F.monotonically_increasing_id()), "found")


def holders(found: DataFrame) -> DataFrame:
    """(h, n_documents, n_owners) per candidate value: distinct repositories (documents) and distinct owners. Rows of
    one document count once, so do null ids and null owners. Each step sums before it shuffles, and the first is dealt
    by value, owner and document together, so no value gathers in one task."""
    each = found.select(F.explode(F.array_distinct("found.h")).alias("h"), "owner", "doc_id").distinct()
    per = each.groupBy("h", "owner").agg(F.count("*").alias("n"))
    return per.groupBy("h").agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_owners"))


def scan(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", owners: int = OWNERS, repositories: int = REPOSITORIES
) -> DataFrame:
    """(row, doc_id, owner, found, live) per row of docs. found: array of (start, kind, end, h, fit), kind an index
    into KINDS, h a hash of the value, fit whether it could be a secret by its looks. live: those that are fit and
    whose value fewer than `owners` owners and fewer than `repositories` repositories hold: they look like somebody's
    own; the others are examples that were copied around. A document is a repository, owner_col names its owner.

    Null and empty texts have no spans; a null owner counts as one owner; repeated rows come back repeated and count
    once for ownership; only three columns are read, so others' names can't clash. Whole texts are scanned once. What
    is shuffled is hashes; the rows of a value that a third of all documents hold are dealt over several tasks.
    """
    d = candidates(docs, scratch, id_col, text_col, owner_col)
    wide = holders(d).where((F.col("n_owners") >= owners) | (F.col("n_documents") >= repositories))
    wide = scratch.save(wide.select("h", F.col("n_documents").alias("n")), "wide")
    held = d.select("row", F.explode(F.array_distinct("found.h")).alias("h"))
    copied = spread_join(held, wide.select("h"), ["h"], wide, wide.agg(F.sum("n")).first()[0] or 0).groupBy("row").agg(F.collect_list("h").alias("copied"))
    d = d.join(copied, "row", "left")
    return d.withColumn("live", F.expr("filter(found, f -> f.fit and (copied is null or not array_contains(copied, f.h)))")).drop("copied")


def ownership(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """(h, n_documents, n_owners) per candidate value of the corpus."""
    return holders(candidates(docs, scratch, id_col, text_col, owner_col))


def span_text(column: str, kinds: tuple[str, ...] = KINDS) -> str:
    """SQL: kind:start:end by start, then kind."""
    names = ", ".join(f"'{k}'" for k in kinds)
    return f"array_join(transform(array_sort({column}), f -> concat(element_at(array({names}), f.kind + 1), ':', f.start, ':', f.end)), ',')"


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op6"))
    base = "filter(found, f -> f.kind < 3)"
    return got.selectExpr(
        "doc_id",
        *[f"cast(size(filter(found, f -> f.kind = {i})) as long) AS n_{k}" for i, k in enumerate(KINDS[:3])],
        f"sha2({span_text(base)}, 256) AS base_sha256",
        span_text(f"concat({base}, filter(live, f -> f.kind = 3))") + " AS spans",
        "cast(size(live) as long) AS n_live",
        "cast(size(found) - size(live) as long) AS n_copied",
    )
