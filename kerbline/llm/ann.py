"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes, error bounds, exact reranking.

A vector is a centre plus a residual; the residual's direction is kept as one sign bit per randomly rotated component,
with two correction scalars: its length, and how well the signs fit it. From these alone the inner product with any
query is estimated without bias, and the estimate's error is bounded. A query's block reads the codes run by run,
passes over runs whose centre and longest residual can't reach the query's k-th score, estimates the rest, and reads
original vectors only where some estimate plus its bound reaches that score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, filesystem
from .topk import _Best, _read

#: Numbers (vectors x components) that centres are fitted on at most, vectors per centre aimed at, centres at most.
SAMPLE, PER_CENTRE, CENTRES = 1_280_000, 8192, 1024
#: Standard deviations of an estimate's error that its bound allows for: one of 740 neighbours at the very margin fails it.
BOUND = 3.0
#: Queries of a block and codes read at once.
QUERIES, SLAB = 2048, 4096


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, vec_id, v) of the vectors that take part, v in doubles, row a number of each row's own.

    Null, empty and zero vectors, vectors that hold null, NaN or infinity, and rows with a null id take no part. Rows
    that repeat an id, or an id and its vector, all take part.
    """
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    d = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    d = d.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine & F.exists("v", lambda c: c != 0.0))
    return d.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def _rows(column, dim: int):
    """Doubles of an Arrow list column as rows; shorter vectors end in zeros."""
    import numpy as np

    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    if len(column) and (np.diff(at) == dim).all():
        return np.ascontiguousarray(flat[at[0] : at[-1]].reshape(-1, dim))
    out, size = np.zeros((len(column), dim)), np.diff(at)
    out[np.repeat(np.arange(len(column)), size), np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], size)] = flat[at[0] : at[-1]]
    return out


def _nearest(x, centres):
    """The centre next to each row."""
    import numpy as np

    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[at : at + 8192] @ centres.T, axis=1) for at in range(0, len(x), 8192)] or [np.zeros(0, dtype=np.int64)])


def centres(vectors: DataFrame, dim: int, n: int, seed: int = 42, rounds: int = 6):
    """Centres of a bounded sample of the vectors (Lloyd's rounds): SAMPLE // dim rows by the hash of their number."""
    import numpy as np

    rows = vectors.orderBy(F.xxhash64("row"), "row").limit(max(1, SAMPLE // dim)).select("v").toArrow()["v"].combine_chunks()
    x = _rows(rows, dim)
    k = max(1, min(CENTRES, len(x) // 16, -(-n // PER_CENTRE)))
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]] if len(x) else np.zeros((1, dim))
    for _ in range(rounds if k > 1 else 1):
        at = _nearest(x, c)
        count = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def rotation(dim: int, seed: int = 42):
    """A random orthonormal matrix."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return np.ascontiguousarray(q * np.sign(np.diag(r)))


def encode(x, centres_, turn):
    """(cell, bits, length, fit): the centre next to each row; the signs of the rotated residual, packed; its length;
    and its cosine with the signs."""
    import numpy as np

    cell = _nearest(x, centres_)
    rest = (x - centres_[cell]) @ turn
    length = np.sqrt((rest * rest).sum(axis=1))
    fit = np.abs(rest).sum(axis=1) / (np.maximum(length, 1e-300) * np.sqrt(x.shape[1]))
    return cell, np.packbits(rest > 0, axis=1, bitorder="little"), length, np.where(length > 0, fit, 1.0)


def estimate(q, q_turned, centre, bits, length, fit, bound: float = BOUND):
    """(estimate, error bound) of the inner products of queries (rows) with the codes of one centre (columns)."""
    import numpy as np

    dim = q.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim, bitorder="little").astype(np.float32) * 2 - 1
    scale = (length / (fit * np.sqrt(dim))).astype(np.float32)
    got = (q_turned.astype(np.float32) @ signs.T) * scale + (q @ centre).astype(np.float32)[:, None]
    wide = length * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit * (bound / np.sqrt(max(1, dim - 1)))
    norm = np.sqrt((q * q).sum(axis=1))
    return got, norm[:, None] * (wide + 1e-5 * (length + np.sqrt((centre * centre).sum())))[None, :]


def _encoded(batches, centres_, turn, parts: int):
    import pyarrow as pa

    dim = turn.shape[0]
    for b in batches:
        if b.num_rows:
            cell, bits, length, fit = encode(_rows(b.column(2), dim), centres_, turn)
            row = b.column(0).to_numpy()
            packed = pa.array([x.tobytes() for x in bits], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row % parts, pa.int32()), pa.array(cell, pa.int32()), b.column(0), b.column(1), packed, pa.array(length), pa.array(fit), b.column(2)],
                names=["part", "cell", "row", "vec_id", "bits", "length", "fit", "v"],
            )


@dataclass
class Index:
    """The codes' folder (a subfolder per part, sorted by cell), and what the codes are relative to."""

    folder: str
    parts: int
    centres: object
    turn: object


def index(vectors: DataFrame, scratch: Scratch, parts: int) -> Index:
    """Codes of every vector in `vectors`, a written table of usable()."""
    n, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = dim or 1
    c, turn = centres(vectors, dim, n), rotation(dim)
    codes = vectors.mapInArrow(partial(_encoded, centres_=c, turn=turn, parts=parts), "part int, cell int, row long, vec_id long, bits binary, length double, fit double, v array<double>")
    folder = scratch.path("codes")
    codes.repartitionByRange("part", "cell", "row").sortWithinPartitions("part", "cell").write.partitionBy("part").parquet(folder)
    return Index(folder, parts, c, turn)


def exact(a, b):
    """Inner products of rows, each summed component by component, so that equal vectors have equal scores."""
    import numpy as np

    s = np.zeros(len(a))
    for d in range(a.shape[1]):
        s += a[:, d] * b[:, d]
    return s


def _block(qrow, qid, q, found: Index, part: int, k: int, bound: float):
    """The k best of one part for a block of queries: (query's row, query's id, id, score)."""
    import numpy as np

    turn, dim = found.turn, found.turn.shape[0]
    q_turned, norm, best = q @ turn, np.sqrt((q * q).sum(axis=1)), _Best(len(q), k)
    fs, at = filesystem(f"{found.folder}/part={part}")  # a part without vectors has no folder
    columns = ["cell", "row", "vec_id", "bits", "length", "fit", "v"]
    for b in _read(f"{found.folder}/part={part}", columns, SLAB) if fs.get_file_info(at).type.name == "Directory" else ():
        cell, row, vec_id, length, fit = (b.column(i).to_numpy() for i in (0, 1, 2, 4, 5))
        bits, x = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).reshape(len(row), -1), None
        cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            centre, theta = found.centres[cell[s]], best.worst()
            reach = q @ centre + norm * length[s:e].max()
            live = np.flatnonzero(reach + 1e-9 * np.abs(reach) >= theta)
            if not len(live):
                continue
            if x is None:
                x = _rows(b.column(6), dim)
            guess, wide = estimate(q[live], q_turned[live], centre, bits[s:e], length[s:e], fit[s:e], bound)
            if e - s > k and not np.isfinite(theta[live]).all():  # the first run: exact scores of the best guesses give a bound
                most = np.argpartition(-guess, k, axis=1)[:, : k + 1]
                i, j = np.repeat(np.arange(len(live)), k + 1), most.ravel()
                score = np.sort(np.where(qrow[live][i] != row[s + j], exact(q[live][i], x[s + j]), -np.inf).reshape(len(live), -1), axis=1)
                theta[live] = np.maximum(theta[live], score[:, 1])
            i, j = np.nonzero((guess + wide >= theta[live][:, None]) & (qrow[live][:, None] != row[None, s:e]))
            for at in range(0, len(i), 1 << 16):
                qi, xj = live[i[at : at + (1 << 16)]], s + j[at : at + (1 << 16)]
                near = np.einsum("ij,ij->i", q[qi], x[xj]) >= theta[qi] - 1e-9 * norm[qi]
                qi, xj = qi[near], xj[near]
                best.add(qi, vec_id[xj], exact(q[qi], x[xj]))
    return qrow[best.q], qid[best.q], best.c, best.s


def _searched(batches, found: Index, k: int, bound: float):
    """Queries sorted by slot, a slot being a block of queries for one part."""
    import numpy as np
    import pyarrow as pa

    def slots():
        held = []
        for b in batches:
            slot = b.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(slot)]])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and held[0][0] != slot[s]:
                    yield held
                    held = []
                held.append((slot[s], b.column(1).to_numpy()[s:e], b.column(2).to_numpy()[s:e], _rows(b.column(3).slice(s, e - s), found.turn.shape[0])))
        if held:
            yield held

    for held in slots():
        got = _block(*(np.concatenate([h[i] for h in held]) for i in (1, 2, 3)), found, int(held[0][0] % found.parts), k, bound)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in got[:3]] + [pa.array(got[3], pa.float64())], names=["row", "query_id", "vec_id", "score"])


def nearest(table: DataFrame, scratch: Scratch, every: int = 20, k: int = 20, bound: float = BOUND, id_col: str = "vec_id", vec_col: str = "embedding", queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with id divisible by `every` the k nearest other rows found by
    inner product, ties to the smaller id; all of them where there are fewer. score is exact, in doubles.

    See usable() for which rows take part. A row is a candidate for every other row, also where they share an id;
    rows that repeat an id each get ranks of their own. Vectors shorter than the longest end in zeros. Other columns
    are not read. An empty table gives no rows. A neighbour is missed only if its estimate falls short of it by more
    than `bound` standard deviations and of the k-th score besides: recall is measured against brute force in the
    tests. Nothing is capped; a task holds a block of queries and a slab of codes.
    """
    vectors = scratch.save(usable(table, id_col, vec_col), "vectors")
    asked = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // queries))
    parts = max(1, -(-2 * scratch.spark.sparkContext.defaultParallelism // blocks))  # 1 once there are many blocks
    found = index(vectors, scratch, parts)
    slots = asked.select((F.pmod(F.xxhash64("row"), F.lit(blocks)) * parts).alias("slot"), "row", "vec_id", "v")
    slots = slots.withColumn("slot", F.explode(F.sequence("slot", F.col("slot") + (parts - 1)))).repartitionByRange(blocks * parts, "slot").sortWithinPartitions("slot")
    got = slots.mapInArrow(partial(_searched, found=found, k=k, bound=bound), "row long, query_id long, vec_id long, score double")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op12"))


#: The exact answer, which these bounds reach on small tables; the tests measure recall on larger ones.
OP12_SQL = """
WITH n AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
      FROM n q JOIN n c ON q.row <> c.row WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
