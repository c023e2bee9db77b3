"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, filesystem

#: Rotated components in the partial sums, candidates in a block, queries in a block, largest vectors that seed the bounds.
HEAD, BLOCK, QUERIES, SEED = 16, 8192, 1024, 4096


def quantized(table: DataFrame, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, vec_id, v, sq) of the vectors that take part: v = floor(scale * x) as longs, sq its squared length, row a
    number of its own for each row of the table.

    Null vectors, vectors that hold null, NaN or infinity, empty ones and rows with a null id take no part. Rows that
    repeat an id, or an id and its vector, all take part.
    """
    x = F.col("x")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    d = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    d = d.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(fine)
    d = d.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    return d.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _matrix(column, dim: int):
    """Longs of an Arrow list column as rows; shorter vectors end in zeros."""
    import numpy as np

    n = len(column)
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    out = np.zeros((n, dim), dtype=np.int64)
    size = np.diff(at)
    out[np.repeat(np.arange(n), size), np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], size)] = flat[at[0] : at[-1]]
    return out


def _gram(batches, dim: int):
    import numpy as np
    import pyarrow as pa

    total = np.zeros((dim, dim))
    for b in batches:
        m = _matrix(b.column(0), dim).astype(np.float64)
        total += m.T @ m
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["at", "g"])


def rotation(vectors: DataFrame, dim: int):
    """Orthonormal columns by descending share of the squared length: right singular vectors of all vectors.

    Tasks sum their Gram matrices; Spark adds them; the driver gets dim * dim numbers.
    """
    import numpy as np

    rows = vectors.select("v").mapInArrow(partial(_gram, dim=dim), "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()
    g = np.zeros(dim * dim)
    for r in rows:
        g[r["at"]] = r["g"]
    return np.ascontiguousarray(np.linalg.eigh(g.reshape(dim, dim))[1][:, ::-1])


def _read(folder: str, columns: list[str], rows: int):
    """Batches of a stored table, one after another."""
    import pyarrow.dataset as ds

    fs, at = filesystem(folder)
    table = ds.dataset([i.path for i in fs.get_file_info(_selector(at)) if i.path.endswith(".parquet")], filesystem=fs, format="parquet")
    return table.to_batches(columns=columns, batch_size=rows, batch_readahead=1, fragment_readahead=1)


def _selector(at: str):
    from pyarrow import fs

    return fs.FileSelector(at)


def _dots(a, b, i, j, most: float):
    """Integer inner products of row pairs (i, j)."""
    import numpy as np

    if most < 2**52:  # every partial sum is a whole number that a double holds
        return np.einsum("ij,ij->i", a[i].astype(np.float64), b[j].astype(np.float64)).astype(np.int64)
    return np.einsum("ij,ij->i", a[i], b[j])


class _Best:
    """Per query the k best (score, id) so far"""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k, self.q = k, np.zeros(0, dtype=np.int64)
        self.c, self.s, self.n = self.q.copy(), self.q.copy(), n

    def add(self, q, c, s):
        import numpy as np

        q, c, s = np.concatenate([self.q, q]), np.concatenate([self.c, c]), np.concatenate([self.s, s])
        o = np.lexsort((c, -s, q))
        q, c, s = q[o], c[o], s[o]
        first = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.c, self.s = q[keep], c[keep], s[keep]

    def worst(self):
        """The k-th score of each query, -inf where there are fewer."""
        import numpy as np

        out = np.full(self.n, -np.inf)
        count = np.bincount(self.q, minlength=self.n)
        last = np.searchsorted(self.q, np.arange(self.n), side="right") - 1
        full = count >= self.k
        out[full] = self.s[last[full]]
        return out


def _search(batches, queries: str, turn, dim: int, k: int):
    """Candidates, longest first, in blocks against every block of queries."""
    import numpy as np
    import pyarrow as pa

    def blocks():
        held = []
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim)))
            if sum(len(h[0]) for h in held) >= BLOCK:
                yield map(np.concatenate, zip(*held, strict=True))
                held = []
        if held:
            yield map(np.concatenate, zip(*held, strict=True))

    for crow, cid, cv in blocks():
        cf = cv.astype(np.float64)
        norm = np.sqrt((cf * cf).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        crow, cid, cv, cf, norm = crow[order], cid[order], cv[order], cf[order], norm[order]
        cr = cf @ turn
        chead, crest = cr[:, :HEAD], np.sqrt((cr[:, HEAD:] ** 2).sum(axis=1))
        for b in _read(queries, ["row", "vec_id", "v", "theta"], QUERIES):
            qrow, qid, qv, theta = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim), b.column(3).to_numpy(zero_copy_only=False).copy()
            qf = qv.astype(np.float64)
            qn = np.sqrt((qf * qf).sum(axis=1))
            slack = 1e-9 * qn * norm[0] + 1e-3
            live = np.flatnonzero(qn * norm[0] + slack >= theta)  # no candidate is longer than the first
            if not len(live):
                continue
            qr = qf[live] @ turn
            qhead, qrest, best = qr[:, :HEAD], np.sqrt((qr[:, HEAD:] ** 2).sum(axis=1)), _Best(len(live), k)
            for at in range(0, len(cid), 1024):
                to = min(at + 1024, len(cid))
                bound = np.maximum(theta[live], best.worst())
                on = np.flatnonzero(qn[live] * norm[at] + slack[live] >= bound)
                if not len(on):
                    break
                top = qhead[on] @ chead[at:to].T + qrest[on][:, None] * crest[None, at:to] + slack[live][on][:, None]
                i, j = np.nonzero((top >= bound[on][:, None]) & (qrow[live][on][:, None] != crow[None, at:to]))
                if len(i):
                    s = _dots(qv[live], cv, on[i], at + j, float(qn.max() * norm[0]))
                    good = s >= bound[on[i]]
                    best.add(on[i][good], cid[at + j[good]], s[good])
            if len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qrow[live][best.q], qid[live][best.q], best.c, best.s)], names=["row", "query_id", "vec_id", "score"])


def _seeded(batches, seed: str, dim: int, k: int):
    """A lower bound on each query's k-th score from the longest candidates."""
    import numpy as np
    import pyarrow as pa

    parts = [(b.column(0).to_numpy(), _matrix(b.column(1), dim)) for b in _read(seed, ["row", "v"], SEED)]
    crow = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    cf = np.concatenate([p[1] for p in parts]).astype(np.float64) if parts else np.zeros((0, dim))
    for b in batches:
        q = _matrix(b.column(2), dim).astype(np.float64)
        theta = np.full(len(q), -np.inf)
        for at in range(0, len(q), 256):
            s = q[at : at + 256] @ cf.T
            s[b.column(0).to_numpy()[at : at + 256, None] == crow[None, :]] = -np.inf
            if s.shape[1] >= k:
                low = np.partition(s, -k, axis=1)[:, -k]
                theta[at : at + 256] = low - np.where(np.isfinite(low), 1e-9 * np.abs(low) + 1e-3, 0)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(theta)], names=["row", "vec_id", "v", "theta"])


def top_k(table: DataFrame, scratch: Scratch, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with id divisible by `every` its k best other rows, ties to the
    smaller id; all of them where there are fewer. See quantized() for which rows take part; an empty table gives no
    rows; vectors shorter than the longest end in zeros; scores must fit in a long. A row's doubles are candidates
    for it as any other row is: rows that repeat an id each get k ranks of their own, and an id may hold several.

    Candidates are dealt by range of length, longest first. Queries are read from shared storage a block at a time,
    so no task holds more than a block of each side, and a block whose longest vector can't reach a query's bound is
    passed over. Every task returns only what beats the bounds of the longest `SEED` vectors.
    """
    all_ = scratch.save(quantized(table, scale, id_col, vec_col), "vectors")
    dim = all_.agg(F.max(F.size("v"))).first()[0] or 1
    turn = rotation(all_, dim)
    seed = scratch.path("seed")
    all_.orderBy(F.desc("sq"), "row").limit(SEED).select("row", "v").coalesce(1).write.parquet(seed)
    queries = scratch.path("queries")
    q = all_.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    q.repartition("row").mapInArrow(partial(_seeded, seed=seed, dim=dim, k=k), "row long, vec_id long, v array<long>, theta double").write.parquet(queries)
    sorted_ = all_.repartitionByRange(F.desc("sq"), F.col("row")).sortWithinPartitions(F.desc("sq")).select("row", "vec_id", "v")
    found = sorted_.mapInArrow(partial(_search, queries=queries, turn=turn, dim=dim, k=k), "row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op4"))


OP4_SQL = """
WITH n AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(embedding) > 0 AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
u AS (SELECT row, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM n),
v AS (SELECT row, vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS c FROM u),
s AS (SELECT q.row, q.vec_id AS query_id, c.row AS other, c.vec_id, CAST(sum(q.c * c.c) AS BIGINT) AS score
      FROM v q JOIN v c ON q.i = c.i AND q.row <> c.row WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
