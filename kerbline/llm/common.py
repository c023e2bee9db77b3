"""Scratch storage, skew helpers and the chunk-table encoder that several operators share."""

from __future__ import annotations

import array
import atexit
import contextlib
import gc
import re
import sys
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where Python workers find this package when it isn't installed (on a cluster: --py-files or an image).
PACKAGE_HOME = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and is local."""
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    at = sc.getConf().get("spark.checkpoint.dir") or (set_.get() if set_.isDefined() else None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kerbline-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Tables and files of one run under the shared folder. Every table is a finished Parquet write, so a lost
    executor costs a re-read and never a recomputation of what stands before it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_HOME)
        self.root = f"{shared_dir(spark)}/kerbline/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._leave)

    def _leave(self) -> None:
        """Results read these tables for as long as the program runs; after that nobody does."""
        with contextlib.suppress(Exception):
            self.clear()

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        at = self.path(name)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(at)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        """Delete one table or folder that path() named."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            for st in fs.listStatus(at):
                if st.getPath().getName().endswith(f"-{name}"):
                    fs.delete(st.getPath(), True)

    def clear(self) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: When release() last asked.
_RELEASED = [0.0]


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver collects its garbage; ask for that every few seconds."""
    if time.monotonic() - _RELEASED[0] > 5:
        gc.collect()
        spark._jvm.System.gc()
        _RELEASED[0] = time.monotonic()


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a plain reference inside a lambda would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op=lambda x, y: x + F.coalesce(y, F.lit(0))) -> Column:
    """Running totals of an array, itself included (or another op of a value and one before it or null), by doubling:
    n log n steps. A fold that appends would copy what it has for every element."""
    back = lambda i, k: i - F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int")), values, lambda acc, k: F.transform(acc, lambda x, i: op(x, F.get(acc, back(i, k)))))


def fence(df: DataFrame) -> DataFrame:
    """df behind a generator of one row each. A filter that stands above is not moved below it, where Catalyst would
    put the columns' expressions in the place of their names and compute them again, in lambdas for every element."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("__row")).select("__row.*")


#: Keys whose rows spread_join() deals over several tasks: at most so many, by its choice of the limit.
HOT_KEYS = 20_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, total: int) -> DataFrame:
    """left inner-joined on keys with right, where a key may hold any share of the rows of left.

    counts has the keys and n, their rows in left; total is the sum of n. Of a key with more than total / HOT_KEYS
    rows the rows of left are dealt over enough tasks and those of right are sent to each. There can't be more than
    HOT_KEYS such keys, so the list of them, which is broadcast, has a bound that doesn't grow with the data, and so
    have the further copies of right. counts and right should be written tables.
    """
    limit = max(64, total // HOT_KEYS)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("__ways")))
    ways = F.coalesce("__ways", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("__way", F.pmod(F.xxhash64(*left.columns), ways).cast("int")).drop("__ways")
    each = right.join(hot, keys, "left").withColumn("__way", F.explode(F.sequence(F.lit(0), ways - 1))).drop("__ways")
    return dealt.join(each, [*keys, "__way"]).drop("__way")


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], scratch: Scratch, name: str, keyed: DataFrame | None = None) -> DataFrame:
    """spread_join() for a left whose keys are still to be counted, in the written table keyed or in left itself."""
    counts = scratch.save((left if keyed is None else keyed).groupBy(*keys).agg(F.count("*").alias("n")), name)
    return spread_join(left, right, keys, counts, counts.agg(F.sum("n")).first()[0] or 0)


def filesystem(uri: str):
    """(file system, path) of a URI, in executors too. Any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:/", uri) else (fs.LocalFileSystem(), uri)


class _Chunks(dict):
    """Packed ids by chunk, made when first asked for and kept while there is room."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str) -> bytes:
        got = self.encode(chunk)
        if len(self) < self.most:
            self[chunk] = got
        return got


class ChunkEncoder:
    """Encodes texts through a table of distinct chunks.

    split(text) gives chunks whose encodings, set side by side, are the encoding of the text, or None where that
    can't be promised; such texts go whole to whole(text). encode(chunk) gives its packed ids. The table keeps at
    most `most` chunks, the first ones met, frequent ones among them; others are encoded again, so memory is bounded
    and the result the same.
    """

    def __init__(self, split, encode, whole, most: int = 400_000):
        self.split, self.encode, self.whole, self.table = split, encode, whole, _Chunks(encode, most)

    def batch(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        get = self.table.__getitem__
        return [self.whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, map(self.split, texts), strict=True)]


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def slices(texts: list[str], chars: int = 2_000_000):
    """Runs of consecutive texts of about so many characters: what a task holds beside its Arrow batch."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run
