"""Best-fit packing of tokenized documents into sequences of a fixed capacity, planned on the length histogram."""

from __future__ import annotations

import bisect
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices
from .tokens import word_encoder

CAPACITY = 4096


class Bins:
    """Bins by free room, held as runs of consecutive numbers, so the plan doesn't grow with the number of documents."""

    def __init__(self, cap: int):
        self.cap, self.next, self.runs, self.rooms, self.rows = cap, 0, {}, [], []

    def free(self, room: int, start: int, n: int) -> None:
        if n and room:
            if room not in self.runs:
                self.runs[room] = []
                bisect.insort(self.rooms, room)
            self.runs[room].append((start, n))

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.remove(room)
        return run

    def put(self, length: int, first: int, n: int, per: int, start: int, room: int) -> None:
        """Items first..first+n-1 of this length go `per` to a bin from bin `start` on."""
        self.rows.append((length, first, n, per, start, self.cap - room))

    def fill(self, length: int, first: int, n: int, room: int, start: int, bins: int) -> int:
        """As many of n items as the run of bins holds; returns how many."""
        per = room // length
        full = min(bins, n // per)
        if full:
            self.put(length, first, full * per, per, start, room)
            self.free(room - per * length, start, full)
        left = n - full * per
        if full < bins and left:
            self.put(length, first + full * per, left, left, start + full, room)
            self.free(room - left * length, start + full, 1)
            self.free(room, start + full + 1, bins - full - 1)
            return n
        self.free(room, start + full, bins - full)
        return full * per


def plan(counts: dict[int, int], cap: int = CAPACITY) -> tuple[list[tuple], int]:
    """(rows, number of bins) from how many items have each length.

    A row (length, first, n, per, start, offset): items first.. of that length, in groups of `per`, go to bins start..
    at that offset. Items above a third of the capacity stand at most two to a bin: the largest takes the largest
    partner that fits. Smaller ones, longest first, go where they leave least room. Steps depend on the number of
    different lengths only.
    """
    b, left = Bins(cap), {k: v for k, v in counts.items() if v}
    used = dict.fromkeys(left, 0)
    third = sorted(k for k in left if 3 * k > cap)

    def partner(length: int) -> int | None:
        i = bisect.bisect_right(third, min(cap - length, length)) - 1
        return third[i] if i >= 0 else None

    def place(length: int, n: int, per: int, start: int, room: int) -> None:
        b.put(length, used[length], n, per, start, room)
        used[length] += n
        left[length] -= n
        if not left[length]:
            third.remove(length)

    while third:
        big = third[-1]
        mate = partner(big)
        if mate == big and left[big] > 1:
            k = left[big] // 2
            place(big, 2 * k, 2, b.next, cap)
            b.free(cap - 2 * big, b.next, k)
            b.next += k
            continue
        if mate == big:  # one left over: the next smaller
            i = third.index(big) - 1
            mate = third[i] if i >= 0 else None
        k = left[big] if mate is None else min(left[big], left[mate])
        start = b.next
        b.next += k
        place(big, k, 1, start, cap)
        if mate is not None:
            place(mate, k, 1, start, cap - big)
        b.free(cap - big - (mate or 0), start, k)
    for length in sorted((k for k in left if 3 * k <= cap), reverse=True):
        n, first = left[length], 0
        while n:
            i = bisect.bisect_left(b.rooms, length)
            if i < len(b.rooms):
                room = b.rooms[i]
                start, bins = b.take(room)
            else:
                room, bins = cap, -(-n // (cap // length))
                start, b.next = b.next, b.next + bins
            k = b.fill(length, first, n, room, start, bins)
            first, n = first + k, n - k
    return b.rows, b.next


def _tokenize(batches, tokenizer: str, end: int, cap: int):
    """Pieces of each document, numbered by length within the task."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    enc, task, seen = word_encoder(tokenizer), TaskContext.get().partitionId(), {}
    tail = np.array([end], dtype="<u4").tobytes()
    for b in batches:
        ids_of = iter(b.column(0).to_pylist())
        for run in slices([t or "" for t in b.column(1).to_pylist()]):
            rows = []
            for data in enc.batch(run):
                data, doc = data + tail, next(ids_of)
                for k, at in enumerate(range(0, len(data), 4 * cap)):
                    ids = data[at : at + 4 * cap]
                    n = len(ids) // 4
                    rows.append((doc, k, at // 4, n, task, seen.get(n, 0), ids))
                    seen[n] = seen.get(n, 0) + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "task", "k", "ids"])


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 1, cap: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, task, k, ids): token ids, little-endian unsigned 32-bit, in pieces of at most cap."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        partial(_tokenize, tokenizer=tokenizer, end=end, cap=cap), "doc_id long, piece int, start long, length long, task int, k long, ids binary"
    )


def _place(batches, rows):
    """Bin and offset of item i of a length by binary search in the plan."""
    import numpy as np
    import pyarrow as pa

    length, first, _, per, start, offset = rows
    for b in batches:
        n, i = (b.column(c).to_numpy(zero_copy_only=False) for c in (b.schema.get_field_index("length"), b.schema.get_field_index("i")))
        at = np.searchsorted(length << 44 | first, n << 44 | i, side="right") - 1
        j = i - first[at]
        keep = [c for c in b.schema.names if c != "i"]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(start[at] + j // per[at]), pa.array(offset[at] + j % per[at] * n)], names=[*keep, "sequence_id", "offset"]
        )


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str = "word_bpe_49k.json", end: int = 1, cap: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """(doc_id, piece, start, length, [ids,] sequence_id, offset) per piece of at most cap tokens.

    Null and empty texts hold the end id alone. Rows with null ids or repeated ids are packed like any other. Very
    long texts are cut into pieces of cap tokens. No rows: no pieces. Only two columns of docs are read. The driver
    gets the histogram of lengths (at most cap rows); the plan made of it is sent to the tasks and its size depends
    on cap, not on the corpus. `columns` are expressions over the stored piece that the result carries along.
    """
    import numpy as np

    stored = scratch.save(pieces(docs, tokenizer, end, cap, id_col, text_col), "pieces")
    counts = scratch.save(stored.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    rows, _ = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, cap)
    rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6).T
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    keep = ["doc_id", "piece", "start", "length", *columns]
    numbered = stored.selectExpr("task", "k", *keep).join(base.hint("merge"), ["length", "task"])  # grows with the tasks, so never a broadcast
    numbered = numbered.select(*[F.col(c.split(" AS ")[-1]) for c in keep], (F.col("base") + F.col("k")).alias("i"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name != "i")
    return numbered.mapInArrow(partial(_place, rows=rows), f"{schema}, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, scratch, columns=("crc32(ids) AS ids_crc32",))
