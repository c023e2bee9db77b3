"""Near duplicates by SimHash: pigeonhole blocks, then exact Hamming distance, then components."""

from __future__ import annotations

import itertools
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, spread_join
from .graph import components

#: Words of a shingle, and the Jaccard similarity from which two texts are near duplicates, where that decides.
WIDTH, LEAST = 5, 0.8
#: Members of one block bucket that are compared at once; larger buckets are split by more blocks.
BUCKET = 2048
#: Blocks of the finest split.
FINEST = 16


def hashes(text: bytes, width: int = 4, seed: int = 42):
    """Unsigned 64-bit hashes of one text's word shingles, repeats included; a text of fewer words is one shingle."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0d split
    one, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1) if words else 0
    return np.fromiter((one(b" ".join(words[i : i + width]), seed) for i in range(n)), dtype="<u8", count=n)


def majority(h) -> int:
    """The bits that are set in over half of the hashes, unsigned; 0 without hashes."""
    import numpy as np

    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text's word shingles, unsigned; 0 without words."""
    return majority(hashes(text, width, seed))


def _fingerprints(batches, width: int, seed: int):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        got = np.array([fingerprint(t or b"", width, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) per row; fp holds the 64 bits as a signed long. A null text has no words."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t")).mapInArrow(
        partial(_fingerprints, width=width, seed=seed), "id long, fp long"
    )


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of every choice of blocks - distance blocks: two fingerprints within the distance agree on one of them."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cut)]
    return [sum(x) for x in itertools.combinations(parts, blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """Fewest blocks whose keys have enough bits that n random fingerprints fall about one to a bucket."""
    return next(m for m in range(distance + 2, 65) if 64 * (m - distance) // m >= max(1, n).bit_length() - 2 or m >= FINEST)


def star(fp, rep, distance: int):
    """Links of one bucket as (larger, smaller): a spanning star per group of fingerprints that reach each other
    within the distance. fp uint64, rep int64 arrays. Memory grows with the bucket, not with its square."""
    import numpy as np

    order = np.argsort(rep, kind="stable")
    fp, rep, left, us, vs = fp[order], rep[order], np.arange(len(rep)), [], []
    while len(left) > 1:
        centre, todo = left[0], left[:1]
        left = left[1:]
        while len(todo) and len(left):
            some, todo = todo[:256], todo[256:]
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(left), 1 << 14):
                near[at : at + (1 << 14)] = (np.bitwise_count(fp[some, None] ^ fp[left[at : at + (1 << 14)]][None, :]) <= distance).any(axis=0)
            new = left[near]
            left, todo = left[~near], np.concatenate([todo, new])
            us.append(rep[new])
            vs.append(np.full(len(new), rep[centre]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _links(batches, distance: int, most: int | None):
    """Rows sorted by (c, key): links of each bucket with up to `most` members (None: of every bucket), and the
    members of larger ones as hot rows, wherever a batch ends."""
    import numpy as np
    import pyarrow as pa

    none = np.zeros(0, dtype=np.int64)
    held, hot = [none] * 4, None
    for b in itertools.chain(batches, [None]):
        if b is not None and not b.num_rows:
            continue
        cols = held if b is None else [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
        c, key, fp, rep = cols
        n = len(c)
        if not n:
            continue
        edge = np.flatnonzero((c[1:] != c[:-1]) | (key[1:] != key[:-1])) + 1
        at = np.concatenate([[0], edge, [n]])
        last = len(at) - 1
        if b is not None and (most is None or n - at[-2] <= most) and hot != (c[-1], key[-1]):
            last -= 1  # the last bucket may go on in the next batch
        us, vs, hot_fp, hot_rep = [], [], [], []
        for i in range(last):
            s, e = at[i], at[i + 1]
            if most is not None and e - s > most or hot == (c[s], key[s]):
                hot = (c[s], key[s])  # what the next batches hold of this bucket is hot too
                hot_fp.append(fp[s:e])
                hot_rep.append(rep[s:e])
            elif e - s > 1:
                u, v = star(fp[s:e].view(np.uint64), rep[s:e], distance)
                us.append(u)
                vs.append(v)
        held = [x[at[last]:] for x in cols]
        u, v = np.concatenate([none, *us]), np.concatenate([none, *vs])
        hf, hr = np.concatenate([none, *hot_fp]), np.concatenate([none, *hot_rep])
        if len(u) + len(hf):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([u, hr])), pa.array(np.concatenate([v, hf])), pa.array(np.arange(len(u) + len(hf)) >= len(u))],
                names=["u", "v", "hot"],
            )


def _keyed(members: DataFrame, masks: list[int]) -> DataFrame:
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    return members.select("fp", "rep", F.explode(keys).alias("k")).select("k.c", "k.key", "fp", "rep")


def links(distinct: DataFrame, n: int, distance: int, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """distinct(fp, rep) -> (u, v): every two reps within the distance are connected through these links.

    Members of a bucket with more than `bucket` fingerprints are keyed again by more blocks, where the same
    pigeonhole argument holds; none is dropped and no pairs are written out. With FINEST blocks a bucket fixes all but
    a few bits (16 for a distance of 4), so it can't hold more fingerprints than those bits can spell, and it is
    searched whole.
    """
    found, blocks = None, blocks_for(n, distance)
    while True:
        last = blocks >= FINEST
        got = scratch.save(
            _keyed(distinct, block_masks(blocks, distance)).repartition("c", "key").sortWithinPartitions("c", "key").mapInArrow(
                partial(_links, distance=distance, most=None if last else bucket), "u long, v long, hot boolean"
            ),
            f"links-{blocks}",
        )
        part = got.where("not hot").select("u", "v")
        found = part if found is None else found.union(part)
        hot = got.where("hot").select(F.col("v").alias("fp"), F.col("u").alias("rep")).distinct()
        if last or hot.isEmpty():
            return found
        distinct, blocks = scratch.save(hot, f"hot-{blocks}"), min(blocks + 2, FINEST)


def near_duplicates(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4, seed: int = 42, bucket: int = BUCKET
) -> DataFrame:
    """(id, fp, component_id) per input row.

    Fingerprints within `distance` bits link; component_id is the smallest id reachable, itself included. Null,
    empty and blank texts have fingerprint 0 and link like any other. A row with a null id gets a fingerprint and
    the component of its fingerprint, and is never a representative (null if no other row has it). Repeated rows
    come back repeated; rows that share an id count as one document, so their fingerprints link. Other columns of docs are not read, so
    their names can't clash. An empty table gives an empty table.
    """
    fps = scratch.save(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "distinct")
    known = distinct.where("rep is not null").select("fp", "rep")
    edges = links(known, known.count(), distance, scratch, bucket)
    shared = fps.where("id is not null").groupBy("id").agg(F.min("fp").alias("p"), F.max("fp").alias("q")).where("p <> q").select("id")
    same_id = fps.join(shared, "id", "left_semi").distinct().join(known, "fp").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    edges = edges.union(same_id)
    comp = components(edges, scratch)
    named = distinct.join(comp, distinct.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return spread_join(fps, scratch.save(named, "named"), ["fp"], distinct, fps.count()).select("id", "fp", "component_id")


def fp_hex(fp: str):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, scratch).select(F.col("id").alias("doc_id"), fp_hex("fp").alias("fingerprint"), "component_id")


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of docs whose id is not in ids(gone); columns of any names, null ids stay."""
    key = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("gone"))
    return rows.join(ids, "gone", "left_anti").select("row.*")


def keep_one(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", least: float | None = LEAST, width: int = WIDTH) -> DataFrame:
    """Rows of docs without those whose component has a smaller id. Rows with a null id stay.

    Texts whose sets of `width` words are alike by `least` or more (Jaccard) count as near duplicates. Blocks find
    those whose fingerprints are within four bits, and exact sets decide; fingerprints of others differ in more bits
    than blocks of useful size allow, so jaccard.py adds candidates by min-hash bands. With least=None fingerprints
    within four bits count as they are. Columns of any names pass through.
    """
    from . import jaccard  # which builds on this module

    near = near_duplicates(docs, scratch, id_col, text_col, width=width) if least is None else jaccard.near_duplicates(docs, scratch, id_col, text_col, width, least)
    gone = near.where("id > component_id").select(F.col("id").alias("gone")).distinct()
    return without(docs, scratch.save(gone, "gone"), id_col)
