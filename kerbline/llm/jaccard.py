"""Near duplicates by Jaccard similarity of word shingles: SimHash blocks, then min-hash bands for candidates, exact sets to decide."""

from __future__ import annotations

from functools import cache, partial
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, counted_join, spread_join
from .graph import components
from .simhash import LEAST, WIDTH, hashes, links, majority

#: Bits in which fingerprints may differ to be candidates by SimHash.
DISTANCE = 4
#: (bands, rows of a band), coarse to fine. A pair of similarity 0.8 shares no band of a level with probability
#: (1 - 0.8 ** rows) ** bands: 6e-7, 1e-8 and 5e-10. Finer bands serve the members of crowded buckets.
LEVELS = ((20, 3), (60, 6), (300, 12))
#: Members of a bucket that are held against each other; larger ones are split by finer bands.
CROWD = 512
#: One-bit min-hashes of a sketch, and with what probability a pair of just the similarity asked for may fail by it.
SKETCH, MISS = 1024, 1e-9
#: Members of a bucket that one task holds against each other; the pairs of larger ones are dealt out in tiles.
TILE = 1024


def shingles(text: bytes, width: int = WIDTH, seed: int = 42):
    """Sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words is one shingle, none without words."""
    import numpy as np

    return np.unique(hashes(text, width, seed))


def set_name(s) -> int:
    """One signed 64-bit hash that names a set."""
    import xxhash

    h = xxhash.xxh64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


@cache
def _permutations(n: int):
    import numpy as np

    r = np.random.default_rng(42)
    flip = r.integers(0, 1 << 63, n, dtype=np.uint64)
    return flip, r.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def smallest(s, n: int):
    """The smallest value of a set under each of n permutations."""
    import numpy as np

    flip, by = _permutations(n)
    low, step = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64), max(1, (1 << 19) // n)
    for at in range(0, len(s), step):
        np.minimum(low, ((s[at : at + step, None] ^ flip) * by).min(axis=0), out=low)
    return low


def band_keys(s, level: int = 0) -> list[int]:
    """A signed key per band; equal sets have equal keys."""
    import xxhash

    bands, rows = LEVELS[level]
    keys = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(smallest(s, bands * rows).reshape(bands, rows))]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def _signatures(batches, width: int):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        fps, names, sizes, keys = [], [], [], []
        for t in b.column(1).to_pylist():
            h = hashes(t or b"", width)
            s = np.unique(h)
            fps.append(majority(h))
            names.append(set_name(s))
            sizes.append(len(s))
            keys.append(band_keys(s) if len(s) else [])
        fps = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), fps, pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "fp", "name", "n", "keys"])


def sketch(s) -> list[int]:
    """SKETCH one-bit min-hashes in signed longs. Two sets' bits differ with probability (1 - similarity) / 2 each."""
    import numpy as np

    if not len(s):
        return [0] * (SKETCH // 64)
    # bit 24 of a smallest value: the bits at its lower end are those of the item in every permutation
    return np.packbits((smallest(s, SKETCH) >> np.uint64(24) & np.uint64(1)).astype(bool), bitorder="little").view("<i8").tolist()


def most_bits(least: float) -> int:
    """Fewest bits such that sketches of sets alike by `least` differ in more with a probability of at most MISS."""
    p, left = (1 - least) / 2, 1.0
    for d in range(SKETCH):
        left -= comb(SKETCH, d) * p**d * (1 - p) ** (SKETCH - d)
        if left <= MISS:
            return d
    return SKETCH


def _sets(batches, width: int):
    import pyarrow as pa

    for b in batches:
        got = [shingles(t or b"", width) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([set_name(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary()), pa.array([sketch(s) for s in got], pa.list_(pa.int64()))],
            names=["name", "items", "bits"],
        )


def _alike(batches, least: float):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= least * (len(x) + len(y) - both))
        m = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m)], names=["u", "v"])


def _finer(batches, level: int):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        keys = [band_keys(np.frombuffer(x, dtype=np.uint64), level) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["name", "keys"])


def _close(batches, least: float):
    """Rows sorted by tile, a tile being the members of a bucket in two of its shares: pairs of different parts, of
    sizes that fit and with close sketches, as (a, b). Nothing else leaves the task."""
    import numpy as np
    import pyarrow as pa

    most, words = most_bits(least), SKETCH // 64
    none = np.zeros(0, dtype=np.int64)
    held = [none] * 8 + [np.zeros((0, words), dtype=np.int64)]

    def pairs(share, name, n, part, bits):
        two = share.min() != share.max()
        for at in range(0, len(name), 256):
            s = slice(at, at + 256)
            on = (name[s, None] < name[None, :]) & (part[s, None] != part[None, :])
            if two:
                on &= share[s, None] != share[None, :]
            low, high = np.minimum(n[s, None], n[None, :]), np.maximum(n[s, None], n[None, :])
            on &= low >= np.floor(high * least)
            i, j = np.nonzero(on)
            for k in range(0, len(i), 1 << 16):
                p, q = at + i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                near = np.bitwise_count((bits[p] ^ bits[q]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= most
                yield name[p[near]], name[q[near]]

    for b in _and_end(batches):
        if b is not None and not b.num_rows:
            continue
        if b is None:
            cols = held
        else:
            new = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)]
            new.append(b.column(8).flatten().to_numpy(zero_copy_only=False).reshape(-1, words))
            cols = [np.concatenate(x) for x in zip(held, new, strict=True)]
        if not len(cols[0]):
            continue
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
        cuts = [0, *edge.tolist(), len(cols[0])]
        last = len(cuts) - 1 if b is None else len(cuts) - 2
        got = [p for s, e in zip(cuts[:last], cuts[1 : last + 1], strict=True) if e - s > 1 for p in pairs(*(c[s:e] for c in cols[4:]))]
        held = [c[cuts[last] :] for c in cols]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[i] for g in got])) for i in (0, 1)], names=["a", "b"])


def _and_end(batches):
    yield from batches
    yield None


def close_pairs(members: DataFrame, least: float) -> DataFrame:
    """members(c, key, name, n, part, m, bits) of buckets of m members -> distinct (a, b), names of different parts
    whose sketches are close.

    A bucket of more than TILE members is cut into shares by hash, and every two shares meet in a tile of their own,
    so the pairs of a bucket of any size are dealt over tasks; a pair becomes a row only if its sketches are close.
    """
    ways = F.ceil(F.col("m") / TILE).cast("int")
    rows = members.withColumn("share", F.pmod(F.xxhash64("name"), ways).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), ways - 1)))
    rows = rows.select("c", "key", F.least("share", "other").alias("i"), F.greatest("share", "other").alias("j"), "share", "name", "n", "part", "bits")
    rows = rows.repartition("c", "key", "i", "j").sortWithinPartitions("c", "key", "i", "j")
    return rows.mapInArrow(partial(_close, least=least), "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float, scratch: Scratch, name: str) -> DataFrame:
    """The written pairs (a, b) of set names whose sets are alike, as (u, v). The set of a name that is in very many
    pairs is sent to several tasks, so no task meets all its pairs."""
    one = sets.select(F.col("name").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("name").alias("b"), F.col("items").alias("y"))
    both = counted_join(pairs, one, ["a"], scratch, f"{name}-of").join(two, "b").select("a", "b", "x", "y")
    return scratch.save(both.mapInArrow(partial(_alike, least=least), "u long, v long"), name)


def simhash_groups(tags: DataFrame, scratch: Scratch) -> DataFrame:
    """tags(name, fp, n), written -> (c, key, name, n): sets by the component of their fingerprint under links of DISTANCE bits
    or fewer, which blocks find. key names the component, c is -1."""
    fps = scratch.save(tags.groupBy("fp").agg(F.min("name").alias("rep"), F.count("*").alias("n")), "fingerprints")
    total = fps.agg(F.count("*"), F.sum("n")).first()
    comp = components(links(fps.select("fp", "rep"), total[0], DISTANCE, scratch), scratch, "hamming")
    named = fps.join(comp, fps.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("key"))
    keyed = spread_join(tags, scratch.save(named, "groups"), ["fp"], fps, total[1] or 0)
    return keyed.select(F.lit(-1).alias("c"), "key", "name", "n").distinct()


def _buckets(keyed: DataFrame, scratch: Scratch, level: int) -> DataFrame:
    """keyed(c, key, name, n) of buckets with several members, with the bucket's size m and its smallest member low."""
    keyed = scratch.save(keyed, f"keyed-{level}")
    full = keyed.groupBy("c", "key").agg(F.count("*").alias("m"), F.min_by(F.struct("name", "n"), "name").alias("low")).where("m > 1")
    full = scratch.save(full, f"full-{level}")
    total = full.agg(F.sum("m")).first()[0] or 0
    return scratch.save(spread_join(keyed, full, ["c", "key"], full.select("c", "key", F.col("m").alias("n")), total), f"buckets-{level}")


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(id, component_id) per row: texts whose shingle sets have a Jaccard similarity of `least` or more link.

    component_id is the smallest id reachable. Null, empty and blank texts have the empty set and link with each
    other. A row with a null id gets the component of its text and is never a representative; rows that share an id
    count as one document. Equal sets are collapsed first. The first buckets are those of SimHash: sets whose
    fingerprints (of the same shingles, repeats included) reach each other by steps of DISTANCE bits; then come those of
    bands, for pairs that are alike but farther apart. Within a bucket each set is held against its smallest name; only
    pairs that this leaves in different components are held against each other, so a large group of copies costs one
    comparison a member, and only those whose sketches are close become rows. Where a band's bucket of more than CROWD
    members is left with several components, its members get finer bands, in which texts that are alike still meet and others part; only
    at the finest are all that remain held against each other, in tiles. Bands and sketches miss a pair of just the similarity
    asked for with the probabilities at LEVELS and MISS; there is no cap on candidates.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    rows = scratch.save(d.mapInArrow(partial(_signatures, width=width), "id long, fp long, name long, n long, keys array<long>"), "signatures")
    distinct = scratch.save(rows.groupBy("name").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("keys").alias("keys"), F.count("*").alias("copies")).where("rep is not null"), "distinct")
    fits = lambda p, q: (F.least(p, q) >= F.floor(F.greatest(p, q) * least))
    tags = scratch.save(rows.where("id is not null and n > 0").select("name", "fp", "n").distinct(), "tags")
    buckets = _buckets(simhash_groups(tags, scratch), scratch, -1)
    banded = _buckets(distinct.select("name", "n", F.posexplode("keys").alias("c", "key")), scratch, 0)
    members = scratch.save(buckets.select("name").union(banded.select("name")).distinct(), "members")
    ids = distinct.join(members, "name", "left_semi").select(F.col("rep").alias("id")).distinct()
    sets = d.join(ids, "id", "left_semi").select("t").mapInArrow(partial(_sets, width=width), "name long, items binary, bits array<long>")
    sets = scratch.save(sets.join(members, "name", "left_semi").groupBy("name").agg(F.first("items").alias("items"), F.first("bits").alias("bits")), "sets")
    found, held = None, None
    for level in range(-1, len(LEVELS)):
        star = buckets.where((F.col("name") != F.col("low.name")) & fits(F.col("n"), F.col("low.n"))).select(F.col("low.name").alias("a"), F.col("name").alias("b"))
        star = scratch.save(star.distinct() if held is None else star.distinct().join(held, ["a", "b"], "left_anti"), f"star-{level}")
        new = verified(star, sets, least, scratch, f"star-links-{level}")
        found, held = (new, star) if found is None else (found.union(new), held.union(star))
        comp = components(found, scratch, f"near-{level}")
        part = buckets.join(comp.withColumnRenamed("node", "name"), "name", "left").select("c", "key", "name", "n", "m", F.coalesce("component", "name").alias("part"))
        part = scratch.save(part, f"parts-{level}")
        mixed = part.groupBy("c", "key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.max("m").alias("m")).where("p <> q")
        mixed = scratch.save(mixed.select("c", "key", "m"), f"mixed-{level}")
        last = level + 1 == len(LEVELS)
        few = part.join(mixed if last else mixed.where(F.col("m") <= CROWD), ["c", "key"], "left_semi")
        few = few.join(sets.select("name", "bits"), "name").select("c", "key", "name", "n", "part", "m", "bits")
        rest = scratch.save(close_pairs(few, least).join(held, ["a", "b"], "left_anti"), f"rest-{level}")
        found, held = found.union(verified(rest, sets, least, scratch, f"rest-links-{level}")), held.union(rest)
        if level < 0:  # every set goes on to the bands, those of crowded groups too
            buckets = banded
            continue
        crowd = mixed.where(F.col("m") > CROWD)
        if last or crowd.isEmpty():
            break
        total = crowd.agg(F.sum("m")).first()[0]
        crowd = spread_join(part.select("c", "key", "name", "n"), crowd.select("c", "key"), ["c", "key"], crowd.select("c", "key", F.col("m").alias("n")), total)
        crowd = scratch.save(crowd.select("name", "n").distinct(), f"crowd-{level}")
        finer = sets.join(crowd.select("name"), "name", "left_semi").mapInArrow(partial(_finer, level=level + 1), "name long, keys array<long>")
        buckets = _buckets(finer.join(crowd, "name").select("name", "n", F.posexplode("keys").alias("c", "key")), scratch, level + 1)
    rep = distinct.select("name", "rep")
    links = counted_join(found, rep.select(F.col("name").alias("u"), F.col("rep").alias("ru")), ["u"], scratch, "links-of")
    links = links.join(rep.select(F.col("name").alias("v"), F.col("rep").alias("rv")), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    shared = rows.where("id is not null").groupBy("id").agg(F.min("name").alias("p"), F.max("name").alias("q")).where("p <> q").select("id")
    same_id = rows.join(shared, "id", "left_semi").select("id", "name").distinct().join(rep, "name").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    links = links.union(same_id)
    comp = components(links, scratch, "all")
    named = rep.join(comp, rep.rep == comp.node, "left").select("name", F.coalesce("component", "rep").alias("component_id"))
    counts = distinct.select("name", F.col("copies").alias("n"))
    done = spread_join(rows.select("id", "name"), scratch.save(named, "named"), ["name"], counts, rows.count())
    orphans = rows.where("id is null").select("id", "name").join(rep, "name", "left_anti")
    return done.select("id", "component_id").union(orphans.select("id", F.lit(None).cast("long")))
