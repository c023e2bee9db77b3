"""Content-addressed token store: packs of unique chunks, recipes per document, Merkle roots over both."""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, filesystem, slices
from .tokens import byte_encoder

#: File format. A pack is PACK and then chunks of little-endian unsigned ids of 2 bytes where all ids of the tokenizer fit,
#: else of 4; a recipe file is RECIPE and then per document: id, number of ids, number of chunks, Merkle root, digests.
#: Digests are of the stored bytes.
PACK, RECIPE, HEAD, DIGEST = b"KLPACK1\n", b"KLRECP1\n", struct.Struct("<qqI16s"), 16
NO_ID = -(1 << 63)
#: Ids in a chunk: at least, a cut on average each (a power of two), at most.
LEAST, MEAN, MOST, WINDOW = 256, 1024, 4096, 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests in order; an odd one out moves up as it is."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@functools.cache
def _gear():
    import numpy as np

    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 1 << 16, dtype=np.uint64)


def cuts(ids) -> list[int]:
    """Ends of the chunks of an id array. A cut depends on the WINDOW ids before it, so a changed passage changes the
    chunks that it touches and no others."""
    import numpy as np

    n, out, at = len(ids), [], 0
    if n > LEAST:
        g = _gear()[ids & 0xFFFF] ^ (ids.astype(np.uint64) >> np.uint64(16))
        h, j = g, 1  # sum of the last WINDOW values, each shifted by its age, by doubling
        while j < WINDOW:
            h, last, j = h.copy(), h, 2 * j
            h[j // 2 :] += last[: n - j // 2] << np.uint64(j // 2)
        for p in (np.flatnonzero(h >> np.uint64(64 - (MEAN.bit_length() - 1)) == 0) + 1).tolist():
            while p - at > MOST:
                at += MOST
                out.append(at)
            if p - at >= LEAST:
                out.append(at := p)
    while n - at > MOST:
        at += MOST
        out.append(at)
    return [*out, n] if n > at else out


class _Packs:
    """Writes chunks to pack files of at most `most` bytes each."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.out = folder, most, None
        self.fs, self.at = filesystem(folder)

    def add(self, data: bytes) -> tuple[str, int]:
        if self.out is not None and self.size + len(data) > self.most:
            self.close()
        if self.out is None:
            self.fs.create_dir(self.at, recursive=True)
            self.name = f"{uuid.uuid4().hex}.pack"
            self.out, self.size = self.fs.open_output_stream(f"{self.at}/{self.name}", compression=None), len(PACK)
            self.out.write(PACK)
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return f"{self.folder}/{self.name}", at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


@functools.cache
def id_bytes(tokenizer: str, end: int) -> int:
    """Bytes that every id of a tokenizer fits in."""
    return 2 if max(byte_encoder(tokenizer).encode.tok.get_vocab_size(), end + 1) <= 1 << 16 else 4


def _stage(batches, tokenizer: str, end: int, folder: str, most: int):
    """A row per document with its recipe, and a row per chunk that is new to this task with its place."""
    import numpy as np
    import pyarrow as pa

    enc, packs, known, kind = byte_encoder(tokenizer), _Packs(folder, most), set(), f"<u{id_bytes(tokenizer, end)}"
    tail = np.array([end], dtype="<u4").tobytes()
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("recipe", pa.binary()), ("digest", pa.binary()), ("path", pa.string()), ("offset", pa.int64())]
    for b in batches:
        doc = iter(b.column(0).to_pylist())
        for run in slices([t or "" for t in b.column(1).to_pylist()]):
            rows = []
            for data in enc.batch(run):
                data, recipe, at = data + tail, [], 0
                ids = np.frombuffer(data, dtype="<u4")
                for to in cuts(ids):
                    chunk, size, at = ids[at:to].astype(kind).tobytes(), to - at, to
                    recipe.append(d := digest(chunk))
                    if d not in known:
                        known.add(d)
                        rows.append((None, size, None, d, *packs.add(chunk)))
                rows.append((next(doc), len(data) // 4, b"".join(recipe), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])
    packs.close()


def _compact(batches, folder: str, most: int, width: int):
    """Copies the chunks that stay into final packs, in the order of the file that held them."""
    import pyarrow as pa

    for b in batches:
        for path, keep in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            packs, rows = _Packs(folder, most), []
            fs, at = filesystem(path)
            with fs.open_input_file(at) as f:
                data = f.read()
            for k in sorted(keep, key=lambda k: k["offset"]):
                chunk = data[k["offset"] : k["offset"] + width * k["n"]]
                if digest(chunk) != k["digest"]:
                    raise ValueError(f"a chunk of {path} doesn't have its digest")
                rows.append((k["digest"], *packs.add(chunk), k["n"]))
            packs.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["digest", "path", "offset", "n"])


def _recipes(batches, folder: str):
    """One recipe file per task from rows in ascending doc_id order; a manifest row for it."""
    import pyarrow as pa
    from pyspark import TaskContext

    fs, at = filesystem(folder)
    name, out, docs, tokens, roots = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.recipe", None, 0, 0, []
    for b in batches:
        for doc, n, recipe in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if out is None:
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(f"{at}/{name}")
                out.write(RECIPE)
            root = merkle([recipe[i : i + DIGEST] for i in range(0, len(recipe), DIGEST)])
            out.write(HEAD.pack(NO_ID if doc is None else doc, n, len(recipe) // DIGEST, root) + recipe)
            docs, tokens = docs + 1, tokens + n
            roots.append(root)
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{name}"], "docs": [docs], "tokens": [tokens], "root": [merkle(roots)]})


def _width(scratch: Scratch) -> int:
    """Tasks for steps whose rows are few and whose work is large: file sizes don't show in their shuffle."""
    return max(1, 4 * scratch.spark.sparkContext.defaultParallelism)


def write_store(docs: DataFrame, scratch: Scratch, tokenizer: str = "byte_bpe_50k.json", end: int = 2, pack_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the store; returns (index, manifest).

    index(digest, path, offset, n): every different chunk once. manifest(part, path, docs, tokens, base, root): the
    recipe files in ascending doc_id order, with the ids of all files before. Null and empty texts hold the end id
    alone; null ids come first, ties in any order. A task that runs again writes files of other names, and only rows
    of the attempt that ended are read. Ids are tokenized once and pass through no shuffle: tasks write packs, the
    owner of a chunk that several tasks wrote is the smallest (path, offset), and each pack is copied without the
    chunks that others own.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    staged = scratch.save(
        d.mapInArrow(partial(_stage, tokenizer=tokenizer, end=end, folder=scratch.path("staging"), most=pack_bytes), "doc_id long, n long, recipe binary, digest binary, path string, offset long"), "staged"
    )
    owned = staged.where("digest is not null").groupBy("digest").agg(F.min(F.struct("path", "offset", "n")).alias("at"))
    packs = owned.select("digest", "at.*").groupBy("path").agg(F.collect_list(F.struct("offset", "n", "digest")).alias("keep")).repartition(_width(scratch))
    index = scratch.save(packs.mapInArrow(partial(_compact, folder=scratch.path("packs"), most=pack_bytes, width=id_bytes(tokenizer, end)), "digest binary, path string, offset long, n long"), "index")
    scratch.drop("staging")
    rows = staged.where("digest is null").select("doc_id", "n", "recipe").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    parts = scratch.save(rows.mapInArrow(partial(_recipes, folder=scratch.path("recipes")), "part int, path string, docs long, tokens long, root binary"), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return index, scratch.save(parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "manifest")


def store_root(manifest: DataFrame) -> str:
    """Merkle root over the recipe files: one small row per file reaches the driver."""
    return merkle([bytes(r["root"]) for r in manifest.select("part", "root").orderBy("part").collect()]).hex()


def _lookup(batches):
    """Chunk references of every document of a recipe file, with the file's Merkle root checked."""
    import pyarrow as pa

    names = ["doc_id", "start", "n_tokens", "root", "seq", "digest"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
    for b in batches:
        for path, base, want in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            fs, where = filesystem(path)
            with fs.open_input_file(where) as f:
                data = f.read()
            at, rows, roots = len(RECIPE), [], []
            while at < len(data):
                doc, n, k, root = HEAD.unpack_from(data, at)
                at += HEAD.size
                roots.append(root)
                rows += [(None if doc == NO_ID else doc, base, n, root, i, data[at + DIGEST * i : at + DIGEST * (i + 1)]) for i in range(k)]
                at, base = at + DIGEST * k, base + n
                if len(rows) >= 20_000 or at >= len(data):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if merkle(roots) != want:
                raise ValueError(f"{path} doesn't have its Merkle root")


class _Blocks:
    """Reads through a few large blocks per task, so that neighbouring chunks share a read."""

    def __init__(self, size: int = 1 << 20, most: int = 16):
        self.size, self.read = size, functools.lru_cache(most)(self._read)

    def _read(self, path: str, k: int) -> bytes:
        fs, at = filesystem(path)
        with fs.open_input_file(at) as f:
            return f.read_at(min(self.size, f.size() - k * self.size), k * self.size)

    def get(self, path: str, at: int, n: int) -> bytes:
        a, z = at // self.size, (at + n - 1) // self.size
        data = self.read(path, a) if a == z else b"".join(self.read(path, k) for k in range(a, z + 1))
        return data[at - a * self.size : at - a * self.size + n]


def _rebuild(batches, width: int):
    import numpy as np
    import pyarrow as pa

    blocks, names = _Blocks(), ["doc_id", "start", "n_tokens", "ids"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for b in batches:
        rows, held = [], 0
        for doc, start, n, root, chunks in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            chunks.sort(key=lambda c: c["seq"])
            data = [blocks.get(c["path"], c["offset"], width * c["n"]) for c in chunks]
            if merkle([digest(x) for x in data]) != root or sum(map(len, data)) != width * n:
                raise ValueError(f"document {doc} isn't what its recipe says")
            rows.append((doc, start, n, np.frombuffer(b"".join(data), dtype=f"<u{width}").astype("<u4").tobytes()))
            held += 4 * n
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_store(index: DataFrame, manifest: DataFrame, scratch: Scratch, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document from the files, ids little-endian unsigned 32-bit; width: id_bytes(). Chunk references find their place by an equi join
    on the digest, never a broadcast, whatever size Spark takes the references to have; documents are then read in the order of their first chunk's place. Every Merkle root is checked."""
    refs = manifest.select("path", "base", "root").repartition(_width(scratch)).mapInArrow(_lookup, "doc_id long, start long, n_tokens long, root binary, seq int, digest binary")
    found = refs.join(index.hint("merge"), "digest").groupBy("start").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.collect_list(F.struct("seq", "path", "offset", "n")).alias("chunks")
    )
    found = scratch.save(found.withColumn("at", F.array_min(F.transform("chunks", lambda c: F.struct(c.path.alias("path"), c.offset.alias("offset"))))), "found")
    near = found.repartitionByRange("at.path", "at.offset", "start").sortWithinPartitions("at.path", "at.offset")  # start parts equal documents
    return near.select("doc_id", "start", "n_tokens", "root", "chunks").mapInArrow(partial(_rebuild, width=width), "doc_id long, start long, n_tokens long, ids binary")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op7")
    index, manifest = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)
    return read_store(index, manifest, scratch).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
