"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import functools
import hashlib
import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkEncoder, pack_ids, slices
from .tokens import _file

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def marked_words(text: str) -> list[str]:
    """The text's chunks, each a run of markers and what follows up to the next marker, written without its first
    marker: the library puts that one back before each chunk as it does before a whole text."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]


@functools.cache
def processor(name: str = "piece_bpe_32k.model"):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=_file(name))


@functools.cache
def splittable(name: str) -> bool:
    """Whether no piece of the model reaches from a character over a following marker, texts aren't normalised, blanks
    aren't merged, and a marker is put first: then marked words can be segmented one by one."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    sp, m = processor(name), pb.ModelProto()
    m.ParseFromString(sp.serialized_model_proto())
    n = m.normalizer_spec
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
    return plain and not m.trainer_spec.treat_whitespace_as_suffix and all(p.type != 4 and MARK not in p.piece.lstrip(MARK) for p in m.pieces)


@functools.cache
def piece_encoder(name: str = "piece_bpe_32k.model") -> ChunkEncoder:
    sp, alone = processor(name), [processor(name).piece_to_id(MARK)]
    encode = lambda word: pack_ids(sp.encode(word) if word else alone)
    return ChunkEncoder(marked_words, encode, lambda text: pack_ids(sp.encode(text)))


def _encode(batches, model: str, end: bool):
    import numpy as np
    import pyarrow as pa

    sp, table = processor(model), piece_encoder(model) if splittable(model) else None
    tail = [sp.eos_id()] if end else []
    for b in batches:
        at, ids_of = 0, b.column(0)
        for run in slices([t or "" for t in b.column(1).to_pylist()]):
            if table:
                ids = [np.frombuffer(x, dtype="<u4").tolist() + tail for x in table.batch(run)]
            else:
                ids = [x + tail for x in sp.encode(run, num_threads=1)]
            yield ids_of.slice(at, len(run)), ids
            at += len(run)


def _ids(batches, model: str, end: bool):
    import pyarrow as pa

    for doc, ids in _encode(batches, model, end):
        yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row, exactly the library's ids. Null and empty texts have the end id alone. Repeated rows and
    null ids come back as they are; whole texts of any length; no shuffle; other columns aren't read."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(partial(_ids, model=model, end=end), "doc_id long, ids array<int>")


def _decoded(batches, model: str):
    import pyarrow as pa

    sp = processor(model)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sp.decode([x or [] for x in b.column(1).to_pylist()], num_threads=1), pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids are an empty list."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, model=model), "doc_id long, text string")


def _digests(batches, model: str):
    import pyarrow as pa

    sp = processor(model)
    word = [str(i) for i in range(sp.get_piece_size())].__getitem__
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc, ids in _encode(batches, model, True):
        back = sp.decode(ids, num_threads=1)
        yield pa.RecordBatch.from_arrays(
            [doc, pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(" ".join(map(word, x))) for x in ids]), pa.array([sha(t) for t in back])],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def digests(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """What encode() and decode() give, as counts and hashes, in one pass without moving the ids out of the task."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(partial(_digests, model=model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import PACKAGE_HOME

    spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_HOME)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
