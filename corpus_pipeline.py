"""From raw documents to packed sequences in five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import lines, packing, pii, quality, simhash
from kerbline.llm.common import Scratch

#: Scratch folders of stages whose result has been written since.
_DONE: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A folder for this stage. Its predecessor's result is on disk by now, so what that left goes."""
    while _DONE:
        old = _DONE.pop()
        if old.spark.sparkContext is spark.sparkContext:
            old.clear()
    _DONE.append(new := Scratch(spark, f"pipeline-{name}"))
    return new


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule of the current policy lets pass."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus."""
    return lines.dedup_lines(docs, _scratch(spark, "lines"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates: SimHash over five-word shingles, blocks
    and exact Hamming distance, then exact Jaccard; min-hash bands add the alike pairs that lie farther apart."""
    return simhash.keep_one(docs, _scratch(spark, "near"), least=0.8, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack(docs, _scratch(spark, "pack"), columns=("crc32(ids) AS ids_crc32",))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("pack_sequences", pack_sequences),
]

#: SQL can say neither the fingerprints nor the token ids; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    tables = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
