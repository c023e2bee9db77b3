"""Documents and files that leave the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def feature_rows(df: DataFrame, columns: list[str], lon: str = "centre_lon", lat: str = "centre_lat") -> DataFrame:
    """One GeoJSON feature per row (S9): a sink writes them line by line, so no row holds a whole collection."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 7), F.round(lat, 7)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*columns).alias("properties"))).alias("feature"))


def feature_collection(df: DataFrame, columns: list[str], matched: int, most: int = 20_000) -> DataFrame:
    """One FeatureCollection document of a page; a page has at most `most` rows."""
    rows = feature_rows(df.limit(most), columns)
    page = rows.agg(F.collect_list("feature").alias("f"))
    return page.select(F.concat(F.lit('{"type":"FeatureCollection","numberMatched":'), F.lit(str(matched)), F.lit(',"numberReturned":'), F.size("f").cast("string"), F.lit(',"features":['), F.array_join("f", ","), F.lit("]}")).alias("document"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV as spreadsheets read it."""
    rows = text.csv_row(df)
    rows.select(*[text.csv_cell(F.col(f"`{c}`")).alias(c) for c in rows.columns]).write.option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def chat_records(turns: DataFrame) -> DataFrame:
    """(conv_id, conversations): turns in order as {from, value}."""
    t = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))))
    return turns.groupBy("conv_id").agg(F.transform(t, lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) per table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def file_hashes(spark, path: str) -> DataFrame:
    """(path, bytes, sha256) per file below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names in one folder only, or with other bytes (Q23); both from file_hashes()."""
    name = lambda d, s: d.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias(s))
    return name(a, "a").join(name(b, "b"), "name", "full_outer").where("not (a <=> b)")
