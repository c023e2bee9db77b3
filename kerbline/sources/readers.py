"""Readers for the file kinds that surveys come in."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; other lines are dropped (S3)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per JSON file of a folder, with its name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, whatever its byte order mark."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def survey(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a survey CSV: ranges, enums, unique ids."""
    from ..operators.checks import rejects

    d = csv(spark, path, "section_id string, start_lat double, start_lon double, end_lat double, end_lon double, road_class string, surface string, cracking_pct double, ravelling_pct double, potholes_number double, patching_pct double, rut_depth_mm double, iri_m_km double, pci double")
    n = F.count("*").over(Window.partitionBy("section_id"))
    d = d.withColumn("repeats", n)
    share = lambda c: F.col(c).isNull() | F.col(c).between(0, 100)
    rules = {"section_id": (F.col("repeats") == 1) & F.col("section_id").isNotNull(), "road_class": F.col("road_class").isin("highway", "mdr", "rural", "urban"), **{c: share(c) for c in ("cracking_pct", "ravelling_pct", "patching_pct", "pci")}, "latitude": F.col("start_lat").between(-90, 90) & F.col("end_lat").between(-90, 90)}
    bad = rejects(d, rules)
    return d.join(bad.select("section_id").distinct(), "section_id", "left_anti").drop("repeats"), bad


def imu(spark: SparkSession, path: str) -> DataFrame:
    """Sensor rows in time order without repeated or unreadable stamps."""
    d = csv(spark, path, "t_ns long, sensor string, x double, y double, z double").where("t_ns is not null")
    fine = reduce(lambda a, b: a & b, [~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y", "z")])
    w = Window.partitionBy("sensor", "t_ns").orderBy("x", "y", "z")
    return d.where(fine).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def yolo_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(image, class_id, x0, y0, x1, y1) of YOLO label files, in shares of the image."""
    d = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("image"), F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") >= 5)
    n = lambda i: F.get("v", F.lit(i)).try_cast("double")
    return d.select("image", F.get("v", F.lit(0)).try_cast("int").alias("class_id"), (n(1) - n(3) / 2).alias("x0"), (n(2) - n(4) / 2).alias("y0"), (n(1) + n(3) / 2).alias("x1"), (n(2) + n(4) / 2).alias("y1")).where("class_id is not null and x0 is not null and y1 is not null")


def voc_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(image, name, x0, y0, x1, y1) of Pascal-VOC files."""
    s = "filename string, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    d = spark.read.schema(s).option("rowTag", "annotation").xml(path).select("filename", F.explode("object").alias("o"))
    return d.select(F.col("filename").alias("image"), "o.name", F.col("o.bndbox.xmin").alias("x0"), F.col("o.bndbox.ymin").alias("y0"), F.col("o.bndbox.xmax").alias("x1"), F.col("o.bndbox.ymax").alias("y1"))


def rest_filter(params: dict[str, str]) -> Column:
    """Filters written as column=op.value, as a Column that Parquet can take."""
    out = F.lit(True)
    for name, v in params.items():
        if m := re.fullmatch(r"in\.\((.*)\)", v):
            out = out & F.col(name).isin(*m[1].split(","))
        elif v in ("is.null", "not.is.null"):
            out = out & (F.col(name).isNull() if v == "is.null" else F.col(name).isNotNull())
        elif m := re.fullmatch(r"(eq|neq|gt|gte|lt|lte)\.(.*)", v):
            c, x = F.col(name), F.lit(m[2])
            out = out & {"eq": c == x, "neq": c != x, "gt": c > x, "gte": c >= x, "lt": c < x, "lte": c <= x}[m[1]]
        else:
            raise ValueError(f"unknown filter {name}={v}")
    return out


def fingerprints(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(session, fingerprint) per folder of an inbox from names, sizes and times, without reading contents."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    part = F.element_at(F.split("path", "/"), -1 - depth)
    line = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    return f.groupBy(part.alias("session")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))
