"""Session defaults: UTC, adaptive plans. Shuffle counts and memory are the cluster's to set."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "kerbline", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that driver and executors share (spark.checkpoint.dir), or, where the session names
    none and is local, under a temporary one of this machine, as in tests."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kerbline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
