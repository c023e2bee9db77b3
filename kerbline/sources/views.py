"""Road-survey views over the driver's tables. Each is one SQL text that Spark and DuckDB both read, {S} being the
engine's string type, so that a query and its counterpart start from the same rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HOME = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", HOME)  # for workers where the package isn't installed
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SEGMENTS = """
SELECT *, vlm_class IN ('distress', 'normal', 'unknown') AS answered,
       CASE WHEN vlm_class = 'distress' THEN CASE event_id % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END
            WHEN vlm_class = 'normal' THEN 'None' ELSE 'Unknown' END AS severity,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 11 = 0 END AS expert_reviewed,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE confidence < 0.8E0 END AS needs_expert_review
FROM (
SELECT event_id, user_id, value,
       concat('S', lpad(CAST(user_id AS {S}), 5, '0'), '_seg', lpad(CAST(k AS {S}), 5, '0')) AS segment_id,
       concat('S', lpad(CAST(user_id AS {S}), 5, '0')) AS session_id,
       CAST(k AS BIGINT) AS k,
       5.0E0 * k AS s0_m, 5.0E0 * k + 5.0E0 AS s1_m, 5.0E0 AS length_m, ts AS utc,
       CASE WHEN event_id % 23 = 0 THEN 'not_covered' WHEN event_id % 6 = 0 THEN 'skip'
            WHEN event_id % 17 = 0 THEN 'audit' ELSE 'send' END AS status,
       CASE WHEN event_id % 23 = 0 THEN 'not_covered' WHEN event_id % 6 = 0 THEN 'not_sent'
            WHEN event_id % 29 = 0 THEN 'pending' WHEN event_type IN ('error','purchase') THEN 'distress'
            WHEN event_id % 31 = 0 THEN 'unknown' ELSE 'normal' END AS vlm_class,
       CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'Potholes'
                                                ELSE 'Potholes|Alligator Cracking' END
            WHEN event_type = 'purchase' THEN 'Longitudinal Cracking' ELSE 'Normal' END AS label_text,
       least(0.99E0, 0.5E0 + value / 100.0E0) AS confidence,
       77.5E0 + (user_id % 10) * 0.001E0 AS centre_lon, 12.9E0 + k * 0.000045E0 AS centre_lat
FROM (SELECT event_id, user_id, ts, event_type, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM {events}) e) s
"""

ASSESSMENTS = """
SELECT o_orderkey AS id, o_custkey AS photo_id, o_orderdate AS created_at,
       CASE WHEN o_orderkey % 7 = 0 THEN 'pending' WHEN o_orderkey % 7 = 1 THEN 'processing'
            WHEN o_orderstatus = 'F' THEN 'classified' WHEN o_orderstatus = 'O' THEN 'expert_review'
            WHEN o_orderkey % 2 = 0 THEN 'rejected_non_pavement' ELSE 'failed' END AS status,
       CASE WHEN o_orderkey % 7 < 2 THEN NULL ELSE least(0.99E0, o_totalprice / 500000.0E0) END AS confidence,
       CASE WHEN o_orderkey % 7 < 2 THEN NULL ELSE o_orderkey % 3 = 0 END AS is_distressed,
       CASE WHEN o_orderkey % 5 = 0 THEN 'Potholes|Ravelling' WHEN o_orderkey % 5 = 1 THEN 'Potholes'
            WHEN o_orderkey % 5 = 2 THEN 'Edge Cracking' ELSE 'Normal' END AS label_text,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 900 AS DOUBLE) END AS stage1_ms,
       o_orderpriority AS source
FROM {orders}
"""

PHOTOS = """SELECT c_custkey AS photo_id, c_name AS url, c_nationkey AS nation, c_acctbal AS size FROM {customer}"""

REVIEWS = """
SELECT doc_id AS id, CAST(doc_id % 180 AS BIGINT) AS item, CASE WHEN doc_id % 2 = 0 THEN 'video' ELSE 'citizen' END AS source,
       CASE doc_id % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'needs_review' ELSE 'auto' END AS queue,
       concat(CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE '' END, CASE doc_id % 4 WHEN 0 THEN 'Asha  Rao' WHEN 1 THEN 'asha rao' WHEN 2 THEN 'Lee' ELSE 'Mina' END) AS reviewer,
       quality = 1 AS expert_distress, toxic = 1 OR doc_id % 3 = 0 AS vlm_distress,
       CASE doc_id % 4 WHEN 0 THEN 'Potholes' WHEN 1 THEN 'Potholes|Ravelling' WHEN 2 THEN 'Edge Cracking' ELSE 'Ravelling' END AS expert_text,
       CASE doc_id % 5 WHEN 0 THEN 'Potholes' WHEN 1 THEN 'Ravelling' WHEN 2 THEN 'Potholes|Ravelling' WHEN 3 THEN 'Edge Cracking' ELSE 'Rutting' END AS vlm_text,
       CAST(doc_id % 3 + 1 AS INTEGER) AS vlm_severity, CAST(doc_id % 2 + 1 AS INTEGER) AS expert_severity, doc_id % 6 = 0 AS needs_review
FROM {labels}
"""

PROBES = """
SELECT vec_id AS id, label % 2 = 1 AS truth, label AS grp, concat('d', CAST(vec_id % 12 AS {S})) AS day,
       round(1.0E0 / (1.0E0 + exp(-4.0E0 * embedding[{one}])), 2) AS p1, round(1.0E0 / (1.0E0 + exp(-4.0E0 * embedding[{two}])), 2) AS p2
FROM {embeddings}
"""

SURVEY = """
SELECT l_orderkey AS block, l_linenumber AS n, l_quantity AS x, l_extendedprice / 1000.0E0 AS y,
       CAST(floor(l_quantity / 9.0E0) AS INTEGER) AS c1, CAST(floor(l_extendedprice / 18000.0E0) AS INTEGER) AS c2
FROM {lineitem}
"""

VIEWS = {"segments": (SEGMENTS, "events"), "assessments": (ASSESSMENTS, "orders"), "photos": (PHOTOS, "customer"), "reviews": (REVIEWS, "labels"), "probes": (PROBES, "embeddings"), "survey": (SURVEY, "lineitem")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, base = VIEWS[name]
    text = text.replace("{S}", "STRING").replace("{one}", "0").replace("{two}", "1")
    return spark.sql(text, **{base: table(spark, sf_dir, base)})


def duck(name: str) -> str:
    text, base = VIEWS[name]
    return text.replace("{S}", "VARCHAR").replace("{one}", "1").replace("{two}", "2").replace("{" + base + "}", base)


def over(body: str, *names: str) -> str:
    """DuckDB SQL with the named views in front."""
    found = names or [n for n in VIEWS if n in body]
    rest = body.strip()
    head = ", ".join(f"{n} AS ({duck(n)})" for n in found)
    return f"WITH {head}, {rest[5:]}" if rest[:5].upper() == "WITH " else f"WITH {head} {rest}"
