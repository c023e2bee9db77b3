"""Queries over drive segments: projections, filters, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import aggregates as A
from ..operators import filters
from ..sources.views import over, view
from .registry import query


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "segments")
    return d.withColumn("final_labels", F.split("label_text", r"\|")).withColumn("final_severity", F.col("severity"))


BOX = {"bbox": "77.5,12.9,77.505,12.95", "min_confidence": "0.8", "vlm_class": "distress,normal"}
_BOX_SQL = "centre_lon BETWEEN 77.5 AND 77.505 AND centre_lat BETWEEN 12.9 AND 12.95 AND confidence >= 0.8 AND vlm_class IN ('distress', 'normal')"
_COVERED = "status <> 'not_covered'"


@query("flagship_label_metres", over(f"""
WITH hit AS (SELECT * FROM segments WHERE {_BOX_SQL} AND {_COVERED}),
t AS (SELECT sum(length_m) AS surveyed FROM hit),
l AS (SELECT unnest(CASE WHEN vlm_class = 'distress' THEN string_split(label_text, '|') ELSE ['Normal'] END) AS label, length_m FROM hit)
SELECT label, count(*) AS segments, round(sum(length_m), 2) AS length_m, round(100.0 * sum(length_m) / max(surveyed), 3) AS pct_of_surveyed
FROM l, t GROUP BY label"""))
def flagship(spark, sf):
    hit = segments(spark, sf).where(filters.parse(BOX).column())
    total = hit.where("status <> 'not_covered'").agg(F.sum("length_m").alias("surveyed"))
    rows = A.by_label(hit)
    return rows.join(F.broadcast(total)).select("label", "segments", "length_m", A.percent(F.col("length_m"), F.col("surveyed")).alias("pct_of_surveyed"))


# ---- projections


@query("P1_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def p1(spark, sf):
    d = spark.read.parquet(f"{sf}/events.parquet")
    return d.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("P2_flatten", over("SELECT segment_id, session_id, k, status, vlm_class, answered, severity AS final_severity, length_m, s0_m / 1000 AS chainage_start_km, s1_m / 1000 AS chainage_end_km, coalesce(expert_reviewed, false) AS expert_reviewed, round(centre_lon, 7) AS centre_lon, round(centre_lat, 7) AS centre_lat FROM segments"))
def p2(spark, sf):
    d = segments(spark, sf)
    return d.select("segment_id", "session_id", "k", "status", "vlm_class", "answered", "final_severity", "length_m", (F.col("s0_m") / 1000).alias("chainage_start_km"), (F.col("s1_m") / 1000).alias("chainage_end_km"), F.coalesce("expert_reviewed", F.lit(False)).alias("expert_reviewed"), F.round("centre_lon", 7).alias("centre_lon"), F.round("centre_lat", 7).alias("centre_lat"))


@query("P3_coalesce_answer", over("SELECT s.event_id, coalesce(a.status, s.status) AS answer_status, coalesce(a.confidence, s.confidence) AS answer_confidence FROM segments s LEFT JOIN assessments a ON s.event_id = a.id"))
def p3(spark, sf):
    s, a = view(spark, sf, "segments"), view(spark, sf, "assessments")
    return s.join(a.select(F.col("id").alias("event_id"), F.col("status").alias("a"), F.col("confidence").alias("c")), "event_id", "left").select("event_id", F.coalesce("a", "status").alias("answer_status"), F.coalesce("c", "confidence").alias("answer_confidence"))


@query("P4_final_labels", over("SELECT id, CASE WHEN needs_review THEN expert_text ELSE vlm_text END AS final_text, len(string_split(CASE WHEN needs_review THEN expert_text ELSE vlm_text END, '|')) AS n FROM reviews"))
def p4(spark, sf):
    r = view(spark, sf, "reviews")
    fixed = F.when(F.col("needs_review"), F.split("expert_text", r"\|")).otherwise(F.array().cast("array<string>"))
    final = F.when(F.size(fixed) > 0, fixed).otherwise(F.split("vlm_text", r"\|"))
    return r.select("id", F.array_join(final, "|").alias("final_text"), F.size(final).cast("long").alias("n"))


@query("P5_vlm_class", over("SELECT vlm_class, count(*) AS n FROM segments GROUP BY vlm_class"))
def p5(spark, sf):
    d = segments(spark, sf)
    c = F.when(F.col("status") == "not_covered", "not_covered").when(F.col("status") == "skip", "not_sent").when(F.col("event_id") % 29 == 0, "pending")
    c = c.when(F.size(L.valid_distress(F.col("final_labels"))) > 0, "distress").when(F.col("event_id") % 31 == 0, "unknown").otherwise("normal")
    return d.select(c.alias("vlm_class")).groupBy("vlm_class").agg(F.count("*").alias("n"))


@query("P6_marker_label", over("SELECT segment_id, CASE WHEN label_text LIKE '%Potholes%' THEN 'Potholes' ELSE string_split(label_text, '|')[1] END AS marker FROM segments"))
def p6(spark, sf):
    return segments(spark, sf).select("segment_id", L.marker(F.col("final_labels")).alias("marker"))


@query("P7_numeric", "SELECT event_id, round(try_cast(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) / 8, 2) AS v FROM events")
def p7(spark, sf):
    from ..functions.arrays import number

    d = spark.read.parquet(f"{sf}/events.parquet")
    return d.select("event_id", F.round(number(F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_id").cast("string"))) / 8, 2).alias("v"))


@query("P8_lonlat", over("SELECT segment_id, CASE WHEN lon BETWEEN -180 AND 180 THEN round(lon, 7) END AS lon FROM (SELECT segment_id, centre_lon * CASE WHEN k % 5 = 0 THEN 3 ELSE 1 END AS lon FROM segments) q"))
def p8(spark, sf):
    from ..functions.arrays import lonlat

    d = segments(spark, sf).withColumn("lon", F.col("centre_lon") * F.when(F.col("k") % 5 == 0, 3).otherwise(1))
    return d.select("segment_id", lonlat(F.col("lon"), F.col("centre_lat"))["lon"].alias("lon"))


@query("P9_citizen_feature", over("SELECT id, status, confidence, label_text AS labels, strftime(created_at, '%Y-%m-%d') AS day FROM assessments WHERE status IN ('classified', 'expert_review')"))
def p9(spark, sf):
    return view(spark, sf, "assessments").where(F.col("status").isin("classified", "expert_review")).select("id", "status", "confidence", F.col("label_text").alias("labels"), F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("P10_worker_result", over("SELECT id, CASE WHEN confidence >= 0.8 THEN 'classified' ELSE 'expert_review' END AS status, concat(status, '/', coalesce(CAST(stage1_ms AS BIGINT), -1)) AS audit FROM assessments WHERE confidence IS NOT NULL"))
def p10(spark, sf):
    a = view(spark, sf, "assessments").where("confidence is not null")
    return a.select("id", filters.gate(F.col("confidence"), F.lit(1.0), F.lit(False), F.lit(False)).alias("status"), F.concat_ws("/", "status", F.coalesce(F.col("stage1_ms").cast("long"), F.lit(-1)).cast("string")).alias("audit"))


@query("P11_answer_columns", over("SELECT id, coalesce(is_distressed AND label_text <> 'Normal', false) AS distressed, string_split(label_text, '|')[1] AS primary_label FROM assessments"))
def p11(spark, sf):
    return view(spark, sf, "assessments").select("id", F.coalesce(F.col("is_distressed") & (F.col("label_text") != "Normal"), F.lit(False)).alias("distressed"), F.get(F.split("label_text", r"\|"), F.lit(0)).alias("primary_label"))


@query("P12_preview_width", "SELECT event_id, CASE WHEN value * 5 <= 160 THEN 160 WHEN value * 5 <= 320 THEN 320 WHEN value * 5 <= 480 THEN 480 WHEN value * 5 <= 640 THEN 640 WHEN value * 5 <= 960 THEN 960 WHEN value * 5 <= 1280 THEN 1280 WHEN value * 5 <= 1600 THEN 1600 ELSE 1920 END AS w FROM events")
def p12(spark, sf):
    from ..functions.arrays import snap_width

    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", snap_width(F.col("value") * 5).alias("w"))


@query("P13_colours", over("SELECT segment_id, CASE vlm_class WHEN 'distress' THEN CASE severity WHEN 'Low' THEN '#f2c14e' WHEN 'Medium' THEN '#f78154' ELSE '#b4436c' END WHEN 'normal' THEN '#5fad56' ELSE '#888888' END AS colour FROM segments"))
def p13(spark, sf):
    rows = [("distress", "Low", "#f2c14e"), ("distress", "Medium", "#f78154"), ("distress", "High", "#b4436c"), ("normal", "None", "#5fad56")]
    dim = spark.createDataFrame(rows, "vlm_class string, severity string, colour string")  # a fixed handful of rows
    return segments(spark, sf).join(F.broadcast(dim), ["vlm_class", "severity"], "left").select("segment_id", F.coalesce("colour", F.lit("#888888")).alias("colour"))


@query("P14_bin_fractions", over("""
SELECT session_id, least(d, 1.0) AS distress, least(n, 1.0 - least(d, 1.0)) AS normal FROM (SELECT session_id, round(sum(CASE WHEN vlm_class = 'distress' THEN 5 ELSE 0 END) / 250.0, 6) AS d, round(sum(CASE WHEN vlm_class = 'normal' THEN 5 ELSE 0 END) / 250.0, 6) AS n FROM segments GROUP BY session_id) q"""))
def p14(spark, sf):
    d = segments(spark, sf).groupBy("session_id").agg(*[F.round(F.sum(F.when(F.col("vlm_class") == c, 5).otherwise(0)) / 250.0, 6).alias(n) for c, n in (("distress", "d"), ("normal", "n"))])
    first = F.least("d", F.lit(1.0))
    return d.select("session_id", first.alias("distress"), F.least(F.col("n"), 1.0 - first).alias("normal"))


# ---- filters


def _filter(name: str, params: dict[str, str], sql: str, layer: str = "video"):
    @query(name, over(f"SELECT segment_id FROM segments WHERE {sql}"))
    def run(spark, sf, params=params):
        return segments(spark, sf).where(filters.parse(params, layer).column()).select("segment_id")

    return run


_filter("F1_parse", {"session": "S00001,S00002", "status": "send,audit", "min_confidence": "0.9", "_t": "1"}, "session_id IN ('S00001', 'S00002') AND status IN ('send', 'audit') AND confidence >= 0.9")
_filter("F2_session", {"session": "S00003,S00017"}, "session_id IN ('S00003', 'S00017')")
_filter("F3_time_range", {"date_from": "2024-01-05", "date_to": "2024-01-07"}, "utc >= TIMESTAMP '2024-01-05' AND utc < TIMESTAMP '2024-01-08'")
_filter("F4_label", {"label": "potholes,EDGE CRACKING"}, "label_text LIKE '%Potholes%'")
_filter("F5_choices", {"severity": "high,low", "vlm_class": "distress"}, "severity IN ('High', 'Low') AND vlm_class = 'distress'")
_filter("F6_flags", {"reviewed": "false", "needs_review": "true"}, "coalesce(expert_reviewed, false) = false AND coalesce(needs_expert_review, false) = true")
_filter("F7_confidence", {"min_confidence": "0.95"}, "confidence >= 0.95")
_filter("F8_bbox", {"bbox": "77.502,12.9001,77.504,12.902"}, "centre_lon BETWEEN 77.502 AND 77.504 AND centre_lat BETWEEN 12.9001 AND 12.902")


@query("F9_citizen_default", over("SELECT id FROM assessments WHERE status <> 'expert_review' AND confidence >= 0.2"))
def f9(spark, sf):
    return view(spark, sf, "assessments").where(filters.parse({"min_confidence": "0.2"}, "citizen").column()).select("id")


@query("F10_queues", over("SELECT count(*) FILTER (answered AND coalesce(needs_expert_review, false) AND NOT coalesce(expert_reviewed, false)) AS needs_review, count(*) FILTER (answered AND NOT coalesce(needs_expert_review, false) AND NOT coalesce(expert_reviewed, false)) AS auto, count(*) FILTER (answered AND NOT coalesce(expert_reviewed, false)) AS random, count(*) FILTER (answered AND coalesce(expert_reviewed, false)) AS reviewed FROM segments"))
def f10(spark, sf):
    return segments(spark, sf).agg(*[F.count_if(filters.queue(q)).alias(q) for q in filters.QUEUES])


@query("F11_element_exists", over("SELECT segment_id FROM segments WHERE list_contains(string_split(label_text, '|'), 'Alligator Cracking')"))
def f11(spark, sf):
    return segments(spark, sf).where(F.array_contains("final_labels", "Alligator Cracking")).select("segment_id")


@query("F12_dashboard_filter", over("SELECT id FROM assessments WHERE status IN ('classified', 'failed') AND created_at >= TIMESTAMP '1995-01-01' AND created_at <= TIMESTAMP '1996-12-31' ORDER BY created_at DESC, id LIMIT 50 OFFSET 10"))
def f12(spark, sf):
    a = view(spark, sf, "assessments").where(F.col("status").isin("classified", "failed") & F.col("created_at").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")))
    return a.orderBy(F.desc("created_at"), "id").offset(10).limit(50).select("id")


@query("F13_changed_since", over("SELECT id FROM assessments WHERE created_at > TIMESTAMP '1997-06-01' OR created_at + INTERVAL 200 DAY > TIMESTAMP '1998-01-01'"))
def f13(spark, sf):
    since = lambda c, t: c > F.lit(t).cast("timestamp")
    return view(spark, sf, "assessments").where(since(F.col("created_at"), "1997-06-01") | since(F.col("created_at") + F.expr("INTERVAL 200 DAYS"), "1998-01-01")).select("id")


@query("F14_row_policy", over("SELECT id FROM assessments WHERE status = 'expert_review' OR coalesce(is_distressed, false)"))
def f14(spark, sf):
    return view(spark, sf, "assessments").where((F.col("status") == "expert_review") | F.coalesce("is_distressed", F.lit(False))).select("id")


@query("F15_gate", over("SELECT CASE WHEN confidence >= 0.8 AND (vlm_class <> 'distress' OR (0.3 + value / 400) >= 0.8) AND NOT coalesce(needs_expert_review, false) THEN 'classified' ELSE 'expert_review' END AS status, count(*) AS n FROM segments GROUP BY 1"))
def f15(spark, sf):
    g = filters.gate(F.col("confidence"), 0.3 + F.col("value") / 400, F.col("vlm_class") == "distress", F.col("needs_expert_review"))
    return segments(spark, sf).select(g.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("F16_client_day", over("SELECT segment_id FROM segments WHERE utc >= TIMESTAMP '2024-01-05' - INTERVAL 330 MINUTE AND utc < TIMESTAMP '2024-01-06' - INTERVAL 330 MINUTE"))
def f16(spark, sf):
    return segments(spark, sf).where(filters.parse({"date_from": "2024-01-05", "date_to": "2024-01-05"}, zone="Asia/Kolkata").column()).select("segment_id")


# ---- aggregates

_TOTALS = ", ".join(
    ["count(*) AS segments"]
    + [f"count(*) FILTER (status = '{s}') AS n_{s}" for s in L.STATUSES]
    + [f"count(*) FILTER (vlm_class = '{c}') AS class_{c}" for c in L.CLASSES]
    + ["count(*) FILTER (answered) AS n_answered", "count(*) FILTER (needs_expert_review) AS n_needs_review", "count(*) FILTER (expert_reviewed) AS n_reviewed"]
    + ["sum(length_m) AS route_m", f"coalesce(sum(length_m) FILTER ({_COVERED}), 0) AS surveyed_m", "coalesce(sum(length_m) FILTER (status IN ('send', 'audit')), 0) AS sent_m", f"coalesce(sum(length_m) FILTER ({_COVERED} AND vlm_class IN ('distress', 'normal')), 0) AS classified_m"]
    + [f"coalesce(sum(length_m) FILTER (vlm_class = '{c}'), 0) AS {c}_m" for c in L.CLASSES]
)
_SHARES = "CASE WHEN surveyed_m > 0 THEN round(100.0 * distress_m / surveyed_m, 3) END AS pct_distress_of_surveyed, CASE WHEN classified_m > 0 THEN round(100.0 * distress_m / classified_m, 3) END AS pct_distress_of_classified"


@query("A8_segment_totals", over(f"SELECT *, {_SHARES} FROM (SELECT {_TOTALS} FROM segments) q"))
def a8(spark, sf):
    return A.aggregate(segments(spark, sf))


@query("A8_labels", over(f"SELECT label, count(*) AS segments, sum(length_m) AS length_m FROM (SELECT unnest(CASE WHEN vlm_class = 'distress' THEN string_split(label_text, '|') ELSE ['Normal'] END) AS label, length_m FROM segments WHERE {_COVERED} AND vlm_class IN ('distress', 'normal')) q GROUP BY label"))
def a8l(spark, sf):
    return A.by_label(segments(spark, sf))


@query("A9_summary", over(f"SELECT count(DISTINCT session_id) AS sessions, count(*) AS segments, min(utc) AS first, max(utc) AS last, min(centre_lon) AS x0, max(centre_lat) AS y1 FROM segments WHERE {_BOX_SQL}"))
def a9(spark, sf):
    return segments(spark, sf).where(filters.parse(BOX).column()).agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("segments"), F.min("utc").alias("first"), F.max("utc").alias("last"), F.min("centre_lon").alias("x0"), F.max("centre_lat").alias("y1"))


_UNEVEN = "SELECT *, s0_m * 1.37 AS a, s1_m * 1.37 AS b FROM segments"


@query("A10_per_km", over(f"""
WITH u AS ({_UNEVEN}), m AS (SELECT session_id, min(a) AS base FROM u GROUP BY 1),
e AS (SELECT u.session_id, status, vlm_class, a - base AS a, b - base AS b FROM u JOIN m USING (session_id)),
x AS (SELECT *, unnest(range(CAST(floor(a / 100) AS BIGINT), greatest(CAST(floor(a / 100) AS BIGINT) + 1, CAST(ceil(b / 100 - 1e-12) AS BIGINT)))) AS km FROM e),
o AS (SELECT *, least(b, (km + 1) * 100.0) - greatest(a, km * 100.0) AS ov FROM x)
SELECT session_id, km, round(coalesce(sum(ov) FILTER ({_COVERED}), 0), 2) AS surveyed_m, round(coalesce(sum(ov) FILTER (vlm_class = 'distress'), 0), 2) AS distress_m, round(coalesce(sum(ov) FILTER (vlm_class = 'normal'), 0), 2) AS normal_m
FROM o WHERE ov > 0 GROUP BY 1, 2"""))
def a10(spark, sf):
    d = segments(spark, sf).withColumn("s0_m", F.col("s0_m") * 1.37).withColumn("s1_m", F.col("s1_m") * 1.37)
    return A.per_km(d, size=100.0).select("session_id", "km", "surveyed_m", "distress_m", "normal_m")


@query("A11_sessions", over(f"SELECT *, {_SHARES} FROM (SELECT session_id, {_TOTALS} FROM segments GROUP BY session_id) q"))
def a11(spark, sf):
    return A.aggregate(segments(spark, sf), "session_id")


@query("A12_meta", over("SELECT count(*) AS segments, count(DISTINCT session_id) AS sessions, count(DISTINCT CAST(utc AS DATE)) AS days, count(DISTINCT label_text) AS label_sets FROM segments"))
def a12(spark, sf):
    return segments(spark, sf).agg(F.count("*").alias("segments"), F.countDistinct("session_id").alias("sessions"), F.countDistinct(F.to_date("utc")).alias("days"), F.countDistinct("label_text").alias("label_sets"))


_QUANT = """q AS (SELECT session_id, CAST(floor(s0_m / 100) AS BIGINT) AS section, sum(length_m) AS length_m, coalesce(sum(length_m) FILTER (status <> 'not_covered'), 0) AS imaged_m,
 coalesce(sum(length_m) FILTER (status IN ('send', 'audit') AND vlm_class IN ('distress', 'normal')), 0) AS classified_m, coalesce(sum(length_m) FILTER (status = 'skip'), 0) AS skip_m,
 coalesce(sum(length_m) FILTER (status IN ('send', 'audit') AND vlm_class = 'distress' AND label_text LIKE '%Cracking%'), 0) AS cracking_m,
 coalesce(sum(length_m) FILTER (status IN ('send', 'audit') AND vlm_class = 'distress' AND label_text LIKE '%Potholes%'), 0) AS potholes_m FROM segments GROUP BY 1, 2)"""


def sections(spark, sf):
    return A.coverage(A.quantities(segments(spark, sf).withColumn("section", F.floor(F.col("s0_m") / 100)), "session_id", "section"))


@query("A13_unit_quantities", over(f"WITH {_QUANT} SELECT *, CASE WHEN classified_m + skip_m <= 0 OR classified_m <= 0 OR imaged_m / length_m < 0.5 - 1e-9 THEN 'insufficient' WHEN imaged_m / length_m < 0.8 - 1e-9 THEN 'low_coverage' ELSE 'rated' END AS coverage_status FROM q"))
def a13(spark, sf):
    return sections(spark, sf).select("session_id", "section", "length_m", "imaged_m", "classified_m", "skip_m", "cracking_m", "potholes_m", "coverage_status")


@query("A14_extents", over(f"WITH {_QUANT} SELECT session_id, section, round(100.0 * potholes_m / (classified_m + skip_m), 6) AS lo, round(100.0 * (potholes_m + 0.1028 * skip_m) / (classified_m + skip_m), 6) AS hi, round(100.0 * (potholes_m + 9.0 / 161 * skip_m) / (classified_m + skip_m), 6) AS point FROM q WHERE classified_m + skip_m > 0"))
def a14(spark, sf):
    d = A.extents(sections(spark, sf).where("denominator_m > 0"), "potholes")
    return d.select("session_id", "section", *[F.round(f"potholes_{n}", 6).alias(n) for n in ("lo", "hi", "point")])


@query("A15_worst_severity", over("SELECT session_id, label, max(CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END) AS worst FROM (SELECT session_id, severity, unnest(string_split(label_text, '|')) AS label FROM segments WHERE vlm_class = 'distress') q GROUP BY 1, 2"))
def a15(spark, sf):
    rank = F.when(F.col("severity") == "Low", 1).when(F.col("severity") == "Medium", 2).when(F.col("severity") == "High", 3)
    return segments(spark, sf).where("vlm_class = 'distress'").select("session_id", rank.alias("r"), F.explode("final_labels").alias("label")).groupBy("session_id", "label").agg(F.max("r").alias("worst"))


@query("A16_run_histogram", over("WITH p AS (SELECT session_id, k, k - row_number() OVER (PARTITION BY session_id ORDER BY k) AS g FROM segments WHERE vlm_class = 'distress' AND label_text LIKE '%Potholes%' AND status IN ('send', 'audit')), r AS (SELECT session_id, g, count(*) AS n FROM p GROUP BY 1, 2) SELECT n, count(*) AS runs FROM r GROUP BY n"))
def a16(spark, sf):
    from ..operators.islands import runs

    hit = (F.col("vlm_class") == "distress") & F.array_contains("final_labels", "Potholes") & F.col("status").isin("send", "audit")
    return runs(segments(spark, sf), hit, "session_id", "k").groupBy("n").agg(F.count("*").alias("runs"))


@query("A17_probe_fraction", over("SELECT grp, round(sum(CASE WHEN greatest(p1, p2) >= 0.6 THEN 5.0 ELSE 0 END) / sum(5.0), 6) AS fraction FROM probes GROUP BY grp"))
def a17(spark, sf):
    from ..functions.arrays import best_score

    d = view(spark, sf, "probes").withColumn("scores", F.create_map(F.lit("Potholes"), F.col("p1"), F.lit("Ravelling"), F.col("p2")))
    hit = best_score(F.col("scores"), ["Potholes", "Ravelling", "Rutting"]) >= 0.6
    return d.groupBy("grp").agg(F.round(F.sum(F.when(hit, 5.0).otherwise(0.0)) / F.sum(F.lit(5.0)), 6).alias("fraction"))


@query("A18_weighted_rms", over("SELECT session_id, round(sqrt(sum(value * value * length_m) / sum(length_m)), 6) AS rms, round(sum(value * length_m) / sum(length_m), 6) AS mean FROM segments WHERE status <> 'not_covered' GROUP BY 1"))
def a18(spark, sf):
    d = segments(spark, sf).where("status <> 'not_covered'")
    return d.groupBy("session_id").agg(F.round(F.sqrt(F.sum(F.expr("value * value * length_m")) / F.sum("length_m")), 6).alias("rms"), F.round(F.sum(F.expr("value * length_m")) / F.sum("length_m"), 6).alias("mean"))


@query("A19_blocks", over("SELECT session_id, CAST(floor(s0_m / 100) AS BIGINT) AS block, round(avg(value), 6) AS v, count(*) AS n FROM segments GROUP BY 1, 2"))
def a19(spark, sf):
    return segments(spark, sf).groupBy("session_id", F.floor(F.col("s0_m") / 100).alias("block")).agg(F.round(F.avg("value"), 6).alias("v"), F.count("*").alias("n"))


@query("A20_two_level", over("SELECT session_id, round(sum(v * m) / sum(m), 6) AS iri, count(*) AS bins FROM (SELECT session_id, floor(s0_m / 100) AS b, ln(1 + avg(value)) AS v, sum(length_m) AS m FROM segments GROUP BY 1, 2) q WHERE v > 3 GROUP BY 1"))
def a20(spark, sf):
    b = segments(spark, sf).groupBy("session_id", F.floor(F.col("s0_m") / 100).alias("b")).agg(F.log1p(F.avg("value")).alias("v"), F.sum("length_m").alias("m")).where("v > 3")
    return b.groupBy("session_id").agg(F.round(F.sum(F.expr("v * m")) / F.sum("m"), 6).alias("iri"), F.count("*").alias("bins"))


@query("A21_km_mean", over("SELECT user_id % 7 AS road, round(sum(length_m * value) / sum(length_m), 6) AS pci, sum(length_m) / 1000 AS km FROM segments WHERE vlm_class IN ('distress', 'normal') GROUP BY 1"))
def a21(spark, sf):
    d = segments(spark, sf).where(F.col("vlm_class").isin("distress", "normal"))
    return d.groupBy((F.col("user_id") % 7).alias("road")).agg(F.round(F.sum(F.expr("length_m * value")) / F.sum("length_m"), 6).alias("pci"), (F.sum("length_m") / 1000).alias("km"))


@query("A22_class_counts", over("SELECT severity, vlm_class, count(*) AS n FROM segments GROUP BY 1, 2"))
def a22(spark, sf):
    return segments(spark, sf).groupBy("severity", "vlm_class").agg(F.count("*").alias("n"))


@query("A23_csv_inputs", over("SELECT block % 50 AS section, round(sum(x * y) / sum(x), 6) AS cracking, sum(c1) AS potholes FROM survey GROUP BY 1"))
def a23(spark, sf):
    return view(spark, sf, "survey").groupBy((F.col("block") % 50).alias("section")).agg(F.round(F.sum(F.expr("x * y")) / F.sum("x"), 6).alias("cracking"), F.sum("c1").alias("potholes"))


@query("A24_day_summary", over("""
WITH d AS (SELECT strftime(utc, '%Y-%m-%d') AS day, count(*) FILTER (vlm_class = 'distress') AS hit, count(*) FILTER (answered) AS n FROM segments GROUP BY 1)
SELECT day, hit, n, round((hit / n + 3.841458881296 / (2 * n) - 1.959964 * sqrt(hit / n * (1 - hit / n) / n + 3.841458881296 / (4 * n * n))) / (1 + 3.841458881296 / n), 4) AS lo FROM d""".replace("hit / n", "(hit * 1.0E0 / n)")))
def a24(spark, sf):
    from ..functions.stats import wilson

    d = segments(spark, sf).groupBy(F.date_format("utc", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("vlm_class") == "distress").alias("hit"), F.count_if("answered").alias("n"))
    return d.select("day", "hit", "n", wilson(F.col("hit"), F.col("n"))["lo"].alias("lo"))


@query("A25_medians", over("SELECT median(value) AS med, round(sum(value), 2) AS total FROM segments"))
def a25(spark, sf):
    return segments(spark, sf).agg(F.median("value").alias("med"), F.round(F.sum("value"), 2).alias("total"))


@query("A26_fixed_bins", over("SELECT CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS bin, count(*) AS n, round(avg(CASE WHEN vlm_class = 'distress' THEN 1.0 ELSE 0 END), 6) AS rate FROM segments GROUP BY 1"))
def a26(spark, sf):
    from ..functions.stats import edge_bin

    return segments(spark, sf).groupBy(edge_bin(F.col("value"), [10, 50, 100]).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("vlm_class") == "distress", 1.0).otherwise(0.0)), 6).alias("rate"))


@query("A27_quantile_bins", over("""
WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM segments),
e AS (SELECT j, (SELECT value FROM o WHERE i = CAST(floor(n * j / 4) AS BIGINT)) AS edge FROM (VALUES (1), (2), (3)) AS t(j))
SELECT (SELECT count(*) FROM e WHERE s.value >= edge) AS bin, count(*) AS n FROM segments s GROUP BY 1"""))
def a27(spark, sf):
    from ..functions.stats import index_edges

    d = segments(spark, sf)
    e = index_edges(d, "value", 4)
    b = F.size(F.filter("edges", lambda x: F.col("value") >= x)).cast("long")
    return d.join(F.broadcast(e)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query("A28_review_reasons", over("SELECT CASE WHEN confidence < 0.6 THEN 'low' WHEN vlm_class = 'unknown' THEN 'unknown' WHEN needs_expert_review THEN 'flag' ELSE 'none' END AS reason, count(*) AS n, count(*) FILTER (vlm_class = 'distress') AS distress FROM segments GROUP BY 1"))
def a28(spark, sf):
    r = F.when(F.col("confidence") < 0.6, "low").when(F.col("vlm_class") == "unknown", "unknown").when(F.col("needs_expert_review"), "flag").otherwise("none")
    return segments(spark, sf).groupBy(r.alias("reason")).agg(F.count("*").alias("n"), F.count_if(F.col("vlm_class") == "distress").alias("distress"))


@query("A29_regression", over("SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM survey"))
def a29(spark, sf):
    return view(spark, sf, "survey").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


@query("A30_session_metrics", over("SELECT session_id, sum(length_m) AS metres, round(100.0 * count(*) FILTER (status <> 'not_covered') / count(*), 3) AS coverage, count(*) FILTER (value < 5) AS low_light FROM segments GROUP BY 1"))
def a30(spark, sf):
    return segments(spark, sf).groupBy("session_id").agg(F.sum("length_m").alias("metres"), F.round(100.0 * F.count_if(F.col("status") != "not_covered") / F.count("*"), 3).alias("coverage"), F.count_if(F.col("value") < 5).alias("low_light"))


@query("A31_request_metrics", over("SELECT count(*) FILTER (stage1_ms IS NOT NULL) AS answered, count(*) FILTER (stage1_ms IS NULL) AS unanswered, median(stage1_ms) AS med, round(quantile_cont(stage1_ms, 0.95), 6) AS p95, round(avg(stage1_ms), 6) AS mean FROM assessments"))
def a31(spark, sf):
    return view(spark, sf, "assessments").agg(F.count("stage1_ms").alias("answered"), F.count_if(F.col("stage1_ms").isNull()).alias("unanswered"), F.median("stage1_ms").alias("med"), F.round(F.percentile("stage1_ms", 0.95), 6).alias("p95"), F.round(F.avg("stage1_ms"), 6).alias("mean"))


@query("A32_last_good_answer", over("SELECT photo_id, max_by(id, id) AS id, max_by(label_text, id) AS label_text FROM assessments WHERE status IN ('classified', 'expert_review') GROUP BY 1"))
def a32(spark, sf):
    return view(spark, sf, "assessments").where(F.col("status").isin("classified", "expert_review")).groupBy("photo_id").agg(F.max("id").alias("id"), F.max_by("label_text", "id").alias("label_text"))


@query("A38_within_drive_median", over("""
WITH m AS (SELECT session_id, median(value) AS med FROM segments GROUP BY 1)
SELECT value >= med AS above, count(*) AS n, count(*) FILTER (vlm_class = 'distress') AS distress FROM segments JOIN m USING (session_id) GROUP BY 1"""))
def a38(spark, sf):
    d = segments(spark, sf)
    m = d.groupBy("session_id").agg(F.median("value").alias("med"))
    return d.join(m, "session_id").groupBy((F.col("value") >= F.col("med")).alias("above")).agg(F.count("*").alias("n"), F.count_if(F.col("vlm_class") == "distress").alias("distress"))


@query("A45_mode", over("SELECT label_text, count(*) AS n FROM segments GROUP BY 1 ORDER BY n DESC, label_text LIMIT 1"))
def a45(spark, sf):
    return segments(spark, sf).groupBy("label_text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label_text").limit(1)


@query("A46_data_key", over("SELECT count(*) AS n, max(utc) AS a, max(event_id) AS b, max(k) AS c FROM segments"))
def a46(spark, sf):
    return segments(spark, sf).agg(F.count("*").alias("n"), F.max("utc").alias("a"), F.max("event_id").alias("b"), F.max("k").alias("c"))


@query("A47_heat_weights", over("SELECT segment_id, CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END AS weight FROM segments WHERE vlm_class = 'distress'"))
def a47(spark, sf):
    return segments(spark, sf).where("vlm_class = 'distress'").select("segment_id", F.when(F.col("severity") == "Low", 1).when(F.col("severity") == "Medium", 2).when(F.col("severity") == "High", 3).alias("weight"))


@query("A49_jolt", over("SELECT segment_id, round(value / m, 6) AS jolt FROM segments JOIN (SELECT session_id, median(value) AS m FROM segments GROUP BY 1) q USING (session_id)"))
def a49(spark, sf):
    d = segments(spark, sf)
    m = d.groupBy("session_id").agg(F.median("value").alias("m"))
    return d.join(m, "session_id").select("segment_id", F.round(F.col("value") / F.col("m"), 6).alias("jolt"))


@query("A50_quartile_p90", over("""
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM segments),
x AS (SELECT CASE WHEN value < a THEN 0 WHEN value < b THEN 1 WHEN value < c THEN 2 ELSE 3 END AS bin, confidence * value AS j FROM segments, q)
SELECT bin, round(quantile_cont(j, 0.9), 6) AS p90, count(*) AS n FROM x GROUP BY bin HAVING count(*) >= 400"""))
def a50(spark, sf):
    d = segments(spark, sf)
    q = d.agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    x = d.join(F.broadcast(q)).select(F.size(F.filter("e", lambda v: F.col("value") >= v)).alias("bin"), (F.col("confidence") * F.col("value")).alias("j"))
    return x.groupBy("bin").agg(F.round(F.percentile("j", 0.9), 6).alias("p90"), F.count("*").alias("n")).where("n >= 400")


