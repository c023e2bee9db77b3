"""Report, reader, repair and request queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import estimate, signal
from ..operators import checks, network, report, spatial, work
from ..session import scratch
from ..sources import readers, sinks
from ..sources.views import over, table, view
from .registry import query, whole
from .segments import segments


@query("S3_json_lines", "SELECT event_id, value FROM events WHERE event_id % 5 <> 0")
def s3(spark, sf):
    at = scratch(spark, "s3")
    line = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "value")))
    table(spark, sf, "events").select(line.alias("value")).write.text(at)
    return readers.json_lines(spark, at, "event_id long, value double").where("event_id is not null")


@query("S4_sidecars", "SELECT n_nationkey, n_name FROM nation")
def s4(spark, sf):
    at = scratch(spark, "s4")
    table(spark, sf, "nation").repartition(25, "n_nationkey").sortWithinPartitions("n_nationkey").write.option("maxRecordsPerFile", 1).json(at)
    return readers.sidecars(spark, at, "n_nationkey int, n_name string").select("n_nationkey", "n_name")


@query("S5_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def s5(spark, sf):
    at = scratch(spark, "s5")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(at)
    return readers.csv(spark, at, "c_custkey long, c_name string, c_acctbal double")


@query("S6_survey_csv", "SELECT concat('x', s_suppkey) AS section_id FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0")
def s6(spark, sf):
    at = scratch(spark, "s6")
    k = F.col("s_suppkey")
    n = lambda v: F.lit(v).cast("double")
    cols = {"section_id": F.concat(F.lit("x"), k.cast("string")), "start_lat": n(12.9), "start_lon": n(77.5), "end_lat": n(12.9), "end_lon": n(77.5), "road_class": F.when(k % 7 == 0, "lane").otherwise("urban"), "surface": F.lit("BC"), "cracking_pct": F.when(k % 5 == 0, 140.0).otherwise(4.0), "ravelling_pct": n(1), "potholes_number": n(1), "patching_pct": n(1), "rut_depth_mm": n(1), "iri_m_km": n(3), "pci": n(70)}
    table(spark, sf, "supplier").select(*[c.alias(a) for a, c in cols.items()]).write.option("header", True).csv(at)
    return readers.survey(spark, at)[0].select("section_id")


@query("S7_imu_csv", "SELECT count(*) AS n FROM events WHERE event_id % 4 <> 0")
def s7(spark, sf):
    at = scratch(spark, "s7")
    e = table(spark, sf, "events")
    x = F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("value"))
    rows = e.select(F.col("event_id").alias("t_ns"), F.lit("acc").alias("sensor"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(9.8).alias("z"))
    rows.union(rows.where("t_ns % 10 = 1")).write.option("header", True).csv(at)
    return readers.imu(spark, at).agg(F.count("*").alias("n"))


@query("S8_boxes", "SELECT p_partkey % 4 AS class_id, count(*) AS n FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1")
def s8(spark, sf):
    at = scratch(spark, "s8")
    k = F.col("p_partkey")
    line = F.when(k % 9 == 0, F.lit("bad")).otherwise(F.concat_ws(" ", (k % 4).cast("string"), F.lit("0.5 0.5 0.2"), F.lit("0.1")))
    table(spark, sf, "part").select(line.alias("value")).write.text(at)
    return readers.yolo_boxes(spark, at).groupBy(F.col("class_id").cast("long").alias("class_id")).agg(F.count("*").alias("n"))


@query("S17_fingerprints", "SELECT 1 AS sessions")
def s17(spark, sf):
    at = scratch(spark, "s17")
    table(spark, sf, "nation").write.json(f"{at}/drive1")
    return readers.fingerprints(spark, at).where("session = 'drive1' and length(fingerprint) = 64").agg(F.count("*").cast("int").alias("sessions"))


@query("Q23_folder_identity", "SELECT 0 AS differing")
def q23(spark, sf):
    a = scratch(spark, "q23")
    table(spark, sf, "region").coalesce(1).write.json(a)
    h = sinks.file_hashes(spark, a)
    return sinks.folder_difference(h, h).agg(F.count("*").cast("int").alias("differing"))


_LEVEL = "sum(length_m) AS length_m, coalesce(sum(length_m) FILTER (status IN ('send', 'audit') AND vlm_class = 'distress' AND label_text LIKE '%Potholes%'), 0) AS potholes_m FROM segments"


@query("U5_report", over(f"SELECT 'section' AS level, session_id AS path, CAST(floor(s0_m / 100) AS BIGINT) AS unit, {_LEVEL} GROUP BY 2, 3 UNION ALL SELECT 'km', session_id, CAST(floor(s0_m / 1000) AS BIGINT), {_LEVEL} GROUP BY 2, 3 UNION ALL SELECT 'stretch', session_id, 0, {_LEVEL} GROUP BY 2"))
def u5(spark, sf):
    d = segments(spark, sf).withColumn("path", F.col("session_id")).withColumn("m", F.col("s0_m"))
    return report.report(d).select("level", "path", "unit", "length_m", "potholes_m")


@query("U5_report_ratings")
def u5r(spark, sf):
    d = segments(spark, sf).withColumn("path", F.col("session_id")).withColumn("m", F.col("s0_m"))
    return report.report(d).select("level", "path", "unit", "coverage_status", "final_lo", "final_hi", "class")


@query("U2_membership", over("WITH t AS (SELECT max(s1_m) AS total FROM segments WHERE user_id = 3) SELECT segment_id, CAST(least(floor(s0_m / 100), greatest(1, floor(total / 100) + CASE WHEN total - floor(total / 100) * 100 >= 50 THEN 1 ELSE 0 END) - 1) AS BIGINT) AS section, 'path' AS role FROM segments, t WHERE user_id = 3"))
def u2(spark, sf):
    d = segments(spark, sf)
    return report.membership(d, d.where("user_id = 3").select("segment_id", F.col("s0_m").alias("m"), F.lit("path").alias("role")))


@query("U6_geometry", over("WITH d AS (SELECT session_id, k, status <> 'not_covered' AS surveyed, CASE WHEN coalesce(lag(status <> 'not_covered') OVER w <> (status <> 'not_covered') OR lag(k) OVER w <> k - 1, true) THEN 1 ELSE 0 END AS b FROM segments WINDOW w AS (PARTITION BY session_id ORDER BY k)), p AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY k) AS part FROM d) SELECT session_id, surveyed, min(k) AS a, max(k) AS b, count(*) AS points FROM p GROUP BY session_id, surveyed, part"))
def u6(spark, sf):
    return report.geometry(segments(spark, sf)).select("session_id", "surveyed", "a", "b", "points")


def _reasons(records, rules):
    """How many records break each rule."""
    d = checks.reasons(records, "rec", rules)
    return d.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_REVIEW = """SELECT concat('{"reviewer_name": "', CASE WHEN id % 11 = 0 THEN ' ' WHEN id % 37 = 0 THEN repeat('Name', 16) ELSE reviewer END, '", "types": [', CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN '"zebra"'
  WHEN 2 THEN '"Normal", "Potholes"' WHEN 3 THEN '"Normal"' ELSE '"Potholes", "Ravelling"' END, CASE WHEN id % 23 = 0 THEN '}' ELSE ']' END, ', "severity": ', CASE id % 5 WHEN 0 THEN '"odd"' WHEN 1 THEN 'null' ELSE '"High"' END,
  CASE WHEN id % 13 = 0 THEN concat(', "notes": "', repeat('x', 2001), '"') ELSE '' END, '}') AS rec FROM reviews"""


@query("V5_review_rules", over(f"""WITH r AS ({_REVIEW}), j AS (SELECT rec, json_valid(rec) AS ok FROM r), f AS (SELECT ok, CASE WHEN ok THEN trim(coalesce(rec ->> '$.reviewer_name', '')) END AS who,
  CASE WHEN ok THEN CAST(json_extract(rec, '$.types') AS VARCHAR[]) END AS types, CASE WHEN ok THEN rec ->> '$.severity' END AS sev, CASE WHEN ok THEN length(coalesce(rec ->> '$.notes', '')) END AS notes FROM j),
  o AS (SELECT unnest(CASE WHEN NOT ok THEN ['not JSON'] ELSE list_filter([CASE WHEN who = '' THEN 'reviewer_name is missing' END, CASE WHEN length(who) > 60 THEN 'reviewer_name is too long' END,
  CASE WHEN len(types) NOT BETWEEN 1 AND 12 THEN 'types are no list of some' END, CASE WHEN list_contains(types, 'zebra') THEN 'unknown types' END, CASE WHEN list_contains(types, 'Normal') AND len(types) > 1 THEN 'Normal stands alone' END,
  CASE WHEN coalesce(sev, 'null') NOT IN ('None', 'Low', 'Medium', 'High', 'Unknown') THEN 'unknown severity' END, CASE WHEN notes > 2000 THEN 'notes are too long' END], lambda x: x IS NOT NULL) END) AS reason FROM f)
  SELECT reason, count(*) AS n FROM o GROUP BY 1"""))
def v5(spark, sf):
    from ..functions import labels as L

    return _reasons(_from(spark, sf, _REVIEW, "reviews"), checks.review_rules(L.DISTRESS, L.SEVERITIES))


def _from(spark, sf, text, name):
    """A query text over a view; its braces are JSON's, so it runs on a name of its own."""
    view(spark, sf, name).createOrReplaceTempView(f"__{name}")
    return spark.sql(text.replace(f"FROM {name}", f"FROM __{name}"))


_ROUGH = """SELECT concat('{"schema": "', CASE WHEN id % 29 = 0 THEN 'v0' ELSE 'v1' END, '", "model": "log_linear", "terms": [', CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN '"log_rms_av", "other"' ELSE '"log_rms_av", "log_speed"' END,
  '], "coef": {"intercept": ', CASE id % 5 WHEN 0 THEN '"1"' ELSE '1.5' END, ', "log_rms_av": 0.9', CASE WHEN id % 3 = 0 THEN '' ELSE ', "log_speed": -0.4' END, '}, "unit_m": ', CASE WHEN id % 11 = 0 THEN '0' ELSE '100' END,
  ', "fit_range": {"rms_av": [0.1, 1], "speed_mps": ', CASE id % 4 WHEN 0 THEN '[12, 3]' WHEN 1 THEN '[3]' ELSE '[3, 12]' END, '}, "n": 40, "residual_sd_log": 0.1', CASE WHEN id % 13 = 0 THEN '' ELSE ', "source": {"survey": "s"}' END, CASE WHEN id % 31 = 0 THEN '' ELSE '}' END) AS rec FROM assessments"""


@query("V6_calibration_records", over(f"""WITH r AS ({_ROUGH}), f AS (SELECT json_valid(rec) AS ok, CASE WHEN json_valid(rec) THEN CAST(rec AS JSON) END AS v FROM r),
  g AS (SELECT *, CAST(v -> '$.terms' AS VARCHAR[]) AS terms, list_contains(['DOUBLE', 'BIGINT', 'UBIGINT'], json_type(v, '$.coef.intercept')) AS i, json_type(v, '$.coef.log_speed') AS sp, CAST(v -> '$.fit_range.speed_mps' AS DOUBLE[]) AS sr FROM f),
  o AS (SELECT unnest(CASE WHEN NOT ok THEN ['not JSON'] ELSE list_filter([CASE WHEN v ->> '$.schema' <> 'v1' THEN 'schema' END, CASE WHEN len(terms) = 0 OR list_contains(terms, 'other') THEN 'terms' END, CASE WHEN NOT i THEN 'coef.intercept' END,
  CASE WHEN list_contains(terms, 'log_speed') AND sp IS NULL THEN 'coef.log_speed' END, CASE WHEN CAST(v ->> '$.unit_m' AS DOUBLE) <= 0 THEN 'unit_m' END, CASE WHEN len(sr) <> 2 OR sr[1] >= sr[2] THEN 'fit_range.speed_mps' END,
  CASE WHEN json_type(v, '$.source') IS NULL THEN 'source' END], lambda x: x IS NOT NULL) END) AS reason FROM g) SELECT reason, count(*) AS n FROM o GROUP BY 1"""))
def v6(spark, sf):
    return _reasons(_from(spark, sf, _ROUGH, "assessments"), checks.roughness_rules("v1"))


_PARAMS = """SELECT concat('{"schema": ', CASE WHEN id % 19 = 0 THEN '1' ELSE '2' END, ', "probe_fp": "', CASE WHEN id % 17 = 0 THEN 'xyz' ELSE '0123456789abcdef' END, '", "params": {"cracking": {"source": "', CASE id % 5 WHEN 0 THEN 'guess' WHEN 1 THEN 'labels' ELSE 'probe' END,
  '", "threshold": ', CASE WHEN id % 7 = 0 THEN '1.5' ELSE '0.4' END, ', "b": ', CASE WHEN id % 11 = 0 THEN '-1' ELSE '2' END, '}, "', CASE id % 3 WHEN 0 THEN 'zebra' ELSE 'ravelling' END, '": {"source": "', CASE WHEN id % 13 = 0 THEN 'labels' ELSE 'probe' END, '", "threshold": 0.5}}}') AS rec FROM assessments"""


@query("U7_calibration_rules", over(f"""WITH r AS ({_PARAMS}), v AS (SELECT CAST(rec AS JSON) AS v FROM r),
  o AS (SELECT unnest(list_filter([CASE WHEN v ->> '$.schema' <> '2' THEN 'schema' END, CASE WHEN NOT regexp_full_match(v ->> '$.probe_fp', '[0-9a-f]{{16}}') THEN 'probe_fp' END, CASE WHEN list_contains(json_keys(v, '$.params'), 'zebra') THEN 'parameters' END,
  CASE WHEN v ->> '$.params.cracking.source' = 'guess' THEN 'source' END, CASE WHEN coalesce(v ->> '$.params.ravelling.source', v ->> '$.params.zebra.source') = 'labels' THEN 'labels' END, CASE WHEN v ->> '$.params.cracking.b' = '-1' THEN 'b' END,
  CASE WHEN v ->> '$.params.cracking.source' = 'probe' AND v ->> '$.params.cracking.threshold' = '1.5' THEN 'threshold' END], lambda x: x IS NOT NULL)) AS reason FROM v) SELECT reason, count(*) AS n FROM o GROUP BY 1"""))
def u7(spark, sf):
    return _reasons(_from(spark, sf, _PARAMS, "assessments"), checks.parameter_rules(("cracking", "potholes", "ravelling"), ("cracking", "potholes")))


_EX = "(centre_lon - 77.5) * 111320.0 * cos(radians(12.9))"


@query("G3_explicit_gap", over(f"WITH p AS (SELECT session_id, max_by({_EX}, k) AS ex, min_by({_EX}, k) AS sx, max_by((centre_lat - 12.9) * 111320.0, k) AS e, min_by((centre_lat - 12.9) * 111320.0, k) AS s FROM segments GROUP BY 1) SELECT a.session_id AS id, b.session_id AS id_b FROM p a JOIN p b ON a.session_id <> b.session_id AND sqrt((a.ex - b.sx) ** 2 + (a.e - b.s) ** 2) <= 300 ORDER BY round(sqrt((a.ex - b.sx) ** 2 + (a.e - b.s) ** 2), 6), 1, 2 LIMIT 1"))
def g3(spark, sf):
    x, _ = spatial.local_xy(F.col("centre_lon"), F.col("centre_lat"), 77.5, 12.9)
    return _explicit_gap(segments(spark, sf), x)


def _explicit_gap(drives, x):
    p = drives.withColumn("x", x).withColumn("y", (F.col("centre_lat") - 12.9) * 111320.0)
    g = p.groupBy(F.col("session_id").alias("id")).agg(F.max_by("y", "k").alias("e"), F.min_by("y", "k").alias("s"), F.max_by("x", "k").alias("ex"), F.min_by("x", "k").alias("sx"))
    end, start = g.select("id", F.col("ex").alias("x"), F.col("e").alias("y")), g.select("id", F.col("sx").alias("x"), F.col("s").alias("y"))
    hit = spatial.radius_pairs(end, start, 300.0).where("id <> id_b").withColumn("d", F.round("d", 6))
    return hit.orderBy("d", "id", "id_b").limit(1).select("id", "id_b")


@query("G4_refusals", over("WITH r AS (SELECT k, event_id % 12 AS via, event_id % 7 = 0 AS same, abs(value - 50) * 3 AS snap_m FROM segments) SELECT CASE WHEN same THEN 'start and goal are the same' WHEN via > 8 THEN 'more than 8 way points' WHEN snap_m > 40 THEN 'no node within 40 m' ELSE 'none' END AS why, count(*) AS n FROM r GROUP BY 1"))
def g4(spark, sf):
    """Requests of every segment, how many are refused and why."""
    r = segments(spark, sf).select((F.col("event_id") % 12).alias("via"), (F.col("event_id") % 7 == 0).alias("same"), (F.abs(F.col("value") - 50) * 3).alias("snap_m"))
    return r.groupBy(network.refusal(F.col("same"), F.col("via"), F.col("snap_m")).alias("why")).agg(F.count("*").alias("n"))


@query("G5_directions", over("SELECT session_id, CASE WHEN avg(cos(radians(value - 90))) >= 0 THEN 'same' ELSE 'opposite' END AS direction FROM segments GROUP BY 1"))
def g5(spark, sf):
    d = segments(spark, sf).select("session_id", F.col("value").alias("heading"), F.lit(90.0).alias("path_heading"))
    return network.direction(d, "session_id")


@query("K2_band_pass")
def k2(spark, sf):
    d = segments(spark, sf).select("session_id", (F.col("k") * 5_000_000).alias("t_ns"), F.col("value").alias("v"))
    return signal.windows(d, low=1.0, high=10.0)


@query("K5_profile", over("SELECT session_id, k, round(sum((value - 50) * 0.00025E0) OVER (PARTITION BY session_id ORDER BY k ROWS UNBOUNDED PRECEDING), 9) AS z FROM segments"))
def k5(spark, sf):
    """Elevations of a profile whose slopes a table gives, a quarter of a metre apart."""
    return signal.profile(segments(spark, sf).withColumn("slope", (F.col("value") - 50) * 0.001), "session_id", "k", "slope", 0.25).select("session_id", "k", F.round("z", 9).alias("z"))


@query("Z2_stale_claims", "SELECT CASE WHEN epoch(TIMESTAMP '2024-02-01') - epoch(ts) > 1000000 THEN 'pending' ELSE 'processing' END AS status, count(*) AS n FROM events GROUP BY 1")
def z2(spark, sf):
    q = table(spark, sf, "events").select("event_id", F.lit("processing").alias("status"), F.col("ts").cast("timestamp").alias("claimed_at"), F.lit(0).alias("retry_count"))
    return work.recover(q, F.lit("2024-02-01").cast("timestamp"), 1_000_000).groupBy("status").agg(F.count("*").alias("n"))


@query("R1_function_of_rows", over("SELECT id, 'processing' AS status FROM assessments WHERE status = 'pending' ORDER BY created_at, id LIMIT 7"))
def r1(spark, sf):
    return work.claim(view(spark, sf, "assessments"), 7).select("id", "status")


@query("R6_predicate_agreement", over("SELECT count(*) FILTER ((p1 >= 0.6) = (p2 >= 0.6)) AS agree, count(*) AS n FROM probes"))
def r6(spark, sf):
    rule = lambda c: c >= 0.6  # noqa: E731  any Column -> Column
    return view(spark, sf, "probes").agg(F.count_if(rule(F.col("p1")) == rule(F.col("p2"))).alias("agree"), F.count("*").alias("n"))


@query("M16_normal_quantile", over("SELECT count(*) AS n, CAST(0 AS INTEGER) AS off FROM probes WHERE p1 > 0 AND p1 < 1"))
def m16q(spark, sf):
    """Scores whose normal quantile isn't the mirror image of that of their complement."""
    d = view(spark, sf, "probes").where("p1 > 0 and p1 < 1").select(F.abs(estimate.normal_quantile(F.col("p1")) + estimate.normal_quantile(1 - F.col("p1"))).alias("e"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("e") > 1e-8).cast("int").alias("off"))
