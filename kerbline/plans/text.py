"""Labels, parsers, dates, arrays and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, labels, text, times
from ..sources.views import over, table, view
from .registry import query
from .segments import segments

_VARIANTS = "CASE id % 6 WHEN 0 THEN ' potholes ' WHEN 1 THEN 'Raveling' WHEN 2 THEN 'Block Crack (D43)' WHEN 3 THEN 'NORMAL' WHEN 4 THEN 'Dragon teeth' ELSE 'edge CRACKING' END"


def _raw(spark, sf):
    return view(spark, sf, "assessments").select("id", F.expr(_VARIANTS).alias("raw"))


@query("L1_canonical", over("SELECT id, CASE id % 6 WHEN 0 THEN 'Potholes' WHEN 3 THEN 'Normal' WHEN 5 THEN 'Edge Cracking' END AS label FROM assessments"))
def l1(spark, sf):
    return _raw(spark, sf).select("id", labels.canonical(F.col("raw")).alias("label"))


@query("L2_legacy", over("SELECT id, CASE id % 6 WHEN 0 THEN 'Potholes' WHEN 1 THEN 'Ravelling' WHEN 2 THEN 'Transverse Cracking' WHEN 3 THEN 'Normal' WHEN 4 THEN 'Dragon teeth' ELSE 'Edge Cracking' END AS label FROM assessments"))
def l2(spark, sf):
    return _raw(spark, sf).select("id", labels.canonical_or_legacy(F.col("raw")).alias("label"))


@query("L3_taxonomy", over("SELECT id, CASE id % 6 WHEN 0 THEN 'Potholes' WHEN 1 THEN 'Ravelling' WHEN 2 THEN 'Transverse Cracking' WHEN 4 THEN 'Dragon teeth' WHEN 5 THEN 'Edge Cracking' END AS label FROM assessments"))
def l3(spark, sf):
    return _raw(spark, sf).select("id", labels.taxonomy(F.col("raw")).alias("label"))


@query("L4_type_set", over("SELECT id, CASE WHEN label_text = 'Normal' THEN 0 ELSE len(list_distinct(string_split(label_text, '|'))) END AS n FROM assessments"))
def l4(spark, sf):
    return view(spark, sf, "assessments").select("id", F.size(labels.type_set(F.split("label_text", r"\|"))).cast("long").alias("n"))


@query("L5_severity", over("SELECT id, CASE id % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN 'None' WHEN 3 THEN 'Medium' ELSE 'Unknown' END AS s FROM assessments"))
def l5(spark, sf):
    raw = F.expr("CASE id % 5 WHEN 0 THEN '\"Large\".' WHEN 1 THEN ' minor, ' WHEN 2 THEN 'N/A' WHEN 3 THEN 'Moderate;' ELSE 'purple' END")
    return view(spark, sf, "assessments").select("id", labels.severity(raw).alias("s"))


@query("L6_pavement", "SELECT conv_id, turn, CASE regexp_extract(upper(trim(text)), '^([A-Z]+)', 1) WHEN 'YES' THEN 'yes' WHEN 'NO' THEN 'no' ELSE 'unsure' END AS p FROM conversations")
def l6(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", labels.pavement(F.col("text")).alias("p"))


@query("L7_stage1", over("SELECT id, CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE -1 END AS s FROM assessments"))
def l7(spark, sf):
    raw = F.expr("CASE id % 5 WHEN 0 THEN ' Normal. ' WHEN 1 THEN 'a crack here' WHEN 2 THEN 'distress, not normal' WHEN 3 THEN 'normal, no damage' ELSE 'sky' END")
    return view(spark, sf, "assessments").select("id", labels.stage1(raw).alias("s"))


@query("L8_stage2", over("SELECT id, CASE id % 3 WHEN 0 THEN 'Potholes,Ravelling' WHEN 1 THEN 'Alligator Cracking,Settlement' ELSE 'Normal' END AS types, CASE id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Unknown' ELSE 'None' END AS severity FROM assessments"))
def l8(spark, sf):
    raw = F.expr("CASE id % 3 WHEN 0 THEN 'DISTRESS_TYPES: pothole, Raveling, Other\nSEVERITY: Severe.\nDESCRIPTION: x' WHEN 1 THEN 'fatigue crack and some upheaval' ELSE 'distress_types: Normal\nseverity: n/a' END")
    s = labels.stage2(raw)
    return view(spark, sf, "assessments").select("id", F.array_join(s["types"], ",").alias("types"), s["severity"].alias("severity"))


@query("L9_class_ids", over("SELECT id, CASE WHEN label_text LIKE '%Potholes%' THEN '3' ELSE '' END AS ids FROM assessments"))
def l9(spark, sf):
    return view(spark, sf, "assessments").select("id", F.array_join(labels.class_ids(F.split("label_text", r"\|")).cast("array<string>"), ",").alias("ids"))


@query("L10_fuzzy", over("SELECT id, CASE WHEN id % 6 IN (0) THEN 'pothole' WHEN id % 6 = 2 THEN 'block crack' WHEN id % 6 = 5 THEN 'edge crack' END AS mapped FROM assessments"))
def l10(spark, sf):
    return text.fuzzy_map(_raw(spark, sf), "raw", ["pothole", "block crack", "edge crack"]).select("id", "mapped")


@query("L11_answer_text", over("SELECT id, CASE id % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS s FROM assessments"))
def l11(spark, sf):
    ids = F.when(F.col("id") % 3 == 0, F.array(F.lit(0))).when(F.col("id") % 3 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(3)))
    return view(spark, sf, "assessments").select("id", F.regexp_extract(text.answer_text(ids), r"SEVERITY: (\w+)", 1).alias("s"))


@query("L12_safe_name", "SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g') AS f FROM customer")
def l12(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.safe_file_name(F.col("c_name")).alias("f"))


@query("L13_segment_id", over("SELECT event_id, concat(session_id, '_seg', CASE WHEN k * 999 < 100000 THEN lpad(CAST(k * 999 AS VARCHAR), 5, '0') ELSE CAST(k * 999 AS VARCHAR) END) AS id FROM segments"))
def l13(spark, sf):
    return segments(spark, sf).select("event_id", text.segment_id(F.col("session_id"), F.col("k") * 999).alias("id"))


@query("L14_names", over(r"SELECT id, lower(regexp_replace(trim(reviewer), '\s+', ' ', 'g')) AS who FROM reviews"))
def l14(spark, sf):
    return view(spark, sf, "reviews").select("id", text.normal_name(F.col("reviewer")).alias("who"))


@query("L15_chainage", over("SELECT segment_id, concat('Km ', CAST(floor(s0_m * 7 / 1000) AS BIGINT), '+', lpad(CAST(CAST(s0_m * 7 AS BIGINT) % 1000 AS VARCHAR), 3, '0')) AS c FROM segments"))
def l15(spark, sf):
    return segments(spark, sf).select("segment_id", text.chainage(F.col("s0_m") * 7).alias("c"))


@query("L16_class_range", over("SELECT DISTINCT c1, c2, CASE WHEN c1 = c2 THEN n1 WHEN c1 < c2 THEN n1 || '–' || n2 ELSE n2 || '–' || n1 END AS r FROM (SELECT c1 % 3 AS c1, c2 % 3 AS c2, CASE c1 % 3 WHEN 0 THEN 'Poor' WHEN 1 THEN 'Fair' ELSE 'Good' END AS n1, CASE c2 % 3 WHEN 0 THEN 'Poor' WHEN 1 THEN 'Fair' ELSE 'Good' END AS n2 FROM survey) q"))
def l16(spark, sf):
    from ..functions.rating import class_range

    name = lambda c: F.when(F.col(c) == 0, "Poor").when(F.col(c) == 1, "Fair").otherwise("Good")
    d = view(spark, sf, "survey").select((F.col("c1") % 3).alias("c1"), (F.col("c2") % 3).alias("c2")).distinct()
    return d.select("c1", "c2", class_range(name("c1"), name("c2")).alias("r"))


@query("L17_treatment", over("SELECT segment_id, CASE string_split(label_text, '|')[1] WHEN 'Potholes' THEN 'Fill and compact, then seal' WHEN 'Longitudinal Cracking' THEN 'Seal cracks' ELSE 'Inspect' END AS t FROM segments"))
def l17(spark, sf):
    dim = spark.createDataFrame(list(text.TREATMENT.items()), "label string, t string")  # a fixed handful of rows
    d = segments(spark, sf).select("segment_id", F.get("final_labels", F.lit(0)).alias("label"))
    return d.join(F.broadcast(dim), "label", "left").select("segment_id", F.coalesce("t", F.lit("Inspect")).alias("t"))


@query("L18_headline", over("SELECT session_id, concat_ws(' ', session_id, CAST(count(*) AS VARCHAR), 'segments,', CAST(count(*) FILTER (vlm_class = 'distress') AS VARCHAR), 'with distress') AS h FROM segments GROUP BY 1"))
def l18(spark, sf):
    g = segments(spark, sf).groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("vlm_class") == "distress").alias("d"))
    return g.select("session_id", F.concat_ws(" ", "session_id", F.col("n").cast("string"), F.lit("segments,"), F.col("d").cast("string"), F.lit("with distress")).alias("h"))


@query("L19_url", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(url, '^http:', 'https:') AS url FROM pages")
def l19(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_replace("url", "^http:", "https:").alias("url"))


@query("L20_hash", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS h, md5(concat('s', event_id)) AS m FROM events""")
def l20(spark, sf):
    return table(spark, sf, "events").select("event_id", text.canonical_hash("event_type", "event_id").alias("h"), F.md5(F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("m"))


@query("L21_split_class", over("SELECT segment_id, label_text AS name, severity FROM segments"))
def l21(spark, sf):
    c = text.split_class(F.concat_ws(" - ", "label_text", "severity"))
    return segments(spark, sf).select("segment_id", c["name"].alias("name"), c["severity"].alias("severity"))


@query("L22_item_spans", over("SELECT segment_id, CASE WHEN len(string_split(label_text, '|')) > 1 THEN length(string_split(label_text, '|')[1]) + 2 END AS second FROM segments"))
def l22(spark, sf):
    s = text.item_spans(F.array_join("final_labels", ", "))
    return segments(spark, sf).select("segment_id", F.get(s, F.lit(1))["start"].cast("long").alias("second"))


# ---- dates


@query("D1_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS t FROM events")
def d1(spark, sf):
    return table(spark, sf, "events").select("event_id", times.iso(F.col("ts")).alias("t"))


@query("D2_parse", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS t FROM events")
def d2(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, "soon").when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", F.unix_timestamp(times.parse(raw)).alias("t"))


@query("D3_day_end", "SELECT event_id, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') AS d FROM events")
def d3(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format(times.day_end(F.col("ts")), "yyyy-MM-dd").alias("d"))


@query("D4_millis", "SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events")
def d4(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.unix_millis(F.timestamp_millis(ms)).alias("ms"))


@query("D5_local_day", "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS d FROM events")
def d5(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format(times.local_day(F.col("ts")), "yyyy-MM-dd").alias("d"))


@query("D6_season", "SELECT o_orderkey, CASE WHEN month(o_orderdate) BETWEEN 6 AND 9 THEN 'monsoon' WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'pre-monsoon' WHEN month(o_orderdate) IN (10, 11) THEN 'post-monsoon' ELSE 'winter' END AS s FROM orders")
def d6(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", times.season(F.col("o_orderdate")).alias("s"))


@query("D7_relative", "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR AND ts < TIMESTAMP '2024-01-20') AS h1, count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR AND ts < TIMESTAMP '2024-01-20') AS h24 FROM events")
def d7(spark, sf):
    at = F.lit("2024-01-20").cast("timestamp")
    return table(spark, sf, "events").agg(F.count_if(times.within(F.col("ts"), at, hours=1)).alias("h1"), F.count_if(times.within(F.col("ts"), at, hours=24)).alias("h24"))


@query("D8_same_instant", "SELECT count(*) AS n FROM events")
def d8(spark, sf):
    a, b = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+00:00"))
    return table(spark, sf, "events").where(times.parse(a) == times.parse(b)).agg(F.count("*").alias("n"))


@query("D9_utc_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def d9(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("D10_day_prefix", over("SELECT substr(session_id, 1, 4) AS p, count(*) AS n FROM segments GROUP BY 1"))
def d10(spark, sf):
    return segments(spark, sf).groupBy(F.substring("session_id", 1, 4).alias("p")).agg(F.count("*").alias("n"))


# ---- arrays and maps


def _scores(spark, sf):
    return view(spark, sf, "probes").withColumn("m", F.create_map(F.lit("Potholes"), F.col("p1"), F.lit("Ravelling"), F.col("p2")))


@query("N1_best_score", over("SELECT id, greatest(p2, 0.0) AS v FROM probes"))
def n1(spark, sf):
    return _scores(spark, sf).select("id", arrays.best_score(F.col("m"), ["Ravelling", "Rutting"]).alias("v"))


@query("N2_decide", over("SELECT id, CASE WHEN p1 >= 0.6 AND p2 >= 0.6 THEN CASE WHEN p2 > p1 THEN 'b,a' ELSE 'a,b' END WHEN p1 >= 0.6 THEN 'a' WHEN p2 >= 0.6 THEN 'b' ELSE '' END AS d FROM probes"))
def n2(spark, sf):
    return _scores(spark, sf).select("id", F.array_join(arrays.decide(F.col("m"), {"a": ["Potholes"], "b": ["Ravelling"]}, 0.6), ",").alias("d"))


@query("N3_strongest", over("SELECT id, CASE WHEN p2 >= p1 THEN 'Ravelling' ELSE 'Potholes' END AS k, greatest(p1, p2) AS v FROM probes"))
def n3(spark, sf):
    s = arrays.strongest(F.col("m"))
    return _scores(spark, sf).select("id", s["key"].alias("k"), s["score"].alias("v"))


@query("N4_combine", over("SELECT id, greatest(p1, p2) AS a, round((p1 + p2) / 2, 6) AS b FROM probes"))
def n4(spark, sf):
    one, two = F.create_map(F.lit("x"), F.col("p1")), F.create_map(F.lit("x"), F.col("p2"))
    d = view(spark, sf, "probes")
    return d.select("id", F.element_at(arrays.combine(one, two, "max"), "x").alias("a"), F.round(F.element_at(arrays.combine(one, two, "mean"), "x"), 6).alias("b"))


@query("N5_geometric", over("SELECT id, round(exp((ln(p1 + 0.01) + ln(p2 + 0.01)) / 2), 4) AS g, round(exp(ln(p1 + 0.01) + ln(p2 + 0.01)), 4) AS j FROM probes"))
def n5(spark, sf):
    g = arrays.geometric(F.array(F.log(F.col("p1") + 0.01), F.lit(None).cast("double"), F.log(F.col("p2") + 0.01)))
    return view(spark, sf, "probes").select("id", g["mean"].alias("g"), g["joint"].alias("j"))


@query("N6_primary_entry", over("SELECT segment_id, CASE WHEN label_text LIKE 'Potholes%' THEN 'Potholes' END AS e FROM segments"))
def n6(spark, sf):
    return segments(spark, sf).select("segment_id", F.get(F.filter("final_labels", lambda x: labels.canonical(x) == "Potholes"), F.lit(0)).alias("e"))


@query("N7_join", over("SELECT segment_id, replace(label_text, '|', '; ') AS s FROM segments"))
def n7(spark, sf):
    return segments(spark, sf).select("segment_id", F.array_join("final_labels", "; ").alias("s"))


@query("N8_json_safe", over("SELECT segment_id, '{\"k\":' || k || '}' AS j FROM segments"))
def n8(spark, sf):
    bad = F.when(F.col("k") < 0, F.col("value")).otherwise(F.lit(float("nan")))
    return segments(spark, sf).select("segment_id", F.to_json(F.struct("k", F.when(~F.isnan(bad), bad).alias("v"))).alias("j"))


@query("N9_private_fields", over("SELECT segment_id, k FROM segments"))
def n9(spark, sf):
    d = segments(spark, sf).select("segment_id", "k", F.lit(1).alias("_cache"))
    return d.drop(*[c for c in d.columns if c.startswith("_")])


@query("N10_json_number", "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS v FROM events")
def n10(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "double").alias("v"))


@query("N11_passthrough", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def n11(spark, sf):
    v = F.parse_json(F.concat(F.lit('{"list": ['), F.get_json_object("props", "$.k"), F.lit("]}")))
    return table(spark, sf, "events").select("event_id", F.get(F.try_variant_get(v, "$.list", "array<long>"), F.lit(0)).alias("k"))


# ---- sinks


@query("S10_csv_cells", over("SELECT segment_id, replace(label_text, '|', '; ') AS final_labels, coalesce(CAST(expert_reviewed AS VARCHAR), '') AS expert_reviewed FROM segments"))
def s10(spark, sf):
    return text.csv_row(segments(spark, sf).select("segment_id", "final_labels", "expert_reviewed"))


@query("S11_formula_guard", over("SELECT id, CASE WHEN id % 3 = 0 THEN concat('''', '=x', id) ELSE concat('x', id) END AS c FROM assessments"))
def s11(spark, sf):
    return view(spark, sf, "assessments").select("id", text.csv_cell(F.concat(F.when(F.col("id") % 3 == 0, "=x").otherwise("x"), F.col("id").cast("string"))).alias("c"))


@query("S9_feature_collection", over("SELECT count(*) AS n FROM segments WHERE confidence >= 0.95"))
def s9(spark, sf):
    from ..sources import sinks

    doc = sinks.feature_rows(segments(spark, sf).where("confidence >= 0.95"), ["segment_id", "k", "vlm_class"])
    return doc.where(F.get_json_object("feature", "$.geometry.coordinates[0]").isNotNull()).agg(F.count("*").alias("n"))


@query("S12_stacked_report", over("SELECT 'section' AS kind, session_id, sum(length_m) AS m, NULL AS label FROM segments GROUP BY 2 UNION ALL SELECT 'pothole', session_id, NULL, label_text FROM segments WHERE label_text = 'Potholes' AND vlm_class = 'distress'"))
def s12(spark, sf):
    d = segments(spark, sf)
    one = d.groupBy("session_id").agg(F.sum("length_m").alias("m")).withColumn("kind", F.lit("section"))
    two = d.where("label_text = 'Potholes' and vlm_class = 'distress'").select("session_id", F.col("label_text").alias("label"), F.lit("pothole").alias("kind"))
    return one.unionByName(two, allowMissingColumns=True).select("kind", "session_id", "m", "label")


@query("S14_upsert", over("SELECT session_id, max(k) AS k FROM segments GROUP BY 1"))
def s14(spark, sf):
    from ..operators.work import merge_latest

    d = segments(spark, sf).select("session_id", "k", F.col("k").alias("stamp"))
    return merge_latest(d.where("k % 2 = 0"), d.where("k % 2 = 1"), "session_id", "stamp").select("session_id", "k")


@query("S15_training_records", "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1")
def s15(spark, sf):
    from ..sources import sinks

    return sinks.chat_records(table(spark, sf, "conversations")).select("conv_id", F.size("conversations").cast("long").alias("turns"))


@query("S16_manifest", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def s16(spark, sf):
    from ..sources import sinks

    return sinks.manifest({n: table(spark, sf, n) for n in ("nation", "region")})


@query("S2_pushed_scan", over("SELECT id FROM assessments WHERE status IN ('pending', 'failed') AND confidence IS NULL"))
def s2(spark, sf):
    from ..sources.readers import rest_filter

    return view(spark, sf, "assessments").where(rest_filter({"status": "in.(pending,failed)", "confidence": "is.null"})).select("id")


@query("S1_scan", "SELECT n_nationkey, n_name FROM nation")
def s1(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", "n_name")


@query("S13_layers", over("SELECT 'section' AS layer, count(DISTINCT session_id) AS n FROM segments UNION ALL SELECT 'point', count(*) FROM segments WHERE vlm_class = 'distress'"))
def s13(spark, sf):
    d = segments(spark, sf)
    return d.agg(F.countDistinct("session_id").alias("n")).select(F.lit("section").alias("layer"), "n").unionByName(d.where("vlm_class = 'distress'").agg(F.count("*").alias("n")).select(F.lit("point").alias("layer"), "n"))
