"""Joins, ordering, set operations and housekeeping over assessments, photos and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.views import over, table, view
from .registry import query, whole
from .segments import segments


@query("J1_left_join", over("SELECT s.segment_id, a.status AS answer FROM segments s LEFT JOIN assessments a ON s.event_id = a.id"))
def j1(spark, sf):
    a = view(spark, sf, "assessments").select(F.col("id").alias("event_id"), F.col("status").alias("answer"))
    return segments(spark, sf).select("segment_id", "event_id").join(a, "event_id", "left").select("segment_id", "answer")


@query("J2_inner_join", over("SELECT s.session_id, count(*) AS n FROM segments s JOIN assessments a ON s.event_id = a.id GROUP BY 1"))
def j2(spark, sf):
    a = view(spark, sf, "assessments").select(F.col("id").alias("event_id"))
    return segments(spark, sf).select("session_id", "event_id").join(a, "event_id").groupBy("session_id").agg(F.count("*").alias("n"))


@query("J3_anti_backfill", over("SELECT p.photo_id FROM photos p LEFT JOIN assessments a ON p.photo_id = a.photo_id WHERE a.id IS NULL"))
def j3(spark, sf):
    return view(spark, sf, "photos").join(view(spark, sf, "assessments"), "photo_id", "left_anti").select("photo_id")


@query("J4_not_exists", over("SELECT id FROM assessments a WHERE status = 'expert_review' AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.id = a.id) AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.item = a.photo_id AND r.needs_review)"))
def j4(spark, sf):
    a, r = view(spark, sf, "assessments").where("status = 'expert_review'"), view(spark, sf, "reviews")
    a = a.join(r.select("id"), "id", "left_anti")
    return a.join(r.where("needs_review").select(F.col("item").alias("photo_id")), "photo_id", "left_anti").select("id")


@query("J5_semi", over("SELECT id FROM assessments WHERE id IN (SELECT item FROM reviews)"))
def j5(spark, sf):
    return view(spark, sf, "assessments").join(view(spark, sf, "reviews").select(F.col("item").alias("id")), "id", "left_semi").select("id")


@query("J6_lateral_unnest", over("SELECT label, count(*) AS n FROM (SELECT unnest(string_split(label_text, '|')) AS label FROM assessments) q GROUP BY 1"))
def j6(spark, sf):
    return view(spark, sf, "assessments").select(F.explode(F.split("label_text", r"\|")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("J7_ordinality", over("SELECT id, i AS pos, string_split(label_text, '|')[i] AS label FROM assessments, unnest(range(1, len(string_split(label_text, '|')) + 1)) AS u(i)"))
def j7(spark, sf):
    return view(spark, sf, "assessments").select("id", F.posexplode(F.split("label_text", r"\|")).alias("pos", "label")).select("id", (F.col("pos") + 1).cast("long").alias("pos"), "label")


@query("J8_lease_join", over("SELECT a.id, r.reviewer FROM assessments a LEFT JOIN reviews r ON r.id = a.id AND r.queue = 'random' LEFT JOIN photos p ON p.photo_id = a.photo_id WHERE a.status = 'expert_review' AND (r.reviewer IS NULL OR r.needs_review)"))
def j8(spark, sf):
    a, r = view(spark, sf, "assessments").where("status = 'expert_review'"), view(spark, sf, "reviews").where("queue = 'random'")
    j = a.join(r.select("id", "reviewer", "needs_review"), "id", "left").join(view(spark, sf, "photos"), "photo_id", "left")
    return j.where("reviewer is null or needs_review").select("id", "reviewer")


_WHO = r"lower(regexp_replace(trim(reviewer), '\s+', ' ', 'g'))"


@query("J9_using", over(f"WITH c AS (SELECT {_WHO} AS who, count(DISTINCT item) AS n FROM reviews GROUP BY 1), l AS (SELECT {_WHO} AS who, max_by(trim(reviewer), id) AS name FROM reviews GROUP BY 1) SELECT who, n, name FROM c JOIN l USING (who)"))
def j9(spark, sf):
    from ..functions.text import normal_name

    r = view(spark, sf, "reviews").withColumn("who", normal_name(F.col("reviewer")))
    return r.groupBy("who").agg(F.countDistinct("item").alias("n")).join(r.groupBy("who").agg(F.max_by(F.trim("reviewer"), "id").alias("name")), "who")


@query("J10_lookup", over("SELECT s.segment_id, p.p1 FROM segments s LEFT JOIN probes p ON p.id = s.event_id"))
def j10(spark, sf):
    p = view(spark, sf, "probes").select(F.col("id").alias("event_id"), "p1")
    return segments(spark, sf).select("segment_id", "event_id").join(p, "event_id", "left").select("segment_id", "p1")


@query("J20_full_outer", over("SELECT count(*) FILTER (a.id IS NOT NULL AND r.id IS NOT NULL) AS both_sides, count(*) FILTER (r.id IS NULL) AS only_left, count(*) FILTER (a.id IS NULL) AS only_right FROM assessments a FULL JOIN reviews r ON a.id = r.id * 3"))
def j20(spark, sf):
    a, r = view(spark, sf, "assessments").select("id", F.lit(1).alias("a")), view(spark, sf, "reviews").select((F.col("id") * 3).alias("id"), F.lit(1).alias("r"))
    return a.join(r, "id", "full_outer").agg(F.count_if(F.expr("a is not null and r is not null")).alias("both_sides"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


@query("J21_head_to_head", over("SELECT r.id, r.vlm_text, a.label_text FROM reviews r JOIN assessments a ON a.id = r.id WHERE r.vlm_text <> a.label_text"))
def j21(spark, sf):
    r, a = view(spark, sf, "reviews").select("id", "vlm_text"), view(spark, sf, "assessments").select("id", "label_text")
    return r.join(a, "id").where("vlm_text <> label_text")


@query("A1_pipeline_metrics", over("SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'classified') AS classified, count(*) FILTER (status = 'expert_review') AS expert_review, count(*) FILTER (status = 'rejected_non_pavement') AS rejected, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (created_at >= TIMESTAMP '1998-01-01') AS recent, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (is_distressed) AS distressed FROM assessments"))
def a1(spark, sf):
    st = lambda s: F.count_if(F.col("status") == s)
    return view(spark, sf, "assessments").agg(F.count("*").alias("total"), st("pending").alias("pending"), st("processing").alias("processing"), st("classified").alias("classified"), st("expert_review").alias("expert_review"), st("rejected_non_pavement").alias("rejected"), st("failed").alias("failed"), F.count_if(F.col("created_at") >= F.lit("1998-01-01").cast("timestamp")).alias("recent"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count_if("is_distressed").alias("distressed"))


def _window(spark, sf, since: str):
    a = view(spark, sf, "assessments").where("status in ('classified', 'expert_review')").select("created_at", F.explode(F.split("label_text", r"\|")).alias("label"))
    return a, a.where(F.col("created_at") >= F.lit(since).cast("timestamp"))


@query("A2_class_distribution", over("SELECT label, count(*) AS n FROM (SELECT unnest(string_split(label_text, '|')) AS label FROM assessments WHERE status IN ('classified', 'expert_review') AND created_at >= TIMESTAMP '1998-01-01') q GROUP BY 1 ORDER BY n DESC, label"))
def a2(spark, sf):
    return _window(spark, sf, "1998-01-01")[1].groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@query("A3_fallback", over("SELECT 'all' AS win, label, count(*) AS n FROM (SELECT unnest(string_split(label_text, '|')) AS label FROM assessments WHERE status IN ('classified', 'expert_review')) q GROUP BY 2"))
def a3(spark, sf):
    every, recent = _window(spark, sf, "2030-01-01")
    count = lambda d, w: d.groupBy("label").agg(F.count("*").alias("n")).select(F.lit(w).alias("win"), "label", "n")
    some = recent.limit(1).select(F.lit("all").alias("win"))  # one row if the window holds any
    return count(recent, "24h").unionByName(count(every, "all").join(F.broadcast(some), "win", "left_anti"))


@query("A4_metrics_fill", over("SELECT count(*) FILTER (status = 'rejected_non_pavement') AS rejected, round(avg(confidence), 6) AS conf, round(avg(stage1_ms) FILTER (stage1_ms > 0), 6) AS ms FROM assessments"))
def a4(spark, sf):
    return view(spark, sf, "assessments").agg(F.count_if(F.col("status") == "rejected_non_pavement").alias("rejected"), F.round(F.avg("confidence"), 6).alias("conf"), F.round(F.avg(F.when(F.col("stage1_ms") > 0, F.col("stage1_ms"))), 6).alias("ms"))


@query("A5_dashboard", over("SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM assessments GROUP BY 1 ORDER BY day DESC LIMIT 60"))
def a5(spark, sf):
    return view(spark, sf, "assessments").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(60)


@query("A6_review_sessions", over("SELECT session_id, count(*) FILTER (answered) AS answered, count(*) FILTER (needs_expert_review) AS needs, count(*) FILTER (expert_reviewed) AS reviewed, min(utc) AS first FROM segments GROUP BY 1"))
def a6(spark, sf):
    return segments(spark, sf).groupBy("session_id").agg(F.count_if("answered").alias("answered"), F.count_if("needs_expert_review").alias("needs"), F.count_if("expert_reviewed").alias("reviewed"), F.min("utc").alias("first"))


@query("A7_queue_sizes", over("SELECT source, count(*) FILTER (queue = 'random') AS random, count(*) FILTER (queue = 'needs_review') AS needs_review, count(*) FILTER (queue = 'auto') AS auto, count(*) AS n FROM reviews GROUP BY 1"))
def a7(spark, sf):
    q = lambda n: F.count_if(F.col("queue") == n).alias(n)
    return view(spark, sf, "reviews").groupBy("source").agg(q("random"), q("needs_review"), q("auto"), F.count("*").alias("n"))


# ---- order, paging, choice


@query("T1_order", over("SELECT segment_id FROM segments ORDER BY session_id, k"))
def t1(spark, sf):
    return segments(spark, sf).orderBy("session_id", "k").select("segment_id")


@query("T2_nulls_last", over("SELECT id FROM assessments ORDER BY confidence DESC NULLS LAST, id"))
def t2(spark, sf):
    return view(spark, sf, "assessments").orderBy(F.desc_nulls_last("confidence"), "id").select("id")


@query("T3_hash_order", over("SELECT segment_id FROM segments ORDER BY md5(concat('salt', segment_id))"))
def t3(spark, sf):
    return segments(spark, sf).select("segment_id").orderBy(F.md5(F.concat(F.lit("salt"), "segment_id")))


@query("T4_page", over(f"SELECT segment_id, (SELECT count(*) FROM segments WHERE confidence >= 0.9) AS matched FROM segments WHERE confidence >= 0.9 ORDER BY session_id, k LIMIT 25 OFFSET 50"))
def t4(spark, sf):
    hit = segments(spark, sf).where("confidence >= 0.9")
    n = hit.agg(F.count("*").alias("matched"))
    return hit.orderBy("session_id", "k").offset(50).limit(25).select("segment_id").join(F.broadcast(n))


@query("T5_recent", over("SELECT id FROM assessments ORDER BY created_at DESC, id LIMIT 20"))
def t5(spark, sf):
    return view(spark, sf, "assessments").orderBy(F.desc("created_at"), "id").limit(20).select("id")


@query("T6_fifo_claim", over("SELECT id FROM assessments WHERE status = 'pending' ORDER BY created_at, id LIMIT 5"))
def t6(spark, sf):
    from ..operators.work import claim

    return claim(view(spark, sf, "assessments"), 5).select("id")


@query("T7_annex_quota", over("WITH r AS (SELECT segment_id, label_text, floor(s0_m / 100) AS cell, row_number() OVER (PARTITION BY label_text, floor(s0_m / 100) ORDER BY confidence DESC, segment_id) AS a, confidence FROM segments WHERE vlm_class = 'distress'), q AS (SELECT *, row_number() OVER (PARTITION BY label_text ORDER BY confidence DESC, segment_id) AS b FROM r WHERE a = 1) SELECT label_text, segment_id FROM q WHERE b <= 4"))
def t7(spark, sf):
    from ..operators.work import quota

    d = segments(spark, sf).where("vlm_class = 'distress'").withColumn("cell", F.floor(F.col("s0_m") / 100))
    return quota(d, "label_text", "cell", 4, F.desc("confidence"), F.col("segment_id")).select("label_text", "segment_id")


@query("T8_greedy_passes", over("""WITH d AS (SELECT user_id % 10 AS road, CAST(floor(s0_m / 100) AS BIGINT) AS section, session_id, s0_m AS a, s1_m AS b, vlm_class IN ('distress', 'normal') AS ok, strftime(utc, '%Y-%m-%d') AS day FROM segments),
  p AS (SELECT road, section, session_id, row_number() OVER (PARTITION BY road, section ORDER BY coalesce(sum(b - a) FILTER (ok), 0) DESC, max(day) DESC, session_id) AS rank FROM d GROUP BY 1, 2, 3),
  e AS (SELECT DISTINCT road, section, unnest([a, b]) AS a FROM d WHERE ok), c AS (SELECT *, lead(a) OVER (PARTITION BY road, section ORDER BY a) AS b FROM e),
  f AS (SELECT c.road, c.section, c.a, c.b, min(rank) AS rank FROM c JOIN d ON d.road = c.road AND d.section = c.section AND d.ok AND d.a < c.b AND c.a < d.b JOIN p ON p.road = d.road AND p.section = d.section AND p.session_id = d.session_id WHERE c.b IS NOT NULL GROUP BY 1, 2, 3, 4),
  m AS (SELECT road, section, rank, sum(b - a) AS metres FROM f GROUP BY 1, 2, 3)
  SELECT road, section, session_id, CAST(row_number() OVER (PARTITION BY road, section ORDER BY rank) - 1 AS INTEGER) AS "order", metres FROM m JOIN p USING (road, section, rank)"""))
def t8(spark, sf):
    from ..operators.work import greedy_cover

    d = segments(spark, sf).select((F.col("user_id") % 10).alias("road"), F.floor(F.col("s0_m") / 100).alias("section"), "session_id", F.col("s0_m").alias("a"), F.col("s1_m").alias("b"), F.col("vlm_class").isin("distress", "normal").alias("ok"), F.date_format("utc", "yyyy-MM-dd").alias("day"))
    return greedy_cover(d, ("road", "section"))


@query("T9_non_maximum")
def t9(spark, sf):
    from ..operators.work import suppress

    s = view(spark, sf, "survey")
    boxes = s.select("block", "n", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 20).alias("x1"), (F.col("y") + 15).alias("y1"))
    return suppress(boxes, "block", 0.3, 4).select("block", "n")


@query("T10_folds", over("WITH b AS (SELECT DISTINCT session_id FROM segments), f AS (SELECT session_id, (row_number() OVER (ORDER BY md5(concat('7', session_id))) - 1) % 5 AS fold FROM b) SELECT fold, count(*) AS n FROM segments JOIN f USING (session_id) GROUP BY 1"))
def t10(spark, sf):
    from ..operators.work import folds

    d = segments(spark, sf)
    return d.join(folds(d, "session_id", 5, "7"), "session_id").groupBy("fold").agg(F.count("*").alias("n"))


@query("T11_alternate_blocks", over("SELECT session_id, k, CAST(floor((row_number() OVER (PARTITION BY session_id ORDER BY k) - 1) / 3) AS BIGINT) % 2 AS side FROM segments"))
def t11(spark, sf):
    w = Window.partitionBy("session_id").orderBy("k")
    return segments(spark, sf).select("session_id", "k", (F.floor((F.row_number().over(w) - 1) / 3) % 2).alias("side"))


@query("T12_sample_trips", over("WITH d AS (SELECT session_id, min(strftime(utc, '%Y-%m-%d')) AS day, count(*) AS n FROM segments GROUP BY 1) SELECT day, min_by(session_id, md5(session_id)) AS session_id FROM d WHERE n >= 20 GROUP BY 1"))
def t12(spark, sf):
    d = segments(spark, sf).groupBy("session_id").agg(F.min(F.date_format("utc", "yyyy-MM-dd")).alias("day"), F.count("*").alias("n"))
    return d.where("n >= 20").groupBy("day").agg(F.min_by("session_id", F.md5("session_id")).alias("session_id"))


# ---- sets


@query("U0a_label_sets", over("SELECT id, len(list_intersect(v, e)) AS both_sides, len(list_distinct(list_concat(v, e))) AS either, len(list_filter(v, lambda x: NOT list_contains(e, x))) AS extra FROM (SELECT id, string_split(vlm_text, '|') AS v, string_split(expert_text, '|') AS e FROM reviews) q"))
def u0a(spark, sf):
    v, e = F.split("vlm_text", r"\|"), F.split("expert_text", r"\|")
    n = lambda c, a: F.size(c).cast("long").alias(a)
    return view(spark, sf, "reviews").select("id", n(F.array_intersect(v, e), "both_sides"), n(F.array_union(v, e), "either"), n(F.array_except(v, e), "extra"))


@query("U0b_missing_ids", over("SELECT 'left' AS side, id FROM (SELECT id FROM reviews EXCEPT SELECT id FROM assessments) q UNION ALL SELECT 'right', id FROM (SELECT item AS id FROM reviews EXCEPT SELECT id FROM reviews) q"))
def u0b(spark, sf):
    r, a = view(spark, sf, "reviews"), view(spark, sf, "assessments").select("id")
    one, two = r.select("id").subtract(a), r.select(F.col("item").alias("id")).subtract(r.select("id"))
    return one.select(F.lit("left").alias("side"), "id").union(two.select(F.lit("right").alias("side"), "id"))


@query("U0c_topup", over("SELECT 0 AS part, id FROM reviews WHERE queue = 'random' UNION ALL SELECT 1, id FROM assessments WHERE status = 'pending' AND id NOT IN (SELECT id FROM reviews WHERE queue = 'random')"))
def u0c(spark, sf):
    mine = view(spark, sf, "reviews").where("queue = 'random'").select("id")
    new = view(spark, sf, "assessments").where("status = 'pending'").select("id").join(mine, "id", "left_anti")
    return mine.select(F.lit(0).alias("part"), "id").unionByName(new.select(F.lit(1).alias("part"), "id"))


@query("U0d_stacked", over("SELECT 'status' AS kind, status AS name, count(*) AS n FROM segments GROUP BY 2 UNION ALL SELECT 'class', vlm_class, count(*) FROM segments GROUP BY 2"))
def u0d(spark, sf):
    d = segments(spark, sf)
    one = lambda k, c: d.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(k))
    return one("status", "status").unionByName(one("class", "vlm_class"))


@query("U0e_expected_found", over("SELECT coalesce(a.id, r.id) AS id, a.id IS NOT NULL AS expected, r.id IS NOT NULL AS found FROM (SELECT DISTINCT item AS id FROM reviews) a FULL JOIN (SELECT id FROM reviews) r ON a.id = r.id WHERE a.id IS NULL OR r.id IS NULL"))
def u0e(spark, sf):
    r = view(spark, sf, "reviews")
    a, b = r.select(F.col("item").alias("id")).distinct().withColumn("a", F.lit(1)), r.select("id").withColumn("b", F.lit(1))
    return a.join(b, "id", "full_outer").select("id", F.col("a").isNotNull().alias("expected"), F.col("b").isNotNull().alias("found")).where("not (expected and found)")


# ---- constraints


@query("V1_checks", over("SELECT status, count(*) AS n FROM assessments WHERE status NOT IN ('pending', 'processing', 'classified') OR (confidence IS NULL AND status = 'classified') GROUP BY 1"))
def v1(spark, sf):
    from ..operators.checks import rejects

    a = view(spark, sf, "assessments")
    return rejects(a, {"status": F.col("status").isin("pending", "processing", "classified"), "confidence": ~(F.col("confidence").isNull() & (F.col("status") == "classified"))}).groupBy("status").agg(F.count("*").alias("n"))


@query("V2_unique", over("SELECT photo_id, count(*) AS n FROM assessments WHERE status = 'classified' GROUP BY 1 HAVING count(*) > 1"))
def v2(spark, sf):
    from ..operators.checks import repeated

    return repeated(view(spark, sf, "assessments").where("status = 'classified'"), "photo_id")


@query("V3_dangling", over("SELECT 'photo' AS what, count(*) AS n FROM assessments a LEFT JOIN photos p USING (photo_id) WHERE p.url IS NULL UNION ALL SELECT 'assessment', count(*) FROM reviews r LEFT JOIN assessments a ON r.id = a.id WHERE a.id IS NULL"))
def v3(spark, sf):
    a, p, r = (view(spark, sf, n) for n in ("assessments", "photos", "reviews"))
    count = lambda d, n: d.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n")
    return count(a.join(p, "photo_id", "left_anti"), "photo").union(count(r.join(a.select("id"), "id", "left_anti"), "assessment"))


@query("V4_preflight", "SELECT conv_id, count(*) AS n FROM conversations WHERE role NOT IN ('user', 'assistant', 'system') OR text IS NULL OR length(text) > 2000 GROUP BY 1")
def v4(spark, sf):
    from ..operators.checks import rejects

    c = table(spark, sf, "conversations")
    bad = rejects(c, {"role": F.col("role").isin("user", "assistant", "system"), "text": F.col("text").isNotNull() & (F.length("text") <= 2000)})
    return bad.groupBy("conv_id").agg(F.count("*").alias("n"))


# ---- maintenance


@query("Q1_recent_sessions", over("SELECT session_id, max(utc) AS last, count(*) AS n, count(*) FILTER (vlm_class = 'distress') AS distress FROM segments GROUP BY 1 ORDER BY last DESC, session_id LIMIT 20"))
def q1(spark, sf):
    return segments(spark, sf).groupBy("session_id").agg(F.max("utc").alias("last"), F.count("*").alias("n"), F.count_if(F.col("vlm_class") == "distress").alias("distress")).orderBy(F.desc("last"), "session_id").limit(20)


@query("Q2_orphans", over("SELECT photo_id FROM photos WHERE size > 0 AND photo_id NOT IN (SELECT photo_id FROM assessments)"))
def q2(spark, sf):
    return view(spark, sf, "photos").where("size > 0").join(view(spark, sf, "assessments"), "photo_id", "left_anti").select("photo_id")


@query("Q3_cascade", over("SELECT a.id FROM assessments a WHERE NOT (a.photo_id % 10 = 0 AND NOT EXISTS (SELECT 1 FROM assessments b WHERE b.photo_id = a.photo_id AND b.status = 'processing'))"))
def q3(spark, sf):
    from ..operators.work import cascade_delete

    a = view(spark, sf, "assessments")
    return cascade_delete(a, a.where("photo_id % 10 = 0").select("photo_id").distinct(), "photo_id").select("id")


@query("Q4_reset", over("SELECT CASE WHEN status IN ('failed', 'rejected_non_pavement') AND coalesce(is_distressed, false) = false THEN 'pending' ELSE status END AS status, count(*) AS n FROM assessments GROUP BY 1"))
def q4(spark, sf):
    from ..operators.work import reset

    return reset(view(spark, sf, "assessments"), ["failed", "rejected_non_pavement"], ~F.coalesce("is_distressed", F.lit(False))).groupBy("status").agg(F.count("*").alias("n"))


@query("Q5_reroute", over("SELECT status AS src, CASE WHEN status NOT IN ('classified', 'expert_review') THEN 'skipped' WHEN confidence >= 0.3 THEN 'classified' ELSE 'expert_review' END AS dst, count(*) AS n FROM assessments GROUP BY 1, 2"))
def q5(spark, sf):
    to = F.when(~F.col("status").isin("classified", "expert_review"), "skipped").when(F.col("confidence") >= 0.3, "classified").otherwise("expert_review")
    return view(spark, sf, "assessments").groupBy(F.col("status").alias("src"), to.alias("dst")).agg(F.count("*").alias("n"))


@query("Q6_gate_comparison", over("SELECT count(*) FILTER (p1 >= 0.6 AND p2 >= 0.6) AS both_pass, count(*) FILTER (p1 >= 0.6 AND p2 < 0.6) AS only_1, count(*) FILTER (p1 < 0.6 AND p2 >= 0.6) AS only_2, round(avg(p1), 6) AS m1, round(avg(p2), 6) AS m2 FROM probes"))
def q6(spark, sf):
    a, b = F.col("p1") >= 0.6, F.col("p2") >= 0.6
    return view(spark, sf, "probes").agg(F.count_if(a & b).alias("both_pass"), F.count_if(a & ~b).alias("only_1"), F.count_if(~a & b).alias("only_2"), F.round(F.avg("p1"), 6).alias("m1"), F.round(F.avg("p2"), 6).alias("m2"))


@query("Q13_probe_vs_label", over("SELECT count(*) FILTER (v = e) AS same, sum(len(list_filter(v, lambda x: NOT list_contains(e, x)))) AS added, sum(len(list_filter(e, lambda x: NOT list_contains(v, x)))) AS removed FROM (SELECT string_split(vlm_text, '|') AS v, string_split(expert_text, '|') AS e FROM reviews) q"))
def q13(spark, sf):
    v, e = F.split("vlm_text", r"\|"), F.split("expert_text", r"\|")
    return view(spark, sf, "reviews").agg(F.count_if(F.col("vlm_text") == F.col("expert_text")).alias("same"), F.sum(F.size(F.array_except(v, e))).alias("added"), F.sum(F.size(F.array_except(e, v))).alias("removed"))


@query("Q15_best_offset", over("WITH c AS (SELECT j * 0.05 AS off FROM range(-6, 7) r(j)), m AS (SELECT off, count(*) FILTER (truth AND p1 + off >= 0.5) AS tp, count(*) FILTER (NOT truth AND p1 + off >= 0.5) AS fp, count(*) FILTER (truth AND p1 + off < 0.5) AS fn, count(*) FILTER (NOT truth AND p1 + off < 0.5) AS tn FROM probes, c GROUP BY off), s AS (SELECT off, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc FROM m) SELECT round(off, 2) AS off, round(mcc, 6) AS mcc FROM s ORDER BY mcc DESC, abs(off), off LIMIT 1"))
def q15(spark, sf):
    from ..functions.stats import confusion, mcc

    d = view(spark, sf, "probes").withColumn("off", F.explode(F.array(*[F.lit(j * 0.05) for j in range(-6, 7)])))
    m = d.groupBy("off").agg(*confusion(F.col("truth"), F.col("p1") + F.col("off") >= 0.5))
    m = m.withColumn("mcc", mcc(*[F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")]))
    return m.orderBy(F.desc("mcc"), F.abs("off"), "off").limit(1).select(F.round("off", 2).alias("off"), F.round("mcc", 6).alias("mcc"))


@query("Q16_pass_rate", over("WITH o AS (SELECT p1, row_number() OVER (ORDER BY p1 DESC, id) AS r FROM probes WHERE truth), t AS (SELECT p1 AS cut FROM o WHERE r = (SELECT CAST(ceil(0.9 * count(*)) AS BIGINT) FROM probes WHERE truth)) SELECT cut, round(avg(CASE WHEN p1 >= cut THEN 1.0 ELSE 0 END), 6) AS rate FROM probes, t GROUP BY cut"))
def q16(spark, sf):
    from ..functions.stats import cut_at_recall

    d = view(spark, sf, "probes")
    cut = cut_at_recall(d, "p1", "truth", 0.9)
    return d.join(F.broadcast(cut)).groupBy("cut").agg(F.round(F.avg((F.col("p1") >= F.col("cut")).cast("double")), 6).alias("rate"))


@query("Q18_lag_statistics", over("WITH l AS (SELECT vlm_class = 'distress' AS y, lag(vlm_class = 'distress') OVER (PARTITION BY session_id ORDER BY k) AS prev, length_m FROM segments) SELECT round(sum(length_m) FILTER (y AND prev) / sum(length_m) FILTER (prev), 6) AS given_prev, round(sum(length_m) FILTER (y) / sum(length_m), 6) AS base FROM l WHERE prev IS NOT NULL"))
def q18(spark, sf):
    w = Window.partitionBy("session_id").orderBy("k")
    d = segments(spark, sf).withColumn("y", F.col("vlm_class") == "distress").withColumn("prev", F.lag("y").over(w)).where("prev is not null")
    m = lambda c: F.sum(F.when(c, F.col("length_m")))
    return d.agg(F.round(m(F.col("y") & F.col("prev")) / m(F.col("prev")), 6).alias("given_prev"), F.round(m(F.col("y")) / F.sum("length_m"), 6).alias("base"))


@query("Q19_paired_table", over("SELECT count(*) FILTER (a AND b) AS yes_yes, count(*) FILTER (a AND NOT b) AS yes_no, count(*) FILTER (NOT a AND b) AS no_yes, count(*) FILTER (NOT a AND NOT b) AS no_no FROM (SELECT s.vlm_class = 'distress' AS a, coalesce(r.is_distressed, false) AS b FROM segments s JOIN assessments r ON r.id = s.event_id WHERE s.vlm_class IN ('distress', 'normal')) q"))
def q19(spark, sf):
    a = view(spark, sf, "assessments").select(F.col("id").alias("event_id"), F.coalesce("is_distressed", F.lit(False)).alias("b"))
    d = segments(spark, sf).where("vlm_class in ('distress', 'normal')").join(a, "event_id").withColumn("a", F.col("vlm_class") == "distress")
    x, y = F.col("a"), F.col("b")
    return d.agg(F.count_if(x & y).alias("yes_yes"), F.count_if(x & ~y).alias("yes_no"), F.count_if(~x & y).alias("no_yes"), F.count_if(~x & ~y).alias("no_no"))


@query("Q21_progress", over("SELECT min(id) FILTER (status = 'pending') AS first_pending, count(*) FILTER (status = 'pending') AS remaining, round(avg(stage1_ms) / 1000 * count(*) FILTER (status = 'pending'), 4) AS eta_s FROM assessments"))
def q21(spark, sf):
    p = F.col("status") == "pending"
    return view(spark, sf, "assessments").agg(F.min(F.when(p, F.col("id"))).alias("first_pending"), F.count_if(p).alias("remaining"), F.round(F.avg("stage1_ms") / 1000 * F.count_if(p), 4).alias("eta_s"))


@query("Q22_diverse_sample", over("WITH r AS (SELECT segment_id, vlm_class, row_number() OVER (PARTITION BY label_text ORDER BY segment_id) AS a, row_number() OVER (PARTITION BY vlm_class ORDER BY segment_id) AS b FROM segments) SELECT segment_id FROM r ORDER BY CASE WHEN a = 1 THEN 0 WHEN b = 1 THEN 1 ELSE 2 END, segment_id LIMIT 12"))
def q22(spark, sf):
    first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("segment_id")) == 1
    d = segments(spark, sf).select("segment_id", F.when(first("label_text"), 0).when(first("vlm_class"), 1).otherwise(2).alias("rank"))
    return d.orderBy("rank", "segment_id").limit(12).select("segment_id")


@query("Q24_event_ingestion", "SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN event_type ELSE 'info' END AS level, substr(props, 1, 6) AS detail FROM events WHERE event_type <> 'signup'")
def q24(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'signup'")
    return e.select("event_id", F.when(F.col("event_type").isin("error", "view"), F.col("event_type")).otherwise("info").alias("level"), F.substring("props", 1, 6).alias("detail"))
