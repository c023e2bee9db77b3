"""Streaming queries, each drained over the events table and equal to its batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.views import table
from ..streaming import desk as D
from ..streaming import queues as Q
from .registry import query


def _events(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    raw = Q.read(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema)
    return raw.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])


@query("Z1_claims")
def z1(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("item"), "event_id", F.expr("case event_id % 3 when 0 then 'claim' when 1 then 'done' else 'error' end").alias("event"), F.col("ts").cast("double").alias("t"))
    return Q.drain(Q.retries(e), "append", "z1")


@query("Z3_photo_inserts", "SELECT DISTINCT user_id AS photo_id, 'pending' AS status FROM events")
def z3(spark, sf):
    return Q.drain(Q.photo_inserts(_events(spark, sf).select(F.col("user_id").alias("photo_id"))), "append", "z3")


@query("Z4_heartbeats", "SELECT user_id % 8 AS worker_id, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def z4(spark, sf):
    e = _events(spark, sf).select((F.col("user_id") % 8).alias("worker_id"), "ts", F.col("event_type").alias("state"), F.col("event_id").alias("seq"))
    return Q.drain(Q.heartbeats(e), "complete", "z4").select("worker_id", "state")


@query("Z6_leases")
def z6(spark, sf):
    e = _events(spark, sf).select((F.col("user_id") % 20).alias("item"), "event_id", F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("session"), F.expr("case when event_type in ('view', 'click') then 'grant' when event_type = 'error' then 'release' else 'heartbeat' end").alias("action"), F.col("ts").cast("double").alias("t"))
    return Q.drain(Q.leases(e), "append", "z6")


@query("Z7_idempotent_saves", "SELECT count(DISTINCT event_id // 3) AS n FROM events")
def z7(spark, sf):
    e = _events(spark, sf).select("ts", F.floor(F.col("event_id") / 3).alias("op_id"))
    return Q.drain(Q.saves(e), "append", "z7").agg(F.count("*").alias("n"))


@query("Z8_metrics", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def z8(spark, sf):
    return Q.drain(Q.metrics(_events(spark, sf).withColumnRenamed("event_type", "status")), "complete", "z8")


@query("Z11_rolling", "WITH p AS (SELECT user_id, event_id, value FROM events) SELECT user_id AS item, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) + 1e-9, 4) AS mean FROM p")
def z11(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("item"), "event_id", F.col("value").alias("v"), F.col("event_id").cast("double").alias("t"))
    return Q.drain(Q.rolling(e), "append", "z11").select("item", "event_id", F.round(F.col("mean") + 1e-9, 4).alias("mean"))


@query("Z12_state_stamps", "SELECT concat('S', user_id) AS session_id, epoch_us(max(ts) FILTER (event_type = 'view')) AS view_us FROM events GROUP BY 1")
def z12(spark, sf):
    e = _events(spark, sf).select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("state"), "ts")
    return Q.drain(Q.stamps(e, ["view", "error"]), "complete", "z12").select("session_id", F.unix_micros("view_at").alias("view_us"))


@query("Z_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01')) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ztumble(spark, sf):
    return Q.drain(Q.tumbling(_events(spark, sf)), "complete", "zt").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("Z_sliding", "SELECT epoch_us(time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01')) - o * 10800000000 AS start_us, count(*) AS n FROM events, (VALUES (0), (1)) AS v(o) GROUP BY 1")
def zslide(spark, sf):
    return Q.drain(Q.sliding(_events(spark, sf)), "complete", "zs").select(F.unix_micros("start").alias("start_us"), "n")


@query("Z_sessions", "WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM d) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s")
def zsess(spark, sf):
    return Q.drain(Q.sessions(_events(spark, sf)), "complete", "zw").select("user_id", F.unix_micros("start").alias("start_us"), "n")


def _desk_events(spark, sf, body: dict):
    """The events table as events of desks of 25 users, a day in 15 minutes."""
    e = table(spark, sf, "events").withColumn("ts", F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) / 100).cast("long")))
    kinds = F.create_map(*[x for k, v in (("view", "a"), ("signup", "b"), ("click", "c"), ("purchase", "d"), ("error", "e")) for x in (F.lit(k), F.lit(v))])
    e = e.withColumn("of", kinds[F.col("event_type")]).withColumn("r", F.floor(F.col("event_id") / 7).cast("long"))
    return e.select(F.floor(F.col("user_id") / 25).cast("string").alias("key"), "event_id", "ts", *[F.expr(x).alias(c) for c, x in body.items()])


@query("Z6_review_desk")
def z6_desk(spark, sf):
    """Hand-outs, leases, skips and saves of review desks, an answer per event."""
    item = "concat('i', event_id % 60)"
    body = {
        "kind": "case of when 'a' then 'item' when 'b' then 'next' when 'c' then element_at(array('grant', 'take', 'active'), cast(r % 3 + 1 as int)) when 'd' then 'save' else element_at(array('heartbeat', 'release', 'release'), cast(r % 3 + 1 as int)) end",
        "source": "case when of = 'e' then null when event_id % 5 = 0 then 'citizen' else 'video' end",
        "item": f"case when of in ('a', 'c', 'd') then {item} end",
        "items": f"case of when 'c' then array({item}, concat('i', (event_id + 5) % 60)) when 'e' then case when r % 3 = 2 then array(concat('video:', {item}), concat('video:i', (event_id + 1) % 60)) end end",
        "session": "concat('s', user_id % 4)", "name": "concat('Reviewer ', user_id % 4)",
        "queue": "element_at(array('needs_review', 'auto', 'random'), cast(r % 3 + 1 as int))",
        "n": "case when of = 'b' then cast(event_id % 7 + 1 as int) end", "skip": "case when of = 'e' then r % 3 = 2 end",
        "status": "case when of = 'a' then if(event_id % 2 = 0, 'expert_review', 'classified') end",
        "place": f"lpad({item}, 6, '0')", "lottery": f"md5(concat('{D.SALT}', {item}))",
        "op_id": "case when of = 'd' then concat('op', r) end", "severity": "case when of = 'd' then 'High' end", "types": "case when of = 'd' then array('Potholes') end",
    }
    return D.replayed(_desk_events(spark, sf, body), D.Desk, "z6desk")


@query("Z7_saves")
def z7_saves(spark, sf):
    """The log of saves: of each desk's saves what became of them, replays and conflicts among them."""
    got = z6_desk(spark, sf).select("key", F.from_json("answer", "result string, action string, item string, held_by string, reviewed_by string, reviewed_at double").alias("a"))
    got = got.where("a.result in ('saved', 'replayed', 'conflict', 'not found', 'op_id of another item')").select("key", "a.result", "a.action", F.when(F.col("a.held_by").isNotNull(), "held").when(F.col("a.reviewed_by").isNotNull(), "reviewed").alias("why"))
    return got.groupBy("key", "result", "action", "why").agg(F.count("*").alias("n"))


@query("Z5_work_queue")
def z5(spark, sf):
    """Claims of the oldest due photos, retries with a delay that doubles, stale claims, stops."""
    body = {
        "kind": "case when of in ('a', 'b') then 'photo' when of = 'c' then 'claim' when r % 29 = 0 then 'stop' when of = 'd' then 'done' else 'error' end",
        "item": "case when of in ('a', 'b') then concat('p', event_id % 400) when of in ('d', 'e') then concat('p', event_id % 23) end",
        "worker": "concat('w', user_id % 2)", "n": "case when of = 'c' then cast(event_id % 6 + 1 as int) end",
        "status": "case when of = 'd' and r % 4 = 0 then 'expert_review' end", "transient": "case when of = 'e' then r % 5 <> 0 end",
    }
    return D.replayed(_desk_events(spark, sf, body), D.WorkQueue, "z5")


@query("Z9_inbox")
def z9(spark, sf):
    """Inboxes of drive packages: what runs next, what was refused, replaced or vanished, what goes on after a restart."""
    packages = "map_from_entries(transform(filter(sequence(0, 11), k -> k <= r % 14 and (k + r) % 17 <> 0), k -> struct(concat('d', k), concat('f', floor((r + k) / 90)))))"
    body = {
        "kind": "case when of = 'a' then 'scan' when of = 'b' then 'poll' when of = 'c' then 'stage' when of = 'd' then case when r % 3 = 0 then 'fail' when r % 7 = 1 then 'restart' else 'poll' end else case when r % 2 = 0 then 'error' else 'ok' end end",
        "packages": f"case when of = 'a' then {packages} end",
        "session": "case when of in ('c', 'd') then concat('d', event_id % 4) end",
        "state": "case when of = 'c' then element_at(array('extracting', 'classifying', 'storing', 'stored', 'done'), cast(r % 5 + 1 as int)) end",
        "stage": "case when of = 'd' then if(r % 2 = 0, 'validate', 'extract') end", "error": "case when of = 'd' then 'refused' end",
    }
    return D.replayed(_desk_events(spark, sf, body), D.Inbox, "z9")
