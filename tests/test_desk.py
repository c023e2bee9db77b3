"""Review desk, work queue and inbox: outcomes one by one, invariants over long random runs, batches and restarts."""

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from kerbline.plans import load, registry
from kerbline.session import scratch
from kerbline.streaming import desk as D
from kerbline.streaming import queues as Q


load()


class Play:
    """Rules without Spark: step by step."""

    def __init__(self, rules):
        self.r, self.n = rules(), 0
        self.r.rows = {t: {} for t in rules.TABLES}

    def __call__(self, kind, t, **e):
        self.n += 1
        return self.r.step({"kind": kind, "t": float(t), "event_id": self.n, **e})


def desk(n=8):
    p = Play(D.Desk)
    for i in range(n):
        p("item", 0, source="video", item=f"i{i}", status="expert_review" if i % 2 else "classified", place=f"{i:03d}", lottery=f"{(7 * i) % n:03d}")
    return p


A, B = {"session": "a", "name": "Asha"}, {"session": "b", "name": "Ravi"}


def test_hand_out_renews_own_and_tops_up_in_order():
    p = desk()
    got = p("next", 1, **A, queue="needs_review", n=2)
    assert (got["items"], got["new"], got["total"], got["available"]) == (["video:i1", "video:i3"], 2, 4, 4)
    again = p("next", 2, **A, queue="needs_review", n=3)
    assert (again["items"], again["new"]) == (["video:i1", "video:i3", "video:i5"], 1)
    other = p("next", 3, **B, queue="needs_review", n=5)
    assert (other["items"], other["available"]) == (["video:i7"], 1)
    assert p("next", 4, **A, queue="random", n=2)["items"] == ["video:i5", "video:i3", "video:i1"]  # all own ones, in the list's order
    # own leases that have ended are renewed, never new; others' that have ended are free
    late = p("next", 700, **A, queue="needs_review", n=30)
    assert (late["items"], late["new"]) == (["video:i1", "video:i3", "video:i5", "video:i7"], 1)
    assert p("next", 701, **A, queue="no such list") == {"result": "invalid"}


def test_batch_and_cap():
    p = desk(200)
    assert len(p("next", 1, **A, queue="random", n=99)["items"]) == 30
    p("next", 2, **A, queue="auto", n=30)
    assert sum(p("active", 3)["by_session"].values()) <= 60
    for t in range(4, 9):
        p("grant", t, **A, source="video", queue="random", items=[f"i{k}" for k in range(25 * (t - 4), 25 * (t - 3))])
    assert p("active", 9)["by_session"] == {"a": 60}
    assert p("next", 10, **B, queue="random", n=30)["available"] == 140
    assert p("grant", 11, **B, source="video", queue="random", items=[])["result"] == "invalid"
    assert p("grant", 11, **B, source="video", queue="random", items=["x"] * 201)["result"] == "invalid"


def test_expiry_and_heartbeat():
    p = desk()
    ids = p("next", 0, **A, queue="random", n=2)["items"]
    first, second = (i.split(":")[1] for i in ids)
    p("heartbeat", 500, **A, items=[ids[1]])
    got = p("grant", 601, **B, source="video", queue="random", items=[first, second])
    assert (got["items"], got["held_by_others"]) == ([ids[0]], {ids[1]: "Asha"})
    beat = p("heartbeat", 602, **A, items=ids)
    assert (beat["items"], beat["lost"]) == ([ids[1]], [ids[0]])
    assert p("heartbeat", 1300, **A)["items"] == [ids[1]]  # ended, taken by nobody
    assert p("take", 1301, **B, source="video", item=second) == {"result": "conflict", "held_by": "Asha"}
    assert p("take", 1302, **A, source="video", item=second)["result"] == "held"
    assert p("heartbeat", 1302 + D.LEASE_S + D.LEASE_KEPT_S, **A)["items"] == []  # forgotten


def test_skips():
    p = desk()
    first = p("next", 1, **A, queue="random", n=3)["items"]
    assert p("release", 2, **A, items=[first[0]], skip=True)["skipped"] == 1
    p("release", 3, **A, items=[first[1]])
    mine = p("next", 4, **A, queue="random", n=3)["items"]
    assert first[0] not in mine and first[1] in mine and first[2] in mine
    assert p("next", 5, **B, queue="random", n=1)["items"] == [first[0]]
    p("release", 6, **B)
    item = first[0].split(":")[1]
    assert p("grant", 7, **A, source="video", queue="random", items=[item])["items"] == []
    assert p("grant", 8, **A, source="video", queue="reviewed", items=[item])["items"] == [first[0]]  # skips count in review lists only


def test_save_checks_in_order():
    p = desk()
    p("take", 1, **A, source="video", item="i1")
    body = {"source": "video", "item": "i1", "types": ["Potholes"], "severity": "High"}
    assert p("save", 2, **B, **{**body, "item": "nothing"})["result"] == "not found"
    assert p("save", 3, **B, **body) == {"result": "conflict", "held_by": "Asha"}
    assert p("save", 3, **body)["result"] == "conflict"  # an old page without a session
    saved = p("save", 4, **A, **body, op_id="x")
    assert (saved["result"], saved["action"], saved["reviewed_at"]) == ("saved", "confirm", 4.0)
    assert p("active", 5)["by_session"] == {}
    assert p("save", 6, **A, **body, op_id="x") == {**saved, "result": "replayed"}
    assert p("save", 7, **A, **{**body, "item": "i3"}, op_id="x")["result"] == "op_id of another item"
    assert p("save", 8, **B, **body) == {"result": "conflict", "reviewed_by": "Asha", "reviewed_at": 4.0}
    assert p("save", 9, **B, **body, seen=3.0)["result"] == "conflict"
    second = p("save", 10, **B, **body, seen=4.0, op_id="y")
    assert (second["result"], second["action"]) == ("saved", "update")
    replay = p("save", 11, **A, **body, op_id="x")
    assert (replay["result"], replay["action"], replay["reviewed_at"]) == ("replayed", "confirm", 10.0)
    assert all("video:i1" not in p("next", 12, **s, queue="random", n=30)["items"] for s in (A, B))
    assert p("save", 4 + D.LOG_KEPT_S + 1, **A, **body, seen=10.0, op_id="x")["result"] == "saved"  # the log has let go


def desk_events(seed, n=600):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice("abc")
        e = {"session": s, "name": s.upper(), "source": "video", "queue": r.choice(D.LISTS), "item": f"i{r.randrange(40)}"}
        kind = r.choices(["item", "next", "grant", "take", "heartbeat", "release", "save", "active"], [5, 4, 3, 2, 2, 3, 4, 1])[0]
        if kind in ("item", "save"):
            e |= {"status": r.choice(["expert_review", "classified"]), "place": e["item"], "lottery": e["item"][::-1], "op_id": f"o{r.randrange(200)}"}
        if kind == "grant":
            e |= {"items": [f"i{r.randrange(40)}" for _ in range(5)], "n": 3}
        if kind in ("heartbeat", "release"):
            e |= {"items": [f"video:i{r.randrange(40)}" for _ in range(3)] if r.random() < 0.7 else None, "skip": kind == "release" and r.random() < 0.4, "source": None}
        out.append({"kind": kind, "t": 60.0 * i + r.random() * 50, **e})
    return out


@pytest.mark.parametrize("seed", range(5))
def test_never_two_holders(seed):
    """A model beside the desk that believes every answer: no item is handed to a session while another holds it."""
    p, holds = Play(D.Desk), {}
    for e in desk_events(seed, 3000):
        t, s = e["t"], e["session"]
        a = p(**e)
        if e["kind"] in ("next", "grant", "take", "heartbeat"):
            got = a.get("items", [D.item_key(e["source"], e["item"])] if a["result"] == "held" and e["kind"] == "take" else [])
            for k in got:
                assert k not in holds or holds[k][0] == s or holds[k][1] <= t
                holds[k] = (s, t + D.LEASE_S)
        elif e["kind"] == "release":
            for k in a["items"]:
                assert holds.pop(k)[0] == s
        elif a["result"] in ("saved", "replayed") and e["kind"] == "save":
            k = D.item_key("video", e["item"])
            if k in holds and (a["result"] == "saved" or holds[k][0] == s):
                holder, until = holds.pop(k)
                assert holder == s or until <= t
        live = {}
        for k, (o, until) in holds.items():
            if until > t:
                live[o] = live.get(o, 0) + 1
        assert p("active", t)["by_session"] == live and all(n <= D.LIVE for n in live.values())


def test_work_queue():
    p = Play(D.WorkQueue)
    for i in range(7):
        assert p("photo", i, item=f"p{i}")["result"] == "pending"
    assert p("photo", 8, item="p0")["result"] == "known"
    assert p("claim", 10, worker="w") == {"result": "claimed", "items": ["p0", "p1", "p2", "p3", "p4"], "left": 2}
    assert p("done", 11, worker="w", item="p0") == {"result": "classified", "tries": 0}
    assert p("done", 11, worker="v", item="p1")["result"] == "not claimed"
    first = p("error", 12, worker="w", item="p1")
    assert (first["result"], first["tries"], first["due"]) == ("again", 1, 13.0)
    assert p("claim", 12.5, worker="v", n=9)["items"] == ["p5", "p6"]  # p1 isn't due yet
    assert p("claim", 13, worker="v", n=9)["items"] == ["p1"]
    assert p("error", 14, worker="v", item="p1")["due"] == 16.0  # doubled
    assert p("claim", 17, worker="v")["items"] == ["p1"]
    assert p("error", 18, worker="v", item="p1") == {"result": "failed", "tries": 3}
    assert p("error", 19, worker="w", item="p2", transient=False) == {"result": "failed", "tries": 1}
    assert p("stop", 20, worker="v") == {"result": "released", "items": ["p5", "p6"]}
    assert p("claim", 310, worker="v", n=9)["items"] == ["p5", "p6"]
    assert p("claim", 311, worker="u", n=9)["items"] == ["p3", "p4"]  # w's claims of second 10 are stale
    assert p("done", 312, worker="w", item="p3")["result"] == "not claimed"
    assert p("done", 313, worker="u", item="p3", status="expert_review") == {"result": "expert_review", "tries": 1}


def test_inbox():
    p = Play(D.Inbox)
    assert p("scan", 0, packages={"a": "1", "b": "1"})["new"] == ["a", "b"]
    assert p("poll", 10)["result"] == "idle"  # not settled
    p("scan", 20, packages={"a": "2", "b": "1"})
    assert p("poll", 31) == {"result": "run", "session": "b", "from": "queued"}
    assert p("poll", 60) == {"result": "busy", "session": "b"}
    p("stage", 61, session="b", state="extracting")
    assert p("restart", 62)["session"] == "b"
    assert p("poll", 63) == {"result": "run", "session": "b", "from": "extracting"}  # before a, which has settled
    p("stage", 64, session="b", state="done")
    assert p("poll", 65)["session"] == "a"
    assert p("fail", 66, session="a", stage="validate", error="bad")["result"] == "failed"
    assert p("scan", 70, packages={"a": "2", "b": "1", "c": "1"}) == {"result": "scanned", "new": ["c"], "again": [], "gone": []}
    assert p("scan", 80, packages={"a": "3", "b": "1"}) == {"result": "scanned", "new": [], "again": ["a"], "gone": ["c"]}
    assert p("poll", 100)["result"] == "idle" and p("poll", 110)["session"] == "a"
    assert p("stage", 111, session="b", state="storing")["result"] == "not running"
    assert [p("error", 120)["seconds"] for _ in range(6)] == [30, 60, 120, 240, 300, 300] and p("ok", 121)["seconds"] == 15


FIELDS = "key string, event_id long, ts timestamp, kind string, session string, name string, source string, queue string, item string, status string, place string, lottery string, op_id string, items array<string>, n int, skip boolean"


@pytest.fixture(scope="module")
def events(spark):
    rows, names = [], FIELDS.replace(", ", " ").split()[::2]
    for key in ("d1", "d2", "d3"):
        for i, e in enumerate(desk_events(key, 150)):
            rows.append([key, i, e["t"], *[e.get(n) for n in names[3:]]])
    raw = spark.createDataFrame(rows, FIELDS.replace("ts timestamp", "ts double"))
    return raw.withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).repartition(2)


def rows(df):
    return sorted((r.key, r.event_id, r.answer) for r in df.collect())


def test_one_batch_many_and_plain_agree(spark, events):
    one = rows(D.replayed(events, D.Desk, "t", files=1))
    plain = []
    for key in ("d1", "d2", "d3"):
        p = Play(D.Desk)
        for i, e in enumerate(desk_events(key, 150)):
            plain.append((key, i, json.dumps(p(**{**e, "t": int(e["t"] * 1e6) / 1e6}), sort_keys=True)))
    assert one == sorted(plain)
    assert rows(D.replayed(events, D.Desk, "t", files=4)) == one


def test_a_run_that_was_stopped_goes_on(spark, events, tmp_path):
    """Half of the files, stop, the other half from the checkpoint: as if it had never stopped."""
    whole, folder = rows(D.replayed(events, D.Desk, "t", files=3)), f"{tmp_path}/in"
    half = events.agg(F.expr("percentile(unix_micros(ts), 0.5)")).first()[0]
    at = scratch(spark, "stopped")

    def run():
        with D.rocks(spark):
            q = D.answers(Q.read(spark, folder, events.schema, 1), D.Desk, "10 minutes").writeStream.outputMode("append").format("parquet")
            q.option("path", f"{at}/data").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    events.where(F.unix_micros("ts") < int(half)).write.mode("append").parquet(folder)
    run()
    early = spark.read.parquet(f"{at}/data").count()
    D.arrive(events.where(F.unix_micros("ts") >= int(half)), folder, 2)
    run()
    got = rows(spark.read.parquet(f"{at}/data").where("key <> ''"))
    assert got == whole and 0 < early < len(whole)
    shutil.rmtree(folder)


@pytest.mark.parametrize("name", ["Z5_work_queue", "Z6_review_desk", "Z9_inbox"])
def test_queries_answer_every_event(spark, data, name):
    got = registry.queries()[name](spark, data)
    results = {json.loads(r.answer)["result"] for r in got.collect()}
    assert got.count() == got.select("key", "event_id").distinct().count() == spark.read.parquet(f"{data}/events.parquet").count()
    assert len(results) >= 5 and "invalid" not in results, results
