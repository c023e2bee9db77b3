"""Review desk, work queue and inbox as keyed state on `transformWithState`.

All three take events in the order of their time, whatever batches they come in: an event waits in list state until
the watermark has passed it, an event-time timer then hands over what is due. So one batch and many, and a run that was
stopped and went on from its checkpoint, give the same answers. State is map state, of which only changed entries are
written; a key's state is one desk's, queue's or inbox's, never the whole table's.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..session import scratch
from . import queues

# Seconds of a lease, items of a hand-out, live leases of a session, items of a request, lists by source,
# what the random list's order is the md5 of, before the item.
SALT = "expert-review-random-v1:"
LEASE_S, BATCH, LIVE, ASKED = 600, 30, 60, 200
LISTS = ("needs_review", "auto", "random")
UNSKIPPED = (*LISTS, "citizen_pending")
#: Seconds after its end that a lease, and after its entry that a logged save, is kept.
LEASE_KEPT_S, LOG_KEPT_S = 3600, 7 * 86400
# Seconds of a claim, attempts, first delay, images of a claim; states that go on; seconds between looks,
# until a package has settled, and of the longest delay.
CLAIM_S, ATTEMPTS, DELAY_S, IMAGES = 300, 3, 1.0, 5
RESUMABLE, POLL_S, SETTLE_S, MOST_DELAY_S = ("extracting", "classifying", "storing", "stored"), 15.0, 30.0, 300.0

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Hands events to step() in order of (t, event_id) once the watermark has passed them.

    A subclass names its map states in TABLES; self.rows[name] then is a dict of key -> dict that step() may change.
    """

    TABLES: tuple[str, ...] = ()

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event string")
        self.states = {n: handle.getMapState(n, "k string", "v string") for n in self.TABLES}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [e for df in rows for e in df["event"]]
        self.waiting.appendList([(e,) for e in new])
        self.handle.registerTimer(min(int(json.loads(e)["t"] * 1000) for e in new))
        yield pd.DataFrame(columns=["key", "event_id", "answer"]).astype({"event_id": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [json.loads(e) for (e,) in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((e for e in held if int(e["t"] * 1000) <= now), key=lambda e: (e["t"], e["event_id"]))
        rest = [e for e in held if int(e["t"] * 1000) > now]
        old = {n: {k: v for (k,), (v,) in s.iterator()} if s.exists() else {} for n, s in self.states.items()}
        self.rows = {n: {k: json.loads(v) for k, v in d.items()} for n, d in old.items()}
        out = [(key[0], e["event_id"], json.dumps(self.step(e), sort_keys=True)) for e in due]
        self.forget(now / 1000)
        for n, s in self.states.items():
            now_ = {k: json.dumps(v, sort_keys=True) for k, v in self.rows[n].items()}
            for k in old[n].keys() - now_.keys():
                s.removeKey((k,))
            for k, v in now_.items():
                if old[n].get(k) != v:
                    s.updateValue((k,), (v,))
        self.waiting.put([(json.dumps(e),) for e in rest]) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(min(int(e["t"] * 1000) for e in rest))
        elif (until := self.next_end()) is not None:
            self.handle.registerTimer(max(int(until * 1000), now + 1))
        yield pd.DataFrame(out, columns=["key", "event_id", "answer"]).astype({"event_id": "int64"})

    def close(self) -> None:
        pass

    def step(self, e: dict) -> dict:
        raise NotImplementedError

    def forget(self, now: float) -> None:
        """Drop what no event after `now` can see."""

    def next_end(self) -> float | None:
        """When there will be something to forget."""


def item_key(source: str, item: str) -> str:
    return f"{source}:{item}"


class Desk(Ordered):
    """Leases, skips and saves of one review desk.

    Events have t (seconds), event_id, kind and, by kind: item(source, item, status, place, lottery) puts an item on
    the desk; next(session, name, queue, n) hands out of a list; grant(source, session, name, queue, items, n) leases
    given items; take(source, item, session, name, queue) one right before a save; heartbeat(session, items);
    release(session, items, source, skip, name); save(source, item, session, name, queue, op_id, seen, types,
    severity); active() counts. Answers are JSON objects.
    """

    TABLES = ("items", "leases", "skips", "log")

    def forget(self, now: float) -> None:
        leases, log = self.rows["leases"], self.rows["log"]
        for k in [k for k, v in leases.items() if v["until"] + LEASE_KEPT_S <= now]:
            del leases[k]
        for k in [k for k, v in log.items() if v["t"] + LOG_KEPT_S <= now]:
            del log[k]

    def next_end(self) -> float | None:
        ends = [v["until"] + LEASE_KEPT_S for v in self.rows["leases"].values()] + [v["t"] + LOG_KEPT_S for v in self.rows["log"].values()]
        return min(ends, default=None)

    def step(self, e: dict) -> dict:
        self.forget(e["t"])
        return getattr(self, f"on_{e['kind']}", lambda _: {"result": "invalid"})(e)

    def _live(self, k: str, t: float) -> dict | None:
        v = self.rows["leases"].get(k)
        return v if v and v["until"] > t else None

    def _lease(self, k: str, e: dict) -> None:
        self.rows["leases"][k] = {"session": e["session"], "name": e.get("name"), "queue": e.get("queue"), "until": e["t"] + LEASE_S}

    def _own(self, session: str) -> list[str]:
        return [k for k, v in self.rows["leases"].items() if v["session"] == session]

    def _room(self, e: dict, n: int, own: int) -> int:
        return min(n - own, LIVE - sum(self._live(k, e["t"]) is not None for k in self._own(e["session"])))

    def _free(self, k: str, e: dict, queue: str) -> bool:
        """No lease, or one of another session that has ended; a session's own is renewed, never new."""
        v = self.rows["leases"].get(k)
        if v and (v["session"] == e["session"] or v["until"] > e["t"]):
            return False
        return queue not in UNSKIPPED or f"{k} {e['session']}" not in self.rows["skips"]

    def _listed(self, queue: str) -> list[str]:
        want = {"needs_review": "expert_review", "auto": "classified"}.get(queue)
        got = [(v["lottery"] if queue == "random" else v["place"], k) for k, v in self.rows["items"].items() if v["source"] == "video" and v["reviewed_at"] is None and want in (None, v["status"])]
        return [k for _, k in sorted(got)]

    def on_item(self, e: dict) -> dict:
        k = item_key(e["source"], e["item"])
        old = self.rows["items"].get(k, {"reviewed_at": None, "reviewer": None})
        self.rows["items"][k] = {**old, **{x: e.get(x) for x in ("source", "status", "place", "lottery")}}
        return {"result": "listed"}

    def on_next(self, e: dict) -> dict:
        if e["queue"] not in LISTS:
            return {"result": "invalid"}
        n, listed = max(1, min(BATCH, int(e.get("n") or 12))), self._listed(e["queue"])
        own = set(self._own(e["session"]))
        mine = [k for k in listed if k in own]
        for k in mine:
            self._lease(k, e)
        room = self._room(e, n, len(mine))
        new = [k for k in listed if k not in own and self._free(k, e, e["queue"])][: max(0, room)]
        for k in new:
            self._lease(k, e)
        got = set(mine) | set(new)
        others = sum((v := self._live(k, e["t"])) is not None and v["session"] != e["session"] for k in listed)
        return {"result": "handed", "items": [k for k in listed if k in got], "new": len(new), "total": len(listed), "available": len(listed) - others}

    def on_grant(self, e: dict) -> dict:
        asked = list(dict.fromkeys(e.get("items") or []))
        if not 1 <= len(e.get("items") or []) <= ASKED:
            return {"result": "invalid"}
        keys = [item_key(e["source"], i) for i in asked]
        n = min(len(keys), BATCH) if e.get("n") is None else max(1, min(BATCH, int(e["n"])))
        own = set(self._own(e["session"]))
        mine = [k for k in keys if k in own]
        for k in mine:
            self._lease(k, e)
        room = self._room(e, n, len(mine))
        new = [k for k in keys if k not in own and self._free(k, e, e["queue"])][: max(0, room)]
        for k in new:
            self._lease(k, e)
        got = set(mine) | set(new)
        held = {k: v["name"] for k in keys if (v := self._live(k, e["t"])) and v["session"] != e["session"]}
        return {"result": "granted", "items": [k for k in keys if k in got], "new": len(new), "held_by_others": held}

    def on_take(self, e: dict) -> dict:
        k = item_key(e["source"], e["item"])
        v = self._live(k, e["t"])
        if v and v["session"] != e["session"]:
            return {"result": "conflict", "held_by": v["name"]}
        self._lease(k, e)
        return {"result": "held"}

    def on_heartbeat(self, e: dict) -> dict:
        own = self._own(e["session"])
        asked = own if e.get("items") is None else list(dict.fromkeys(e["items"]))
        held = [k for k in asked if k in own]
        for k in held:
            self.rows["leases"][k]["until"] = e["t"] + LEASE_S
        return {"result": "held", "items": sorted(held), "lost": sorted(set(asked) - set(held))}

    def on_release(self, e: dict) -> dict:
        own = [k for k in self._own(e["session"]) if e.get("source") is None or k.startswith(e["source"] + ":")]
        gone = own if e.get("items") is None else [k for k in dict.fromkeys(e["items"]) if k in self._own(e["session"])]
        for k in gone:
            del self.rows["leases"][k]
        skipped = list(dict.fromkeys(e.get("items") or [])) if e.get("skip") else []
        for k in skipped:
            self.rows["skips"].setdefault(f"{k} {e['session']}", {"name": e.get("name"), "t": e["t"]})
        return {"result": "released", "items": sorted(gone), "skipped": len(skipped)}

    def on_save(self, e: dict) -> dict:
        """The item is known; an op_id seen before is answered as then; nobody else holds the item; it is as the page
        saw it. Then the review is written and logged and the lease ends."""
        k = item_key(e["source"], e["item"])
        item = self.rows["items"].get(k)
        if item is None:
            return {"result": "not found"}
        lease = self.rows["leases"].get(k)
        if e.get("op_id") and (was := self.rows["log"].get(e["op_id"])):
            if was["item"] != k:
                return {"result": "op_id of another item"}
            if lease and lease["session"] == e.get("session"):
                del self.rows["leases"][k]
            return {**was["answer"], "result": "replayed", "reviewed_at": item["reviewed_at"]}
        if lease and lease["until"] > e["t"] and lease["session"] != e.get("session"):
            return {"result": "conflict", "held_by": lease["name"]}
        if item["reviewed_at"] != e.get("seen"):
            return {"result": "conflict", "reviewed_by": item["reviewer"], "reviewed_at": item["reviewed_at"]}
        answer = {"result": "saved", "item": k, "action": "confirm" if item["reviewed_at"] is None else "update", "types": e.get("types"), "severity": e.get("severity"), "reviewer": e.get("name"), "reviewed_at": e["t"]}
        self.rows["items"][k] = {**item, "reviewed_at": e["t"], "reviewer": e.get("name")}
        if e.get("op_id"):
            self.rows["log"][e["op_id"]] = {"item": k, "t": e["t"], "answer": answer}
        self.rows["leases"].pop(k, None)
        return answer

    def on_active(self, e: dict) -> dict:
        live = [(k, v) for k, v in self.rows["leases"].items() if v["until"] > e["t"]]
        count = lambda names: {n: names.count(n) for n in sorted(set(names))}
        return {"result": "active", "by_session": count([v["session"] for _, v in live]), "by_queue": count([f"{k.split(':')[0]}:{v['queue']}" for k, v in live])}


class WorkQueue(Ordered):
    """A worker pool's photos: photo(item) waits; claim(worker, n) takes the oldest that are due; done(worker, item,
    status); error(worker, item, transient) puts it back with a delay that doubles, or fails it after ATTEMPTS or at
    once; stop(worker) gives its claims back. A claim older than CLAIM_S is stale: its photo waits again, one attempt
    more."""

    TABLES = ("photos",)

    def _recover(self, t: float) -> None:
        for v in self.rows["photos"].values():
            if v["status"] == "processing" and t - v["claimed"] > CLAIM_S:
                v.update(status="pending", tries=v["tries"] + 1, worker=None, due=v["claimed"] + CLAIM_S)

    def step(self, e: dict) -> dict:
        photos, t = self.rows["photos"], e["t"]
        self._recover(t)
        if e["kind"] == "photo":
            if e["item"] in photos:
                return {"result": "known"}
            photos[e["item"]] = {"status": "pending", "tries": 0, "since": t, "due": t, "worker": None, "claimed": None}
            return {"result": "pending"}
        if e["kind"] == "claim":
            due = sorted((v["since"], k) for k, v in photos.items() if v["status"] == "pending" and v["due"] <= t)
            got = [k for _, k in due[: int(e.get("n") or IMAGES)]]
            for k in got:
                photos[k].update(status="processing", worker=e["worker"], claimed=t)
            return {"result": "claimed", "items": got, "left": len(due) - len(got)}
        if e["kind"] == "stop":
            back = sorted(k for k, v in photos.items() if v["status"] == "processing" and v["worker"] == e["worker"])
            for k in back:
                photos[k].update(status="pending", worker=None, claimed=None)
            return {"result": "released", "items": back}
        v = photos.get(e.get("item"))
        if v is None or v["status"] != "processing" or v["worker"] != e["worker"]:
            return {"result": "not claimed"}  # by this worker, any more
        if e["kind"] == "done":
            v.update(status=e.get("status") or "classified", worker=None)
            return {"result": v["status"], "tries": v["tries"]}
        tries = v["tries"] + 1
        if not e.get("transient", True) or tries >= ATTEMPTS:
            v.update(status="failed", tries=tries, worker=None)
            return {"result": "failed", "tries": tries}
        v.update(status="pending", tries=tries, worker=None, claimed=None, due=t + DELAY_S * 2 ** (tries - 1))
        return {"result": "again", "tries": tries, "due": v["due"]}


class Inbox(Ordered):
    """Which session runs next: one at a time, those that can go on before queued ones, queued ones once their
    package has been the same for SETTLE_S. scan(packages {key: fingerprint}) lists the inbox; poll() asks what to run;
    stage(session, state) and fail(session, stage, error) report; error() and ok() set and reset the loop's delay."""

    TABLES = ("sessions", "loop")

    def step(self, e: dict) -> dict:
        sessions, t = self.rows["sessions"], e["t"]
        loop = self.rows["loop"].setdefault("", {"running": None, "delay": None})
        if e["kind"] == "scan":
            return self._scan(e["packages"], t)
        if e["kind"] == "poll":
            if loop["running"] is not None:
                return {"result": "busy", "session": loop["running"]}
            order = sorted((v["first"], k) for k, v in sessions.items() if v["state"] in RESUMABLE)
            order = order or sorted((v["first"], k) for k, v in sessions.items() if v["state"] == "queued" and t - v["stable"] >= SETTLE_S)
            if not order:
                return {"result": "idle"}
            loop["running"] = order[0][1]
            return {"result": "run", "session": order[0][1], "from": sessions[order[0][1]]["state"]}
        if e["kind"] in ("error", "ok"):
            loop["delay"] = None if e["kind"] == "ok" else min(MOST_DELAY_S, 2 * (loop["delay"] or POLL_S))
            return {"result": "wait", "seconds": loop["delay"] or POLL_S}
        if e["kind"] == "restart":  # what ran was interrupted; its state says where it goes on
            was, loop["running"] = loop["running"], None
            return {"result": "restarted", "session": was}
        v = sessions.get(e.get("session"))
        if v is None or loop["running"] != e["session"]:
            return {"result": "not running"}
        if e["kind"] == "fail":
            v.update(failed_from=v["state"] if v["state"] in RESUMABLE else None, state="failed", stage=e["stage"], error=e.get("error"))
            loop["running"] = None
        else:
            v["state"] = e["state"]
            if e["state"] in ("done", "queued"):
                loop["running"] = None
        return {"result": v["state"], "session": e["session"]}

    def _scan(self, packages: dict[str, str], t: float) -> dict:
        sessions, new, again, gone = self.rows["sessions"], [], [], []
        for k, p in sorted(packages.items()):
            v = sessions.get(k)
            if v is None:
                sessions[k] = {"state": "queued", "print": p, "stable": t, "first": t, "stage": None, "error": None}
                new.append(k)
            elif v["print"] != p:
                v.update(print=p, stable=t)
                if v["state"] == "failed" and v["stage"] == "validate":
                    v.update(state="queued", stage=None, error=None)
                    again.append(k)
        for k, v in sorted(sessions.items()):
            if k not in packages and v["state"] in ("queued", RESUMABLE[0]):
                v.update(failed_from=v["state"] if v["state"] in RESUMABLE else None, state="failed", stage="inbox", error="the package is gone")
                if self.rows["loop"][""]["running"] == k:
                    self.rows["loop"][""]["running"] = None
                gone.append(k)
        return {"result": "scanned", "new": new, "again": again, "gone": gone}


def answers(events: DataFrame, rules: type[Ordered], late: str = "0 seconds") -> DataFrame:
    """events(key, event_id, ts, kind, ...) -> (key, event_id, answer JSON), one row per event once the watermark,
    `late` behind the latest event seen, has passed it. Events may be disordered by `late` between batches and by
    anything within one; columns that are null are absent from the event. Needs the RocksDB state store.
    """
    body = [c for c in events.columns if c not in ("key", "ts")]
    event = F.to_json(F.struct((F.unix_micros("ts") / 1e6).alias("t"), *body))
    e = events.withWatermark("ts", late).select(F.col("key").cast("string").alias("key"), event.alias("event"), "ts")
    return e.groupBy("key").transformWithStateInPandas(rules(), "key string, event_id long, answer string", "Append", "EventTime")


@contextlib.contextmanager
def rocks(spark):
    """The state store that `transformWithState` needs, for queries started meanwhile."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def arrive(events: DataFrame, folder: str, files: int = 3, late: str = "10 minutes") -> None:
    """Write events as files that arrive one after another in order of their time, and a last one with an event of the
    empty key so far ahead that the watermark passes all others."""
    at = F.unix_micros("ts")
    cuts = events.select(at.cast("double").alias("at")).approxQuantile("at", [i / files for i in range(1, files)], 0.001) if files > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = events if low is None else events.where(at >= int(low))
        (part if high is None else part.where(at < int(high))).write.mode("append").parquet(folder)
    end = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr(f"interval {late}") + F.expr("interval 1 second")).alias("ts"))
    end = end.select(*[(F.col("ts") if c == "ts" else F.lit("" if c in ("key", "kind") else None).cast(t)).alias(c) for c, t in ((f.name, f.dataType) for f in events.schema)])
    end.withColumn("event_id", F.lit(0).cast(events.schema["event_id"].dataType)).write.mode("append").parquet(folder)


def replayed(events: DataFrame, rules: type[Ordered], name: str, files: int = 3, late: str = "10 minutes", per_batch: int | None = 1) -> DataFrame:
    """answers() to a table of events that arrive in `files` files, drained, (key, event_id, answer)."""
    spark = events.sparkSession
    folder = scratch(spark, f"{name}-events")
    arrive(events, folder, files, late)
    with rocks(spark):
        got = queues.drain(answers(queues.read(spark, folder, events.schema, per_batch), rules, late), "append", name)
    return got.where("key <> ''")
