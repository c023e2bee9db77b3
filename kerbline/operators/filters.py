"""Query parameters to a typed filter, and the filter to one Column that Catalyst can push down (F1-F16)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

PARAMETERS = {
    "video": {"session", "date_from", "date_to", "label", "severity", "status", "vlm_class", "answered", "reviewed", "needs_review", "min_confidence", "bbox", "limit", "offset"},
    "citizen": {"date_from", "date_to", "label", "severity", "reviewed", "needs_review", "include_review", "min_confidence", "bbox", "limit", "offset"},
}
LIMIT, MOST = 5000, 20_000


class FilterError(ValueError):
    """A parameter that doesn't hold what it should."""


@dataclass(frozen=True)
class Filter:
    layer: str = "video"
    within: Mapping[str, tuple] = field(default_factory=dict)
    flags: Mapping[str, bool] = field(default_factory=dict)
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    min_confidence: float | None = None
    bbox: tuple[float, float, float, float] | None = None
    include_review: bool = False
    limit: int = LIMIT
    offset: int = 0

    def column(self, time: str = "utc", lon: str = "centre_lon", lat: str = "centre_lat", zone: str = "UTC") -> Column:
        """One conjunction, cheap tests first. A null never passes a time, number or list test; a null flag is false."""
        out = [F.lit(True)]
        if self.layer == "citizen" and not self.include_review:
            out.append(F.col("status") != "expert_review")
        for name, values in self.within.items():
            if name != "labels":
                out.append(F.col(name).isin(*values))
        for name, value in self.flags.items():
            out.append(F.coalesce(F.col(name), F.lit(False)) == value)
        if self.min_confidence is not None:
            out.append(F.col("confidence") >= self.min_confidence)
        if self.bbox:
            w, s, e, n = self.bbox
            out += [F.col(lon).between(w, e), F.col(lat).between(s, n)]
        at = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
        if self.start:
            out.append(F.col(time) >= at(self.start))
        if self.end:
            out.append(F.col(time) < at(self.end))
        if "labels" in self.within:
            out.append(F.arrays_overlap(F.transform("final_labels", L.canonical), L.array(self.within["labels"])))
        cond = out[0]
        for c in out[1:]:
            cond = cond & c
        return cond

    def page(self, df: DataFrame, *order: str) -> DataFrame:
        """The page asked for, in order."""
        return df.where(self.column()).orderBy(*order).offset(self.offset).limit(self.limit)


def _date(name: str, raw: str, end: bool, zone: str) -> dt.datetime:
    """An ISO date or date-time as UTC without zone; a plain date at the end of a range covers that day."""
    import zoneinfo

    try:
        plain = len(raw) == 10
        t = dt.datetime.fromisoformat(raw) + dt.timedelta(days=1 if plain and end else 0)
    except ValueError:
        raise FilterError(f"{name}={raw!r} is no ISO date or date-time") from None
    t = t if t.tzinfo else t.replace(tzinfo=zoneinfo.ZoneInfo(zone))
    return t.astimezone(dt.timezone.utc).replace(tzinfo=None)


def _choices(name: str, raw: str, allowed: tuple[str, ...]) -> tuple[str, ...]:
    known, out = {a.lower(): a for a in allowed}, []
    for x in filter(None, (p.strip() for p in raw.split(","))):
        if x.lower() not in known:
            raise FilterError(f"{name}={x!r} is none of {', '.join(allowed)}")
        out.append(known[x.lower()])
    return tuple(dict.fromkeys(out))


def _flag(name: str, raw: str) -> bool:
    if raw.lower() not in ("true", "false", "1", "0", "yes", "no"):
        raise FilterError(f"{name}={raw!r} is neither true nor false")
    return raw.lower() in ("true", "1", "yes")


def _number(name: str, raw: str, low: float, high: float, kind=float):
    try:
        v = kind(raw)
    except ValueError:
        raise FilterError(f"{name}={raw!r} is no number") from None
    if not low <= v <= high:
        raise FilterError(f"{name} must lie within {low} and {high}")
    return v


def parse(query: Mapping[str, str], layer: str = "video", allow: tuple[str, ...] = (), zone: str = "UTC") -> Filter:
    """A Filter from query parameters (F1). Unknown ones are refused; names that begin with _ are passed over.

    zone "Asia/Kolkata" gives the map client's day bounds (F16).
    """
    known = PARAMETERS[layer] | set(allow)
    if odd := sorted(k for k in query if k not in known and not k.startswith("_")):
        raise FilterError(f"unknown for the {layer} layer: {', '.join(odd)}")
    q = {k: str(v).strip() for k, v in query.items() if v is not None and str(v).strip()}
    within, flags, kw = {}, {}, {"layer": layer}
    if "session" in q:
        within["session_id"] = tuple(filter(None, (x.strip() for x in q["session"].split(","))))
    for name, column, allowed in (("label", "labels", L.LABELS), ("severity", "final_severity", L.SEVERITIES), ("status", "status", L.STATUSES), ("vlm_class", "vlm_class", L.CLASSES)):
        if name in q:
            within[column] = _choices(name, q[name], allowed)
    for name, column in (("answered", "answered"), ("reviewed", "expert_reviewed"), ("needs_review", "needs_expert_review")):
        if name in q:
            flags[column] = _flag(name, q[name])
    if "date_from" in q:
        kw["start"] = _date("date_from", q["date_from"], False, zone)
    if "date_to" in q:
        kw["end"] = _date("date_to", q["date_to"], True, zone)
    if kw.get("start") and kw.get("end") and kw["start"] >= kw["end"]:
        raise FilterError("date_from must come before date_to")
    if "min_confidence" in q:
        kw["min_confidence"] = _number("min_confidence", q["min_confidence"], 0, 1)
    if "bbox" in q:
        parts = q["bbox"].split(",")
        if len(parts) != 4:
            raise FilterError("bbox needs four numbers, longitude first")
        w, s, e, n = (_number("bbox", x, -180, 180) for x in parts)
        if not (w <= e and -90 <= s <= n <= 90):
            raise FilterError("bbox needs west <= east and south <= north, longitude first")
        kw["bbox"] = (w, s, e, n)
    if "include_review" in q:
        kw["include_review"] = _flag("include_review", q["include_review"])
    kw["limit"] = int(_number("limit", q.get("limit", str(LIMIT)), 1, MOST, int))
    kw["offset"] = int(_number("offset", q.get("offset", "0"), 0, 10_000_000, int))
    return Filter(within=within, flags=flags, **kw)


def gate(s1: Column, s2: Column, distressed: Column, flagged: Column, least: float = 0.80) -> Column:
    """classified or expert_review by stored confidences."""
    ok = (s1 >= least) & (~distressed | (s2 >= least)) & ~F.coalesce(flagged, F.lit(False))
    return F.when(ok, "classified").otherwise("expert_review")


QUEUES = {
    "needs_review": "coalesce(needs_expert_review, false) and not coalesce(expert_reviewed, false)",
    "auto": "not coalesce(needs_expert_review, false) and not coalesce(expert_reviewed, false)",
    "random": "not coalesce(expert_reviewed, false)",
    "reviewed": "coalesce(expert_reviewed, false)",
}


def queue(name: str) -> Column:
    """Rows of a review queue (F10): answered ones by flag and review state."""
    return F.expr(f"answered and {QUEUES[name]}")
