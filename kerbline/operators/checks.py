"""Constraints as queries that return what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rejects(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules broken (V1, V4). A null verdict breaks its rule."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("broken", names).where(F.size("broken") > 0)


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has (V2)."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def missing(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no parent (V3)."""
    return children.join(parents.select(key), key, "left_anti")


def review(payload: dict, types: tuple[str, ...], severities: tuple[str, ...], notes: int = 2000, name: int = 60, most: int = 12) -> list[str]:
    """What is wrong with a review that a page sent (V5)."""
    out = []
    if not str(payload.get("reviewer_name") or "").strip():
        out.append("reviewer_name is missing")
    if len(str(payload.get("reviewer_name") or "")) > name:
        out.append(f"reviewer_name is longer than {name}")
    got = payload.get("types")
    if not isinstance(got, list) or not got or len(got) > most:
        out.append(f"types must be a list of 1 to {most}")
    elif odd := [t for t in got if t not in (*types, "Normal")]:
        out.append(f"unknown types: {', '.join(map(str, odd))}")
    elif "Normal" in got and len(got) > 1:
        out.append("Normal stands alone")
    if payload.get("severity") not in severities:
        out.append("unknown severity")
    if len(str(payload.get("notes") or "")) > notes:
        out.append(f"notes are longer than {notes}")
    return out


def calibration(spec: dict, params: tuple[str, ...]) -> list[str]:
    """What is wrong with a parameter calibration."""
    out = []
    for p, s in (spec.get("params") or {}).items():
        if p not in params:
            out.append(f"unknown parameter {p}")
        if s.get("source") not in ("probe", "labels", "roughness"):
            out.append(f"{p}: unknown source")
        if s.get("source") == "probe" and not (isinstance(s.get("threshold"), int | float) and 0 <= s["threshold"] <= 1 and s.get("keys")):
            out.append(f"{p}: a probe needs keys and a threshold within 0 and 1")
        for k in ("a", "b"):
            if not isinstance(s.get(k), int | float):
                out.append(f"{p}: {k} must be a number")
    return out


# ---- rules over records that are JSON texts


def at(record: Column, path: str, kind: str) -> Column:
    """What stands at a path of a variant, null where there is nothing or it is no such kind."""
    return F.try_variant_get(record, path, kind)


def number(record: Column, path: str) -> Column:
    """A JSON number at a path: a text that could be read as one is none."""
    kind = F.schema_of_variant(at(record, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|INT|FLOAT)$"), at(record, path, "double"))


def reasons(records: DataFrame, column: str, rules: dict[str, Column]) -> DataFrame:
    """records with `reasons`: the names of the rules that a record breaks, in order; a text that is no JSON breaks
    `not JSON` alone. Rules are Columns over the variant `record`; a null verdict breaks its rule."""
    d = records.withColumn("record", F.try_parse_json(column))
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return d.withColumn("reasons", F.when(F.col("record").isNull(), F.array(F.lit("not JSON"))).otherwise(broken)).drop("record")


# Terms of the log-linear roughness model, what its record must hold.
TERMS, HELD = ("log_rms_av", "log_speed", "log_rms_rot"), ("n", "residual_sd_log", "source")


def roughness_rules(schema: str) -> dict[str, Column]:
    """Rules of a roughness calibration record (V6)."""
    r = F.col("record")
    terms = at(r, "$.terms", "array<string>")
    has = lambda t: F.array_contains(F.coalesce(terms, F.array().cast("array<string>")), t)
    pair = lambda k: (F.size(at(r, f"$.fit_range.{k}", "array<variant>")) == 2) & (number(r, f"$.fit_range.{k}[0]") < number(r, f"$.fit_range.{k}[1]"))
    return {
        "schema": at(r, "$.schema", "string") == schema,
        "model": at(r, "$.model", "string") == "log_linear",
        "terms": (F.size(terms) > 0) & F.forall(terms, lambda t: t.isin(*TERMS)),
        "coef.intercept": number(r, "$.coef.intercept").isNotNull(),
        **{f"coef.{t}": ~has(t) | number(r, f"$.coef.{t}").isNotNull() for t in TERMS},
        "unit_m": number(r, "$.unit_m") > 0,
        **{f"fit_range.{k}": pair(k) for k in ("rms_av", "speed_mps")},
        **{k: at(r, f"$.{k}", "variant").isNotNull() for k in HELD},
    }


def review_rules(types: tuple[str, ...], severities: tuple[str, ...], notes: int = 2000, name: int = 60, most: int = 12) -> dict[str, Column]:
    """Rules of a review that a page sends (V5)."""
    r = F.col("record")
    got, who = at(r, "$.types", "array<string>"), F.trim(F.coalesce(at(r, "$.reviewer_name", "string"), F.lit("")))
    return {
        "reviewer_name is missing": who != "",
        "reviewer_name is too long": F.length(who) <= name,
        "types are no list of some": F.size(got).between(1, most),
        "unknown types": F.coalesce(F.forall(got, lambda t: t.isin(*types, "Normal")), F.lit(True)),
        "Normal stands alone": F.coalesce(~F.array_contains(got, "Normal") | (F.size(got) == 1), F.lit(True)),
        "unknown severity": at(r, "$.severity", "string").isin(*severities),
        "notes are too long": F.length(F.coalesce(at(r, "$.notes", "string"), F.lit(""))) <= notes,
    }


def parameter_rules(params: tuple[str, ...], labelled: tuple[str, ...]) -> dict[str, Column]:
    """Rules of a parameter calibration (U7): a map of parameters, each by probe or by labels."""
    r = F.col("record")
    specs = F.map_entries(F.coalesce(at(r, "$.params", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>").cast("array<variant>"))))
    every = lambda ok: F.forall(specs, lambda e: F.coalesce(ok(e["key"], e["value"]), F.lit(False)))
    source = lambda v: at(v, "$.source", "string")
    return {
        "schema": number(r, "$.schema") == 2,
        "probe_fp": at(r, "$.probe_fp", "string").rlike("^[0-9a-f]{16}$"),
        "parameters": every(lambda k, v: k.isin(*params)),
        "source": every(lambda k, v: source(v).isin("probe", "labels")),
        "labels": every(lambda k, v: F.coalesce(source(v) != "labels", F.lit(True)) | k.isin(*labelled)),
        "b": every(lambda k, v: F.coalesce(number(v, "$.b"), F.lit(1.0)) >= 0),
        "threshold": every(lambda k, v: F.coalesce(source(v) != "probe", F.lit(True)) | ((number(v, "$.threshold") > 0) & (number(v, "$.threshold") < 1))),
    }
