"""Rules over JSON records: a good record breaks none, each fault its own rule, odd texts no crash."""

import json

import pytest

from kerbline.functions import labels
from kerbline.operators import checks

ROUGH = {"schema": "v1", "model": "log_linear", "terms": ["log_rms_av", "log_speed"], "coef": {"intercept": 1, "log_rms_av": 0.9, "log_speed": -0.4}, "unit_m": 100, "fit_range": {"rms_av": [0.1, 1], "speed_mps": [3, 12.5]}, "n": 40, "residual_sd_log": 0.1, "source": {"survey": "s"}}
REVIEW = {"reviewer_name": "Asha", "types": ["Potholes", "Ravelling"], "severity": "High", "notes": "x"}
PARAMS = {"schema": 2, "probe_fp": "0123456789abcdef", "params": {"cracking": {"source": "labels", "b": 2}, "ravelling": {"source": "probe", "threshold": 0.4, "a": 0}}}


def broken(spark, rules, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, rec string")
    return [r.reasons for r in checks.reasons(d, "rec", rules).orderBy("i").collect()]


def change(record, path, value):
    """A copy with the value at a path, or without it."""
    out = json.loads(json.dumps(record))
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(out)


@pytest.mark.parametrize("record,rules,faults", [
    (ROUGH, checks.roughness_rules, {
        "schema": (("schema",), "v0"), "model": (("model",), None), "terms": (("terms",), ["log_rms_av", "other"]), "coef.intercept": (("coef", "intercept"), "1"), "coef.log_speed": (("coef", "log_speed"), None),
        "unit_m": (("unit_m",), 0), "fit_range.rms_av": (("fit_range", "rms_av"), [1, 0.1]), "fit_range.speed_mps": (("fit_range", "speed_mps"), [3]), "n": (("n",), None), "source": (("source",), None),
    }),
    (REVIEW, checks.review_rules, {
        "reviewer_name is missing": (("reviewer_name",), "  "), "reviewer_name is too long": (("reviewer_name",), "n" * 61), "types are no list of some": (("types",), []), "unknown types": (("types",), ["zebra"]),
        "Normal stands alone": (("types",), ["Normal", "Potholes"]), "unknown severity": (("severity",), "odd"), "notes are too long": (("notes",), "x" * 2001),
    }),
    (PARAMS, checks.parameter_rules, {
        "schema": (("schema",), 1), "probe_fp": (("probe_fp",), "0123456789ABCDEF"), "parameters": (("params", "zebra"), {"source": "probe", "threshold": 0.5}), "source": (("params", "cracking", "source"), "guess"),
        "labels": (("params", "ravelling"), {"source": "labels"}), "b": (("params", "cracking", "b"), -1), "threshold": (("params", "ravelling", "threshold"), 1),
    }),
])
def test_each_fault_breaks_its_rule(spark, record, rules, faults):
    args = {checks.roughness_rules: ("v1",), checks.review_rules: (labels.DISTRESS, labels.SEVERITIES), checks.parameter_rules: (("cracking", "potholes", "ravelling"), ("cracking", "potholes"))}[rules]
    got = broken(spark, rules(*args), json.dumps(record), *[change(record, *f) for f in faults.values()], "{", "", None, "[]", '"x"', "null")
    assert got[0] == [] and got[1 : 1 + len(faults)] == [[name] for name in faults]
    rest = got[1 + len(faults) :]
    assert rest[0] == rest[1] == rest[2] == ["not JSON"] and all(rest)


def test_no_records(spark):
    assert broken(spark, checks.roughness_rules("v1")) == []
