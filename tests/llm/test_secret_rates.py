"""Recall and false alarms of the secret scan on values planted into the test tables' own texts."""

import random
import string

from pyspark.sql import functions as F

from kerbline.llm import secrets
from kerbline.llm.common import Scratch

B62, B36 = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits


def values(r):
    """A value of each form as it is written."""
    some = lambda abc, n: "".join(r.choice(abc) for _ in range(n))
    return {
        "quoted": f'api_key = "{some(B62, 32)}"', "header": f"Token: {some(B36, 24)}", "password": f"password={some(B62 + '+/', 16)}", "access": f"AKIA{some(string.ascii_uppercase + string.digits, 16)}",
        "hex": some("0123456789abcdef", 40), "bare": some(B62, 40), "base64": some(B62 + "+/", 43) + "=", "lower": some(B36, 32),
    }


def test_planted_values(spark, data):
    """Values that one document holds are live, values that many owners hold and placeholders are not. A bare value in
    lower case alone is no form of the scan: its rate is told, not asked for."""
    r = random.Random(21)
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 200").orderBy("doc_id").limit(160).select("doc_id", "text", "source").collect()
    copied = list(values(r).values()) + ['api_key = "your_api_key_goes_here"', "password=changeme12345", "token: xxxxxxxxxxxxxxxxxxxx"]
    rows, own, shared = [], {}, {}
    for n, d in enumerate(docs):
        text, form = d.text, None
        at = text.find(" ", r.randrange(len(text) // 2)) % len(text)
        if n % 2:
            form, value = r.choice(list(values(r).items()))
        else:
            value = copied[n // 2 % len(copied)]
        text = f"{text[:at]} {value} {text[at:]}"
        rows.append((d.doc_id, text, f"o{n % 20}"))
        (own if form else shared)[d.doc_id] = (form, at + 1, at + 1 + len(value))
    got = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), Scratch(spark, "rates")).select("doc_id", "live").collect()}
    found = lambda i, a, b: any(s.start < b and a < s.end for s in got[i].live)
    by = {}
    for i, (form, a, b) in own.items():
        by.setdefault(form, []).append(found(i, a, b))
    rates = {f: sum(v) / len(v) for f, v in by.items()}
    print(rates)
    asked = [x for f, v in by.items() if f != "lower" for x in v]
    assert len(asked) > 50 and sum(asked) / len(asked) >= 0.97, rates
    assert not [i for i, (_, a, b) in shared.items() if found(i, a, b)]
    clean = spark.read.parquet(f"{data}/documents.parquet").where(~F.col("text").rlike(r"(?i)(passw|secret|token|api_?key)|AKIA|[0-9a-f]{16}"))
    n = clean.count()
    alarms = secrets.scan(clean, Scratch(spark, "clean")).where(F.size("live") > 0).count()
    assert n > 50 and alarms <= 0.01 * n, (alarms, n)
