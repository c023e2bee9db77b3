"""The pipeline against a plain version of its stages."""

import random
import re

import pyarrow.parquet as pq

import corpus_pipeline
from kerbline.llm import packing, quality, tokens
from test_jaccard import brute
from test_ops import PII, brute_lines, brute_repeats


def kept(t):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
    v = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_repeat_words": brute_repeats(t) if len(w) >= 50 else 0}
    full = [x for x in t.split("\n") if x.split()]
    v |= {"n_lines": len(full), "n_dup_lines": len(full) - len(set(full)), "n_upper": sum(c.isupper() for c in t), "n_letters": sum(c.isalpha() for c in t), "n_exclamations": t.count("!")}
    return not any(eval(rule, {}, v) for rule in quality.RULES.values())


def masked(t):
    spans = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(PII) for m in re.finditer(p, t) if ok(m[0]))
    out, at = [], 0
    for s, _, e, n in spans:
        if s >= at:
            out += [t[at:s], f"<{n.upper()}>"]
        at = max(at, e)
    return "".join(out) + t[at:]


def plain_run(rows):
    """{(doc_id, piece): length} of the five stages over (doc_id, text) in order of doc_id."""
    rows = [(i, t) for i, t in rows if t is not None and kept(t)]
    rows = list(zip([i for i, _ in rows], brute_lines([t for _, t in rows], 8)))
    low = brute([t for _, t in rows])
    rows = [(i, masked(t)) for k, (i, t) in enumerate(rows) if low[k] == k]
    want = {}
    for (i, _), x in zip(rows, tokens.word_encoder().batch([t for _, t in rows])):
        n = len(x) // 4 + 1
        for p in range(-(-n // packing.CAPACITY)):
            want[int(i), p] = min(packing.CAPACITY, n - p * packing.CAPACITY)
    return want


def check_sequences(got):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY


def test_pipeline(spark, data):
    d = pq.read_table(f"{data}/documents.parquet").to_pandas().sort_values("doc_id")
    got = corpus_pipeline.run(spark, data).collect()
    assert {(r.doc_id, r.piece): r.length for r in got} == plain_run(list(zip(d.doc_id, d.text)))
    check_sequences(got)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and very long texts, copies, clashing and dotted column names, and an empty table through run()."""
    r = random.Random(3)
    words = ["road", "crack", "edge", "lane", "repair", "asphalt", "survey", "metre", "joint", "shoulder", "drain", "kerb"]
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(300)) for _ in range(n))
    long, twin = text(30_000), text(200)
    hub = text(150) + "\n" + text(12)
    texts = [None, "", " \n ", long, twin, twin, twin + " more", hub, hub + "\n" + text(60), text(80) + " ann.b@mail.example.com " + text(40), text(49), "a " * 200, text(100) + "\nshared line of text\n" + text(90), "shared line of text\n" + text(70)]
    rows = [(i, t, "en", None, None if t is None else len(t), 1, "x", 2) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, piece string, component_id int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{tmp_path}/one/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/one").collect()
    assert {(x.doc_id, x.piece): x.length for x in got} == plain_run(list(enumerate(texts)))
    check_sequences(got)
    odd = rows + [rows[4]] * 3 + [(None, twin + " " + text(150), "en", "s", 1, 1, "x", 2), (None, None, None, None, None, None, None, None)]
    spark.createDataFrame(odd, schema).write.parquet(f"file://{tmp_path}/two/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/two").collect()
    assert {x.doc_id for x in got} >= {None, 4, 7, 9} and len([x for x in got if x.doc_id == 4 and x.piece == 0]) == 4  # rows of one id are one document
    check_sequences(got)
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_stage_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
