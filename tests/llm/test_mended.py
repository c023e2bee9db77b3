"""Cases that once went wrong: repeated ids, magic inside payloads, components that don't settle."""

import time

import pytest
from pyspark.sql import functions as F

from kerbline.llm import common, graph, simhash, warc


@pytest.fixture()
def scratch(spark):
    s = common.Scratch(spark, "test")
    yield s
    s.clear()


def test_pages_that_share_an_id(spark, scratch):
    rows = [(3, "AAA"), (4, "CCC"), (7, "AAA"), (7, "CCC"), (7, "UNIQUE"), (9, "UNIQUE"), (9, None), (10, "")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(2)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload) for r in warc.read_archives(warc.write_archives(pages, scratch), scratch).collect())
    b32 = lambda h: warc.base32_sha1(h.encode())
    want = [(3, "response", None, "AAA"), (4, "response", None, "CCC"), (7, "response", None, "UNIQUE"), (7, "revisit", 3, "AAA"), (7, "revisit", 4, "CCC"), (9, "response", None, ""), (9, "revisit", 7, "UNIQUE"), (10, "revisit", 9, "")]
    assert [(a, b, c, d) for a, b, c, d, _ in got] == sorted((i, t, r, b32(h)) for i, t, r, h in want)
    assert {p: x for _, t, _, p, x in got if t == "response"} == {b32(h): h.encode() for h in ("AAA", "CCC", "UNIQUE", "")}


@pytest.mark.parametrize("fake", ["WARC/1.1\r\n", "WARC/1.1\r\nA: b\r\n", "WARC/1.1\r\nContent-Length: 9\r\n\r\n", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n"])
def test_a_megabyte_of_magic(spark, scratch, fake, tmp_path):
    body = fake * ((1 << 20) // len(fake))
    data = warc.record(1, "u", body.encode(), None) + warc.record(2, "u", b"plain", None)
    at = tmp_path / "x.warc"
    at.write_bytes(data)
    import pyarrow as pa

    began = time.process_time()
    got = pa.Table.from_batches(warc._candidates([pa.RecordBatch.from_pydict({"path": [str(at)], "start": [0], "end": [len(data)], "size": [len(data)]})])).to_pylist()
    assert time.process_time() - began < 1
    assert {g["entry"]: g["exit"] for g in got}[0] == len(data)
    manifest = spark.createDataFrame([(str(at), len(data), 2)], "path string, bytes long, records long")
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_archives(manifest, scratch, split=50_000).collect()) == [(1, len(body)), (2, 5)]


def test_header_forms():
    good = warc.record(1, "u", b"x", None)
    n, fields = warc.parse_header(good)
    assert good[:n].endswith(warc.END) and fields["warc-type"] == "response"
    assert all(warc.parse_header(good[:k]) is warc.MORE for k in range(n))
    assert warc.parse_header(b"WARC/1.0\r\n") is None and warc.parse_header(b"WARC/1.1\r\n\r\n") is None
    assert warc.parse_header(b"WARC/1.1\r\nno colon\r\n") is None
    assert warc.parse_header(b"WARC/1.1\r\nA: " + b"x" * warc.MOST_HEADER) is None


def test_record_without_an_end_raises_where_it_leaves_its_range(spark, scratch, tmp_path):
    one, two = warc.record(1, "u", b"a" * 5000, None), warc.record(2, "u", b"b" * 50, None)
    at = tmp_path / "x.warc"
    at.write_bytes(one[:-2] + b"??" + two)
    manifest = spark.createDataFrame([(str(at), len(one + two), 2)], "path string, bytes long, records long")
    with pytest.raises(Exception, match="doesn't end|breaks"):
        warc.read_archives(manifest, scratch, split=1000).collect()


def test_fingerprints_of_one_id_link(spark, scratch):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(3, two), (5, two), (5, one), (9, one), (8, "quite another text of some words"), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.component_id) for r in simhash.near_duplicates(docs, scratch).collect()), key=str)
    assert got == [(3, 3), (5, 3), (5, 3), (8, 8), (9, 3), (None, 3)]


def test_components_of_a_star_around_the_largest_node(spark, scratch):
    edges = spark.range(3000).select(F.lit(10_000).cast("long").alias("u"), F.col("id").alias("v"))
    got = graph.components(edges, scratch).collect()
    assert len(got) == 3001 and {r.component for r in got} == {0}


def test_components_say_when_they_do_not_settle(spark, scratch, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 2)
    path = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        graph.components(path, scratch)
