"""Each training-data operator against brute force, and with nulls, empty tables, long texts, ties and odd columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import common, graph, lines, packing, pieces, pii, quality, queries, secrets, simhash, store, tokens, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, `odd col` string"
LONG = "lorem ipsum dolor sit amet " * 30_000


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 4}", len(t or ""), 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


ODD = ["", None, " \n\t ", LONG, "same text here twice over", "same text here twice over", "é🙂 ü"]


@pytest.fixture()
def scratch(spark):
    s = common.Scratch(spark, "test")
    yield s
    s.clear()


@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL])
def test_same_as_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_components(spark, scratch):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    root = {v: v for e in edges for v in e}
    while True:
        now = dict(root)
        for a, b in edges:
            now[a] = now[b] = min(now[a], now[b])
        if now == root:
            break
        root = now
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: root[v] for v in linked}


@pytest.mark.parametrize("bucket", [2048, 4])
def test_simhash_links_against_all_pairs(spark, scratch, bucket):
    r = random.Random(2)
    seeds = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for s in seeds for _ in range(25)})
    d = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {x.node: x.component for x in graph.components(simhash.links(d, len(fps), 4, scratch, bucket), scratch).collect()}
    root = list(range(len(fps)))
    while True:
        now = [min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))]
        if now == root:
            break
        root = now
    assert all(got.get(i, i) == root[i] for i in range(len(fps)))


def test_bucket_over_batches_gives_one_answer():
    import pyarrow as pa

    r = random.Random(7)
    low = sorted(r.sample(range(1 << 20), 40))
    fp = np.array(low, dtype=np.int64)
    rep = np.arange(len(low))
    key = np.zeros(len(low), dtype=np.int64)

    def run(cuts, most):
        at = [0, *cuts, len(low)]
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i:j]) for x in (key, key, fp, rep)], names=["c", "key", "fp", "rep"]) for i, j in zip(at, at[1:])]
        got = [x for b in simhash._links(iter(batches), 4, most) for x in zip(*(c.to_pylist() for c in b.columns))]
        return sorted(got)

    for most in (10, 39, 40, None):
        whole = run([], most)
        assert all(h == (most is not None and most < 40) for _, _, h in whole)
        for c in range(1, 40):
            assert run([c], most) == whole and run([c // 2, c], most) == whole
        assert run(list(range(1, 40)), most) == whole


def test_simhash_links_in_a_hot_group(spark, scratch):
    """23,000 fingerprints that share half their bits; pairs at distance 4 with one bit in each of four blocks."""
    r = np.random.default_rng(5)
    base = (r.integers(0, 1 << 32, 11_500, dtype=np.uint64) << np.uint64(32)) | np.uint64(0x5A5A5A5A)
    flip = np.array([1 << 33 | 1 << 43 | 1 << 54 | 1 << 63, 1 << 32 | 1 << 42 | 1 << 53 | 1 << 0], dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flip[np.arange(len(base)) % 2]]))
    d = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64).tolist())], "fp long, rep long").repartition(4)
    comp = {x.node: x.component for x in graph.components(simhash.links(d, len(fps), 4, scratch), scratch).collect()}
    at = {int(f): i for i, f in enumerate(fps)}
    lost = sum(comp.get(at[int(b)], -1) != comp.get(at[int(b ^ flip[k % 2])], -2) for k, b in enumerate(base))
    assert lost == 0
    low = fps[:: len(fps) // 200]
    for i, f in enumerate(low.tolist()):  # no component joins what isn't linked
        near = np.flatnonzero(np.bitwise_count(fps ^ np.uint64(f)) <= 4)
        assert len({comp.get(int(j), int(j)) for j in near}) == 1


def plain_fingerprint(text):
    """The rule word by word, on bytes of the lower-cased text."""
    import xxhash

    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())) if x]
    if not w:
        return 0
    g = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in g]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprint_rule():
    r = random.Random(9)
    texts = ["".join(r.choice(["A", "b", "É", "🙂", " ", "  ", "\n", "\x0b", "\xa0", "x y z"]) for _ in range(r.randrange(60))) for _ in range(200)]
    for t in [*texts, *(x for x in ODD if x), "one", "one two three"]:
        if t != LONG:
            assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


def test_hot_keys_are_spread(spark, scratch):
    left = scratch.save(spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, id % 900) AS k"), "left")
    right = scratch.save(spark.range(900).selectExpr("id AS k", "id * 2 AS v"), "right")
    got = common.counted_join(left, right, ["k"], scratch, "counts")
    assert got.select("id", "k", "v").exceptAll(left.selectExpr("id", "k", "k * 2")).count() == 0 and got.count() == 5000


def test_simhash_edges(spark, scratch):
    got = {r.id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs(spark, ODD), scratch).collect()}
    assert got[0] == got[1] == got[2] == (0, 0) and got[4] == got[5] == (got[4][0], 4) and len(got) == len(ODD)
    assert simhash.near_duplicates(docs(spark, ODD).where("false"), scratch).count() == 0
    nulls = simhash.near_duplicates(docs(spark, ["a b c d e", "x y"], [None, 3]), scratch).collect()
    assert {r.component_id for r in nulls} == {None, 3}
    kept = simhash.keep_one(docs(spark, ODD), scratch)
    assert kept.columns == docs(spark, ODD).columns and {r.doc_id for r in kept.collect()} == {0, 3, 4, 6}
    odd = docs(spark, ODD).withColumn("a.b", F.lit(1)).withColumn("id", F.lit(5)).withColumn("component_id", F.lit(6)).withColumn("gone", F.lit(7))
    for least in (0.8, None):
        kept = simhash.keep_one(odd, scratch, least=least)
        assert kept.columns == odd.columns and {(r.doc_id, r.gone) for r in kept.collect()} == {(i, 7) for i in (0, 3, 4, 6)}
    twice = docs(spark, ["a b c d e", "a b c d e"], [3, 3])
    assert simhash.keep_one(twice, scratch).count() == 2  # rows that share an id are one document


def test_warc_round_trip_with_magic_in_payloads(spark, scratch):
    inner = warc.record(9, "http://in.side/", b"trap", None).decode()
    html = ["<p>a</p>", inner * 3, None, "", "WARC/1.1\r\n", "<p>a</p>", "é" * 5000, inner * 3 + "x"]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://h/{i} ü\n", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, first int").repartition(2)
    m = warc.write_archives(pages, scratch, most=3000)
    for split in (97, 1000, 1 << 20):
        got = {r.page_id: r for r in warc.read_archives(m, scratch, split=split).collect()}
        assert len(got) == len(html)
        for i, h in enumerate(html):
            body = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), warc.base32_sha1(body))
            first = min(j for j, x in enumerate(html) if (x or "") == (h or ""))
            assert (got[i].record_type, got[i].refers_to) == (("response", None) if first == i else ("revisit", first))
            assert got[i].payload == (None if first != i else body)
    assert warc.read_archives(warc.write_archives(pages.where("false"), scratch), scratch).count() == 0


def test_warc_edges(spark, scratch):
    """Null ids, repeated rows, one payload in most rows, payloads longer than several ranges, odd columns."""
    long = "x" * 9000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "y" * 9000
    rows = [(None, "u", "hot"), (None, "u", "hot"), (5, "u", "hot"), (5, "u", "hot"), (4, None, long), (6, "u", long), (4, None, long), *((100 + i, "u", "hot") for i in range(300))]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, d int, `a.b` int").repartition(3)
    m = warc.write_archives(pages, scratch, most=20_000)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(m, scratch, split=1000).collect()), key=str)
    want = [(None, "response", None, 3)] * 2 + [(5, "response", None, 3)] * 2 + [(4, "response", None, len(long))] * 2 + [(6, "revisit", 4, len(long))] + [(100 + i, "revisit", 5, 3) for i in range(300)]
    assert got == sorted(want, key=str)
    kept = warc.write_archives(pages, scratch, least=4)
    assert {(r.page_id, r.record_type) for r in warc.read_archives(kept, scratch).collect() if r.page_id in (5, 6, 100)} == {(5, "response"), (6, "revisit"), (100, "response")}


def test_warc_broken_chain_raises(spark, scratch):
    m = warc.write_archives(spark.createDataFrame([(1, "u", "x" * 100), (2, "u", "y" * 100)], "page_id long, url string, html string").coalesce(1), scratch)
    path = m.first().path.removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-9] + b"#########")
    with pytest.raises(ValueError):
        warc.read_archives(m, scratch)


@pytest.mark.parametrize("seed", range(60))
def test_packing_plan(seed):
    r = random.Random(seed)
    cap = r.choice([12, 30, 64])
    counts = {k: r.randint(0, 25) for k in r.sample(range(1, cap + 1), r.randint(1, cap // 2))}
    rows, bins = packing.plan(counts, cap)
    held, seen = {}, {}
    for length, first, n, per, start, offset in rows:
        for i in range(n):
            held.setdefault(start + i // per, []).append((offset + i % per * length, length))
            seen.setdefault(length, []).append(first + i)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(v)) for k, v in counts.items() if v}
    assert set(held) == set(range(bins))
    for v in held.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= cap
    total = sum(k * v for k, v in counts.items())
    assert bins >= -(-total // cap)


def test_pack_edges(spark, scratch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    got = packing.pack(docs(spark, ODD), scratch).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(ODD):
        want = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        assert b"".join(bytes(r.ids) for r in sorted(by[i], key=lambda r: r.piece)) == want
    assert max(r.length for r in got) == 4096
    assert packing.pack(docs(spark, ODD).where("false"), scratch).count() == 0


def test_chunk_tables_equal_the_libraries():
    from tokenizers import Tokenizer

    r = random.Random(5)
    parts = ["a", "b", "Z", " ", "  ", "\n", "▁", "é", "É", "ß", "🙂", "x1", "don't", "\t", " ", "\x1c", "\0", "12", "!!", "<|endoftext|>", "　", "İ", "́", "\r\n", ".", " foo,"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(5000)]
    for enc, name in ((tokens.word_encoder(), "word_bpe_49k.json"), (tokens.byte_encoder(), "byte_bpe_50k.json")):
        want = Tokenizer.from_file(tokens.tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.batch(texts)] == [e.ids for e in want]
    got = [np.frombuffer(x, "<u4").tolist() for x in pieces.piece_encoder().batch(texts)]
    assert got == pieces.processor().encode(texts)


def test_full_word_table_keeps_what_it_has():
    """Words met when there is no room are segmented each time, right, and those met before aren't forgotten."""
    from tokenizers import Tokenizer

    tok, w = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json")), tokens._Words("byte_bpe_50k.json", lower=False, blank=" ", most=3)
    chunks = ["road", "Straße,", "kerb", "lane", "×", "a×b!", "drain??", "...", "\0edge.", "ªb", "x1", "road"]
    for c in chunks * 2:
        want = tok.encode(c[1:] if c[0] == "\0" else " " + c, add_special_tokens=False).ids
        assert np.frombuffer(w(c), "<u4").tolist() == want
    assert list(w.known) == [" road", " Straße", ","]


def test_sentencepiece_round_trip(spark):
    sp = pieces.processor()
    got = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs(spark, ODD))).collect()}
    assert got == {i: sp.decode(sp.encode(t or "")) for i, t in enumerate(ODD)}
    assert pieces.encode(docs(spark, ODD).where("false")).count() == 0


def test_top_k_against_all_pairs(spark, scratch):
    r = np.random.default_rng(3)
    v = (r.integers(-3, 4, (230, 5)) / 4).tolist()
    rows = [(i, [float(c) for c in x], 1) for i, x in enumerate(v)] + [(300, None, 1), (400, [1.0, None, 0.0, 0.0, 0.0], 1), (500, [float("nan")] * 5, 1), (None, [1.0] * 5, 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), scratch, every=10, k=4).collect()
    m = np.floor(np.array(v) * 1024).astype(int)
    want = [(q, i + 1, c, s) for q in range(0, 230, 10) for i, (s, c) in enumerate(sorted(((-int(m[q] @ m[c]), c) for c in range(230) if c != q))[:4]) for s in [-s]]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>, score int"), scratch).count() == 0


def test_top_k_with_repeated_rows(spark, scratch):
    r = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in r.integers(-2, 3, 3)]) for i in r.integers(0, 12, 60)] + [(10, [1.0, 1.0, 1.0])] * 4
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), scratch, every=5, k=3).collect()
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 5 == 0:
            best = sorted((-sum(int(x * 1024) * int(y * 1024) for x, y in zip(v, w)), c) for j, (c, w) in enumerate(rows) if j != i)[:3]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_secret_spans_and_ownership(spark, scratch):
    key = "Ab3xY9kLm2Qw7ZtR5vN8pHs4JdFg6K"
    texts = ["x token = 'abcdefghijkl' y", "token: short", "AKIA" + "A" * 14, "deadbeef" * 3, f"k {key} z", f"k {key} z", f"k {key} z", "", None, "PassWord=" + "zq8Kw" * 10_000]
    got = {r.doc_id: r for r in secrets.scan(docs(spark, texts), scratch).selectExpr("doc_id", secrets.span_text("found") + " AS f", "size(live) AS live").collect()}
    assert [got[i].f for i in (0, 1, 2, 3, 7, 8)] == ["assign:2:23", "", "access:0:18", "hex:0:24", "", ""]
    assert got[4].f == "mixed:2:32" and got[4].live == 0  # three owners hold it
    assert got[9].f == "assign:0:50009" and got[9].live == 1
    assert {r.n_owners for r in secrets.ownership(docs(spark, texts), scratch).where("n_documents = 3").collect()} == {3}
    assert secrets.scan(docs(spark, texts).where("false"), scratch).count() == 0


SECRETS = (
    ("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 12),
    ("access", r"(AKIA[A-Z0-9]+)", 18),
    ("hex", r"([0-9a-f]+)", 16),
)


def test_secret_spans_against_plain_patterns(spark, scratch):
    """Base and added spans of random texts, and each value's owners and documents, against plain versions."""
    r = random.Random(12)
    keys = ["".join(r.choice("abcXYZ0123456789") for _ in range(26)) for _ in range(6)]
    parts = ["password", "Token", "api_key", "apikey", " = ", ":", '"', "'", "AKIA", "IOSFODNN7EXAMPLE22", "deadbeef", "0123456789abcdef", "ab", "Z", " ", "é", "🙂", "secret", "ſ", "\n", "x" * 12, *keys]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(600)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{r.randrange(5)}", 0, 1, "x") for i, t in enumerate(texts)]
    rows += rows[:40]  # repeated rows
    d = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1)).withColumn("found", F.lit(2)).withColumn("a.b", F.lit(3)).repartition(3)
    base, more, holds = {}, {}, collections.defaultdict(set)
    for i, t, _, owner, *_ in rows:
        spans = [(m.start(), k, m.end(), n, m[1]) for k, (n, p, least) in enumerate(SECRETS) for m in re.finditer(p, t) if len(m[1]) >= least]
        base[i] = sorted(spans)
        runs = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t) if len(m[0]) >= 24]
        runs = [x for x in runs if re.search("[0-9]", x[2]) and re.search("[a-z]", x[2]) and re.search("[A-Z]", x[2]) and secrets.entropy(x[2]) >= 3.5]
        more[i] = [x for x in runs if not any(s < x[1] and x[0] < e for s, _, e, _, _ in spans)]
        for v in [x[4] for x in spans] + [x[2] for x in more[i]]:
            holds[v].add((owner, i))
    wide = {v for v, x in holds.items() if len({o for o, _ in x}) >= 3 or len(x) >= 20}
    assert wide and len(wide) < len(holds)
    got = secrets.scan(d, scratch).selectExpr("doc_id", secrets.span_text("filter(found, f -> f.kind < 3)") + " AS b", secrets.span_text("filter(live, f -> f.kind = 3)") + " AS m").collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.b == ",".join(f"{n}:{s}:{e}" for s, _, e, n, _ in base[x.doc_id])
        assert x.m == ",".join(f"mixed:{s}:{e}" for s, e, v in more[x.doc_id] if v not in wide and secrets.looks_live(v))
    have = sorted((r.n_documents, r.n_owners) for r in secrets.ownership(d, scratch).collect())
    assert have == sorted((len({i for _, i in x}), len({o for o, _ in x})) for x in holds.values())


def test_copied_within_one_owner_is_no_secret(spark, scratch):
    key = "Ab3xY9kLm2Qw7ZtR5vN8pHs4JdFg6K"
    rows = [(i, f"k {key} z", "en", "hot", 0, 1, "x") for i in range(25)] + [(30, "k Zb8xQ1kLm5Qw7ZtR5vN8pHs4JdFg9P", "en", "hot", 0, 1, "x"), (31, "token = your_token_example_here", "en", "hot", 0, 1, "x")]
    got = {r.doc_id: r.n for r in secrets.scan(spark.createDataFrame(rows, DOCS), scratch).selectExpr("doc_id", "size(live) AS n").collect()}
    assert [got[i] for i in (0, 24, 30, 31)] == [0, 0, 1, 0]
    words = "\n".join(f"{i:016x} {key}{i}" for i in range(20_000))  # base spans and candidates side by side
    t = time.monotonic()
    assert len(secrets.more_spans(words, secrets.base_spans(words))) == 20_000 and time.monotonic() - t < 10


def test_store_round_trip(spark, scratch):
    from tokenizers import Tokenizer

    r = random.Random(4)
    shared = " ".join(r.choice(["pothole", "road", "crack", "edge", "42"]) for _ in range(5000))
    texts = [*ODD, shared, "intro " + shared + " tail", shared]
    index, manifest = store.write_store(docs(spark, texts), scratch, pack_bytes=30_000)
    got = {x.doc_id: x for x in store.read_store(index, manifest, scratch).collect()}
    tok, at = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json")), 0
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (at, len(ids), np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    stored = index.agg(F.sum("n")).first()[0]
    assert stored < at and index.count() == index.select("digest").distinct().count() and len(store.store_root(manifest)) == 32
    e, m = store.write_store(docs(spark, texts).where("false"), scratch)
    assert store.read_store(e, m, scratch).count() == 0


def test_store_detects_changed_files(spark, scratch):
    index, manifest = store.write_store(docs(spark, ["some words to keep"]), scratch)
    path = index.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-1] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="recipe"):
        store.read_store(index, manifest, scratch).collect()


def brute_repeats(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text) if x]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(g)
    return len({i + o for i, x in enumerate(g) if n[x] > 1 for o in range(3)})


def test_quality_measurements(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(40))) for _ in range(150)] + ["a\nb\n\na\n a", *ODD]
    got = {x.doc_id: x for x in quality.ledger(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_repeat_words == brute_repeats(t or "")
    assert got[150].n_dup_lines == 1 and got[153].n_words == 0
    long = got[texts.index(LONG)]
    assert long.n_words == 150_000 == long.n_repeat_words
    kept = quality.keep_good(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns and kept.count() == 0
    a = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(quality.ledger(docs(spark, texts))).collect()}
    assert a["few_words"][0] >= 156 and set(a) == set(quality.RULES)
    with pytest.raises(ValueError):
        quality.ledger(docs(spark, texts).withColumn("n_words", F.lit(1)), keep=("doc_id", "n_words"))


def test_repeats_with_colliding_keys(spark, monkeypatch):
    """Windows whose keys' hashes are equal don't hide each other, and texts may have more windows than a key numbers."""
    found = "a38983 b38983 c38983 a1007151 b1007151 c1007151 a38983 b38983 c38983"  # two keys of this text collide
    r = random.Random(3)
    texts = [found, *(" ".join(r.choice("abcde") for _ in range(r.randrange(3, 60))) for _ in range(60))]
    got = {x.doc_id: x.n_repeat_words for x in quality.ledger(docs(spark, texts)).collect()}
    assert got[0] == 6 == brute_repeats(found)
    monkeypatch.setattr(quality, "_window_hash", lambda a, b, c: F.length(a).cast("long") * 0)
    got = {x.doc_id: x.n_repeat_words for x in quality.ledger(docs(spark, texts)).collect()}
    assert got == {i: brute_repeats(t) for i, t in enumerate(texts)}
    monkeypatch.undo()
    monkeypatch.setattr(quality, "AT", 4)
    got = {x.doc_id: x.n_repeat_words for x in quality.ledger(docs(spark, texts)).collect()}
    assert got == {i: brute_repeats(t) for i, t in enumerate(texts)}
    assert quality.ledger(docs(spark, texts).where("false")).count() == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def test_pii_spans_against_plain_patterns(spark):
    r = random.Random(3)
    parts = ["a", "b.", "@", "c", "-", "1", "23", "."," ", "+", "(555)", "4111111111111111", "4111-1111 1111 1111", "10.0.0.1", "256.1.1.1", "é", "🙂", "x@y.z", "\n", "+1 (389) 555-5010", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)] + ["1" * 30_000, "a" * 30_000, "1." * 9000, "+1" + " " * 30_000, None, ""]
    got = {x.doc_id: x.b for x in pii.find(docs(spark, texts)).select("doc_id", pii.span_text(F.col("base")).alias("b")).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(PII) for m in re.finditer(p, t or "") if ok(m[0]))
        assert got[i] == ",".join(f"{n}:{s}:{e}" for s, k, e, n in spans)


def test_pii_model_on_other_texts(spark):
    """Precision and recall of the added spans on labelled texts that were neither fitted nor calibrated on."""
    d = pii.labelled_texts(spark, 3000, seed=99)
    got = pii.find(d, "text", ("generator", "y")).selectExpr("generator", "y", "size(more) > 0 OR size(base) > 0 AS hit").groupBy("generator").agg(
        F.sum(F.when(F.col("hit") & (F.col("y") == 1), 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("hit"), 1).otherwise(0)).alias("p"), F.sum("y").alias("y")
    ).collect()
    print([(pii.GENERATORS[r.generator][0], round(r.tp / r.p, 3), round(r.tp / r.y, 3)) for r in got])
    assert len(got) == len(pii.GENERATORS)
    assert sum(r.tp for r in got) / sum(r.p for r in got) >= 0.95 and sum(r.tp for r in got) / sum(r.y for r in got) >= 0.75
    trees, cut = pii.model()
    assert all(c < 1e9 for c in cut.values())
    rows = pii.labelled_rows(spark, 400, seed=5)
    scored = pii.candidates(pii.labelled_texts(spark, 400, 5), "text", ("y",)).select("y", F.explode("cand").alias("c"))
    have = sorted(round(r[0], 9) for r in scored.select(pii.score(F.col("c"))).collect())
    assert have == sorted(round(pii.value(trees, r), 9) for r, _ in rows)  # the plan's conditions are the trees


def test_pii_overlaps_and_edges(spark):
    one = lambda rows: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).alias("s")) for a, b, s in rows])
    got = spark.range(1).select(pii._best(one([(0, 5, 1.0), (3, 9, 2.0), (8, 12, 1.5), (12, 14, 0.1)]))).first()[0]
    assert [(x.start, x.end) for x in got] == [(3, 9), (12, 14)]
    base = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(0).alias("kind"), F.lit(b).alias("end")) for a, b in [(0, 40), (5, 7), (60, 61)]])
    got = spark.range(1).select(pii._clear(one([(8, 10, 1.0), (40, 42, 1.0), (58, 62, 1.0), (61, 63, 1.0), (59, 60, 1.0)]), base)).first()[0]
    assert [(x.start, x.end) for x in got] == [(40, 42), (59, 60), (61, 63)]
    assert pii.find(docs(spark, ODD).where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a@b.cc", 1, 2)] * 2 + [(3, "ssn 123-45-6789", 1, 2)], "doc_id long, text string, t int, `a.b` int")
    assert sorted((r.doc_id or 0, r.text) for r in pii.redact(odd).collect()) == [(0, "<EMAIL>")] * 2 + [(3, "ssn <OTHER>")]
    assert pii.redact(odd).columns == odd.columns
    book = "\n".join(f"+1 (389) 555-{i:04d} ssn {i % 900 + 100}-{i % 90 + 10}-{i % 9000 + 1000}" for i in range(5000))
    r = pii.find(docs(spark, [book])).selectExpr("size(base) AS b", "size(more) AS m").first()
    assert (r.b, r.m) == (5000, 5000)


def test_pii_masks(spark):
    rows = docs(spark, ["mail joe@x.com or call +1 (389) 555-5010; ssn: 123-45-6789.", None, "plain 123-45-6789 part", ""])
    got = {r.doc_id: r for r in pii.redact(rows).collect()}
    assert got[0].text == "mail <EMAIL> or call <PHONE>; ssn: <OTHER>." and got[0].n_chars == len(got[0].text)
    assert (got[1].text, got[2].text, got[3].text) == (None, "plain 123-45-6789 part", "") and pii.redact(rows).columns == rows.columns


def brute_lines(texts, least):
    same, seen, out = set(), collections.defaultdict(set), []
    for t in texts:
        keep = []
        for x in (t or "").split("\n"):
            w = tuple(re.findall(r"[^\x20\x09-\x0d]+", x))
            if w:
                gone = w in same or len(w) >= least and any(near(w, s) for k in (-1, 0, 1) for s in seen[len(w) + k])
                same.add(w)
                if len(w) >= least:
                    seen[len(w)].add(w)
                if gone:
                    continue
            keep.append(x)
        out.append(None if t is None else "\n".join(keep))
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup_against_all_pairs(spark, scratch):
    r = random.Random(8)
    base = [[r.choice("abcdefgh") for _ in range(r.randint(4, 6))] for _ in range(25)]

    def line():
        w = list(r.choice(base))
        for _ in range(r.randrange(3)):
            i, k = r.randrange(len(w)), r.randrange(3)
            w[i : i + 1] = [r.choice("xyz")] if k == 0 else [] if k == 1 else [w[i], "q"]
        return r.choice((" ", "  ")).join(w[: r.choice((2, 9, 9, 9))]) + r.choice(("", " "))

    texts = ["\n".join(line() for _ in range(r.randrange(5))) for _ in range(80)] + [None, ""]
    d = docs(spark, texts)
    got = {x.doc_id: x.text for x in lines.dedup_lines(d, scratch, near_words=4).collect()}
    assert got == dict(enumerate(brute_lines(texts, 4)))
    assert lines.dedup_lines(d, scratch).columns == d.columns
    assert lines.dedup_lines(d.where("false"), scratch).count() == 0
    same_rows = lines.dedup_lines(docs(spark, ["a b c d e f g h"] * 2, [None, 1]), scratch).collect()
    assert {x.text for x in same_rows} == {"a b c d e f g h"}
    odd = d.withColumn("gone", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("line_no", F.lit(3))
    got = lines.dedup_lines(odd, scratch, near_words=4)
    assert got.columns == odd.columns and {x.doc_id: x.text for x in got.collect()} == dict(enumerate(brute_lines(texts, 4)))
    other = docs(spark, ["x y\nz", "x y\nz", "z\nx y"], [1, 1, 1])  # an id that repeats, with another text
    assert sorted(x.text for x in lines.dedup_lines(other, scratch).collect()) == ["x y", "x y", "z"]


def test_lines_get_only_the_kinds_of_keys_that_can_meet(spark, scratch, monkeypatch):
    """Lines that share a half with lines of as many words alone get no keys for insertions, and the other way round."""
    kinds, real = [], lines.variants

    def counted(of):
        got = real(of)
        kinds.append({r.t for r in got.select("t").distinct().collect()})
        return got

    monkeypatch.setattr(lines, "variants", counted)
    for texts in (["a b c d e f g h", "a b c d e f g x", "a b c d q r s t"], ["a b c d e f g h", "a b c d e f g h i"], ["a b c d e f g h", "a b c d x f g h", "a b c d e f g h i"]):
        got = {x.doc_id: x.text for x in lines.dedup_lines(docs(spark, texts), scratch).collect()}
        assert [got[i] for i in range(len(texts))] == brute_lines(texts, 8)
    assert kinds == [{lines.OPEN}, {lines.WHOLE, lines.SHORT}, {lines.WHOLE, lines.SHORT, lines.OPEN}]


def test_short_lines_and_lines_without_blanks(spark, scratch):
    texts = ["menu\n\n道路の状態を調べる調査の記録です\nkeep", "keep\n \nmenu", "道路の状態を調べる調査の記録です\n\nnew", "道路の状態を調べる調査の記録"]
    got = {x.doc_id: x.text for x in lines.dedup_lines(docs(spark, texts), scratch).collect()}
    assert got == dict(enumerate(brute_lines(texts, 8))) and got[1] == " " and got[2] == "\nnew" and got[3] == texts[3]


def test_long_lines_and_many_lines(spark, scratch):
    """A line of 100,000 words against one that differs in one word, and a text of 30,000 lines that all stand earlier."""
    w = [f"w{i % 977}" for i in range(100_000)]
    many = "\n".join(f"line {i}" for i in range(30_000))
    texts = [" ".join(w), " ".join([*w[:70_000], "other", *w[70_001:]]), " ".join([*w[:5], *w[6:]]), " ".join([*w[:5], "p", *w[6:70_000], "other", *w[70_001:]]), many, many]
    t = time.monotonic()
    got = {x.doc_id: x.text for x in lines.dedup_lines(docs(spark, texts), scratch).collect()}
    assert got == {0: texts[0], 1: "", 2: "", 3: "", 4: many, 5: ""}  # 3 is one word from 1, if two from 0
    assert time.monotonic() - t < 120


def test_queries_on_whole_tables(spark, data):
    import pyarrow.parquet as pq

    n = pq.read_table(f"{data}/documents.parquet").num_rows
    for name in ("op1_simhash_near_dedup", "op5_sentencepiece", "op6_secret_scan", "op7_token_store", "op9_pii"):
        assert queries.QUERIES[name](spark, data).count() == n


def test_digest_columns(spark, data):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    d = pq.read_table(f"{data}/documents.parquet").to_pandas().set_index("doc_id").text.sort_index()
    sp, tok = pieces.processor(), Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    a = queries.QUERIES["op5_sentencepiece"](spark, data).toPandas().set_index("doc_id").sort_index()
    ids = [sp.encode(t) + [2] for t in d]
    assert a.ids_sha256.tolist() == [hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for i in ids]
    assert a.decoded_sha256.tolist() == [hashlib.sha256(sp.decode(i).encode()).hexdigest() for i in ids]
    b = queries.QUERIES["op7_token_store"](spark, data).toPandas().set_index("doc_id").sort_index()
    ids = [tok.encode(t, add_special_tokens=False).ids + [2] for t in d]
    assert b.ids_crc32.tolist() == [zlib.crc32(np.array(i, dtype="<u4").tobytes()) for i in ids]
    f = queries.QUERIES["op1_simhash_near_dedup"](spark, data).toPandas().set_index("doc_id").sort_index()
    assert f.fingerprint.tolist() == [f"{simhash.fingerprint(t.encode()):016x}" for t in d]
