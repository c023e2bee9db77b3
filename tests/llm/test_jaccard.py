"""Near duplicates of the pipeline's stage against all pairs of shingle sets."""

import random

import corpus_pipeline
from kerbline.llm import jaccard, simhash


def brute(texts, width=5, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    low = list(range(len(texts)))
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    while True:
        now = list(low)
        for i, j in alike:
            now[i] = now[j] = min(now[i], now[j])
        if now == low:
            return low
        low = now


def copies(r, n):
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(60, 200))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.3:
            w = w[: int(len(w) * r.uniform(0.7, 1))]
        out.append(" ".join(w))
    return out + [None, "", "one two", "one  two", "one two three"]


def test_near_dedup_stage_against_all_pairs(spark, data):
    texts = copies(random.Random(4), 120)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    assert len(set(want)) > 12
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, d, data).collect()}
    assert got == {i for i, c in enumerate(want) if i == c}


def test_near_dedup_stage_links_by_simhash(spark, data, monkeypatch):
    """Without any band the stage still finds texts whose fingerprints are close, if they are alike, and no others."""
    r = random.Random(5)
    base = [[f"w{r.randrange(400)}" for _ in range(900)] for _ in range(8)]
    texts = [" ".join(w) for w in base] + [" ".join(w[:k] + ["new"] + w[k:]) for k, w in enumerate(base, 300)]
    texts += ["a b c d e", "a b c d e " * 9 + "f"]  # one shingle against several
    fps = [simhash.fingerprint(t.encode(), 5) for t in texts]
    close = [k for k in range(8) if (fps[k] ^ fps[k + 8]).bit_count() <= 4]
    assert len(close) >= 4
    real = jaccard._buckets
    monkeypatch.setattr(jaccard, "_buckets", lambda keyed, scratch, level: real(keyed if level < 0 else keyed.where("false"), scratch, level))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id for x in corpus_pipeline.near_dedup(spark, d, data).collect()}
    assert got == set(range(len(texts))) - {k + 8 for k in close}


def test_edges(spark, data):
    from kerbline.llm.common import Scratch

    text = " ".join(f"v{i}" for i in range(60))
    d = spark.createDataFrame([(None, text), (3, text), (3, "other words here"), (5, "other words here"), (7, text + " more")], "doc_id long, text string")
    got = sorted(((r.id, r.component_id) for r in jaccard.near_duplicates(d, Scratch(spark, "t")).collect()), key=str)
    assert got == [(3, 3), (3, 3), (5, 3), (7, 3), (None, 3)]
    assert jaccard.near_duplicates(d.where("false"), Scratch(spark, "t")).count() == 0


def test_crowded_buckets_get_finer_bands(spark, data, monkeypatch):
    """Texts that share most of one template, some of them alike and most not, with a crowd of two."""
    from kerbline.llm.common import Scratch

    monkeypatch.setattr(jaccard, "CROWD", 2)
    r = random.Random(6)
    template = [f"t{i}" for i in range(80)]
    texts = []
    for k in range(40):
        own = [f"o{k}_{i}" for i in range(r.choice((16, 20, 24)))]
        texts.append(" ".join(template + own))
        if k % 4 == 0:
            texts.append(" ".join(template + own[:-2] + ["z"]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.id: x.component_id for x in jaccard.near_duplicates(d, Scratch(spark, "t")).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_sketches_part_texts_that_are_not_alike():
    """Differing bits of sets just as alike as asked for stay within the bound, small sets too; of half-alike sets few do."""
    import numpy as np

    r = np.random.default_rng(8)
    assert 150 <= (most := jaccard.most_bits(0.8)) <= 170
    both = lambda same, own: [np.unique(np.concatenate([x, y])) for x in [r.integers(0, 1 << 63, same, dtype=np.uint64)] for y in r.integers(0, 1 << 63, (2, own), dtype=np.uint64)]
    bits = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(jaccard.sketch(a), jaccard.sketch(b)))
    for same, own in ((8, 1), (80, 10), (800, 100)):
        assert max(bits(*both(same, own)) for _ in range(300)) <= most
    assert sum(bits(*both(100, 50)) <= most for _ in range(300)) <= 15
    a = r.integers(0, 1 << 63, 5, dtype=np.uint64)
    assert bits(a, a) == 0 and jaccard.sketch(a[:0]) == [0] * 16


def test_texts_around_one_passage_give_few_pairs(spark, data, monkeypatch):
    """2,000 texts share a passage of 200 words and have 65 of their own, no two alike: two million pairs meet in
    buckets, next to none becomes a row."""
    from kerbline.llm.common import Scratch

    r, rows = random.Random(9), []
    passage = [f"p{i}" for i in range(200)]
    texts = [" ".join(passage + [f"o{k}_{r.randrange(10**6)}" for _ in range(65)]) for k in range(2000)]
    texts += [t + " and more" for t in texts[:5]]
    real = jaccard.verified

    def counted(pairs, *args):
        rows.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(jaccard, "verified", counted)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.id: x.component_id for x in jaccard.near_duplicates(d, Scratch(spark, "t")).collect()}
    assert [got[i] for i in range(len(texts))] == [*range(2000), *range(5)]
    assert sum(rows[1::2]) < 2000 and sum(rows) < 60_000


def test_tiles_find_the_same_pairs(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, (6, 120), dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k % 6][r.random(120) < 0.96], r.integers(0, 1 << 63, 4, dtype=np.uint64)])) for k in range(60)]
    rows = [(0, 7, k, len(s), k, 60, jaccard.sketch(s)) for k, s in enumerate(sets)] + [(1, 7, 900 + k, 9, 5, 2, [k] * (jaccard.SKETCH // 64)) for k in range(2)]
    d = spark.createDataFrame(rows, "c int, key long, name long, n long, part long, m long, bits array<long>")
    whole = {tuple(x) for x in jaccard.close_pairs(d, 0.8).collect()}
    monkeypatch.setattr(jaccard, "TILE", 7)
    assert {tuple(x) for x in jaccard.close_pairs(d, 0.8).collect()} == whole
    alike = {(i, j) for j in range(60) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert alike and alike <= whole
