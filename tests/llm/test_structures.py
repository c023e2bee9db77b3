"""Conversation repair, nearest neighbours and the Merkle manifest against plain versions, with odd tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import ann, common, merkle, repair


@pytest.fixture()
def scratch(spark):
    s = common.Scratch(spark, "test")
    yield s
    s.clear()


# Conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(turns):
    """turns of one conversation in order -> the row without conv_id; up to three insertions at any place are tried."""
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.strip(repair.BLANKS)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    nxt = {"n": "su", "s": "u", "u": "a", "a": "u"}
    best = {"n": (0, "", ())}

    def inserted(at):
        for _ in range(3):
            for s, (c, a, out) in list(at.items()):
                for r in "ua":
                    if r in nxt[s]:
                        new = (c + 5, a + "I", (*out, f"{repair.ROLES[r]}:"))
                        if r not in at or new[:2] < at[r][:2]:
                            at[r] = new
        return at

    for (_, role, text), fault in zip(turns, faults, strict=True):
        new = {}

        def offer(state, way, new=new):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        for s, (c, a, out) in inserted(dict(best)).items():
            offer(s, (c + 2, a + "D", out))
            if fault in ("b", "d"):
                continue
            more = 5 * (fault == "t")
            if role[:1] and role[0] in nxt[s]:
                offer(role[0], (c + more, a + "K", (*out, f"{role}:{text}")))
            for r in "ua":
                if r in nxt[s]:
                    offer(r, (c + 1 + more, a + "R", (*out, f"{repair.ROLES[r]}:{text}")))
        best = new
    cost, audit, out = min(v for s, v in inserted(dict(best)).items() if s in "na")
    known = [t for t, *_ in turns if t is not None]
    first = [r[:1] for _, r, _ in turns]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in "bdt"),
        sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(first)), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def plain_conversations(rows):
    by = {r[0]: [] for r in rows}
    for conv, *r in plain_damage(rows):
        by[conv].append(tuple(r))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        out.append((conv, *plain_repair(turns)) if turns else (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()))
    return out


def conversations(seed):
    r = random.Random(seed)
    role = lambda: r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "sys"])
    text = lambda: r.choice(["Yes.", "No", "", " \n", None, "é 🙂!", "Why?\n", "x" * r.randrange(1, 9) + r.choice(".!? a"), "Yes."])
    rows = [(c, t if r.random() < 0.95 else None, role(), text()) for c in [*range(40), None] for t in range(r.randrange(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2] if r.random() < 0.9 else role(), f"{t} {text()}" if r.random() < 0.9 else text()) for t in range(300)]  # one holds most rows
    rows += [(101, 5, "user", "Same.")] * 40 + [(102, None, None, None)] * 3 + [(103, 1, "assistant", "long word " * 20_000)]
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, g string, seg int, at int, `odd col` int"


@pytest.mark.parametrize("segment", [3, 64])
def test_repair_against_plain(spark, scratch, segment, monkeypatch):
    rows = conversations(segment)
    table = spark.createDataFrame([(*r, "g", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(repair.repair, "__defaults__", (segment, False))
    got = sorted(map(tuple, repair.repaired(table, repair.damaged(table), scratch).collect()), key=repr)
    assert got == sorted(plain_conversations(rows), key=repr)


def test_repaired_texts(spark, scratch):
    rows = conversations(1)
    table = spark.createDataFrame([(*r, "g", 1, 2, 3) for r in rows], SCHEMA)
    turns = repair.repair(repair.damaged(table), scratch, 4, texts=True).orderBy("g", "seg", "place").collect()
    want = {repr(c): d for c, *_, d in plain_conversations(rows)}
    by = {}
    for t in turns:
        by.setdefault(t.g, []).append(f"{t.role}:{t.text}")
    for conv in {r[0] for r in rows}:
        g = "" if conv is None else f"={conv}"
        assert hashlib.sha256("\n".join(by.get(g, [])).encode()).hexdigest() == want[repr(conv)]


def test_repair_of_nothing(spark, scratch):
    table = spark.createDataFrame([], SCHEMA)
    assert repair.repaired(table, repair.damaged(table), scratch).collect() == []
    dropped = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(*dropped, "user", "x.", "g", 1, 2, 3)], SCHEMA)
    assert [tuple(r) for r in repair.repaired(table, repair.damaged(table), scratch).collect()] == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# Nearest neighbours


def plain_nearest(rows, every, k):
    """[(query row number, [(id, score), ...])] over usable rows"""
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max((len(v) for _, v in ok), default=1)
    m = np.array([np.pad(v, (0, dim - len(v))) for _, v in ok]).reshape(-1, dim)
    ids = np.array([i for i, _ in ok], dtype=np.int64)
    out = []
    for n in np.flatnonzero(ids % every == 0):
        s = ann.exact(np.broadcast_to(m[n], m.shape), m)
        o = [x for x in np.lexsort((ids, -s)) if x != n][:k]
        out.append((int(ids[n]), [(int(ids[x]), float(s[x])) for x in o]))
    return out


def vectors(seed, n, dim, clusters):
    r = np.random.default_rng(seed)
    c = r.standard_normal((clusters, dim)) * 2
    m = r.standard_normal((n, dim)) + c[r.integers(0, clusters, n)]
    return [(i, (v * r.uniform(0.2, 3)).tolist()) for i, v in enumerate(m)]


SHAPE = "vec_id long, embedding array<double>, row int, score double, `odd col` int"


@pytest.mark.parametrize("dim,clusters", [(32, 1), (16, 12), (3, 1)])
def test_nearest_recall(spark, scratch, dim, clusters, monkeypatch):
    monkeypatch.setattr(ann, "PER_CENTRE", 200)
    rows = vectors(dim, 2400, dim, clusters)
    table = spark.createDataFrame([(*r, 1, 0.5, 2) for r in rows], SHAPE).repartition(3)
    got = {}
    for x in ann.nearest(table, scratch, queries=50).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    want, hit, n = plain_nearest(rows, 20, 20), 0, 0
    assert {q for q, _ in want} == set(got)
    exact = {(q, i): s for q, best in want for i, s in best}
    for q, best in want:
        found = [got[q][i + 1] for i in range(20)]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(exact.get((q, i), s) == s for i, s in found)
        hit, n = hit + len({i for i, _ in found} & {i for i, _ in best}), n + 20
    assert hit / n >= 0.99


def test_nearest_odd_rows(spark, scratch):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (20, [3.0]), (20, [3.0]), (20, [0.0, -1.0]), (8, [1.0, 2.0, 4.0])]
    table = spark.createDataFrame([(*r, 1, 0.5, 2) for r in rows], SHAPE).repartition(2)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in ann.nearest(table, scratch).collect())
    assert got == sorted((q, i + 1, v, s) for q, best in plain_nearest(rows, 20, 20) for i, (v, s) in enumerate(best))
    assert ann.nearest(table.where("false"), scratch).collect() == []


def test_estimates_within_bounds():
    """Without bias, and beyond the bound about as rarely as a normal error."""
    r = np.random.default_rng(3)
    x, q, dim = r.standard_normal((4000, 64)), r.standard_normal((50, 64)), 64
    turn, c = ann.rotation(dim), np.zeros((1, dim))
    _, bits, length, fit = ann.encode(x, c, turn)
    guess, wide = ann.estimate(q, q @ turn, c[0], bits, length, fit, bound=2.0)
    error = guess - q @ x.T
    assert abs(error.mean()) < 0.02 and (np.abs(error) > wide).mean() < 0.06


# Merkle manifest


def plain_tree(digests):
    """(root, [path of each leaf as a list of (left, right)])"""
    paths, place, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(place):
            run = level[p - p % 3 : p - p % 3 + 3]
            paths[i].append((run[: p % 3], run[p % 3 + 1 :]))
        level, place = [merkle.digest(*level[i : i + 3]) for i in range(0, len(level), 3)], [p // 3 for p in place]
    return level[0], paths


def plain_manifest(rows):
    def leaf(row):
        return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).hexdigest()

    by = {}
    for doc_id, text, lang, source, n in rows:
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        bare = text.replace("\n", "") if text is not None and even else text
        by.setdefault(source, []).append(((doc_id is not None, doc_id or 0), leaf((doc_id, source, lang, n, text)), doc_id, leaf((doc_id, source, lang, n, bare))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = [plain_tree([x[1] for x in sorted(by[s])]) for s in order]
    root, above = plain_tree([s for s, _ in subs])
    out = []
    for s, (sub, paths), up in zip(order, subs, above, strict=True):
        for (_, own, doc_id, bad), path in zip(sorted(by[s]), paths, strict=True):
            h = bad
            for lo, hi in path + up:
                h = merkle.digest(*lo, h, *hi)
            out.append((doc_id, own, sub, root, merkle.digest(*(d for lo, hi in path + up for d in (*lo, *hi))), h, h == root))
    return out


@pytest.mark.parametrize("span", [1, 2, 6])
def test_manifest_against_plain(spark, scratch, span):
    r = random.Random(span)
    text = lambda: r.choice(["a\nb", "", None, "é🙂\n", "plain", "\n\n", "long\n" * 30_000])
    rows = [(i if r.random() < 0.97 else None, text(), r.choice(["en", None, ""]), "hot" if i % 3 else r.choice(["a", "é", "", None, "z", "B"]), r.choice([1, None, -5])) for i in range(120)]
    rows += [(7, "twice\n", "en", "hot", 3)] * 5 + [(999, "a\nlone", "en", "only", 1), (None, None, None, None, None)]
    rows += [(2000 + i, "x\ny", "en", f"s{i}", 1) for i in range(31)]
    r.shuffle(rows)
    table = spark.createDataFrame([(*x, "g", 1, 2) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, pos int, `odd col` int").repartition(3)
    even = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    args = {"tampered": {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}, "when": even, "span": span}
    got = merkle.proofs(table, scratch, **args)
    assert got.columns == ["id", "leaf", "subroot", "proof_sha256", "folded_root", "root", "verified"]
    got = got.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_manifest(rows), key=repr)
    assert 0 < sum(x.verified for x in got) < len(got)
    whole = merkle.proofs(table, scratch, told=False, span=span).collect()
    leaf = {(x.g, x.pos): x.digest for x in merkle.placed(merkle.leaves(table), ["id", "digest"], scratch, "again").collect()}
    assert len(whole) == len(rows) and all(merkle.fold(leaf[x.g, x.pos], x.path) == x.root for x in whole)
    assert merkle.proofs(table.where("false"), scratch).collect() == []
