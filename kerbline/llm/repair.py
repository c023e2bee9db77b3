"""Repair of conversation structure: the cheapest edits that give every conversation a legal order of roles.

A turn becomes one symbol (its role's initial, and whether it is whole, truncated or must go), a conversation a row of
symbols, cut into segments of at most SEGMENT turns that lie side by side in a range sort. Hash-partitioned batches of
segments go through one recursive DuckDB query: each step advances one turn in all segments of the batch and keeps per
grammar state the minimum cost and its audit, from every state that a segment may start in. What a conversation of
several segments costs follows from their costs and the order of their audits alone, so a conversation of any length
streams through a task by its segments, never by its turns.
"""

from __future__ import annotations

import hashlib
from functools import cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Turns of a segment, and segments that one recursive query takes.
SEGMENT, BATCH = 64, 4096
BLANKS = " \t\n\x0b\x0c\r"
#: Grammar states: nothing yet, after system, after user, after assistant; what each accepts and where that leads.
NEXT = {"n": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
STATES = "nsua"
ROLES = {"u": "user", "a": "assistant"}
#: Costs of edits, and what a truncated turn adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Symbols of whole, truncated and forbidden turns of system, user, assistant and other roles.
WHOLE, CUT, GONE = "suao", "SUAO", "1234"


def _insertable(state: str) -> str:
    return next(r for r in "ua" if r in NEXT[state])


@cache
def moves() -> list[tuple[str, str, str, int, str]]:
    """(state, symbol, edits, cost, state after) for every way to pass one turn, with or without an insertion before.

    Two insertions in a row never pay: they lead from a state to itself, or past a turn that deletes for less.
    """
    out = []
    for state in STATES:
        put = _insertable(state)
        for before, cost, at in (("", 0, state), ("I", INSERT, NEXT[state][put])):
            for kind, symbols in enumerate(zip(WHOLE, CUT, GONE, strict=True)):
                for symbol, more in zip(symbols, (0, TRUNCATED, None), strict=True):
                    out.append((state, symbol, f"{before}D", cost + DELETE, at))
                    if more is None:
                        continue
                    if (to := NEXT[at].get(WHOLE[kind])) is not None:
                        out.append((state, symbol, f"{before}K", cost + more, to))
                    out += [(state, symbol, f"{before}R", cost + more + REROLE, NEXT[at][r]) for r in "ua" if r in NEXT[at]]
    return out


WALK = """
WITH RECURSIVE s AS (SELECT row_number() OVER () AS k, symbols, first FROM (SELECT DISTINCT symbols, first FROM batch)),
walk AS (
  SELECT k, state AS start, state, 0 AS i, 0 AS cost, '' AS audit FROM s, (VALUES ('n'), ('s'), ('u'), ('a')) t(state) WHERE state = 'n' OR NOT first
  UNION ALL
  SELECT k, start, state, i, best.cost AS cost, best.audit AS audit FROM (
    SELECT w.k, w.start, m.after AS state, w.i + 1 AS i, min({'cost': w.cost + m.cost, 'audit': w.audit || m.edits}) AS best
    FROM walk w JOIN s ON s.k = w.k JOIN moves m ON m.state = w.state AND m.symbol = s.symbols[w.i + 1]
    WHERE w.i < length(s.symbols) GROUP BY ALL)),
done AS (SELECT w.*, dense_rank() OVER (PARTITION BY w.k ORDER BY audit) AS place FROM walk w JOIN s ON s.k = w.k WHERE w.i = length(s.symbols)),
each AS (SELECT k, list({'start': start, 'after': state, 'cost': cost, 'place': CAST(place AS INTEGER), 'audit': audit}) AS ways FROM done GROUP BY k)
SELECT b.g, b.seg, b.symbols, each.ways FROM batch b JOIN s ON s.symbols = b.symbols AND s.first = b.first JOIN each ON each.k = s.k
"""
WAYS = "array<struct<start:string,after:string,cost:int,place:int,audit:string>>"


def _walked(batches):
    import duckdb
    import pyarrow as pa

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    con.execute("CREATE TABLE moves (state VARCHAR, symbol VARCHAR, edits VARCHAR, cost INTEGER, after VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            con.register("batch", pa.Table.from_batches([b.slice(at, BATCH)]))
            got = con.sql(WALK).to_arrow_table()
            con.unregister("batch")
            yield from got.to_batches()


def _chosen(batches):
    """Segments sorted by conversation: which way each goes in the cheapest repair of the whole. Of a conversation no
    more is held than a few small numbers per segment."""
    import pyarrow as pa

    kinds = dict(zip(WHOLE + CUT + GONE, WHOLE * 3, strict=True))
    names = ["g", "seg", "start", "after", "tail", "alone", "cost", "illegal"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]

    def ended(g, segs, state):
        ways = [(c, p, s, "") for s, (c, p) in state.items() if s in "na"]
        ways += [(c + INSERT, p, s, "I") for s, (c, p) in state.items() if s == "u"]
        cost, _, at, tail = min(ways)
        out, path = [], at
        for k in range(len(segs) - 1, -1, -1):
            seg, back, _ = segs[k]
            out.append((g, seg, back[path], path, tail if k == len(segs) - 1 else "", len(segs) == 1, cost if k == 0 else None, sum(x[2] for x in segs) if k == 0 else None))
            path = back[path]
        return out[::-1]

    def rows():
        g, segs, state, last = None, [], None, ""
        for b in batches:
            for key, seg, symbols, ways in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != g and segs:
                    yield from ended(g, segs, state)
                if key != g or not segs:
                    g, segs, state, last = key, [], {"n": (0, 0)}, ""
                new, back = {}, {}
                for w in ways:
                    if w["start"] in state:
                        c, p = state[w["start"]]
                        if (way := (c + w["cost"], p, w["place"])) < new.get(w["after"], (float("inf"),)):
                            new[w["after"]], back[w["after"]] = way, w["start"]
                order = {x: i for i, x in enumerate(sorted({way[1:] for way in new.values()}))}  # the order of the audits so far
                state = {s: (way[0], order[way[1:]]) for s, way in new.items()}
                told = last + "".join(kinds[c] for c in symbols)
                segs.append((seg, back, sum(told[i : i + 2] not in ("su", "ua", "au") for i in range(len(told) - 1))))
                last = told[-1]
        if segs:
            yield from ended(g, segs, state)

    held = []
    for r in rows():
        held.append(r)
        if len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def replay(start: str, audit: str, turns):
    """(edit, role, text) of what a segment's turns become; turns yields (role, text)."""
    state, turns = start, iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        letter = role[:1] if edit == "K" else _insertable(state)
        yield edit, role if edit == "K" else ROLES[letter], text
        state = NEXT[state][letter]


def _segments(batches):
    """Rows sorted by (g, seg, at), the first of a segment its head: (g, seg, head, generator of its (role, text))."""
    import itertools

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for (g, seg), run in itertools.groupby(rows, key=lambda r: r[:2]):
        head = next(run)
        yield g, seg, head, ((r[6], r[7]) for r in run)


def _turns(batches):
    import pyarrow as pa

    names, types = ["g", "seg", "place", "edit", "role", "text"], [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
    held, size = [], 0
    for g, seg, head, turns in _segments(batches):
        for i, (edit, role, text) in enumerate(replay(head[3], head[4], turns)):
            held.append((g, seg, i, edit, role, text))
            size += len(text)
            if len(held) >= 4096 or size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _digests(batches):
    """Conversations of one segment leave with their digest, others with the lines of their segments, a few at a time."""
    import pyarrow as pa

    names = ["g", "seg", "piece", "audit", "digest", "lines"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.binary()]
    held, size = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for g, seg, head, turns in _segments(batches):
        h, first, lines, many, piece, alone = hashlib.sha256(), True, [], 0, 0, head[5]
        for _, role, text in replay(head[3], head[4], turns):
            line = f"{role}:{text}".encode("utf-8", "surrogatepass")
            if alone:
                h.update(line if first else b"\n" + line)
                first = False
                continue
            lines.append(line)
            many += len(line)
            if many > 1 << 20:
                held.append((g, seg, piece, head[4] if piece == 0 else "", None, b"\n".join(lines)))
                size, lines, many, piece = size + many, [], 0, piece + 1
                if size > 4 << 20:
                    yield flush()
                    held, size = [], 0
        if alone:
            held.append((g, seg, 0, head[4], h.hexdigest(), None))
        elif lines or piece == 0:
            held.append((g, seg, piece, head[4] if piece == 0 else "", None, b"\n".join(lines) if lines else None))
            size += many
        if len(held) >= 4096 or size > 4 << 20:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _joined(batches):
    """Pieces sorted by conversation: the digest of all its lines and its whole audit."""
    import itertools

    import pyarrow as pa

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for g, run in itertools.groupby(rows, key=lambda r: r[0]):
        h, first, audit = hashlib.sha256(), True, []
        for _, _, _, edits, _, lines in run:
            audit.append(edits)
            if lines is not None:
                h.update(lines if first else b"\n" + lines)
                first = False
        yield pa.RecordBatch.from_pydict({"g": [g], "audit": ["".join(audit)], "digest": [h.hexdigest()]})


def damaged(rows: DataFrame) -> DataFrame:
    """(g, conv_id, turn, role, text) as the contract damages them: by crc32(`conv_id:turn`) % 20 a turn is dropped (0),
    emptied (1), loses its full stops (2), comes twice (3) or gets the role user (4). Nulls of role and text, and of
    conv_id and turn inside the checksum, are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select(key(F.col("conv_id")).alias("g"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"))
    d = d.withColumn("h", (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20).cast("int")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    d = d.select("g", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy"))
    return d.drop("copy")


def key(conv: Column) -> Column:
    """A conversation's key, never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(turns: DataFrame, scratch: Scratch, segment: int = SEGMENT, texts: bool = False) -> DataFrame:
    """turns(g, turn, role, text), none null but turn -> per g: gaps, blank, duplicate, truncated, illegal, cost, audit
    and repaired_sha256; with texts the repaired turns instead: (g, seg, place, edit, role, text), in that order.

    A conversation's turns go by turn (null first), equal turns by role and text. A turn's first fault counts: blank
    (no character but blanks), duplicate (role and text seen before), truncated (ends in none of `.!?`). Blank and
    duplicate turns are deleted. Of the edits of least cost the audit that is least in ASCII order is taken. Roles of
    any initial, empty ones too, can be given another role. An empty table gives an empty table.
    """
    own = turns.select("g", "turn", "role", "text").withColumn("__own", F.monotonically_increasing_id())
    order = ["g", "turn", "role", "text", "__own"]
    rows = own.repartitionByRange(*order).sortWithinPartitions(*order).drop("__own").withColumn("at", F.monotonically_increasing_id())
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = scratch.save(rows.withColumn("blank", bare == "").withColumn("cut", ~F.right(bare, F.lit(1)).isin(".", "!", "?")).withColumn("same", same), "turns")
    # A turn is new where its place is the first of its role and text; places are unique, so no key of this join is hot.
    firsts = rows.where("not blank").groupBy("g", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    marks = rows.select("g", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "cut", "at").join(firsts, "at", "left")
    fault = F.when(F.col("blank"), "b").when(F.col("new").isNull(), "d").when(F.col("cut"), "t").otherwise("")
    kind = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.col("initial")), F.lit(0)), F.lit(4))
    kind = F.when(F.col("initial") == "", 4).otherwise(kind)
    marks = marks.select("g", "turn", "at", F.floor(F.col("at") / segment).cast("long").alias("seg"), fault.alias("fault"), kind.alias("kind"))
    row = F.when(F.col("fault").isin("b", "d"), F.lit(GONE)).when(F.col("fault") == "t", F.lit(CUT)).otherwise(F.lit(WHOLE))
    marks = scratch.save(marks.withColumn("symbol", F.substring(row, F.col("kind"), F.lit(1))), "marks")
    symbols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "")
    segs = scratch.save(marks.groupBy("g", "seg").agg(symbols.alias("symbols")), "segments")
    heads = segs.groupBy("g").agg(F.min("seg").alias("seg")).withColumn("first", F.lit(True))
    segs = segs.join(heads, ["g", "seg"], "left").select("g", "seg", "symbols", F.coalesce("first", F.lit(False)).alias("first"))
    walked = scratch.save(segs.repartition("g", "seg").mapInArrow(_walked, f"g string, seg long, symbols string, ways {WAYS}"), "walked")
    slim = walked.select("g", "seg", "symbols", F.transform("ways", lambda w: F.struct(w["start"].alias("start"), w["after"].alias("after"), w["cost"].alias("cost"), w["place"].alias("place"))).alias("ways"))
    chosen = slim.repartition("g").sortWithinPartitions("g", "seg").mapInArrow(_chosen, "g string, seg long, start string, after string, tail string, alone boolean, cost long, illegal long")
    chosen = scratch.save(chosen, "chosen")
    way = lambda w: (w["start"] == F.col("start")) & (w["after"] == F.col("after"))
    picked = chosen.join(walked.select("g", "seg", "ways"), ["g", "seg"]).select("g", "seg", F.lit(-1).cast("long").alias("at"), "start", F.concat(F.filter("ways", way)[0]["audit"], "tail").alias("audit"), "alone")
    picked = picked.select("*", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    none = lambda kind: F.lit(None).cast(kind)
    body = rows.select("g", F.floor(F.col("at") / segment).cast("long").alias("seg"), "at", none("string").alias("start"), none("string").alias("audit"), none("boolean").alias("alone"), "role", "text")
    both = picked.union(body).repartition("g", "seg").sortWithinPartitions("g", "seg", "at")
    if texts:
        return both.mapInArrow(_turns, "g string, seg long, place int, edit string, role string, text string")
    pieces = scratch.save(both.mapInArrow(_digests, "g string, seg long, piece int, audit string, digest string, lines binary"), "pieces")
    long = pieces.where("digest is null").repartition("g").sortWithinPartitions("g", "seg", "piece").mapInArrow(_joined, "g string, audit string, digest string")
    told = pieces.where("digest is not null").select("g", "audit", "digest").union(long).withColumnRenamed("digest", "repaired_sha256")
    count = lambda f: F.count(F.when(F.col("fault") == f, 1))
    turns_ = marks.groupBy("g", "turn").agg(count("b").alias("b"), count("d").alias("d"), count("t").alias("t"))  # a hot conversation is summed in parts
    stats = turns_.groupBy("g").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), F.sum("b").alias("blank"), F.sum("d").alias("duplicate"), F.sum("t").alias("truncated"))
    sums = chosen.where("cost is not null").select("g", "illegal", "cost")
    return stats.join(sums, "g").join(told, "g")


def repaired(conversations: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """repair() of turns with a row for every conv_id of conversations, null too; conversations without turns have
    zeros, an empty audit and the digest of nothing. Columns of conversations other than conv_id are not read."""
    ids = conversations.select(key(F.col("conv_id")).alias("g"), F.col("conv_id").cast("long").alias("conv_id")).distinct()
    got = ids.join(repair(turns, scratch), "g", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(rows, damaged(rows), Scratch(spark, "op11"))


OP11_SQL = """
WITH RECURSIVE c0 AS (SELECT i, i AS c1, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c1 % 2 = 1 THEN xor(3988292384, c1 // 2) ELSE c1 // 2 END, k + 1 FROM c0 WHERE k < 8),
ct AS (SELECT list(c1 ORDER BY i) AS m FROM c0 WHERE k = 8),
e AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, x: CAST(xor(m[xor(a, x) % 256 + 1], a // 256) AS BIGINT)), 4294967295) % 20 AS h FROM conversations, ct),
d AS (SELECT coalesce('=' || conv_id, '') AS g, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM e, range(2) t(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS nth,
  lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS prior FROM o),
t AS (SELECT g, i, turn, role, text, left(role, 1) AS a, prior, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
step(state, put, after) AS (VALUES ('n', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
w AS (
  SELECT g, CAST(0 AS BIGINT) AS i, 'n' AS state, 0 AS cost, '' AS audit FROM (SELECT DISTINCT g FROM t)
  UNION ALL
  SELECT g, i, state, b.cost, b.audit FROM (
    SELECT g, i, state, min({'cost': cost, 'audit': audit}) AS b FROM (
      SELECT t.g, t.i, p.cost + v.cost + CASE WHEN v.edit <> 'D' AND t.fault = 't' THEN 5 ELSE 0 END AS cost, p.audit || v.edit AS audit,
        CASE v.edit WHEN 'D' THEN p.state WHEN 'K' THEN t.a ELSE s.after END AS state
      FROM (SELECT g, i, state, cost, audit FROM w UNION ALL SELECT w.g, w.i, s.after, w.cost + 5, w.audit || 'I' FROM w JOIN step s ON s.state = w.state) p
      JOIN t ON t.g = p.g AND t.i = p.i + 1 JOIN step s ON s.state = p.state
      JOIN (VALUES ('K', 0), ('R', 1), ('D', 2)) v(edit, cost) ON v.edit = 'D' OR t.fault NOT IN ('b', 'd') AND (v.edit = 'R' OR t.a = s.put OR t.a = 's' AND p.state = 'n')) GROUP BY g, i, state)),
n AS (SELECT g, count(*) AS n FROM t GROUP BY g),
z AS (SELECT w.g, min({'cost': cost + CASE WHEN state = 'u' THEN 5 ELSE 0 END, 'audit': audit || CASE WHEN state = 'u' THEN 'I' ELSE '' END}) AS b
  FROM w JOIN n ON n.g = w.g AND n.n = w.i WHERE state <> 's' GROUP BY w.g),
x AS (SELECT g, k, b.audit[k] AS edit, length(replace(left(b.audit, k), 'I', '')) AS i FROM z, range(1, length(b.audit) + 1) r(k)),
y AS (SELECT x.g, k, edit, role, text, count(*) FILTER (edit <> 'I' AND left(role, 1) = 's' AND edit = 'K') OVER (PARTITION BY x.g) AS sys, row_number() OVER (PARTITION BY x.g ORDER BY k) AS nth
  FROM x JOIN t ON t.g = x.g AND t.i = greatest(x.i, 1) WHERE edit <> 'D'),
l AS (SELECT g, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS body FROM y GROUP BY g),
q AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND prior || a NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY g)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN q ON q.g = coalesce('=' || c.conv_id, '') LEFT JOIN z ON z.g = q.g LEFT JOIN l ON l.g = q.g
"""
