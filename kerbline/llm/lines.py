"""Line dedup across a corpus: equal lines and lines within one word, by deletion neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, counted_join, fence, let, running, spread_join
from .quality import BLANK, BLANKS, words

#: Lines of fewer words go only as equal copies: one word in fewer than eight is another line.
NEAR_WORDS = 8


def normal(line: Column) -> Column:
    """Words joined by single spaces."""
    t = F.btrim(line, F.lit(BLANKS))
    odd = F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")) | F.contains(t, F.lit("\r")) | F.contains(t, F.lit("\x0b")) | F.contains(t, F.lit("\x0c"))
    return F.when(odd, F.regexp_replace(t, BLANK, " ")).otherwise(t)


def _hashes(s: Column) -> list[Column]:
    """Two 64-bit hashes under different seeds; together they name a line."""
    return [F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2")]


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, s, n) of the lines that aren't blank."""
    key = F.col(f"`{id_col}`")
    d = docs.where(key.isNotNull()).select(key.cast("long").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("line_no", "line"))
    d = d.where(F.btrim("line", F.lit(BLANKS)) != "").select("doc_id", "line_no", normal(F.col("line")).alias("s"))
    return d.select("*", (F.octet_length("s") - F.octet_length(F.replace("s", F.lit(" "), F.lit(""))) + 1).alias("n"))


def dense(values: Column, kind: str) -> Column:
    """Structs of an array (line_no, v), one per line_no, as an array that holds v at its line_no and null elsewhere."""

    def spread(x: Column, i: Column, of: Column) -> Column:
        gap = x["line_no"] - F.coalesce(F.get(of, i - 1)["line_no"], F.lit(-1)) - 1
        return F.concat(F.array_repeat(F.lit(None).cast(kind), gap), F.array(x["v"]))

    return let(F.sort_array(values), lambda of: F.flatten(F.transform(of, lambda x, i: spread(x, i, of))))


def _halves(s: Column, n: Column) -> Column:
    """Keys of which two lines within one word of each other share at least one.

    Let t be the shorter line's words and k = t div 2. If the change stands at word k or later the first k words are
    equal, else the last k are. A line of n words meets partners with t = n and t = n - 1. The lowest bit of a key
    tells first (0) from last (1).
    """
    side = lambda k: F.call_function("substring_index", s, F.lit(" "), k)

    def pair(k: Column) -> list[Column]:
        first = F.xxhash64(F.lit("p"), k, side(k)).bitwiseAND(F.lit(-2))
        last = F.xxhash64(F.lit("s"), k, side(-k)).bitwiseOR(F.lit(1))
        return [first, last]

    k, j = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.array_compact(F.array(*pair(k), *[F.when(k != j, c) for c in pair(j)]))


#: Kinds of variants: the whole line, the line without a word, the line with a word left open.
WHOLE, SHORT, OPEN = 0, 1, 2


#: Words up to which a fold that appends is the cheaper way to running hashes.
FOLD = 96


def _chain(w: Column, n: Column, seed: str) -> Column:
    """Two 64-bit hashes each of the first 0, 1, 2, .. words. A word's hash names its place, and the hash of a prefix
    is that of its words in exclusive or. Long lines build them by doubling, in n log n steps; a fold copies what it
    has for every word, which only pays for short ones. Both give the same."""
    none = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    each = F.transform(w, lambda x, i: F.struct(F.xxhash64(F.lit(seed), i, x).alias("a"), F.xxhash64(x, i, F.lit(seed)).alias("b")))
    both = lambda x, y: F.struct(x["a"].bitwiseXOR(y["a"]).alias("a"), x["b"].bitwiseXOR(y["b"]).alias("b"))
    fold = F.aggregate(each, none, lambda acc, x: F.array_append(acc, both(F.element_at(acc, -1), x)))
    return F.when(n <= FOLD, fold).otherwise(running(F.concat(none, each), lambda x, y: F.when(y.isNull(), x).otherwise(both(x, y))))


def variants(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, t, k1, k2): the deletion neighbourhood of bound one of lines(doc_id, line_no, n, lo, hi, p, r,
    up, down, even), p and r the hashes of their first and last words. A line without possible partners of one word
    more (up), one less (down) or as many (even) gets no keys by which only those could meet it.

    The line without word i is named by i and the hashes of what stands before and after. It equals a shorter line's
    key at split i if that line is what is left (an insertion), and, under another seed, the key of a line that
    differs in word i alone (a substitution). Words outside lo..hi are known to be equal in every partner. A key is
    two independent 64-bit hashes of the words left, so keys of different variants are not equal by chance.
    """
    n = F.col("n")
    place = lambda i: F.struct(i.alias("i"), F.get("p", i).alias("x"), F.get("r", n - 1 - i).alias("y"), F.get("r", n - i).alias("z"))
    kinds = ["up", "down", "even"]
    each = lines.select("doc_id", "line_no", "n", *kinds, F.explode(F.transform(F.sequence("lo", "hi"), place)).alias("at")).select("doc_id", "line_no", "n", *kinds, "at.*")
    one = lambda t, seed, size, rest: F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(seed), "i", size, "x.a", f"{rest}.a").alias("k1"), F.col("x.b").bitwiseXOR(F.col(f"{rest}.b")).alias("k2"))
    inner = F.col("y").isNotNull()
    keys = F.array(F.when(F.col("up"), one(WHOLE, "d", n, "z")), F.when(inner & F.col("down"), one(SHORT, "d", n - 1, "y")), F.when(inner & F.col("even"), one(OPEN, "s", n, "y")))
    return each.select("doc_id", "line_no", F.explode(F.array_compact(keys)).alias("v")).select("doc_id", "line_no", "v.*")


def _common(a: str, b: str) -> str:
    """SQL: how many words two arrays share from the start."""
    same = f"array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false)"
    return f"if({same} = 0, least(size({a}), size({b})), {same} - 1)"


def within_one(a: str = "a", b: str = "b") -> Column:
    """Whether word arrays differ by at most one inserted, deleted or replaced word: what they share from both ends
    leaves no more than that. One pass from each end."""
    shared = f"({_common(a, b)} + {_common(f'reverse({a})', f'reverse({b})')})"
    return F.expr(f"abs(size({a}) - size({b})) <= 1 and {shared} >= greatest(size({a}), size({b})) - 1")


def near_bounds(distinct: DataFrame, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, near_words: int) -> DataFrame:
    """(h1, h2, bound): for lines with another within one word, the first place of the earliest such line.

    Only lines that share a half with another one get their deletion neighbourhood, and of that only the kinds that
    lines with such a half have the number of words for, which loses none. A bucket of equal variants links each member to the bucket's earliest, never all pairs, and a large bucket is dealt over tasks.
    """
    keyed = scratch.save(distinct.select("first", "words", F.explode("halves").alias("key")), "halves")
    shared = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("words").alias("low"), F.max("words").alias("high")).where("n > 1"), "shared")
    side = F.col("key").bitwiseAND(F.lit(1)) == 0
    total = shared.agg(F.sum("n")).first()[0] or 0
    kinds = {"head": side, "tail": ~side, "up": F.expr("high > words"), "down": F.expr("low < words"), "even": F.expr("low = high or n > 2")}
    likely = spread_join(keyed, shared, ["key"], shared.select("key", "n"), total).groupBy("first").agg(*[F.bool_or(c).alias(k) for k, c in kinds.items()])
    flags = f"struct<{','.join(f'{k}:boolean' for k in kinds)}>"
    at = likely.groupBy("first.doc_id").agg(dense(F.collect_list(F.struct("first.line_no", F.struct(*kinds).alias("v"))), flags).alias("at"))
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t")).join(at, "doc_id")
    lines = text.select("doc_id", "at", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", F.get("at", F.col("line_no")).alias("at"), "line").where("at is not null")
    lines = fence(lines.select("doc_id", "line_no", "at", words(F.col("line")).alias("w"))).where(F.size("w") >= near_words)
    lines = scratch.save(lines.groupBy("doc_id", "line_no").agg(F.first("at").alias("at"), F.min("w").alias("w")), "lines")
    scratch.drop("halves")
    n = F.size("w")
    k = F.floor((n - 1) / 2).cast("int")
    v = lines.select("doc_id", "line_no", n.alias("n"), "at.up", "at.down", "at.even", F.when(~F.col("at.tail"), k).otherwise(0).alias("lo"), F.when(~F.col("at.head"), n - k).otherwise(n).alias("hi"), _chain(F.col("w"), n, "p").alias("p"), _chain(F.reverse("w"), n, "r").alias("r"))
    v = scratch.save(variants(v), "variants")
    me, whole = F.struct("doc_id", "line_no"), F.col("t") == WHOLE
    low = v.groupBy("k1", "k2").agg(F.min(F.when(whole, me)).alias("whole"), F.min(F.when(~whole, me)).alias("short"), F.count("*").alias("n")).where("n > 1")
    low = scratch.save(low, "low")
    other = F.when(F.col("t") == SHORT, F.col("whole")).otherwise(F.col("short"))
    total = low.agg(F.sum("n")).first()[0] or 0
    pairs = spread_join(v, low.drop("n"), ["k1", "k2"], low.select("k1", "k2", "n"), total).select("doc_id", "line_no", other.alias("o")).where(F.col("o").isNotNull() & (F.col("o") < me))
    pairs = scratch.save(pairs.select("doc_id", "line_no", F.col("o.doc_id").alias("doc_b"), F.col("o.line_no").alias("line_b")).distinct(), "pairs")
    scratch.drop("variants")
    scratch.drop("low")
    a = lines.select("doc_id", "line_no", F.col("w").alias("a"))
    b = lines.select(F.col("doc_id").alias("doc_b"), F.col("line_no").alias("line_b"), F.col("w").alias("b"))
    met = counted_join(pairs.join(a, ["doc_id", "line_no"]), b, ["doc_b", "line_b"], scratch, "met", pairs)
    found = met.where(within_one()).groupBy(me.alias("first")).agg(F.min(F.struct(F.col("doc_b").alias("doc_id"), F.col("line_b").alias("line_no"))).alias("bound"))
    return distinct.select("h1", "h2", "first").join(found, "first").select("h1", "h2", "bound")


def dedup_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS, counts: bool = False) -> DataFrame:
    """docs with repeated lines taken out of the texts; with counts also n_lines and n_removed (long).

    A line that isn't blank goes if an equal line stands earlier in the corpus, in order of id and line number, or,
    from near_words words on, one within one inserted, deleted or replaced word; blanks between words don't count.
    The earliest stays. All other lines, and texts without a removed line, stay as they are to the byte; a text whose
    lines all go becomes empty. Null texts stay null, rows with null ids take no part. Rows that repeat an id and
    text are treated alike. n_chars, where there is such a column, follows the text. Other columns pass through
    whatever their names. The cost of a line of n words is of the order n log n, that of a text of its lines.

    Native functions only. Every shuffle but two carries hashes and places; minima are combined before them, and
    lines or variants that a large part of the rows share are dealt over several tasks.
    """
    occ = occurrences(docs, id_col, text_col)
    halves = F.when(F.col("n") >= near_words, _halves(F.col("s"), F.col("n")))
    occ = scratch.save(occ.select("doc_id", "line_no", *_hashes(F.col("s")), F.col("n").alias("words"), halves.alias("halves")), "occurrences")
    distinct = scratch.save(occ.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"), F.min("words").alias("words"), F.min("halves").alias("halves")), "distinct")
    near = near_bounds(distinct, docs, scratch, id_col, text_col, near_words)
    bounds = distinct.where("n > 1").select("h1", "h2", F.col("first").alias("bound"), "n").union(near.select("*", F.lit(1).cast("long"))).groupBy("h1", "h2").agg(F.min("bound").alias("bound"), F.max("n").alias("n"))
    bounds = scratch.save(bounds, "bounds")
    total = bounds.agg(F.sum("n")).first()[0] or 0
    gone = spread_join(occ.select("doc_id", "line_no", "h1", "h2"), bounds.drop("n"), ["h1", "h2"], bounds.select("h1", "h2", "n"), total)
    gone = gone.where(F.struct("doc_id", "line_no") > F.col("bound"))
    pair = "array<struct<h1:bigint,h2:bigint>>"
    gone = gone.groupBy("doc_id", "line_no").agg(F.collect_set(F.struct("h1", "h2")).alias("v"))
    gone = scratch.save(gone.groupBy("doc_id").agg(dense(F.collect_list(F.struct("line_no", "v")), pair).alias("gone")), "gone")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    row = row.join(gone, "doc_id", "left")
    text = F.col(f"row.`{text_col}`")
    stays = lambda x, i: F.coalesce(~F.array_contains(F.get("gone", i), let(normal(x), lambda s: F.struct(*_hashes(s)))), F.lit(True))
    left = F.when(F.col("gone").isNotNull(), F.filter(F.split(text.cast("string"), "\n"), stays))
    row = row.select("row", left.alias("left"))
    n = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    row = row.select("row", F.when(F.col("left").isNull(), text).otherwise(F.array_join("left", "\n")).alias("t"), *([n.alias("n"), F.size("left").alias("m")] if counts else []))
    fresh = {text_col: F.col("t"), "n_chars": F.length("t").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    out = [fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if counts:
        out += [F.col("n").alias("n_lines"), F.when(F.col("m") >= 0, F.col("n") - F.col("m")).otherwise(0).cast("long").alias("n_removed")]
    return row.select(*out)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, Scratch(spark, "op10"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


OP10_SQL = rf"""
WITH s AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, list_filter(string_split_regex(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             doc_id * 10000000 + i AS pos FROM s, unnest(range(1, len(ls) + 1)) AS u(i)),
d AS (SELECT w, min(pos) AS pos FROM l WHERE len(w) > 0 GROUP BY w),
e AS (SELECT * FROM d WHERE len(w) >= {NEAR_WORDS}),
v AS (SELECT w, pos, false AS cut, 'd' AS kind, w AS k FROM e
      UNION ALL SELECT w, pos, true, 'd', list_concat(w[1:j - 1], w[j + 1:len(w)]) FROM e, unnest(range(1, len(w) + 1)) AS u(j)
      UNION ALL SELECT w, pos, true, 's' || j, list_concat(w[1:j - 1], w[j + 1:len(w)]) FROM e, unnest(range(1, len(w) + 1)) AS u(j)),
b AS (SELECT kind, k, min(CASE WHEN NOT cut THEN pos END) AS whole, min(CASE WHEN cut THEN pos END) AS short FROM v GROUP BY kind, k HAVING count(*) > 1),
n AS (SELECT v.w, min(CASE WHEN v.kind <> 'd' THEN b.short WHEN v.cut THEN b.whole ELSE b.short END) AS bound
      FROM v JOIN b ON v.kind = b.kind AND v.k = b.k GROUP BY v.w),
x AS (SELECT l.doc_id, l.i, l.line, d.pos IS NOT NULL AND l.pos > least(d.pos, coalesce(n.bound, d.pos)) AS gone
      FROM l LEFT JOIN d ON l.w = d.w LEFT JOIN n ON l.w = n.w)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM x GROUP BY doc_id
"""
