"""Quality rules as a bitmask ledger: each rule once per document, policies and ablations over the bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fence, let

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Low bits of a window key hold its position, the others its hash.
AT = 24

#: rule -> SQL over the measurements, true where the document fails. The position in this list is the rule's bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "100 * n_upper > 30 * word_chars",
    "exclamations": "5 * n_exclamations > n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "few_letters": "100 * n_letters < 50 * word_chars",
}
BASE = ("few_words", "repeated_words")
#: version -> rules that reject. The stored bits serve every version.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(RULES)}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def _window_hash(*three: Column) -> Column:
    return F.xxhash64(*three)


def _window_keys(w: Column, n: Column) -> Column:
    """Hash and position of each 3-word window in one long, sorted."""
    key = lambda i: F.shiftleft(_window_hash(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), AT).bitwiseOR(i.cast("long"))
    none = F.array().cast("array<bigint>")
    return F.when(n < 4, none).otherwise(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key)))


def _at(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << AT) - 1)).cast("int")


def _neighbours(keys: Column, w: Column) -> Column:
    """Of each sorted key and the next: 0 other hash, 1 same words, 2 same hash but other words."""

    def state(x: Column, i: Column) -> Column:
        y = F.get(keys, i + 1)
        words = [F.get(w, _at(x) + o) == F.get(w, _at(y) + o) for o in range(3)]
        return F.when(y.isNull() | (F.shiftright(x, AT) != F.shiftright(y, AT)), 0).when(words[0] & words[1] & words[2], 1).otherwise(2)

    return F.transform(keys, state)


def _repeated(keys: Column, state: Column, w: Column, n: Column) -> Column:
    """Sorted positions of the windows whose words stand at another position too.

    Equal windows are neighbours among the sorted keys, unless windows of other words share their key's hash or the
    text has more windows than a key can number; such a text has its windows sorted by their words.
    """
    fast = F.transform(F.filter(keys, lambda x, i: (F.get(state, i) == 1) | F.coalesce(F.get(state, i - 1) == 1, F.lit(False))), _at)
    window = lambda i: F.struct(F.struct(*[F.get(w, i + o).alias(f"w{o}") for o in range(3)]).alias("g"), i.alias("at"))
    exact = let(
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)),
        lambda x: F.transform(F.filter(x, lambda v, i: (F.get(x, i + 1)["g"] == v["g"]) | F.coalesce(F.get(x, i - 1)["g"] == v["g"], F.lit(False))), lambda v: v["at"]),
    )
    return F.sort_array(F.when((n >= 1 << AT) | F.array_contains(state, 2), exact).otherwise(fast))


def _covered(p: Column) -> Column:
    """Number of words in the windows that begin at the sorted positions p."""
    step = lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))
    return F.aggregate(F.transform(p, step), F.lit(0).cast("long"), lambda a, x: a + x)


def _gone(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, every measurement, and fail_bits with bit i set where rule i of RULES fails.

    One pass, no shuffle, no Python. Null and empty texts have no words and fail few_words. Rows are judged one by
    one, so repeated rows and null ids come back as they are. Kept columns are renamed while the measurements are
    made, so their names can't clash; a kept column named like a measurement is refused (ValueError). Texts of any
    length are measured whole.
    """
    measures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_exclamations", "fail_bits"]
    if clash := set(keep) & set(measures):
        raise ValueError(f"columns named like measurements: {sorted(clash)}")
    held = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)]
    names = [f"__{i}" for i in range(len(keep))]
    d = docs.select(*held, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    d = d.select("*", words(F.col("t")).alias("w"))
    d = d.select("*", F.size("w").alias("n"))
    d = d.select("*", _window_keys(F.col("w"), F.col("n")).alias("k"))
    d = d.select("*", _neighbours(F.col("k"), F.col("w")).alias("s"))
    d = d.select(*names, "t", "w", "n", _repeated(F.col("k"), F.col("s"), F.col("w"), F.col("n")).alias("p"))
    full = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = F.col("t")
    d = d.select(
        *names,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        _gone(t, r"[^#*$%&|<>]+").alias("n_symbols"),
        let(full, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _covered(F.col("p")).alias("n_repeat_words"),
        _gone(t, r"[^\p{Lu}]+").alias("n_upper"),
        _gone(t, r"[^\p{L}]+").alias("n_letters"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
    )
    d = d.select(*names, "n_words", "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", "n_upper", "n_letters", "n_exclamations")
    bits = " + ".join(f"if({rule}, {1 << i}, 0)" for i, rule in enumerate(RULES.values()))
    d = d.withColumn("fail_bits", F.expr(bits))
    return fence(d.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *measures))


def verdict(policy: str = "v1") -> Column:
    """Whether the document stays under a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(measured: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, n_failed, n_only): documents that a rule rejects, and those that no other rule of the policy would."""
    m = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    counts = measured.select(m.alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("b")) for r in POLICIES[policy]])
    each = counts.select("m", "n", F.explode(rows).alias("r")).select("m", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("m").bitwiseAND(F.col("b")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("m") == F.col("b"), F.col("n")).otherwise(0)).alias("n_only")
    )


def keep_good(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """Rows of docs that the policy keeps, with their columns as they were."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return ledger(wrapped, "text", ("row",)).where(verdict(policy)).select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict("v1")).alias("kept"), "fail_bits")


MEASURED_SQL = r"""
t AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters,
             length(t) - length(replace(t, '!', '')) AS n_exclamations
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, {bits} AS fail_bits FROM m)
""".replace("{bits}", " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values())))

OP8_SQL = f"""WITH {MEASURED_SQL.replace("{docs}", "documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask("base")} <> 0 AS base_failed,
       fail_bits & {mask("v1")} = 0 AS kept, CAST(fail_bits AS INTEGER) AS fail_bits FROM b
"""
