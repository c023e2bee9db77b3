"""Personal data: pattern spans, and further candidates scored by boosted trees with calibrated thresholds."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fence, let, running

KINDS = ("email", "ip", "card", "phone", "other")

#: Base patterns. Possessive where nothing that follows could use what backtracking gives up, so that long runs of
#: digits or letters cost linear time; a run is only entered at its start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of further candidates: what looks like an address, a number or a code but isn't in base form.
GENERATORS: tuple[tuple[str, str], ...] = (
    ("written_email", r"[A-Za-z0-9._%+-]{2,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{2,64}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,12}"),
    ("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("social_number", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("bank_account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("digit_run", r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){7,18}(?![0-9A-Za-z])"),
)
#: Beginnings of words before a candidate that tell what it is.
HINTS = {
    "hint_phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp"),
    "hint_mail": ("mail", "contact", "write to", "reach"),
    "hint_id": ("ssn", "social", "passport", "iban", "account", "licen", "tax id", "born"),
    "hint_thing": ("part", "version", "column", "count", "sum of", "lot ", "order", "draft", "parcel", "serial", "model", "licence plate", "product", "shelf", "row ", "created", "checksum", "population", "offset", "total"),
}
#: Characters of context on the left.
CONTEXT = 24
FEATURES = ("generator", "digits", "letters", "marks", "same", *HINTS)
#: Labelled texts the trees are fitted on (half) and calibrated on (half): written by labelled_texts(), a fixed number.
TEXTS, TREES, RATE, PRECISION = 3200, 16, 0.4, 0.97


# ---- spans


def _matches(text: Column, guard: Column, pattern: str) -> Column:
    return F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _spans(matches: Column, gaps: Column) -> Column:
    """(start, end, text, left) of each match, from the texts between matches. Lengths are code points."""
    of = "array<struct<start:int,end:int,text:string,left:string>>"
    steps = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
    one = lambda m, end, i: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"))
    walk = let(running(steps), lambda ends: F.transform(matches, lambda m, i: one(m, F.get(ends, i), i)))
    return F.when(F.size(matches) > 0, walk).otherwise(F.array().cast(of))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        v = F.substr(d, i, F.lit(1)).cast("int")
        w = F.when(i % 2 == 0, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)
        return acc + w

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card_ok(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(14, 19) & luhn(d)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.right(p, F.lit(3)).cast("int") <= 255)),
    "card": _card_ok,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def _ok(kind: str):
    return lambda s: VALID[kind](s["text"])


def _of(kind: int):
    return lambda s: s["kind"] == kind


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


# ---- candidates, trees


def _count(s: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(s, drop, ""))


def features(generator: int, s: Column) -> Column:
    """Struct of whole numbers that describe a candidate's format and context."""
    text, left = s["text"], F.concat(F.lit(" "), F.regexp_replace(F.lower(s["left"]), r"[^\p{L}]+", " "))
    marks = F.regexp_replace(text, "[A-Za-z0-9]", "")
    hint = lambda ws: F.when(functools.reduce(lambda a, b: a | b, [F.contains(left, F.lit(f" {w}")) for w in ws]), 1).otherwise(0)
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(generator).alias("generator"), _count(text, "[^0-9]").alias("digits"), _count(text, "[^A-Za-z]").alias("letters"),
        F.length(marks).alias("marks"), F.when(F.length(F.regexp_replace(marks, r"(.)(?=.*\1)", "")) <= 1, 1).otherwise(0).alias("same"), *[hint(ws).alias(k) for k, ws in HINTS.items()],
    )


def _describe(generator: int):
    return lambda s: features(generator, s)


#: Per generator: what people write before and after their own data, and candidates; then the same of look-alikes.
#: In a form # is a digit, @ a capital and % a small letter. Invented here; a form in both lists is told apart by context.
FORMS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "written_email": (
        ("mail me: ", "write to ", "my contact is ", "reach me under ", "she answers as ", "e-mail "),
        ("%%%%%.%%%% [at] %%%%%% [dot] com", "%%%%%%(at)%%%%%%(dot)org", "%%%%.%%%%% at %%%%%%% dot net", "%%%%%## [at] %%%%% [dot] de"),
        ("we met ", "they looked ", "the train stops ", "a price of six ", "printed ", "and so of the ", "for ", "then. "),
        ("%%%%% at %%%% dot matrix", "%%%% at %%%%%% dot chart", "%%%%%% at %%% dot three"),
    ),
    "local_phone": (
        ("call ", "phone: ", "tel. ", "my mobile is ", "fax ", "whatsapp me on ", "ask for Ann, "),
        ("###-###-####", "(###) ###-####", "###.###.####", "### ### ####"),
        ("part no. ", "version ", "columns ", "we counted ", "sum of ", "lot ", "and so of the ", "for ", "then. "),
        ("###-###-####", "###.###.####", "### ### ####", "### ### ####"),
    ),
    "social_number": (
        ("ssn ", "my social security number is ", "ssn: ", "tax id ", "born 1970, ", "the applicant, "),
        ("###-##-####",),
        ("order ", "part ", "draft ", "parcel ", "see form ", "and so of the ", "for ", "then. "),
        ("###-##-####",),
    ),
    "bank_account": (
        ("iban ", "pay to account ", "IBAN: ", "my account is ", "transfer the rent to "),
        ("@@## #### #### #### #### ##", "@@##@@@@##############", "@@## @@@@ #### #### #### ##", "@@####################"),
        ("serial ", "model ", "licence plate list ", "product key ", "shelf mark ", "and so of the ", "for ", "then. "),
        ("@@## @@@@ @#@@ @@#@ @@@@", "@@##@@@@@@#@@#@@", "@@## @#@# @@@@ @@##"),
    ),
    "digit_run": (
        ("account ", "passport ", "phone ", "call ", "my tax id is ", "ssn "),
        ("###########", "#########", "#### #######", "### ### ## ##"),
        ("row ", "created ", "checksum ", "population ", "offset ", "in total ", "and so of the ", "for ", "then. "),
        ("##############", "########", "################", "## ######", "###################"),
    ),
}


def labelled_texts(spark: SparkSession, n: int = TEXTS, seed: int = 11) -> DataFrame:
    """(id, generator, y, text): n short texts with one candidate each. Half hold somebody's data (y = 1), the others
    a look-alike; one in 64 has the other side's words before it, so words alone don't decide. Every candidate in it, of whichever generator, has its label. A rule makes them, so
    n is a parameter that doesn't grow with the corpus."""
    pick = lambda of, salt: F.element_at(of, F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.size(of)).cast("int") + 1)
    words = lambda xs: F.array(*map(F.lit, xs))
    by_generator = lambda part: functools.reduce(lambda a, i: F.when(F.col("generator") == i, words(FORMS[GENERATORS[i][0]][part])).otherwise(a), range(len(GENERATORS)), F.lit(None).cast("array<string>"))
    roll = lambda salt, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(k)).cast("int")
    d = spark.range(n).select("id", roll("g", len(GENERATORS)).alias("generator"), roll("y", 2).alias("y"), roll("swap", 64).alias("swap"))
    own = F.col("y") == 1
    before = pick(F.when(own == (F.col("swap") != 0), by_generator(0)).otherwise(by_generator(2)), "before")
    form = pick(F.when(own, by_generator(1)).otherwise(by_generator(3)), "form")

    def letter(c: Column, i: Column) -> Column:
        k = F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(260)).cast("int")
        small = F.char(F.lit(97) + k % 26)
        return F.when(c == "#", (k % 10).cast("string")).when(c == "@", F.upper(small)).when(c == "%", small).otherwise(c)

    filled = F.array_join(F.transform(F.split(form, ""), letter), "")
    around = words(("Notes of the day. ", "", "As agreed, ", "Item 4: "))
    return d.select("id", "generator", "y", F.concat(pick(around, "head"), before, filled, pick(words((".", " and so on", ", thanks", "")), "tail")).alias("text"))


def labelled_rows(spark: SparkSession, n: int = TEXTS, seed: int = 11) -> list[tuple[tuple[int, ...], int]]:
    """Feature rows with labels: the generators and features() over labelled_texts(). A few rows a text reach the driver."""
    d = labelled_texts(spark, n, seed)
    found = candidates(d, "text", ("y",)).select("y", F.explode("cand").alias("c"))
    return [(tuple(r[1:]), r[0]) for r in found.select("y", *[F.col(f"c.{k}") for k in FEATURES]).collect()]


def _tree(rows: list[tuple[int, ...]], grad: list[float], hess: list[float], depth: int):
    """Regression tree by second-order gain: a number or (feature, cut, left, right)."""
    g, h = sum(grad), sum(hess)
    best = None
    for f in range(len(FEATURES)) if depth else ():
        for cut in sorted({r[f] for r in rows})[:-1]:
            gl = hl = 0.0
            for r, a, b in zip(rows, grad, hess, strict=True):
                if r[f] <= cut:
                    gl, hl = gl + a, hl + b
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = (gain, f, cut)
    if best is None:
        return -g / (h + 1)
    _, f, cut = best
    sides = [[i for i, r in enumerate(rows) if (r[f] <= cut) == low] for low in (True, False)]
    return (f, cut, *[_tree([rows[i] for i in s], [grad[i] for i in s], [hess[i] for i in s], depth - 1) for s in sides])


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def fit(rows: list[tuple[tuple[int, ...], int]]) -> tuple:
    """Boosted trees. Equal rows are pooled, so fitting takes a fraction of a second."""
    pooled: dict[tuple[int, ...], list[int]] = {}
    for r, y in rows:
        c = pooled.setdefault(r, [0, 0])
        c[0] += 1
        c[1] += y
    keys, trees, total = sorted(pooled), [], dict.fromkeys(pooled, 0.0)
    for _ in range(TREES):
        p = {k: 1 / (1 + math.exp(-total[k])) for k in keys}
        grad, hess = [pooled[k][0] * p[k] - pooled[k][1] for k in keys], [pooled[k][0] * p[k] * (1 - p[k]) for k in keys]
        trees.append(_tree(keys, grad, hess, 3))
        for k in keys:
            total[k] += RATE * _value(trees[-1], k)
    return tuple(trees)


def value(trees: tuple, row: tuple[int, ...]) -> float:
    return sum(RATE * _value(t, row) for t in trees)


def calibrate(trees: tuple, held: list[tuple[tuple[int, ...], int]], precision: float = PRECISION) -> dict[int, float]:
    """Per generator the lowest score from which held-out candidates are personal data with this precision; infinity
    where no score reaches it."""
    cut = {}
    for g in range(len(GENERATORS)):
        own = sorted(((value(trees, r), y) for r, y in held if r[0] == g), reverse=True)
        cut[g], good = math.inf, 0
        for i, (s, y) in enumerate(own):
            good += y
            if good / (i + 1) >= precision and (i + 1 == len(own) or own[i + 1][0] < s):
                cut[g] = s
    return cut


@functools.cache
def model(n: int = TEXTS) -> tuple[tuple, dict[int, float]]:
    """(trees, threshold per generator), fitted on one half of n labelled texts and calibrated on the other."""
    rows = sorted(labelled_rows(SparkSession.active(), n))
    trees = fit(rows[::2])
    return trees, calibrate(trees, rows[1::2])


def score(c: Column) -> Column:
    """The trees' sum over a candidate, as nested conditions."""

    def of(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(RATE * tree)
        return F.when(c[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

    return functools.reduce(lambda a, b: a + b, map(of, model()[0]))


def candidates(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns in keep, base and cand: base spans that pass their checks, and the generators' candidates with
    their features. A generator whose marks a text lacks is not run."""
    names = [f"__{i}" for i in range(len(keep))]
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    d = d.select("*", F.contains(t, F.lit("@")).alias("g_at"), F.contains(t, F.lit("+")).alias("g_plus"), t.rlike("[0-9]").alias("g_digit"))
    worded = t.rlike(r"(?:\[at\]|\(at\)|\x20at\x20)[^\n]{1,70}(?:\[dot\]|\(dot\)|\x20dot\x20)")
    guards = {"email": F.col("g_at"), "ip": F.col("g_digit"), "card": F.col("g_digit"), "phone": F.col("g_plus") & F.col("g_digit"), "written_email": worded}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, **dict(GENERATORS)}
    d = d.select(*names, "t", *[_matches(t, guards.get(k, F.col("g_digit")), p).alias(f"m_{k}") for k, p in patterns.items()])
    d = d.select(*names, *[f"m_{k}" for k in patterns], *[F.when(F.size(f"m_{k}") > 0, F.split(t, p)).alias(f"s_{k}") for k, p in patterns.items()])
    d = d.select(*names, *[_spans(F.col(f"m_{k}"), F.col(f"s_{k}")).alias(f"a_{k}") for k in patterns])
    base = [_tagged(F.filter(F.col(f"a_{k}"), _ok(k)), i) for i, k in enumerate(KINDS[:4])]
    cand = [F.transform(F.col(f"a_{k}"), _describe(i)) for i, (k, _) in enumerate(GENERATORS)]
    d = d.select(*names, F.array_sort(F.concat(*base)).alias("base"), F.concat(*cand).alias("cand"))
    return fence(d.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "base", "cand"))


def _clear(hit: Column, base: Column) -> Column:
    """Those of hit that touch no base span, by start: what the spans before reach and where the next begins, each in
    one pass, so a text full of both costs no more than sorting them."""
    far = (1 << 31) - 1
    both = F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(None).cast("double").alias("s"))), hit)

    def walk(x: Column) -> Column:
        ends = running(F.transform(x, lambda v: F.when(v["s"].isNull(), v["end"]).otherwise(0)), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(x, lambda v: F.when(v["s"].isNull(), v["start"]).otherwise(far))), F.least))
        return let(F.struct(ends.alias("e"), starts.alias("s")), lambda r: F.filter(x, lambda v, i: v["s"].isNotNull() & (F.get(r["e"], i) <= v["start"]) & (F.get(r["s"], i) >= v["end"])))

    return F.when((F.size(hit) > 0) & (F.size(base) > 0), let(F.array_sort(both), walk)).otherwise(F.array_sort(hit))


def _best(more: Column) -> Column:
    """Of candidates (start, end, s) that overlap the one with the highest score, ties to the first. By start; only
    texts with an overlap are walked."""

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        apart = F.array_append(acc, c)
        better = F.array_append(F.slice(acc, 1, F.size(acc) - 1), c)
        return F.when(last["end"] <= c["start"], apart).when(c["s"] > last["s"], better).otherwise(acc)

    overlap = F.exists(F.transform(more, lambda c, i: F.get(more, i + 1)["start"] < c["end"]), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(overlap, F.aggregate(F.slice(more, 2, F.size(more)), F.slice(more, 1, 1), step)).otherwise(more)


def find(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and base and more: arrays of (start, kind, end), kind an index into KINDS, code points.

    base are the patterns' matches that pass their checks. more are candidates of the generators that touch no base
    span, whose tree score reaches their generator's threshold; of those that overlap the highest score. Null and
    empty texts have none; rows are looked at one by one, so repeated rows and null ids come back; whole texts of any
    length; an empty table gives an empty table; only the named columns are read, whatever the others' names. No
    shuffle and no Python on the executors: the trees, fitted on TEXTS texts of labelled_texts(), are conditions in
    the plan.
    """
    if clash := {"base", "more"} & set(keep):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    names = [f"__{i}" for i in range(len(keep))]
    d = candidates(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_col}`").alias("t")), "t", tuple(names))
    cuts = model()[1]
    limit = lambda c: functools.reduce(lambda a, g: F.when(c["generator"] == g, F.lit(min(cuts[g], 1e9))).otherwise(a), cuts, F.lit(1e9))
    scored = F.transform("cand", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), score(c).alias("s"), limit(c).alias("least")))
    hit = F.transform(F.filter(scored, lambda c: c["s"] >= c["least"]), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["s"].alias("s")))
    d = d.select(*names, "base", hit.alias("hit"))
    d = d.select(*names, "base", _clear(F.col("hit"), F.col("base")).alias("hit"))
    d = d.select(*names, "base", _tagged(_best(F.col("hit")), len(KINDS) - 1).alias("more"))
    return fence(d.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "base", "more"))


def span_text(column: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every base and selected span replaced by its kind in angle brackets; overlapping spans become one.

    n_chars, where there is such a column, follows the text. Texts without spans, nulls among them, stay as they are.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = find(docs.select(row, F.col(f"`{text_col}`").alias("text")), "text", ("row",))
    t = F.col(f"row.`{text_col}`")
    d = d.select("row", F.array_sort(F.concat("base", "more")).alias("spans"))
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.array(F.substr(t, acc["pos"] + 1, s["start"] - acc["pos"]), F.get(name, s["kind"])))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], put).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(t, acc["pos"] + 1, F.length(t))))
    d = d.select("row", F.when(F.size("spans") > 0, done).otherwise(t).alias("t"))
    fresh = {text_col: F.col("t")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("t").isNull(), F.col("row.n_chars")).otherwise(F.length("t").cast(docs.schema["n_chars"].dataType))
    return d.select(*[fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = [F.size(F.filter("base", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    found = (F.size("base") + F.size("more")).cast("long").alias("n_spans")
    return d.select("doc_id", *n, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.concat("base", "more")).alias("spans"), found)
