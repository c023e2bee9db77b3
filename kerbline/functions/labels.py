"""Label vocabulary and label columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label vocabulary in its order.
LABELS = (
    "Bleeding", "Streaking", "Hungry Surface", "Hairline Cracks", "Alligator Cracking",
    "Longitudinal Cracking", "Transverse Cracking", "Edge Cracking", "Slippage", "Rutting",
    "Corrugation", "Shoving", "Shallow Depression", "Settlement", "Stripping", "Ravelling",
    "Potholes", "Edge Breaking", "Normal",
)
DISTRESS = LABELS[:-1]
# Which label colours a marker, first match wins.
PRIORITY = (
    "Potholes", "Edge Breaking", "Ravelling", "Stripping", "Alligator Cracking", "Settlement",
    "Shallow Depression", "Rutting", "Shoving", "Corrugation", "Slippage", "Edge Cracking",
    "Transverse Cracking", "Longitudinal Cracking", "Hairline Cracks", "Bleeding", "Hungry Surface",
    "Streaking", "Normal",
)
SEVERITIES = ("None", "Low", "Medium", "High", "Unknown")
STATUSES = ("send", "audit", "skip", "not_covered")
CLASSES = ("distress", "normal", "unknown", "pending", "not_sent", "not_covered")
# Older names and their standard ones.
LEGACY = {
    "longitudinal crack (d00)": "Longitudinal Cracking", "longitudinal crack": "Longitudinal Cracking",
    "transverse crack (d10)": "Transverse Cracking", "transverse crack": "Transverse Cracking",
    "alligator crack (d20)": "Alligator Cracking", "alligator crack": "Alligator Cracking",
    "pothole (d40)": "Potholes", "pothole": "Potholes", "block crack (d43)": "Transverse Cracking",
    "block crack": "Transverse Cracking", "inlaid patch (d44)": "Patching", "patch": "Patching",
    "raveling": "Ravelling", "edge crack": "Edge Cracking", "depression": "Shallow Depression",
}
# Further aliases of the taxonomy.
ALIASES = {
    "block crack (d43)": "Transverse Cracking", "block crack": "Transverse Cracking", "block cracking": "Transverse Cracking",
    "d43": "Transverse Cracking", "polishing": "Bleeding", "polishing of aggregates": "Bleeding",
    "weathering": "Hungry Surface", "oxidation": "Hungry Surface", "weathering/oxidation": "Hungry Surface",
    "patch": "Patching", "inlaid patch (d44)": "Patching", "inlaid patch": "Patching", "d44": "Patching",
    "open joint (d50)": "Edge Breaking", "d50": "Edge Breaking",
}
# Names that stand for no distress.
NO_DISTRESS = ("normal", "no distress detected", "unknown", "other distress", "other", "unknown distress", "none")
# Severity spellings.
SEVERITY_WORDS = {
    "low": "Low", "medium": "Medium", "high": "High", "small": "Low", "large": "High", "n/a": "None", "na": "None",
    "not applicable": "None", "none": "None", "no severity": "None", "minor": "Low", "moderate": "Medium",
    "severe": "High", "extensive": "High", "unknown": "Unknown", "": "Unknown",
}
# Keywords of free-text answers in the order they are tried.
KEYWORDS = {
    "longitudinal crack": "Longitudinal Cracking", "transverse crack": "Transverse Cracking",
    "alligator crack": "Alligator Cracking", "fatigue crack": "Alligator Cracking", "mesh crack": "Alligator Cracking",
    "map crack": "Alligator Cracking", "pothole": "Potholes", "block crack": "Transverse Cracking", "rutting": "Rutting",
    "raveling": "Ravelling", "ravelling": "Ravelling", "bleeding": "Bleeding", "fatty surface": "Bleeding",
    "edge crack": "Edge Cracking", "edge breaking": "Edge Breaking", "edge break": "Edge Breaking",
    "shallow depression": "Shallow Depression", "depression": "Shallow Depression", "settlement": "Settlement",
    "upheaval": "Settlement", "shoving": "Shoving", "corrugation": "Corrugation", "washboard": "Corrugation",
    "slippage": "Slippage", "stripping": "Stripping", "streaking": "Streaking", "hungry surface": "Hungry Surface",
    "hairline": "Hairline Cracks", "weathering": "Hungry Surface", "oxidation": "Hungry Surface",
}


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """Value of a literal map, null where the key is missing."""
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.try_element_at(m, key)


def array(values) -> Column:
    return F.array(*map(F.lit, values))


def canonical(label: Column) -> Column:
    """Vocabulary spelling whatever the case, else null (L1)."""
    return lookup({x.lower(): x for x in LABELS}, F.lower(F.trim(label)))


def canonical_or_legacy(label: Column) -> Column:
    """Standard name of a vocabulary or older name, unknown names trimmed (L2)."""
    s = F.trim(label)
    return F.coalesce(lookup({x.lower(): x for x in (*LABELS, "Patching")} | {"upheaval": "Upheaval"}, F.lower(s)), lookup(LEGACY, F.lower(s)), s)


def taxonomy(label: Column) -> Column:
    """Taxonomy name: null for non-distress markers, aliases, "Name (D00)" by its bare name, others trimmed (L3)."""
    known = {x.lower(): x for x in (*DISTRESS, "Patching")} | LEGACY
    table = ALIASES | known
    s = F.trim(label)
    low = F.lower(s)
    bare = F.lower(F.trim(F.substring_index(s, "(", 1)))
    return F.when((s == "") | low.isin(*NO_DISTRESS), None).otherwise(F.coalesce(lookup(table, low), F.when(F.contains(s, F.lit("(")), lookup(table, bare)), s))


def type_set(labels: Column) -> Column:
    """Distinct standard names without Normal, Unknown and blanks (L4)."""
    names = F.transform(F.coalesce(labels, F.array().cast("array<string>")), canonical_or_legacy)
    return F.array_distinct(F.filter(names, lambda x: (x != "") & ~x.isin("Normal", "Unknown")))


def valid_distress(labels: Column) -> Column:
    """Distinct vocabulary distress labels."""
    names = F.transform(F.coalesce(labels, F.array().cast("array<string>")), canonical)
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "Normal")))


def marker(labels: Column) -> Column:
    """The label that colours a marker: first of PRIORITY present, else the first."""
    known = F.transform(labels, lambda x: F.coalesce(canonical(x), x))
    return F.coalesce(F.get(F.filter(array(PRIORITY), lambda p: F.array_contains(known, p)), F.lit(0)), F.get(labels, F.lit(0)))


def severity(raw: Column) -> Column:
    """One of SEVERITIES: closing punctuation and quotes stripped, synonyms mapped, anything else Unknown."""
    s = F.regexp_replace(F.lower(F.trim(raw)), r"[.,;:!?)\s]+$", "")
    s = F.trim(F.regexp_replace(s, "^['\"`]+|['\"`]+$", ""))
    return F.coalesce(lookup(SEVERITY_WORDS, s), F.lit("Unknown"))


def pavement(text: Column) -> Column:
    """yes, no or unsure from the first word."""
    w = F.regexp_extract(F.upper(F.trim(text)), r"^([A-Z]+)", 1)
    return F.when(w == "YES", "yes").when(w == "NO", "no").otherwise("unsure")


def stage1(text: Column) -> Column:
    """0 normal, 1 distress, -1 unparseable: exact words, keywords, then whichever comes first."""
    t = F.lower(F.trim(text))
    at = lambda w: F.when(F.contains(t, F.lit(w)), F.locate(w, t)).otherwise(10_000)
    normal = F.contains(t, F.lit("normal"))
    bad = functools_or([F.contains(t, F.lit(w)) for w in ("distress", "damage", "crack", "pothole")])
    first = F.locate("normal", t) < F.least(at("distress"), at("damage"), at("crack"))
    return (
        F.when(t.isin("normal", "normal."), 0)
        .when(t.isin("distress", "distress.", "distressed"), 1)
        .when(bad & ~normal, 1)
        .when(normal & ~bad, 0)
        .when(bad & normal, F.when(first, 0).otherwise(1))
        .otherwise(-1)
    )


def functools_or(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def _line(text: Column, key: str) -> Column:
    """Value of the last line "KEY: value" in any case, null if there is none."""
    found = F.regexp_extract_all(text, F.lit(rf"(?im)^[ \t]*{key}:[ \t]*(.*)$"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def stage2(text: Column) -> Column:
    """(types, severity, description) from three KEY: value lines, keywords where no type is named."""
    named = _line(text, "DISTRESS_TYPES")
    none = F.contains(F.lower(named), F.lit("normal")) | F.contains(F.lower(named), F.lit("no distress"))
    split = F.filter(F.transform(F.split(named, ","), taxonomy), lambda x: x.isNotNull())
    types = F.when(named.isNull(), F.array().cast("array<string>")).when(none, F.array(F.lit("Normal"))).otherwise(F.array_distinct(split))
    low = F.lower(text)
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in KEYWORDS.items()])
    words = F.array_distinct(F.transform(F.filter(pairs, lambda p: F.contains(low, p["k"])), lambda p: p["v"]))
    types = F.when(F.size(types) > 0, types).when(F.size(words) > 0, words).otherwise(F.array(F.lit("Unknown")))
    return F.struct(types.alias("types"), severity(F.coalesce(_line(text, "SEVERITY"), F.lit("Unknown"))).alias("severity"), F.coalesce(_line(text, "DESCRIPTION"), F.lit("")).alias("description"))


def class_ids(types: Column) -> Column:
    """Sorted numeric classes that the names mention."""
    def one(x: Column) -> Column:
        low = F.lower(x)
        # The words that name a class.
        has = lambda *ws: functools_or([F.contains(low, F.lit(w)) for w in ws])
        return F.when(has("d00", "longitudinal"), 0).when(has("d10", "transverse"), 1).when(has("d20", "alligator", "fatigue"), 2).when(has("d40", "pothole"), 3)

    return F.array_sort(F.array_distinct(F.filter(F.transform(types, one), lambda x: x.isNotNull())))
