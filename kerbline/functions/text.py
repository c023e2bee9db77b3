"""Text columns: names, CSV cells, chainage, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_name(c: Column) -> Column:
    """Trimmed, inner blanks collapsed, lower case."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def safe_file_name(c: Column) -> Column:
    """Anything but letters, digits, dot, underscore and hyphen becomes an underscore."""
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def segment_id(session: Column, k: Column) -> Column:
    """Session and number, five digits or more."""
    return F.concat(session, F.lit("_seg"), F.when(k < 100_000, F.lpad(k.cast("string"), 5, "0")).otherwise(k.cast("string")))


def chainage(m: Column) -> Column:
    """Km 1+234 (L15)."""
    r = F.round(m).cast("long")
    return F.concat(F.lit("Km "), F.floor(r / 1000).cast("string"), F.lit("+"), F.lpad((r % 1000).cast("string"), 3, "0"))


def csv_cell(c: Column) -> Column:
    """A text that a spreadsheet would read as a formula gets a quote in front."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_row(df: DataFrame) -> DataFrame:
    """Every column as CSV text: lists joined by '; ', booleans in lower case, nulls empty."""
    from pyspark.sql.types import ArrayType

    def one(f) -> Column:
        c = F.col(f"`{f.name}`")
        return F.coalesce(F.array_join(c, "; ") if isinstance(f.dataType, ArrayType) else c.cast("string"), F.lit("")).alias(f.name)

    return df.select(*map(one, df.schema.fields))


def canonical_hash(*columns: str) -> Column:
    """sha256 of the columns as JSON in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def split_class(c: Column) -> Column:
    """(name, severity) of "name-severity", split at the last hyphen."""
    return F.struct(F.trim(F.regexp_extract(c, r"^(.*)-([^-]*)$", 1)).alias("name"), F.trim(F.regexp_extract(c, r"^(.*)-([^-]*)$", 2)).alias("severity"))


def item_spans(c: Column) -> Column:
    """(label, start) of the items of a comma field."""
    parts = F.split(c, ",")
    at = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, p: a + F.length(p) + 1)
    return F.transform(parts, lambda p, i: F.struct(F.trim(p).alias("label"), (at(i) + F.length(p) - F.length(F.ltrim(p))).alias("start")))


def fuzzy_map(labels: DataFrame, column: str, targets: list[str]) -> DataFrame:
    """labels with `mapped`: the first target that equals, holds or lies in the label, both reduced to letters."""
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z]+", "")
    t = F.array(*map(F.lit, targets))
    x = norm(F.col(column))
    hit = F.filter(t, lambda v: (norm(v) == x) | F.contains(norm(v), x) | F.contains(x, norm(v)))
    return labels.withColumn("mapped", F.when(x != "", F.get(hit, F.lit(0))))


# Treatments by distress.
TREATMENT = {"Potholes": "Fill and compact, then seal", "Alligator Cracking": "Patch the full depth", "Longitudinal Cracking": "Seal cracks", "Ravelling": "Renew the surface"}


def answer_text(ids: Column) -> Column:
    """Answer text and severity from class numbers: more classes, more severe."""
    names = F.array(*map(F.lit, ("Longitudinal Cracking", "Transverse Cracking", "Alligator Cracking", "Potholes")))
    types = F.transform(ids, lambda i: F.get(names, i))
    sev = F.when(F.size(ids) >= 3, "High").when((F.size(ids) == 2) | F.array_contains(ids, 3), "Medium").otherwise("Low")
    return F.concat_ws("\n", F.concat(F.lit("DISTRESS_TYPES: "), F.array_join(types, ", ")), F.concat(F.lit("SEVERITY: "), sev), F.lit("DESCRIPTION: generated"))
