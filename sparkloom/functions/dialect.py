"""Functions of the analytical dialect whose meaning differs from Spark's."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Format directives and the Java patterns that mean the same.
FORMATS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD", "p": "a", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "f": "SSSSSS"}


def java_format(fmt: str) -> str:
    out = []
    for part in re.findall(r"%.|[^%]+", fmt):
        if part.startswith("%"):
            out.append("%" if part == "%%" else FORMATS[part[1]])
        else:
            out.append(re.sub(r"[A-Za-z']+", lambda m: "'" + m[0].replace("'", "''") + "'", part))
    return "".join(out)


def strftime(ts: Column, fmt: str) -> Column:
    """%w and %u are computed, the rest is a Java pattern."""
    pieces = [p for p in re.split(r"(%[wu])", fmt) if p]
    day = F.dayofweek(ts)
    special = {"%w": (day - 1).cast("string"), "%u": F.when(day == 1, 7).otherwise(day - 1).cast("string")}
    return F.concat(*(special[p] if p in special else F.date_format(ts, java_format(p)) for p in pieces))


def strptime(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(java_format(fmt)))


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """Unit boundaries crossed from a to b."""
    if unit == "day":
        return F.datediff(F.to_date(b), F.to_date(a)).cast("long")
    if unit in ("year", "quarter", "month"):
        months = (F.year(b) * 12 + F.month(b) - F.year(a) * 12 - F.month(a)).cast("long")
        return {"month": months, "quarter": (F.year(b) * 4 + F.quarter(b) - F.year(a) * 4 - F.quarter(a)).cast("long"), "year": (F.year(b) - F.year(a)).cast("long")}[unit]
    size = {"week": 7 * 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    sec = lambda c: F.unix_timestamp(F.date_trunc(unit, c.cast("timestamp")))
    return ((sec(b) - sec(a)) / size).cast("long")


def regexp_replace_first(s: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(s, f"(?s)^(.*?)(?:{pattern})", "$1" + to.replace("\\", "\\\\").replace("$", "\\$"))


def concat_skip(*cols: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *cols)


def slice_text(s: Column, start: int | None, end: int | None) -> Column:
    """s[start:end], from 1, both ends included; negative places count from the end."""
    n = F.char_length(s)
    place = lambda i, d: d if i is None else F.lit(i) if i >= 0 else n + 1 + i
    a, b = F.greatest(place(start, F.lit(1)), F.lit(1)), F.least(place(end, n), n)
    return F.when(s.isNotNull(), F.substring(s, a, F.greatest(b - a + 1, F.lit(0))))


def snake_case(name: str) -> str:
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub(r"[^0-9A-Za-z]+", "_", name))
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s).lower().strip("_")


def dow(ts: Column) -> Column:
    """Day of the week, Sunday 0."""
    return (F.dayofweek(ts) - 1).cast("long")


def similar_to(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})$")


def extract_struct(s: Column, pattern: str, names: list[str]) -> Column:
    return F.struct(*(F.regexp_extract(s, pattern, i + 1).alias(n) for i, n in enumerate(names)))


def reduce_list(a: Column, f) -> Column:
    """Fold from the first element; null for an empty list."""
    return F.when(F.size(a) > 0, F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.element_at(a, 1), f))


def quote_identifier(name: str) -> str:
    return "[" + name.replace("]", "]]") + "]"


def quoted_name(name: Column) -> Column:
    """quote_identifier for a column of names."""
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))


def quoted_text(text: Column) -> Column:
    """A national text literal."""
    return F.concat(F.lit("N'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def prefix_aliases(sql: str) -> str:
    """`SELECT name: expression` as `SELECT expression AS name`; the select list ends at FROM."""
    m = re.match(r"(?is)\s*SELECT\s+(.*?)(\s+FROM\s.*)?\Z", sql)
    out, depth, part = [], 0, ""
    for c in m[1] + ",":
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            alias = re.match(r"\s*([A-Za-z_]\w*)\s*:(?!:)\s*(.*)\Z", part, re.S)
            out.append(f"{alias[2]} AS {alias[1]}" if alias else part.strip())
            part = ""
        else:
            part += c
    return f"SELECT {', '.join(out)}{m[2] or ''}"


def at_zone(ts: Column, zone: str, other: str) -> Column:
    """A local time of one zone as the local time of another."""
    return F.convert_timezone(F.lit(zone), F.lit(other), ts.cast("timestamp_ntz"))


def in_zone(df: DataFrame, column: str, zone: str, name: str) -> DataFrame:
    """df with a UTC time for a local time of the zone, whatever the session's zone."""
    return df.select(*(c for c in df.columns if c != column), at_zone(F.col(column), zone, "UTC").alias(name))


def nextval(df: DataFrame, name: str, start: int = 1, step: int = 1, by: list[Column] | None = None) -> DataFrame:
    """df with the next values of a sequence, in the given order or any."""
    from ..operators.joins import numbered

    order = by or [F.monotonically_increasing_id()]
    return numbered(df, order, "__pos").withColumn(name, (F.col("__pos") - 1) * step + start).drop("__pos")


def settings(spark: SparkSession, **names: str) -> DataFrame:
    """One row with session settings."""
    return spark.range(1).select(*(F.lit(spark.conf.get(k)).alias(n) for n, k in names.items()))


def fixed_array(a: Column, n: int) -> Column:
    """The array, failing where it has another length; null stays."""
    return F.when(a.isNull() | (F.size(a) == n), a).otherwise(F.raise_error(F.lit(f"an array of {n} is needed")))


def tagged(members: dict[str, Column], tag: Column) -> Column:
    """A union value: its tag and one field for each member, null in all but the tagged one."""
    return F.struct(tag.alias("tag"), *(F.when(tag == n, c).alias(n) for n, c in members.items()))


def flatten_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with the named fields of a JSON column beside it."""
    return df.withColumn("__j", F.from_json(column, schema)).select(*df.columns, "__j.*")


class Enum:
    """A closed domain of texts in an order of their own."""

    def __init__(self, *values: str):
        self.values = values

    def checked(self, c: Column) -> Column:
        return F.when(c.isNull() | c.isin(*self.values), c).otherwise(F.raise_error(F.concat(F.lit("not in the domain: "), c)))

    def rank(self, c: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, v in enumerate(self.values):
            out = F.when(c == v, i).otherwise(out)
        return out
