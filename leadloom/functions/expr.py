"""Column helpers: rounding, trimming, ratios, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space that trimming removes, as a regex class body.
SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
EPSILON = 2.220446049250313e-16


def half_up(value: Column, digits: int = 2, epsilon: bool = True) -> Column:
    """Rounds the binary value half up, as scores are rounded."""
    factor = float(10**digits)
    moved = value + F.lit(EPSILON) if epsilon else value
    return F.floor(moved * F.lit(factor) + F.lit(0.5)).cast("double") / F.lit(factor)


def fixed2(value: Column) -> Column:
    """Two digits of the exact binary value. On what looks like a tie the exact side decides: all steps below are exact."""
    value = value.cast("double")
    n = F.floor(value * 1000 + 0.5)
    high = F.floor(value * 1048576) / 1048576
    above = (high * 1000 - n) + (value - high) * 1000 >= 0
    tie = (n % 10 == 5) & (F.abs(value * 1000 - n) < 1e-6)
    down = (n - 5) / 1000
    return F.format_string("%.2f", F.when(tie, F.when(above, down + 0.01).otherwise(down)).otherwise(value))


def clean_trim(value: Column) -> Column:
    return F.regexp_replace(value, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def compact(value: Column, most: int) -> Column:
    """Runs of white space become one space; trimmed, cut, trimmed again."""
    return clean_trim(F.left(clean_trim(F.regexp_replace(value, rf"[{SPACE}]+", " ")), F.lit(most)))


def not_blank(value: Column) -> Column:
    """The trimmed value, null if nothing is left."""
    trimmed = clean_trim(value)
    return F.when(trimmed != "", trimmed)


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole, null where whole is 0."""
    value = F.when(whole > 0, part.cast("double") / whole)
    return value if digits is None else half_up(value, digits, epsilon=False)


def json_strings(*values: Column) -> Column:
    """JSON array text of strings and nulls."""
    return F.to_json(F.array(*[v.cast("string") for v in values]))


def uuid_of(text: Column) -> Column:
    """UUID-shaped identifier from the SHA-256 of a text: version nibble 8, variant 8 to b."""
    h = F.sha2(text, 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def deterministic_uuid(namespace: str, kind: str, *values: Column) -> Column:
    return uuid_of(json_strings(F.lit(namespace), F.lit(kind), *values))


def duplicates(df, *keys: str):
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
