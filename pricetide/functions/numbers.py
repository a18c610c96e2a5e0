"""Number parsing, coercion and rate arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_accents

NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
MAX_LOG_PRICE = 21.0


def parse_plain(col: Column) -> Column:
    """Text to double, null when it is not a plain number."""
    text = col.cast("string")
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def safe_double(col: Column) -> Column:
    """Text to double; anything unusable is 0."""
    return F.coalesce(parse_plain(col), F.lit(0.0))


def safe_int(col: Column) -> Column:
    """Text to integer through double (``"2.9"`` is 2); anything unusable is 0."""
    return F.coalesce(parse_plain(col).try_cast("int"), F.lit(0))


def known(col: Column) -> Column:
    """The value, or null where 0 stands for "not informed"."""
    return F.when(col > 0, col)


def reference_area(private: Column, total: Column) -> Column:
    """Private area where known, else total area."""
    return F.when(private > 0, private).otherwise(total)


def larger_area(total: Column, private: Column) -> Column:
    return F.round(F.greatest(F.coalesce(total, F.lit(0.0)), F.coalesce(private, F.lit(0.0))), 2)


def backfill(value: Column, other: Column) -> Column:
    """Copy the other area where this one is missing or zero."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.nullif(other, F.lit(0.0)), value)


def price_per_area(price: Column, private: Column, total: Column) -> Column:
    area = F.coalesce(F.nullif(private, F.lit(0.0)), F.nullif(total, F.lit(0.0)))
    return F.when(price.isNotNull() & (price != 0) & (area > 0), price / area)


def relative_difference(left: Column, right: Column) -> Column:
    """|l - r| over the larger magnitude, 0 when both are 0 or missing."""
    left, right = F.coalesce(left, F.lit(0.0)), F.coalesce(right, F.lit(0.0))
    base = F.greatest(F.abs(left), F.abs(right))
    return F.when(base > 0, F.abs(left - right) / base).otherwise(F.lit(0.0))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col))


def safe_expm1(col: Column) -> Column:
    """Inverse of log1p with the exponent held in [0, 21]."""
    return F.expm1(clamp(col, 0.0, MAX_LOG_PRICE))


def annual_pct(monthly_log: Column) -> Column:
    return F.lit(100.0) * F.expm1(F.lit(12.0) * monthly_log)


def monthly_log(annual: Column) -> Column:
    return F.log1p(annual / 100.0) / 12.0


STABLE_BAND = 0.005


def direction(col: Column, band: float = STABLE_BAND) -> Column:
    """-1, 0 or 1 with a dead band around zero."""
    return F.when(col > band, 1).when(col < -band, -1).otherwise(0)


def parse_money(col: Column, style: str = "strip", strict: bool = False) -> Column:
    """Price text to double in one of the notations the sources use.

    ``first``: first number once dots are dropped; ``labelled``: needs ``R$`` and cents;
    ``words``: a trailing ``mil`` means thousands; ``strip``: every digit, comma decimals;
    ``digits``: like ``strip`` but stray dots are dropped. With ``strict`` the ``words``
    notation also multiplies "milhões" by 1000, as the stored data did.
    """
    text = col.cast("string")
    if style == "first":
        plain = F.translate(F.regexp_replace(text, r"R\$", ""), ",.", ".")
        return F.nullif(F.regexp_extract(plain, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    if style == "labelled":
        hit = F.regexp_extract(text, r"R\$\s*([\d.]+,\d+)", 1)
        return F.translate(F.nullif(hit, F.lit("")), ",.", ".").try_cast("double")
    if style == "strip":
        return F.translate(F.regexp_replace(text, r"[^\d,]", ""), ",", ".").try_cast("double")
    number = F.translate(F.regexp_replace(text, r"[^\d,]", ""), ",", ".").try_cast("double")
    if style == "digits":
        return number
    if style != "words":
        raise ValueError(f"unknown money style {style!r}")
    word = F.lower(strip_accents(text))
    if strict:
        return F.when(word.contains("mil"), number * 1000.0).otherwise(number)
    return (
        F.when(word.contains("milh"), number * 1_000_000.0)
        .when(word.contains("mil"), number * 1000.0)
        .otherwise(number)
    )


def parse_decimal(col: Column) -> Column:
    """Comma decimals; with several separators only the last one is the decimal point."""
    text = F.translate(F.regexp_replace(col.cast("string"), r"[^\d,.]", ""), ",", ".")
    whole = F.translate(F.regexp_replace(text, r"\.[^.]*$", ""), ".", "")
    last = F.regexp_extract(text, r"(\.[^.]*)$", 1)
    many = F.length(text) - F.length(F.translate(text, ".", "")) > 1
    return F.when(many, F.concat(whole, last)).otherwise(text).try_cast("double")


def parse_comma_float(col: Column) -> Column:
    return parse_plain(F.translate(col.cast("string"), ",", "."))


def first_int(col: Column) -> Column:
    """First run of digits."""
    return F.nullif(F.regexp_extract(col.cast("string"), r"(\d+)", 1), F.lit("")).try_cast("int")


def parse_rooms(col: Column, suite_pattern: str = r"su\w*te") -> Column:
    """Room text with suites: ``2 + 1 suíte`` is 3, ``+1 suíte`` is 2, a bare suite is 1."""
    text = F.trim(F.lower(strip_accents(col.cast("string"))))
    found = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    numbers = F.transform(found, lambda x: x.try_cast("int"))
    first = F.get(numbers, F.lit(0))
    total = F.aggregate(numbers, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    plus_one = text.contains("+") & ~text.startswith(F.get(found, F.lit(0)))
    suite = (
        F.when(F.size(numbers) >= 2, total)
        .when((F.size(numbers) == 1) & plus_one, first + 1)
        .when(F.size(numbers) == 1, first)
        .otherwise(F.lit(1))
    )
    return F.when(text == "", F.lit(None).cast("int")).when(text.rlike(suite_pattern), suite).otherwise(first)


def labelled_rooms(col: Column) -> Column:
    """``3 quartos`` or a bare number, else null."""
    text = F.trim(F.lower(F.regexp_replace(strip_accents(col.cast("string")), r"\s+", " ")))
    hit = F.regexp_extract(text, r"(\d+)\s*quarto", 1)
    bare = F.regexp_extract(text, r"^(\d+)$", 1)
    return F.coalesce(F.nullif(hit, F.lit("")), F.nullif(bare, F.lit(""))).try_cast("int")


def area_tolerance_log(tolerance: float) -> float:
    """Log-width of a relative tolerance measured against the larger value."""
    return -math.log(1.0 - tolerance)
