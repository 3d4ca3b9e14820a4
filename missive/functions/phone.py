"""Phone numbers: one canonical form for grouping, four display styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(c: Column) -> Column:
    """Digits with + where a country code is known; ten digits, or eleven from 1,
    are taken as North American. No digits give ''."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(digits == "", "")
        .when(c.startswith("+"), F.concat(F.lit("+"), digits))
        .when(n == 10, F.concat(F.lit("+1"), digits))
        .when((n == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
        .otherwise(digits)
    )


def _cut(c: Column, start: int, size: int | None = None) -> Column:
    return F.substring(c, start + 1, size if size is not None else 1 << 30)


def _grouped(c: Column, start: int, lead: str) -> Column:
    return F.concat(F.lit(f"{lead}("), _cut(c, start, 3), F.lit(") "), _cut(c, start + 3, 3), F.lit("-"), _cut(c, start + 6))


def format_one(c: Column, style: str = "list") -> Column:
    """A single number for display: list, activity, search or summary."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    n = F.length(digits)
    if style == "list":
        far = F.concat(F.lit("+"), digits.substr(F.lit(1), n - 10), F.lit(" "), digits.substr(n - 9, F.lit(3)), F.lit(" "), digits.substr(n - 6, F.lit(3)), F.lit(" "), digits.substr(n - 3, F.lit(4)))
        return (
            F.when(c.isNull() | (c == ""), "Unknown")
            .when((n == 11) & digits.startswith("1"), _grouped(digits, 1, "+1 "))
            .when(n == 10, _grouped(digits, 0, ""))
            .when(n > 10, far)
            .otherwise(c)
        )
    empty = F.when(c.isNull() | (c == ""), "")
    if style == "activity":
        kept = F.regexp_replace(c, "[^0-9+]", "")
        size = F.length(kept)
        return (
            empty.when(kept.startswith("+1") & (size == 12), _grouped(kept, 2, "+1 "))
            .when(kept.startswith("+"), kept)
            .when((size == 11) & kept.startswith("1"), _grouped(kept, 1, "+1 "))
            .when(size == 10, _grouped(kept, 0, "+1 "))
            .otherwise(c)
        )
    if style == "search":
        bare = F.regexp_replace(c, r"^\+1", "")
        return empty.when(F.length(bare) == 10, _grouped(bare, 0, "")).otherwise(c)
    if style == "summary":
        return empty.when(n == 10, _grouped(digits, 0, "")).when((n == 11) & digits.startswith("1"), _grouped(digits, 1, "+1 ")).otherwise(c)
    raise ValueError(f"unknown style {style!r}")


def format_number(c: Column, style: str = "list") -> Column:
    """A number, or the comma-separated numbers of a group."""
    if style == "summary":
        return format_one(c, style)
    many = F.array_join(F.transform(F.split(c, ","), lambda x: format_one(F.trim(x), style)), ", ")
    return F.when(c.contains(","), many).otherwise(format_one(c, style))
