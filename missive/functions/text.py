"""String helpers shared by the record conversions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it: fixed values.
SPACE = r"[\t\n\x0B\f\r\x20\x85\xA0  -     　]"


def trim(c: Column) -> Column:
    """Strip Unicode white space at both ends; Spark's own trim strips spaces only."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def null_string(c: Column) -> Column:
    """'' for the word null in any case, with or without space around it."""
    return F.when(trim(F.lower(c)) == "null", "").otherwise(c)


def whole(c: Column, default: int | None = 0) -> Column:
    """A decimal integer with optional sign; anything else is the default."""
    parsed = F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast("bigint"))


def preview(c: Column, size: int = 50) -> Column:
    """The first `size` characters and three dots if there are more."""
    return F.when(c.isNull(), "").when(F.length(c) <= size, c).otherwise(F.concat(trim(F.substring(c, 1, size)), F.lit("...")))


def sanitize_username(c: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name == "", "user").otherwise(name)


def folded(x: str | None) -> str | None:
    """Lower case without diacritics."""
    if x is None or x.isascii():
        return x.lower() if x else x
    return "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c))


def _fold(s: pd.Series) -> pd.Series:
    return s.map(folded)


def fold(c: Column) -> Column:
    """folded() on a column. Spark has no Unicode normalisation of its own, so values with
    other characters than ASCII go through Python; for the rest nothing is sent there."""
    return F.coalesce(F.pandas_udf(_fold, "string")(F.when(c.rlike("[^\\x00-\\x7F]"), c)), F.lower(c))
