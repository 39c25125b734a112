"""Tag lookup and strict parsing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schema import MAX_U64


def first_tag(tags: Column | str, name: str) -> Column:
    """The first tag of that name, whether or not it has a value."""
    return F.get(F.filter(tags, lambda t: F.get(t, F.lit(0)) == name), F.lit(0))


def tag(tags: Column | str, name: str) -> Column:
    """The first value of the first tag of that name, else null."""
    return F.get(first_tag(tags, name), F.lit(1))


def tag_values(tags: Column | str, name: str) -> Column:
    """All non-empty values of the first tag of that name; labels are kept byte for byte."""
    found = first_tag(tags, name)
    values = F.filter(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(values, F.array().cast("array<string>"))


def parse_amount(text: Column) -> Column:
    """An unsigned 64-bit whole number, else null.  A plain cast would take blanks, fractions
    and exponents."""
    # Leading zeros may exceed any decimal's digits, so they are dropped before the cast.
    digits = F.regexp_extract(text, r"\A\+?0*([0-9]{1,20})\z", 1)
    value = F.when(digits != "", digits).try_cast("decimal(38,0)")
    return F.when(value <= F.lit(str(MAX_U64)).cast("decimal(38,0)"), value.cast("decimal(20,0)"))


def parse_premium(text: Column) -> Column:
    """A signed 64-bit whole number, else null."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text).try_cast("bigint")


def parse_bond(text: Column) -> Column:
    """True or false for exactly these words, else null (unknown)."""
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
