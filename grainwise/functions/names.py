"""Tests and keys of names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "(Blank)"
# Endings that mean an identifier, a link or a picture.
ID_ENDINGS = ("id", "key", "guid", "code", "url", "image", "pic", "photo")
# Words that name a period.
PERIOD_WORDS = ("year", "quarter", "month", "week", "day", "date", "period", "fiscal")


def name_key(name: Column) -> Column:
    """A metric's name for comparing: lower case, % as pct, & as and, letters and digits only."""
    return F.regexp_replace(F.replace(F.replace(F.lower(name), F.lit("%"), F.lit("pct")), F.lit("&"), F.lit("and")), r"[^\p{L}\p{N}]", "")


def is_id_like(name: Column) -> Column:
    folded = F.lower(F.trim(name))
    return folded.rlike(f"({'|'.join(ID_ENDINGS)})$") | folded.contains("(clusters)")


def is_unreadable(sample: Column, longest: int = 60) -> Column:
    """True of a value that can't label an axis: a link, inline data, or more than `longest` characters."""
    text = F.lower(F.trim(sample))
    return text.rlike("^(http://|https://|data:|www\\.|/9j/)") | (F.length(text) > longest)


def names_period(name: Column) -> Column:
    """True if a word of the name, camel case split, names a period."""
    return F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2").rlike(f"(?i)\\b({'|'.join(PERIOD_WORDS)})\\b")


def label(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull() | (F.trim(text) == ""), BLANK).otherwise(text)


def numeric_order(text: Column) -> Column:
    """Text that sorts numbers in it by size: each run of digits is padded to 18."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$") & (F.length(p) < 18), F.lpad(p, 18, "0")).otherwise(F.lower(p))), "")
