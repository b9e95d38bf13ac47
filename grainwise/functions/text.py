"""Definitions as text: canonical form, fingerprints, and what they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, quoted text, names in brackets, numbers, words, two-letter operators, any other sign.
_COMMENT = r"//[^\n]*|--[^\n]*|/\*[\s\S]*?\*/"
_QUOTED = r'"(?:[^"]|"")*"'
_TOKENS = rf"({_QUOTED}|'(?:[^']|'')*'|\[[^\]]*\]|{_COMMENT}|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[\p{{L}}_][\p{{L}}\p{{N}}_.]*|<>|<=|>=|&&|\|\||\S)"


def tokens(text: Column) -> Column:
    """The tokens of a definition without comments."""
    return F.filter(F.regexp_extract_all(text, F.lit(_TOKENS), 1), lambda t: ~t.rlike(rf"^(?:{_COMMENT})$"))


def canonical(text: Column) -> Column:
    """One space between tokens, letters in lower case outside quoted text, numbers without needless zeros."""

    def one(t: Column) -> Column:
        trimmed = F.regexp_replace(F.regexp_replace(t, r"^0+(?=[0-9])", ""), r"(\.[0-9]*?)0+$", "$1")
        number = F.regexp_replace(trimmed, r"\.$", "")
        return F.when(t.startswith('"'), t).when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), number).otherwise(F.lower(t))

    return F.array_join(F.transform(tokens(text), one), " ")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)


def functions_called(text: Column) -> Column:
    """Names before an opening bracket, in upper case, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}_][\p{L}\p{N}_.]*)\s*\("), 1), F.upper)))


def references(text: Column) -> Column:
    """Table[Column] and [Name] references, each once, sorted; a table's quotes are left out."""
    found = F.regexp_extract_all(text, F.lit(r"((?:'[^']+'|[\p{L}_][\p{L}\p{N}_]*)?\[[^\]]+\])"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda r: F.replace(r, F.lit("'"), F.lit("")))))
