"""What a measure's definition does, told from the functions it calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Behaviours in order of precedence, and the functions that show them.
BEHAVIOURS = {
    "time_intelligence": "PREVIOUSMONTH PREVIOUSYEAR PREVIOUSQUARTER PREVIOUSDAY SAMEPERIODLASTYEAR DATEADD PARALLELPERIOD TOTALYTD TOTALQTD TOTALMTD DATESYTD DATESQTD DATESMTD DATESBETWEEN DATESINPERIOD NEXTMONTH NEXTYEAR ENDOFMONTH STARTOFMONTH".split(),
    "ranking": "RANKX TOPN RANK".split(),
    "ratio": ["DIVIDE"],
    "relationship_override": "USERELATIONSHIP CROSSFILTER".split(),
    "distinct_count": "DISTINCTCOUNT DISTINCTCOUNTNOBLANK".split(),
    "context_removal": "ALL ALLEXCEPT ALLSELECTED REMOVEFILTERS".split(),
    "row_iteration": "SUMX AVERAGEX COUNTX MINX MAXX PRODUCTX RANKX".split(),
    "scope_aware": "ISINSCOPE HASONEVALUE SELECTEDVALUE ISFILTERED".split(),
    "conditional": "IF SWITCH IFERROR".split(),
    "aggregation": "SUM AVERAGE COUNT COUNTA COUNTROWS MIN MAX MEDIAN".split(),
}
# Spellings of one aggregation on different platforms.
CONCEPTS = {
    "SUM": "SUM", "SUMX": "SUM", "COUNT": "COUNT", "COUNTROWS": "COUNT", "COUNTA": "COUNT", "COUNTSTAR": "COUNT", "COUNTIF": "COUNT",
    "AVERAGE": "AVG", "AVERAGEX": "AVG", "AVG": "AVG", "MIN": "MIN", "MINX": "MIN", "MAX": "MAX", "MAXX": "MAX", "MEDIAN": "MEDIAN",
    "DISTINCTCOUNT": "COUNT_DISTINCT", "COUNTDISTINCT": "COUNT_DISTINCT", "APPROXCOUNTDISTINCT": "COUNT_DISTINCT",
}
_AGGREGATES = BEHAVIOURS["aggregation"] + BEHAVIOURS["row_iteration"] + BEHAVIOURS["distinct_count"]


def behaviour(called: Column) -> Column:
    """The first behaviour that the called functions (array, upper case) show."""
    out = F.lit(None).cast("string")
    for name in reversed(BEHAVIOURS):
        out = F.when(F.arrays_overlap(called, F.array(*[F.lit(f) for f in BEHAVIOURS[name]])), name).otherwise(out)
    return out


def single_aggregation(called: Column) -> Column:
    """The aggregation called, where it is exactly one."""
    used = F.array_intersect(called, F.array(*[F.lit(f) for f in _AGGREGATES]))
    return F.when(F.size(used) == 1, F.get(used, F.lit(0)))


def concept(name: Column) -> Column:
    """What an aggregation computes, whatever a platform calls it."""
    table = F.create_map(*[F.lit(x) for pair in CONCEPTS.items() for x in pair])
    return F.element_at(table, F.regexp_replace(F.upper(name), "[^A-Z]", ""))
