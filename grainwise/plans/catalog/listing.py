"""Listings and observations over definition tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import canonical, fingerprint, functions_called
from ...operators.filters import resolve_fields

# The functions a load's steps call, and what each does to the rows.
ROW_CHANGING_STEPS = {
    "Table.SelectRows": "filters rows", "Table.Distinct": "removes repeats", "Table.FirstN": "keeps first rows", "Table.Skip": "drops first rows", "Table.Range": "keeps a range of rows",
    "Table.RemoveLastN": "drops last rows", "Table.Group": "groups rows", "Table.Combine": "appends tables", "Table.Join": "joins tables", "Table.NestedJoin": "joins tables", "Table.ExpandTableColumn": "expands rows",
    "Table.Pivot": "pivots", "Table.Unpivot": "unpivots", "Table.UnpivotOtherColumns": "unpivots",
}
ROW_KEEPING_STEPS = {
    "Table.SelectColumns": "keeps columns", "Table.RemoveColumns": "removes columns", "Table.RenameColumns": "renames columns", "Table.ReorderColumns": "reorders columns",
    "Table.TransformColumnTypes": "casts columns", "Table.TransformColumns": "transforms columns", "Table.AddColumn": "adds a column", "Table.AddIndexColumn": "adds an index", "Table.ReplaceValue": "replaces values",
    "Table.PromoteHeaders": "promotes headers", "Table.DemoteHeaders": "demotes headers", "Table.Sort": "sorts rows", "Table.FillDown": "fills down", "Table.FillUp": "fills up",
    "Csv.Document": "reads delimited text", "Excel.Workbook": "reads a workbook", "Json.Document": "reads JSON", "Xml.Tables": "reads XML", "File.Contents": "reads a file", "Value.NativeQuery": "runs a query",
}
STEP_EFFECTS = ROW_CHANGING_STEPS | ROW_KEEPING_STEPS
# Connectors of a load.
CONNECTORS = {"Csv.Document": "csv", "Json.Document": "json", "Xml.Tables": "xml", "Xml.Document": "xml", "Excel.Workbook": "excel", "Sql.Database": "sql", "File.Contents": "file"}


def load_steps(loads: DataFrame) -> DataFrame:
    """(id, connector, first_literal, calls, steps, effects, unknown, changes_rows) of load scripts (id, script).

    calls counts every library function called, steps those of known effect; unknown names the others, connectors aside.
    """
    called = F.regexp_extract_all("script", F.lit(r"([A-Za-z]+\.[A-Za-z]+)\s*\("), 1)
    as_map = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    known = lambda m: F.filter(F.transform("called", lambda c: F.element_at(as_map(m), c)), lambda x: x.isNotNull())
    rows = loads.select("id", "script", called.alias("called")).withColumn("effects", known(STEP_EFFECTS))
    named = F.array(*[F.lit(x) for x in dict.fromkeys((*STEP_EFFECTS, *CONNECTORS))])
    return rows.select(
        "id",
        F.get(known(CONNECTORS), F.lit(0)).alias("connector"),
        F.regexp_extract("script", '"([^"]*)"', 1).alias("first_literal"),
        F.size("called").alias("calls"),
        F.size("effects").alias("steps"),
        F.array_join("effects", ", ").alias("effects"),
        F.array_join(F.array_except("called", named), ",").alias("unknown"),
        F.arrays_overlap("called", F.array(*[F.lit(x) for x in ROW_CHANGING_STEPS])).alias("changes_rows"),
    )


def sql_refs(views: DataFrame) -> DataFrame:
    """(id, tables, columns, aggregates) of view texts (id, body): names of WITH are no tables, quoted names keep their case, columns are those named with their table or alias."""
    bare = F.regexp_replace(F.regexp_replace("body", r"--[^\n]*|/\*(?s:.*?)\*/", " "), "'[^']*'", "''")
    name = r'(?:"[^"]+"|[A-Za-z_][\w$]*)'
    plain = lambda names: F.transform(names, lambda x: F.when(x.startswith('"'), F.translate(x, '"', "")).otherwise(F.lower(x)))
    sorted_text = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    tables = plain(F.regexp_extract_all(bare, F.lit(rf"(?i)\b(?:from|join)\s+({name}(?:\.{name})*)"), 1))
    given = plain(F.regexp_extract_all(bare, F.lit(rf"(?i)(?:\bwith\s+(?:recursive\s+)?|\),?\s*)({name})\s+as\s*\("), 1))
    columns = plain(F.regexp_extract_all(F.regexp_replace(bare, rf"(?i)\b(?:from|join)\s+{name}(?:\.{name})*", " "), F.lit(rf"{name}\.({name})"), 1))
    aggregates = F.array_intersect(functions_called(F.col("body")), F.array(*[F.lit(x) for x in ("SUM", "AVG", "COUNT", "MIN", "MAX", "MEDIAN")]))
    return views.select("id", sorted_text(F.array_except(tables, given)).alias("tables"), sorted_text(columns).alias("columns"), F.array_join(aggregates, ",").alias("aggregates"))


def list_tables(tables: DataFrame, columns: DataFrame, measures: DataFrame) -> DataFrame:
    """(table_name, kind, n_columns, n_measures) of tables (table_name), columns (table_name, column_name, parameter) and measures (table_name, measure).

    Kinds: system tables of dates, tables of measures alone, parameter tables (every column is one), and data.
    """
    c = columns.groupBy("table_name").agg(F.count("*").alias("n_columns"), F.count_if("parameter").alias("_parameters"))
    m = measures.groupBy("table_name").agg(F.count("*").alias("n_measures"))
    n = lambda x: F.coalesce(x, F.lit(0))
    kind = (
        F.when(F.col("table_name").rlike("^(LocalDateTable|DateTableTemplate)"), "system")
        .when((n("n_columns") == 0) & (n("n_measures") > 0), "measures")
        .when((n("n_columns") > 0) & (F.col("_parameters") == F.col("n_columns")), "parameter")
        .otherwise("data")
    )
    return tables.join(c, "table_name", "left").join(m, "table_name", "left").select("table_name", kind.alias("kind"), n("n_columns").alias("n_columns"), n("n_measures").alias("n_measures"))


def list_measures(measures: DataFrame, described: DataFrame) -> DataFrame:
    """(table_name, measure, documented) of measures (table_name, measure), with whether described (measure) has them."""
    known = described.select("measure", F.lit(True).alias("_there")).distinct()
    return measures.join(known, "measure", "left").select("table_name", "measure", F.coalesce("_there", F.lit(False)).alias("documented"))


def risks(counts: Mapping[str, DataFrame]) -> DataFrame:
    """(risk, n): one count for each observation."""
    out = None
    for name, rows in counts.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("risk"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def same_fingerprint(objects: DataFrame) -> DataFrame:
    """Fingerprints that several names of one kind share."""
    return objects.groupBy("kind", "fingerprint").agg(F.count_distinct("name").alias("n")).filter("n > 1")


def glossary(objects: DataFrame, description: Column) -> DataFrame:
    return objects.filter(description.isNotNull() & (F.trim(description) != "")).select("kind", "name", description.alias("description"))


def gaps(found: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, n) of kinds (kind) that are present and not known."""
    return found.join(known, "kind", "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


def data_as_of(tables: DataFrame) -> DataFrame:
    """(as_of, tables, storage): the latest refresh over tables (refreshed_at, calculated, mode) that are not calculated, and their storage mode, or mixed."""
    mode = F.when(F.min("mode") == F.max("mode"), F.min("mode")).when(F.count("mode") > 0, "mixed")
    return tables.filter(~F.col("calculated")).agg(F.max("refreshed_at").alias("as_of"), F.count("*").alias("tables"), mode.alias("storage"))


def security(grants: DataFrame) -> DataFrame:
    """(role, what, value) of grants: each once, a row each, so that a role of any size is no single row."""
    return grants.select("role", "what", "value").distinct()


def security_counts(grants: DataFrame) -> DataFrame:
    """(role, members, filters, hidden) of grants (role, what, value), as numbers."""
    return security(grants).groupBy("role").agg(*[F.count_if(F.col("what") == w).alias(n) for w, n in (("member", "members"), ("filter", "filters"), ("hidden", "hidden"))])


def self_check(definitions: DataFrame) -> DataFrame:
    """(id, same_when_reformatted, differs_when_mutated) of definitions (id, text)."""
    f = lambda c: fingerprint(canonical(c))
    reformatted = F.concat(F.lit("// note\n  "), F.regexp_replace("text", " ", "\n  "))
    return definitions.select("id", (f(F.col("text")) == f(reformatted)).alias("same_when_reformatted"), (f(F.col("text")) != f(F.concat("text", F.lit(" + 1")))).alias("differs_when_mutated"))


def tiles(fields: DataFrame, measures: DataFrame, columns: DataFrame) -> DataFrame:
    """(tile, n_fields, n_measures, n_columns, n_unresolved, is_kpi) of fields (tile, field, visual), resolved by measures and columns (one column of names each): a KPI is a single number that is a measure."""
    of = resolve_fields(fields.dropDuplicates(["tile", "field"]), measures, columns)
    n = {what: F.count_if(F.col("resolved") == what) for what in ("measure", "column", "unresolved")}
    return of.groupBy("tile").agg(
        F.count("*").alias("n_fields"), n["measure"].alias("n_measures"), n["column"].alias("n_columns"), n["unresolved"].alias("n_unresolved"), ((n["measure"] > 0) & (F.min("visual") == "number")).alias("is_kpi")
    )


def lineage_events(columns: DataFrame, reads: DataFrame, omitted: DataFrame) -> DataFrame:
    """(table_name, event): one JSON dataset event a table, of columns (table_name, column_name, data_type), reads (table_name, measure, column_name) and omitted (table_name, measure, reason).

    A list is as long as a table has columns, measures or reads of measures.
    """
    listed = lambda df, name, *cols: df.groupBy("table_name").agg(F.array_sort(F.collect_set(F.struct(*cols))).alias(name))
    fields = listed(columns, "fields", F.col("column_name").alias("name"), F.col("data_type").alias("type"))
    events = fields.join(listed(reads, "lineage", "measure", "column_name"), "table_name", "left").join(listed(omitted, "omitted", "measure", "reason"), "table_name", "left")
    return events.select("table_name", F.to_json(F.struct(F.col("table_name").alias("dataset"), "fields", "lineage", "omitted")).alias("event"))
