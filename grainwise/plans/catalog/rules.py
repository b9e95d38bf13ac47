"""Rules that make requirements of the definitions of many models, with what each rests on.

Definitions are tables; each has `model`, and every rule works on all models at once. A requirement is
(model, requirement, kind, category, statement, confidence, evidence): business and functional ones of the same thing share
the thing's hash under another prefix, and evidence is an array of (node, fingerprint, detail). Confidence says where a
statement comes from: high where the model states it, medium where it is inferred, low where a person has to look. Lists
that are put together (a role's tables, a hierarchy's levels) are those of one thing in one model.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import fingerprint

BUSINESS, FUNCTIONAL = "business", "functional"
COLUMNS = ("model", "requirement", "kind", "category", "statement", "confidence", "evidence")


def evidence(node: Column, print_: Column, detail: Column) -> Column:
    return F.struct(node.alias("node"), print_.alias("fingerprint"), detail.alias("detail"))


def text(*parts: str | Column) -> Column:
    """Texts and columns in a row; a null column counts as nothing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def listed(values: Column) -> Column:
    """a, b and c."""
    n = F.size(values)
    return F.when(n < 2, F.array_join(values, "")).otherwise(F.concat(F.array_join(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(values, F.lit(-1))))


def requirement(rows: DataFrame, kind: str, about: Column, category: str, statement: Column, confidence: str | Column, rests_on: Column) -> DataFrame:
    level = F.lit(confidence) if isinstance(confidence, str) else confidence
    name = F.concat(F.lit("B-" if kind == BUSINESS else "F-"), F.substring(about, 1, 16))
    return rows.select("model", name.alias("requirement"), F.lit(kind).alias("kind"), F.lit(category).alias("category"), statement.alias("statement"), level.alias("confidence"), rests_on.alias("evidence"))


def blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)), F.lit("")) == ""


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def of_measures(measures: DataFrame, columns: DataFrame) -> DataFrame:
    """measures (model, table, name, expression, fingerprint, columns, measures, implicit): one without an expression is incomplete; an implicit one rests on the first column it reads, and is left out where the model has no such column."""
    m = measures.withColumn("_read", F.try_element_at(F.array_sort("columns"), F.lit(1)))
    real = columns.select(F.col("model").alias("_model"), F.concat_ws(".", "table", "name").alias("_column"), F.col("fingerprint").alias("_print"))
    bound = m.filter("implicit").join(real, (F.col("model") == F.col("_model")) & (F.col("_read") == F.col("_column"))).drop("_model")
    own = m.filter("NOT implicit").withColumn("_column", F.lit(None).cast("string")).withColumn("_print", F.lit(None).cast("string"))
    rows = own.unionByName(bound)
    node = F.when(F.col("implicit"), text("column:", F.col("_column"))).otherwise(text("measure:", F.col("table"), ".", F.col("name")))
    rests = F.array(evidence(node, F.when(F.col("implicit"), F.col("_print")).otherwise(F.col("fingerprint")), F.trim("expression")))
    about = fingerprint(F.lit("measure"), F.col("model"), F.col("table"), F.col("name"))
    missing = requirement(rows.filter(blank("expression")), FUNCTIONAL, about, "incomplete definitions", text("What ", F.col("table"), ".", F.col("name"), " computes is not stated and has to be supplied."), "low", rests)
    whole = rows.filter(~blank("expression"))
    source = F.when(F.size("columns") > 0, text(" It reads ", listed(F.array_sort("columns")), ".")).when(F.size("measures") > 0, text(" It is made of ", listed(F.array_sort("measures")), ".")).otherwise("")
    shown = F.when(F.col("implicit"), " The report makes this figure, no measure does.").otherwise("")
    business = requirement(whole, BUSINESS, about, "metrics", text("The solution reports ", F.col("name"), ".", source, shown), "high", rests)
    first = F.when(F.size("measures") > 0, text(" Before it, ", listed(F.array_sort("measures")), " must be known.")).otherwise("")
    functional = requirement(whole, FUNCTIONAL, about, "measure definitions", text(F.col("table"), ".", F.col("name"), " is computed as its expression in the evidence says.", first), "high", rests)
    return union([missing, business, functional])


def of_relationships(relationships: DataFrame, tables: DataFrame) -> DataFrame:
    """relationships (model, from_table, from_column, to_table, to_column, cardinality, active, integrity, direction, fingerprint); those of system tables are left out. What an active one is for is inferred, and what an inactive one is for nobody has said."""
    system = tables.filter("system").select(F.col("model").alias("_model"), F.col("name").alias("_name")).distinct()
    rows = relationships
    for side in ("from_table", "to_table"):
        rows = rows.join(system, (F.col("model") == F.col("_model")) & (F.col(side) == F.col("_name")), "left_anti")
    left, right = F.concat_ws(".", "from_table", "from_column"), F.concat_ws(".", "to_table", "to_column")
    about = fingerprint(F.lit("relationship"), F.col("model"), left, right)
    rests = F.array(evidence(text("table:", F.col("from_table"), " -> table:", F.col("to_table")), F.col("fingerprint"), text(left, " -> ", right)))
    active = F.coalesce("active", F.lit(False))
    purpose = F.when(active, text("Users can split ", F.col("from_table"), " by what ", F.col("to_table"), " says of it.")).otherwise(text("Calculations that ask for it can take another way from ", F.col("from_table"), " to ", F.col("to_table"), "."))
    business = requirement(rows, BUSINESS, about, "analysis by dimension", purpose, F.when(active, "medium").otherwise("low"), rests)
    join = F.when(F.coalesce("integrity", F.lit(False)), "drops no row, since each key is known to exist").otherwise("keeps rows without a partner")
    functional = requirement(rows, FUNCTIONAL, about, "relationships", text("An ", F.when(active, "active").otherwise("inactive"), " relationship (", F.col("cardinality"), ") joins ", left, " to ", right, ", filters ", F.coalesce("direction", F.lit("one way")), " and ", join, "."), "high", rests)
    return business.unionByName(functional)


def of_hierarchies(levels: DataFrame) -> DataFrame:
    """levels (model, table, hierarchy, ordinal, level, column, fingerprint), a null level where a hierarchy has none: that one is incomplete."""
    level = F.when(F.col("level").isNotNull(), F.struct("ordinal", "level", "column"))
    rows = levels.groupBy("model", "table", "hierarchy").agg(F.array_sort(F.collect_list(level)).alias("levels"), F.min("fingerprint").alias("fingerprint"))
    about = fingerprint(F.lit("hierarchy"), F.col("model"), F.col("table"), F.col("hierarchy"))
    path = F.array_join(F.transform("levels", lambda x: x["level"]), " > ")
    rests = F.array(evidence(text("hierarchy:", F.col("table"), ".", F.col("hierarchy")), F.col("fingerprint"), path))
    some, none = rows.filter(F.size("levels") > 0), rows.filter(F.size("levels") == 0)
    missing = requirement(none, FUNCTIONAL, about, "incomplete definitions", text(F.col("hierarchy"), " of ", F.col("table"), " has no levels; its way down has to be stated."), "low", rests)
    business = requirement(some, BUSINESS, about, "drilling", text("Users can drill through ", F.col("hierarchy"), " of ", F.col("table"), ": ", path, "."), "high", rests)
    names = F.transform("levels", lambda x: F.concat(x["level"], F.lit(" ("), x["column"], F.lit(")")))
    functional = requirement(some, FUNCTIONAL, about, "hierarchies", text(F.col("hierarchy"), " of ", F.col("table"), " has ", F.size("levels"), " levels, in this order: ", F.array_join(names, ", "), "."), "high", rests)
    return union([missing, business, functional])


def of_calculated_columns(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """columns (model, table, name, expression, calculated, fingerprint): calculated ones outside system tables; without an expression they are incomplete."""
    system = tables.filter("system").select("model", F.col("name").alias("table")).distinct()
    rows = columns.filter("calculated").join(system, ["model", "table"], "left_anti")
    about = fingerprint(F.lit("column"), F.col("model"), F.col("table"), F.col("name"))
    rests = F.array(evidence(text("column:", F.col("table"), ".", F.col("name")), F.col("fingerprint"), F.trim("expression")))
    name = text(F.col("table"), ".", F.col("name"))
    missing = requirement(rows.filter(blank("expression")), FUNCTIONAL, about, "incomplete definitions", text(name, " is calculated, but by what is not stated."), "low", rests)
    return missing.unionByName(requirement(rows.filter(~blank("expression")), FUNCTIONAL, about, "derived columns", text(name, " is calculated by its expression in the evidence, and not loaded."), "high", rests))


def of_roles(filters: DataFrame) -> DataFrame:
    """filters (model, role, access, table, expression, fingerprint), a null table where a role filters none: what its members see, and each filter that has an expression."""
    there = F.col("table").isNotNull()
    rests = evidence(text("role:", F.col("role")), F.col("fingerprint"), F.when(there, text(F.col("table"), ": ", F.col("expression"))).otherwise(text("access: ", F.col("access"))))
    roles = filters.groupBy("model", "role").agg(F.min("access").alias("access"), F.array_sort(F.collect_set("table")).alias("tables"), F.array_sort(F.collect_list(F.when(there, rests))).alias("some"), F.array_sort(F.collect_list(rests)).alias("all"))
    said = F.when(F.size("tables") > 0, text("Members of ", F.col("role"), " see only the rows of ", listed(F.col("tables")), " that its filters let through.")).otherwise(text("Members of ", F.col("role"), " have ", F.col("access"), " access and see all rows."))
    business = requirement(roles, BUSINESS, fingerprint(F.lit("role"), F.col("model"), F.col("role")), "who sees what", said, "high", F.when(F.size("some") > 0, F.col("some")).otherwise(F.col("all")))
    each = filters.filter(there & ~blank("expression"))
    own = F.array(evidence(text("role:", F.col("role")), F.col("fingerprint"), F.col("expression")))
    return business.unionByName(requirement(each, FUNCTIONAL, fingerprint(F.lit("role"), F.col("model"), F.col("role"), F.col("table")), "row filters", text("For ", F.col("role"), ", rows of ", F.col("table"), " are filtered by the expression in the evidence."), "high", own))


def of_kpis(kpis: DataFrame) -> DataFrame:
    """kpis (model, table, measure, target, target_text, status, trend, fingerprint): that a figure is judged, and by what where a status expression says so."""
    parts = F.filter(F.array(*[F.when(~blank(c), text(f"{c}: ", F.col(c))) for c in ("target", "status", "trend")]), lambda x: x.isNotNull())
    rests = F.array(evidence(text("kpi:", F.col("table"), ".", F.col("measure")), F.col("fingerprint"), F.array_join(parts, "; ")))
    about = fingerprint(F.lit("kpi"), F.col("model"), F.col("table"), F.col("measure"))
    against = F.when(~blank("target_text"), F.col("target_text")).otherwise("the target in the evidence")
    business = requirement(kpis, BUSINESS, about, "metrics", text(F.col("measure"), " is judged against ", against, "."), "high", rests)
    return business.unionByName(requirement(kpis.filter(~blank("status")), FUNCTIONAL, about, "kpi thresholds", text("The status of ", F.col("table"), ".", F.col("measure"), " is computed by the expression in the evidence."), "high", rests))


def of_object_permissions(permissions: DataFrame) -> DataFrame:
    """permissions (model, role, target, hides): all that a role can't see at all, in one requirement."""
    print_ = fingerprint(F.lit("hidden"), F.col("role"), F.col("target"))
    rows = permissions.filter("hides").groupBy("model", "role").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.array_sort(F.collect_set(evidence(text("role:", F.col("role")), print_, text(F.col("target"), ": no access")))).alias("rests"))
    return requirement(rows, BUSINESS, fingerprint(F.lit("hidden"), F.col("model"), F.col("role")), "who sees what", text("To members of ", F.col("role"), ", ", listed(F.col("targets")), " don't exist."), "high", F.col("rests"))


def of_variations(variations: DataFrame, tables: DataFrame) -> DataFrame:
    """variations (model, table, column, name, target): a target in a system table, or none, is an automatic one and isn't named."""
    owner = F.trim(F.regexp_extract(F.coalesce("target", F.lit("")), r"^'?([^.\[']*)", 1))
    system = tables.filter("system").select(F.col("model").alias("_model"), F.col("name").alias("_name"), F.lit(True).alias("_system")).distinct()
    rows = variations.join(system, (F.col("model") == F.col("_model")) & (owner == F.col("_name")), "left").drop("_model")
    automatic = blank("target") | F.coalesce("_system", F.lit(False))
    said = F.when(automatic, text("Users can drill ", F.col("table"), ".", F.col("column"), " by an automatic calendar.")).otherwise(text("Drilling ", F.col("table"), ".", F.col("column"), " goes through ", F.col("target"), ", not through its own values."))
    print_ = fingerprint(F.lit("variation"), *[F.coalesce(c, F.lit("")) for c in ("table", "column", "name", "target")])
    rests = F.array(evidence(text("column:", F.col("table"), ".", F.col("column")), print_, text("variation ", F.col("name"))))
    return requirement(rows, BUSINESS, fingerprint(F.lit("variation"), F.col("model"), F.col("table"), F.col("column"), F.col("name")), "drilling", said, "high", rests)


def of_perspectives(members: DataFrame) -> DataFrame:
    """members (model, perspective, member_kind, table, name): a view's tables and measures; one without members says nothing."""
    what = text(F.col("member_kind"), " ", F.col("table"), ".", F.col("name"))
    rows = members.filter("name IS NOT NULL").groupBy("model", "perspective").agg(
        F.array_sort(F.collect_set("table")).alias("tables"), F.array_sort(F.collect_set(F.when(F.col("member_kind") == "measure", F.col("name")))).alias("measures"), F.array_sort(F.collect_set(what)).alias("all")
    )
    offers = F.when(F.size("measures") > 0, text(", with ", listed(F.col("measures")))).otherwise("")
    detail = F.array_join("all", ", ")
    rests = F.array(evidence(text("perspective:", F.col("perspective")), fingerprint(F.lit("perspective"), F.col("perspective"), detail), detail))
    return requirement(rows, BUSINESS, fingerprint(F.lit("perspective"), F.col("model"), F.col("perspective")), "who sees what", text("The view ", F.col("perspective"), " shows ", listed(F.col("tables")), offers, "."), "high", rests)


def of_calculation_groups(items: DataFrame) -> DataFrame:
    """items (model, table, item, ordinal, expression, fingerprint): what a group offers, and each item that has an expression."""
    rests = evidence(text("item:", F.col("table"), ".", F.col("item")), F.col("fingerprint"), F.col("expression"))
    groups = items.filter("item IS NOT NULL").groupBy("model", "table").agg(F.array_sort(F.collect_list(F.struct("ordinal", "item", rests.alias("rests")))).alias("items"))
    business = requirement(groups, BUSINESS, fingerprint(F.lit("group"), F.col("model"), F.col("table")), "metrics", text("Any metric can be seen through ", F.col("table"), ", which offers ", listed(F.transform("items", lambda x: x["item"])), "."), "high", F.transform("items", lambda x: x["rests"]))
    each = items.filter(F.col("item").isNotNull() & ~blank("expression"))
    return business.unionByName(requirement(each, FUNCTIONAL, fingerprint(F.lit("item"), F.col("model"), F.col("table"), F.col("item")), "calculation groups", text("Choosing ", F.col("item"), " of ", F.col("table"), " evaluates the metric through the expression in the evidence."), "high", F.array(rests)))


def of_loads(steps: DataFrame) -> DataFrame:
    """steps (model, table, nth, step, effect, changes_rows, query, fingerprint), a null step where a load is one expression: what the load does in order, what it does that isn't described, and whether rows get lost on the way."""
    rows = steps.groupBy("model", "table").agg(F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("nth", "step", "effect", "changes_rows")))).alias("steps"), F.min("query").alias("query"), F.min("fingerprint").alias("fingerprint"))
    n, known = F.size("steps"), F.filter("steps", lambda x: x["effect"].isNotNull())
    unknown, fewer = F.filter("steps", lambda x: x["effect"].isNull()), F.filter("steps", lambda x: F.coalesce(x["changes_rows"], F.lit(False)))
    does = F.when(F.size(known) > 0, text(", which ", listed(F.transform(known, lambda x: F.concat(x["effect"], F.lit(" ("), x["step"], F.lit(")")))))).otherwise("")
    said = F.when(n > 0, text(F.col("table"), " is loaded by the ", n, " steps in the evidence", does, ".")).otherwise(text(F.col("table"), " is loaded by the one expression in the evidence."))
    more = F.when(F.size(unknown) > 0, text(" ", F.size(unknown), " of them are not described.")).otherwise("")
    loses = F.when(F.size(fewer) > 0, text(" Since ", listed(F.transform(fewer, lambda x: x["step"])), " may change the number of rows, its figures need not equal those of its source.")).otherwise("")
    return requirement(rows, FUNCTIONAL, fingerprint(F.lit("load"), F.col("model"), F.col("table")), "data acquisition", text(said, more, loses), "high", F.array(evidence(text("table:", F.col("table")), F.col("fingerprint"), F.trim("query"))))


def of_scope(tables: DataFrame, gaps: DataFrame) -> DataFrame:
    """tables (model, name, system, measure_only, parameter, fingerprint) and gaps (model, feature, n, reason): what a model covers, and what its documents don't."""
    own = tables.filter("NOT system AND NOT measure_only AND NOT parameter")
    rows = own.groupBy("model").agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set(evidence(text("table:", F.col("name")), F.col("fingerprint"), text("table ", F.col("name"))))).alias("rests"))
    scope = requirement(rows, BUSINESS, fingerprint(F.lit("scope"), F.col("model")), "scope", text("The solution covers ", F.size("names"), F.when(F.size("names") == 1, " subject: ").otherwise(" subjects: "), listed(F.col("names")), "."), "high", F.col("rests"))
    none = F.array().cast("array<struct<node: string, fingerprint: string, detail: string>>")
    why = F.when(~blank("reason"), text(" (", F.col("reason"), ")")).otherwise("")
    return scope.unionByName(requirement(gaps, FUNCTIONAL, fingerprint(F.lit("gap"), F.col("model"), F.col("feature")), "gaps", text("The ", F.col("n"), " ", F.col("feature"), " of this model are not covered", why, " and have to be specified elsewhere."), "low", none))


def derive(definitions: Mapping[str, DataFrame]) -> DataFrame:
    """All requirements of the definition tables that are given: measures, columns, tables, relationships, levels, filters, kpis, permissions, variations, members, items, steps, gaps."""
    d = definitions
    parts = [of_scope(d["tables"], d["gaps"]), of_calculated_columns(d["columns"], d["tables"]), of_measures(d["measures"], d["columns"]), of_relationships(d["relationships"], d["tables"])]
    more = {"levels": of_hierarchies, "filters": of_roles, "kpis": of_kpis, "permissions": of_object_permissions, "members": of_perspectives, "items": of_calculation_groups, "steps": of_loads}
    parts += [rule(d[name]) for name, rule in more.items() if name in d]
    if "variations" in d:
        parts.append(of_variations(d["variations"], d["tables"]))
    return union(parts).select(*COLUMNS)
