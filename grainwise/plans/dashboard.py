"""Splits, trends and dashboards over a model's measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_id_like, is_unreadable, label
from ..operators.shape import disjoint_spans, first_per, key_is_number, sort_key, top_fold
from ..sources.staging import staged
from ..sources.tables import profile
from .model import PERIODS, Measure, Model, NotComputable, as_rows

MIN_CLASSES, MAX_CLASSES, MAX_SLICES, MAX_PERIODS, MAX_POINTS, MAX_SPLITS, MAX_PLACES = 2, 30, 10, 120, 40, 4, 400


def calendar_choice(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_distinct): the date column of most distinct days; none where two tie."""
    counts = table.agg(*[F.count_distinct(F.to_date(c)).alias(c) for c in columns]).unpivot([], list(columns), "column_name", "n_distinct")
    best = counts.withColumn("most", F.max("n_distinct").over(Window.partitionBy())).filter("n_distinct = most")
    return best.withColumn("tied", F.count("*").over(Window.partitionBy())).filter("tied = 1").select("column_name", "n_distinct")


def calendar_tables(model: Model, dates: Mapping[str, Sequence[str]], marked: Sequence[str] = ()) -> list[str]:
    """The table to take years from, in a list of one, or none: the one marked table with dates, else the only one with dates that others lead to and that leads to none itself."""
    own = [t for t in marked if dates.get(t)]
    if len(own) == 1:
        return own
    pointed = {r.one.split(".")[0] for r in model.relationships} - {r.many.split(".")[0] for r in model.relationships}
    leaves = sorted(t for t in pointed if dates.get(t))
    return leaves if len(leaves) == 1 else []


def calendar(model: Model, dates: Mapping[str, Sequence[str]], marked: Sequence[str] = ()) -> DataFrame:
    """(table_name, column_name, n_distinct) of the date column to take years from, dates being the date columns of each table; no row if the model doesn't settle it."""
    spark = next(iter(model.tables.values())).sparkSession
    found = calendar_tables(model, dates, marked)
    if not found:
        return spark.createDataFrame([], "table_name string, column_name string, n_distinct long")
    return calendar_choice(model.tables[found[0]], dates[found[0]]).select(F.lit(found[0]).alias("table_name"), "column_name", "n_distinct")


def usable_periods(table: DataFrame, column: str, most: int = MAX_PERIODS) -> DataFrame:
    """(period, buckets) of the periods that have 2 to `most` buckets; coarser ones are counted over the distinct hours."""
    hours = table.select(F.date_trunc("hour", column).alias("hour")).distinct()
    counts = hours.agg(*[F.count_distinct(F.date_trunc(p, "hour")).alias(p) for p in PERIODS])
    return counts.unpivot([], list(PERIODS), "period", "buckets").filter(F.col("buckets").between(2, most))


def one_side(model: Model, base: str) -> list[str]:
    """Tables reached from base going only to one sides."""
    found, todo = [], [base]
    while todo:
        here = todo.pop(0)
        for r in model.relationships:
            many, one = r.many.split(".")[0], r.one.split(".")[0]
            if r.active and many == here and one not in found:
                found.append(one)
                todo.append(one)
    return found


def keys_of(model: Model) -> set[str]:
    return {c for r in model.relationships for c in (r.many, r.one)}


def chartable(model: Model, base: str, hidden: Sequence[str] = ()) -> DataFrame:
    """(table_name, column_name, n_distinct, sample) of the columns fit to split by: on a one side, no key, not id-like, 2 to 30 readable values."""
    barred = keys_of(model) | set(hidden)
    parts = []
    for t in one_side(model, base):
        columns = [c for c, kind in model.tables[t].dtypes if f"{t}.{c}" not in barred and kind in ("string", "int", "bigint", "boolean")]
        if columns:
            parts.append(profile(model.tables[t], columns, MAX_CLASSES).select(F.lit(t).alias("table_name"), "*"))
    if not parts:
        raise ValueError(f"nothing on a one side of {base} can be charted")
    found = reduce(DataFrame.unionByName, parts)
    return found.filter(F.col("n_distinct").between(MIN_CLASSES, MAX_CLASSES) & ~is_id_like(F.col("column_name")) & ~is_unreadable(F.col("sample")))


def one_per_table(columns: DataFrame, most: int = MAX_SPLITS) -> DataFrame:
    """The column of fewest values of each table, at most `most` tables."""
    return first_per(columns, ["table_name"], F.col("n_distinct"), F.col("column_name")).orderBy("table_name").limit(most)


def label_order(table: DataFrame, column: str, sort_by: str | None = None, date: str | None = None) -> DataFrame:
    """(label, order_key): the order of a column's labels as its declared sort column has it, or, where the labels are periods of a date column, each ending before the next begins, as time has it; no rows otherwise."""
    named = table.select(label(F.col(column)).alias("label"), *[F.col(c).alias("at") for c in (sort_by or date,) if c])
    if sort_by:
        kind = dict(table.dtypes)[sort_by]
        firsts = named.groupBy("label").agg(F.min("at").alias("at")).filter("at IS NOT NULL")
        key = sort_key(F.col("at"), kind)
        if key_is_number(kind):
            # One negative number, and all are compared as text.
            key = F.when(F.min("at").over(Window.partitionBy()) < 0, F.col("at").cast("string")).otherwise(key)
        return firsts.select("label", key.alias("order_key"))
    if date:
        spans = named.groupBy("label").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low IS NOT NULL")
        fit = disjoint_spans(spans.withColumn("all", F.lit(1)), ["all"]).filter("disjoint").select("disjoint")
        enough = F.count("*").over(Window.partitionBy())
        return spans.crossJoin(fit).withColumn("n", enough).filter(F.col("n") >= MIN_CLASSES).select("label", F.col("low").cast("string").alias("order_key"))  # fit is one row or none
    return named.select("label", F.lit(None).cast("string").alias("order_key")).limit(0)


def breakdown(model: Model, measure: str, by: str, where: Mapping[str, object] | None = None, year: int | None = None, most: int = MAX_SLICES, order: DataFrame | None = None) -> DataFrame:
    """(measure, by, label, value, folded, additive, order_key) of a measure split by one column; order is (label, order_key)."""
    found = dashboard(model, measure, [by], where, year, most, refuse=False, whole_split=False).drop("is_filter")
    if order is None:
        return found.withColumn("order_key", F.lit(None).cast("string"))
    return found.join(order, "label", "left").select("measure", "by", "label", "value", "folded", "additive", "order_key")


def over_time(model: Model, measures: Sequence[str], period: str, grain: Sequence[str] = (), year: int | None = None, most: int = MAX_PERIODS) -> DataFrame:
    """(keys, period, measures), the first `most` periods in order; periods without any figure are dropped."""
    frame = model.evaluate(measures, grain, period, year).filter("period IS NOT NULL")
    frame = frame.filter(reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in measures]))
    if grain:
        return frame
    return frame.orderBy("period").limit(most)


def dashboard(
    model: Model, measure: str, splits: Sequence[str], where: Mapping[str, object] | None = None, year: int | None = None, most: int = MAX_SLICES, refuse: bool = True, whole_split: bool = True
) -> DataFrame:
    """(measure, by, label, value, folded, additive, is_filter): the splits of a measure under a cross-filter.

    With whole_split the split of a filtered column stays whole and is marked is_filter. A measure of one base is
    aggregated for all splits and their wholes in one pass over one joined frame, by grouping sets, each split with its own
    conditions. Refused if no rows are left.
    """
    where = dict(where or {})
    leaves = model.leaves(measure)
    bases = {leaf.base for leaf in leaves}
    conditions = [{c: v for c, v in where.items() if not (whole_split and c == by)} for by in splits]
    if len(bases) > 1 or model.shifts(measure) or model.moving(measure):
        rows = reduce(DataFrame.unionByName, [_split(model, measure, by, others, year) for by, others in zip(splits, conditions)])
    else:
        rows = _splits_in_one(model, measure, leaves, splits, conditions, year)
    if refuse:
        rows = staged(rows, "splits")
        if rows.filter("label IS NOT NULL").isEmpty():
            raise NotComputable("BLOCKED", "rows", f"the filters leave no rows of {measure}")
    parts = rows.filter("NOT total").select("measure", "by", label(F.col("label")).alias("label"), "value").filter("value IS NOT NULL")
    whole = rows.filter("total").select("measure", "by", F.col("value").alias("whole"))
    gap = F.abs(F.col("parts") - F.col("whole")) <= 1e-9 * F.greatest(F.abs("whole"), F.lit(1.0))
    check = parts.groupBy("measure", "by").agg(F.sum("value").alias("parts")).join(whole, ["measure", "by"]).select("measure", "by", gap.alias("additive"))
    return top_fold(parts, most, ["measure", "by"]).join(check, ["measure", "by"], "left").withColumn("is_filter", F.col("by").isin(*where) if where and whole_split else F.lit(False))


def _split(model: Model, measure: str, by: str, where: Mapping[str, object], year: int | None) -> DataFrame:
    """(measure, by, label, value, total) of one split, and its whole."""
    head = (F.lit(measure).alias("measure"), F.lit(by).alias("by"))
    value = F.col(f"`{measure}`").cast("double").alias("value")
    parts = model.evaluate([measure], [by], where=where, year=year).select(*head, F.col(by.split(".")[-1]).cast("string").alias("label"), value, F.lit(False).alias("total"))
    return parts.unionByName(model.evaluate([measure], where=where, year=year).select(*head, F.lit(None).cast("string").alias("label"), value, F.lit(True).alias("total")))


def _splits_in_one(model: Model, measure: str, leaves: Sequence[Measure], splits: Sequence[str], conditions: Sequence[Mapping[str, object]], year: int | None) -> DataFrame:
    """The same for several splits, in one pass."""
    frame, keeps = model.scoped(leaves, [*splits, *{c for some in conditions for c in some}], conditions, year)
    keys = [F.col(by).cast("string").alias(f"split{i}") for i, by in enumerate(splits)]
    read = frame.select("*", *keys)
    sums = [leaf.build(keep).alias(f"{i}:{leaf.name}") for i, keep in enumerate(keeps) for leaf in leaves]
    there = [keep.rows().alias(f"{i}:rows") for i, keep in enumerate(keeps)]
    names = [f"split{i}" for i in range(len(splits))]
    grouped = read.groupingSets([[F.col(n)] for n in names] + [[]], *[F.col(n) for n in names]).agg(F.grouping_id().alias("gid"), *sums, *there)
    all_ones = (1 << len(splits)) - 1
    out = []
    for i, by in enumerate(splits):
        # Of the grouping id's bits the one of this split is 0, the others are 1; the whole has all.
        mine = F.when(F.col("gid") == all_ones, True).when(F.col("gid") == all_ones & ~(1 << (len(splits) - 1 - i)), False)
        own = [F.col(f"`{i}:{leaf.name}`").alias(leaf.name) for leaf in leaves]
        out.append(F.struct(F.lit(by).alias("by"), F.col(f"split{i}").alias("label"), mine.alias("total"), F.col(f"`{i}:rows`").alias("rows"), *own))
    rows = grouped.select(F.inline(F.array(*out))).filter("total IS NOT NULL AND (total OR rows > 0)")
    value = model.derived(rows, measure, {leaf.name for leaf in leaves})
    return value.select(F.lit(measure).alias("measure"), "by", "label", F.col(f"`{measure}`").cast("double").alias("value"), "total")


def sparklines(model: Model, measures: Sequence[str], period: str, points: int = MAX_POINTS) -> DataFrame:
    """(measure, period, value): the last `points` of every measure."""
    rows = as_rows(model.evaluate(measures, period=period), measures, ["period"]).filter("value IS NOT NULL AND period IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("period")))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= points).drop("_nth")


def places(values: DataFrame, coordinates: DataFrame, most: int = MAX_PLACES) -> DataFrame:
    """(label, latitude, longitude, value, and the bounds): the places of largest magnitude; coordinates must be legal pairs."""
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    legal = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    spots = coordinates.filter(legal).groupBy("label").agg(F.min_by(lat, F.struct(lat, lon)).alias("latitude"), F.min_by(lon, F.struct(lat, lon)).alias("longitude"))
    top = values.join(spots, "label").orderBy(F.desc(F.abs("value")), "label").limit(most)
    everything = Window.partitionBy()
    return top.select("*", F.min("latitude").over(everything).alias("south"), F.max("latitude").over(everything).alias("north"), F.min("longitude").over(everything).alias("west"), F.max("longitude").over(everything).alias("east"))


# Names of coordinate columns.
LATITUDES, LONGITUDES = ("lat", "latitude"), ("lon", "lng", "long", "longitude")


def coordinate_columns(columns: Sequence[str], categories: Mapping[str, str] | None = None) -> tuple[str, str] | None:
    """The latitude and longitude among a table's columns: those of that declared category, else those so named; None unless there are both."""
    categories = {c: k.lower() for c, k in (categories or {}).items()}

    def one(category: str, names: Sequence[str]) -> str | None:
        said = [c for c in columns if categories.get(c) == category]
        return next(iter(said or [c for c in columns if c.lower().replace(" ", "").replace("_", "") in names]), None)

    pair = one("latitude", LATITUDES), one("longitude", LONGITUDES)
    return pair if all(pair) else None


def place_label(frame: DataFrame, table: str, coordinates: Sequence[str]) -> str | None:
    """The column to name places by: called like the table or `name`, else the first text that isn't id-like, else the first that is left."""
    left = [c for c in frame.columns if c not in coordinates]
    called = [c for c in left if c.lower() in (table.lower(), "name")]
    text = [c for c, kind in frame.dtypes if c in left and kind == "string"]
    if text and not called:
        spark = frame.sparkSession
        fit = spark.createDataFrame([(i, c) for i, c in enumerate(text)], "i int, c string").filter(~is_id_like(F.col("c"))).orderBy("i").first()
        called = [fit["c"]] if fit else []
    return next(iter(called or left), None)


def map_places(model: Model, measure: str, categories: Mapping[str, Mapping[str, str]] | None = None, most: int = MAX_PLACES) -> DataFrame:
    """places() of a measure over the first table that has coordinates, categories being what a table's columns are declared to be."""
    for table, frame in model.tables.items():
        pair = coordinate_columns(frame.columns, (categories or {}).get(table))
        if pair and (name := place_label(frame, table, pair)):
            values = model.evaluate([measure], [f"{table}.{name}"]).select(F.col(name).cast("string").alias("label"), F.col(measure).cast("double").alias("value")).filter("value IS NOT NULL")
            return places(values, frame.select(F.col(name).cast("string").alias("label"), F.col(pair[0]).alias("latitude"), F.col(pair[1]).alias("longitude")), most)
    raise NotComputable("BLOCKED", "coordinates", "no table has a latitude, a longitude and a column to name places by")


def grain_options(model: Model, base: str) -> list[str]:
    """Columns a user may group by: on a one side, no key."""
    barred = keys_of(model)
    return [f"{t}.{c}" for t in one_side(model, base) for c in model.tables[t].columns if f"{t}.{c}" not in barred]
