"""Registering queries and reading the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Measure, Model, Relationship, row_count, total

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its times in the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes])


RELATIONSHIPS = (
    Relationship("lineitem.l_orderkey", "orders.o_orderkey"),
    Relationship("lineitem.l_partkey", "part.p_partkey"),
    Relationship("lineitem.l_suppkey", "supplier.s_suppkey"),
    Relationship("orders.o_custkey", "customer.c_custkey"),
    Relationship("customer.c_nationkey", "nation.n_nationkey"),
    Relationship("supplier.s_nationkey", "nation.n_nationkey", active=False),
    Relationship("nation.n_regionkey", "region.r_regionkey"),
)

def net():
    return F.col("lineitem.l_extendedprice") * (1 - F.col("lineitem.l_discount"))


def retail(spark: SparkSession, sf_dir: str) -> Model:
    """The given star schema with measures over lineitem and orders."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    model = Model({n: table(spark, sf_dir, n) for n in names}, RELATIONSHIPS, {}, {"lineitem": "orders.o_orderdate", "orders": "orders.o_orderdate"})
    return model.add(
        total("revenue", "lineitem", net, format="#,0.00"),
        total("quantity", "lineitem", lambda: F.col("lineitem.l_quantity")),
        row_count("lines", "lineitem"),
        Measure("discount", "lineitem", lambda keep: F.avg(keep(F.col("lineitem.l_discount"))), format="0.0%"),
        row_count("returned", "lineitem", lambda: F.col("lineitem.l_returnflag") == "R"),
        row_count("order_count", "orders"),
        total("order_value", "orders", lambda: F.col("orders.o_totalprice")),
        Measure("return_rate", inputs=("returned", "lines"), fn=lambda a, b: F.try_divide(a, b), format="0.0%"),
        Measure("revenue_per_order", inputs=("revenue", "order_count"), fn=lambda a, b: F.try_divide(a, b)),
        Measure("last_month", inputs=("revenue",), previous="month"),
        Measure("month_change", inputs=("revenue", "last_month"), fn=lambda a, b: a - b),
    )


def money(*names: str) -> list:
    """Figures as doubles of four places, under their names."""
    return [F.round(F.col(n).cast("double"), 4).alias(n) for n in names]


def ratio(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 4).alias(n) for n in names]


FROM_LINES = """lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""
