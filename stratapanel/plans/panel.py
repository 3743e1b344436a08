"""A panel over the star-schema tables: customers are entities, order years are periods.

Like any preparation step, the panel is written once per session and read by the queries after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapanel.operators.reshape import to_long
from stratapanel.session import materialize

INDICATORS = [
    "withdrawals",
    "stress",
    "productivity",
    "agriculture",
    "domestic",
    "industry",
    "population",
    "gdppc",
]
FLAGS = {"agriculture": "A", "domestic": "N", "industry": "R"}
#: Orders that one task joins to their line items.
ORDERS_PER_TASK = 200_000
#: Cells of the panel that one task makes or writes.
CELLS_PER_TASK = 500_000

_stored: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_amounts(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """Line items summed per order before they meet the orders, in ``parts`` tasks; those without an order meet none."""
    price = F.col("l_extendedprice")
    shares = [
        F.sum(F.when(F.col("l_returnflag") == flag, price).otherwise(0.0)).alias(f"price_{name}")
        for name, flag in FLAGS.items()
    ]
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_orderkey").isNotNull())
        .select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
        .repartition(parts, "l_orderkey")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum("l_quantity").alias("quantity"), F.sum(price).alias("price"), F.count(price).alias("n_lines"), *shares)
    )


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity and year, with NULL where the entity has no orders that year.

    The empty cells are added as rows without values ahead of the aggregation, so completing the
    grid costs no further shuffle. Sums are rounded to cents, which makes them the same whatever
    the order of summation. Orders and line items are dealt by order, and entities by row, into as many
    parts as they need, so what a task sums and sorts does not grow with the tables. The years of
    an entity come into one part, where readers sum them up before any shuffle.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    first, last, n = orders.agg(F.min("year"), F.max("year"), F.count(F.lit(1))).first()
    parts = n // ORDERS_PER_TASK + 1
    facts = orders.repartition(parts, "o_orderkey").join(order_amounts(spark, sf_dir, parts), "o_orderkey", "left").select(
        F.col("o_custkey").alias("entity"),
        "year",
        "o_totalprice",
        "quantity",
        "price",
        "n_lines",
        *[f"price_{name}" for name in FLAGS],
        F.lit(1).alias("n"),
    )
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    n_cells = people.count() * ((last or 0) - (first or 0) + 1)
    cells = people.repartition(n_cells // CELLS_PER_TASK + 1).withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    sums = (
        facts.unionByName(cells, allowMissingColumns=True)
        .groupBy("entity", "year")
        .agg(*[F.round(F.sum(c), 2).alias(c) for c in facts.columns[2:]])
    )
    files = max(spark.sparkContext.defaultParallelism, n_cells // CELLS_PER_TASK + 1)
    return sums.repartition(files, "entity").select(
        "entity",
        "year",
        F.col("o_totalprice").alias("withdrawals"),
        F.col("quantity").alias("stress"),
        F.try_divide("price", "n_lines").alias("productivity"),
        *[(F.try_divide(f"price_{name}", "price") * 100).alias(name) for name in FLAGS],
        F.col("price").alias("population"),
        F.try_divide("price", "n").alias("gdppc"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, "panel")
    if key not in _stored:
        _stored[key] = materialize(build_panel(spark, sf_dir), "panel")
    return _stored[key]


def long_panel(spark: SparkSession, sf_dir: str, indicators: list[str] | None = None) -> DataFrame:
    """``(entity, year, indicator, value)`` of the indicators asked for; only those are read."""
    return to_long(panel(spark, sf_dir), ["entity", "year"], indicators or INDICATORS)


def info(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Entity dimension: region, income group and the single-period snapshot.

    The places are joined only when the region is asked for: the optimizer keeps a left join whose
    right side it cannot prove unique.
    """
    columns = columns or ("region", "income_group", "snapshot")
    people = table(spark, sf_dir, "customer")
    if "region" in columns:
        nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
        places = nation.join(region, nation.n_regionkey == region.r_regionkey)
        places = places.select("n_nationkey", F.col("r_name").alias("region"))
        people = people.join(places, people.c_nationkey == places.n_nationkey, "left")
    people = people.withColumnsRenamed(
        {"c_custkey": "entity", "c_mktsegment": "income_group", "c_acctbal": "snapshot"}
    )
    return people.select("entity", *columns)


# The same panel for the SQL checks.
PANEL_SQL = """
WITH RECURSIVE li AS (
  SELECT l_orderkey, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, count(l_extendedprice) AS n_lines,
         sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END) AS pa,
         sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) AS pn,
         sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS pr
  FROM lineitem GROUP BY l_orderkey),
ey AS (
  SELECT o_custkey AS entity, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS withdrawals, sum(qty) AS stress,
         round(sum(price), 2) / sum(n_lines) AS productivity, round(sum(pa), 2) / round(sum(price), 2) * 100 AS agriculture,
         round(sum(pn), 2) / round(sum(price), 2) * 100 AS domestic, round(sum(pr), 2) / round(sum(price), 2) * 100 AS industry,
         round(sum(price), 2) AS population, round(sum(price), 2) / count(*) AS gdppc
  FROM orders LEFT JOIN li ON l_orderkey = o_orderkey GROUP BY 1, 2),
years AS (SELECT unnest(generate_series((SELECT min(year(o_orderdate)) FROM orders),
                                        (SELECT max(year(o_orderdate)) FROM orders))) AS year),
panel AS (
  SELECT c_custkey AS entity, y.year AS year, withdrawals, stress, productivity, agriculture, domestic, industry,
         population, gdppc
  FROM customer CROSS JOIN years y LEFT JOIN ey ON ey.entity = c_custkey AND ey.year = y.year),
info AS (
  SELECT c_custkey AS entity, r_name AS region, c_mktsegment AS income_group, c_acctbal AS snapshot
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
long AS (
  SELECT entity, year, indicator, value FROM panel
  UNPIVOT INCLUDE NULLS (value FOR indicator IN
    (withdrawals, stress, productivity, agriculture, domestic, industry, population, gdppc)))
"""
