"""Preparation queries: reshape, profile, filter, impute, derive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapanel.functions.columns import log10p1
from stratapanel.operators import derive, groupstats, impute, quality, relations, reshape
from stratapanel.plans.panel import INDICATORS, PANEL_SQL, info, long_panel, panel, table
from stratapanel.plans.registry import query

YEAR_LIMIT, ENTITY_LIMIT = 0.30, 0.57

KEPT_SQL = PANEL_SQL + """,
good_years AS (
  SELECT year FROM (SELECT year, indicator, avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS m FROM long GROUP BY 1, 2)
  GROUP BY year HAVING max(m) <= 0.30),
good_entities AS (
  SELECT entity FROM (SELECT entity, indicator, avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS m FROM long GROUP BY 1, 2)
  GROUP BY entity HAVING max(m) <= 0.57),
kept AS (SELECT * FROM long WHERE year IN (SELECT year FROM good_years) AND entity IN (SELECT entity FROM good_entities))
"""


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return quality.threshold_filter(long_panel(spark, sf), len(INDICATORS), YEAR_LIMIT, ENTITY_LIMIT)


def year_wide(spark: SparkSession, sf: str, value: str = "withdrawals") -> DataFrame:
    """Storage form with one column per year."""
    stored = panel(spark, sf).select("entity", F.concat(F.lit("X"), "year").alias("label"), value)
    labels = [f"X{row.year}" for row in panel(spark, sf).select("year").distinct().orderBy("year").collect()]
    return reshape.to_wide(stored, ["entity"], "label", labels, value)


@query("panel_build", PANEL_SQL + "SELECT entity, year::BIGINT AS year, withdrawals, stress, productivity, agriculture, population, gdppc FROM panel")
def panel_build(spark, sf):
    from stratapanel.plans.panel import build_panel

    names = ["withdrawals", "stress", "productivity", "agriculture", "population", "gdppc"]
    return build_panel(spark, sf).select(
        "entity", F.col("year").cast("long").alias("year"), *names
    )


@query("panel_long", PANEL_SQL + "SELECT entity, year::BIGINT AS year, round(withdrawals, 4) AS value FROM panel WHERE year >= 1996")
def panel_long(spark, sf):
    long = reshape.years_to_long(year_wide(spark, sf), ["entity"], first=1996)
    return long.select("entity", F.col("year").cast("long").alias("year"), F.round("value", 4).alias("value"))


@query("panel_wide", PANEL_SQL + """SELECT entity,
  round(max(CASE WHEN year = 1995 THEN withdrawals END), 4) AS X1995, round(max(CASE WHEN year = 1996 THEN withdrawals END), 4) AS X1996,
  round(max(CASE WHEN year = 1997 THEN withdrawals END), 4) AS X1997, round(max(CASE WHEN year = 1998 THEN withdrawals END), 4) AS X1998,
  round(max(CASE WHEN year = 1999 THEN withdrawals END), 4) AS X1999, round(max(CASE WHEN year = 2000 THEN withdrawals END), 4) AS X2000,
  round(max(CASE WHEN year = 2001 THEN withdrawals END), 4) AS X2001 FROM panel GROUP BY entity""")
def panel_wide(spark, sf):
    wide = year_wide(spark, sf)
    return wide.select("entity", *[F.round(c, 4).alias(c) for c in reshape.year_columns(wide)])


@query("presence_label", PANEL_SQL + "SELECT entity, max(CASE WHEN withdrawals IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS has_data FROM panel GROUP BY entity")
def presence_label(spark, sf):
    values = panel(spark, sf).select("entity", F.col("withdrawals").alias("value"))
    return impute.presence_label(values).withColumn("has_data", F.col("has_data").cast("long"))


@query("snapshot_relabel", PANEL_SQL + "SELECT entity, 1997::BIGINT AS year, round(stress, 4) AS midpoint_stress FROM panel WHERE year = 2000")
def snapshot_relabel(spark, sf):
    snap = reshape.relabel_snapshot(panel(spark, sf).select("entity", "year", "stress"), 2000, 1997)
    return reshape.renamed(snap, {"stress": "midpoint_stress"}).select(
        "entity", F.col("year").cast("long").alias("year"), F.round("midpoint_stress", 4).alias("midpoint_stress")
    )


@query("snapshot_spread", "SELECT c_custkey AS entity, y.year::BIGINT AS year, c_acctbal AS value FROM customer CROSS JOIN (SELECT unnest(generate_series(1995, 2001)) AS year) y")
def snapshot_spread(spark, sf):
    snap = info(spark, sf, "snapshot").withColumnRenamed("snapshot", "value")
    return reshape.spread_snapshot(snap, 1995, 2001).select("entity", F.col("year").cast("long").alias("year"), "value")


@query("tagged_union", PANEL_SQL + """SELECT entity, year::BIGINT AS year, round(domestic, 4) AS value, 'Domestic' AS category FROM panel
  UNION ALL SELECT entity, year, round(agriculture, 4), 'Agriculture' FROM panel
  UNION ALL SELECT entity, year, round(industry, 4), 'Industry' FROM panel""")
def tagged_union(spark, sf):
    base = panel(spark, sf)
    frames = {
        name.capitalize(): base.select("entity", F.col("year").cast("long").alias("year"), F.round(name, 4).alias("value"))
        for name in ("domestic", "agriculture", "industry")
    }
    return reshape.tagged_union(frames)


@query("complete_cases", PANEL_SQL + """SELECT entity, year::BIGINT AS year, withdrawals, productivity
  FROM panel WHERE withdrawals IS NOT NULL AND productivity IS NOT NULL""")
def complete_cases(spark, sf):
    rows = relations.complete_cases(panel(spark, sf).select("entity", "year", "withdrawals", "productivity"))
    return rows.select("entity", F.col("year").cast("long").alias("year"), "withdrawals", "productivity")


@query("distinct_entities", PANEL_SQL + "SELECT DISTINCT entity, region FROM panel JOIN info USING (entity)")
def distinct_entities(spark, sf):
    return relations.attach(panel(spark, sf).select("entity", "year"), info(spark, sf, "region"), "entity").select("entity", "region").distinct()


@query("key_intersection", """SELECT o_custkey AS entity FROM orders WHERE o_orderstatus = 'F'
  INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def key_intersection(spark, sf):
    tags = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O", "P"))
    return relations.keys_in_all(tags, "o_custkey", "o_orderstatus", 3).select(F.col("o_custkey").alias("entity"))


@query("semi_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_filter(spark, sf):
    rich = table(spark, sf, "customer").where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("o_custkey"))
    return relations.keep_keys(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), rich, "o_custkey")


@query("dimension_left_join", PANEL_SQL + """SELECT entity, year::BIGINT AS year, round(stress, 4) AS stress,
  coalesce(region, 'Unknown') AS region, coalesce(income_group, 'Unknown') AS income_group FROM panel LEFT JOIN info USING (entity)""")
def dimension_left_join(spark, sf):
    rows = panel(spark, sf).select("entity", F.col("year").cast("long").alias("year"), F.round("stress", 4).alias("stress"))
    return relations.attach(rows, info(spark, sf, "region", "income_group"), "entity", fill="Unknown")


@query("inner_merge", PANEL_SQL + """SELECT entity, region, snapshot, round(avg(stress), 4) AS stress FROM panel JOIN info USING (entity)
  GROUP BY entity, region, snapshot""")
def inner_merge(spark, sf):
    means = groupstats.group_means(panel(spark, sf), ["entity"], ["stress"])
    merged = relations.merge(info(spark, sf, "region", "snapshot"), means, "entity")
    return merged.select("entity", "region", "snapshot", F.round("stress", 4).alias("stress"))


@query("multi_join_panel", PANEL_SQL + """SELECT entity, year::BIGINT AS year, population, withdrawals, stress, gdppc, productivity FROM panel""")
def multi_join_panel(spark, sf):
    names = ["population", "withdrawals", "stress", "gdppc", "productivity"]
    # Five long frames meet on (entity, year) in one grouped pivot instead of a chain of joins.
    wide = reshape.to_wide(long_panel(spark, sf, names), ["entity", "year"], "indicator", names, "value")
    return wide.select("entity", F.col("year").cast("long").alias("year"), *names)


@query("fold_left_join", PANEL_SQL + """SELECT entity, round(w, 4) AS withdrawals, round(s, 4) AS late_stress, round(p, 4) AS early_gdppc
  FROM (SELECT entity, avg(withdrawals) AS w FROM panel GROUP BY 1)
  LEFT JOIN (SELECT entity, avg(stress) AS s FROM panel WHERE year >= 2000 GROUP BY 1) USING (entity)
  LEFT JOIN (SELECT entity, avg(gdppc) AS p FROM panel WHERE year <= 1996 GROUP BY 1) USING (entity)""")
def fold_left_join(spark, sf):
    base = panel(spark, sf)
    frames = [
        groupstats.group_means(base, ["entity"], ["withdrawals"]),
        groupstats.group_means(base.where(F.col("year") >= 2000), ["entity"], ["stress"]),
        groupstats.group_means(base.where(F.col("year") <= 1996), ["entity"], ["gdppc"]),
    ]
    joined = relations.fold_left(frames, ["entity"])
    return joined.select("entity", F.round("withdrawals", 4).alias("withdrawals"), F.round("stress", 4).alias("late_stress"), F.round("gdppc", 4).alias("early_gdppc"))


@query("map_join", """SELECT n_name, c AS n_customers, round(b, 4) AS mean_balance FROM nation
  LEFT JOIN (SELECT c_nationkey, count(*) AS c, avg(c_acctbal) AS b FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""")
def map_join(spark, sf):
    values = (
        table(spark, sf, "customer").groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("n_customers"), F.avg("c_acctbal").alias("b"))
    )
    mapped = relations.attach_as(table(spark, sf, "nation"), values, "n_nationkey", "c_nationkey")
    return mapped.select("n_name", "n_customers", F.round("b", 4).alias("mean_balance"))


@query("fold_difference", "SELECT c_custkey AS entity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001)")
def fold_difference(spark, sf):
    late = table(spark, sf, "orders").where(F.year("o_orderdate") == 2001).select(F.col("o_custkey").alias("entity"))
    return relations.drop_keys(table(spark, sf, "customer").select(F.col("c_custkey").alias("entity")), late, "entity")


@query("missing_overall", PANEL_SQL + "SELECT indicator, round(100 * avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END), 2) AS missing_pct FROM long GROUP BY 1")
def missing_overall(spark, sf):
    rates = quality.missing_rates(long_panel(spark, sf), ["indicator"])
    return rates.select("indicator", F.round(F.col("missing") * 100, 2).alias("missing_pct"))


@query("missing_by_year", PANEL_SQL + "SELECT indicator, year::BIGINT AS year, round(100 * avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END), 4) AS missing_pct FROM long GROUP BY 1, 2")
def missing_by_year(spark, sf):
    rates = quality.missing_rates(long_panel(spark, sf), ["indicator", "year"])
    return rates.select("indicator", F.col("year").cast("long").alias("year"), F.round(F.col("missing") * 100, 4).alias("missing_pct"))


@query("missing_by_entity", PANEL_SQL + "SELECT indicator, entity, round(100 * avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END), 4) AS missing_pct FROM long GROUP BY 1, 2")
def missing_by_entity(spark, sf):
    rates = quality.missing_rates(long_panel(spark, sf), ["indicator", "entity"])
    return rates.select("indicator", "entity", F.round(F.col("missing") * 100, 4).alias("missing_pct"))


@query("missing_after_filter", KEPT_SQL + "SELECT indicator, round(100 * avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END), 2) AS missing_pct FROM kept GROUP BY 1")
def missing_after_filter(spark, sf):
    rates = quality.missing_rates(kept(spark, sf), ["indicator"])
    return rates.select("indicator", F.round(F.col("missing") * 100, 2).alias("missing_pct"))


RETENTION_SQL = KEPT_SQL + """, b AS (SELECT indicator, count(*) AS cb, count(value) AS nb FROM long GROUP BY 1),
a AS (SELECT indicator, count(*) AS ca, count(value) AS na FROM kept GROUP BY 1)
"""


@query("cell_retention", RETENTION_SQL + "SELECT indicator, cb AS cells_before, ca AS cells_after, round(ca * 100.0::DOUBLE / cb, 2) AS retained_pct FROM b JOIN a USING (indicator)")
def cell_retention(spark, sf):
    audit = quality.retention(long_panel(spark, sf), kept(spark, sf))
    return audit.select("indicator", "cells_before", "cells_after", F.col("cells_retained_pct").alias("retained_pct"))


@query("nonnull_retention", RETENTION_SQL + "SELECT indicator, nb AS non_null_before, na AS non_null_after, round(na * 100.0::DOUBLE / nb, 2) AS retained_pct FROM b JOIN a USING (indicator)")
def nonnull_retention(spark, sf):
    audit = quality.retention(long_panel(spark, sf), kept(spark, sf))
    return audit.select("indicator", "non_null_before", "non_null_after", F.col("non_null_retained_pct").alias("retained_pct"))


@query("threshold_filter", KEPT_SQL + "SELECT entity, year::BIGINT AS year, indicator, value FROM kept")
def threshold_filter(spark, sf):
    return kept(spark, sf).select("entity", F.col("year").cast("long").alias("year"), "indicator", "value")


@query("impute_category_regression", PANEL_SQL + """, s AS (SELECT entity, region, stress FROM panel LEFT JOIN info USING (entity) WHERE year = 2000)
SELECT entity, region, round(coalesce(stress, CASE WHEN region IS NOT NULL THEN avg(stress) OVER (PARTITION BY region) END), 4) AS stress FROM s""")
def impute_category_regression(spark, sf):
    snap = panel(spark, sf).where(F.col("year") == 2000).select("entity", "stress")
    filled = impute.impute_by_category(relations.attach(snap, info(spark, sf, "region"), "entity"), "stress", "region")
    return filled.select("entity", "region", F.round("stress", 4).alias("stress"))


@query("impute_group_mean", PANEL_SQL + """SELECT entity, year::BIGINT AS year, income_group,
  round(coalesce(gdppc, avg(gdppc) OVER (PARTITION BY income_group, year)), 4) AS gdppc FROM panel JOIN info USING (entity) WHERE year >= 1996""")
def impute_group_mean(spark, sf):
    recent = panel(spark, sf).where(F.col("year") >= 1996).select("entity", "year", "gdppc")
    merged = relations.merge(recent, info(spark, sf, "income_group"), "entity")
    filled = impute.impute_by_group(merged, "gdppc", ["income_group", "year"])
    return filled.select("entity", F.col("year").cast("long").alias("year"), "income_group", F.round("gdppc", 4).alias("gdppc"))


def _indicator(spark, sf, name):
    return panel(spark, sf).select("entity", "year", F.col(name).alias("value"))


def _cells(df, out):
    return df.select("entity", F.col("year").cast("long").alias("year"), F.col("value").alias(out))


@query("derived_product", PANEL_SQL + "SELECT entity, year::BIGINT AS year, productivity * withdrawals AS gdp_usd FROM panel")
def derived_product(spark, sf):
    both = derive.combine(_indicator(spark, sf, "productivity"), _indicator(spark, sf, "withdrawals"), derive.product)
    return _cells(both, "gdp_usd")


@query("derived_ratio", PANEL_SQL + "SELECT entity, year::BIGINT AS year, withdrawals / nullif(stress, 0) * 100 AS available_resources FROM panel")
def derived_ratio(spark, sf):
    both = derive.combine(_indicator(spark, sf, "withdrawals"), _indicator(spark, sf, "stress"), derive.ratio_percent)
    return _cells(both, "available_resources")


@query("derived_total", PANEL_SQL + "SELECT entity, year::BIGINT AS year, gdppc * stress AS gdp_ppp FROM panel")
def derived_total(spark, sf):
    both = derive.combine(_indicator(spark, sf, "gdppc"), _indicator(spark, sf, "stress"), derive.product)
    return _cells(both, "gdp_ppp")


@query("growth_label", PANEL_SQL + """, e AS (SELECT entity, max(CASE WHEN year = 1995 THEN population END) AS a, max(CASE WHEN year = 2000 THEN population END) AS b FROM panel GROUP BY 1)
SELECT entity, round((b - a) / nullif(a, 0) * 100, 4) AS growth_rate, CASE WHEN (b - a) / nullif(a, 0) * 100 < 30 THEN 'Slow_growth' ELSE 'Rapid_growth' END AS label FROM e""")
def growth_label(spark, sf):
    return derive.growth_label(panel(spark, sf), "population", 1995, 2000).withColumn("growth_rate", F.round("growth_rate", 4))


@query("label_counts", PANEL_SQL + """, e AS (SELECT entity, max(CASE WHEN year = 1995 THEN population END) AS a, max(CASE WHEN year = 2000 THEN population END) AS b FROM panel GROUP BY 1)
SELECT CASE WHEN (b - a) / nullif(a, 0) * 100 < 30 THEN 'Slow_growth' ELSE 'Rapid_growth' END AS label, count(*) AS n FROM e GROUP BY 1""")
def label_counts(spark, sf):
    return groupstats.frequencies(derive.growth_label(panel(spark, sf), "population", 1995, 2000), "label")


CUTS_SQL = PANEL_SQL + """, m AS (SELECT entity, avg(population) AS average_population FROM panel GROUP BY 1),
j AS (SELECT p.entity, p.year, p.domestic, m.average_population FROM panel p LEFT JOIN m USING (entity)),
cuts AS (SELECT quantile_cont(average_population, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM j)
"""


def _with_population(spark, sf):
    base = panel(spark, sf)
    means = groupstats.group_means(base, ["entity"], ["population"]).withColumnRenamed("population", "average_population")
    return relations.attach(base.select("entity", "year", "domestic"), means, "entity")


@query("quantile_cuts", CUTS_SQL + "SELECT round(q[1], 3) AS q0, round(q[2], 3) AS q1, round(q[3], 3) AS q2, round(q[4], 3) AS q3, round(q[5], 3) AS q4, round(q[6], 3) AS q5 FROM cuts")
def quantile_cuts(spark, sf):
    from stratapanel.operators.quantiles import exact_quantiles

    cuts = exact_quantiles(_with_population(spark, sf), "average_population", [i / 5 for i in range(6)])
    return cuts.select(*[F.round(c, 3).alias(c) for c in cuts.columns])


@query("quantile_bin_long", CUTS_SQL + """SELECT CASE WHEN average_population < q[1] THEN NULL WHEN average_population <= q[2] THEN 'Very Low' WHEN average_population <= q[3] THEN 'Low'
  WHEN average_population <= q[4] THEN 'Average' WHEN average_population <= q[5] THEN 'High' WHEN average_population <= q[6] THEN 'Very High' END AS population_group,
  year::BIGINT AS year, round(avg(domestic), 4) AS average_domestic_usage, count(*) AS n FROM j, cuts GROUP BY 1, 2""")
def quantile_bin_long(spark, sf):
    joined = _with_population(spark, sf)
    breaks = derive.quantile_breaks(joined, "average_population")
    binned = derive.bin_by_breaks(joined, "average_population", breaks, derive.POPULATION_GROUPS, "population_group")
    return binned.groupBy("population_group", F.col("year").cast("long").alias("year")).agg(
        F.round(F.avg("domestic"), 4).alias("average_domestic_usage"), F.count(F.lit(1)).alias("n")
    )


@query("quantile_bin_entity", PANEL_SQL + """, m AS (SELECT entity, avg(gdppc) AS g, avg(stress) AS s FROM panel GROUP BY 1),
cuts AS (SELECT quantile_cont(g, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM m)
SELECT entity, round(s, 4) AS stress_avg, CASE WHEN g < q[1] THEN NULL WHEN g <= q[2] THEN 'Low' WHEN g <= q[3] THEN 'Lower-Mid' WHEN g <= q[4] THEN 'Mid' WHEN g <= q[5] THEN 'Upper-Mid' WHEN g <= q[6] THEN 'High' END AS gdppc_group FROM m, cuts""")
def quantile_bin_entity(spark, sf):
    means = groupstats.group_means(panel(spark, sf), ["entity"], ["gdppc", "stress"])
    breaks = derive.quantile_breaks(means, "gdppc")
    binned = derive.bin_by_breaks(means, "gdppc", breaks, derive.GDP_GROUPS, "gdppc_group")
    return binned.select("entity", F.round("stress", 4).alias("stress_avg"), "gdppc_group")


@query("log_scatter", PANEL_SQL + """SELECT entity, round(log10(p + 1), 6) AS log_pop_mean, round(log10(w + 1), 6) AS log_withdraw_mean
  FROM (SELECT entity, avg(population) AS p, avg(withdrawals) AS w FROM panel WHERE year BETWEEN 1996 AND 2000 GROUP BY 1)""")
def log_scatter(spark, sf):
    means = groupstats.group_means(panel(spark, sf).where(F.col("year").between(1996, 2000)), ["entity"], ["population", "withdrawals"])
    return means.select("entity", F.round(log10p1("population"), 6).alias("log_pop_mean"), F.round(log10p1("withdrawals"), 6).alias("log_withdraw_mean"))
