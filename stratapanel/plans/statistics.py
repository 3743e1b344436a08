"""Grouped statistics over the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapanel.operators import groupstats, impute, relations
from stratapanel.plans.panel import PANEL_SQL, info, long_panel, panel
from stratapanel.plans.preparation import KEPT_SQL, kept
from stratapanel.plans.registry import query


def _grouped(spark, sf, columns, attributes=("income_group",)):
    return relations.attach(panel(spark, sf).select("entity", "year", *columns), info(spark, sf, *attributes), "entity")


def _year(name: str = "year"):
    return F.col(name).cast("long").alias(name)


@query("flagship", KEPT_SQL + """, g AS (SELECT k.indicator, k.entity, k.year, i.income_group, k.value FROM kept k JOIN info i USING (entity)),
f AS (SELECT *, coalesce(value, avg(value) OVER (PARTITION BY indicator, income_group, year)) AS filled FROM g)
SELECT indicator, income_group, year::BIGINT AS year, round(avg(filled), 3) AS mean_value, count(*) AS n FROM f GROUP BY 1, 2, 3""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold filter, group-mean imputation per year, then mean by group and year."""
    grouped = relations.merge(kept(spark, sf), info(spark, sf, "income_group"), "entity")
    filled = impute.impute_by_group(grouped, "value", ["indicator", "income_group", "year"])
    return filled.groupBy("indicator", "income_group", _year()).agg(
        F.round(F.avg("value"), 3).alias("mean_value"), F.count(F.lit(1)).alias("n")
    )


@query("group_year_mean", PANEL_SQL + "SELECT region, year::BIGINT AS year, round(avg(domestic), 4) AS average_usage FROM panel JOIN info USING (entity) GROUP BY 1, 2")
def group_year_mean(spark, sf):
    means = groupstats.group_means(_grouped(spark, sf, ["domestic"], ["region"]), ["region", "year"], ["domestic"])
    return means.select("region", _year(), F.round("domestic", 4).alias("average_usage"))


@query("group_year_category_mean", PANEL_SQL + """SELECT income_group, year::BIGINT AS year, indicator AS category, round(avg(value), 4) AS average_usage
  FROM long JOIN info USING (entity) WHERE indicator IN ('domestic', 'agriculture', 'industry') GROUP BY 1, 2, 3""")
def group_year_category_mean(spark, sf):
    long = long_panel(spark, sf, ["domestic", "agriculture", "industry"])
    rows = relations.attach(long, info(spark, sf, "income_group"), "entity")
    means = groupstats.group_means(rows, ["income_group", "year", "indicator"], ["value"])
    return means.select("income_group", _year(), F.col("indicator").alias("category"), F.round("value", 4).alias("average_usage"))


@query("geomean_group_year", PANEL_SQL + """SELECT income_group, year::BIGINT AS year,
  round(CASE WHEN max(CASE WHEN domestic = 0 THEN 1 ELSE 0 END) = 1 THEN 0 ELSE exp(avg(CASE WHEN domestic > 0 THEN ln(domestic) END)) END, 4) AS geomean_domestic,
  round(CASE WHEN max(CASE WHEN stress = 0 THEN 1 ELSE 0 END) = 1 THEN 0 ELSE exp(avg(CASE WHEN stress > 0 THEN ln(stress) END)) END, 4) AS geomean_stress
  FROM panel JOIN info USING (entity) GROUP BY 1, 2""")
def geomean_group_year(spark, sf):
    rows = _grouped(spark, sf, ["domestic", "stress"])
    means = rows.groupBy("income_group", "year").agg(*[groupstats.geometric_mean(c).alias(f"geomean_{c}") for c in ("domestic", "stress")])
    return means.select("income_group", _year(), F.round("geomean_domestic", 4).alias("geomean_domestic"), F.round("geomean_stress", 4).alias("geomean_stress"))


@query("geomean_shifted_entity", PANEL_SQL + "SELECT entity, round(exp(avg(ln(domestic + 1))) - 1, 4) AS geomean FROM panel GROUP BY 1")
def geomean_shifted_entity(spark, sf):
    means = groupstats.group_shifted_geometric_means(panel(spark, sf), ["entity"], "domestic", "geomean")
    return means.withColumn("geomean", F.round("geomean", 4))


@query("entity_mean", PANEL_SQL + "SELECT entity, round(avg(withdrawals), 4) AS withdrawals, round(avg(stress), 4) AS stress, round(avg(gdppc), 4) AS gdppc FROM panel GROUP BY 1")
def entity_mean(spark, sf):
    names = ["withdrawals", "stress", "gdppc"]
    means = groupstats.group_means(panel(spark, sf), ["entity"], names)
    return means.select("entity", *[F.round(n, 4).alias(n) for n in names])


@query("entity_feature_block", PANEL_SQL + """SELECT entity, round(avg(stress), 4) AS stress_mean, round(stddev_samp(stress), 4) AS stress_sd, min(stress) AS stress_min,
  max(stress) AS stress_max, round(CASE WHEN count(stress) > 1 THEN regr_slope(stress, year) END, 4) AS stress_slope FROM panel GROUP BY 1""")
def entity_feature_block(spark, sf):
    block = groupstats.entity_features(panel(spark, sf), ["stress"])
    rounded = {c: F.round(c, 4) for c in ("stress_mean", "stress_sd", "stress_slope")}
    return block.withColumns(rounded)


@query("two_level_summary", PANEL_SQL + """, e AS (SELECT entity, income_group, avg(stress) AS m FROM panel JOIN info USING (entity) GROUP BY 1, 2)
SELECT income_group, round(avg(m), 4) AS mean, round(max(m), 4) AS max, round(min(m), 4) AS min, round(quantile_cont(m, 0.5), 4) AS median FROM e GROUP BY 1""")
def two_level_summary(spark, sf):
    summary = groupstats.two_level_summary(_grouped(spark, sf, ["stress"]), "entity", "income_group", "stress")
    return summary.select("income_group", *[F.round(c, 4).alias(c) for c in ("mean", "max", "min", "median")])


@query("distinct_count_group", PANEL_SQL + "SELECT income_group, count(DISTINCT entity) AS n FROM panel JOIN info USING (entity) GROUP BY 1")
def distinct_count_group(spark, sf):
    return groupstats.distinct_members(_grouped(spark, sf, []), ["income_group"], "entity")


@query("weighted_overall_mean", PANEL_SQL + """, g AS (SELECT income_group, year, avg(domestic) AS year_mean FROM panel JOIN info USING (entity) GROUP BY 1, 2),
c AS (SELECT income_group, count(DISTINCT entity) AS n FROM info GROUP BY 1),
o AS (SELECT year, sum(year_mean * n) / sum(CASE WHEN year_mean IS NOT NULL THEN n END) AS overall_mean FROM g JOIN c USING (income_group) GROUP BY 1)
SELECT income_group, year::BIGINT AS year, round(year_mean, 4) AS year_mean, round(overall_mean, 4) AS overall_mean FROM g JOIN o USING (year) ORDER BY 1 NULLS FIRST, 2""")
def weighted_overall_mean(spark, sf):
    rows = _grouped(spark, sf, ["domestic"])
    by_group = groupstats.group_means(rows, ["income_group", "year"], ["domestic"]).withColumnRenamed("domestic", "year_mean")
    sizes = groupstats.distinct_members(rows, ["income_group"], "entity")
    final = groupstats.weighted_overall_mean(by_group, sizes, "income_group", "year_mean", "n")
    return final.select("income_group", _year(), F.round("year_mean", 4).alias("year_mean"), F.round("overall_mean", 4).alias("overall_mean")).orderBy("income_group", "year")


@query("group_sum_desc", PANEL_SQL + "SELECT region, round(sum(snapshot), 2) AS total FROM info WHERE region IS NOT NULL AND snapshot IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1")
def group_sum_desc(spark, sf):
    return groupstats.group_sums(info(spark, sf), "region", "snapshot").withColumn("total", F.round("total", 2))


@query("multi_col_means", PANEL_SQL + """SELECT income_group, round(avg(population), 3) AS population, round(avg(withdrawals), 3) AS withdrawals, round(avg(stress), 4) AS stress,
  round(avg(gdppc), 3) AS gdppc, round(avg(productivity), 3) AS productivity FROM panel JOIN info USING (entity) GROUP BY 1""")
def multi_col_means(spark, sf):
    names = ["population", "withdrawals", "stress", "gdppc", "productivity"]
    means = groupstats.group_means(_grouped(spark, sf, names), ["income_group"], names)
    return means.select("income_group", *[F.round(n, 4 if n == "stress" else 3).alias(n) for n in names])


PAIRS = {f"r_{a}_{b}": (a, b) for a in ("population", "gdppc") for b in ("stress", "withdrawals", "productivity")}


def _sql_corr(a: str, b: str) -> str:
    return f"round(CASE WHEN NOT isnan(corr({a}, {b})) THEN corr({a}, {b}) END, 6)"


@query("group_correlations", PANEL_SQL + "SELECT income_group, " + ", ".join(f"{_sql_corr(a, b)} AS {n}" for n, (a, b) in PAIRS.items()) + " FROM panel JOIN info USING (entity) GROUP BY 1")
def group_correlations(spark, sf):
    rows = _grouped(spark, sf, ["population", "withdrawals", "stress", "gdppc", "productivity"])
    result = groupstats.correlations(rows, ["income_group"], PAIRS)
    return result.select("income_group", *[F.round(n, 6).alias(n) for n in PAIRS])


MATRIX = ["population", "withdrawals", "stress", "gdppc", "productivity"]


@query("correlation_matrix", PANEL_SQL + """, h AS (SELECT panel.* FROM panel JOIN info USING (entity) WHERE income_group = 'BUILDING' AND population IS NOT NULL AND withdrawals IS NOT NULL
  AND stress IS NOT NULL AND gdppc IS NOT NULL AND productivity IS NOT NULL)
""" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_sql_corr(a, b)} AS correlation FROM h" for i, a in enumerate(MATRIX) for b in MATRIX[i + 1:]))
def correlation_matrix(spark, sf):
    rows = _grouped(spark, sf, MATRIX).where(F.col("income_group") == "BUILDING")
    return groupstats.correlation_matrix(rows, MATRIX).withColumn("correlation", F.round("correlation", 6))


@query("histogram_30", PANEL_SQL + """, l AS (SELECT indicator AS feature, value AS x FROM long WHERE indicator IN ('stress', 'domestic', 'gdppc') AND value IS NOT NULL),
m AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1)
SELECT feature, least(floor((x - lo) / (hi - lo) * 30) + 1, 30)::BIGINT AS bin, count(*) AS n FROM l JOIN m USING (feature) GROUP BY 1, 2""")
def histogram_30(spark, sf):
    bins = groupstats.histogram(panel(spark, sf), ["stress", "domestic", "gdppc"])
    return bins.withColumn("bin", F.col("bin").cast("long"))


@query("boxplot_stats", PANEL_SQL + """, e AS (SELECT income_group, avg(stress) AS v FROM panel JOIN info USING (entity) GROUP BY entity, income_group HAVING avg(stress) IS NOT NULL),
b AS (SELECT income_group, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM e GROUP BY 1)
SELECT income_group, round(min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 4) AS whisker_low, round(any_value(q1), 4) AS lower,
  round(any_value(q2), 4) AS middle, round(any_value(q3), 4) AS upper,
  round(max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 4) AS whisker_high,
  sum(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END)::BIGINT AS n_outliers FROM e JOIN b USING (income_group) GROUP BY 1""")
def boxplot_stats(spark, sf):
    means = groupstats.group_means(_grouped(spark, sf, ["stress"]), ["entity", "income_group"], ["stress"])
    boxes = groupstats.box_stats(means, "income_group", "stress")
    names = ["whisker_low", "lower", "middle", "upper", "whisker_high"]
    return boxes.select("income_group", *[F.round(n, 4).alias(n) for n in names], "n_outliers")
