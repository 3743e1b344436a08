import math

import pytest
from pyspark.sql import functions as F

from stratapanel.operators import derive, groupstats, impute, quality, relations, reshape


@pytest.fixture(scope="module")
def wide(spark):
    rows = [("a", 1.0, None, 3.0), ("b", math.nan, 5.0, 6.0), ("c", None, None, None)]
    return spark.createDataFrame(rows, "entity string, X1994 double, X1995 double, X1996 double")


def test_long_and_back(wide):
    long = reshape.years_to_long(wide, ["entity"])
    assert long.count() == 9 and long.where("value is null").count() == 5
    back = reshape.to_wide(long, ["entity"], "year", [1994, 1995, 1996], "value")
    assert {r["entity"]: r["1996"] for r in back.collect()} == {"a": 3.0, "b": 6.0, "c": None}
    assert reshape.years_to_long(wide, ["entity"], first=1995, last=1995).count() == 3


def test_column_selection(wide):
    assert reshape.columns_like(wide, "X", ("95", "96"), ["entity"]).columns == ["entity", "X1995", "X1996"]
    assert reshape.column_range(wide, "X1994", "X1995").columns == ["X1994", "X1995"]
    assert reshape.year_columns(wide, 1995) == ["X1995", "X1996"]


def test_presence_and_rates(wide):
    long = reshape.years_to_long(wide, ["entity"]).withColumn("indicator", F.lit("i"))
    assert {r[0]: r[1] for r in impute.presence_label(long).collect()} == {"a": 1, "b": 1, "c": 0}
    by_entity = {r["entity"]: r["missing"] for r in quality.missing_rates(long, ["entity"]).collect()}
    assert by_entity == {"a": pytest.approx(1 / 3), "b": pytest.approx(1 / 3), "c": 1.0}


def test_threshold_uses_the_raw_panel(spark):
    cells = [("i", e, y, None if (e, y) in {("a", 1), ("b", 1), ("b", 2)} else 1.0) for e in "abc" for y in (1, 2, 3)]
    cells += [("j", e, y, 1.0) for e in "abc" for y in (1, 2, 3)]
    panel = spark.createDataFrame(cells, "indicator string, entity string, year int, value double")
    kept = quality.threshold_filter(panel, 2, year_limit=0.5, entity_limit=0.5)
    # Year 1 has two of three missing and entity b two of three; a keeps its place though year 1 goes.
    assert {(r.entity, r.year) for r in kept.select("entity", "year").distinct().collect()} == {
        (e, y) for e in "ac" for y in (2, 3)
    }
    audit = {r.indicator: r for r in quality.retention(panel, kept).collect()}
    assert (audit["i"].cells_before, audit["i"].cells_after, audit["i"].cells_retained_pct) == (9, 4, 44.44)
    assert (audit["i"].non_null_before, audit["i"].non_null_after) == (6, 4)


def test_retention_of_a_dropped_indicator(spark):
    panel = spark.createDataFrame([("i", 1.0), ("j", None)], "indicator string, value double")
    audit = {r.indicator: r for r in quality.retention(panel, panel.where("indicator = 'i'")).collect()}
    assert audit["j"].cells_after == 0 and audit["j"].non_null_retained_pct is None


def test_category_imputation_skips_unknown_category(spark):
    df = spark.createDataFrame(
        [(1, "x", 1.0), (2, "x", None), (3, None, None), (4, "y", None), (5, None, 9.0)], "k int, r string, v double"
    )
    got = {r.k: r.v for r in impute.impute_by_category(df, "v", "r").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: None, 5: 9.0}


def test_group_imputation_treats_missing_group_as_group(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None), (3, "g", None)], "k int, g string, v double")
    got = {r.k: r.v for r in impute.impute_by_group(df, "v", ["g"]).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: None}


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("z", 2)], "entity string, v int")
    dim = spark.createDataFrame([("a", "R"), ("b", "S")], "entity string, region string")
    assert {r.region for r in relations.attach(left, dim, "entity", fill="Unknown").collect()} == {"R", "Unknown"}
    assert relations.merge(left, dim, "entity").count() == 1
    assert relations.drop_keys(left, dim, "entity").first().entity == "z"
    assert relations.keep_keys(left, dim, "entity").first().entity == "a"
    assert relations.attach_as(dim, left.withColumnRenamed("entity", "code"), "entity", "code").count() == 2
    tags = spark.createDataFrame([("a", "i"), ("a", "j"), ("b", "i"), ("a", "i")], "entity string, tag string")
    assert [r.entity for r in relations.keys_in_all(tags, "entity", "tag", 2).collect()] == ["a"]


def test_derived_indicators(spark):
    a = spark.createDataFrame([("a", 1, 6.0), ("b", 1, 6.0)], "entity string, year int, value double")
    b = spark.createDataFrame([("b", 1, 0.0), ("a", 1, 3.0)], "entity string, year int, value double")
    got = {r.entity: r.value for r in derive.combine(a, b, derive.ratio_percent).collect()}
    assert got == {"a": 200.0, "b": None}
    assert {r.entity: r.value for r in derive.combine(a, b, derive.product).collect()} == {"a": 18.0, "b": 0.0}


def test_growth_label_of_missing_growth_is_rapid(spark):
    rows = [("a", 1, 100.0), ("a", 2, 129.0), ("b", 1, 100.0), ("b", 2, 130.0), ("c", 1, None), ("c", 2, 1.0), ("d", 1, 0.0), ("d", 2, 1.0), ("e", 7, 1.0)]
    df = spark.createDataFrame(rows, "entity string, year int, v double")
    got = {r.entity: r.label for r in derive.growth_label(df, "v", 1, 2).collect()}
    assert got == {"a": "Slow_growth", "b": "Rapid_growth", "c": "Rapid_growth", "d": "Rapid_growth", "e": "Rapid_growth"}


def test_snapshot_and_tags(spark):
    df = spark.createDataFrame([("a", 2009, 1.0), ("a", 2010, 2.0)], "entity string, year int, v double")
    snap = reshape.relabel_snapshot(df, 2009, 2000)
    assert [(r.year, r.v) for r in snap.collect()] == [(2000, 1.0)]
    assert [r.year for r in reshape.spread_snapshot(snap, 2012, 2014).collect()] == [2012, 2013, 2014]
    assert {r.category for r in reshape.tagged_union({"x": df, "y": df}).collect()} == {"x", "y"}


def test_group_statistics_edges(spark):
    df = spark.createDataFrame([("g", "a", 1, 2.0), (None, "b", 1, 4.0), (None, "b", 1, 4.0)], "g string, m string, year int, v double")
    counts = {r.g: r.n for r in groupstats.distinct_members(df, ["g"], "m").collect()}
    assert counts == {"g": 1, None: 1}
    summary = {r.g: r for r in groupstats.two_level_summary(df, "m", "g", "v").collect()}
    assert summary[None].median == 4.0 and summary["g"].max == 2.0
    block = groupstats.entity_features(df, ["v"], "m").where("m = 'a'").first()
    assert block.v_sd is None and block.v_slope is None and block.v_mean == 2.0
    assert groupstats.group_sums(df, "g", "v").collect() == [("g", 2.0)]
    assert groupstats.frequencies(df, "g").collect() == [("g", 1)]
    yearly = groupstats.group_means(df, ["g", "year"], ["v"])
    sizes = groupstats.distinct_members(df, ["g"], "m")
    overall = groupstats.weighted_overall_mean(yearly, sizes, "g", "v", "n").collect()
    assert {r.overall_mean for r in overall} == {3.0} and len(overall) == 2


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 30.0), (1.0, 15.0)], "c double, v double")
    got = {(r.feature, r.bin): r.n for r in groupstats.histogram(df, ["c", "v"]).collect()}
    assert got == {("c", 1): 3, ("v", 1): 1, ("v", 16): 1, ("v", 30): 1}


def test_the_panel_is_made_in_parts_that_follow_the_tables(spark, tmp_path, monkeypatch):
    """Customers of one file and orders of few shuffle partitions are dealt out; the years of an entity stay in one part."""
    from stratapanel.plans import panel

    monkeypatch.setattr(panel, "CELLS_PER_TASK", 40)
    monkeypatch.setattr(panel, "ORDERS_PER_TASK", 10)
    people = [(k,) for k in range(100)] + [(None,), (7,)]
    orders = [(k, k % 90, f"{1994 + k % 3}-05-01", 10.0 + k) for k in range(200)] + [(None, 3, "1995-01-01", 5.0), (500, None, "1996-01-01", 6.0)]
    items = [(k % 150, 1.0 + k, 100.0 + k, "ANR"[k % 3]) for k in range(600)] + [(None, 9.0, 9.0, "A")]
    for name, rows, schema in (("customer", people, "c_custkey long"), ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double"), ("lineitem", items, "l_orderkey long, l_quantity double, l_extendedprice double, l_returnflag string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    found = panel.build_panel(spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).collect()
    assert len(found) == 101 * 3 and len({r.part for r in found}) > 4
    parts = {}
    for r in found:
        parts.setdefault(r.entity, set()).add(r.part)
        mine = [o for o in orders if o[1] == r.entity and o[2].startswith(str(r.year))]
        lines = [i for i in items if i[0] is not None and i[0] in {o[0] for o in mine}]
        price = sum(i[2] for i in lines)
        assert r.withdrawals == (pytest.approx(sum(o[3] for o in mine)) if mine else None)
        assert r.stress == (pytest.approx(sum(i[1] for i in lines)) if lines else None)
        assert r.population == (pytest.approx(price) if lines else None)
        assert r.agriculture == (pytest.approx(100 * sum(i[2] for i in lines if i[3] == "A") / price) if lines else None)
    assert all(len(p) == 1 for p in parts.values())


def test_a_wide_table_takes_one_shuffle(spark, capsys):
    rows = [(1, "a", None), (1, "a", 2.0), (1, "b", 3.0), (None, "b", 4.0), (2, "c", 5.0), (3, None, 6.0)]
    wide = reshape.to_wide(spark.createDataFrame(rows, "k long, name string, value double"), ["k"], "name", ["a", "b"], "value")
    assert sorted(map(tuple, wide.collect()), key=str) == sorted([(1, 2.0, 3.0), (None, None, 4.0), (2, None, None), (3, None, None)], key=str)
    capsys.readouterr()
    wide.explain()
    assert capsys.readouterr().out.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
