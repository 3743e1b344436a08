import csv

import pytest
from pyspark.sql import functions as F

from stratapanel.operators.reshape import year_columns, years_to_long
from stratapanel.session import materialize, shared_root
from stratapanel.sources import catalog, csv_panels

PANEL = '''"Data Source","Invented Indicators",

"Last Updated Date","2025-01-01",

"Country Name","Country Code","Indicator Name","Indicator Code","1994","1995","1996",
"Aland, North","ALN","Use, total","U.TOT","1.5","","3",
"Borduria","BOR","Use, total","U.TOT","","","",
"Syldavia","SYL","Use, total","U.TOT","2e2","7","-1.25",
'''
DIMENSION = '''"Country Code","Region","IncomeGroup","Notes"
"ALN","North","High income","x"
"BOR","","Low income",""
"WLD","","","all"
'''


def test_indicator_file(spark, tmp_path):
    path = tmp_path / "use.csv"
    path.write_text(PANEL, encoding="utf-8")
    wide = csv_panels.read_indicator_csv(spark, str(path))
    assert wide.columns == ["Country.Name", "Country.Code", "Indicator.Name", "Indicator.Code", "X1994", "X1995", "X1996"]
    rows = {r["Country.Code"]: r for r in wide.collect()}
    assert set(rows) == {"ALN", "BOR", "SYL"} and rows["ALN"]["Country.Name"] == "Aland, North"
    assert (rows["ALN"].X1994, rows["ALN"].X1995, rows["SYL"].X1994, rows["SYL"].X1996) == (1.5, None, 200.0, -1.25)
    assert year_columns(wide) == ["X1994", "X1995", "X1996"]
    long = years_to_long(wide.withColumnRenamed("Country.Code", "entity"), ["entity"])
    assert long.count() == 9 and long.where("value is not null").count() == 5


def test_folder_of_files_with_different_headers(spark, tmp_path):
    head = '"Country Name","Country Code","Indicator Name","Indicator Code",'
    (tmp_path / "one.csv").write_text(head + '"1994","1995",\n"A","AAA","I","I.1","1","2",\n')
    (tmp_path / "two.csv").write_text("".join(f'"note {k}"\n' for k in range(30)) + head + '"1995","1996",\n"B","BBB","I","I.1","3","4",\n')
    wide = csv_panels.read_indicator_csv(spark, str(tmp_path))
    rows = {r["Country.Code"]: (r.X1994, r.X1995, r.X1996) for r in wide.collect()}
    assert rows == {"AAA": (1.0, 2.0, None), "BBB": (None, 3.0, 4.0)}


def test_file_without_header_is_refused(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        csv_panels.read_indicator_csv(spark, str(path))


def test_dimension_blanks(spark, tmp_path):
    path = tmp_path / "info.csv"
    path.write_text(DIMENSION)
    rows = {r["Country.Code"]: (r.Region, r.IncomeGroup) for r in csv_panels.read_dimension_csv(spark, str(path)).collect()}
    assert rows == {"ALN": ("North", "High income"), "BOR": (None, "Low income"), "WLD": (None, None)}
    kept = csv_panels.read_dimension_csv(spark, str(path), blanks_as_null=False).where("Region = ''")
    assert kept.count() == 2


def test_catalog_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1.0)], "entity string, v double")
    catalog.save_catalog({"first": frame, "second": frame}, str(tmp_path))
    assert catalog.list_catalog(spark, str(tmp_path)) == ["first", "second"]
    loaded = catalog.load_catalog(spark, str(tmp_path), ["first", "second"])
    assert loaded["first"].collect() == frame.collect() and spark.table("second").count() == 1
    assert catalog.load_table(spark, str(tmp_path), "first").count() == 1


def test_long_panel_is_pruned_by_indicator(spark, tmp_path):
    rows = [("a", 1, i, 1.0) for i in ("x", "y")]
    path = str(tmp_path / "long")
    catalog.save_long_panel(spark.createDataFrame(rows, "entity string, year int, indicator string, value double"), path)
    one = spark.read.parquet(path).where("indicator = 'x'")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(indicator" in one._jdf.queryExecution().toString()


def test_csv_sink_writes_arrays_as_json(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2])], "k string, labels array<int>")
    csv_panels.write_csv(df, str(tmp_path / "out"))
    rows = []
    for part in (tmp_path / "out").glob("part-*.csv"):
        with open(part, newline="") as f:
            rows += list(csv.reader(f, escapechar="\\"))
    assert ["k", "labels"] in rows and ["a", "[1,2]"] in rows


def test_materialize_cuts_lineage_into_the_shared_folder(spark):
    df = materialize(spark.range(5).withColumn("x", F.col("id") * 2), "unit")
    assert df.count() == 5 and df.inputFiles()[0].replace("file://", "").startswith(shared_root(spark))
