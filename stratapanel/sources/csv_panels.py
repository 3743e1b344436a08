"""CSV files of yearly indicators: a preamble, a header with year columns, an empty last column."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stratapanel.functions.columns import blank_to_null

def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header lines by their text, with the files that have them; a header names the code of country and indicator."""
    lines = spark.read.text(path).select("value", "_metadata.file_path")
    found: dict[str, list[str]] = {}
    heads = lines.where(F.col("value").contains("Country Code") & F.col("value").contains("Indicator Code"))
    for row in heads.distinct().orderBy("file_path").collect():
        found.setdefault(row["value"], []).append(row["file_path"])
    if not found:
        raise ValueError(f"no header with a Country Code column in {path}")
    return found


def read_indicator_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide panel from one file or folder of files, whose headers may differ.

    The files are split and parsed in parallel: the preamble and header lines are recognised by
    content, since the CSV reader cannot skip a number of lines. Years become ``X<year>``; a year
    that a file lacks is NULL in its rows.
    """
    parts = [_read_files(spark, header, files) for header, files in _headers(spark, path).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _read_files(spark: SparkSession, header: str, files: list[str]) -> DataFrame:
    names = next(csv.reader([header.lstrip("\ufeff")]))
    fields = []
    for name in names:
        if name.isdigit():
            fields.append(T.StructField(f"X{name}", T.DoubleType()))
        elif name:
            fields.append(T.StructField(name.replace(" ", "."), T.StringType()))
        else:
            fields.append(T.StructField("__empty", T.StringType()))
    if not names[-1] == "":
        fields.append(T.StructField("__empty", T.StringType()))
    schema = T.StructType(fields)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    lines = spark.read.text(files).where(F.col("value") != header)
    parsed = lines.select(F.from_csv("value", ddl, {"mode": "PERMISSIVE"}).alias("row")).select(
        *[F.col("row")[f.name].alias(f.name) for f in schema.fields if f.name != "__empty"]
    )
    # Preamble lines have no indicator code in the fourth field.
    return parsed.where(blank_to_null(F.col("`Indicator.Code`")).isNotNull())


def read_dimension_csv(spark: SparkSession, path: str, blanks_as_null: bool = True) -> DataFrame:
    """Entity dimension with code, region and income group; blank strings become NULL."""
    raw = spark.read.option("header", True).csv(path)
    names = {name: name.replace(" ", ".").lstrip("﻿") for name in raw.columns}
    frame = raw.toDF(*names.values()).select(F.col("`Country.Code`"), "Region", "IncomeGroup")
    if blanks_as_null:
        return frame.withColumns({c: blank_to_null(c) for c in ("Region", "IncomeGroup")})
    return frame.fillna("", subset=["Region", "IncomeGroup"])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; array and struct columns are written as JSON text."""
    columns = [
        F.to_json(f.name).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)
