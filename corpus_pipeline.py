"""From raw documents to token files: the text operators in a row, each stage over all that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import decontaminate, mixing, near_duplicates, quality_rules, token_ids
from stratapanel.llm.common import BLANKS, cut, new_folder, remove_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps."""
    return quality_rules.passing(docs, quality_rules.PRODUCTION)


def _fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document of the smallest id; rows of one id stay or go together.

    Documents without id come after all others, by a hash of their text, and of equal ones among them one stays.
    Null, empty and blank texts stay; extra columns are passed on, whatever their names.
    """
    key = _fresh("key")
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS)) == ""
    keyed = docs.withColumn(key, F.coalesce("doc_id", F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))))
    gone = near_duplicates.near_duplicates(keyed, id_col=key).filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    left = keyed.join(gone, key, "left_anti")
    nameless = F.col("doc_id").isNull() & ~blank
    return left.filter(~nameless).union(left.filter(nameless).dropDuplicates([key])).drop(key)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return docs.filter(~decontaminate.contaminated(spark, table(spark, sf_dir, "benchmark", "item_id", "text"), F.col("text")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows of one id, or without id, are taken alike.

    Null, empty and blank texts have no words and take nothing of a target; extra columns are passed on, whatever their names.
    """
    taken_id, copies, copy = _fresh("id"), _fresh("copies"), _fresh("copy")
    taken = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias(taken_id)).agg(F.max("copies").cast("int").alias(copies)).filter(F.col(copies) > 0)
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(F.col(taken_id)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(taken_id, copies, copy)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns their index as read back; the files of this run are then removed."""
    folder = new_folder(spark, "token-ids")
    try:
        manifest = token_ids.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
        return cut(token_ids.read_token_files(manifest, folder))
    finally:
        remove_folder(spark, folder)


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token ids", write_ids),
]

#: Tokens cannot be counted in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read by the next."""
    docs, folders = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    try:
        for name, stage in STAGES[:-1]:
            folders.append(new_folder(spark, name.replace(" ", "-")))
            stage(spark, docs, sf_dir).write.parquet(folders[-1])
            docs = spark.read.parquet(folders[-1])
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        for folder in folders:
            remove_folder(spark, folder)
