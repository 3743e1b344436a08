"""What several text operators need: table access, lineage cuts, expressions bound once, Arrow tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blanks: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns of a table, so that a clash with other columns cannot arise."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset (tests), a folder of this session's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


_open_scratch: list[list[DataFrame]] = []


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and goes on from there; inside of ``scratch`` they go when it ends.

    There the driver also collects garbage, as Spark deletes the shuffle files of a table only when its plan is collected.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _open_scratch:
        _open_scratch[-1].append(out)
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A stretch of work whose ``cut`` tables are deleted when it ends, failed or not; the function it gives cuts a table that stays."""
    shared_folder(spark)
    _open_scratch.append([])
    try:
        yield lambda df: df.checkpoint(eager=True)
    finally:
        for table in _open_scratch.pop():
            if (folder := table._jdf.queryExecution().logical().rdd().getCheckpointFile()).isDefined():
                remove_folder(spark, folder.get())


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a folder not used before, inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of ``new_folder`` once its reader has stored what it needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; none for null or blank."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow form of a short list of ``name type`` pairs; the schema of an Arrow task's output."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([pa.field(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def by_bytes(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``most`` bytes (UTF-8) each; a longer text is a list of its own."""
    batch, size = [], 0
    for text in texts:
        n = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += n
    if batch:
        yield batch
