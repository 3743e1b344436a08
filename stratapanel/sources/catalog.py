"""Named datasets on disk: one parquet directory per name, one partition per indicator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}")


def load_catalog(spark: SparkSession, directory: str, names: Iterable[str], suffix: str = "") -> dict[str, DataFrame]:
    """Register each dataset under its base name as a temporary view, and return the frames."""
    frames = {}
    for name in names:
        frames[name] = spark.read.parquet(f"{directory}/{name}{suffix}")
        frames[name].createOrReplaceTempView(name)
    return frames


def list_catalog(spark: SparkSession, directory: str) -> list[str]:
    """Base names in a catalog folder, seen through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(directory)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(name.removesuffix(".parquet") for name in names if not name.startswith(("_", ".")))


def save_catalog(frames: dict[str, DataFrame], directory: str) -> None:
    """Write every frame under its name, replacing an older one."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{directory}/{name}")


def save_long_panel(panel: DataFrame, path: str) -> None:
    """Store a long panel by indicator, so that a reader of few indicators skips the rest.

    The rows are spread over many tasks per indicator first: one indicator may hold most rows.
    """
    panel.repartition("indicator", "entity").write.mode("overwrite").partitionBy("indicator").parquet(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)
