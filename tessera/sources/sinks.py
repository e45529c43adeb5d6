"""Results as files: manifests, completion records, image chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity


def write_manifests(rows: DataFrame, path: str, keys: list[str], entry) -> None:
    """One JSON line for each output; Spark's commit makes them appear together or not at all."""
    integrity.manifest(rows, keys, entry).select("manifest").write.mode("overwrite").text(path)


def record(state: DataFrame, path: str) -> None:
    """Adds completion records (ota, name, sha256, verified, at) to a state table."""
    state.write.mode("append").parquet(path)


def completed(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each output that a state table has."""
    return integrity.latest_record(spark.read.parquet(path), ["ota", "name"], ["at"])


def write_chunks(chunks: DataFrame, path: str) -> None:
    """(image, off, data) as a table partitioned by image, in order of offset within files; all-zero chunks are holes and
    left out."""
    full = chunks.filter(F.rtrim(F.hex("data"), F.lit("0")) != "")
    full.repartition("image").sortWithinPartitions("image", "off").write.mode("overwrite").partitionBy("image").parquet(path)


def pending_chunks(chunks: DataFrame, written: DataFrame) -> DataFrame:
    """Chunks that an interrupted copy hasn't written yet."""
    return chunks.join(written.select("image", "off"), ["image", "off"], "left_anti")
