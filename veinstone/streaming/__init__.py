"""Evidence units as a stream: JSON-lines files that a running analysis appends to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_units(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Units from JSON-lines files as they appear; lines that do not parse are dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("mode", "DROPMALFORMED").json(folder)


def progress_counts(units: DataFrame) -> DataFrame:
    """Running count of units by phase and kind (for update or complete output)."""
    return units.groupBy("phase", "kind").agg(F.count("*").alias("units"))
