"""Global row numbers in a total order, without a window over one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """rows with a 0-based position in the order.

    A range partitioning deals rows to parts in order; each part numbers its own rows, and the sizes of
    the parts (one number a part reaches the driver) give every part its base.
    """
    # written once: a second run of the range partitioner could cut elsewhere
    parts = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    base, at = [], 0
    for part in sorted(sizes):
        base.append((part, at))
        at += sizes[part]
    starts = F.broadcast(rows.sparkSession.createDataFrame(base, "__part int, __base long"))
    w = Window.partitionBy("__part").orderBy(*order)
    return parts.withColumn("__n", F.row_number().over(w)).join(starts, "__part").withColumn(name, F.col("__base") + F.col("__n") - 1).drop("__part", "__n", "__base")
