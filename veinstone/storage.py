"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a temporary folder where that is unset.

    On a cluster a machine-local folder would lose data, so an unset folder raises ValueError there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veinstone-"))
    return sc.getCheckpointDir().rstrip("/")


#: Tables that this process has written, in order.
_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veinstone/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, written; the tables that were written to make it are deleted, for nothing reads them any more."""
    before = len(_written)
    out = written(make(), name)
    _delete(out.sparkSession, _written[before:-1])
    del _written[before:-1]
    return out


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Delete all that this library wrote to the shared folder. Results not yet read are lost."""
    _delete(spark, [f"{shared_dir(spark)}/veinstone"])
