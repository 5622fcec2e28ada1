"""Where intermediate files go: the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="papertrail-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: later reads don't depend on executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/papertrail-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """For forget(): what stored() writes from here on."""
    return len(_stored)


def forget(spark: SparkSession, since: int = 0, *, but_last: bool = False) -> None:
    """Delete what stored() has written in this session (since a mark; all but the last of it): call it when no result
    still reads it."""
    gone = _stored[since : len(_stored) - but_last]
    _stored[since : len(_stored) - but_last] = []
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has fewer partitions than that, as a file of one row group has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
