"""Tables between steps: lineage and plans are cut by a table in the cluster's shared folder.

An operator writes a table only where its result is read more than once. `release` deletes what an application
wrote, when its results have been read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def application_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, as a URI.

    Where that is unset, a local master gets a temporary one, set for the session; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siteloom-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for what `name` says, as a URI."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read back: what follows reads it as often as it likes and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spent(*tables: DataFrame) -> None:
    """Deletes tables that `cut` gave and that nothing will read again; what was written from them stays."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has cut; results that still read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
