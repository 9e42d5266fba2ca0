"""Tables that cut lineage: written once to shared storage and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a local folder is made and
    set, so that every later caller of the session sees the same one; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kelpie-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new path under the shared folder, which goes when the application ends."""
    path = f"{scratch_dir(spark)}/kelpie-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    One write computes the plan once (an eager ``checkpoint()`` runs its last stage twice),
    survives lost executors, and goes when the application ends.
    """
    spark = df.sparkSession
    path = folder(spark)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kelpie_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`cut` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_kelpie_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
