"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: \x20 and \x09-\x0D, which is also what bytes.split() takes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for written intermediates, below the cluster's shared spark.checkpoint.dir.

    Only a session on one machine can do without that setting, as tests do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="postern-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: computed once, and read again by whatever survives."""
    return written_at(df, label, codec)[0]


def written_at(df: DataFrame, label: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """As written(), with the folder, for tables that can go before the query ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def settled(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that have ended: it does so when the driver's JVM collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, 64 bits; maps and variants, which have none, count as their text."""
    quoted = [(F.col(f"`{c.replace('`', '``')}`"), t) for c, t in df.dtypes]
    return F.xxhash64(*(c.cast("string") if "map<" in t or "variant" in t else c for c, t in quoted))
