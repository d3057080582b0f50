"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, through Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, may do without and gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'graphloom-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of values up to which a table is broadcast.
MAX_BROADCAST_BYTES = 32_000_000


def small(df: DataFrame, *columns: str) -> DataFrame:
    """df, to be broadcast if the values of the columns and 32 bytes a row are few bytes in all (both are measured first); else joined by a shuffle."""
    size = df.agg(F.count(F.lit(1)) * 32 + F.coalesce(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= MAX_BROADCAST_BYTES else df


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back, so lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # what is not dropped before goes with the JVM
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes the files behind a DataFrame that stored() returned."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        parent = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if parent.getName().startswith("graphloom-"):
            parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: inside a lambda a plain expression would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, blank: str = r"[\x20\x09-\x0D]+") -> Column:
    """The words between runs of blank, without the empty ones at the ends; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), blank), lambda w: w != "")
