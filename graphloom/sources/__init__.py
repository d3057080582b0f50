"""File sources: rows of CSV (all strings), Parquet and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", quote: str = '"', ignore_bad: bool = False, null_if: str | None = None) -> DataFrame:
    """Every value is a string; an empty field is an empty string unless it equals null_if."""
    rows = spark.read.csv(path, header=header, sep=delimiter, quote=quote, nullValue=null_if, mode="DROPMALFORMED" if ignore_bad else "FAILFAST", inferSchema=False)
    return rows if null_if is not None else rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Decimals become doubles and binary values strings."""
    rows = spark.read.parquet(path)
    casts = {c: "double" if t.startswith("decimal") else "string" for c, t in rows.dtypes if t.startswith("decimal") or t == "binary"}
    return rows.withColumns({c: F.col(c).cast(t) for c, t in casts.items()}) if casts else rows


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
