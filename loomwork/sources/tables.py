"""The project's tables and their cleaned key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def id_number(col: Column | str) -> Column:
    """An id of up to 19 digits as a number: blanks and a trailing ``.0`` do not count; null if it is
    none or beyond 2^63 - 1."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d{1,19})(?:\.0+)?\s*$", 1).try_cast("bigint")


def id_text(col: Column | str) -> Column:
    """An id number as text of at least ten digits."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c < 10**9, F.lpad(c.cast("string"), 10, "0")).otherwise(c.cast("string"))


def message_links(twcs: DataFrame) -> DataFrame:
    """``id, parent`` (numbers) of the raw message table; rows without a usable id are left out."""
    return twcs.select(id_number("tweet_id").alias("id"), id_number("in_response_to_tweet_id").alias("parent")).filter(
        F.col("id").isNotNull()
    )
