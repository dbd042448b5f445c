"""All messages of one party: its own and those it answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.messages import canonical_inbound
from loomwork.functions.text import normalise
from loomwork.sources.tables import id_number


def brand_rows(messages: DataFrame, brand: str) -> DataFrame:
    return messages.filter((F.lower(F.trim("inbound")) == "false") & (F.trim("author_id") == brand))


def extract_brand(messages: DataFrame, brand: str) -> DataFrame:
    """Rows of the brand and rows it replies to: ``id, parent, author_id, inbound, created_at, text_raw,
    text, row_type``.  The keys are distinct before the semi-join, so its right side has one row a key."""
    own = brand_rows(messages, brand).select(id_number("tweet_id").alias("id"), id_number("in_response_to_tweet_id").alias("parent"))
    keys = (
        own.select("id", F.lit(1).alias("own"))
        .unionAll(own.select(F.col("parent").alias("id"), F.lit(0).alias("own")))
        .filter("id is not null")
        .groupBy("id")
        .agg(F.max("own").alias("own"))
    )
    rows = messages.select(
        id_number("tweet_id").alias("id"), id_number("in_response_to_tweet_id").alias("parent"),
        F.trim("author_id").alias("author_id"), canonical_inbound("inbound").alias("inbound"), "created_at",
        F.col("text").alias("text_raw"), normalise("text").alias("text"),
    )
    return rows.join(keys, "id").withColumn("row_type", F.when(F.col("own") == 1, "brand_reply").otherwise("customer_inbound")).drop("own")


def first_match(messages: DataFrame, brands: list[str]) -> DataFrame:
    """``id, brand``: each row by the first brand (in the given order) it belongs to, as a reply of the
    brand or as a message the brand replies to."""
    order = F.create_map(*[x for i, b in enumerate(brands) for x in (F.lit(b), F.lit(i))])
    own = messages.filter((F.lower(F.trim("inbound")) == "false") & F.trim("author_id").isin(*brands)).select(
        id_number("tweet_id").alias("id"), id_number("in_response_to_tweet_id").alias("parent"), F.trim("author_id").alias("brand")
    )
    pairs = own.select("id", "brand").unionAll(own.select(F.col("parent").alias("id"), "brand")).filter("id is not null")
    ids = messages.select(id_number("tweet_id").alias("id")).distinct()
    return pairs.groupBy("id").agg(F.min_by("brand", order[F.col("brand")]).alias("brand")).join(ids, "id", "left_semi")
