"""Figures of several brands side by side, each over its own share of the messages, and rankings of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.messages import direction, likely_english, masked_fields, percent, present, useful_words
from loomwork.functions.time import twitter_instant
from loomwork.operators.extract import first_match
from loomwork.operators.hierarchy import resolve_hierarchy
from loomwork.operators.packed import split_packed
from loomwork.session import written
from loomwork.sources.tables import id_number

FAR = 1 << 60
#: A text of fewer words says little; texts are judged by their first 200 characters.
NOISE_WORDS, TEXT_LENGTH = 3, 200


def brand_rows(messages: DataFrame, brands: list[str]) -> DataFrame:
    """All rows of the brands' own messages and of those they answer, each row with the first brand it belongs to."""
    owner = first_match(messages, brands)
    rows = messages.select(
        id_number("tweet_id").alias("id"), id_number("in_response_to_tweet_id").alias("parent"), (direction("inbound") == "inbound").alias("is_inbound"),
        twitter_instant("created_at").cast("long").alias("t"), F.trim("author_id").alias("author"), (F.lower(F.trim("inbound")) == "false").alias("is_reply"),
        F.substring("text", 1, TEXT_LENGTH).alias("text"), "response_tweet_id",
    )
    return rows.join(owner, "id")


def _responses(rows: DataFrame) -> DataFrame:
    """``id, all_here, any_brand``: whether all listed replies are in the brand's subset, and one is its own message."""
    ids = rows.select("id", "brand", "response_tweet_id").distinct()
    refs = split_packed(ids, "response_tweet_id", ["id", "brand"], packed_ids=True).select("id", "brand", id_number("value").alias("ref")).filter("ref is not null").distinct()
    here = rows.groupBy(F.col("id").alias("ref"), F.col("brand").alias("ref_brand")).agg(F.max(F.coalesce(F.col("is_reply") & (F.col("author") == F.col("brand")), F.lit(False))).alias("own"))
    marked = refs.join(here, "ref", "left").withColumn("same", F.coalesce(F.col("ref_brand") == F.col("brand"), F.lit(False)))
    return marked.groupBy("id").agg(F.min("same").alias("all_here"), F.max(F.col("same") & F.col("own")).alias("any_brand"))


def brand_threads(rows: DataFrame) -> DataFrame:
    """One row a thread inside the subset of a brand: ``brand, n, both, three_plus, exchanges, ends_with_brand, broken``.

    A reply of a brand message by a customer exists exactly where some brand message is before some customer
    message, so two grouped extremes tell it and no thread is sorted."""
    one = rows.groupBy("id").agg(F.max("parent").alias("parent"), F.max("brand").alias("brand"), F.max("is_inbound").alias("is_inbound"), F.min("t").alias("t"))
    one = written(one, "brand-messages")
    parents = one.select(F.col("id").alias("parent"), F.col("brand").alias("parent_brand"))
    linked = one.join(parents, "parent", "left").withColumn("here", F.coalesce(F.col("brand") == F.col("parent_brand"), F.lit(False)))
    linked = written(linked, "brand-links")
    tree = resolve_hierarchy(linked.select("id", F.when(F.col("here"), F.col("parent")).alias("parent"))).select("id", "root", "on_cycle")
    at = F.struct(F.coalesce("t", F.lit(FAR)).alias("t"), F.col("id").cast("string").alias("i"))
    out = linked.join(tree, "id").groupBy("brand", "root").agg(
        F.count("*").alias("n"), F.count_if("is_inbound").alias("n_in"), F.min(F.when(~F.col("is_inbound"), at)).alias("first_out"),
        F.max(F.when(F.col("is_inbound"), at)).alias("last_in"), F.max_by(~F.col("is_inbound"), at).alias("ends_with_brand"),
        F.max((F.col("parent").isNotNull() & ~F.col("here")) | (F.col("on_cycle") == 1)).alias("broken"),
    )
    return out.select(
        "brand", "root", "n", ((F.col("n_in") > 0) & (F.col("n_in") < F.col("n"))).alias("both"), (F.col("n") >= 3).alias("three_plus"),
        ((F.col("n") >= 3) & F.coalesce(F.col("first_out") < F.col("last_in"), F.lit(False))).alias("exchanges"), "ends_with_brand", "broken",
    )


def unanswered_mentions(messages: DataFrame, brands: list[str]) -> DataFrame:
    """``brand, n_unanswered``: customer rows in no brand's subset that hold ``@brand``; an estimate by mentions."""
    keys = first_match(messages, brands).select("id")
    asked = messages.filter(direction("inbound") == "inbound").select(id_number("tweet_id").alias("id"), "text")
    named = asked.select("id", F.explode(F.filter(F.array(*[F.when(F.contains(F.coalesce("text", F.lit("")), F.lit("@" + b)), F.lit(b)) for b in brands]), lambda b: b.isNotNull())).alias("brand"))
    return named.join(keys, "id", "left_anti").groupBy("brand").agg(F.count("*").alias("n_unanswered"))


def brand_metrics(messages: DataFrame, brands: list[str]) -> DataFrame:
    """One row a brand with all figures; percentages have one digit, those of empty wholes are 0.

    A link field is *present* if it is not blank; it is *valid* if what it names is in the brand's own subset."""
    rows = written(brand_rows(messages, brands), "brand-rows")
    rows = rows.join(_responses(rows), "id", "left")
    has_parent, has_response = F.col("parent").isNotNull(), present("response_tweet_id")
    here = rows.select(F.col("id").alias("parent"), F.col("brand").alias("parent_brand")).distinct()
    rows = rows.join(here, "parent", "left")
    valid = F.coalesce(F.col("parent_brand") == F.col("brand"), F.lit(False))
    inside, brand_reply = has_response & F.coalesce("all_here", F.lit(False)), has_response & F.coalesce("any_brand", F.lit(False))
    customer = F.col("is_inbound")
    text = F.coalesce("text", F.lit(""))
    by_brand = rows.groupBy("brand").agg(
        F.count("*").alias("n_rows"), F.count_if(customer).alias("n_inbound"), F.count_if(~customer).alias("n_outbound"),
        F.count_if(has_parent).alias("n_parent"), F.count_if(valid).alias("n_parent_valid"), F.count_if(~valid).alias("n_roots"),
        F.count_if(has_response).alias("n_response"), F.count_if(inside).alias("n_response_valid"), F.count_if(brand_reply).alias("n_response_brand"),
        F.count_if(customer & has_response).alias("n_asked_response"), F.count_if(customer & inside).alias("n_asked_valid"), F.count_if(customer & brand_reply).alias("n_asked_brand"),
        F.count_if(likely_english(text)).alias("n_english"), F.count_if(useful_words(text) < NOISE_WORDS).alias("n_noise"),
        F.count_if(masked_fields(text) > 0).alias("n_masked_rows"), F.sum(masked_fields(text)).alias("n_masked"),
    )
    n = F.col("n")
    threads = brand_threads(rows).groupBy("brand").agg(
        F.count("*").alias("n_threads"), F.count_if(n == 1).alias("n_single"), F.count_if("both").alias("n_both"), F.count_if("three_plus").alias("n_three_plus"),
        F.count_if("exchanges").alias("n_exchanges"), F.count_if("ends_with_brand").alias("n_ends_brand"), F.count_if("broken").alias("n_broken"),
        F.round(F.avg(n), 2).alias("avg_length"), F.percentile(n, F.lit(0.5)).alias("median_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"),
    )
    out = by_brand.join(threads, "brand").join(unanswered_mentions(messages, brands), "brand", "left").withColumn("n_unanswered", F.coalesce("n_unanswered", F.lit(0)))
    of = {
        "n_rows": ["n_parent", "n_response", "n_english", "n_noise"], "n_parent": ["n_parent_valid"], "n_response": ["n_response_valid", "n_response_brand"],
        "n_inbound": ["n_asked_response", "n_asked_valid", "n_asked_brand"], "n_threads": ["n_both", "n_three_plus", "n_exchanges", "n_ends_brand", "n_broken"],
    }
    shares = {"pct_" + part[2:]: percent(F.col(part), F.col(whole)) for whole, parts in of.items() for part in parts}
    shares["pct_multi"] = percent(F.col("n_threads") - F.col("n_single"), F.col("n_threads"))
    shares["pct_answered"] = percent(F.col("n_asked_brand"), F.col("n_inbound") + F.col("n_unanswered"))
    return out.withColumns(shares)


def _ranked(df: DataFrame, score: str, name: str) -> DataFrame:
    """Ranks 1.. by falling score, ties by brand; one row a brand reaches the window."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), "brand")))


def _judged(metrics: DataFrame, judged: dict[str, tuple[float, float]]) -> tuple[DataFrame, Column]:
    """Adds volume (share of the largest brand), and the judged diversity and distinctiveness (0.5 where not assessed)."""
    pick = lambda i: F.coalesce(*[F.when(F.col("brand") == b, F.lit(float(v[i]))) for b, v in judged.items()], F.lit(0.5))
    volume = F.col("n_outbound") / F.max("n_outbound").over(Window.partitionBy())
    english = F.col("pct_english") / 100 * (1 - F.col("pct_noise") / 100)
    return metrics.withColumns({"volume": volume, "diversity": pick(0), "distinct": pick(1)}).withColumn("english", english), F.col("volume")


def rank_first(metrics: DataFrame, judged: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``brand, score, rank``: weights 0.20 volume, 0.20 completeness, 0.20 diversity, 0.15 English, 0.15 volume again, 0.10 distinctiveness.

    Completeness is half the threads that end with the brand and half those of two messages or more."""
    df, volume = _judged(metrics, judged or {})
    complete = 0.5 * F.col("pct_ends_brand") / 100 + 0.5 * F.col("pct_multi") / 100
    score = volume * 0.20 + complete * 0.20 + F.col("diversity") * 0.20 + F.col("english") * 0.15 + volume * 0.15 + F.col("distinct") * 0.10
    return _ranked(df.select("brand", F.round(score, 4).alias("score")), "score", "rank")


def rank_validated(metrics: DataFrame, judged: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``brand, volume_score, quality_score, volume_rank, quality_rank``.

    By volume: 0.20 volume, 0.20 threads of both sides, 0.20 diversity, 0.15 English, 0.15 volume again, 0.10 distinctiveness.
    By quality: 0.30 conversations (0.4 both sides, 0.3 three and more, 0.3 exchanges), 0.25 diversity, 0.25 English, 0.20 distinctiveness."""
    df, volume = _judged(metrics, judged or {})
    both, three, back = (F.col(c) / 100 for c in ("pct_both", "pct_three_plus", "pct_exchanges"))
    by_volume = volume * 0.20 + both * 0.20 + F.col("diversity") * 0.20 + F.col("english") * 0.15 + volume * 0.15 + F.col("distinct") * 0.10
    by_quality = (0.4 * both + 0.3 * three + 0.3 * back) * 0.30 + F.col("diversity") * 0.25 + F.col("english") * 0.25 + F.col("distinct") * 0.20
    out = df.select("brand", F.round(by_volume, 4).alias("volume_score"), F.round(by_quality, 4).alias("quality_score"))
    return _ranked(_ranked(out, "volume_score", "volume_rank"), "quality_score", "quality_rank")
