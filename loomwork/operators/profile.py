"""Profiles of a raw message table: one pass, partial aggregates before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.messages import direction, first_mention, present
from loomwork.session import written


def counts(messages: DataFrame) -> DataFrame:
    """One row: rows, inbound, outbound, repeated ids, distinct customers, links and roots."""
    inbound = F.trim(F.coalesce("inbound", F.lit(""))) == "True"
    return messages.agg(
        F.count("*").alias("n_rows"),
        F.count_if(inbound).alias("n_inbound"),
        F.count_if(~inbound).alias("n_outbound"),
        (F.count("tweet_id") - F.countDistinct("tweet_id")).alias("n_repeated_ids"),
        F.countDistinct(F.when(inbound, F.col("author_id"))).alias("n_customers"),
        F.count_if(present("response_tweet_id")).alias("n_with_response"),
        F.count_if(present("in_response_to_tweet_id")).alias("n_with_parent"),
        F.count_if(~present("in_response_to_tweet_id")).alias("n_roots"),
    )


def nulls(messages: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n_null, n_blank`` for each of ``columns``; one pass."""
    aggs = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.trim(c) == "").alias("n_blank")) for c in columns]
    return messages.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def group_counts(messages: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """``key, n`` by falling count, ties by key."""
    out = messages.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.asc(key)).limit(top) if top else out


def mention_examples(messages: DataFrame, per_mention: int = 20) -> DataFrame:
    """``mention, n, examples``: at most ``per_mention`` ids (smallest first) of each first mention.

    The ids are cut to the smallest ones inside each task first, so a mention of a third of the
    rows sends no more than a few ids per task."""
    rows = messages.select("tweet_id", first_mention("text").alias("mention")).filter("mention is not null").distinct()
    w = Window.partitionBy("mention").orderBy("tweet_id")
    few = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_mention)
    examples = few.groupBy("mention").agg(F.array_sort(F.collect_list("tweet_id")).alias("ids"))
    n = rows.groupBy("mention").agg(F.count("*").alias("n"))
    return n.join(examples, "mention").select("mention", "n", F.array_join("ids", ",").alias("examples"))


def direction_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(direction("inbound").alias("direction")).agg(F.count("*").alias("n"))


def repeated_ids(messages: DataFrame, id_col: str = "tweet_id", fields: tuple[str, ...] = ("text", "author_id")) -> DataFrame:
    """``id, n_rows, conflicting`` of ids with several rows; they conflict if a field differs (null is a value)."""
    vals = [F.count(F.lit(1)).alias("n_rows")]
    differs = F.lit(False)
    for f in fields:
        v = F.coalesce(F.col(f).cast("string"), F.lit("\x00"))
        vals += [F.min(v).alias("lo_" + f), F.max(v).alias("hi_" + f)]
        differs = differs | (F.col("lo_" + f) != F.col("hi_" + f))
    return messages.groupBy(id_col).agg(*vals).filter("n_rows > 1").select(id_col, "n_rows", differs.alias("conflicting"))


def row_quality(messages: DataFrame, *more) -> DataFrame:
    """One row of quality counters, with further aggregates if given."""
    return messages.agg(*_quality(), *more)


def _quality() -> list:
    text, ts = F.trim(F.coalesce("text", F.lit(""))), F.trim(F.coalesce("created_at", F.lit("")))
    parent = F.trim(F.coalesce("in_response_to_tweet_id", F.lit("")))
    return [
        F.count("*").alias("n_rows"),
        F.count_if(text == "").alias("empty_text"),
        F.count_if((ts == "") | (ts == "nan")).alias("missing_timestamp"),
        F.count_if(direction("inbound") == "unknown").alias("bad_inbound"),
        F.count_if((parent != "") & (parent == F.trim("tweet_id"))).alias("self_parent"),
        F.count_if(F.array_contains(F.split(F.regexp_replace(F.coalesce("response_tweet_id", F.lit("")), r"\s", ""), ","), F.trim("tweet_id"))).alias("self_response"),
    ]


def severity_report(quality: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``severity, rule, n`` for the counters of :func:`row_quality` that are above zero.

    ``rules``: (counter, severity, description)."""
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(d).alias("rule"), F.col(c).alias("n")) for c, s, d in rules])
    return quality.select(F.explode(rows).alias("x")).select("x.*").filter("n > 0")


def _digest(*cols: str):
    """16 bytes that stand for a value (null for null): distinct counts shuffle these instead of texts."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]
    code = F.unhex(F.md5(F.concat_ws("\x1f", *parts)))
    return F.when(F.col(cols[0]).isNotNull(), code) if len(cols) == 1 else code


def duplicate_audit(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """One row: rows and distinct values of columns and of pairs of columns."""
    named = {c: _digest(c) for c in columns} | {f"{a}_{b}": _digest(a, b) for a, b in pairs}
    codes = df.select(*[code.alias(n) for n, code in named.items()])
    return codes.agg(F.count("*").alias("n_rows"), *[F.countDistinct(n).alias("distinct_" + n) for n in named])


def most_repeated(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """``column, n`` of the values repeated most, ties by value.  Counted by digest; the texts are fetched for the ties
    and winners only."""
    rows = df.filter(F.col(column).isNotNull()).select(_digest(column).alias("d"), column)
    n = rows.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1")
    n = written(n, "repeats")
    least = n.orderBy(F.desc("n")).limit(top).agg(F.min("n")).first()[0]  # one number
    winners = n.filter(F.col("n") >= F.lit(least))
    texts = rows.join(winners, "d").groupBy("d", "n").agg(F.first(column).alias(column))
    return texts.select(column, "n").orderBy(F.desc("n"), column).limit(top)


#: Counters of :func:`validation_figures` with severity and wording.
VALIDATION_RULES = (
    ("n_no_id", "error", "rows without id"), ("n_no_brand_rows", "error", "no rows of the brand"), ("n_no_inbound", "warning", "no customer rows"), ("n_duplicate_ids", "warning", "repeated ids"),
    ("n_conflicts", "warning", "ids with conflicting records"), ("n_empty_text", "warning", "rows without text"), ("n_no_time", "warning", "rows without time"), ("n_bad_inbound", "warning", "rows of unknown direction"),
    ("n_self_parent", "warning", "rows that answer themselves"), ("n_self_response", "warning", "rows that list themselves as reply"), ("n_too_few", "warning", "too few ids"),
    ("n_ids", "info", "ids"), ("n_parent", "info", "rows with parent field"), ("n_response", "info", "rows with response field"),
)


def validation_figures(messages: DataFrame, brand: str, least: int = 100) -> DataFrame:
    """One row of figures over an extraction read back: row counters in one pass, repeated and conflicting ids in another."""
    more = [
        F.count_if(~present("tweet_id")).alias("n_no_id"), F.count_if((F.trim("author_id") == brand) & (direction("inbound") == "outbound")).alias("n_brand"),
        F.count_if(direction("inbound") == "inbound").alias("n_inbound"), F.count_if(present("in_response_to_tweet_id")).alias("n_parent"),
        F.count_if(present("response_tweet_id")).alias("n_response"), F.lit(1).alias("one"),
    ]
    repeats = repeated_ids(messages.filter(present("tweet_id")).withColumn("tweet_id", F.trim("tweet_id")))
    twice = repeats.agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("n_duplicate_ids"), F.count_if("conflicting").alias("n_conflicts"), F.lit(1).alias("one"))
    one = row_quality(messages, *more).join(twice, "one")  # one row each
    n_ids = F.col("n_rows") - F.col("n_no_id") - F.col("n_duplicate_ids")
    return one.select(
        "n_no_id", F.when(F.col("n_brand") == 0, 1).otherwise(0).alias("n_no_brand_rows"), F.when(F.col("n_inbound") == 0, 1).otherwise(0).alias("n_no_inbound"),
        "n_duplicate_ids", "n_conflicts", F.col("empty_text").alias("n_empty_text"), F.col("missing_timestamp").alias("n_no_time"), F.col("bad_inbound").alias("n_bad_inbound"),
        F.col("self_parent").alias("n_self_parent"), F.col("self_response").alias("n_self_response"), F.when(n_ids < least, 1).otherwise(0).alias("n_too_few"),
        n_ids.alias("n_ids"), "n_parent", "n_response",
    )


def validation_report(messages: DataFrame, brand: str, least: int = 100) -> DataFrame:
    """``severity, rule, n`` of everything that was found, errors, warnings and plain figures."""
    return severity_report(validation_figures(messages, brand, least), list(VALIDATION_RULES))
