"""Thread records: one row a reply tree, with counts, flags and link metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.messages import direction
from loomwork.functions.time import twitter_instant
from loomwork.operators.hierarchy import resolve_hierarchy
from loomwork.operators.packed import split_packed
from loomwork.operators.skew import global_row_number, lookup_join
from loomwork.session import written
from loomwork.sources.tables import id_number, id_text

FAR = 1 << 60


def message_rows(messages: DataFrame) -> DataFrame:
    """One row an id: ``id, parent, is_customer, t, empty, n_rows, conflict``; the row loaded first counts.

    Repeated ids are flagged as conflicting if their texts differ.  Every field is a number or a flag,
    so the rows meet in a hash aggregate and no text is shuffled."""
    text = F.coalesce("text", F.lit(""))
    empty = F.trim(text) == ""
    loaded = F.coalesce(F.unix_micros("loaded_at"), F.lit(FAR)) * 2 + F.when(empty, 0).otherwise(1)
    rows = messages.select(
        id_number("tweet_id").alias("id"), id_number("in_response_to_tweet_id").alias("parent"),
        (direction("inbound") == "inbound").alias("is_customer"), twitter_instant("created_at").cast("long").alias("t"),
        empty.alias("empty"), loaded.alias("loaded"), F.xxhash64(F.coalesce("text", F.lit("\x00"))).alias("h"),
    ).filter("id is not null")
    return rows.groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("is_customer").alias("is_customer"), F.min_by("t", "loaded").alias("t"),
        F.min_by("empty", "loaded").alias("empty"), F.count("*").alias("n_rows"), (F.min("h") != F.max("h")).alias("conflict"),
    )


def first_rows(messages: DataFrame) -> DataFrame:
    """The fields of each message as text, from the row that was loaded first (ties: the smaller text)."""
    fields = ["author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id"]
    rows = messages.select(id_number("tweet_id").alias("id"), *fields, "loaded_at").filter("id is not null")
    order = F.struct(F.coalesce(F.unix_micros("loaded_at"), F.lit(FAR)).alias("l"), F.coalesce("text", F.lit("")).alias("x"))
    return rows.groupBy("id").agg(F.min_by(F.struct(*fields), order).alias("m")).select("id", "m.*")


def placed(messages: DataFrame) -> DataFrame:
    """:func:`message_rows` with ``root, on_cycle, depth, parent_present``, written."""
    rows = written(message_rows(messages), "message-rows")
    tree = resolve_hierarchy(rows.select("id", "parent"))
    return written(rows.join(tree.select("id", "root", "on_cycle", "depth", "parent_present"), "id"), "placed-messages")


def _at():
    """The order inside a thread: time (missing ones last), then the id as text."""
    return F.struct(F.coalesce("t", F.lit(FAR)).alias("t"), F.col("id").cast("string").alias("i"))


def ordered_messages(messages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``root, position, id`` and the fields of every message in the order of its thread, ``position`` from 1.

    A distributed merge sort; a thread of any length is in no single task.  ``rows`` may give the
    result of :func:`placed`."""
    rows = (placed(messages) if rows is None else rows).select("root", "id", F.coalesce("t", F.lit(FAR)).alias("at"), "is_customer")
    turns = global_row_number(rows.withColumn("i", F.col("id").cast("string")), ["root"], [F.col("at").asc(), F.col("i").asc()], "position", "thread-order")
    return turns.drop("i", "at").join(first_rows(messages), "id")


def response_links(messages: DataFrame) -> DataFrame:
    """``id, r_present, r_valid, r_missing``: reply ids of each message that exist or not."""
    ids = messages.select(id_number("tweet_id").alias("id"), "response_tweet_id").filter("id is not null").distinct()
    refs = split_packed(ids, "response_tweet_id", ["id"], packed_ids=True).select("id", id_number("value").alias("ref")).filter("ref is not null").distinct()
    known = messages.select(id_number("tweet_id").alias("ref")).filter("ref is not null").distinct().withColumn("known", F.lit(1))
    marked = refs.join(known, "ref", "left")
    return marked.groupBy("id").agg(
        F.lit(1).alias("r_present"), F.count("known").alias("r_valid"), F.count_if(F.col("known").isNull()).alias("r_missing")
    )


def thread_records(messages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row a thread.  A circle of links with all below it is one thread, its root the smallest id on it.

    Every message is in exactly one thread.  All fields are grouped aggregates with map-side
    combine, so a thread of a third of all messages is no hot task; order-dependent fields are
    minima and maxima by (time, id as text)."""
    joined = (placed(messages) if rows is None else rows).join(written(response_links(messages), "response-links"), "id", "left")
    at = _at()
    has_parent = F.col("parent").isNotNull()
    return joined.groupBy("root").agg(
        F.count("*").alias("message_count"),
        F.count_if("is_customer").alias("customer_message_count"),
        F.count_if(~F.col("is_customer")).alias("brand_message_count"),
        F.max_by(~F.col("is_customer"), at).alias("ends_with_brand_reply"),
        F.max((has_parent & ~F.col("parent_present")) | (F.col("on_cycle") == 1)).alias("has_broken_links"),
        F.max(F.col("on_cycle") == 1).alias("cycle_detected"),
        F.max(F.col("n_rows") > 1).alias("has_duplicate_ids"),
        F.max("conflict").alias("has_conflicting_duplicates"),
        F.max("empty").alias("has_empty_text"),
        F.count_if(F.col("t").isNull()).alias("malformed_timestamps"),
        F.max("depth").alias("max_depth"),
        F.count_if(has_parent).alias("parent_links_present"),
        F.count_if(has_parent & F.col("parent_present")).alias("parent_links_valid"),
        F.count_if(has_parent & ~F.col("parent_present")).alias("parent_links_missing"),
        F.coalesce(F.sum("r_present"), F.lit(0)).alias("response_links_present"),
        F.coalesce(F.sum("r_valid"), F.lit(0)).alias("response_links_valid"),
        F.coalesce(F.sum("r_missing"), F.lit(0)).alias("response_links_missing"),
    ).withColumns({
        "has_both_directions": (F.col("customer_message_count") > 0) & (F.col("brand_message_count") > 0),
        "has_3plus_messages": F.col("message_count") >= 3,
        "is_complete": F.col("ends_with_brand_reply"),
        "has_multiple_exchanges": (F.col("customer_message_count") >= 2) & (F.col("brand_message_count") >= 2),
    }).withColumn("quality_flags", _flags())


def _flags():
    #: Names and order of the flags.
    named = [
        (F.col("has_broken_links"), F.lit("missing_parent_link")),
        (F.col("response_links_missing") > 0, F.lit("missing_response_target")),
        (F.col("cycle_detected"), F.lit("cycle_detected")),
        (F.col("malformed_timestamps") > 0, F.concat(F.lit("malformed_or_missing_timestamp ("), F.col("malformed_timestamps").cast("string"), F.lit(")"))),
        (F.col("has_empty_text"), F.lit("empty_text")),
        (F.col("message_count") == 1, F.lit("single_message")),
        (F.col("customer_message_count") == 0, F.lit("no_customer_message")),
        (F.col("brand_message_count") == 0, F.lit("no_brand_message")),
        (F.col("has_duplicate_ids"), F.lit("duplicate_tweet_ids_in_input")),
        (F.col("has_conflicting_duplicates"), F.lit("conflicting_duplicate_records_in_input")),
    ]
    return F.filter(F.array(*[F.when(cond, name) for cond, name in named]), lambda x: x.isNotNull())


def thread_summary(threads: DataFrame) -> DataFrame:
    """Corpus figures of the thread sizes (exact median)."""
    n = F.col("message_count")
    return threads.agg(
        F.count("*").alias("n_threads"), F.sum(n).alias("n_messages"), F.round(F.avg(n), 2).alias("avg_messages"), F.min(n).alias("min_messages"),
        F.max(n).alias("max_messages"), F.percentile(n, F.lit(0.5)).alias("median_messages"),
        F.count_if("has_both_directions").alias("both_directions"), F.count_if("has_3plus_messages").alias("three_plus"),
        F.count_if("has_multiple_exchanges").alias("multiple_exchanges"), F.count_if("ends_with_brand_reply").alias("ends_with_brand"),
        F.count_if("has_broken_links").alias("broken"), F.count_if("cycle_detected").alias("circles"),
    )


def link_totals(threads: DataFrame) -> DataFrame:
    """Link metrics of the corpus; coverage is null where nothing is present."""
    s = {c: F.sum(c).alias(c) for c in ("parent_links_present", "parent_links_valid", "parent_links_missing", "response_links_present", "response_links_valid", "response_links_missing")}
    out = threads.agg(*s.values())
    return out.withColumn("parent_coverage", F.try_divide("parent_links_valid", "parent_links_present")).withColumn(
        "response_coverage", F.try_divide("response_links_valid", F.col("response_links_valid") + F.col("response_links_missing"))
    )


def first_exchange(turns: DataFrame) -> DataFrame:
    """``root, customer_id, brand_id``: the first customer message that is not empty and the first brand message that
    is not empty after it, of ``turns (root, id, t, is_customer, empty)``.

    Two grouped minima over numbers instead of a window: no thread is sorted in one task, no text is read."""
    at = F.struct(F.coalesce("t", F.lit(FAR)).alias("t"), F.col("id").alias("i"))
    rows = turns.filter(~F.col("empty")).select("root", at.alias("at"), "is_customer")
    asked = rows.groupBy("root").agg(F.min(F.when(F.col("is_customer"), F.col("at"))).alias("q"), F.count("*").alias("n_rows")).filter("q is not null")
    later = lookup_join(rows.filter(~F.col("is_customer")), written(asked, "first-questions"), "root", "n_rows").filter(F.col("at") > F.col("q"))
    return later.groupBy("root").agg(F.min("q").alias("q"), F.min("at").alias("a")).select("root", F.col("q.i").alias("customer_id"), F.col("a.i").alias("brand_id"))


def exchange_texts(pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """``pairs`` of :func:`first_exchange` with ``customer_text`` and ``brand_text``."""
    texts = first_rows(messages).select("id", "text")
    for who in ("customer", "brand"):
        pairs = pairs.join(texts.select(F.col("id").alias(f"{who}_id"), F.col("text").alias(f"{who}_text")), f"{who}_id")
    return pairs


def first_customer_messages(turns: DataFrame) -> DataFrame:
    """One row a thread of ``turns (root, id, t, is_customer, empty)``: ``root, customer_id, n_skipped, reason, exclusion``.

    The first customer message that is not empty; ``n_skipped`` empty ones come before it.  A thread without
    customer messages, or with empty ones only, is excluded."""
    at = _at()
    rows = turns.filter("is_customer").select("root", "id", at.alias("at"), "empty")
    picked = rows.groupBy("root").agg(F.min(F.when(~F.col("empty"), F.struct("at", "id"))).alias("p"), F.min("at").alias("first"), F.count("*").alias("n_rows"))
    picked = written(picked.select("root", "p.id", F.col("p.at").alias("at"), "first", "n_rows"), "first-customer")
    fallback = picked.filter(F.col("at") != F.col("first")).select("root", F.col("at").alias("chosen"), "n_rows")
    skipped = lookup_join(rows, written(fallback, "later-customer"), "root", "n_rows").filter(F.col("at") < F.col("chosen")).groupBy("root").agg(F.count("*").alias("n_skipped"))
    threads = turns.select("root").distinct()
    out = threads.join(picked.select("root", F.col("id").alias("customer_id"), F.lit(True).alias("has")), "root", "left").join(skipped, "root", "left")
    n = F.coalesce("n_skipped", F.lit(0))
    reason = F.when(n == 0, "first_customer_message_chronological").otherwise(F.concat(F.lit("subsequent_customer_message_fallback (index "), n.cast("string"), F.lit(")")))
    exclusion = F.when(F.col("has").isNull(), "no_customer_message").when(F.col("customer_id").isNull(), "all_customer_messages_empty")
    return out.select("root", "customer_id", n.alias("n_skipped"), F.when(F.col("customer_id").isNotNull(), reason).alias("reason"), exclusion.alias("exclusion"))


_LINKS = ("parent_links_present", "parent_links_valid", "parent_links_missing", "response_links_present", "response_links_valid", "response_links_missing")


def thread_documents(messages: DataFrame, part: int = 10_000) -> DataFrame:
    """Thread records as nested JSON: ``root, part, value``.

    ``value`` holds the record's fields, its link metrics and the ordered messages.  A thread of more than
    ``part`` messages has several rows, each with the next ``part`` of them, so no row is unbounded."""
    rows = placed(messages)
    turns = ordered_messages(messages, rows)
    side = F.when(F.col("is_customer"), "customer_inbound").otherwise("brand_reply")
    message = F.struct(
        "position", id_text("id").alias("tweet_id"), "author_id", F.when(F.col("is_customer"), "True").otherwise("False").alias("inbound"), side.alias("row_type"),
        "created_at", "text", "response_tweet_id", "in_response_to_tweet_id",
    )
    lists = turns.groupBy("root", F.floor((F.col("position") - 1) / part).cast("int").alias("part")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    records = thread_records(messages, rows).withColumn("link_metrics", F.struct(*_LINKS)).drop(*_LINKS, "max_depth")
    head = [F.concat(F.lit("thread_"), id_text("root")).alias("thread_id"), id_text("root").alias("root_tweet_id")]
    ends = [F.get("messages", F.lit(0))["created_at"].alias("start_timestamp"), F.element_at("messages", -1)["created_at"].alias("end_timestamp")]
    fields = [c for c in records.columns if c != "root"]
    return lists.join(records, "root").select("root", "part", F.to_json(F.struct(*head, "part", *ends, *fields, "messages")).alias("value"))


def numeric_then_text(col: str) -> list:
    """Sort order of ids: numbers by value, then the rest as text, nulls last."""
    return [F.col(col).try_cast("bigint").asc_nulls_last(), F.col(col).asc_nulls_last()]
