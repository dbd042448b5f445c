"""Queries that write and read files, split and encode: each goes once through its reader or writer and is compared with SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from loomwork.functions.time import permissive_instant
from loomwork.operators import isolation as I
from loomwork.operators import ml
from loomwork.operators import threads as H
from loomwork.plans.reference import _CAND, _GOLD, _ID, _TIME, _t, query
from loomwork.session import shared_dir
from loomwork.sources import files as S


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/loomwork/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_COLS = ", ".join(S.MESSAGE_COLUMNS)


@query(f"select {', '.join(f'''nullif({c}, '') {c}''' for c in S.MESSAGE_COLUMNS)} from twcs")
def csv_round_trip(spark, d):
    """The messages written as sorted CSV and read again: line breaks and quotes inside fields survive, blanks become null."""
    path = _folder(spark, "csv")
    rows = _t(spark, d, "twcs").select(*S.MESSAGE_COLUMNS)
    S.write_sorted_csv(rows, path, H.numeric_then_text("tweet_id"))
    back = S.read_messages_csv(spark, path)
    S.check_columns(back, S.MESSAGE_COLUMNS)
    return back.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in S.MESSAGE_COLUMNS])


@query(f"select thread_id, tweet_id, candidate_intent, thread_message_count, is_complete from {_CAND}")
def jsonl_round_trip(spark, d):
    """The candidates written as JSON lines and read again with a schema."""
    path = _folder(spark, "jsonl")
    rows = _t(spark, d, _CAND)
    S.write_jsonl(rows, path)
    return S.read_jsonl(spark, path, rows.schema).select("thread_id", "tweet_id", "candidate_intent", "thread_message_count", "is_complete")


@query("select budget_id, purpose, capacity_tokens, 2 copies from context_budgets")
def csv_append(spark, d):
    """A table appended twice to a folder of CSV files in a fixed order of columns; a third write is refused."""
    path = _folder(spark, "append")
    rows = _t(spark, d, "context_budgets")
    for _ in range(2):
        S.write_csv(rows, path, ["purpose", "capacity_tokens", "budget_id"], mode="append")
    try:
        S.write_csv(rows, path)
        raise AssertionError("an existing folder must be refused")
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    back = spark.read.schema("purpose string, capacity_tokens int, budget_id int").option("header", True).csv(path)
    return back.groupBy("budget_id", "purpose", "capacity_tokens").agg(F.count("*").cast("int").alias("copies"))


@query("""select count(*) n_rows, count(distinct tweet_id) n_ids, 'outbound counts as not True' note from twcs""")
def metadata_figures(spark, d):
    """Figures and notes as metadata JSON, read back."""
    figures = _t(spark, d, "twcs").agg(F.count("*").alias("n_rows"), F.countDistinct("tweet_id").alias("n_ids"))
    meta = json.loads(S.metadata_json(figures, {"note": "outbound counts as not True"}))
    return spark.createDataFrame([(meta["figures"]["n_rows"], meta["figures"]["n_ids"], meta["note"])], "n_rows bigint, n_ids bigint, note string")


@query("""select '| budget_id | capacity_tokens |' || chr(10) || '|---|---|' || string_agg(chr(10) || '| ' || budget_id || ' | ' || capacity_tokens || ' |', '' order by budget_id) "table" from context_budgets""")
def markdown_table(spark, d):
    """A small table as Markdown."""
    text = S.markdown_table(_t(spark, d, "context_budgets").select("budget_id", "capacity_tokens").orderBy("budget_id"))
    return spark.createDataFrame([(text,)], '`table` string')


@query("select inbound, count(*) n from (select case lower(trim(inbound)) when 'true' then true when 'false' then false end inbound from twcs) group by 1")
def sample_scan(spark, d):
    """The look at a schema with its boolean direction, here over all rows."""
    rows = _t(spark, d, "twcs")
    return S.sample_rows(rows, 1 << 30).groupBy("inbound").agg(F.count("*").alias("n"))


@query(f"""select {_ID('tweet_id')} id, min(cast(coalesce({_TIME}, epoch(try_cast(case when regexp_matches(trim(coalesce(created_at, '')), '^\\d{{4}}-\\d{{2}}-\\d{{2}}([ T]\\d{{2}}:\\d{{2}}(:\\d{{2}})?)?$') then replace(trim(created_at), 'T', ' ') end as timestamp))) as bigint)) t
from twcs group by 1 having id is not null""")
def message_times(spark, d):
    """Seconds of every message, from the message format or, where that fails, from an ISO date."""
    from loomwork.sources.tables import id_number

    return _t(spark, d, "twcs").select(id_number("tweet_id").alias("id"), permissive_instant("created_at").cast("long").alias("t")).filter("id is not null").groupBy("id").agg(F.min("t").alias("t"))


@query(f"""with r as (select tweet_id, candidate_intent, row_number() over (partition by candidate_intent order by o, tweet_id) rn, count(*) over (partition by candidate_intent) n
 from (select distinct tweet_id, candidate_intent, sha256('ninety:' || tweet_id) o from {_CAND} where tweet_id is not null and candidate_intent is not null))
select candidate_intent, case when rn <= round(n * 0.9) then 'train' else 'valid' end split, tweet_id from r""")
def stratified_split(spark, d):
    """Nine tenths of every label for training, one tenth held back."""
    rows = _t(spark, d, _CAND).filter("tweet_id is not null and candidate_intent is not null").select("tweet_id", "candidate_intent").distinct()
    return I.stratified_split(rows, "tweet_id", "candidate_intent", 0.9, "ninety").select("candidate_intent", "split", "tweet_id")


@query(f"""select candidate_intent, count(*) n from {_CAND} where candidate_intent is not null and candidate_intent <> 'needs_review'
 and ({_ID('tweet_id')} is null or {_ID('tweet_id')} not in (select {_ID('tweet_id')} from {_GOLD} where {_ID('tweet_id')} is not null)) group by 1""")
def training_pool(spark, d):
    """The isolated candidates without those left for review, by label."""
    return I.isolated(_t(spark, d, _CAND), _t(spark, d, _GOLD)).filter("candidate_intent <> 'needs_review'").groupBy("candidate_intent").agg(F.count("*").alias("n"))


@query("""with e as (select vec_id, list_transform(embedding[1:4], lambda x: exp(cast(x as double))) p from embeddings), s as (select vec_id, list_transform(p, lambda x: x / list_sum(p)) p from e),
z as (select vec_id, list_sort(list_transform([1, 2, 3, 4], lambda i: {'confidence': p[i], 'label': ['a', 'b', 'c', 'd'][i]}), 'desc') z from s)
select vec_id, z[1].label "first", z[2].label "second", z[3].label "third", round(z[1].confidence, 4) confidence, round(z[1].confidence - z[2].confidence, 4) margin from z""")
def softmax_top3(spark, d):
    """Scores as shares, the best three labels and the margin."""
    scores = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    rows = _t(spark, d, "embeddings").select("vec_id", ml.softmax(scores).alias("p"))
    top = rows.select("vec_id", ml.ranked_labels(F.col("p"), ["a", "b", "c", "d"]).alias("top"), F.sort_array("p", asc=False).alias("s"))
    return top.select("vec_id", *[F.col("top")[i]["label"].alias(n) for i, n in enumerate(("first", "second", "third"))], F.round(F.col("s")[0], 4).alias("confidence"), F.round(F.col("s")[0] - F.col("s")[1], 4).alias("margin"))


@query("select (select count(*) from embeddings) n_corpus, count(*) n_vectors, (select count(*) from embeddings) - count(*) n_missing, count(*) filter (where sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) not between 0.99 and 1.01) n_off from embeddings where label <> 0")
def vector_check(spark, d):
    """Vectors against their corpus: counts, missing ones and lengths."""
    e = _t(spark, d, "embeddings")
    return ml.check_vectors(e, e.filter("label <> 0").select("vec_id", F.col("embedding").alias("vector")), "vec_id")
