from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomwork.functions import messages as M
from loomwork.functions.text import decode_entities, has_content, words
from loomwork.functions.time import twitter_instant
from loomwork.operators import isolation, metrics, ml, retrieval, review, rules, threads
from loomwork.sources import files
from loomwork.sources.tables import id_number, id_text


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, decode_entities(F.lit("a &amp;lt; b &lt; &#39;c&#39; &AMP d"))) == "a &lt; b < 'c' & d"
    assert one(spark, words(F.lit("Don’t STOP &amp; go_on ５"))) == ["dont", "stop", "go", "on", "５"]
    assert one(spark, words(F.lit(None).cast("string"))) == []
    assert [one(spark, has_content(F.lit(t))) for t in ("@a https://x.example/1 😊 &amp;", "@a ok", None)] == [False, True, False]
    assert one(spark, M.first_mention(F.lit("hi @123, @Brand: x"))) is None and one(spark, M.first_mention(F.lit("hi @Brand: x"))) == "Brand"
    assert one(spark, M.redact_plain(F.lit("call 12345678 or a@b.c"))) == "call [ID] or [email]"
    assert one(spark, M.likely_english(F.lit("a" * 85 + "é" * 15))) and not one(spark, M.likely_english(F.lit("a" * 84 + "é" * 16)))
    assert one(spark, M.useful_words(F.lit("@a https://x.example one two 3rd"))) == 2


def test_times_and_ids(spark):
    ok = one(spark, twitter_instant(F.lit("Tue Oct 31 22:10:47 -0500 2017")).cast("long"))
    assert ok == int(datetime(2017, 11, 1, 3, 10, 47).timestamp()) or ok == 1509505847
    for bad in ("Tue Foo 31 22:10:47 +0000 2017", "Tue Feb 30 22:10:47 +0000 2017", "0000-00-00", "", None, "Wed Nov 15 2"):
        assert one(spark, twitter_instant(F.lit(bad).cast("string"))) is None
    assert [one(spark, id_number(F.lit(v).cast("string"))) for v in (" 12 ", "12.0", "nan", "", None, "x")] == [12, 12, None, None, None, None]
    assert one(spark, id_text(F.lit(12).cast("bigint"))) == "0000000012"


RAW = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string, loaded_at timestamp"


def message(i, parent=None, inbound="True", text="hello there", at="Mon Jan 01 10:00:00 +0000 2018", resp=None, author="c"):
    return (i, author, inbound, at, text, resp, parent, datetime(2018, 1, 1))


def test_thread_records(spark):
    rows = [
        message("1", resp="2,77"), message("2", "1", "False", author="B"), message("3", "2", text=" "), message("4", "50", at="junk"),
        message("5", "6"), message("6", "5"), message("7", "5"), message("1", resp="2,77", text="other"),
    ]
    got = {r.root: r for r in threads.thread_records(spark.createDataFrame(rows, RAW)).collect()}
    assert sum(r.message_count for r in got.values()) == 7 and set(got) == {1, 4, 5}
    a = got[1]
    assert (a.message_count, a.customer_message_count, a.brand_message_count) == (3, 2, 1) and a.has_conflicting_duplicates
    assert a.response_links_missing == 1 and "missing_response_target" in a.quality_flags and a.has_empty_text
    assert got[4].has_broken_links and got[4].malformed_timestamps == 1 and got[5].cycle_detected and got[5].message_count == 3


def test_rule_labels(spark):
    texts = ["update", "my battery drains and the battery life is bad", "how do i use siri on this", "nothing that matches here", None, "the charger and the camera"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r for r in rules.review_priority(rules.weak_labels(df)).collect()}
    assert got[0].rule_label == "unknown_other" and got[0].rule_matched == "software_update"
    assert (got[1].rule_label, got[1].rule_confidence) == ("battery_power", "high")
    assert got[2].rule_label == "needs_review" and got[2].priority == "critical"
    assert got[3].rule_reason == "no_matching_rules_found" and got[4].rule_reason == "too_short_or_conversational"
    assert got[5].rule_label == "needs_review"


def test_isolation_and_samples(spark):
    df = spark.createDataFrame([(str(i), i % 3) for i in range(300)] + [(None, 1)], "tweet_id string, g int")
    held = spark.createDataFrame([(" 5 ",), ("7.0",), (None,)], "tweet_id string")
    assert isolation.isolated(df, held).count() == 299 and isolation.violations(df, held).count() == 2
    slices = {"a": (F.col("g") == 0, 10), "b": (F.col("g") >= 0, 25)}
    s = isolation.stratified_sample(df.filter("tweet_id is not null"), "tweet_id", slices, "s").cache()
    again = isolation.stratified_sample(df.repartition(7).filter("tweet_id is not null"), "tweet_id", slices, "s")
    assert s.count() == 35 and s.exceptAll(again).count() == 0
    parts = isolation.split_by_hash(df, "tweet_id", {"train": 0.9, "valid": 0.1}, "x").groupBy("split").count().collect()
    assert sum(p["count"] for p in parts) == 301


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c"), (None, "a")], "t string, p string")
    c = metrics.per_class(metrics.confusion(df, "t", "p"))
    by = {r.label: r for r in c.collect()}
    assert by["c"].f1 == 0 and by["a"].recall == 0.5 and by["b"].precision == 0.5
    o = metrics.overall(c).first()
    assert o.accuracy == 0.5 and abs(o.macro_f1 - (2 / 3 + 0.5 + 0) / 3) < 1e-9
    b = metrics.binary(spark.createDataFrame([(False, False)], "t boolean, p boolean"), F.col("t"), F.col("p")).first()
    assert (b.precision, b.recall, b.tn) == (1.0, 1.0, 1)
    assert metrics.class_weights(df, "t").filter("t = 'a'").first().weight == 1.0


def test_top_k_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[50] = v[10]
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 4, str(i % 40)) for i, r in enumerate(v)] + [(999, None, 0, "n")], "id int, vector array<double>, label int, dedup_key string")
    q = df.filter("id % 20 = 0")
    got = {(r.query_id, r.rank): r.id for r in retrieval.top_k(q, df.repartition(5), 4, block=2).collect()}
    for i in range(0, 120, 20):
        s = v @ v[i]
        order = [j for j in sorted(range(120), key=lambda j: (-s[j], j)) if j != i][:4]
        assert [got[(i, k + 1)] for k in range(4)] == order
    assert retrieval.top_k(q, df, 0).count() == 0
    one_each = retrieval.top_k(q, df, 3, dedup=True).join(df.select("id", "dedup_key"), "id")
    assert one_each.groupBy("query_id").agg(F.countDistinct("dedup_key").alias("n")).filter("n <> 3").count() == 0


def test_review_scores(spark):
    e = lambda f, *a: one(spark, f(*[F.lit(x) for x in a]))
    assert e(review.grounding, "restart the phone", "", 1.0) == 0.3 and e(review.overlap, "restart phone", "restart your phone") == 1.0
    assert e(review.completeness, "") == 0.0 and e(review.completeness, "please restart the phone and check it") == 1.0
    assert e(review.new_links, "see https://a.example/x", "none") == ["https://a.example/x"]


def test_classifier_learns(spark):
    rows = [(str(i), ("battery drains fast " if i % 2 else "screen cracked badly ") + f"w{i % 5}", "battery" if i % 2 else "screen") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text string, y string")
    tf = ml.TfIdf(50).fit(df)
    for kind in ("logistic", "svm"):
        model, index = ml.fit_classifier(tf.transform(df), "y", kind, iterations=5)
        assert ml.predict(model, index, tf.transform(df)).filter("prediction_label = y").count() == 60


def test_files(spark, tmp_path):
    src = tmp_path / "m.csv"
    src.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,a,True,x,"line one\nline ""two""",,\n2,b,False,x,None,,1\n')
    df = files.read_messages_csv(spark, str(src))
    assert df.count() == 2 and df.filter("tweet_id = '1'").first().text == 'line one\nline "two"' and df.filter("tweet_id = '2'").first().text == "None"
    with pytest.raises(ValueError):
        files.check_columns(df, ("tweet_id", "nope"))
    files.write_jsonl(df, str(tmp_path / "j"))
    back = files.read_jsonl(spark, str(tmp_path / "j"), df.schema)
    assert files.table_hash(back.repartition(3)).first() == files.table_hash(df).first()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        files.write_jsonl(df, str(tmp_path / "j"))
    assert "| 1 |" in files.markdown_table(df.select("tweet_id"))


def test_streaming_counts(spark, tmp_path):
    from loomwork.streaming.incremental import first_of_id, windowed_counts

    src = str(tmp_path / "in")
    df = spark.createDataFrame([(i % 3, datetime(2024, 1, 1, i // 3)) for i in range(9)], "id int, ts timestamp")
    df.write.parquet(src)
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(src), "ts", ["id"])
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 9
    q = first_of_id(spark.readStream.schema(df.schema).parquet(src), "id", "ts").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 3


def test_entry_has_every_core_query(spark):
    names = __spark_entry__.queries()
    assert {"p1_found", "p7_found", "thread_records", "topk_cosine"} <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_whole_queries_take_texts_in_any_script(spark, tmp_path):
    import html
    import re

    from loomwork.operators.rules import SUPPORT_LEXICON
    from loomwork.plans.reference import QUERIES

    texts = ["La pantalla está rota 😊 battery drain", "あ update", "éupdate ne marche plus", "naïve “wi-fi” and 12345678 plus ñ12345678", "ok ñ", "no news here at all", "write to ü@x.example ９９９９９９９９ now",
             "a &amp; b &lt;c&gt; &quot;d&quot;", "AT&T &amp; update", "refund&hellip; é", "@Ünal https://x.example/a update 日本", None]
    rows = spark.createDataFrame([(i, str(i), f"t{i}", t) for i, t in enumerate(texts)], "doc_id bigint, tweet_id string, thread_id string, text string")
    for name in ("documents", "twcs", "apple_support_intent_training_candidates"):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: QUERIES[name][0](spark, str(tmp_path)).collect()
    known = [t for t in texts if t]
    norm = [" ".join(re.sub(r"@\w+", " ", re.sub(r"https?://\S+", " ", html.unescape(t))).lower().split()) for t in known]
    matched = {}
    for i, x in enumerate(norm):
        matched[str(i)] = "|".join(sorted({r.label for r in SUPPORT_LEXICON if re.search(r.pattern, x)}))
    assert {r.tweet_id: r.matched for r in run("rule_labels")} == matched and matched["2"] == "" and matched["0"]
    assert sum(r.n for r in run("rule_overlap_priority")) == len(known)
    assert {(r.tweet_id, r.n_match) for r in run("short_messages")} == {(str(i), len(x)) for i, x in enumerate(norm) if len(x) < 8}
    assert {r.doc_id: r.masked for r in run("redact_plain")} == {i: re.sub(r"\S+@\S+", "[email]", re.sub(r"\b\d{8,}\b", "[ID]", t)) for i, t in enumerate(known)}
    assert {r.tweet_id: r.decoded for r in run("html_decode")} == {str(i): html.unescape(t) for i, t in enumerate(known)}
