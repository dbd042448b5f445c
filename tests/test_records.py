import copy
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomwork.functions import messages as M
from loomwork.operators import brands, isolation, metrics, ml, profile, retrieval, threads
from loomwork.plans.records import _TAXONOMY
from loomwork.sources import files, tables, taxonomy
from loomwork.streaming.incremental import sessions

RAW = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string, loaded_at timestamp"


def msg(i, parent, who, minute, text="hello there my friend", response=None, loaded=1):
    at = None if minute is None else f"Mon Jan 01 10:{minute:02d}:00 +0000 2018"
    return (str(i), who, str(who.isdigit()), at, text, response, parent, datetime(2018, 1, loaded))


def test_ids_of_nineteen_digits(spark):
    big = "1234567890123456789"
    df = spark.createDataFrame([(big, None), ("5", f" {big}.0 "), ("99999999999999999999", None), ("9223372036854775808", None)], "tweet_id string, in_response_to_tweet_id string")
    got = {(r.id, r.parent) for r in tables.message_links(df).collect()}
    assert got == {(int(big), None), (5, int(big))}


def test_first_mention_is_not_cut(spark):
    long = "x" * 3000
    assert spark.range(1).select(M.first_mention(F.lit(f"hi @{long}! ok"))).first()[0] == long


@pytest.fixture(scope="module")
def conversation(spark):
    rows = [
        msg(1, None, "7", 1, response="2"), msg(2, "1", "B", 2, response="3"), msg(3, "2", "7", 3, "  "), msg(4, "3", "B", None),
        msg(10, None, "8", 5, " "), msg(11, "10", "8", 6), msg(12, "11", "B", 7), msg(20, None, "B", 9), msg(30, None, "9", 4, ""), msg(40, "99", "B", 8),
        msg(2, "1", "B", 2, "changed", loaded=3),
    ]
    return spark.createDataFrame(rows, RAW)


def test_thread_documents_in_parts(spark, conversation):
    docs = [(r.root, r.part, json.loads(r.value)) for r in threads.thread_documents(conversation, part=3).orderBy("root", "part").collect()]
    first = [d for root, _, d in docs if root == 1]
    assert [len(d["messages"]) for d in first] == [3, 1] and [m["tweet_id"] for d in first for m in d["messages"]] == ["0000000001", "0000000002", "0000000003", "0000000004"]
    assert first[0]["message_count"] == 4 and first[0]["has_duplicate_ids"] and first[0]["messages"][1]["text"] != "changed" and first[0]["has_empty_text"]
    assert first[0]["quality_flags"][0] == "malformed_or_missing_timestamp (1)" and first[0]["link_metrics"]["response_links_valid"] == 2
    assert threads.thread_documents(conversation.filter("false")).count() == 0


def test_first_customer_messages(conversation):
    got = {r.root: (r.customer_id, r.reason, r.exclusion) for r in threads.first_customer_messages(threads.placed(conversation)).collect()}
    assert got[1] == (1, "first_customer_message_chronological", None) and got[10] == (11, "subsequent_customer_message_fallback (index 1)", None)
    assert got[20] == (None, None, "no_customer_message") and got[30] == (None, None, "all_customer_messages_empty")
    pairs = threads.exchange_texts(threads.first_exchange(threads.placed(conversation)), conversation).collect()
    assert {(r.root, r.customer_id, r.brand_id) for r in pairs} == {(1, 1, 2), (10, 11, 12)} and all(r.brand_text for r in pairs)


def test_brand_metrics(conversation):
    m = brands.brand_metrics(conversation, ["B", "C"]).collect()
    assert len(m) == 1 and m[0].brand == "B"
    r = m[0]
    # the brand's own 2, 4, 12, 20, 40 (2 twice) and the answered 1, 3, 11
    assert (r.n_rows, r.n_inbound, r.n_outbound, r.n_parent, r.n_parent_valid, r.n_asked_brand) == (9, 3, 6, 7, 5, 1)
    assert (r.n_threads, r.n_both, r.n_exchanges, r.n_single, r.n_broken) == (4, 2, 1, 2, 2)
    ranks = brands.rank_validated(brands.brand_metrics(conversation, ["B"]), {"B": (0.9, 0.1)}).first()
    assert (ranks.volume_rank, ranks.quality_rank) == (1, 1) and brands.rank_first(brands.brand_metrics(conversation, ["B"])).first().rank == 1


def test_validation_report(conversation):
    got = {r["rule"]: (r.severity, r.n) for r in profile.validation_report(conversation, "Nobody").collect()}
    assert got["no rows of the brand"][0] == "error" and got["repeated ids"] == ("warning", 1) and got["ids with conflicting records"] == ("warning", 1) and got["too few ids"][1] == 1
    top = profile.most_repeated(conversation, "text", 2).collect()
    assert top[0].n == 7 and len(top) == 1


def test_taxonomy(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(_TAXONOMY))
    config = taxonomy.read_taxonomy(str(path))
    assert taxonomy.label_names(config)[-1] == "unknown_other" and taxonomy.taxonomy_table(spark, config).filter("is_fallback").count() == 1
    assert taxonomy.label_by_name(config, "battery_power")["escalation_risk"] == "low"
    with pytest.raises(KeyError):
        taxonomy.label_by_name(config, "nope")

    def broken(change):
        c = copy.deepcopy(_TAXONOMY)
        change(c)
        with pytest.raises(taxonomy.TaxonomyError):
            taxonomy.check_taxonomy(c)

    broken(lambda c: c.pop("intents"))
    broken(lambda c: c.update(intents=[]))
    broken(lambda c: c["intents"][0].pop("name"))
    broken(lambda c: c["intents"][1].update(name=c["intents"][0]["name"]))
    broken(lambda c: c["intents"][0].pop("examples"))
    broken(lambda c: c["intents"][0].update(definition=" "))
    broken(lambda c: c.pop("metadata"))
    broken(lambda c: c["metadata"].update(fallback_intent="nope"))


def test_samples_and_requests(spark):
    rows = [(str(i), "battery drains fast" if i % 2 else "x @you https://a.example é", "battery_power" if i % 2 else "needs_review", "high", "rule", "battery drains fast", i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "tweet_id string, text string, candidate_intent string, label_confidence string, label_source string, match_text string, match_count int")
    slices = isolation.audit_slices(["battery_power", "needs_review", "none"])
    drawn = isolation.stratified_sample(df, "tweet_id", slices, "s")
    sizes = {r.slice: (r.requested, r.actual) for r in isolation.sample_sizes(drawn, slices).collect()}
    assert sizes["intent_battery_power"] == (50, 50) and sizes["intent_none"] == (50, 0) and sizes["stratum_rule_overlap"] == (150, 133) and sizes["edge_case_has_url"] == (50, 50)
    union = isolation.sample_union(drawn)
    assert union.count() == union.select("id").distinct().count() == drawn.select("id").distinct().count()
    ten = spark.createDataFrame([(str(i),) for i in range(10)], "tweet_id string")
    got = isolation.cohorts(ten, "tweet_id", [("a", F.lit(True), 3), ("b", F.lit(True), 4), ("c", F.col("tweet_id") == "none", 2)], "s").groupBy("cohort").count().collect()
    assert {r.cohort: r["count"] for r in got} == {"a": 3, "b": 4}
    asked = spark.createDataFrame([("hi", 3, "auto"), (None, 3, "auto"), ("  ", 3, "auto"), ("x" * 2000, 3, "auto"), ("hi", 11, "auto"), ("hi", 1, "odd")], "message string, top_k int, mode string")
    assert [r.error is None for r in isolation.check_requests(asked).collect()] == [True, False, False, False, False, False]


def test_exclusions_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    v = rng.normal(size=(90, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in r], 0, f"th{i % 9}", f" Text {i % 30} ") for i, r in enumerate(v)]
    corpus = spark.createDataFrame(rows, "id int, vector array<double>, label int, thread_id string, text string")
    asked = spark.createDataFrame([(0, rows[0][1], 0, [1, 2], ["th3 "], ["text 4"]), (1, rows[1][1], 0, None, None, None)], "id int, vector array<double>, label int, not_ids array<int>, not_threads array<string>, not_texts array<string>")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.top_k(asked, corpus.repartition(4), 5, dedup=True, min_score=-0.2).collect()}
    for q in (0, 1):
        s = v @ v[q]
        seen, want = set(), []
        for j in sorted(range(90), key=lambda j: (-s[j], j)):
            if j == q or s[j] < -0.2 or (q == 0 and (j in (1, 2) or j % 9 == 3 or j % 30 == 4)) or j % 30 in seen:
                continue
            seen.add(j % 30)
            want.append(j)
        assert [got[q, k + 1] for k in range(5)] == want[:5]


def test_predictions(spark, tmp_path):
    rows = [(str(i), ("battery drains fast " if i % 2 else "screen cracked badly ") + f"w{i % 5}", "battery" if i % 2 else "screen") for i in range(40)] + [("b", " ", "needs_review")]
    df = spark.createDataFrame(rows, "tweet_id string, text string, y string")
    train = df.filter("y <> 'needs_review'")
    tf = ml.TfIdf(50).fit(train)
    for kind in ("logistic", "svm"):
        model, index = ml.fit_classifier(tf.transform(train), "y", kind, iterations=5, weights=metrics.class_weights(train, "y"))
        ml.save_model(model, index, str(tmp_path / kind))
        model, index = ml.load_model(str(tmp_path / kind), type(model))
        scored = ml.predict(model, index, tf.transform(df), "text")
        blank = ml.ambiguous_cases(scored, "y").first()
        assert (blank.prediction_label, blank.confidence, blank.margin, blank.top) == ("unknown_other", 0.0, 0.0, None)
        one = scored.filter("tweet_id = '1'").first()
        assert one.prediction_label == "battery" and one.top[0].label == "battery" and abs(one.top[0].confidence - one.confidence) < 1e-9 and abs(sum(t.confidence for t in one.top) - 1) < 1e-3
    assert spark.range(1).select(ml.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0] == [0.5, 0.5]
    vectors = ml.encode_batches(train, lambda texts: [[float(len(t)), 1.0] for t in texts], "tweet_id", batch=7)
    check = ml.check_vectors(df, vectors, "tweet_id").first()
    assert (check.n_corpus, check.n_vectors, check.n_missing, check.n_off) == (41, 40, 1, 0)
    with pytest.raises(Exception, match="another number"):
        ml.encode_batches(train, lambda texts: [[1.0]], "tweet_id", batch=7).collect()


def test_sinks_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("2", "b"), ("10", "a")], "tweet_id string, inbound string")
    files.write_csv(df, str(tmp_path / "c"), ["inbound", "tweet_id"])
    files.write_csv(df, str(tmp_path / "c"), ["inbound", "tweet_id"], mode="append")
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.columns == ["inbound", "tweet_id"] and back.count() == 4
    files.write_sorted_csv(df, str(tmp_path / "s"), threads.numeric_then_text("tweet_id"))
    assert [r.tweet_id for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == ["2", "10"]
    assert files.sample_rows(spark.createDataFrame([(" TRUE",), ("x",)], "inbound string")).collect()[0].inbound is True
    text = files.markdown_report("Figures", [("Rows", df), ("Note", "none")])
    assert "# Figures" in text and "| 10 | a |" in text and "Only the first 1 rows." in files.markdown_table(df, 1)
    meta = json.loads(files.metadata_json(df.agg(F.count("*").alias("n")), {"seed": 1}))
    assert meta == {"figures": {"n": 2}, "seed": 1}
    src = tmp_path / "m.csv"
    src.write_text("tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n" + "".join(f'{i},a,True,x,"line\nbreak {i}",,\n' for i in range(50)))
    assert files.messages_table(spark, str(src), rows_per_file=20).filter("text like 'line\n%'").count() == 50


def test_sessions(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, m)) for m in (0, 10, 50)] + [(2, datetime(2024, 1, 1))], "id int, ts timestamp")
    assert sorted((r.id, r.n) for r in sessions(df, "ts", "id").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_verdicts_and_latencies(spark):
    df = spark.createDataFrame([("PASS", 0.9, {"g": 1.0}, [("g",)], 1.0), ("FAIL", 0.1, {}, [], 3.0)], "v string, o double, scores map<string,double>, issues array<struct<dimension:string>>, ms double")
    r = metrics.verdict_rates(df, "v", "o", ["g"], "issues").first()
    assert (r.rate_pass, r.rate_fail, r.mean_g, r.issue_g, r.mean_overall) == (0.5, 0.5, 0.5, 0.5, 0.5)
    assert metrics.latency(df, ["ms"]).first().p50_ms == 2.0
    bars = spark.range(1).select(M.bar(F.lit(0.5), 4).alias("b"), M.numbered("BM_", F.lit(7)).alias("i")).first()
    assert (bars.b, bars.i) == ("██░░", "BM_007")
