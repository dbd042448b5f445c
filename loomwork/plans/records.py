"""Queries of thread documents, first messages, brand figures and audit samples, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import brands as B
from loomwork.operators import isolation as I
from loomwork.operators import rules as K
from loomwork.operators import metrics as E
from loomwork.operators import retrieval as R
from loomwork.operators import review as V
from loomwork.operators import threads as H
from loomwork.plans.reference import (
    _ASCII, _BRAND_LIST, _CAND, _DIR, _DOT, _GOLD, _ID, _LABELS, _PRESENT, _REFS, _SCORED, _TIME, _TREE, _USEFUL, BRANDS, _queries, _t, _vectors, query,
)
from loomwork.functions import messages as M
from loomwork.sources.files import table_hash
from loomwork.sources.tables import id_number, id_text
from loomwork.sources.taxonomy import check_taxonomy, taxonomy_table

_ROOT = "lpad(cast({0} as varchar), 10, '0')".format
_FAR = "1152921504606846976"

# ------------------------------------------------------------------ threads

_ORDERED = f"""{_TREE}, f as (select {_ID('tweet_id')} id, arg_min({{'a': author_id, 'c': created_at, 'x': text}}, (loaded_at, coalesce(text, ''))) z from twcs group by 1 having id is not null),
o as (select root, cast(row_number() over (partition by root order by coalesce(t, {_FAR}), cast(m.id as varchar)) as int) "position", m.id, cust from tree join m using (id))"""


@query(f"""with recursive {_ORDERED}
select {_ROOT('root')} root_tweet_id, "position", {_ROOT('o.id')} tweet_id, case when cust then 'customer_inbound' else 'brand_reply' end row_type, z.a author_id, z.c created_at, z.x "text" from o join f using (id)""")
def thread_messages(spark, d):
    """Every message in the order of its thread."""
    rows = H.ordered_messages(_t(spark, d, "twcs"))
    return rows.select(
        id_text("root").alias("root_tweet_id"), "position", id_text("id").alias("tweet_id"), F.when(F.col("is_customer"), "customer_inbound").otherwise("brand_reply").alias("row_type"),
        "author_id", "created_at", "text",
    )


@query(f"""with recursive {_ORDERED}, s as (select root, list(z.c order by "position")[1] s, list(z.c order by "position")[-1] e, string_agg({_ROOT('o.id')}, ',' order by "position") ids, sum(length(coalesce(z.x, ''))) n from o join f using (id) group by 1)
select 'thread_' || {_ROOT('th.root')} thread_id, message_count, customer_message_count, ends_with_brand_reply, cast(response_links_valid as bigint) response_links_valid, s.s start_timestamp, s.e end_timestamp, s.ids, cast(s.n as bigint) n_chars
from th join s on th.root = s.root""")
def thread_documents(spark, d):
    """Thread records as nested JSON with their messages, read back."""
    schema = """thread_id string, part int, message_count bigint, customer_message_count bigint, ends_with_brand_reply boolean, start_timestamp string, end_timestamp string,
     link_metrics struct<response_links_valid: bigint>, messages array<struct<tweet_id: string, text: string>>"""
    x = H.thread_documents(_t(spark, d, "twcs"), part=100_000).select(F.from_json("value", schema).alias("x")).select("x.*")
    return x.select(
        "thread_id", "message_count", "customer_message_count", "ends_with_brand_reply", "link_metrics.response_links_valid", "start_timestamp", "end_timestamp",
        F.array_join("messages.tweet_id", ",").alias("ids"), F.aggregate("messages", F.lit(0).cast("bigint"), lambda a, m: a + F.length(F.coalesce(m["text"], F.lit("")))).alias("n_chars"),
    )


@query(f"""with recursive {_TREE}, c as (select root, m.id, (coalesce(t, {_FAR}), cast(m.id as varchar)) k, trim(text, ' ') = '' e from tree join m using (id) where cust),
g as (select root, min(k) filter (where not e) p, arg_min(id, k) filter (where not e) id from c group by 1),
s as (select c.root, count(*) n from c join g on c.root = g.root where c.k < g.p group by 1)
select {_ROOT('th.root')} root_tweet_id, g.id customer_id, case when g.id is null then null when coalesce(s.n, 0) = 0 then 'first_customer_message_chronological' else 'subsequent_customer_message_fallback (index ' || s.n || ')' end reason,
 case when g.root is null then 'no_customer_message' when g.id is null then 'all_customer_messages_empty' end exclusion
from (select distinct root from tree) th left join g on th.root = g.root left join s on s.root = th.root""")
def first_customer_messages(spark, d):
    """The first customer message of each thread that is not empty, with the reason, or why there is none."""
    return H.first_customer_messages(H.placed(_t(spark, d, "twcs"))).select(id_text("root").alias("root_tweet_id"), "customer_id", "reason", "exclusion")


@query(f"""with recursive {_TREE}, k as (select root, cust, (coalesce(t, {_FAR}), cast(m.id as varchar)) k from tree join m using (id)),
l as (select root, cust, lag(cust) over (partition by root order by k) before, count(*) over (partition by root) n from k)
select n >= 3 three_plus, bool_or(cust and not before and n >= 3) exchanges, count(*) n_messages, root from l group by root, n""")
def thread_exchanges(spark, d):
    """Threads in which a brand message is followed by a customer's."""
    at = H._at()
    g = H.placed(_t(spark, d, "twcs")).groupBy("root").agg(F.count("*").alias("n_messages"), F.min(F.when(~F.col("is_customer"), at)).alias("o"), F.max(F.when(F.col("is_customer"), at)).alias("c"))
    three = F.col("n_messages") >= 3
    return g.select(three.alias("three_plus"), (three & F.coalesce(F.col("o") < F.col("c"), F.lit(False))).alias("exchanges"), "n_messages", "root")


# ------------------------------------------------------------------ brands

_SUBSET = f"""own as (select {_ID('tweet_id')} id, {_ID('in_response_to_tweet_id')} parent, trim(author_id) brand from twcs where lower(trim(inbound)) = 'false' and trim(author_id) in ({_BRAND_LIST})),
p as (select id, brand from own union all select parent, brand from own),
owner as (select id, arg_min(brand, list_position([{_BRAND_LIST}], brand)) brand from p where id is not null and id in (select {_ID('tweet_id')} from twcs) group by 1),
r as (select {_ID('tweet_id')} id, {_ID('in_response_to_tweet_id')} parent, {_DIR} = 'inbound' cust, {_TIME} t, trim(author_id) author, lower(trim(inbound)) = 'false' is_reply, substr(text, 1, 200) "text", response_tweet_id from twcs),
b as (select r.*, owner.brand from r join owner using (id)),
refs as (select distinct id, brand, cast(unnest({_REFS}) as bigint) ref from b),
here as (select id ref, brand rb, bool_or(coalesce(is_reply and author = brand, false)) own from b group by 1, 2),
rs as (select refs.id, bool_and(coalesce(rb = refs.brand, false)) all_here, bool_or(coalesce(rb = refs.brand and own, false)) any_brand from refs left join here using (ref) group by 1),
hp as (select distinct id parent, brand pb from b),
x as (select b.*, coalesce(pb = b.brand, false) valid, {_PRESENT('response_tweet_id')} hr, coalesce(all_here, false) ah, coalesce(any_brand, false) ab from b left join rs using (id) left join hp on b.parent = hp.parent),
rows_ as (select brand, count(*) n_rows, count(*) filter (where cust) n_inbound, count(*) filter (where not cust) n_outbound, count(parent) n_parent, count(*) filter (where valid) n_parent_valid, count(*) filter (where not valid) n_roots,
 count(*) filter (where hr) n_response, count(*) filter (where hr and ah) n_response_valid, count(*) filter (where hr and ab) n_response_brand, count(*) filter (where cust and hr) n_asked_response,
 count(*) filter (where cust and hr and ah) n_asked_valid, count(*) filter (where cust and hr and ab) n_asked_brand, count(*) filter (where {_ASCII} >= 0.85) n_english, count(*) filter (where {_USEFUL} < 3) n_noise,
 count(*) filter (where len(regexp_extract_all(coalesce("text", ''), '__[a-zA-Z]+__')) > 0) n_masked_rows, cast(sum(len(regexp_extract_all(coalesce("text", ''), '__[a-zA-Z]+__'))) as bigint) n_masked from x group by 1),
one as (select id, max(parent) parent, max(brand) brand, bool_or(cust) cust, min(t) t from b group by 1),
lk as (select a.*, coalesce(c.brand = a.brand, false) ok from one a left join one c on c.id = a.parent),
down(id, root) as (select id, id from lk where not ok union all select l.id, d.root from lk l join down d on l.parent = d.id where l.ok),
lost as (select id, parent from lk where ok and id not in (select id from down)),
up(id, seen) as (select id, parent from lost union select u.id, l.parent from up u join lost l on u.seen = l.id),
ring as (select distinct id from up where id = seen),
tree as (select id, root, false cyc from down union all select id, min(seen) filter (where seen in (select id from ring)), id in (select id from ring) from up group by id),
k as (select brand, root, cust, (coalesce(t, {_FAR}), cast(id as varchar)) k, (parent is not null and not ok) or cyc broken from lk join tree using (id)),
l as (select *, lag(cust) over (partition by brand, root order by k) before from k),
th as (select brand, root, count(*) n, count(*) filter (where cust) n_in, coalesce(bool_or(cust and not before), false) back, arg_max(not cust, k) ends, bool_or(broken) broken from l group by 1, 2),
threads_ as (select brand, count(*) n_threads, count(*) filter (where n = 1) n_single, count(*) filter (where n_in > 0 and n_in < n) n_both, count(*) filter (where n >= 3) n_three_plus, count(*) filter (where n >= 3 and back) n_exchanges,
 count(*) filter (where ends) n_ends_brand, count(*) filter (where broken) n_broken, round(avg(n), 2) avg_length, quantile_cont(n, 0.5) median_length, min(n) min_length, max(n) max_length from th group by 1),
mentions as (select unnest(list_filter([{_BRAND_LIST}], lambda z: contains(coalesce(w.text, ''), '@' || z))) brand from twcs w where {_DIR} = 'inbound' and {_ID('tweet_id')} not in (select id from owner)),
una as (select brand, count(*) n_unanswered from mentions group by 1),
m as (select * from rows_ join threads_ using (brand) left join una using (brand))"""


def _pct(part: str, whole: str) -> str:
    return f"round({part} / greatest({whole}, 1) * 100, 1)"


_LINK_COLS = ["n_rows", "n_inbound", "n_outbound", "n_parent", "n_parent_valid", "n_roots", "n_response", "n_response_valid", "n_response_brand", "n_asked_response", "n_asked_valid", "n_asked_brand"]
_TEXT_COLS = ["n_english", "n_noise", "n_masked_rows", "n_masked", "n_threads", "n_single", "n_both", "n_three_plus", "n_exchanges", "n_ends_brand", "n_broken", "avg_length", "median_length", "min_length", "max_length"]
_SHARES = {
    "pct_parent": ("n_parent", "n_rows"), "pct_response": ("n_response", "n_rows"), "pct_parent_valid": ("n_parent_valid", "n_parent"), "pct_response_valid": ("n_response_valid", "n_response"),
    "pct_asked_response": ("n_asked_response", "n_inbound"), "pct_asked_valid": ("n_asked_valid", "n_inbound"), "pct_asked_brand": ("n_asked_brand", "n_inbound"), "pct_english": ("n_english", "n_rows"),
    "pct_noise": ("n_noise", "n_rows"), "pct_both": ("n_both", "n_threads"), "pct_three_plus": ("n_three_plus", "n_threads"), "pct_exchanges": ("n_exchanges", "n_threads"),
    "pct_ends_brand": ("n_ends_brand", "n_threads"), "pct_broken": ("n_broken", "n_threads"), "pct_multi": ("(n_threads - n_single)", "n_threads"),
}
_SHARE_SQL = ", ".join(f"{_pct(a, b)} {c}" for c, (a, b) in _SHARES.items())
_ALL = f"{_SUBSET}, q as (select *, {_SHARE_SQL} from m)"


@query(f"with recursive {_ALL} select brand, {', '.join(_LINK_COLS)}, coalesce(n_unanswered, 0) n_unanswered, {_pct('n_asked_brand', '(n_inbound + coalesce(n_unanswered, 0))')} pct_answered from q")
def brand_links(spark, d):
    """Messages, link fields, valid links, three levels of response coverage and the response rate of each brand."""
    return B.brand_metrics(_t(spark, d, "twcs"), BRANDS).select("brand", *_LINK_COLS, "n_unanswered", "pct_answered")


@query(f"with recursive {_ALL} select brand, {', '.join(_TEXT_COLS)}, {', '.join(_SHARES)} from q")
def brand_threads(spark, d):
    """Text quality and threads of each brand, with percentages."""
    return B.brand_metrics(_t(spark, d, "twcs"), BRANDS).select("brand", *_TEXT_COLS, *_SHARES)


_JUDGED = {"AppleSupport": (0.85, 0.55)}
_RANK = f"""{_ALL}, j as (select *, n_outbound / max(n_outbound) over () v, pct_english / 100 * (1 - pct_noise / 100) e, case brand when 'AppleSupport' then 0.85 else 0.5 end g, case brand when 'AppleSupport' then 0.55 else 0.5 end u from q)"""


@query(f"""with recursive {_RANK}, s as (select brand, round(v * 0.2 + (0.5 * pct_ends_brand / 100 + 0.5 * pct_multi / 100) * 0.2 + g * 0.2 + e * 0.15 + v * 0.15 + u * 0.1, 4) score from j)
select brand, score, row_number() over (order by score desc, brand) rank from s""")
def brand_rank_first(spark, d):
    """The first weighted ranking of the brands."""
    return B.rank_first(B.brand_metrics(_t(spark, d, "twcs"), BRANDS), _JUDGED)


@query(f"""with recursive {_RANK}, s as (select brand, round(v * 0.2 + pct_both / 100 * 0.2 + g * 0.2 + e * 0.15 + v * 0.15 + u * 0.1, 4) volume_score,
 round((0.4 * pct_both / 100 + 0.3 * pct_three_plus / 100 + 0.3 * pct_exchanges / 100) * 0.3 + g * 0.25 + e * 0.25 + u * 0.2, 4) quality_score from j)
select brand, volume_score, quality_score, row_number() over (order by volume_score desc, brand) volume_rank, row_number() over (order by quality_score desc, brand) quality_rank from s""")
def brand_rank_validated(spark, d):
    """The rankings by volume and by quality."""
    return B.rank_validated(B.brand_metrics(_t(spark, d, "twcs"), BRANDS), _JUDGED)


# ------------------------------------------------------------------ audit samples

_PILOT = {"intent": 7, "confidence": 20, "source": 12, "overlap": 20, "risk": 12, "edge": 10}
_INTENTS = [*_LABELS, K.FALLBACK, K.REVIEW]


def _audit_rows(spark, d):
    rows = _t(spark, d, _CAND).filter("tweet_id is not null").select("tweet_id", "text", "candidate_intent", "label_confidence", "label_source")
    return K.weak_labels(rows.withColumn("match_text", K.match_form("text"))).withColumnRenamed("rule_match_count", "match_count")


def _audit_sql(sizes: dict[str, int], seed: str) -> str:
    n = {"intent": 50, "confidence": 100, "source": 100, "overlap": 150, "risk": 100, "edge": 50} | sizes
    rules = [(f"intent_{x}", f"candidate_intent = '{x}'", n["intent"]) for x in _INTENTS] + [(f"confidence_{x}", f"label_confidence = '{x}'", n["confidence"]) for x in ("high", "medium", "low")]
    rules += [(f"source_{x}", f"label_source = '{x}'", n["source"]) for x in ("rule", "fallback", "needs_review")] + [("stratum_rule_overlap", "k > 1", n["overlap"])]
    rules += [(f"high_risk_{x}", f"candidate_intent = '{x}'", n["risk"]) for x in ("software_update", "unknown_other", "needs_review")]
    rules += [("edge_case_short_message", "case when x = '' then 0 else len(string_split(x, ' ')) end <= 5", n["edge"]), ("edge_case_has_url", "regexp_matches(coalesce(text, ''), 'https?://')", n["edge"]),
              ("edge_case_has_mention", "regexp_matches(coalesce(text, ''), '@[A-Za-z0-9_]')", n["edge"]), ("edge_case_has_emoji_or_special", "regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]')", n["edge"])]
    hits = ", ".join(f"case when {c} then {{'slice': '{s}', 'quota': {q}}} end" for s, c, q in rules)
    scored = _SCORED.replace("tweet_id, thread_id,", "tweet_id, candidate_intent, label_confidence, label_source, text,").replace("where text is not null)", "where tweet_id is not null)")
    return f"""with {scored}, e as (select distinct tweet_id id, sha256('{seed}:' || tweet_id) o, unnest(list_filter([{hits}], lambda z: z is not null)) z from l),
drawn as (select z.slice slice, id from (select *, row_number() over (partition by z.slice order by o, id) rn from e) where rn <= z.quota), asked as (select * from (values {', '.join(f"('{s}', {q})" for s, _, q in rules)}) t(slice, requested))"""


@query(_audit_sql({}, "audit") + " select id, string_agg(slice, '|' order by slice) slices from drawn group by 1")
def audit_sample(spark, d):
    """A sampling operator: the union of all slices of an audit, with the slices that drew each row."""
    return I.sample_union(I.stratified_sample(_audit_rows(spark, d), "tweet_id", I.audit_slices(_INTENTS), "audit"))


@query(_audit_sql({}, "audit") + " select slice, requested, cast(count(id) as int) actual from asked left join drawn using (slice) group by 1, 2")
def audit_sizes(spark, d):
    """Rows asked for and drawn in each slice of the audit."""
    slices = I.audit_slices(_INTENTS)
    return I.sample_sizes(I.stratified_sample(_audit_rows(spark, d), "tweet_id", slices, "audit"), slices)


@query(_audit_sql(_PILOT, "pilot") + " select id, string_agg(slice, '|' order by slice) slices from drawn group by 1")
def pilot_sample(spark, d):
    """A sampling operator: the compact sample for a first round of annotation."""
    return I.sample_union(I.stratified_sample(_audit_rows(spark, d), "tweet_id", I.audit_slices(_INTENTS, _PILOT), "pilot"))


@query(f"""with e as (select distinct tweet_id id, substr(text, 1, 120) example, trim(author_id) brand, sha256('examples:' || tweet_id) o from twcs
 where tweet_id is not null and lower(trim(inbound)) = 'false' and trim(author_id) in ({_BRAND_LIST}) and {_USEFUL} >= 3)
select brand, id, example from (select *, row_number() over (partition by brand order by o, id, example) rn from e) where rn <= 5""")
def example_messages(spark, d):
    """A sampling operator: five messages of each brand that say something, in a seeded order."""
    from pyspark.sql import Window

    rows = _t(spark, d, "twcs").filter((F.lower(F.trim("inbound")) == "false") & F.trim("author_id").isin(*BRANDS) & (M.useful_words("text") >= 3) & F.col("tweet_id").isNotNull())
    rows = rows.select(F.col("tweet_id").alias("id"), F.substring("text", 1, 120).alias("example"), F.trim("author_id").alias("brand"), I.seeded_order("tweet_id", "examples").alias("o")).distinct()
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("brand").orderBy("o", "id", "example"))).filter("rn <= 5").select("brand", "id", "example")


@query(f"select *, coalesce(candidate_intent, '') preliminary, text cleaned, '' verified_intent, '' verified_by from (select tweet_id, text, candidate_intent from {_CAND})")
def review_view(spark, d):
    """Candidates with the names and empty columns that reviewers work with."""
    rows = _t(spark, d, _CAND).select("tweet_id", "text", "candidate_intent").withColumn("p", F.coalesce("candidate_intent", F.lit("")))
    return I.review_view(rows, {"preliminary": "p", "cleaned": "text"}, ["verified_intent", "verified_by"]).drop("p")


@query("""select benchmark_id, case when customer_message is null or length(customer_message) < 1 then 'message is missing' when length(customer_message) > 140 then 'message is too long'
 when not regexp_matches(customer_message, '\\S') then 'message is blank' end error from benchmark_cases""")
def request_errors(spark, d):
    """Held-out messages as requests of at most 140 characters: the first rule that each breaks."""
    rows = _t(spark, d, "benchmark_cases").select("benchmark_id", F.col("customer_message").alias("message"), F.lit(5).alias("top_k"), F.lit("auto").alias("mode"))
    return I.check_requests(rows, 140).select("benchmark_id", "error")


_TAXONOMY = {
    "intents": [
        {"name": x, "display_name": x.replace("_", " "), "definition": "messages of the kind " + x, "inclusion_criteria": [x], "exclusion_criteria": [], "auto_handle": x != "billing_payment", "escalation_risk": "low", "examples": []}
        for x in [*_LABELS, K.FALLBACK]
    ],
    "metadata": {"fallback_intent": K.FALLBACK},
}


@query(f"""with n as (select * from (values {', '.join(f"('{x}', {i})" for i, x in enumerate([*_LABELS, K.FALLBACK]))}) t(name, ord))
select name, ord, name = '{K.FALLBACK}' is_fallback, count(tweet_id) n from n left join {_CAND} c on c.candidate_intent = n.name group by 1, 2, 3""")
def taxonomy_counts(spark, d):
    """Candidates of every label of a checked taxonomy."""
    labels = taxonomy_table(spark, check_taxonomy(_TAXONOMY)).select("name", "ord", "is_fallback")
    n = _t(spark, d, _CAND).groupBy(F.col("candidate_intent").alias("name")).agg(F.count("tweet_id").alias("n"))
    return labels.join(n, "name", "left").select("name", "ord", "is_fallback", F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------------------------ retrieval and review


@query(f"""with s as (select q.vec_id query_id, c.vec_id id, {_DOT} score from embeddings q, embeddings c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and c.vec_id <> q.vec_id + 1 and c.label % 7 <> q.label % 7 and cast(c.vec_id % 50 as varchar) <> cast(q.vec_id % 50 as varchar)),
u as (select *, row_number() over (partition by query_id, id % 50 order by score desc, id) k from s where score >= 0.1),
r as (select *, row_number() over (partition by query_id order by score desc, id) rank from u where k = 1) select query_id, cast(rank as int) rank, id, round(score, 5) score from r where rank <= 5""")
def topk_exclusions(spark, d):
    """Nearest neighbours of 0.1 and more without stated ids, threads and texts, one for each text."""
    c = _vectors(spark, d).withColumns({"thread_id": (F.col("label") % 7).cast("string"), "text": F.concat(F.lit(" T"), (F.col("id") % 50).cast("string"))})
    q = _queries(spark, d).withColumns({
        "not_ids": F.array(F.col("id") + 1), "not_threads": F.array((F.col("label") % 7).cast("string")), "not_texts": F.array(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"), F.lit(" "))),
    })
    return R.top_k(q, c, 5, dedup=True, min_score=0.1).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


def _reviewed(spark, d):
    """A reviewed record of every held-out case, made from its fields by fixed rules."""
    n = F.length(F.coalesce("customer_message", F.lit("")))
    base = _t(spark, d, "benchmark_cases").select("benchmark_id", n.alias("n"))
    score = (F.col("n") % 10) / 10.0
    verdict = F.when(score < 0.3, "FAIL").when(score < 0.6, "NEEDS_HUMAN_REVIEW").otherwise("PASS")
    scores = F.when(F.col("n") % 3 == 0, F.create_map(F.lit("grounding"), score)).otherwise(F.create_map(F.lit("grounding"), score, F.lit("relevance"), F.lit(1.0)))
    issues = F.when(F.col("n") % 4 == 0, F.array(F.struct(F.lit("relevance").alias("dimension")))).otherwise(F.array().cast("array<struct<dimension:string>>"))
    return base.select("benchmark_id", score.alias("overall"), verdict.alias("verdict"), scores.alias("scores"), issues.alias("issues"), (F.col("n") * 2.0).alias("ms_a"), (F.col("n") % 7).cast("double").alias("ms_b"))


_RECORDS = """r as (select length(coalesce(customer_message, '')) n from benchmark_cases), v as (select n, n % 10 / 10.0 s from r)"""


@query(f"""with {_RECORDS} select count(*) n, round(avg(case when s >= 0.6 then 1.0 else 0 end), 4) rate_pass, round(avg(case when s >= 0.3 and s < 0.6 then 1.0 else 0 end), 4) rate_needs_human_review,
 round(avg(case when s < 0.3 then 1.0 else 0 end), 4) rate_fail, round(avg(s), 4) mean_overall, round(avg(s), 4) mean_grounding, round(avg(case when n % 3 = 0 then 0.0 else 1.0 end), 4) mean_relevance,
 0.0 issue_grounding, round(avg(case when n % 4 = 0 then 1.0 else 0 end), 4) issue_relevance from v""")
def verdict_rates(spark, d):
    """Shares of verdicts, mean scores and issue rates of reviewed records."""
    return E.verdict_rates(_reviewed(spark, d), "verdict", "overall", ["grounding", "relevance"], "issues")


def _lat(c: str, e: str) -> str:
    return f"select '{c}' component, round(avg({e}), 2) mean_ms, round(stddev_pop({e}), 2) std_ms, round(min({e}), 2) min_ms, round(quantile_cont({e}, 0.5), 2) p50_ms, round(quantile_cont({e}, 0.95), 2) p95_ms, round(max({e}), 2) max_ms from r"


@query(f"with {_RECORDS} {_lat('ms_a', 'cast(n * 2 as double)')} union all {_lat('ms_b', 'cast(n % 7 as double)')}")
def latency_stats(spark, d):
    """Latency figures of several components."""
    return E.latency(_reviewed(spark, d), ["ms_a", "ms_b"])


_TOK = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '\\b[a-z]{{3,}}\\b'), lambda w: not list_contains([" + ", ".join(f"'{w}'" for w in V.STOPWORDS) + "], w))"


@query(f"""with t as (select tweet_id, {_TOK.format("regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')")} a, {_TOK.format("regexp_replace(coalesce(label_reason, '') || ' ' || coalesce(candidate_intent, ''), '_', ' ', 'g')")} e from {_CAND})
select tweet_id, case when len(a) > 0 then round(len(list_filter(a, lambda w: list_contains(e, w))) / len(a), 9) end overlap from t""")
def token_overlap(spark, d):
    """Share of a message's words that stand in the reason of its label."""
    text = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    reason = F.regexp_replace(F.concat_ws(" ", F.coalesce("label_reason", F.lit("")), F.coalesce("candidate_intent", F.lit(""))), "_", " ")
    return _t(spark, d, _CAND).select("tweet_id", F.round(V.overlap(text, reason), 9).alias("overlap"))


def _hash_sql(t: str, cols: list[str]) -> str:
    row = "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(cast({c} as varchar), chr(0))" for c in sorted(cols)) + "))"
    part = lambda i: f"cast(coalesce(sum(cast(('0x' || substr(h, {1 + 8 * i}, 8)) as bigint)), 0) as varchar)"
    return f"select '{t}' \"table\", count(*) n_rows, sha256(concat_ws('-', {', '.join(part(i) for i in range(4))}, cast(count(*) as varchar))) content_hash from (select {row} h from {t})"


_CASES = ["benchmark_id", "tweet_id", "thread_id", "customer_message", "cohort", "ground_truth_intent", "intent_label_source", "expected_escalate", "expected_escalation_rule", "escalation_label_source", "notes"]


@query(_hash_sql("benchmark_cases", _CASES) + " union all " + _hash_sql("context_budgets", ["budget_id", "purpose", "capacity_tokens"]))
def table_fingerprints(spark, d):
    """Order-independent content hashes of the fixed tables."""
    one = lambda n, cols: table_hash(_t(spark, d, n).select(*cols)).withColumn("table", F.lit(n))
    return one("benchmark_cases", _CASES).unionByName(one("context_budgets", ["budget_id", "purpose", "capacity_tokens"]))


@query(f"""select n_threads, n, {"repeat('█', cast(round(least(1.0, n / 5000.0) * 20) as int)) || repeat('░', 20 - cast(round(least(1.0, n / 5000.0) * 20) as int))"} bar, 'BR_' || lpad(cast(n_threads as varchar), 3, '0') code
from (select brand_message_count n_threads, count(*) n from {_CAND} where brand_message_count between 0 and 999 group by 1)""")
def count_bars(spark, d):
    """Candidates by brand messages, with a bar and a numbered id."""
    g = _t(spark, d, _CAND).filter("brand_message_count between 0 and 999").groupBy(F.col("brand_message_count").alias("n_threads")).agg(F.count("*").alias("n"))
    return g.select("n_threads", "n", M.bar(F.col("n") / 5000.0).alias("bar"), M.numbered("BR_", F.col("n_threads")).alias("code"))
