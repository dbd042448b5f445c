"""Queries of the text-preparation problems and their SQL twins."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.formatting_duplicates import collapse, formatting_pairs
from loomwork.llm.language import doubtful_languages, identify
from loomwork.llm.cross_split import cosine_pairs, cross_split_overlaps, word_classes
from loomwork.llm.leakage import leaked_passages
from loomwork.llm.truncation import truncated, truncation_by_source
from loomwork.llm.personal_data import learn_names, redact_rows, types_found
from loomwork.llm.conversations import clock_evidence, message_facts, rebuild_conversations, reply_constraints
from loomwork.llm.packing import fill_report, pack, token_sizes
from loomwork.session import written
from loomwork.sources.tables import id_number, id_text, table


def _language_rows(spark: SparkSession, folder: str, how: str) -> DataFrame:
    twcs = table(spark, folder, "twcs").select(id_number("tweet_id").alias("key"), "text", F.col("author_id").alias("host"))
    labels = table(spark, folder, "tweet_langs").select(id_number("tweet_id").alias("key"), F.col("lang").alias("label")).distinct()
    # joined first: rows without a label need no comparison
    return twcs.join(labels, "key", how).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the labelled messages whose label is missing or wrong or whose text is mixed."""
    found = doubtful_languages(identify(_language_rows(spark, folder, "inner")))
    return found.select(id_text("key").alias("tweet_id"), "lang").distinct()


def p2_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of every message with its language and confidence, labelled or not."""
    result = identify(_language_rows(spark, folder, "left"))
    return result.select(
        id_text("key").alias("tweet_id"), "declared", F.posexplode("passages").alias("passage", "p"),
    ).select(
        "tweet_id", "declared", "passage", F.col("p.lang").alias("lang"), F.round("p.confidence", 4).alias("confidence"),
        F.col("p.first_word").alias("first_word"), F.col("p.n_words").alias("n_words"),
    )


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "twcs").select(id_number("tweet_id").alias("id"), "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Smallest id of each group of messages that differ in writing only, with each other id."""
    rows = formatting_pairs(_messages(spark, folder))
    return rows.select(id_text("first").alias("tweet_id_first"), id_text("id").alias("tweet_id_copy"))


def p5_copies(spark: SparkSession, folder: str) -> DataFrame:
    """How many messages have how many copies."""
    return collapse(_messages(spark, folder)).groupBy("copies").agg(F.count("*").alias("n_texts"))


def _splits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    golden = table(spark, folder, "apple_support_intent_golden_set").select(id_number("tweet_id").alias("id"), "text")
    train = table(spark, folder, "apple_support_intent_training_candidates").select(id_number("tweet_id").alias("id"), "text")
    return golden, train


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out messages that occur again, exactly or nearly, among the training candidates."""
    pairs = cross_split_overlaps(*_splits(spark, folder))
    return pairs.select(id_text("eval_id").alias("golden_tweet_id"), id_text("train_id").alias("train_tweet_id")).distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps by evaluation split and origin of the candidate."""
    pairs = cross_split_overlaps(*_splits(spark, folder))
    golden = table(spark, folder, "apple_support_intent_golden_set").select(id_number("tweet_id").alias("eval_id"), "evaluation_split")
    origin = table(spark, folder, "apple_support_intent_training_candidates").select(
        id_number("tweet_id").alias("train_id"), "selection_reason"
    ).distinct()
    return pairs.join(golden.distinct(), "eval_id").join(origin, "train_id").groupBy("evaluation_split", "selection_reason").agg(
        F.countDistinct("eval_id").alias("n_golden"),
        F.countDistinct("train_id").alias("n_train"),
        F.countDistinct("eval_id", "train_id").alias("n_pairs"),
    )


def p4_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of equal word sets of both splits whose rarity-weighted cosine is 0.8 or more, by twentieths."""
    golden, train = _splits(spark, folder)
    pairs = cosine_pairs(word_classes(golden)[1], word_classes(train)[1], 0.8, "idf")
    return pairs.groupBy(F.least(F.floor(F.col("cosine") * 20 + 1e-9), F.lit(20)).alias("twentieth")).agg(F.count("*").alias("n_pairs"))


def _held_out(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark_cases").select(F.col("benchmark_id").alias("item"), F.col("customer_message").alias("text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share twelve words in a row with a held-out item."""
    found = leaked_passages(table(spark, folder, "documents"), _held_out(spark, folder))
    return found.select("doc_id", F.col("item").alias("benchmark_id"))


def p9_proximity(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with twelve words of an item near the places they have in it (three words of play)."""
    found = leaked_passages(table(spark, folder, "documents"), _held_out(spark, folder), slack=3)
    return found.select("doc_id", F.col("item").alias("benchmark_id"), "n_matched", "longest_run")


_DECODED = (
    "replace(replace(replace(replace(replace(replace(coalesce({0},''), '&#39;', ''''), '&quot;', '\"'), "
    "'&lt;', '<'), '&gt;', '>'), '&AMP;', '&'), '&amp;', '&')"
)
_WORDS = "regexp_extract_all(regexp_replace(lower({0}), '[''’‘ʼ＇]', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"
_BARE = "regexp_replace(regexp_replace({0}, '(?i)https?://\\S+', ' ', 'g'), '@[\\p{{L}}\\p{{N}}_]+', ' ', 'g')"


def _sql_words(column: str, bare: bool) -> str:
    return _WORDS.format(_BARE.format(_DECODED.format(column)) if bare else _DECODED.format(column))


_P4_PAIRS = f"""g as (select distinct cast(tweet_id as bigint) id, list_distinct({_sql_words('text', True)}) w from apple_support_intent_golden_set),
t as (select distinct cast(tweet_id as bigint) id, list_distinct({_sql_words('text', True)}) w from apple_support_intent_training_candidates),
pairs as (select g.id gid, t.id tid from g, t where len(g.w) > 0 and len(t.w) > 0
 and 2 * len(list_intersect(g.w, t.w)) >= 0.8 * (len(g.w) + len(t.w)) - 1e-9)"""
P4_SQL = f"""with {_P4_PAIRS}
select distinct lpad(cast(gid as varchar), 10, '0') golden_tweet_id, lpad(cast(tid as varchar), 10, '0') train_tweet_id from pairs"""
P4_REPORT_SQL = f"""with {_P4_PAIRS}
select evaluation_split, selection_reason, count(distinct gid) n_golden, count(distinct tid) n_train, count(distinct (gid, tid)) n_pairs
from pairs join (select distinct cast(tweet_id as bigint) gid, evaluation_split from apple_support_intent_golden_set) using (gid)
join (select distinct cast(tweet_id as bigint) tid, selection_reason from apple_support_intent_training_candidates) using (tid)
group by 1, 2"""
P4_WEIGHTED_SQL = f"""with g as (select row_number() over () i, w from (select distinct list_sort(list_distinct({_sql_words('text', True)})) w from apple_support_intent_golden_set where tweet_id is not null) where len(w) > 0),
t as (select row_number() over () i, w from (select distinct list_sort(list_distinct({_sql_words('text', True)})) w from apple_support_intent_training_candidates where tweet_id is not null) where len(w) > 0),
df as (select term, ln(1.0 + ((select count(*) from g) + (select count(*) from t)) / count(*)) x from (select unnest(w) term from g union all select unnest(w) from t) group by 1),
gx as (select i, term, x from (select i, unnest(w) term from g) join df using (term)), tx as (select i, term, x from (select i, unnest(w) term from t) join df using (term)),
gn as (select i, sqrt(sum(x * x)) n from gx group by 1), tn as (select i, sqrt(sum(x * x)) n from tx group by 1),
c as (select gx.i gi, tx.i ti, sum(gx.x * tx.x) d from gx join tx using (term) group by 1, 2),
s as (select d / (gn.n * tn.n) cosine from c join gn on gn.i = gi join tn on tn.i = ti)
select cast(least(floor(cosine * 20 + 1e-9), 20) as bigint) twentieth, count(*) n_pairs from s where cosine >= 0.8 - 1e-9 group by 1"""
P9_SQL = f"""with d as (select doc_id, {_sql_words('text', False)} w from documents),
i as (select benchmark_id, {_sql_words('customer_message', False)} w from benchmark_cases),
dg as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) g from d where len(w) >= 12),
ig as (select distinct benchmark_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) g from i where len(w) >= 12)
select distinct doc_id, benchmark_id from dg join ig using (g)"""
P9_NEAR_SQL = f"""with d as (select doc_id, {_sql_words('text', False)} w from documents),
i as (select benchmark_id, {_sql_words('customer_message', False)} w from benchmark_cases),
dp as (select doc_id, unnest(w) term, unnest(range(len(w))) pos from d where len(w) >= 12),
ip as (select benchmark_id, unnest(w) term, unnest(range(len(w))) q from i where len(w) >= 12),
h as (select doc_id, benchmark_id, q, pos - q diag from dp join ip using (term)),
near as (select *, count(*) over (partition by doc_id, benchmark_id order by diag range between current row and 6 following) n from h),
a as (select distinct doc_id, benchmark_id, diag from near where n >= 12),
w as (select a.doc_id, a.benchmark_id, a.diag, h.q from a join h on a.doc_id = h.doc_id and a.benchmark_id = h.benchmark_id and h.diag between a.diag and a.diag + 6 group by all),
r as (select *, q - row_number() over (partition by doc_id, benchmark_id, diag order by q) island, count(*) over (partition by doc_id, benchmark_id, diag) n from w),
g as (select doc_id, benchmark_id, max(n) n, count(*) run from r where n >= 12 group by doc_id, benchmark_id, diag, island)
select doc_id, benchmark_id, cast(max(n) as int) n_matched, cast(max(run) as int) longest_run from g group by 1, 2"""


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncated(table(spark, folder, "documents")).filter("cut").select("doc_id").distinct()


def p10_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts its texts off."""
    return truncation_by_source(truncated(table(spark, folder, "documents")))


def _personal(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "twcs").select(id_number("tweet_id").alias("key"), "text")


def _key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms: the setting spark.loomwork.pseudonym.key (hexadecimal), or else one drawn for this application."""
    given = spark.conf.get("spark.loomwork.pseudonym.key", None)
    if given is None:
        given = secrets.token_hex(32)
        spark.conf.set("spark.loomwork.pseudonym.key", given)
    return bytes.fromhex(given)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Types of personal details in each message."""
    return types_found(_personal(spark, folder), _key(spark)).select(id_text("key").alias("tweet_id"), "pii_type")


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The messages that hold personal details, with pseudonymous placeholders."""
    texts = _personal(spark, folder).filter(F.col("key").isNotNull())
    rows = redact_rows(texts, _key(spark), learn_names(texts)).filter(F.size("types") > 0)
    return rows.select(id_text("key").alias("tweet_id"), "redacted", F.array_join("types", ",").alias("types")).distinct()


def p6_names(spark: SparkSession, folder: str) -> DataFrame:
    """The words that the messages' contexts show to be names."""
    return learn_names(_personal(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every message of every kept conversation, in order of the corrected times.

    TESTDATA.md drops no conversation for a reply that is older than its parent, so there is no tolerance."""
    rows = rebuild_conversations(table(spark, folder, "twcs"))
    return rows.select(id_text("root").alias("root_tweet_id"), "turn", id_text("id").alias("tweet_id"), "role")


def p3_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Kept conversations by length if replies that stay before their parents by more than a minute reject theirs."""
    rows = rebuild_conversations(table(spark, folder, "twcs"), tolerance=60)
    sizes = rows.groupBy("root").agg(
        F.count("*").alias("n_turns"), F.count(F.when(F.col("t") != F.col("time"), 1)).alias("n_moved")
    )
    return sizes.groupBy("n_turns").agg(F.count("*").alias("n_conversations"), F.sum("n_moved").alias("n_moved"))


def p3_clocks(spark: SparkSession, folder: str) -> DataFrame:
    """How many senders have how many reply constraints, and how many of these are broken."""
    facts = written(message_facts(table(spark, folder, "twcs")), "facts")
    per = clock_evidence(written(reply_constraints(facts), "constraints"))
    return per.groupBy("n_replies", "n_replies_broken", "n_answered", "n_answered_broken").agg(F.count("*").alias("n_senders"))


_ID_SQL = "try_cast(regexp_extract(coalesce({0},''), '^\\s*(\\d{{1,19}})(\\.0+)?\\s*$', 1) as bigint)"
_TIME_SQL = (
    "case when regexp_matches(trim(coalesce(created_at,'')), '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \\d{2} \\d{2}:\\d{2}:\\d{2} [+-]\\d{4} \\d{4}$') "
    "then epoch(try_strptime(substr(trim(created_at), 5), '%b %d %H:%M:%S %z %Y')) end"
)
_CONTENT_SQL = f"regexp_matches({_BARE.format(_DECODED.format('text'))}, '[\\p{{L}}\\p{{N}}]')"
P3_SQL = f"""with recursive facts as (
  select {_ID_SQL.format('tweet_id')} id, max({_ID_SQL.format('in_response_to_tweet_id')}) parent,
   max(case when lower(trim(coalesce(inbound,''))) in ('true','1') then 'customer' when lower(trim(coalesce(inbound,''))) in ('false','0') then 'brand'
     when author_id is null or regexp_matches(author_id, '^\\s*\\d+\\s*$') then 'customer' else 'brand' end) role,
   coalesce(min({_TIME_SQL}), 1e18) t, bool_or(coalesce({_CONTENT_SQL}, false)) content
  from twcs group by 1 having id is not null),
linked as (select n.*, p.id is not null ok from facts n left join facts p on n.parent = p.id),
down(id, root, broken) as (select id, id, parent is not null from linked where not ok
  union all select l.id, d.root, d.broken from linked l join down d on l.parent = d.id where l.ok),
m as (select f.*, d.root, d.broken from facts f join down d using (id)),
firsts as (select root, min(row(t, id)) filter (where role = 'customer' and content) a, max(row(t, id)) filter (where role = 'brand' and content) b
  from m where not broken group by 1)
select lpad(cast(m.root as varchar), 10, '0') root_tweet_id, cast(row_number() over (partition by m.root order by m.t, m.id) as int) turn,
  lpad(cast(m.id as varchar), 10, '0') tweet_id, m.role
from m join firsts f on m.root = f.root where not m.broken and f.b > f.a"""

P3_CLOCKS_SQL = f"""with facts as (
  select {_ID_SQL.format('tweet_id')} id, max({_ID_SQL.format('in_response_to_tweet_id')}) parent, min({_TIME_SQL}) t, max(author_id) sender from twcs group by 1 having id is not null),
c as (select a.sender cs, b.sender ps, b.t - a.t gap from facts a join facts b on a.parent = b.id where a.sender <> b.sender and b.t - a.t <= 86400),
e as (select cs sender, true r, gap > 0 b from c union all select ps, false, gap > 0 from c),
s as (select sender, count(*) filter (where r) n_replies, count(*) filter (where r and b) n_replies_broken, count(*) filter (where not r) n_answered, count(*) filter (where not r and b) n_answered_broken from e group by 1)
select n_replies, n_replies_broken, n_answered, n_answered_broken, count(*) n_senders from s group by all"""


_SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_DROPPED = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')".format
_LEADING = rf"^{_SP}*((?:@[\p{{L}}\p{{N}}_]+(?:{_SP}|[:,])*)*)"
_OPEN = (  # references without semicolon as well
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&(lt|LT);?', '<', 'g'), '&(gt|GT);?', '>', 'g'), '&(quot|QUOT);?', '\"', 'g'), '&#39;?', chr(39), 'g'), '&(amp|AMP);?', '&', 'g')"
)
_CANON = f"""m as (select distinct {_ID_SQL.format('tweet_id')} id, {_OPEN.format('text')} x from twcs where text is not null),
l as (select *, regexp_extract(x, '{_LEADING}', 1) lead, substr(x, length(regexp_extract(x, '{_LEADING}')) + 1) body from m where id is not null),
f as (select *, list_filter(string_split_regex(regexp_replace(regexp_replace(body, '^{_SP}+', ''), '{_SP}+$', ''), '{_SP}*(?:[,;|\\n]|{_SP}/{_SP}){_SP}*'), lambda p: p <> '') parts from l),
c as (select id, case when (contains(x, ':') or contains(x, '=')) and len(parts) > 1 and len(list_filter(parts, lambda p: not regexp_matches(p, '^{_SP}*\\p{{L}}[\\p{{L}}\\p{{N}}_ \\t\\-]*[:=]{_SP}*[^\\s\\p{{Z}}]'))) = 0
 then {_DROPPED('lead')} || chr(31) || array_to_string(list_sort(list_transform(parts, lambda p: {_DROPPED('p')})), chr(31)) else {_DROPPED('x')} end k from f),
g as (select k, min(id) first, count(distinct id) copies from c where regexp_matches(k, '[\\p{{L}}\\p{{N}}]') group by 1)"""
P5_SQL = f"""with {_CANON} select distinct lpad(cast(first as varchar), 10, '0') tweet_id_first, lpad(cast(c.id as varchar), 10, '0') tweet_id_copy from c join g on c.k = g.k where copies > 1 and c.id <> first"""
P5_COPIES_SQL = f"with {_CANON} select copies, count(*) n_texts from g group by 1"

#: The same where no clock is doubted; where one is, this has no rows.
P3_CORRECTED_SQL = f"""with recursive {P3_SQL.split('with recursive ', 1)[1].split('firsts as', 1)[0]}
late as (select distinct m.root from m join facts p on m.parent = p.id where m.t < 1e18 and p.t < 1e18 and p.t - m.t > 60),
firsts as (select root, min(row(t, id)) filter (where role = 'customer' and content) a, max(row(t, id)) filter (where role = 'brand' and content) b, count(*) n
  from m where not broken and root not in (select root from late) group by 1),
clocks as ({P3_CLOCKS_SQL})
select n n_turns, count(*) n_conversations, cast(0 as bigint) n_moved from firsts where b > a
 and not exists (select 1 from clocks where (n_replies_broken >= 8 and 2 * n_replies_broken > n_replies) or (n_answered_broken >= 8 and 2 * n_answered_broken > n_answered)) group by 1"""


def p8_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed into the containers of every budget."""
    sizes = written(token_sizes(table(spark, folder, "documents")), "token-sizes")
    return pack(sizes, table(spark, folder, "context_budgets"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of every budget are."""
    return fill_report(p8_bins(spark, folder), table(spark, folder, "context_budgets"))


QUERIES = {
    "p2_found": (p2_found, None),
    "p2_passages": (p2_passages, None),
    "p5_found": (p5_found, P5_SQL),
    "p5_copies": (p5_copies, P5_COPIES_SQL),
    "p4_found": (p4_found, P4_SQL),
    "p4_report": (p4_report, P4_REPORT_SQL),
    "p4_weighted": (p4_weighted, P4_WEIGHTED_SQL),
    "p9_found": (p9_found, P9_SQL),
    "p9_proximity": (p9_proximity, P9_NEAR_SQL),
    "p10_found": (p10_found, None),
    "p10_by_source": (p10_by_source, None),
    "p6_found": (p6_found, None),
    "p6_redacted": (p6_redacted, None),
    "p6_names": (p6_names, None),
    "p3_found": (p3_found, P3_SQL),
    "p3_corrected": (p3_corrected, P3_CORRECTED_SQL),
    "p3_clocks": (p3_clocks, P3_CLOCKS_SQL),
    "p8_bins": (p8_bins, None),
    "p8_fill": (p8_fill, None),
}
