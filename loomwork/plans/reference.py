"""Queries of the conversation-analytics pipeline, each with an SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import messages as M
from loomwork.functions.text import ENTITIES, decode_entities, match_form
from loomwork.operators import extract as X
from loomwork.operators import isolation as I
from loomwork.operators import metrics as E
from loomwork.operators import profile as P
from loomwork.operators import retrieval as R
from loomwork.operators import review as V
from loomwork.operators import rules as K
from loomwork.operators import threads as H
from loomwork.sources.tables import id_number, id_text, table

BRAND = "AppleSupport"
BRANDS = ["AppleSupport", "NordalHelps", "VexaCare", "TrainlyHelp", "OrbitMobile"]
QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name)


_ID = "try_cast(regexp_extract(coalesce({0},''), '^\\s*(\\d{{1,19}})(\\.0+)?\\s*$', 1) as bigint)".format
_DIR = "case lower(trim(coalesce(inbound,''))) when 'true' then 'inbound' when 'false' then 'outbound' else 'unknown' end"
_PRESENT = "(trim(coalesce({0},'')) <> '' and trim(coalesce({0},'')) <> 'nan')".format

# ------------------------------------------------------------------ profile


@query(f"""select count(*) n_rows, count(*) filter (where trim(coalesce(inbound,'')) = 'True') n_inbound,
 count(*) filter (where trim(coalesce(inbound,'')) <> 'True') n_outbound, count(tweet_id) - count(distinct tweet_id) n_repeated_ids,
 count(distinct case when trim(coalesce(inbound,'')) = 'True' then author_id end) n_customers,
 count(*) filter (where {_PRESENT('response_tweet_id')}) n_with_response, count(*) filter (where {_PRESENT('in_response_to_tweet_id')}) n_with_parent,
 count(*) filter (where not {_PRESENT('in_response_to_tweet_id')}) n_roots from twcs""")
def profile_counts(spark, d):
    """Rows, directions, repeated ids, customers, links and roots."""
    return P.counts(_t(spark, d, "twcs"))


_COLS = ["tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id"]


@query(" union all ".join(f"select '{c}' \"column\", count(*) filter (where {c} is null) n_null, count(*) filter (where trim({c}, ' ') = '') n_blank from twcs" for c in _COLS))
def profile_nulls(spark, d):
    """Null and blank values of every column."""
    return P.nulls(_t(spark, d, "twcs"), _COLS)


@query("""select author_id, count(*) n from twcs where lower(trim(inbound)) = 'false' and author_id is not null group by 1 order by n desc, author_id limit 30""")
def profile_top_brands(spark, d):
    """Outbound messages by author, the first thirty."""
    return P.group_counts(_t(spark, d, "twcs").filter(F.lower(F.trim("inbound")) == "false"), "author_id", 30)


@query("select user_id, count(*) n from events where user_id is not null group by 1 order by n desc, user_id limit 30")
def top_groups(spark, d):
    """Events by user, the first thirty (a report of the first groups)."""
    return P.group_counts(_t(spark, d, "events"), "user_id", 30)


@query(f"select {_DIR} direction, count(*) n from twcs group by 1")
def direction_counts(spark, d):
    return P.direction_counts(_t(spark, d, "twcs"))


_MENTION = """regexp_replace(substr(list_filter(string_split_regex(trim(coalesce(text,''), ' '), '\\s+'), lambda w: starts_with(w, '@'))[1], 2), '[.,!?;:]+$', '')"""


@query(f"""with m as (select distinct tweet_id, {_MENTION} mention from twcs),
g as (select * from m where mention is not null and mention <> '' and not regexp_matches(mention, '^[0-9]+$')),
r as (select *, row_number() over (partition by mention order by tweet_id) rn, count(*) over (partition by mention) n from g)
select mention, n, string_agg(tweet_id, ',' order by tweet_id) filter (where rn <= 20) examples from r group by 1, 2""")
def mention_examples(spark, d):
    """First mention of each message: how often, and up to twenty example ids (a bounded report)."""
    return P.mention_examples(_t(spark, d, "twcs"))


@query("""select tweet_id, count(*) n_rows, count(distinct coalesce(text, chr(0))) > 1 or count(distinct coalesce(author_id, chr(0))) > 1 conflicting
from twcs where true group by 1 having count(*) > 1""")
def conflicting_duplicates(spark, d):
    """Ids with several rows, and whether text or author differ."""
    return P.repeated_ids(_t(spark, d, "twcs"))


_QUALITY = f"""select count(*) n_rows, count(*) filter (where trim(coalesce(text,''), ' ') = '') empty_text,
 count(*) filter (where trim(coalesce(created_at,'')) in ('', 'nan')) missing_timestamp, count(*) filter (where {_DIR} = 'unknown') bad_inbound,
 count(*) filter (where trim(coalesce(in_response_to_tweet_id,'')) <> '' and trim(in_response_to_tweet_id) = trim(tweet_id)) self_parent,
 count(*) filter (where list_contains(string_split(regexp_replace(coalesce(response_tweet_id,''), '\\s', '', 'g'), ','), trim(tweet_id))) self_response from twcs"""


@query(_QUALITY)
def row_quality(spark, d):
    return P.row_quality(_t(spark, d, "twcs"))


_VALID = f"""q as (select count(*) filter (where not {_PRESENT('tweet_id')}) n_no_id, case when count(*) filter (where trim(author_id) = '{BRAND}' and {_DIR} = 'outbound') = 0 then 1 else 0 end n_no_brand_rows,
 case when count(*) filter (where {_DIR} = 'inbound') = 0 then 1 else 0 end n_no_inbound, count(*) filter (where trim(coalesce(text,''), ' ') = '') n_empty_text, count(*) filter (where trim(coalesce(created_at,'')) in ('', 'nan')) n_no_time,
 count(*) filter (where {_DIR} = 'unknown') n_bad_inbound, count(*) filter (where trim(coalesce(in_response_to_tweet_id,'')) <> '' and trim(in_response_to_tweet_id) = trim(tweet_id)) n_self_parent,
 count(*) filter (where list_contains(string_split(regexp_replace(coalesce(response_tweet_id,''), '\\s', '', 'g'), ','), trim(tweet_id))) n_self_response, count(distinct case when {_PRESENT('tweet_id')} then trim(tweet_id) end) n_ids,
 count(*) filter (where {_PRESENT('tweet_id')}) n_with, count(*) filter (where {_PRESENT('in_response_to_tweet_id')}) n_parent, count(*) filter (where {_PRESENT('response_tweet_id')}) n_response from twcs),
w as (select *, n_with - n_ids n_duplicate_ids, case when n_ids < 100 then 1 else 0 end n_too_few, (select count(*) from (select trim(tweet_id) from twcs where {_PRESENT('tweet_id')} group by 1
 having count(distinct coalesce(text, chr(0))) > 1 or count(distinct coalesce(author_id, chr(0))) > 1)) n_conflicts from q)"""


@query(f"with {_VALID} select * from (" + " union all ".join(f"select '{s}' severity, '{r}' \"rule\", cast({c} as bigint) n from w" for c, s, r in P.VALIDATION_RULES) + ") where n > 0")
def severity_report(spark, d):
    """Errors, warnings and figures of a message table read back."""
    return P.validation_report(_t(spark, d, "twcs"), BRAND)


@query("""select count(*) n_rows, count(distinct doc_id) distinct_doc_id, count(distinct text) distinct_text, count(distinct author_id) distinct_author_id,
 count(distinct coalesce(source, chr(0)) || chr(31) || coalesce(text, chr(0))) distinct_source_text from documents""")
def duplicate_audit(spark, d):
    return P.duplicate_audit(_t(spark, d, "documents"), ["doc_id", "text", "author_id"], [("source", "text")])


@query("select text, count(*) n from twcs where text is not null group by 1 having count(*) > 1 order by n desc, text limit 5")
def most_repeated_texts(spark, d):
    """The five texts repeated most."""
    return P.most_repeated(_t(spark, d, "twcs"), "text")


# ------------------------------------------------------------------ extraction

_OWN = f"own as (select {_ID('tweet_id')} id, {_ID('in_response_to_tweet_id')} parent from twcs where lower(trim(inbound)) = 'false' and trim(author_id) = '{BRAND}')"


@query(f"""with {_OWN}, keys as (select id, max(o) own from (select id, 1 o from own union all select parent, 0 from own) where id is not null group by 1)
select case when own = 1 then 'brand_reply' else 'customer_inbound' end row_type,
 case lower(trim(coalesce(inbound,''))) when 'true' then 'True' when 'false' then 'False' else 'Unknown' end inbound, count(*) n, count(distinct id) n_ids
from (select {_ID('tweet_id')} id, inbound from twcs) join keys using (id) group by 1, 2""")
def extract_brand(spark, d):
    """Messages of the brand and those it answers, by kind and direction."""
    return X.extract_brand(_t(spark, d, "twcs"), BRAND).groupBy("row_type", "inbound").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


@query(f"""with {_OWN}, keys as (select id from own where id is not null union select parent from own where parent is not null)
select distinct {_ID('tweet_id')} id, trim(author_id) author_id from twcs where {_ID('tweet_id')} in (select id from keys)""")
def extract_semi_join(spark, d):
    """Ids and authors of the brand's conversations."""
    return X.extract_brand(_t(spark, d, "twcs"), BRAND).select("id", "author_id").distinct()


_BRAND_LIST = ", ".join(f"'{b}'" for b in BRANDS)


@query(f"""with own as (select {_ID('tweet_id')} id, {_ID('in_response_to_tweet_id')} parent, trim(author_id) brand from twcs
 where lower(trim(inbound)) = 'false' and trim(author_id) in ({_BRAND_LIST})),
p as (select id, brand from own union all select parent, brand from own)
select brand, count(*) n from (select id, arg_min(brand, list_position([{_BRAND_LIST}], brand)) brand from p where id in (select {_ID('tweet_id')} from twcs) group by 1) group by 1""")
def first_match_assignment(spark, d):
    """Messages of several brands, each given to the first brand it matches."""
    return X.first_match(_t(spark, d, "twcs"), BRANDS).groupBy("brand").agg(F.count("*").alias("n"))


@query("select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def star_semi_join(spark, d):
    """Orders of customers of one region: a semi-join against a small dimension."""
    nations = _t(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    customers = _t(spark, d, "customer").join(nations, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return _t(spark, d, "orders").join(customers, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("""select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(*) n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def star_pricing_summary(spark, d):
    return _t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.to_timestamp(F.lit("1998-09-02"))).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


# ------------------------------------------------------------------ text functions

#: Fixed values of functions.text, as the other engine writes them: one replacement after the other, the ampersand last.
def _decoded(x: str) -> str:
    for pattern, to in ENTITIES:
        # the other engine has no look-ahead: a reference without semicolon is followed by a captured sign or the end
        bare = pattern.replace("(?i)", "")
        q = to.replace("'", "''")
        parts = [p.replace("(?![a-z;])", "") for p in bare.split("|") if "(?!" in p]
        plain = "|".join(p for p in bare.split("|") if "(?!" not in p)
        x = f"regexp_replace({x}, '(?i){plain}', '{q}', 'g')"
        for p in parts:
            for _ in range(2):  # a captured sign cannot begin the next match
                x = f"regexp_replace({x}, '(?i){p}([^a-zA-Z;]|$)', '{q}\\1', 'g')"
    return x


_DEC = _decoded("coalesce({0},'')").format
#: Letters, marks, digits and connectors as both engines' patterns see them, and white space.
_WORD = r"\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200c}}\x{{200d}}".replace("{{", "{").replace("}}", "}")
_SPACE = r"\s\x{0b}\x{85}\p{Z}"
_ASCII = "case when length(coalesce(text,'')) = 0 then 1.0 else length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) end"
_USEFUL = "len(list_filter(string_split_regex(regexp_replace(regexp_replace(coalesce(text,''), 'https?://\\S+', ' ', 'g'), '@\\S+', ' ', 'g'), '\\s+'), lambda w: regexp_matches(w, '^\\p{L}+$')))"


@query(f"select tweet_id, {_ASCII} >= 0.85 english from twcs")
def ascii_ratio_flag(spark, d):
    return _t(spark, d, "twcs").select("tweet_id", M.likely_english("text").alias("english"))


@query(f"select tweet_id, {_USEFUL} useful, {_USEFUL} < 3 noise from twcs")
def useful_words_noise(spark, d):
    u = M.useful_words("text")
    return _t(spark, d, "twcs").select("tweet_id", u.alias("useful"), (u < 3).alias("noise"))


@query("select doc_id, len(regexp_extract_all(coalesce(text,''), '__[a-zA-Z]+__')) n_masked from documents")
def masked_fields(spark, d):
    return _t(spark, d, "documents").select("doc_id", M.masked_fields("text").alias("n_masked"))


_LONG = f"(^|[^{_WORD}])\\p{{Nd}}{{8,}}($|[^{_WORD}])"


@query(f"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{_LONG}', '\\1[ID]\\2', 'g'), '{_LONG}', '\\1[ID]\\2', 'g'), '[^{_SPACE}]+@[^{_SPACE}]+', '[email]', 'g') masked from documents where text is not null")
def redact_plain(spark, d):
    """Long numbers and addresses masked in every text that is not null."""
    return _t(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", M.redact_plain("text").alias("masked"))


@query(f"select tweet_id, {_DEC('text')} decoded from twcs where text is not null")
def html_decode(spark, d):
    """Character references decoded in every text that is not null."""
    return _t(spark, d, "twcs").filter(F.col("text").isNotNull()).select("tweet_id", decode_entities("text").alias("decoded"))


@query("select tweet_id, array_to_string(list_filter(string_split_regex(trim(coalesce(text,''), ' '), '\\s+'), lambda w: not starts_with(w, '@')), ' ') body from twcs")
def without_handles(spark, d):
    return _t(spark, d, "twcs").select("tweet_id", M.without_handles("text").alias("body"))


@query("select tweet_id, substr(text, 1, 120) short from twcs")
def truncate_text(spark, d):
    return _t(spark, d, "twcs").select("tweet_id", F.substring("text", 1, 120).alias("short"))


@query(f"select count(*) filter (where contains(text, '@{BRAND}')) n_mentions, count(*) filter (where contains(text, '@{BRAND}') and {_DIR} = 'inbound') n_inbound from twcs")
def mention_predicate(spark, d):
    hit = F.contains(F.coalesce("text", F.lit("")), F.lit("@" + BRAND))
    return _t(spark, d, "twcs").agg(F.count_if(hit).alias("n_mentions"), F.count_if(hit & (M.direction("inbound") == "inbound")).alias("n_inbound"))


@query("select event_type, count(*) n, count(props) n_props from events group by 1")
def event_types(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("n_props"))


# ------------------------------------------------------------------ threads

_TIME = (
    "case when regexp_matches(trim(coalesce(created_at,'')), '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \\d{2} \\d{2}:\\d{2}:\\d{2} [+-]\\d{4} \\d{4}$') "
    "then cast(epoch(try_strptime(substr(trim(created_at), 5), '%b %d %H:%M:%S %z %Y')) as bigint) end"
)
_REFS = "regexp_extract_all(regexp_replace(coalesce(response_tweet_id,''), '\"(\\d{1,3}),(\\d{3}),(\\d{3}),(\\d{3})\"', '\\1\\2\\3\\4', 'g'), '\\d{10}')"
_TREE = f"""m as (select {_ID('tweet_id')} id, max({_ID('in_response_to_tweet_id')}) parent, bool_or({_DIR} = 'inbound') cust, min({_TIME}) t, max(created_at) created_at,
  arg_min(coalesce(text,''), (loaded_at, coalesce(text,''))) text, count(*) n_rows, count(distinct coalesce(text, chr(0))) > 1 conflict from twcs group by 1 having id is not null),
lk as (select m.id, m.parent, p.id is not null ok from m left join m p on m.parent = p.id),
down(id, root, depth) as (select id, id, 0 from lk where not ok union all select l.id, d.root, d.depth + 1 from lk l join down d on l.parent = d.id where l.ok),
lost as (select id, parent from lk where ok and id not in (select id from down)),
up(id, seen) as (select id, parent from lost union select u.id, l.parent from up u join lost l on u.seen = l.id),
ring as (select distinct id from up where id = seen),
tree as (select id, root, depth, false cyc from down union all
  select u.id, min(u.seen) filter (where u.seen in (select id from ring)), case when u.id in (select id from ring) then 0 else 1 + count(*) filter (where u.seen not in (select id from ring)) end,
  u.id in (select id from ring) from up u group by u.id),
refs as (select distinct {_ID('tweet_id')} id, unnest({_REFS}) ref from twcs),
rl as (select r.id, 1 rp, count(m.id) rv, count(*) - count(m.id) rm from refs r left join m on cast(r.ref as bigint) = m.id where r.id is not null group by 1),
th as (select tree.root, count(*) message_count, count(*) filter (where cust) customer_message_count, count(*) filter (where not cust) brand_message_count,
  arg_max(not cust, (coalesce(t, 1152921504606846976), cast(m.id as varchar))) ends_with_brand_reply,
  bool_or((m.parent is not null and not ok) or cyc) has_broken_links, bool_or(cyc) cycle_detected, bool_or(n_rows > 1) has_duplicate_ids, bool_or(conflict) has_conflicting_duplicates,
  bool_or(trim(text, ' ') = '') has_empty_text, count(*) filter (where t is null) malformed_timestamps, max(depth) max_depth,
  count(m.parent) parent_links_present, count(*) filter (where ok) parent_links_valid, count(*) filter (where m.parent is not null and not ok) parent_links_missing,
  coalesce(sum(rp), 0) response_links_present, coalesce(sum(rv), 0) response_links_valid, coalesce(sum(rm), 0) response_links_missing
  from tree join m using (id) join lk using (id) left join rl using (id) group by 1)"""
_TH = "message_count, customer_message_count, brand_message_count, ends_with_brand_reply, has_broken_links, cycle_detected, has_duplicate_ids, has_conflicting_duplicates, has_empty_text, malformed_timestamps, cast(max_depth as int) max_depth"


@query(f"with recursive {_TREE} select lpad(cast(root as varchar), 10, '0') root_tweet_id, {_TH} from th")
def thread_records(spark, d):
    """One row a thread with counts and flags."""
    return H.thread_records(_t(spark, d, "twcs")).select(
        id_text("root").alias("root_tweet_id"), "message_count", "customer_message_count", "brand_message_count", "ends_with_brand_reply", "has_broken_links",
        "cycle_detected", "has_duplicate_ids", "has_conflicting_duplicates", "has_empty_text", "malformed_timestamps", "max_depth",
    )


_LINKCOLS = "parent_links_present, parent_links_valid, parent_links_missing, response_links_present, response_links_valid, response_links_missing"


@query(f"with recursive {_TREE} select lpad(cast(root as varchar), 10, '0') root_tweet_id, " + ", ".join(f"cast({c.strip()} as bigint) {c.strip()}" for c in _LINKCOLS.split(",")) + " from th")
def thread_links(spark, d):
    """Link metrics of each thread."""
    return H.thread_records(_t(spark, d, "twcs")).select(id_text("root").alias("root_tweet_id"), *[c.strip() for c in _LINKCOLS.split(",")])


@query(f"""with recursive {_TREE} select count(*) n_threads, cast(sum(message_count) as bigint) n_messages, round(avg(message_count), 2) avg_messages, min(message_count) min_messages,
 max(message_count) max_messages, quantile_cont(message_count, 0.5) median_messages, count(*) filter (where customer_message_count > 0 and brand_message_count > 0) both_directions,
 count(*) filter (where message_count >= 3) three_plus, count(*) filter (where customer_message_count >= 2 and brand_message_count >= 2) multiple_exchanges,
 count(*) filter (where ends_with_brand_reply) ends_with_brand, count(*) filter (where has_broken_links) broken, count(*) filter (where cycle_detected) circles from th""")
def thread_corpus_stats(spark, d):
    return H.thread_summary(H.thread_records(_t(spark, d, "twcs")))


@query(f"""with recursive {_TREE}, s as (select {', '.join(f'cast(sum({c.strip()}) as bigint) {c.strip()}' for c in _LINKCOLS.split(','))} from th)
select *, parent_links_valid / parent_links_present parent_coverage, response_links_valid / (response_links_valid + response_links_missing) response_coverage from s""")
def thread_link_totals(spark, d):
    return H.link_totals(H.thread_records(_t(spark, d, "twcs")))


@query(f"""with recursive {_TREE}, fl as (select root, list_filter([
 case when has_broken_links then 'missing_parent_link' end, case when response_links_missing > 0 then 'missing_response_target' end, case when cycle_detected then 'cycle_detected' end,
 case when malformed_timestamps > 0 then 'malformed_or_missing_timestamp (' || malformed_timestamps || ')' end, case when has_empty_text then 'empty_text' end,
 case when message_count = 1 then 'single_message' end, case when customer_message_count = 0 then 'no_customer_message' end, case when brand_message_count = 0 then 'no_brand_message' end,
 case when has_duplicate_ids then 'duplicate_tweet_ids_in_input' end, case when has_conflicting_duplicates then 'conflicting_duplicate_records_in_input' end], lambda x: x is not null) f from th)
select array_to_string(f, ';') flags, count(*) n from fl group by 1""")
def thread_flags(spark, d):
    """Threads by their ordered list of quality flags."""
    rows = H.thread_records(_t(spark, d, "twcs"))
    return rows.groupBy(F.array_join("quality_flags", ";").alias("flags")).agg(F.count("*").alias("n"))


def _turns(spark, d):
    return H.placed(_t(spark, d, "twcs")).select("root", "id", "t", "is_customer", "empty")


@query(f"""with recursive {_TREE}, r as (select root, (coalesce(t, 1152921504606846976), id) k, cust, id from tree join m using (id) where trim(text, ' ') <> ''),
q as (select root, min(k) k, arg_min(id, k) qid from r where cust group by 1)
select lpad(cast(q.root as varchar), 10, '0') root_tweet_id, q.qid customer_id, arg_min(r.id, r.k) brand_id from q join r on q.root = r.root and not r.cust and r.k > q.k group by 1, 2""")
def customer_brand_pairs(spark, d):
    """First customer message of each thread with the first brand message after it."""
    return H.first_exchange(_turns(spark, d)).select(id_text("root").alias("root_tweet_id"), "customer_id", "brand_id")


# ------------------------------------------------------------------ brands

_BRANDS = f"""b as (select author_id brand, count(*) n_out, avg(case when {_USEFUL} < 3 then 1.0 else 0.0 end) noise, avg(case when {_ASCII} >= 0.85 then 1.0 else 0.0 end) english,
 avg(case when {_PRESENT('in_response_to_tweet_id')} then 1.0 else 0.0 end) parent_share, count(distinct {_ID('in_response_to_tweet_id')}) n_answered
 from twcs where lower(trim(inbound)) = 'false' and author_id is not null group by 1)"""


@query(f"with {_BRANDS} select brand, n_out, round(noise, 6) noise, round(english, 6) english, round(parent_share, 6) parent_share, n_answered from b")
def brand_scorecard(spark, d):
    """Counts and text quality of each brand in one aggregate."""
    return _brands(spark, d).select("brand", "n_out", *[F.round(c, 6).alias(c) for c in ("noise", "english", "parent_share")], "n_answered")


def _brands(spark, d):
    own = _t(spark, d, "twcs").filter((F.lower(F.trim("inbound")) == "false") & F.col("author_id").isNotNull())
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return own.groupBy(F.col("author_id").alias("brand")).agg(
        F.count("*").alias("n_out"), share(M.useful_words("text") < 3).alias("noise"), share(M.likely_english("text")).alias("english"),
        share(M.present("in_response_to_tweet_id")).alias("parent_share"), F.countDistinct(id_number("in_response_to_tweet_id")).alias("n_answered"),
    )


# ------------------------------------------------------------------ rule labels

_NORM = f"trim(regexp_replace(lower(regexp_replace(regexp_replace({_DEC('text')}, '(?i)https?://\\S+', ' ', 'g'), '@[{_WORD}]+', ' ', 'g')), '[{_SPACE}]+', ' ', 'g'), ' ')"


def _bounded(pattern: str) -> str:
    """A rule's pattern for an engine whose word border knows ASCII only: the border becomes a sign or an end."""
    head, *rest = pattern.split("\\b")
    return f"(?:^|[^{_WORD}])" + f"(?:$|[^{_WORD}])".join(rest) if not head else f"(?:$|[^{_WORD}])".join([head, *rest])


def _score_sql(label: str) -> str:
    q = chr(39)
    return " + ".join(f"case when regexp_matches(x, '{_bounded(r.pattern).replace(q, q + q)}') then {r.weight} else 0 end" for r in K.SUPPORT_LEXICON if r.label == label)


def _why_sql(label: str) -> str:
    q = chr(39)
    return "[" + ", ".join(f"case when regexp_matches(x, '{_bounded(r.pattern).replace(q, q + q)}') then '{r.reason}' end" for r in K.SUPPORT_LEXICON if r.label == label) + "]"


_LABELS = K.label_order(K.SUPPORT_LEXICON)
_SCORED = f"""n as (select tweet_id, thread_id, {_NORM} x from apple_support_intent_training_candidates where text is not null),
s as (select tweet_id, thread_id, x, list_sort(list_filter([{', '.join(f"{{'neg': -({_score_sql(v)}), 'ord': {i}, 'label': '{v}'}}" for i, v in enumerate(_LABELS))}], lambda z: z.neg < 0)) s from n),
l as (select *, case when length(x) < 8 or len(string_split(x, ' ')) <= 1 then 'unknown_other' when len(s) = 0 then 'unknown_other'
 when len(s) > 1 and (s[1].neg = s[2].neg or (s[1].neg <= -2 and s[2].neg <= -2)) then 'needs_review' else s[1].label end label,
 case when length(x) < 8 or len(string_split(x, ' ')) <= 1 or len(s) = 0 then 'low' when len(s) > 1 and (s[1].neg = s[2].neg or (s[1].neg <= -2 and s[2].neg <= -2)) then 'low'
 when s[1].neg <= -2 then 'high' else 'medium' end conf, array_to_string(list_sort(list_transform(s, lambda z: z.label)), '|') matched, len(s) k from s)"""


def _labelled(spark, d):
    rows = _t(spark, d, "apple_support_intent_training_candidates").filter(F.col("text").isNotNull())
    return K.weak_labels(rows.select("tweet_id", "thread_id", "text"))


@query(f"with {_SCORED} select tweet_id, thread_id, label, conf, matched from l")
def rule_labels(spark, d):
    """Weak labels of all candidates with a text, in any script, by the support lexicon."""
    return _labelled(spark, d).select("tweet_id", "thread_id", F.col("rule_label").alias("label"), F.col("rule_confidence").alias("conf"), F.col("rule_matched").alias("matched"))


@query(f"""with {_SCORED} select case when length(x) < 8 or len(string_split(x, ' ')) <= 1 then 'too_short_or_conversational' when k = 0 then 'no_matching_rules_found'
 when label = 'needs_review' then 'conflicting_rules_matched: [' || array_to_string(list_transform(list_filter(s, lambda z: z.neg <= s[2].neg), lambda z: chr(39) || z.label || chr(39)), ', ') || ']'
 else 'matched: ' || array_to_string(list_filter(case label {' '.join(f"when '{v}' then {_why_sql(v)}" for v in _LABELS)} end, lambda z: z is not null), ', ') end reason,
 case when length(x) < 8 or len(string_split(x, ' ')) <= 1 or k = 0 then 'fallback' when label = 'needs_review' then 'needs_review' else 'rule' end source, count(*) n from l group by 1, 2""")
def rule_reasons(spark, d):
    """Sources and reasons of the weak labels."""
    return _labelled(spark, d).groupBy(F.col("rule_reason").alias("reason"), F.col("rule_source").alias("source")).agg(F.count("*").alias("n"))


@query(f"""with {_SCORED} select case when k > 1 then 'critical' when label in ('software_update', 'unknown_other', 'needs_review') then 'high' when conf in ('low', 'medium') then 'medium' else 'normal' end priority,
 count(*) n, count(*) filter (where k > 1) n_overlap from l group by 1""")
def rule_overlap_priority(spark, d):
    """Review priorities of the weak labels and how many rules overlap."""
    return K.review_priority(_labelled(spark, d)).groupBy("priority").agg(F.count("*").alias("n"), F.count_if(F.col("rule_match_count") > 1).alias("n_overlap"))


_HIST = ["candidate_intent", "label_source", "label_confidence", "selection_reason"]


@query(" union all ".join(f"select '{c}' \"column\", coalesce({c}, '(null)') \"value\", count(*) n from apple_support_intent_training_candidates group by 2" for c in _HIST))
def label_histograms(spark, d):
    return E.histogram(_t(spark, d, "apple_support_intent_training_candidates"), _HIST)


@query("""select case when text is null or trim(text, ' ') = '' then 'no text' when candidate_intent is null then 'no label' when candidate_intent = 'needs_review' then 'needs review' else 'kept' end reason, count(*) n
from apple_support_intent_training_candidates group by 1""")
def exclusion_reasons(spark, d):
    why = F.when(F.col("text").isNull() | (F.trim("text") == ""), "no text").when(F.col("candidate_intent").isNull(), "no label").when(F.col("candidate_intent") == "needs_review", "needs review").otherwise("kept")
    return _t(spark, d, "apple_support_intent_training_candidates").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ isolation and samples

_GOLD, _CAND = "apple_support_intent_golden_set", "apple_support_intent_training_candidates"


@query(f"select tweet_id, thread_id, candidate_intent from {_CAND} where {_ID('tweet_id')} is null or {_ID('tweet_id')} not in (select {_ID('tweet_id')} from {_GOLD} where {_ID('tweet_id')} is not null)")
def isolation_anti_join(spark, d):
    """Training candidates without the held-out messages."""
    return I.isolated(_t(spark, d, _CAND), _t(spark, d, _GOLD)).select("tweet_id", "thread_id", "candidate_intent")


@query(f"select distinct {_ID('tweet_id')} id from {_CAND} where {_ID('tweet_id')} in (select {_ID('tweet_id')} from {_GOLD})")
def isolation_violations(spark, d):
    return I.violations(_t(spark, d, _CAND), _t(spark, d, _GOLD))


_CHECKS = {
    "id": ("tweet_id is not null", "tweet_id is not null"), "text": ("trim(text) <> ''", "trim(text, ' ') <> ''"), "golden intent": ("golden_intent is not null", "golden_intent is not null"),
    "status": ("verification_status in ('verified','corrected','flagged_ambiguous')",) * 2, "split": ("evaluation_split in ('golden_test','golden_dev')",) * 2,
    "difficulty": ("case_difficulty in ('representative','rule_conflict','attribution_vs_symptom','fallback_recovery','boundary_disambiguation','short_noisy','multilingual','ambiguous_multi_intent')",) * 2,
    "review is flagged": ("(golden_intent = 'needs_review') = (verification_status = 'flagged_ambiguous')",) * 2,
}


@query(" union all ".join(f"select '{k}' \"rule\", count(*) filter (where not coalesce({v[1]}, false)) n_bad from {_GOLD}" for k, v in _CHECKS.items())
       + f" union all select 'unique tweet_id', count(tweet_id) - count(distinct tweet_id) from {_GOLD}")
def golden_validation(spark, d):
    """Rules of the held-out set, each with the rows that break it."""
    return I.check_rules(_t(spark, d, _GOLD), {k: F.expr(v[0]) for k, v in _CHECKS.items()}, ["tweet_id"])


_SLICES = {"billing_payment": 30, "battery_power": 30, "software_update": 50, "needs_review": 20}


@query(f"""with h as (select distinct tweet_id id, candidate_intent slice, sha256('audit:' || tweet_id) o from {_CAND} where candidate_intent in ({', '.join(f"'{s}'" for s in _SLICES)})),
r as (select *, row_number() over (partition by slice order by o, id) rn from h)
select slice, id from r where rn <= case slice {' '.join(f"when '{s}' then {q}" for s, q in _SLICES.items())} end""")
def stratified_sample(spark, d):
    """A sampling operator: quotas by intent in a seeded order."""
    return I.stratified_sample(_t(spark, d, _CAND), "tweet_id", {s: (F.col("candidate_intent") == s, q) for s, q in _SLICES.items()}, "audit")


@query(f"""with h as (select distinct tweet_id id, sha256('cohort:' || tweet_id) o, coalesce(is_complete and customer_message_count >= 2, false) m, coalesce(label_confidence = 'low', false) u,
 coalesce(not is_complete, false) n from {_CAND} where tweet_id is not null),
a as (select distinct id, o from h where m order by o, id limit 55),
b as (select distinct id, o from h where u and id not in (select id from a) order by o, id limit 15),
c as (select distinct id, o from h where n and id not in (select id from a union select id from b) order by o, id limit 8)
select 'multi' cohort, id from a union all select 'unsure', id from b union all select 'open', id from c""")
def cohort_quotas(spark, d):
    """A sampling operator: ordered quotas, each drawn from the rows no earlier cohort took."""
    return I.cohorts(_t(spark, d, _CAND), "tweet_id", [
        ("multi", F.col("is_complete") & (F.col("customer_message_count") >= 2), 55), ("unsure", F.col("label_confidence") == "low", 15), ("open", ~F.col("is_complete"), 8)], "cohort")


@query(f"select tweet_id, thread_id, selection_reason, timestamp, case when cast(('0x' || substr(sha256('split:' || tweet_id), 1, 8)) as bigint) / 4294967296.0 < 0.9 then 'train' else 'valid' end split from {_CAND} where tweet_id is not null")
def hash_split(spark, d):
    return I.split_by_hash(_t(spark, d, _CAND).filter("tweet_id is not null"), "tweet_id", {"train": 0.9, "valid": 0.1}, "split").select("tweet_id", "thread_id", "selection_reason", "timestamp", "split")


# ------------------------------------------------------------------ metrics

_CONF = f"c as (select golden_intent truth, candidate_intent pred, count(*) n from {_GOLD} where golden_intent is not null and candidate_intent is not null group by 1, 2)"
_PRF = f"""{_CONF}, lab as (select truth label from c union select pred from c),
k as (select label, coalesce((select sum(n) from c where truth = label and pred = label), 0) tp, coalesce((select sum(n) from c where truth = label), 0) support, coalesce((select sum(n) from c where pred = label), 0) predicted from lab),
f as (select label, case when predicted > 0 then tp / predicted else 0 end p, case when support > 0 then tp / support else 0 end r, support, tp from k),
g as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end f1 from f)"""


@query(f"with {_CONF} select * from c")
def confusion_matrix(spark, d):
    return E.confusion(_t(spark, d, _GOLD), "golden_intent", "candidate_intent")


@query(f"with {_PRF} select label, round(p, 9) \"precision\", round(r, 9) recall, round(f1, 9) f1, cast(support as bigint) support from g")
def prf_per_class(spark, d):
    c = E.per_class(E.confusion(_t(spark, d, _GOLD), "golden_intent", "candidate_intent"))
    return c.select("label", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")], "support")


@query(f"""with {_PRF} select round(sum(tp) / sum(support), 9) accuracy, round(avg(p), 9) macro_precision, round(avg(r), 9) macro_recall, round(avg(f1), 9) macro_f1,
 round(sum(p * support) / sum(support), 9) weighted_precision, round(sum(r * support) / sum(support), 9) weighted_recall, round(sum(f1 * support) / sum(support), 9) weighted_f1, cast(sum(support) as bigint) n from g""")
def macro_weighted(spark, d):
    o = E.overall(E.per_class(E.confusion(_t(spark, d, _GOLD), "golden_intent", "candidate_intent")))
    return o.select(*[F.round(c, 9).alias(c) for c in o.columns if c != "n"], "n")


@query(f"""select case_difficulty, count(*) n, round(avg(case when golden_intent = candidate_intent then 1.0 else 0.0 end), 9) accuracy from {_GOLD} where case_difficulty is not null and case_difficulty <> 'ambiguous_multi_intent' group by 1""")
def slice_accuracy(spark, d):
    s = E.slice_accuracy(_t(spark, d, _GOLD), "case_difficulty", "golden_intent", "candidate_intent", ("ambiguous_multi_intent",))
    return s.select("case_difficulty", "n", F.round("accuracy", 9).alias("accuracy"))


@query(f"""with k as (select count(*) filter (where t and p) tp, count(*) filter (where not t and p) fp, count(*) filter (where t and not p) fn, count(*) filter (where not t and not p) tn
 from (select coalesce(expected_escalate, false) t, coalesce(cohort <> 'routine', false) p from benchmark_cases)),
r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 1 end a, case when tp + fn > 0 then tp / (tp + fn) else 1 end b from k)
select tp, fp, fn, tn, round(a, 9) "precision", round(b, 9) recall, round(case when a + b > 0 then 2 * a * b / (a + b) else 0 end, 9) f1,
 round(case when fp + tn > 0 then fp / (fp + tn) else 0 end, 9) fpr, round(case when fn + tp > 0 then fn / (fn + tp) else 0 end, 9) fnr from r""")
def binary_metrics(spark, d):
    """A two-way decision against its expected value."""
    b = E.binary(_t(spark, d, "benchmark_cases"), F.col("expected_escalate"), F.col("cohort") != "routine")
    return b.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "fpr", "fnr")])


@query(f"with c as (select candidate_intent, count(*) n from {_CAND} where candidate_intent is not null group by 1) select candidate_intent, n, round(sum(n) over () / (count(*) over () * n), 9) weight from c")
def class_weights(spark, d):
    return E.class_weights(_t(spark, d, _CAND), "candidate_intent").select("candidate_intent", "n", F.round("weight", 9).alias("weight"))


@query(f"select candidate_intent, count(*) n from {_CAND} where candidate_intent is not null group by 1 order by n desc, 1 limit 1")
def majority_class(spark, d):
    return E.majority(_t(spark, d, _CAND), "candidate_intent")


@query(f"select count(*) n, round(avg(case when golden_intent = preliminary_intent then 1.0 else 0.0 end), 9) agreement from {_GOLD}")
def agreement_rate(spark, d):
    same = F.when(F.col("golden_intent") == F.col("preliminary_intent"), 1.0).otherwise(0.0)
    return _t(spark, d, _GOLD).agg(F.count("*").alias("n"), F.round(F.avg(same), 9).alias("agreement"))


@query("""select cohort, count(*) n, count(*) filter (where expected_escalate) n_expected from benchmark_cases group by 1""")
def cohort_breakdown(spark, d):
    return _t(spark, d, "benchmark_cases").groupBy("cohort").agg(F.count("*").alias("n"), F.count_if("expected_escalate").alias("n_expected"))


@query(f"""with {_PRF}, m as (select golden_intent truth, preliminary_intent pred, count(*) n from {_GOLD} where golden_intent is not null and preliminary_intent is not null group by 1, 2),
lab2 as (select truth label from m union select pred from m),
f2 as (select label, coalesce((select sum(n) from m where truth = label and pred = label), 0) tp, coalesce((select sum(n) from m where truth = label), 0) s, coalesce((select sum(n) from m where pred = label), 0) q from lab2),
g2 as (select label, case when s + q > 0 then 2 * tp / (s + q) else 0 end f1 from f2)
select coalesce(g.label, g2.label) label, round(coalesce(g.f1, 0), 9) base_f1, round(coalesce(g2.f1, 0), 9) other_f1, round(coalesce(g2.f1, 0) - coalesce(g.f1, 0), 9) + 0.0 delta from g full join g2 on g.label = g2.label""")
def model_delta(spark, d):
    """F1 of two labellers by class and their difference."""
    g = _t(spark, d, _GOLD)
    out = E.compare_models(E.per_class(E.confusion(g, "golden_intent", "candidate_intent")), E.per_class(E.confusion(g, "golden_intent", "preliminary_intent")))
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("base_f1", "other_f1")], (F.round("delta", 9) + F.lit(0.0)).alias("delta"))


@query("select count(value) n, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, min(value) min, round(quantile_cont(value, 0.25), 6) p25, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.75), 6) p75, round(quantile_cont(value, 0.95), 6) p95, max(value) max from events")
def value_percentiles(spark, d):
    """Mean, deviation and exact percentiles, as for latencies and similarities."""
    x = E.distribution(_t(spark, d, "events"), F.col("value"))
    return x.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75", "p95")], "max")


# ------------------------------------------------------------------ retrieval


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _queries(spark, d):
    return _vectors(spark, d).filter(F.col("id") % 20 == 0)  # the stated query set: ids divisible by 20


_DOT = "list_dot_product(cast(q.embedding as double[]), cast(c.embedding as double[]))"


def _topk_sql(extra: str = "") -> str:
    return f"""with s as (select q.vec_id query_id, c.vec_id id, {_DOT} score from embeddings q, embeddings c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id {extra}),
r as (select *, row_number() over (partition by query_id order by score desc, id) rank from s) select query_id, cast(rank as int) rank, id, round(score, 5) score from r where rank <= 5"""


@query(_topk_sql())
def topk_cosine(spark, d):
    """Five nearest neighbours of every twentieth vector among all vectors, itself excluded."""
    return R.top_k(_queries(spark, d), _vectors(spark, d), 5).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


@query(_topk_sql("and q.label = c.label"))
def topk_cosine_label_filter(spark, d):
    return R.top_k(_queries(spark, d), _vectors(spark, d), 5, same_label=True).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


@query(f"""with s as (select q.vec_id query_id, c.vec_id id, c.label, {_DOT} score from embeddings q, embeddings c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
u as (select *, row_number() over (partition by query_id, label order by score desc, id) k from s),
r as (select *, row_number() over (partition by query_id order by score desc, id) rank from u where k = 1) select query_id, cast(rank as int) rank, id, round(score, 5) score from r where rank <= 5""")
def topk_dedup_exclude(spark, d):
    """As above with one result for each value of a key."""
    c = _vectors(spark, d).withColumn("dedup_key", F.col("label").cast("string"))
    return R.top_k(_queries(spark, d), c, 5, dedup=True).select("query_id", "rank", "id", F.round("score", 5).alias("score"))


@query(f"""with s as (select q.vec_id query_id, max({_DOT}) score from embeddings q, embeddings c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id group by 1)
select count(*) n, round(avg(score), 5) mean, round(stddev_pop(score), 5) std, round(quantile_cont(score, 0.5), 5) p50, count(*) filter (where score < 0.5) n_weak from s""")
def leave_one_out_top1_stats(spark, d):
    best = R.top_k(_queries(spark, d), _vectors(spark, d), 1)
    return best.agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean"), F.round(F.stddev_pop("score"), 5).alias("std"), F.round(F.percentile("score", F.lit(0.5)), 5).alias("p50"), F.count_if(F.col("score") < 0.5).alias("n_weak"))


@query(f"""with s as (select q.vec_id query_id, arg_max(c.label, {_DOT}) label, max({_DOT}) score from embeddings q, embeddings c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id group by 1)
select label "group", count(*) n, round(avg(score), 5) mean from s group by 1""")
def similarity_by_label(spark, d):
    """Mean best similarity by label of the best match."""
    best = R.top_k(_queries(spark, d), _vectors(spark, d), 1)
    rows = best.join(_vectors(spark, d).select("id", "label"), "id")
    return R.conditioned_mean(rows, F.col("label"), F.col("score")).select("group", "n", F.round("mean", 5).alias("mean"))


@query("select count(*) n, count(*) filter (where sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) not between 0.99 and 1.01) n_off, count(*) filter (where len(embedding) = 0) n_empty from embeddings")
def norm_check(spark, d):
    return R.norm_check(_t(spark, d, "embeddings"))


@query(f"""select coalesce(c.candidate_intent, 'unknown_other') intent, count(*) n from (select distinct {_ID('tweet_id')} id from twcs) m
left join (select {_ID('tweet_id')} id, min(candidate_intent) candidate_intent from {_CAND} group by 1) c on m.id = c.id group by 1""")
def lookup_default(spark, d):
    """Intent of every message, a default where none is known."""
    ids = _t(spark, d, "twcs").select(id_number("tweet_id").alias("id")).distinct()
    known = _t(spark, d, _CAND).select(id_number("tweet_id").alias("id"), "candidate_intent").groupBy("id").agg(F.min("candidate_intent").alias("i"))
    return ids.join(known, "id", "left").groupBy(F.coalesce("i", F.lit("unknown_other")).alias("intent")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ review of replies


@query(None)
def grounding_overlap(spark, d):
    """Replies of each first exchange against the customer's text: overlap, grounding, relevance, completeness, verdict."""
    pairs = H.exchange_texts(H.first_exchange(_turns(spark, d)), _t(spark, d, "twcs"))
    q, a = F.col("customer_text"), F.col("brand_text")
    scored = pairs.select(
        "root", V.overlap(a, q).alias("overlap"), V.grounding(a, q, F.lit(1.0)).alias("grounding"), V.relevance(q, a).alias("relevance"), V.completeness(a).alias("completeness"),
        F.size(V.new_links(a, q)).alias("n_new_links"),
    )
    judged = V.verdict(scored, {"grounding": 0.4, "relevance": 0.3, "completeness": 0.3})
    return judged.groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("overall"), 6).alias("mean_overall"), F.sum("n_new_links").alias("n_new_links"))


@query("""select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') window_start, event_type, count(*) n from events where ts is not null group by 1, 2""")
def hourly_event_counts(spark, d):
    """The streaming window count on the stored events."""
    from loomwork.streaming.incremental import windowed_counts

    return windowed_counts(_t(spark, d, "events"), "ts", ["event_type"]).select(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "event_type", "n")


def _classified(spark, d):
    """The held-out messages with the predictions of a classifier.  Vocabulary, document frequencies and class weights
    are those of all isolated candidates; only the fit of the classifier takes at most ``ml.TRAIN_ROWS`` of them."""
    from loomwork.operators import ml
    from loomwork.session import written

    train = I.isolated(_t(spark, d, _CAND), _t(spark, d, _GOLD)).filter("candidate_intent is not null and candidate_intent <> 'needs_review' and text is not null")
    train = written(train.select("tweet_id", "text", "candidate_intent"), "isolated")
    tfidf = ml.TfIdf().fit(train)
    weights = E.class_weights(train, "candidate_intent")
    model, index = ml.fit_classifier(tfidf.transform(ml.bounded(train, "tweet_id")), "candidate_intent", weights=weights)
    test = _t(spark, d, _GOLD).filter("golden_intent is not null").select("tweet_id", F.coalesce("text", F.lit("")).alias("text"), "golden_intent", "case_difficulty")
    return ml.predict(model, index, tfidf.transform(test), "text")


@query(None)
def ambiguous_diagnostics(spark, d):
    """What a classifier makes of the held-out messages that the reviewers left open."""
    from loomwork.operators import ml

    rows = ml.ambiguous_cases(_classified(spark, d), "golden_intent")
    return rows.select("tweet_id", "prediction_label", "confidence", "margin", F.to_json("top").alias("top"))


@query(None)
def intent_classifier(spark, d):
    """A balanced TF-IDF classifier fitted on isolated candidates, judged on the held-out messages."""
    scored = _classified(spark, d)
    out = E.per_class(E.confusion(scored, "golden_intent", "prediction_label"))
    return out.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"select tweet_id, length(x) n_match from (select tweet_id, {_NORM} x from twcs where text is not null) where length(x) < 8")
def short_messages(spark, d):
    """Messages too short to label, in any script."""
    m = match_form("text")
    return _t(spark, d, "twcs").filter(F.col("text").isNotNull()).select("tweet_id", F.length(m).alias("n_match")).filter("n_match < 8")
