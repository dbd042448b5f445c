"""Queries of the general data problems (hierarchies, packed fields)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.hierarchy import descendant_counts, descendant_pairs, resolve_hierarchy
from loomwork.operators.packed import split_packed
from loomwork.sources.tables import id_number, id_text, message_links, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root, depth and circle mark of every message whose parent is in the table."""
    links = message_links(table(spark, folder, "twcs"))
    return (
        resolve_hierarchy(links)
        .filter("parent_present")
        .select(id_text("id").alias("tweet_id"), id_text("root").alias("root_tweet_id"), "depth", "on_cycle")
    )


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with root, depth, path and the number of messages below it."""
    links = message_links(table(spark, folder, "twcs"))
    tree = resolve_hierarchy(links, with_path=True)
    counts = descendant_counts(tree).select("id", "n_descendants", "height")
    return tree.join(counts, "id").select(
        id_text("id").alias("tweet_id"),
        id_text("root").alias("root_tweet_id"),
        "depth",
        "on_cycle",
        F.array_join(F.transform("path", lambda x: id_text(x)), ">").alias("path"),
        "n_descendants",
        "height",
    )


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with each message below it and the number of links between them."""
    tree = resolve_hierarchy(message_links(table(spark, folder, "twcs")), with_path=True)
    return descendant_pairs(tree).select(id_text("ancestor").alias("tweet_id"), id_text("descendant").alias("descendant_id"), "distance")


def p1_threads_check(spark: SparkSession, folder: str) -> DataFrame:
    """The older thread records against the trees: how many roots still hold, by kind of difference."""
    tree = resolve_hierarchy(message_links(table(spark, folder, "twcs"))).select("id", "root", "depth", "on_cycle")
    old = (
        table(spark, folder, "threads")
        .select(id_number("root_tweet_id").alias("id"), "thread_id")
        .distinct()
    )
    state = (
        F.when(F.col("t.id").isNull(), "no such message")
        .when(F.col("on_cycle") == 1, "on a circle")
        .when(F.col("depth") == 0, "root")
        .otherwise("not a root")
    )
    return old.alias("o").join(tree.alias("t"), F.col("o.id") == F.col("t.id"), "left").groupBy(state.alias("state")).agg(
        F.count("*").alias("n_threads")
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reply ids of the fields with two or more of them."""
    twcs = table(spark, folder, "twcs").select(id_number("tweet_id").alias("id"), "response_tweet_id")
    return (
        split_packed(twcs, "response_tweet_id", ["id"], packed_ids=True)
        .filter((F.col("n_values") > 1) & F.col("id").isNotNull())
        .select(id_text("id").alias("tweet_id"), "position", id_number("value").alias("r"))
        .filter(F.col("r").isNotNull())
        .select("tweet_id", "position", id_text("r").alias("response_id"))
        .distinct()
    )


def p7_all_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every reply id of every field with position and error flag, counted by flag and field size."""
    twcs = table(spark, folder, "twcs").select("tweet_id", "response_tweet_id")
    return (
        split_packed(twcs, "response_tweet_id", ["tweet_id"], packed_ids=True)
        .groupBy("n_values", F.coalesce("error", F.lit("none")).alias("error"))
        .agg(F.count("*").alias("n"), F.count(id_number("value")).alias("n_ids"))
    )


_ID = "try_cast(regexp_extract(coalesce({0},''), '^\\s*(\\d{{1,19}})(\\.0+)?\\s*$', 1) as bigint)"
_LINKS = f"""nodes as (select {_ID.format('tweet_id')} id, max({_ID.format('in_response_to_tweet_id')}) parent
from twcs group by 1 having id is not null),
linked as (select n.id, n.parent, p.id is not null ok from nodes n left join nodes p on n.parent = p.id)"""

P1_SQL = f"""with recursive {_LINKS},
down(id, root, depth) as (
  select id, id, 0 from linked where not ok
  union all select l.id, d.root, d.depth + 1 from linked l join down d on l.parent = d.id where l.ok),
lost as (select id, parent from linked where ok and id not in (select id from down)),
up(id, seen) as (select id, parent from lost union select u.id, l.parent from up u join lost l on u.seen = l.id),
ring as (select distinct id from up where id = seen),
low as (select u.id, min(u.seen) root from up u where u.seen in (select id from ring) group by 1),
beyond as (select u.id, count(*) filter (where u.seen not in (select id from ring)) n from up u group by 1)
select lpad(cast(d.id as varchar), 10, '0') tweet_id, lpad(cast(d.root as varchar), 10, '0') root_tweet_id,
  cast(d.depth as int) depth, 0 on_cycle from down d join linked l on d.id = l.id where l.ok
union all
select lpad(cast(low.id as varchar), 10, '0'), lpad(cast(low.root as varchar), 10, '0'),
  cast(case when low.id in (select id from ring) then 0 else 1 + beyond.n end as int),
  case when low.id in (select id from ring) then 1 else 0 end
from low join beyond on low.id = beyond.id"""

P1_CHECK_SQL = f"""with recursive {_LINKS},
down(id) as (select id from linked where not ok union all select l.id from linked l join down d on l.parent = d.id where l.ok),
lost as (select id, parent from linked where ok and id not in (select id from down)),
up(id, seen) as (select id, parent from lost union select u.id, l.parent from up u join lost l on u.seen = l.id),
ring as (select distinct id from up where id = seen),
old as (select distinct {_ID.format('root_tweet_id')} id, thread_id from threads)
select case when l.id is null then 'no such message' when l.id in (select id from ring) then 'on a circle'
  when not l.ok then 'root' else 'not a root' end state, count(*) n_threads
from old left join linked l on old.id = l.id group by 1"""

_P1_PATHS = f"""{_LINKS},
reach(id) as (select id from linked where not ok union all select l.id from linked l join reach d on l.parent = d.id where l.ok),
lost as (select id, parent from linked where ok and id not in (select id from reach)),
up(id, seen) as (select id, parent from lost union select u.id, l.parent from up u join lost l on u.seen = l.id),
ring as (select id, min(seen) root from up where id in (select id from up where id = seen) group by 1),
down(id, root, depth, path, cyc) as ((select id, id, 0, [id], 0 from linked where not ok union all select id, root, 0, [id], 1 from ring)
  union all select l.id, d.root, d.depth + 1, list_append(d.path, l.id), 0 from linked l join down d on l.parent = d.id where l.ok and l.id not in (select id from ring)),
pairs as (select unnest(path) anc, id, unnest(range(depth, -1, -1)) dist from down)"""
P1_DESCENDANTS_SQL = f"""with recursive {_P1_PATHS},
n as (select anc, count(*) n_descendants, max(dist) height from pairs where dist > 0 group by 1)
select lpad(cast(id as varchar), 10, '0') tweet_id, lpad(cast(root as varchar), 10, '0') root_tweet_id, cast(depth as int) depth, cyc on_cycle,
 array_to_string(list_transform(path, lambda x: lpad(cast(x as varchar), 10, '0')), '>') path, coalesce(n_descendants, 0) n_descendants, cast(coalesce(height, 0) as int) height
from down left join n on down.id = n.anc"""
P1_PAIRS_SQL = f"""with recursive {_P1_PATHS}
select lpad(cast(anc as varchar), 10, '0') tweet_id, lpad(cast(id as varchar), 10, '0') descendant_id, cast(dist as int) distance from pairs where dist > 0"""

_IDS_IN_FIELD = "regexp_extract_all(regexp_replace(coalesce(response_tweet_id,''), '\"(\\d{1,3}),(\\d{3}),(\\d{3}),(\\d{3})\"', '\\1\\2\\3\\4', 'g'), '\\d{10}')"
P7_SQL = f"""with f as (select distinct {_ID.format('tweet_id')} id, {_IDS_IN_FIELD} ids from twcs),
e as (select id, unnest(range(1, len(ids) + 1)) pos, unnest(ids) r from f where len(ids) > 1 and id is not null)
select distinct lpad(cast(id as varchar), 10, '0') tweet_id, cast(pos as int) "position", r response_id from e"""

P7_ALL_SQL = f"""with f as (select {_IDS_IN_FIELD} ids, response_tweet_id x from twcs),
e as (select len(ids) n_values, case when (length(x) - length(replace(x, '"', ''))) % 2 = 1 or (length(x) - length(replace(x, chr(39), ''))) % 2 = 1 then 'open quote'
 when length(x) - length(replace(x, '[', '')) > length(x) - length(replace(x, ']', '')) then 'open bracket' else 'none' end error from f where len(ids) > 0)
select cast(n_values as int) n_values, error, cast(sum(n_values) as bigint) n, cast(sum(n_values) as bigint) n_ids from e group by 1, 2"""

QUERIES = {
    "p1_found": (p1_found, P1_SQL),
    "p1_descendants": (p1_descendants, P1_DESCENDANTS_SQL),
    "p1_pairs": (p1_pairs, P1_PAIRS_SQL),
    "p1_threads_check": (p1_threads_check, P1_CHECK_SQL),
    "p7_found": (p7_found, P7_SQL),
    "p7_all_values": (p7_all_values, P7_ALL_SQL),
}
