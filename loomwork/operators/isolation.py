"""Strict separation of splits, validation rules and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.skew import global_row_number, lookup_join
from loomwork.session import written
from loomwork.sources.tables import id_number


def isolated(rows: DataFrame, held_out: DataFrame, id_col: str = "tweet_id") -> DataFrame:
    """Rows whose id is not held out; ids compare as numbers, rows without id stay."""
    keys = held_out.select(id_number(id_col).alias("__k")).filter("__k is not null").distinct()
    return rows.withColumn("__k", id_number(id_col)).join(keys, "__k", "left_anti").drop("__k")


def violations(rows: DataFrame, held_out: DataFrame, id_col: str = "tweet_id") -> DataFrame:
    """Distinct ids in both."""
    a = rows.select(id_number(id_col).alias("id")).filter("id is not null").distinct()
    return a.join(held_out.select(id_number(id_col).alias("id")).distinct(), "id", "left_semi")


def check_rules(df: DataFrame, rules: dict[str, Column], unique: list[str]) -> DataFrame:
    """``rule, n_bad``: rows that break each rule (null counts as broken), and repeated values of unique columns; one pass."""
    aggs = [F.struct(F.lit(name).alias("rule"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_bad")) for name, ok in rules.items()]
    aggs += [F.struct(F.lit(f"unique {c}").alias("rule"), (F.count(c) - F.countDistinct(c)).alias("n_bad")) for c in unique]
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def seeded_order(id_col: str, seed: str) -> Column:
    """A pseudo-random order that any engine with SHA-256 repeats."""
    return F.sha2(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string")), 256)


def stratified_sample(df: DataFrame, id_col: str, slices: dict[str, tuple[Column, int]], seed: str) -> DataFrame:
    """``slice, id``: for each slice (condition, quota) the rows first in the seeded order.

    Each row is tested once; the window keeps at most the quota of each task before the shuffle
    (window group limit), so a slice of a third of all rows is no hot task."""
    hit = F.filter(F.array(*[F.when(cond, F.struct(F.lit(n).alias("slice"), F.lit(q).alias("quota"))) for n, (cond, q) in slices.items()]), lambda x: x.isNotNull())
    rows = df.select(F.col(id_col).alias("id"), seeded_order(id_col, seed).alias("o"), F.explode(hit).alias("s")).select("id", "o", "s.slice", "s.quota").distinct()
    w = Window.partitionBy("slice").orderBy("o", "id")
    most = max(q for _, q in slices.values())
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).filter(F.col("rn") <= F.col("quota")).select("slice", "id")


def audit_slices(labels: list[str], sizes: dict[str, int] | None = None) -> dict[str, tuple[Column, int]]:
    """The slices of an audit sample of labelled messages: each label, confidence and source, overlapping rules, labels at
    risk, and edge cases of the text.  Columns: ``candidate_intent, label_confidence, label_source, text, match_text, match_count``."""
    n = {"intent": 50, "confidence": 100, "source": 100, "overlap": 150, "risk": 100, "edge": 50} | (sizes or {})
    text, words = F.coalesce("text", F.lit("")), F.filter(F.split(F.coalesce("match_text", F.lit("")), r"\s+"), lambda w: w != "")
    out = {f"intent_{x}": (F.col("candidate_intent") == x, n["intent"]) for x in labels}
    out |= {f"confidence_{x}": (F.col("label_confidence") == x, n["confidence"]) for x in ("high", "medium", "low")}
    out |= {f"source_{x}": (F.col("label_source") == x, n["source"]) for x in ("rule", "fallback", "needs_review")}
    out["stratum_rule_overlap"] = (F.col("match_count") > 1, n["overlap"])
    out |= {f"high_risk_{x}": (F.col("candidate_intent") == x, n["risk"]) for x in ("software_update", "unknown_other", "needs_review")}
    return out | {
        "edge_case_short_message": (F.size(words) <= 5, n["edge"]), "edge_case_has_url": (text.rlike("https?://"), n["edge"]),
        "edge_case_has_mention": (text.rlike(r"@[A-Za-z0-9_]"), n["edge"]), "edge_case_has_emoji_or_special": (text.rlike(r"[^\x00-\x7F]"), n["edge"]),
    }


def sample_union(drawn: DataFrame) -> DataFrame:
    """``id, slices``: the rows of several slices as one sample, with the names of the slices that drew them."""
    return drawn.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("slice")), "|").alias("slices"))


def sample_sizes(drawn: DataFrame, slices: dict[str, tuple[Column, int]]) -> DataFrame:
    """``slice, requested, actual`` for every slice, also for those that drew nothing."""
    asked = drawn.sparkSession.createDataFrame([(n, q) for n, (_, q) in slices.items()], "slice string, requested int")
    got = drawn.groupBy("slice").agg(F.count("*").cast("int").alias("actual"))
    return asked.join(got, "slice", "left").select("slice", "requested", F.coalesce("actual", F.lit(0)).alias("actual"))


def review_view(rows: DataFrame, aliases: dict[str, str], blank: list[str]) -> DataFrame:
    """``rows`` with further names for some columns and empty columns for the reviewers to fill in."""
    return rows.select("*", *[F.col(c).alias(a) for a, c in aliases.items()], *[F.lit("").alias(c) for c in blank])


def check_requests(requests: DataFrame, longest: int = 1000, most: int = 10, modes: tuple[str, ...] = ("auto", "offline", "live")) -> DataFrame:
    """``requests (message, top_k, mode)`` with ``error``: null, or the first rule that a request breaks."""
    n = F.length("message")
    error = (
        F.when(F.col("message").isNull() | (n < 1), "message is missing").when(n > longest, "message is too long").when(~F.col("message").rlike(r"\S"), "message is blank")
        .when(F.col("top_k").isNull() | (F.col("top_k") < 1) | (F.col("top_k") > most), "top_k is out of range").when(~F.coalesce(F.col("mode").isin(*modes), F.lit(False)), "mode is unknown")
    )
    return requests.withColumn("error", error)


def cohorts(df: DataFrame, id_col: str, ordered: list[tuple[str, Column, int]], seed: str) -> DataFrame:
    """``cohort, id``: quotas filled in order, each from all rows that no earlier cohort took.

    A cohort can lose at most the quotas before it, so of each only that many more rows are
    looked at: the table is read once, and the draws run on these few."""
    reach = {}
    for i, (name, _, _) in enumerate(ordered):
        reach[name] = sum(q for _, _, q in ordered[: i + 1])
    wide = {name: (cond, reach[name]) for name, cond, _ in ordered}
    few = written(stratified_sample(df, id_col, wide, seed).filter("id is not null").withColumn("o", seeded_order("id", seed)), "cohort-candidates")
    used = few.filter("false").select("id")
    out = None
    for name, _, quota in ordered:
        drawn = few.filter(F.col("slice") == name).join(used, "id", "left_anti").orderBy("o", "id").limit(quota)
        drawn = written(drawn.select(F.lit(name).alias("cohort"), "id"), "cohort")
        used = used.unionAll(drawn.select("id"))
        out = drawn if out is None else out.unionAll(drawn)
    return out


def stratified_split(df: DataFrame, id_col: str, label: str, share: float, seed: str, names: tuple[str, str] = ("train", "valid")) -> DataFrame:
    """``split``: of each label the first ``share`` of its rows in the seeded order, rounded, and the rest.

    The rows are numbered by a distributed merge sort, so a label of a third of all rows is in no single task."""
    rows = df.withColumn("__o", seeded_order(id_col, seed))
    numbered = global_row_number(rows, [label], [F.col("__o").asc(), F.col(id_col).asc()], "__rn", "split-order")
    sizes = df.groupBy(label).agg(F.count("*").alias("__n"))
    both = lookup_join(numbered, written(sizes, "label-sizes"), label, "__n")
    return both.select(*df.columns, F.when(F.col("__rn") <= F.round(F.col("__n") * share), names[0]).otherwise(names[1]).alias("split"))


def split_by_hash(df: DataFrame, id_col: str, parts: dict[str, float], seed: str) -> DataFrame:
    """``split`` by a hash of the id: no shuffle, the same row is always in the same split."""
    u = F.conv(F.substring(seeded_order(id_col, seed), 1, 8), 16, 10).cast("double") / float(16**8)
    expr, edge = None, 0.0
    for name, share in parts.items():
        edge += share
        expr = F.when(u < edge, name) if expr is None else expr.when(u < edge, name)
    return df.withColumn("split", expr.otherwise(list(parts)[-1]))
