"""Classification and score metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """``truth, pred, n``."""
    return df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support`` over all labels of truth or prediction; 0 where undefined."""
    rows = conf.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).alias("p")),
        F.struct(F.col("pred").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.col("n").alias("p")),
    )).alias("x")).select("x.*")
    g = rows.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    p = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return g.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support", "tp")


def overall(classes: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted averages."""
    n = F.sum("support")
    w = lambda c: F.sum(F.col(c) * F.col("support")) / n
    return classes.agg(
        (F.sum("tp") / n).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        w("precision").alias("weighted_precision"), w("recall").alias("weighted_recall"), w("f1").alias("weighted_f1"), n.alias("n"),
    )


def slice_accuracy(df: DataFrame, slice_col: str, truth: str, pred: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    return df.filter(F.col(slice_col).isNotNull() & ~F.col(slice_col).isin(*leave_out) if leave_out else F.col(slice_col).isNotNull()).groupBy(slice_col).agg(
        F.count("*").alias("n"), F.avg(F.coalesce(F.col(truth) == F.col(pred), F.lit(False)).cast("double")).alias("accuracy")
    )


def binary(df: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, F1, FPR, FNR; precision and recall are 1 where undefined, the rates 0."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(pred, F.lit(False))
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    pr = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(1.0))
    rc = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1.0))
    return c.select(
        "tp", "fp", "fn", "tn", pr.alias("precision"), rc.alias("recall"), F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0)).alias("f1"),
        F.coalesce(F.try_divide("fp", F.col("fp") + F.col("tn")), F.lit(0.0)).alias("fpr"), F.coalesce(F.try_divide("fn", F.col("fn") + F.col("tp")), F.lit(0.0)).alias("fnr"),
    )


def distribution(df: DataFrame, value: Column) -> DataFrame:
    """n, mean, population deviation, min, exact quartiles and 95th percentile, max."""
    pc = lambda q: F.percentile(value, F.lit(q))
    return df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), pc(0.25).alias("p25"),
        pc(0.5).alias("p50"), pc(0.75).alias("p75"), pc(0.95).alias("p95"), F.max(value).alias("max"),
    )


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n`` for several columns in one pass (grouping by exploded pairs)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n")).select("column", "value", "n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight`` with weight N / (K * n)."""
    c = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # one row a label
    total, k = F.sum("n").over(whole), F.count("*").over(whole)
    return c.select(label, "n", (total / (k * F.col("n"))).alias("weight"))


def majority(df: DataFrame, label: str) -> DataFrame:
    """The most frequent label, ties by name."""
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1)


def compare_models(base: DataFrame, other: DataFrame) -> DataFrame:
    """``label, base_f1, other_f1, delta``; a missing label counts 0."""
    a = base.select("label", F.col("f1").alias("base_f1"))
    b = other.select("label", F.col("f1").alias("other_f1"))
    z = F.lit(0.0)
    return a.join(b, "label", "full").select(
        "label", F.coalesce("base_f1", z).alias("base_f1"), F.coalesce("other_f1", z).alias("other_f1"), (F.coalesce("other_f1", z) - F.coalesce("base_f1", z)).alias("delta")
    )


def _of(dimension: str):
    return lambda issue: issue["dimension"] == dimension


def verdict_rates(df: DataFrame, verdict: str, overall: str, dimensions: list[str], issues: str, scores: str = "scores") -> DataFrame:
    """One row: rows, share of each verdict, mean scores and shares of rows with an issue.

    ``scores`` is a map of dimension to score (a missing one counts 0), ``issues`` an array of structs with a ``dimension``."""
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 4)
    return df.agg(
        F.count("*").alias("n"), *[share(F.col(verdict) == v).alias("rate_" + v.lower()) for v in ("PASS", "NEEDS_HUMAN_REVIEW", "FAIL")], F.round(F.avg(overall), 4).alias("mean_overall"),
        *[F.round(F.avg(F.coalesce(F.try_element_at(scores, F.lit(x)), F.lit(0.0))), 4).alias("mean_" + x) for x in dimensions],
        *[share(F.exists(issues, _of(x))).alias("issue_" + x) for x in dimensions],
    )


def latency(df: DataFrame, columns: list[str]) -> DataFrame:
    """``component, mean_ms, std_ms, min_ms, p50_ms, p95_ms, max_ms`` of each column, two digits, exact percentiles; one pass."""
    two = lambda c: F.round(c, 2)
    one = lambda c: F.struct(
        F.lit(c).alias("component"), two(F.avg(c)).alias("mean_ms"), two(F.stddev_pop(c)).alias("std_ms"), two(F.min(c)).alias("min_ms"),
        two(F.percentile(c, F.lit(0.5))).alias("p50_ms"), two(F.percentile(c, F.lit(0.95))).alias("p95_ms"), two(F.max(c)).alias("max_ms"),
    )
    return df.agg(F.array(*[one(c) for c in columns]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
