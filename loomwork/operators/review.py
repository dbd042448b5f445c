"""Checks of replies against their evidence: overlap, grounding, wording; weighted verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words left out of token overlaps.  Words with an apostrophe never match a token and are left out here.
STOPWORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by cannot could did do does doing down during "
    "each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself me more most my myself no nor not of off on once only or "
    "other ought our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under "
    "until up very was we were what when where which while who whom why with would you your yours yourself yourselves apple applesupport support".split()
)


def tokens(text: Column) -> Column:
    """Lower-case words of three and more letters, without stop words, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[a-z]{3,}\b"), 0), lambda w: ~w.isin(*STOPWORDS))


def overlap(reply: Column, evidence: Column) -> Column:
    """Share of the reply's tokens that stand in the evidence; null without tokens."""
    have = F.array_distinct(tokens(evidence))
    t = tokens(reply)
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda w: F.array_contains(have, w))) / F.size(t))


def grounding(reply: Column, evidence: Column, own: Column) -> Column:
    """Half the overlap, half the grounding score ``own`` that the writer of the reply gave it.

    0.3 without evidence, 0.5 without tokens; at most 0.5 where the overlap is below 0.15."""
    o = overlap(reply, evidence)
    score = F.round(0.5 * o + 0.5 * own, 4)
    return F.when(F.trim(F.coalesce(evidence, F.lit(""))) == "", 0.3).when(o.isNull(), 0.5).when(o < 0.15, F.least(score, F.lit(0.5))).otherwise(score)


def relevance(query: Column, reply: Column) -> Column:
    r = overlap(query, reply)
    return F.when(r.isNull(), 0.8).when(r >= 0.3, 1.0).when(r >= 0.15, 0.85).otherwise(0.65)


def completeness(reply: Column, action: str = r"\b(dm|try|check|restart|update|visit|contact|reset|settings|let us know)\b") -> Column:
    t = F.trim(F.coalesce(reply, F.lit("")))
    return F.when(t == "", 0.0).when(F.size(F.split(t, r"\s+")) < 5, 0.3).when(F.lower(t).rlike(action), 1.0).otherwise(0.75)


def new_links(reply: Column, evidence: Column) -> Column:
    """Links of the reply that the evidence does not have."""
    links = F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"https?://\S+"), 0)
    return F.filter(links, lambda x: ~F.contains(F.coalesce(evidence, F.lit("")), x))


def verdict(df: DataFrame, weights: dict[str, float], fail_below: float = 0.6, review_below: float = 0.75) -> DataFrame:
    """``df`` with ``overall`` (weighted mean of score columns, missing counts 0) and ``verdict``."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("overall", total).withColumn(
        "verdict", F.when(F.col("overall") < fail_below, "FAIL").when(F.col("overall") < review_below, "REVIEW").otherwise("PASS")
    )
