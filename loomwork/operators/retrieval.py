"""Exact nearest neighbours of a stated set of queries in a corpus of vectors.

The corpus is read once for each block of queries.  A block is at most ``block`` vectors, so
the broadcast side is bounded whatever the number of queries; every task keeps the best k of
its own rows for each query, and only these meet in the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def norm_check(df: DataFrame, vector: str = "embedding", low: float = 0.99, high: float = 1.01) -> DataFrame:
    """One row: vectors, vectors whose length is not in [low, high], vectors without values."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.agg(F.count("*").alias("n"), F.count_if((norm < low) | (norm > high)).alias("n_off"), F.count_if(F.size(vector) <= 0).alias("n_empty"))


def top_k(
    queries: DataFrame, corpus: DataFrame, k: int, same_label: bool = False, exclude_self: bool = True,
    min_score: float = -1.0, dedup: bool = False, block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, id, score`` of ``queries``/``corpus (id, vector, label[, dedup_key, thread_id, text])``.

    A query may name what it must not find: ``not_ids`` (array of ids), ``not_threads`` and ``not_texts`` (arrays of
    texts; texts compare trimmed and in lower case).  Without a ``dedup_key`` rows are the same if their texts compare equal.

    Cosine of unit vectors (dot product in double), ties by id, ranks 1..k without gaps.
    Exclusions come before the removal of equal ``dedup_key``s and both before the first k.
    ``k`` of 0 or less gives no rows; null vectors and vectors of another length take no part."""
    spark = corpus.sparkSession
    schema = "query_id bigint, id bigint, score double, dedup_key string"
    form = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    given = lambda df, c, e, t: (e if c in df.columns else F.lit(None).cast(t)).alias(c)
    key = F.col("dedup_key") if "dedup_key" in corpus.columns else form("text") if "text" in corpus.columns else None
    if dedup and key is None:
        raise ValueError("removing repeats needs a dedup_key or a text")
    if k <= 0:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    q = queries.select(
        F.col("id").cast("bigint").alias("id"), "vector", F.col("label").cast("string").alias("label"),
        given(queries, "not_ids", F.col("not_ids").cast("array<bigint>"), "array<bigint>"), given(queries, "not_threads", F.transform("not_threads", lambda x: F.trim(x)), "array<string>"),
        given(queries, "not_texts", F.transform("not_texts", lambda x: F.lower(F.trim(x))), "array<string>"),
    ).filter("vector is not null")
    c = corpus.select(
        F.col("id").cast("bigint").alias("id"), "vector", F.col("label").cast("string").alias("label"),
        (key.cast("string") if dedup else F.lit(None).cast("string")).alias("dedup_key"),
        given(corpus, "thread_id", F.trim("thread_id"), "string"), (form("text") if "text" in corpus.columns else F.lit(None).cast("string")).alias("text"),
    ).filter("vector is not null")
    n_blocks = max(1, -(-q.count() // block))
    parts = None
    numbered = q.withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    for b in range(n_blocks):
        rows = numbered.filter(F.col("__b") == b).drop("__b").toPandas()  # about ``block`` rows
        if not len(rows):
            continue
        size = rows["vector"].map(len).mode()[0]
        rows = rows[rows["vector"].map(len) == size]
        held = spark.sparkContext.broadcast((rows["id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(np.float64), rows["label"].to_numpy(), _exclusions(rows)))
        part = c.mapInPandas(_scan(held, k, same_label, exclude_self, min_score, dedup), schema)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    if dedup:
        same = Window.partitionBy("query_id", "dedup_key").orderBy(F.desc("score"), F.asc("id"))
        parts = parts.withColumn("__d", F.row_number().over(same)).filter("__d = 1").drop("__d")
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _exclusions(rows: pd.DataFrame) -> list[tuple[int, str, set]]:
    """``(place of the query, column of the corpus, values)`` of all queries that must not find something."""
    out = []
    for name, column in (("not_ids", "id"), ("not_threads", "thread_id"), ("not_texts", "text")):
        for j, values in enumerate(rows[name]):
            if values is not None and len(values):
                out.append((j, column, {v for v in values if v is not None}))
    return out


def _scan(held: Any, k: int, same_label: bool, exclude_self: bool, min_score: float, dedup: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, qv, ql, without = held.value
        kept: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf[pdf["vector"].map(len) == qv.shape[1]]
            if not len(pdf):
                continue
            ids = pdf["id"].to_numpy()
            scores = np.stack(pdf["vector"].to_numpy()).astype(np.float64) @ qv.T
            bad = scores < min_score
            if exclude_self:
                bad |= ids[:, None] == qid[None, :]
            if same_label:
                bad |= pdf["label"].to_numpy()[:, None] != ql[None, :]
            for j, column, values in without:
                bad[:, j] |= pdf[column].isin(values).to_numpy()
            scores[bad] = -np.inf
            best = scores
            if dedup:  # only the best row of a key counts
                codes = pd.factorize(pdf["dedup_key"], use_na_sentinel=False)[0]
                order = np.argsort(codes, kind="stable")
                best = np.maximum.reduceat(scores[order], np.flatnonzero(np.diff(codes[order], prepend=-1)), axis=0)
            take = min(len(best), k)
            cut = np.partition(-best, take - 1, axis=0)[take - 1] * -1
            near = (scores >= cut[None, :]) & np.isfinite(scores)
            if dedup:
                near &= scores == best[codes]
            row, col = np.nonzero(near)
            got = pd.DataFrame({"query_id": qid[col], "id": ids[row], "score": scores[row, col], "dedup_key": pdf["dedup_key"].to_numpy()[row]})
            kept = _best(got if kept is None else pd.concat([kept, got]), k, dedup)
        if kept is not None:
            yield kept

    return scan


def _best(rows: pd.DataFrame, k: int, dedup: bool) -> pd.DataFrame:
    rows = rows.sort_values(["query_id", "score", "id"], ascending=[True, False, True], kind="stable")
    if dedup:
        rows = rows.drop_duplicates(["query_id", "dedup_key"])
    return rows[rows.groupby("query_id").cumcount() < k]


def conditioned_mean(scores: DataFrame, group: Column, value: Column) -> DataFrame:
    return scores.groupBy(group.alias("group")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
