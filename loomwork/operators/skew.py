"""Joins and rankings that hold up when one key owns a third of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import written

#: Keys of at least this weight are hot; so many rows make a task of some seconds.
HOT_WEIGHT = 50_000
#: No more hot keys than this are broadcast (as a hash and a number each), whatever the total.
HOT_KEYS = 2_000
#: Rows without a key are spread over this many places of an outer join.
NULL_SPREAD = 1_000


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    weight: str,
    how: str = "inner",
    hot_weight: int = HOT_WEIGHT,
) -> DataFrame:
    """Join ``left`` to ``right``, whose ``weight`` counts the rows of ``left`` with its key.

    One shuffle join over (key, salt), each side read once.  A key of ``hot_weight`` rows
    or more is hot: its rows of ``right`` are repeated once for every ``hot_weight``
    rows, and the rows of ``left`` are spread over the repeats by a hash of all their columns.
    Only hashes of hot keys are broadcast, at most ``HOT_KEYS`` numbers, taken by falling
    weight; a key beyond that bound, or one with an equal hash, is joined all the same.
    Where ``right`` is small the optimizer broadcasts it and nothing is shuffled.

    Null keys match nothing and are spread as well.  ``how`` is ``inner`` or ``left``.
    """
    hot = (
        right.filter((F.col(weight) >= hot_weight) & F.col(key).isNotNull())
        .select(F.xxhash64(key).alias("__h"), F.ceil(F.col(weight) / hot_weight).cast("int").alias("__reps"))
        .groupBy("__h")
        .agg(F.max("__reps").alias("__reps"))
        .orderBy(F.desc("__reps"), "__h")
        .limit(HOT_KEYS)
    )
    found = [(r["__h"], r["__reps"]) for r in hot.collect()]  # at most HOT_KEYS pairs of numbers
    if not found and how == "inner":
        return left.join(right, key, how)
    row = F.xxhash64(*[F.col(c) for c in left.columns])
    # rows without a key match nothing, but an outer join would send them all to one task
    lost = F.when(F.col(key).isNull(), 1 + F.pmod(row, F.lit(NULL_SPREAD)).cast("int"))
    if not found:
        return left.withColumn("__salt", F.coalesce(lost, F.lit(0))).join(right.withColumn("__salt", F.lit(0)), [key, "__salt"], how).drop("__salt")
    hot = F.broadcast(left.sparkSession.createDataFrame(found, "__h bigint, __reps int"))
    spread = F.pmod(row, F.col("__reps")).cast("int")
    a = left.withColumn("__h", F.xxhash64(key)).join(hot, "__h", "left").withColumn("__salt", F.coalesce(lost, spread, F.lit(0))).drop("__h", "__reps")
    repeats = F.explode(F.sequence(F.lit(0), F.coalesce("__reps", F.lit(1)) - 1))
    b = right.withColumn("__h", F.xxhash64(key)).join(hot, "__h", "left").withColumn("__salt", repeats).drop("__h", "__reps")
    return a.join(b, [key, "__salt"], how).drop("__salt")


def global_row_number(df: DataFrame, group: list[str], order: list[Column], name: str, label: str = "rank") -> DataFrame:
    """``row_number() over (partition by group order by order)`` without putting a
    group into one task.

    The rows are range-partitioned by group and order (a distributed merge
    sort), numbered inside each partition, and groups that continue from an
    earlier partition are shifted by the rows they have there.  Only the first
    group of a partition can continue, so the shifts are at most one row a
    partition.  ``order`` must be total within a group, otherwise ties are
    numbered in an unspecified but unique order.

    The numbered rows are written to the shared folder: range bounds come from
    a sample, so partition and row must be fixed together.
    """
    pid, loc = f"__pid_{uuid.uuid4().hex[:6]}", "__loc"
    ranged = df.repartitionByRange(*[F.col(c) for c in group], *order).withColumn(pid, F.spark_partition_id())
    local = ranged.withColumn(loc, F.row_number().over(Window.partitionBy(pid, *group).orderBy(*order)))
    fixed = written(local, label)
    pieces = fixed.groupBy(*group, pid).agg(F.max(loc).cast("long").alias("__n"))
    first = pieces.groupBy(*group).agg(F.collect_list(F.struct(F.col(pid).alias("p"), F.col("__n").alias("n"))).alias("__p"))
    spread = first.filter(F.size("__p") > 1)
    shifts = spread.select(
        *group,
        F.explode(
            F.transform(
                "__p",
                lambda x: F.struct(
                    x["p"].alias("p"),
                    F.aggregate(
                        F.filter("__p", lambda y: y["p"] < x["p"]), F.lit(0).cast("long"), lambda a, y: a + y["n"]
                    ).alias("before"),
                ),
            )
        ).alias("__s"),
    ).select(*group, F.col("__s.p").alias(pid), F.col("__s.before").alias("__before"))
    out = fixed.join(F.broadcast(shifts), [*group, pid], "left")
    number = (F.col(loc) + F.coalesce(F.col("__before"), F.lit(0))).cast("int")
    return out.select(*df.columns, number.alias(name))
