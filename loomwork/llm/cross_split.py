"""Records of one split that occur again, exactly or nearly, in another.

Method: weighted cosine join over inverted lists.

1. Records with the same set of words are one class; classes are compared, members are
   attached afterwards, so copies are never expanded into pairs of each other.
2. A class is a vector of term weights (``unit`` or ``idf``) of length 1, terms in order
   of rising document frequency.
3. Only a prefix of a vector enters the inverted lists: the part up to which a partner
   can still reach the threshold ``t``.  From position i on, a partner gets at most the
   residual norm ||x[i:]|| and at most sum x[j] * maxweight(j) over the other split.
   Where either bound falls below t the prefix ends; no pair at or above t is lost.
4. The lists are joined by term and the products summed up by pair.  After the last term two
   prefixes share, the rest of their product is at most the product of the residual norms
   there; pairs whose sum and rest stay below t are dropped.  Only numbers are shuffled here.
5. Only for the pairs left the whole vectors are fetched; their dot product is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import without_links, words
from loomwork.operators.skew import lookup_join
from loomwork.session import written

EPS = 1e-9


def word_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``id, cls`` and classes ``cls (a number), terms, n_members`` of ``records (id, text)``.

    ``terms`` are the distinct words of the text without mentions and links; records without words are left out."""
    terms = F.array_sort(F.array_distinct(words(without_links(F.coalesce(F.col("text"), F.lit(""))))))
    # filtered when written: a filter before would compute the words twice
    rows = written(records.select("id", terms.alias("terms")).filter(F.col("id").isNotNull()), "split").filter(F.size("terms") > 0)
    rows = rows.withColumn("digest", F.unhex(F.md5(F.array_join("terms", " "))))
    classes = rows.groupBy("digest").agg(F.first("terms").alias("terms"), F.count("*").alias("n_members"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    members = lookup_join(rows.select("id", "digest"), classes.select("digest", "cls", "n_members"), "digest", "n_members")
    return members.select("id", "cls").distinct(), classes.drop("digest")


def _weight(scheme: str, df: Column, n: int) -> Column:
    if scheme == "unit":
        return F.lit(1.0)
    return F.log(F.lit(1.0) + F.lit(float(n)) / df)


def cosine_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.8, scheme: str = "unit") -> DataFrame:
    """``l_cls, r_cls, cosine, shared, l_size, r_size`` of all pairs of classes of ``left`` (the
    smaller, evaluation side) and ``right (cls, terms)`` with cosine of at least ``threshold``."""
    l_terms = left.select("cls", F.explode("terms").alias("term"))
    r_terms = right.select("cls", F.explode("terms").alias("term"))
    counts = (
        l_terms.select("term", F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionAll(r_terms.select("term", F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy("term")
        .agg(F.sum("l").alias("l_df"), F.sum("r").alias("r_df"))
    )
    n = left.count() + right.count()
    df = F.col("l_df") + F.col("r_df")
    # terms go by numbers from here on
    stats = written(counts.select("term", "l_df", "r_df", df.alias("df"), _weight(scheme, df, n).alias("w"), F.monotonically_increasing_id().alias("k")), "terms")
    l_stats = stats.filter("l_df > 0").select("term", "k", "df", "w", F.col("r_df").cast("double").alias("other"), F.col("l_df").alias("n"))
    l_vec = written(_vectors(l_terms, l_stats, "other"), "left-vectors")
    l_max = l_vec.select(F.explode("vec").alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.max("x.wn").alias("top"))
    r_stats = stats.filter("r_df > 0").join(l_max, "k", "left").select("term", "k", "df", "w", F.coalesce("top", F.lit(0.0)).alias("top"), F.col("r_df").alias("n"))
    r_vec = written(_vectors(r_terms, written(r_stats, "right-terms"), "top"), "right-vectors")
    cols = ("cls", "wn", "res", "size")
    l_pre = _prefix(l_vec, threshold, with_top=False).select("k", *[F.col(c).alias("l_" + c) for c in cols], F.col("extra").alias("r_df")).filter("r_df > 0")
    r_pre = _prefix(r_vec, threshold, with_top=True).select("k", *[F.col(c).alias("r_" + c) for c in cols])
    postings = lookup_join(r_pre, written(l_pre, "left-lists"), "k", "r_df")
    size = F.sqrt(F.col("l_size").cast("double") * F.col("r_size"))
    if scheme == "unit":
        # vectors of unit weights reach t only if the shorter has t * t of the longer's terms
        postings = postings.filter(F.least("l_size", "r_size") >= (threshold * threshold - EPS) * F.greatest("l_size", "r_size"))
    sums = postings.groupBy("l_cls", "r_cls").agg(
        F.sum(F.col("l_wn") * F.col("r_wn")).alias("dot"), F.min("l_res").alias("l_res"), F.min("r_res").alias("r_res"), F.max("l_size").alias("l_size"), F.max("r_size").alias("r_size")
    )
    rest = F.col("l_res") * F.col("r_res")
    if scheme == "unit":  # as many terms as the shorter rest has
        rest = F.least(F.col("l_res") * F.col("l_res") * F.col("l_size"), F.col("r_res") * F.col("r_res") * F.col("r_size")) / size
    pairs = written(sums.filter(F.col("dot") + rest >= threshold - EPS).select("l_cls", "r_cls", "l_size", "r_size"), "candidates")
    ids = F.transform("vec", lambda x: x["k"])
    weights = F.map_from_entries(F.transform("vec", lambda x: F.struct(x["k"], x["wn"])))
    l_side = l_vec.select(F.col("cls").alias("l_cls"), ids.alias("l_terms"), F.col("norm").alias("l_norm"), *([weights.alias("l_w")] if scheme != "unit" else []))
    r_side = r_vec.select(F.col("cls").alias("r_cls"), ids.alias("r_terms"), F.col("norm").alias("r_norm"))
    common = pairs.join(l_side, "l_cls").join(r_side, "r_cls").withColumn("common", F.array_intersect("l_terms", "r_terms"))
    shared = F.size("common")
    if scheme == "unit":
        cosine = shared / size
    else:  # a term has the same weight on both sides, only the lengths differ
        cosine = F.aggregate("common", F.lit(0.0), lambda a, t: a + F.pow(F.try_element_at("l_w", t), F.lit(2))) * F.col("l_norm") / F.col("r_norm")
    scored = written(common.select("l_cls", "r_cls", "l_size", "r_size", cosine.alias("cosine"), shared.alias("shared")), "scored")
    return scored.filter(F.col("cosine") >= threshold - EPS)


def _vectors(terms: DataFrame, stats: DataFrame, extra: str) -> DataFrame:
    """``cls, norm, vec<df, k, wn, extra>``: terms by rising frequency, weights of a unit vector."""
    rows = lookup_join(terms, stats, "term", "n")
    vec = rows.groupBy("cls").agg(
        F.array_sort(F.collect_list(F.struct("df", "k", F.col("w").alias("wn"), F.col(extra).alias("extra")))).alias("v"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
    )
    scale = F.transform("v", lambda x: F.struct(x["df"].alias("df"), x["k"].alias("k"), (x["wn"] / F.col("norm")).alias("wn"), x["extra"].alias("extra")))
    return vec.select("cls", "norm", scale.alias("vec"))


def _prefix(vectors: DataFrame, threshold: float, with_top: bool) -> DataFrame:
    """``cls, k, wn, res, size, extra`` of the prefixes; ``res`` is the norm of what follows the term.

    ``with_top``: ``extra`` is the largest weight of the term on the other side."""
    # residuals from position i on, by running sums from the end
    back = F.reverse("vec")
    kept = "array<struct<k:bigint,wn:double,res:double,extra:double>>"
    first = F.struct(F.lit(0.0).alias("sq"), F.lit(0.0).alias("mx"), F.array().cast(kept).alias("keep"))

    def step(acc: Column, x: Column) -> Column:
        sq = acc["sq"] + x["wn"] * x["wn"]
        mx = acc["mx"] + (x["wn"] * x["extra"] if with_top else F.lit(0.0))
        reach = sq >= (threshold - EPS) ** 2
        if with_top:
            reach = reach & (mx >= threshold - EPS) & (x["extra"] > 0)
        one = F.struct(x["k"].alias("k"), x["wn"].alias("wn"), F.sqrt(acc["sq"]).alias("res"), x["extra"].alias("extra"))
        keep = F.when(reach, F.concat(acc["keep"], F.array(one))).otherwise(acc["keep"])
        return F.struct(sq.alias("sq"), mx.alias("mx"), keep.alias("keep"))

    rows = vectors.select("cls", F.size("vec").alias("size"), F.explode(F.aggregate(back, first, step)["keep"]).alias("x"))
    return rows.select("cls", "size", "x.*")


def cross_split_overlaps(evaluation: DataFrame, training: DataFrame, dice: float = 0.8) -> DataFrame:
    """``eval_id, train_id, shared, eval_words, train_words, exact`` for records whose word sets
    share twice their common words of at least ``dice`` of both sizes.

    Found by the cosine join with unit weights at the same threshold, which loses none of
    them (the cosine of two sets is never below that ratio), then checked exactly.

    * Null texts and texts without words have no overlap.  Repeated rows count once.
    * Equal ids in both splits are an overlap like any other.  Empty tables give an empty result.
    """
    l_members, l_classes = word_classes(evaluation)
    r_members, r_classes = word_classes(training)
    pairs = cosine_pairs(l_classes, r_classes, dice, "unit")
    held = pairs.filter(2 * F.col("shared") >= dice * (F.col("l_size") + F.col("r_size")) - EPS)
    return attach_members(held, l_members, r_members, r_classes)


def attach_members(pairs: DataFrame, l_members: DataFrame, r_members: DataFrame, r_classes: DataFrame) -> DataFrame:
    """The members of matching classes.  A class of very many training records is joined where they lie."""
    sized = written(pairs.join(r_classes.select(F.col("cls").alias("r_cls"), "n_members"), "r_cls").withColumnRenamed("r_cls", "cls"), "matches")
    rows = lookup_join(r_members.select(F.col("id").alias("train_id"), "cls"), sized, "cls", "n_members").withColumnRenamed("cls", "r_cls")
    left = l_members.select(F.col("id").alias("eval_id"), F.col("cls").alias("l_cls"))
    return rows.join(left, "l_cls").select(
        "eval_id",
        "train_id",
        "shared",
        F.col("l_size").alias("eval_words"),
        F.col("r_size").alias("train_words"),
        "cosine",
        (F.col("l_cls") == F.col("r_cls")).alias("exact"),
    )
