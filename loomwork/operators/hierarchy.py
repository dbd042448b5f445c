"""Parent-child rows to full hierarchies: root, depth, path, descendants, circles.

Method: level-wise frontier joins.  The roots are the first frontier; each round
joins the rows still open to the frontier on their parent, which gives them root
and depth (and path) and makes them the next frontier.  Only open rows take part
in a round, so all rounds together read the sum of the depths.  After
``levels`` rounds the few rows left, parts of very deep chains, are contracted:
every open row takes over the pointer of the row it points to, so that a round
covers twice as many levels as the one before, and one last frontier join ends
them.  Rows that no frontier reaches lie on circles or below them.  Following
2^k links from every such row, the rows that are met are those on circles as
soon as their number stays the same; the smallest id met there is the root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomwork.operators.skew import lookup_join
from loomwork.session import discard, written

LEVELS = 6


def resolve_hierarchy(
    nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", with_path: bool = False, levels: int = LEVELS
) -> DataFrame:
    """One row for each id: ``id, parent, parent_present, root, depth, on_cycle`` and,
    if ``with_path``, ``path`` (ids from the root, or from the circle, to the row).

    * A row without parent, or whose parent is no id of the table, is a root of depth 0.
    * ``on_cycle`` is 1 for rows on a circle of links (depth 0, path of itself); the root
      of a circle and of all below it is the smallest id on it.  A row that is its
      own parent is a circle of one.
    * Rows without id are left out.  Repeated ids are one row; if their parents differ, the
      largest counts.  An empty table gives an empty result.
    * Other columns of ``nodes`` are ignored, whatever their names.
    """
    base = (
        nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
        .filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max("parent").alias("parent"))
    )
    base = written(base, "nodes")
    children = (
        base.filter(F.col("parent").isNotNull())
        .groupBy("parent")
        .agg(F.count("*").alias("n"))
        .join(base.select(F.col("id").alias("parent")), "parent", "left_semi")
        .withColumn("parent_present", F.lit(True))
    )
    children = written(children, "parents")
    joined = lookup_join(base, children, "parent", "n", "left")
    linked = written(joined.select("id", "parent", F.coalesce("parent_present", F.lit(False)).alias("parent_present")), "links")
    discard(base)
    discard(children)

    roots = linked.filter(~F.col("parent_present")).select(
        "id", "parent", F.col("id").alias("root"), F.lit(0).alias("depth"), F.lit(0).alias("on_cycle")
    )
    edges = linked.filter("parent_present").select("id", F.col("parent").alias("anc"))
    if with_path:
        roots = roots.withColumn("path", F.array("id"))
    done = [roots]
    parts, rest = _descend(edges, roots, with_path, levels)
    done += parts
    if rest is not None:
        circle, below = _circles(rest, with_path)
        done.append(circle)
        parts, unreached = _descend(below, circle, with_path, levels)
        assert unreached is None, "every open row lies below a circle"
        done += parts
    out = roots.withColumn("parent_present", F.lit(False))
    for part in done[1:]:
        out = out.unionByName(part.withColumn("parent_present", F.lit(True)))
    return out


def _descend(edges: DataFrame, frontier: DataFrame, with_path: bool, levels: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows of ``edges (id, anc)`` reached from ``frontier``, and the rest if there is any."""
    parts: list[DataFrame] = []
    open_, cols = edges, ["root", "depth"] + ["path"] * with_path
    n_open = -1
    for level in range(levels):
        table, got, n_open = _round(open_, frontier, cols, with_path, f"level{level}")
        before, open_ = open_, table.filter(F.col("root").isNull()).select("id", "anc")
        frontier = _reached(table, with_path)
        if got:
            parts.append(frontier)
        if n_open == 0:
            return parts, None
        if got == 0:
            return parts, open_
    # deep chains: contract the pointers among the open rows
    work, k = _contract(open_, frontier.select(F.col("id").alias("anc")), with_path)
    ready = work.filter("ready")
    joined = ready.alias("w").join(frontier.select(F.col("id").alias("anc"), *[F.col(c).alias("f_" + c) for c in cols]), "anc")
    reached = joined.select(
        "id",
        "parent",
        F.col("f_root").alias("root"),
        (F.col("f_depth") + F.col("dist")).cast("int").alias("depth"),
        F.lit(0).alias("on_cycle"),
        *([F.concat("f_path", "seg").alias("path")] if with_path else []),
    )
    parts.append(reached)
    n_rest = k
    rest = work.filter(~F.col("ready")).select("id", F.col("parent").alias("anc"))
    return parts, (rest if n_rest else None)


def _round(open_: DataFrame, frontier: DataFrame, cols: list[str], with_path: bool, label: str):
    seen = Observation()
    right = frontier.select(F.col("id").alias("anc"), *cols)
    table = open_.join(right, "anc", "left").observe(
        seen, F.count("root").alias("got"), F.count(F.when(F.col("root").isNull(), 1)).alias("open")
    )
    table = written(table, label)
    counts = seen.get
    return table, counts["got"], counts["open"]


def _reached(table: DataFrame, with_path: bool) -> DataFrame:
    hit = table.filter(F.col("root").isNotNull())
    return hit.select(
        "id",
        F.col("anc").alias("parent"),
        "root",
        (F.col("depth") + 1).alias("depth"),
        F.lit(0).alias("on_cycle"),
        *([F.concat("path", F.array("id")).alias("path")] if with_path else []),
    )


def _contract(open_: DataFrame, entries: DataFrame, with_path: bool) -> tuple[DataFrame, int]:
    """Pointer doubling among ``open_ (id, anc)``: ``ready`` rows point to an entry,
    ``dist`` links away.  Ends when a round makes no further row ready.
    Returns the table and the number of rows that never got ready."""
    start = open_.join(entries.withColumn("ready", F.lit(True)), "anc", "left").select(
        "id",
        F.col("anc").alias("parent"),
        "anc",
        F.lit(1).cast("long").alias("dist"),
        F.coalesce("ready", F.lit(False)).alias("ready"),
        *([F.array("id").alias("seg")] if with_path else []),
    )
    work = written(start, "contract")
    n_ready = work.filter("ready").count()
    while True:
        seen = Observation()
        right = work.select(
            F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("ready").alias("ready2"),
            *([F.col("seg").alias("seg2")] if with_path else []),
        )
        moving = work.filter(~F.col("ready")).join(right, "anc")
        moved = moving.select(
            "id",
            "parent",
            F.col("anc2").alias("anc"),
            (F.col("dist") + F.col("dist2")).alias("dist"),
            F.col("ready2").alias("ready"),
            *([F.concat("seg2", "seg").alias("seg")] if with_path else []),
        )
        step = work.filter("ready").unionByName(moved)
        step = written(
            step.observe(seen, F.count(F.when(F.col("ready"), 1)).alias("ready"), F.count(F.lit(1)).alias("all")), "contract"
        )
        counts = seen.get
        discard(work)
        work = step
        if counts["ready"] == n_ready or counts["ready"] == counts["all"]:
            return work, counts["all"] - counts["ready"]
        n_ready = counts["ready"]


def _circles(rest: DataFrame, with_path: bool) -> tuple[DataFrame, DataFrame]:
    """Rows on circles, and the links of the rows below them, of ``rest (id, anc)``."""
    rest = written(rest, "unreached")
    work = written(rest.select("id", F.col("anc").alias("parent"), F.col("anc").alias("jump"), F.col("id").alias("low")), "circle")
    met = -1
    while True:
        seen = Observation()
        right = work.select(F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
        step = work.join(right, "jump").select(
            "id", "parent", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low"),
            (F.col("low2") < F.col("low")).alias("fell"),
        )
        step = written(step.observe(seen, F.count(F.when(F.col("fell"), 1)).alias("fell")), "circle")
        now = step.select("jump").distinct().count()
        discard(work)
        work = step
        # rows below a circle may still fall after the circles stand still
        on = work.select(F.col("jump").alias("id")).distinct()
        if now == met and (
            seen.get["fell"] == 0 or _still(work, on)
        ):
            break
        met = now
    on = written(on, "on-circle")
    lows = work.join(on, "id", "left_semi")
    circle = lows.select(
        "id",
        "parent",
        F.col("low").alias("root"),
        F.lit(0).alias("depth"),
        F.lit(1).alias("on_cycle"),
        *([F.array("id").alias("path")] if with_path else []),
    )
    return circle, rest.join(on, "id", "left_anti").select("id", "anc")


def _still(work: DataFrame, on: DataFrame) -> bool:
    """Whether one more doubling would lower no minimum on a circle."""
    c = work.join(on, "id", "left_semi").select("id", "jump", "low")
    r = c.select(F.col("id").alias("jump"), F.col("low").alias("low2"))
    return c.join(r, "jump").filter(F.col("low2") < F.col("low")).isEmpty()


def descendant_pairs(resolved: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` for every pair of the trees; needs ``path``.

    A row is no descendant of itself; rows on a circle have no ancestors here."""
    return (
        resolved.select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
        .select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
        .filter(F.col("distance") > 0)
    )


def descendant_counts(resolved: DataFrame) -> DataFrame:
    """``id, n_descendants, height`` for every row; needs ``path``.  The pairs are
    counted before they are shuffled, so a root above a third of the rows is no hot key."""
    pairs = descendant_pairs(resolved)
    counts = pairs.groupBy(F.col("ancestor").alias("id")).agg(
        F.count("*").alias("n_descendants"), F.max("distance").alias("height")
    )
    return resolved.select("id", "root", "depth", "on_cycle").join(counts, "id", "left").select(
        "id", "root", "depth", "on_cycle",
        F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"),
        F.coalesce("height", F.lit(0)).cast("int").alias("height"),
    )
