"""How a page's objects fall apart: cuts along empty corridors, regions that walls of text bound, big objects of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored
from .objects import GAP, PAGE, PAGE_H, PAGE_W, TEXT_GAP, adjacency, centre, page_components

#: The least share of the page on either side of a cut, of a big object, and the longest text that is no wall.
CUT_SHARE, BIG_SHARE, WALL_TEXT = 0.20, 0.30, 10
#: How far centres of one column and of one row of a grid lie apart at most, and how much of it is taken.
COLUMN, ROW, TAKEN = 60, 50, 0.6
KEY = [*PAGE, "cluster"]


def _bands(value: Column, tolerance: float, rows: DataFrame, name: str) -> DataFrame:
    """How many groups a cluster's rounded centres make, a new one after each gap over the tolerance."""
    order = Window.partitionBy(*KEY).orderBy("v")
    gaps = rows.select(*KEY, F.bround(value, 0).alias("v")).withColumn("gap", F.col("v") - F.lag("v").over(order))
    return gaps.groupBy(*KEY).agg((1 + F.count_if(F.col("gap") > tolerance)).alias(name))


def divisible(objects: DataFrame) -> DataFrame:
    """``(deck_id, page, cluster, wide, high)``: clusters of two objects and more that are no grid and hold no connector.

    wide and high are the extent of the cluster. A grid has four objects and more, in two columns and two rows or more
    of which they take TAKEN of the places.
    """
    cx, cy = centre()
    shape = objects.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.bool_or(F.col("kind") == "connector").alias("linked"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("wide"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("high"),
    )
    shape = shape.where("n >= 2 and not linked")
    grid = shape.join(_bands(cx, COLUMN, objects, "cols"), KEY).join(_bands(cy, ROW, objects, "rows"), KEY)
    is_grid = (F.col("n") >= 4) & (F.col("cols") >= 2) & (F.col("rows") >= 2) & (F.col("n") >= TAKEN * F.col("cols") * F.col("rows"))
    return grid.where(~is_grid).select(*KEY, "wide", "high")


def corridors(rows: DataFrame, gap: float) -> DataFrame:
    """``(deck_id, page, cluster, turn, cut)``: the middles of gaps over ``gap`` that no interval of the cluster reaches into.

    ``rows(deck_id, page, cluster, low, high, total)``; intervals are cut off at 0 and at ``total``, the cluster's extent.
    """
    ends = rows.select(*KEY, F.greatest("low", F.lit(0.0)).alias("a"), F.least("high", "total").alias("b"))
    before = F.max("b").over(Window.partitionBy(*KEY).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    reach = F.greatest(before, F.lit(0.0))
    gaps = ends.withColumn("before", before).withColumn("reach", reach).where(F.col("before").isNotNull() & (F.col("a") - F.col("reach") > gap))
    turn = F.row_number().over(Window.partitionBy(*KEY).orderBy("a", "b"))
    return gaps.select(*KEY, turn.alias("turn"), ((F.col("reach") + F.col("a")) / 2).alias("cut"))


def _sides(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each cut with the areas of what ends before it and of what begins after it; null where there is nothing.

    Cuts stand among the objects in order of their ends, and of their begins the other way round, so that running
    envelopes give both sides of all cuts of a cluster by one pass each.
    """
    box = ["x0", "y0", "x1", "y1"]
    marks = cuts.select(*KEY, "turn", "cut", F.col("cut").alias("at"), *[F.lit(None).cast("double").alias(c) for c in box])
    objects = lambda at: rows.select(*KEY, F.lit(None).cast("int").alias("turn"), F.lit(None).cast("double").alias("cut"), F.col(at).alias("at"), *box)

    def running(at: str, order: Column, name: str) -> DataFrame:
        over = Window.partitionBy(*KEY).orderBy(order, F.col("cut").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        area = (F.max("x1").over(over) - F.min("x0").over(over)) * (F.max("y1").over(over) - F.min("y0").over(over))
        return objects(at).unionByName(marks).withColumn(name, area).where("cut is not null").select(*KEY, "turn", "cut", name)

    before = running("high", F.col("at"), "before")
    return before.join(running("low", F.desc("at"), "after").drop("cut"), [*KEY, "turn"])


def chosen_cuts(objects: DataFrame, gap: float, least: float) -> DataFrame:
    """``(deck_id, page, cluster, across, cut)``: the cut of every cluster that has one: the first between left and right, else between upper and lower.

    A cut counts if both sides have objects whose envelope is ``least`` large.
    """
    rows = objects.join(divisible(objects), KEY)
    box = [F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")]
    found = None
    for across, low, size, total in ((True, "x", "w", "wide"), (False, "y", "h", "high")):
        own = rows.select(*KEY, F.col(low).alias("low"), (F.col(low) + F.col(size)).alias("high"), F.col(total).alias("total"), *box)
        fit = _sides(own, corridors(own, gap)).where((F.col("before") >= least) & (F.col("after") >= least)).select(*KEY, F.lit(across).alias("across"), "turn", "cut")
        found = fit if found is None else found.unionByName(fit)
    first = F.min_by(F.struct("across", "cut"), F.struct(~F.col("across"), F.col("turn")))
    return found.groupBy(*KEY).agg(first.alias("best")).select(*KEY, "best.across", "best.cut")


def corridor_cuts(objects: DataFrame, gap: float = GAP, least: float = CUT_SHARE * PAGE_W * PAGE_H) -> DataFrame:
    """``(deck_id, page, cluster, piece, z_index)``: the objects of every cluster by the pieces that corridors leave of it.

    ``objects(deck_id, page, cluster, z_index, kind, x, y, w, h)``. All clusters of all pages are cut at the same time, once
    a round, and their parts again until none has a cut; piece says on which sides of the cuts a part lies (0 left or
    upper, 1 right or lower), so pieces sort as cutting one after the other would list them. Grids and clusters with a
    connector stay whole. An object that lies across its cluster's cut is in no piece.

    What is cut no more leaves the rounds; what is left is stored in each, so a round's plan is no longer than the first's.
    """
    given = objects.select(*KEY, F.lit("").alias("piece"), "z_index", "kind", "x", "y", "w", "h")
    done = None
    left = stored(given)
    while True:
        # parts of a cluster are clusters of their own in the next round
        named = left.withColumn("whole", F.col("cluster")).withColumn("cluster", F.struct("cluster", "piece"))
        cuts = stored(chosen_cuts(named, gap, least))
        rows = named.join(cuts, KEY, "left")
        low, high = F.when(F.col("across"), F.col("x")).otherwise(F.col("y")), F.when(F.col("across"), F.col("x") + F.col("w")).otherwise(F.col("y") + F.col("h"))
        side = F.when(high <= F.col("cut"), "0").when(low >= F.col("cut"), "1")
        whole = rows.where("cut is null").select(*PAGE, F.col("whole").alias("cluster"), "piece", "z_index")
        done = whole if done is None else done.unionByName(whole)
        if cuts.isEmpty():
            return done
        parts = rows.where("cut is not null").withColumn("side", side).where("side is not null")
        left = stored(parts.select(*PAGE, F.col("whole").alias("cluster"), F.concat("piece", "side").alias("piece"), "z_index", "kind", "x", "y", "w", "h"))


def regions(objects: DataFrame, most_text: int = WALL_TEXT, gap: float = GAP, text_gap: float = TEXT_GAP) -> DataFrame:
    """``(deck_id, page, z_index, region)``: objects that grow together from one to the next; ``region`` numbers a page's from 1.

    Objects with more text are walls: growth reaches them and goes no further, and they are in no region. Regions are
    numbered by their lowest object.
    """
    inner = objects.where(F.length(F.trim("text")) <= most_text)
    found = page_components(inner, adjacency(inner, gap, text_gap))
    number = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("root"))
    return found.select(*PAGE, "z_index", number.cast("bigint").alias("region"))


def big_objects(objects: DataFrame, share: float = BIG_SHARE) -> DataFrame:
    """``objects`` with ``is_big``: pictures and embedded objects that take so much of the page stand for themselves."""
    big = F.col("kind").isin("raster", "vector", "visio") & (F.coalesce(F.col("w") * F.col("h"), F.lit(0.0)) >= share * PAGE_W * PAGE_H)
    return objects.withColumn("is_big", big)
