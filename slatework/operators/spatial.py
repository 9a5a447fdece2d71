"""Neighbours on a page: pairs of near boxes and nearest centres, by arrays on small pages and by grid cells on large ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored

PAGE = ["deck_id", "page"]
#: Pages of up to so many objects are compared in one array; the result does not depend on it.
SMALL_PAGE = 64
#: How often a page's square is halved at most to find cells of few objects.
DEEPEST = 12
#: Radius of the first of the rounds that look for a neighbour to one side.
FIRST_RADIUS = 25.0

Getter = Callable[[str], Column]


def by_size(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects of small pages and those of large ones."""
    sized = objects.withColumn("page_n", F.count("*").over(Window.partitionBy(*PAGE)))
    return sized.where(F.col("page_n") <= SMALL_PAGE).drop("page_n"), sized.where(F.col("page_n") > SMALL_PAGE).drop("page_n")


def in_arrays(objects: DataFrame, made: Callable[[Column, Column], Column], columns: list[str]) -> DataFrame:
    """What ``made(object, objects)``, an array of structs, gives for each object and all of its page."""
    held = objects.groupBy(*PAGE).agg(F.collect_list(F.struct(*columns)).alias("held"))
    return held.select(*PAGE, F.inline(F.flatten(F.transform("held", lambda o: made(o, F.col("held"))))))


def _edges_of_boxes(objects: DataFrame, reach: float) -> DataFrame:
    """Boxes grown by half the reach to each side, and the level whose cells are no smaller: a box meets at most four of them."""
    grow = (reach * (1 + 1e-9) + 1e-6) / 2
    far = lambda c, size: F.greatest(F.col(c), F.col(c) + F.col(size)) + grow
    near = lambda c, size: F.least(F.col(c), F.col(c) + F.col(size)) - grow
    rows = objects.withColumns({"x0": near("x", "w"), "x1": far("x", "w"), "y0": near("y", "h"), "y1": far("y", "h")})
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    rows = rows.where("x0 is not null and x1 is not null and y0 is not null and y1 is not null")
    return rows.withColumn("level", F.greatest(F.ceil(F.log2(side / F.lit(2 * grow))), F.lit(0)).cast("int"))


def _cell(value: Column, level: Column, base: float) -> Column:
    return F.floor(value / (F.lit(base) * F.pow(F.lit(2.0), level)))


def near_pairs(objects: DataFrame, keep: Callable[[Getter, Getter], Column], reach: float, columns: list[str]) -> DataFrame:
    """``(deck_id, page, a, b)``: pairs of a page's objects, a's z_index below b's, for which ``keep`` holds.

    ``keep`` must not hold for boxes further apart than ``reach`` on an axis. On a large page boxes lie in grids of cells
    of doubling sides, each box in the grid whose cells are just no smaller than it. Two boxes meet in the grid of the
    larger one, where either has four cells at most, and are compared in that cell alone which holds the upper left
    corner of what their grown boxes share. So what is compared grows with what is near, whatever sizes boxes have.
    Objects with a null coordinate or size have no pairs.
    """
    columns = list(dict.fromkeys(["z_index", "x", "y", "w", "h", *columns]))
    small, large = by_size(objects.select(*PAGE, *columns))

    def pairs(o: Column, held: Column) -> Column:
        near = F.filter(held, lambda p: (o["z_index"] < p["z_index"]) & keep(o.getField, p.getField))
        return F.transform(near, lambda p: F.struct(o["z_index"].alias("a"), p["z_index"].alias("b")))

    base = reach * (1 + 1e-9) + 1e-6
    boxes = _edges_of_boxes(large, reach).withColumn("top", F.max("level").over(Window.partitionBy(*PAGE)))

    def celled(rows: DataFrame, levels: Column, prefix: str) -> DataFrame:
        rows = rows.withColumn("at", F.explode(levels))
        across = lambda low, high: F.sequence(_cell(F.col(low), F.col("at"), base), _cell(F.col(high), F.col("at"), base))
        rows = rows.withColumn("cx", F.explode(across("x0", "x1"))).withColumn("cy", F.explode(across("y0", "y1")))
        return rows.select(*PAGE, "at", "cx", "cy", *[F.col(c).alias(f"{prefix}_{c}") for c in [*columns, "x0", "y0", "x1", "y1", "level"]])

    owners = celled(boxes, F.array("level"), "o")
    others = celled(boxes, F.sequence("level", "top"), "p")
    met = owners.join(others, [*PAGE, "at", "cx", "cy"])
    met = met.where((F.col("p_level") < F.col("o_level")) | (F.col("o_z_index") < F.col("p_z_index")))
    met = met.where((F.col("o_x0") <= F.col("p_x1")) & (F.col("p_x0") <= F.col("o_x1")) & (F.col("o_y0") <= F.col("p_y1")) & (F.col("p_y0") <= F.col("o_y1")))
    here = (F.col("cx") == _cell(F.greatest("o_x0", "p_x0"), F.col("at"), base)) & (F.col("cy") == _cell(F.greatest("o_y0", "p_y0"), F.col("at"), base))
    kept = keep(lambda c: F.col(f"o_{c}"), lambda c: F.col(f"p_{c}"))
    found = met.where(here & kept & (F.col("o_z_index") != F.col("p_z_index")))
    found = found.select(*PAGE, F.least("o_z_index", "p_z_index").alias("a"), F.greatest("o_z_index", "p_z_index").alias("b"))
    return in_arrays(small, pairs, columns).unionByName(found)


def _distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.pow(ax - bx, F.lit(2)) + F.pow(ay - by, F.lit(2))


def nearest(points: DataFrame, k: int) -> DataFrame:
    """``(deck_id, page, z_index, rank, node, d2)``: the k nearest nodes of every asking point of its page, nearest first.

    ``points(deck_id, page, z_index, cx, cy, asks, is_node)`` have different z_index on a page; a point is no node of its
    own; ties go to the lower z. On a large page the square of all points is halved again and again. A point takes the
    smallest cell around it that holds k nodes: their distances bound how far the k nearest can be, and only cells within
    that bound are searched. Points without coordinates take no part.
    """
    points = points.where("cx is not null and cy is not null")
    columns = ["z_index", "cx", "cy", "asks", "is_node"]
    small, large = by_size(points.select(*PAGE, *columns))

    def ranked(o: Column, held: Column) -> Column:
        others = F.filter(held, lambda p: p["is_node"] & (p["z_index"] != o["z_index"]))
        order = F.array_sort(F.transform(others, lambda p: F.struct(_distance(o["cx"], o["cy"], p["cx"], p["cy"]).alias("d2"), p["z_index"].alias("node"))))
        first = F.transform(F.slice(order, 1, k), lambda p, i: F.struct(o["z_index"].alias("z_index"), (i + 1).cast("bigint").alias("rank"), p["node"].alias("node"), p["d2"].alias("d2")))
        return F.when(o["asks"], first).otherwise(F.filter(first, lambda _: F.lit(False)))

    extent = large.groupBy(*PAGE).agg(F.min("cx").alias("left"), F.min("cy").alias("top"), F.max("cx").alias("right"), F.max("cy").alias("bottom"), F.count("*").alias("n"))
    side = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"), F.lit(1e-6)) * (1 + 1e-9)
    depth = F.least(F.lit(DEEPEST), F.ceil(F.log2("n") / 2) + 2).cast("int")
    placed = large.join(extent.select(*PAGE, "left", "top", side.alias("side"), depth.alias("depth")), PAGE)
    width = F.col("side") / F.pow(F.lit(2.0), F.col("at"))
    cells = [F.floor((F.col("cx") - F.col("left")) / width).alias("gx"), F.floor((F.col("cy") - F.col("top")) / width).alias("gy")]
    key = [*PAGE, "at", "gx", "gy"]
    every = placed.withColumn("at", F.explode(F.sequence(F.lit(0), "depth"))).select("*", *cells)
    nodes = every.where("is_node").select(*key, F.col("z_index").alias("node"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    asking = every.where("asks").select(*key, "z_index", "cx", "cy", "left", "top", "side", "is_node")
    counts = nodes.groupBy(*key).agg(F.count("*").alias("held"))
    enough = F.col("held") - F.col("is_node").cast("int") >= k  # a node does not count for itself
    deepest = asking.join(counts, key, "left").groupBy(*PAGE, "z_index").agg(F.coalesce(F.max(F.when(enough, F.col("at"))), F.lit(0)).alias("at"))
    asking = asking.join(deepest, [*PAGE, "z_index", "at"])
    d2 = _distance(F.col("cx"), F.col("cy"), F.col("nx"), F.col("ny"))
    own = asking.join(nodes, key).where("node <> z_index").withColumn("d2", d2)
    turn = F.row_number().over(Window.partitionBy(*PAGE, "z_index").orderBy("d2", "node"))
    bound = own.withColumn("turn", turn).where(F.col("turn") <= k).groupBy(*PAGE, "z_index").agg(F.max("d2").alias("bound"), F.count("*").alias("found"))
    bound = bound.where(F.col("found") == k).drop("found")  # a page of fewer nodes has them all in its one cell
    asking = asking.join(bound, [*PAGE, "z_index"], "left").withColumn("reach", F.sqrt("bound") * (1 + 1e-12) + 1e-9)
    across = lambda c, low: F.sequence(F.floor((F.col(c) - F.col("reach") - F.col(low)) / width), F.floor((F.col(c) + F.col("reach") - F.col(low)) / width))
    whole = F.array(F.lit(0).cast("bigint"))
    searched = asking.drop("gx", "gy").withColumn("gx", F.explode(F.coalesce(across("cx", "left"), whole))).withColumn("gy", F.explode(F.coalesce(across("cy", "top"), whole)))
    found = searched.join(nodes, key).where("node <> z_index").withColumn("d2", d2).where("bound is null or d2 <= bound")
    rank = F.row_number().over(Window.partitionBy(*PAGE, "z_index").orderBy("d2", "node")).cast("bigint")
    found = found.withColumn("rank", rank).where(F.col("rank") <= k).select(*PAGE, "z_index", "rank", "node", "d2")
    return in_arrays(small, ranked, columns).unionByName(found)


def nearest_ahead(points: DataFrame, back: float, near: float) -> DataFrame:
    """``(deck_id, page, a, b)``: from each point to the nearest one to its right or below, less than ``near`` away.

    ``points(deck_id, page, z_index, cx, cy)``. The other may lie back by less than ``back`` on each axis but not on both;
    ties go to the lower z. On large pages rounds of doubling radius look only for those points that have none yet.
    """
    points = points.where("cx is not null and cy is not null").select(*PAGE, "z_index", "cx", "cy")
    small, large = by_size(points)
    ahead = lambda dx, dy: (dx > -back) & (dy > -back) & ((dx > 0) | (dy > 0))

    def first(o: Column, held: Column) -> Column:
        way = lambda p: (p["cx"] - o["cx"], p["cy"] - o["cy"])
        others = F.filter(held, lambda p: (p["z_index"] != o["z_index"]) & ahead(*way(p)))
        best = F.array_min(F.transform(others, lambda p: F.struct((way(p)[0] * way(p)[0] + way(p)[1] * way(p)[1]).alias("d2"), p["z_index"].alias("b"))))
        return F.filter(F.array(F.struct(o["z_index"].alias("a"), best["b"].alias("b"), best["d2"].alias("d2"))), lambda e: e["d2"] < near * near)

    found = in_arrays(small, first, ["z_index", "cx", "cy"]).select(*PAGE, "a", "b")
    if large.isEmpty():
        return found
    large = todo = stored(large)
    radius = min(FIRST_RADIUS, near)
    while True:
        cell = lambda c: F.floor(c / radius)
        others = large.select(*PAGE, cell(F.col("cx")).alias("gx"), cell(F.col("cy")).alias("gy"), F.col("z_index").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
        across = lambda c: F.explode(F.sequence(cell(F.col(c) - back), cell(F.col(c) + radius)))
        asking = todo.withColumn("gx", across("cx")).withColumn("gy", across("cy"))
        dx, dy = F.col("bx") - F.col("cx"), F.col("by") - F.col("cy")
        met = asking.join(others, [*PAGE, "gx", "gy"]).where((F.col("b") != F.col("z_index")) & ahead(dx, dy)).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") < radius * radius)
        best = stored(met.groupBy(*PAGE, "z_index").agg(F.min(F.struct("d2", "b")).alias("best")))
        found = found.unionByName(best.select(*PAGE, F.col("z_index").alias("a"), F.col("best.b").alias("b")))
        if radius >= near:
            return found
        todo = stored(todo.join(best, [*PAGE, "z_index"], "left_anti"))
        radius = min(2 * radius, near)
