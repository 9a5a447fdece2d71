"""Geometry and blocks: noise filter, seeds, text absorption, envelopes, neighbours, grids, trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import PAGE, Getter, near_pairs, nearest, nearest_ahead

#: Sizes in pixels and shares of the page.
PAGE_W, PAGE_H = 960, 720
MIN_AREA, MIN_SIDE, MAX_RATIO = 1600, 48, 10
BANNER_SHARE, BANNER_HEIGHT, SEED_SHARE, MOST_BLOCKS = 0.9, 80, 0.20, 6
GAP, TEXT_GAP, NEAR = 40, 100, 400
#: The type of a block of one object, by its kind.
SINGLE_TYPES = {
    "raster": "raster_image", "vector": "vector_image", "visio": "visio_diagram", "group": "group_diagram",
    "chart": "chart", "formula": "formula_block", "table": "native_table",
}
WITH_FILE = ("raster", "vector", "visio")


def outcome() -> Column:
    """What the noise filter does with an object; the first rule that applies."""
    w, h, kind = F.col("w"), F.col("h"), F.col("kind")
    small = (w * h < MIN_AREA) | (F.least(w, h) < MIN_SIDE) | (F.greatest(w, h) > MAX_RATIO * F.least(w, h))
    return (
        F.when(kind == "formula", "drop formula")
        .when(F.trim("text") != "", "keep text")
        .when(kind.isin("raster", "vector") & (w >= BANNER_SHARE * PAGE_W) & (h > 0) & (h <= BANNER_HEIGHT), "drop banner")
        .when(kind.isin(*WITH_FILE), "keep file")
        .when(kind == "table", "keep table")
        .when(small, "drop small")
        .otherwise("keep rest")
    )


def centre() -> tuple[Column, Column]:
    return F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2


def visible(objects: DataFrame) -> DataFrame:
    """Objects that the noise filter keeps, that aren't text regions, and whose centre is on the page."""
    cx, cy = centre()
    kept = objects.where(outcome().startswith("keep") & (F.col("kind") != "text_region") & (F.col("w") > 0) & (F.col("h") > 0))
    return kept.where(cx.between(0, PAGE_W) & cy.between(0, PAGE_H))


def last_pages(objects: DataFrame) -> DataFrame:
    return objects.groupBy("deck_id").agg(F.max("page").alias("last"))


def is_cover() -> Column:
    """The first and the last page of a deck of two pages and more."""
    return (F.col("last") >= 2) & ((F.col("page") == 1) | (F.col("page") == F.col("last")))


def covers(objects: DataFrame) -> DataFrame:
    """Pages of each deck: ``is_cover`` for the first and the last of decks of two pages and more."""
    return objects.select(*PAGE).distinct().join(last_pages(objects), "deck_id").select(*PAGE, is_cover().alias("is_cover"))


def body(objects: DataFrame) -> DataFrame:
    """Visible objects on pages that aren't covers."""
    return visible(objects).join(last_pages(objects), "deck_id").where(~is_cover()).drop("last")


FIELDS = ("z_index", "kind", "x", "y", "w", "h", "text")


def page_arrays(objects: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """A row a page: the objects that start a block, the first ``most`` in z order, and the shapes with text.

    Seeds and what they absorb come from one grouping of the page's objects, so the objects are read once.
    """
    big = (F.col("kind") != "raster") | (F.col("w") * F.col("h") >= SEED_SHARE * PAGE_W * PAGE_H)
    fit = F.col("kind").isin("group", "visio") | (F.col("kind").isin("vector", "raster") & (F.col("preview_of") == "") & big)
    shape = (F.col("kind") == "shape") & (F.trim("text") != "")
    held = lambda which: F.array_sort(F.collect_list(F.when(which, F.struct(*FIELDS))))
    rows = body(objects).where(fit | shape).groupBy(*PAGE).agg(held(fit).alias("starts"), held(shape).alias("shapes"))
    return rows.select(*PAGE, F.slice("starts", 1, most).alias("starts"), "shapes")


def _block_id(place: Column) -> Column:
    return F.format_string("blk_%02d", place + 1)


def seeds(objects: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """Objects that start a block, numbered in z order; the first ``most`` of a page."""
    rows = page_arrays(objects, most).select(*PAGE, F.posexplode("starts").alias("place", "o"))
    return rows.select(*PAGE, *[F.col(f"o.{c}").alias(c) for c in FIELDS], _block_id(F.col("place")).alias("block_id"))


def members(objects: DataFrame) -> DataFrame:
    """Seeds and the shapes with text that they absorb: a raster takes those whose centre lies in it, edges included."""
    def inside(o, m):
        cx, cy = m["x"] + m["w"] / 2, m["y"] + m["h"] / 2
        return (o["kind"] == "raster") & cx.between(o["x"], o["x"] + o["w"]) & cy.between(o["y"], o["y"] + o["h"])

    row = lambda place, order, m: F.struct(_block_id(place).alias("block_id"), F.lit(order).alias("ord"), *[m[c].alias(c) for c in FIELDS])
    made = F.transform("starts", lambda o, i: F.concat(F.array(row(i, 0, o)), F.transform(F.filter("shapes", lambda m: inside(o, m)), lambda m: row(i, 1, m))))
    return page_arrays(objects).select(*PAGE, F.inline(F.flatten(made)))


def block_type() -> Column:
    """The type from the kinds of a block's members."""
    n, first = F.count("*"), F.min_by("kind", "ord")
    single = F.lit("raster_image")
    for kind, name in SINGLE_TYPES.items():
        single = F.when(first == kind, name).otherwise(single)
    shape = F.col("kind").isin("shape", "connector", "textbox")
    media = F.bool_or(F.col("kind").isin(*WITH_FILE))
    return (
        F.when(n == 1, single)
        .when(F.bool_or(F.col("kind") == "table"), "native_table")
        .when(F.bool_and(shape), "native_logic_diagram")
        .when(media & F.bool_or(shape), "decorated_diagram")
        .when(media, "raster_image")
        .otherwise("native_logic_diagram")
    )


def blocks(objects: DataFrame) -> DataFrame:
    """Blocks with envelope, z range, joined text, text density (characters a million square pixels) and type."""
    texts = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("ord", "z_index", "text"))))
    chars = F.sum(F.when(F.col("kind").isin("shape", "connector", "group"), F.length("text")).otherwise(0))
    rows = members(objects).groupBy(*PAGE, "block_id").agg(
        F.round(F.min("x"), 1).alias("x"), F.round(F.min("y"), 1).alias("y"),
        F.round(F.max(F.col("x") + F.col("w")) - F.min("x"), 1).alias("w"), F.round(F.max(F.col("y") + F.col("h")) - F.min("y"), 1).alias("h"),
        F.min("z_index").alias("z_min"), F.max("z_index").alias("z_max"), F.count("*").alias("n_members"),
        F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text"), chars.cast("bigint").alias("chars"), block_type().alias("block_type"),
    )
    return rows.withColumn("text_density", F.round(F.col("chars") / F.greatest(F.col("w") * F.col("h"), F.lit(1.0)) * 1e6, 3)).drop("chars")


def summary(objects: DataFrame) -> DataFrame:
    """Counts of a deck: its pages, blocks, pages with blocks, and blocks of more than one member."""
    pages = objects.select(*PAGE).distinct().groupBy("deck_id").agg(F.count("*").alias("slides"))
    made = blocks(objects)
    counts = made.groupBy("deck_id").agg(
        F.count("*").alias("blocks_total"), F.count_distinct("page").alias("slides_with_blocks"), F.count_if(F.col("n_members") > 1).alias("composed")
    )
    return pages.join(counts, "deck_id", "left").select("deck_id", "slides", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blocks_total", "slides_with_blocks", "composed")])


def grows_together(gap: float, text_gap: float) -> Callable[[Getter, Getter], Column]:
    """Whether two boxes are apart by the threshold one way and by ``gap`` the other at most; see ``adjacency``."""
    def near(a: Getter, b: Getter) -> Column:
        gap_x = F.greatest(a("x"), b("x")) - F.least(a("x") + a("w"), b("x") + b("w"))
        gap_y = F.greatest(a("y"), b("y")) - F.least(a("y") + a("h"), b("y") + b("h"))
        wide = F.when((F.trim(a("text")) != "") & (F.trim(b("text")) != ""), text_gap).otherwise(gap)
        return ((gap_x <= wide) & (gap_y <= gap)) | ((gap_y <= wide) & (gap_x <= gap))

    return near


def adjacency(objects: DataFrame, gap: float = GAP, text_gap: float = TEXT_GAP) -> DataFrame:
    """Pairs of a page's objects that grow together: apart by the threshold one way and by ``gap`` the other at most.

    The threshold is ``text_gap`` if both have text, else ``gap``.
    """
    return near_pairs(objects, grows_together(gap, text_gap), max(gap, text_gap), ["text"])


def overlapping(objects: DataFrame, gap: float = GAP) -> DataFrame:
    """Pairs of a page's objects that overlap on both axes, or on one with a gap of at most ``gap`` on the other."""
    def near(a: Getter, b: Getter) -> Column:
        apart = lambda c, size: F.greatest(F.lit(0.0), F.abs((a(c) + a(size) / 2) - (b(c) + b(size) / 2)) - (a(size) + b(size)) / 2)
        gap_x, gap_y = apart("x", "w"), apart("y", "h")
        return ((gap_x == 0) & (gap_y <= gap)) | ((gap_y == 0) & (gap_x <= gap))

    return near_pairs(objects, near, gap, [])


def clusters(objects: DataFrame, gap: float = GAP) -> DataFrame:
    """``(deck_id, page, z_index, root)``: objects that overlaps and small gaps connect share the smallest number."""
    return page_components(objects, overlapping(objects, gap))


def roots_of(nodes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest node that edges connect each of the distinct ``nodes`` to; edges name nodes by number.

    Every round both ends of an edge take the smaller label and labels jump to their own labels.
    """
    order = np.argsort(nodes, kind="stable")
    one, two = (np.searchsorted(nodes, ends, sorter=order) for ends in (one, two))
    label = np.arange(len(nodes))
    while (label[one] != label[two]).any():
        a, b = label[one], label[two]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    found = np.empty_like(nodes)
    found[order] = nodes[order][label]
    return found


def page_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(deck_id, page, z_index, root)``: connected objects of a page share the smallest number.

    Objects and edges come sorted by page, as a stream of arrays of which the task holds one page at a time. Ends of
    edges are objects of the page, each of which stands there once.
    """

    def page(rows: np.ndarray) -> np.ndarray:
        own, linked = rows[rows[:, 4] == 0], rows[rows[:, 4] == 1]
        return np.column_stack([own[:, :3], roots_of(own[:, 2], linked[:, 2], linked[:, 3])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def batch(found: list[np.ndarray]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c) for c in np.ascontiguousarray(np.concatenate(found).T)], names=[*PAGE, "z_index", "root"])

        for frame in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in frame.columns])
            if not len(rows):
                continue
            if held and (rows[0, :2] != held[-1][-1, :2]).any():
                yield batch([page(np.concatenate(held))])
                held = []
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            pieces = np.split(rows, cuts)
            if len(pieces) > 1:
                yield batch([page(np.concatenate([*held, pieces[0]])), *map(page, pieces[1:-1])])
                held = []
            held.append(pieces[-1])
        if held:
            yield batch([page(np.concatenate(held))])

    number = lambda n: F.lit(n).cast("bigint")
    own = nodes.select(*PAGE, F.col("z_index").alias("a"), number(0).alias("b"), number(0).alias("linked"))
    rows = own.unionByName(edges.select(*PAGE, "a", "b", number(1).alias("linked"))).repartition(*PAGE).sortWithinPartitions(*PAGE)
    return rows.mapInArrow(run, "deck_id bigint, page bigint, z_index bigint, root bigint")


def nearest_two(objects: DataFrame) -> DataFrame:
    """Each connector's two nearest other objects of its page by the distance of centres; ties to the lower z."""
    cx, cy = centre()
    line = F.col("kind") == "connector"
    return nearest(objects.select(*PAGE, "z_index", cx.alias("cx"), cy.alias("cy"), line.alias("asks"), (~line).alias("is_node")), 2)


def neighbour_edges(objects: DataFrame, near: float = NEAR) -> DataFrame:
    """From each object to the nearest one to its right or below it, nearer than ``near``; ties to the lower z."""
    cx, cy = centre()
    return nearest_ahead(objects.select(*PAGE, "z_index", cx.alias("cx"), cy.alias("cy")), 10, near)


def tree_pages(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages with the number of objects and edges, and whether the edges make one tree of them all."""
    parts = page_components(objects, edges).groupBy(*PAGE).agg(F.count("*").alias("nodes"), F.count_distinct("root").alias("parts"))
    lines = edges.groupBy(*PAGE).agg(F.count("*").alias("edges"))
    rows = parts.join(lines, PAGE, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return rows.select(*PAGE, "nodes", "edges", ((F.col("edges") == F.col("nodes") - 1) & (F.col("parts") == 1)).alias("is_tree"))


def bands(objects: DataFrame, value: Column, tolerance: float, name: str) -> DataFrame:
    """How many groups a page's values make, a new one after each gap over ``tolerance``."""
    order = Window.partitionBy(*PAGE).orderBy("v")
    rows = objects.select(*PAGE, value.alias("v")).withColumn("gap", F.col("v") - F.lag("v").over(order))
    return rows.groupBy(*PAGE).agg((1 + F.count_if(F.col("gap") > tolerance)).alias(name), F.count("*").alias("n"))


def band_means(objects: DataFrame, value: Column, tolerance: float) -> DataFrame:
    """``(deck_id, page, band, mean, n)``: the groups that a page's values make, from 1 in ascending order, with their means.

    A new group begins after each gap over ``tolerance``.
    """
    order = Window.partitionBy(*PAGE).orderBy("v")
    rows = objects.select(*PAGE, value.alias("v")).where("v is not null").withColumn("gap", F.col("v") - F.lag("v").over(order))
    band = 1 + F.sum(F.when(F.col("gap") > tolerance, 1).otherwise(0)).over(order)
    return rows.withColumn("band", band).groupBy(*PAGE, "band").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def grids(objects: DataFrame) -> DataFrame:
    """Pages of four objects and more whose centres stand in columns and rows, three fifths of the places taken."""
    cx, cy = centre()
    cols = bands(objects, F.bround(cx, 0), 60, "cols")
    rows = bands(objects, F.bround(cy, 0), 50, "rows").drop("n")
    fit = (F.col("cols") >= 2) & (F.col("rows") >= 2) & (F.col("n") >= 0.6 * F.col("cols") * F.col("rows"))
    return cols.join(rows, PAGE).where("n >= 4").select(*PAGE, "n", "cols", "rows", fit.alias("is_grid"))


def gap_cuts(objects: DataFrame, gap: float = GAP) -> DataFrame:
    """Where a page can be cut: the middle of each horizontal gap over ``gap`` that no object reaches into."""
    ends = objects.select(*PAGE, F.greatest("x", F.lit(0.0)).alias("a"), F.least(F.col("x") + F.col("w"), F.lit(float(PAGE_W))).alias("b"), "z_index")
    before = F.max("b").over(Window.partitionBy(*PAGE).orderBy("a", "b", "z_index").rowsBetween(Window.unboundedPreceding, -1))
    rows = ends.withColumn("reach", before).where(F.col("a") - F.col("reach") > gap)
    return rows.select(*PAGE, ((F.col("reach") + F.col("a")) / 2).alias("cut"))


def image_filter(objects: DataFrame) -> DataFrame:
    """Images ``(w, h, ink, colours)`` with the rule that drops each, or keep: fragments first, then size, shape, colours."""
    w, h, area = F.col("w"), F.col("h"), F.col("w") * F.col("h")
    verdict = (
        F.when((F.col("kind") == "vector") & (area < 10_000), "drop vector fragment")
        .when((F.col("kind") == "raster") & (area < 40_000) & (F.col("ink") < 0.20), "drop fragment")
        .when(F.least(w, h) < 48, "drop small")
        .when(F.greatest(w, h) / F.least(w, h) > 10, "drop thin")
        .when((F.col("kind") == "raster") & (F.col("colours") <= 4), "drop plain")
        .otherwise("keep")
    )
    return objects.where(F.col("kind").isin("raster", "vector")).withColumn("verdict", verdict)
