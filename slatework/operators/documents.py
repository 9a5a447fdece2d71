"""Block documents: topology, rule captions, bindings, page documents, and deletes that reach all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markdown import CAPTION, PAGE as PAGE_HEADING
from .objects import NEAR, PAGE, page_components

BLOCK = [*PAGE, "block_id"]
#: What is said of a block where no model speaks.
GOAL, GOAL_OF = "展示本页的可视化内容", ("展示本页与「", "」相关的可视化内容")
CAPTION_OF = ("本块包含 ", " 个对象", "：", "。")


def topology(members: DataFrame, near: float = NEAR) -> DataFrame:
    """``(deck_id, page, block_id, nodes, edges, topology_type)`` of the blocks of ``members``.

    Nodes are members but connectors and formulas. Each is tied to the nearest one to its right or below it, nearer
    than ``near``, the first in order of equals. A table makes a grid, edges that join all nodes without a cycle a
    tree, other edges a graph, none isolated nodes.
    """
    nodes = members.where("kind not in ('connector', 'formula')").select(*BLOCK, "ord", "z_index", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    other = nodes.select(*BLOCK, *[F.col(c).alias(f"b_{c}") for c in ("ord", "z_index", "cx", "cy")])
    dx, dy = F.col("b_cx") - F.col("cx"), F.col("b_cy") - F.col("cy")
    pairs = nodes.join(other, BLOCK).where("z_index <> b_z_index").withColumn("dx", dx).withColumn("dy", dy).where("dx > -10 and dy > -10 and (dx > 0 or dy > 0)")
    best = pairs.groupBy(*BLOCK, "z_index").agg(F.min(F.struct((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d2"), "b_ord", "b_z_index")).alias("best"))
    edges = best.where(F.col("best.d2") < near * near).select(*BLOCK, F.col("z_index").alias("a"), F.col("best.b_z_index").alias("b"))
    # a block is a page of its own to the components
    number = (F.col("page") * 100 + F.regexp_extract("block_id", r"(\d+)$", 1).cast("bigint")).alias("page")
    parts = page_components(nodes.select("deck_id", number, "z_index"), edges.select("deck_id", number, "a", "b")).groupBy(*PAGE).agg(F.count("*").alias("nodes"), F.count_distinct("root").alias("parts"))
    lines = edges.groupBy("deck_id", number).agg(F.count("*").alias("edges"))
    tables = members.groupBy(*BLOCK).agg(F.bool_or(F.col("kind") == "table").alias("table"))
    rows = tables.withColumn("own", number).join(parts.withColumnRenamed("page", "own"), ["deck_id", "own"], "left").join(lines.withColumnRenamed("page", "own"), ["deck_id", "own"], "left")
    n, e = F.coalesce("nodes", F.lit(0)), F.coalesce("edges", F.lit(0))
    kind = F.when(F.col("table"), "grid_matrix").when((e > 0) & (e == n - 1) & (F.col("parts") == 1), "tree").when(e > 0, "directed_graph").otherwise("isolated_nodes")
    return rows.select(*BLOCK, n.alias("nodes"), e.alias("edges"), kind.alias("topology_type"))


def rule_captions(members: DataFrame) -> DataFrame:
    """``(deck_id, page, block_id, expression_goal, vlm_caption)``: what the texts of a block's first three members say of it."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("ord", "z_index", "text"))), 1, 3)
    rows = members.groupBy(*BLOCK).agg(first.alias("first"), F.count("*").alias("n"))
    said = F.left(F.array_join(F.filter(F.transform("first", lambda m: m["text"]), lambda t: t != ""), "；"), F.lit(80))
    rows = rows.withColumn("brief", said)
    goal = F.when(F.col("brief") == "", GOAL).otherwise(F.concat(F.lit(GOAL_OF[0]), "brief", F.lit(GOAL_OF[1])))
    tail = F.when(F.col("brief") == "", "").otherwise(F.concat(F.lit(CAPTION_OF[2]), "brief"))
    return rows.select(*BLOCK, goal.alias("expression_goal"), F.concat(F.lit(CAPTION_OF[0]), F.col("n").cast("string"), F.lit(CAPTION_OF[1]), tail, F.lit(CAPTION_OF[3])).alias("vlm_caption"))


def bindings(blocks: DataFrame, relations: DataFrame) -> DataFrame:
    """A row for every relation of a block that is there, with the block's type."""
    return relations.join(blocks.select(*BLOCK, "block_type"), BLOCK)


def histogram(blocks: DataFrame) -> DataFrame:
    """How many blocks of each type a deck has."""
    return blocks.groupBy("deck_id", "block_type").agg(F.count("*").alias("blocks"))


def page_documents(pages: DataFrame, blocks: DataFrame, relations: DataFrame, titles: DataFrame) -> DataFrame:
    """One document a page, those without blocks too: its id, title, reading order, blocks and relations as arrays of structs."""
    held = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("block_id", "block_type", "x", "y", "w", "h", "text"))).alias("visual_blocks"))
    tied = relations.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("relation_id", "block_id", "text_anchor", "relation_type"))).alias("relations"))
    rows = pages.join(titles, PAGE, "left").join(held, PAGE, "left").join(tied, PAGE, "left")
    order = F.concat(F.array(F.format_string("title_shape_%d", "page"), F.format_string("text_body_%d", "page")), F.coalesce(F.transform("visual_blocks", lambda b: b["block_id"]), F.array().cast("array<string>")))
    none = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), rows.schema[c].dataType))
    return rows.select(*PAGE, F.format_string("slide_%03d", "page").alias("slide_id"), F.coalesce("title", F.lit("")).alias("title"), order.alias("reading_order"), none("visual_blocks").alias("visual_blocks"), none("relations").alias("relations"))


def delete_plan(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets ``(deck_id, page, block_id)``, each once, with ``found``: whether such a block is there."""
    return targets.select(*BLOCK).distinct().join(blocks.select(*BLOCK, F.lit(True).alias("there")), BLOCK, "left").select(*BLOCK, F.col("there").isNotNull().alias("found"))


def delete_blocks(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Blocks, relations or bindings without those of the targets."""
    return rows.join(targets.select(*BLOCK).distinct(), BLOCK, "left_anti")


def renumber(relations: DataFrame) -> DataFrame:
    """Relations with new ids, numbered on their page (relation_id) and through their deck (binding_id)."""
    order = ["page", "relation_id", "block_id"]
    counts = relations.groupBy(*PAGE).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("deck_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order))
    rows = relations.withColumn("own", own).join(counts.select(*PAGE, before.alias("before")), PAGE)
    named = lambda n: F.format_string("rel_%02d_%02d", F.col("page"), n)
    return rows.withColumn("relation_id", named(F.col("own"))).withColumn("binding_id", named(F.col("own") + F.col("before"))).drop("own", "before")


def delete_captions(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Markdown ``lines(deck, seq, text)`` without the captions of ``files(deck, file)``.

    A caption goes from its heading up to the next one or to the heading of a page, which stays.
    """
    file = F.when(F.col("text").rlike(CAPTION), F.regexp_extract("text", CAPTION, 2)).when(F.trim("text").rlike(PAGE_HEADING), "")
    upto = Window.partitionBy("deck").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("file", F.coalesce(F.last(file, ignorenulls=True).over(upto), F.lit("")))
    return rows.join(files.select("deck", "file").distinct(), ["deck", "file"], "left_anti").select("deck", "seq", "text")


def deck_summary(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(deck_id, slides, blocks_total, slides_with_blocks)``, counted from the rows there are."""
    made = blocks.groupBy(*PAGE).agg(F.count("*").alias("n")).groupBy("deck_id").agg(F.sum("n").alias("blocks_total"), F.count("*").alias("slides_with_blocks"))
    rows = pages.select(*PAGE).distinct().groupBy("deck_id").agg(F.count("*").alias("slides")).join(made, "deck_id", "left")
    return rows.select("deck_id", "slides", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blocks_total", "slides_with_blocks")])


def verify(targets: DataFrame, **tables: DataFrame) -> DataFrame:
    """``(place, residue)``: how many rows of the targets each table still has; all zero after a whole delete."""
    left = lambda name, rows: rows.join(targets.select(*BLOCK).distinct(), BLOCK, "left_semi").agg(F.lit(name).alias("place"), F.count("*").alias("residue"))
    return reduce(DataFrame.unionByName, [left(n, t) for n, t in tables.items()])


def source_blocks(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """``files(deck_id, name)`` with the block that their name says, with or without more after it; others are left out."""
    found = lambda group: F.regexp_extract("name", r"^slide_(\d+)_(blk_\d+)(?:_|\.|$)", group)
    rows = files.where(found(2) != "").select("deck_id", "name", found(1).cast("bigint").alias("page"), found(2).alias("block_id"), _channel().alias("channel"))
    return rows.join(blocks.select(*BLOCK, "block_type"), BLOCK)


def _channel() -> Column:
    """What reads a source: markup is read as text, pictures by a model of images, others by no one."""
    end = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return F.when(end == "xml", "xml").when(end.isin("png", "jpg", "jpeg"), "image").otherwise("")
