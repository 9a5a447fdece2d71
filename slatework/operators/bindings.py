"""Bindings of texts, formulas, images and captions to pages, and what deleting blocks does to numbers and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn

#: LaTeX commands and characters that a formula worth keeping has one of.
COMMANDS = (
    "neq", "ne", "approx", "approxeq", "equiv", "cong", "leq", "geq", "le", "ge", "pm", "mp", "times", "div", "cdot", "ast", "star",
    "sum", "prod", "int", "iint", "iiint", "oint", "frac", "dfrac", "tfrac", "sqrt", "partial", "nabla", "infty", "lim",
    "rightarrow", "leftarrow", "leftrightarrow", "Rightarrow", "Leftarrow", "Leftrightarrow", "mapsto", "wedge", "vee", "neg", "land", "lor",
    "in", "notin", "subset", "subseteq", "supset", "supseteq", "cup", "cap", "setminus", "propto", "sim", "simeq", "asymp", "doteq",
    "angle", "perp", "parallel", "therefore", "because", "forall", "exists", "lt", "gt", "preceq", "succeq", "big", "Big",
    r"left\(", r"right\)", "begin", "end",
)
SYMBOLS = "=<>±×÷∧∨¬∈⊂⊆∪∩≈≠≤≥≡∼∝→←↔⇒∀∃∑∫∏√∂∇∞"


def formula_pattern() -> str:
    return rf"\\(?:{'|'.join(COMMANDS)})|[{SYMBOLS}]"


def is_formula(latex: Column) -> Column:
    """Whether to keep an entry: one without LaTeX is a placeholder and stays, another needs a mathematical symbol."""
    bare = F.trim(F.coalesce(latex, F.lit("")))
    return (bare == "") | bare.rlike(formula_pattern())


def delete_objects(objects: DataFrame, targets: DataFrame) -> DataFrame:
    """What is left without ``targets(deck_id, page, z_index)``, numbered anew on the page and through the deck.

    A page's rows are numbered on the page; only the pages' counts are summed through the deck.
    """
    left = objects.join(targets, ["deck_id", "page", "z_index"], "left_anti")
    counts = left.groupBy("deck_id", "page").agg(F.count("*").alias("n"))
    through = Window.partitionBy("deck_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("deck_id", "page", F.coalesce(F.sum("n").over(through), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("deck_id", "page").orderBy("z_index")).cast("bigint")
    rows = left.withColumn("number", own).join(starts, ["deck_id", "page"])
    return rows.select("deck_id", "page", "z_index", "number", (F.col("start") + F.col("number")).alias("deck_number"))


def delete_summary(objects: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of each deck that go and stay; targets that no object matches are counted as missing."""
    keys = ["deck_id", "page", "z_index"]
    both = objects.select(*keys, F.lit(1).alias("o")).join(targets.select(*keys, F.lit(1).alias("t")).distinct(), keys, "full")
    has, wanted = F.col("o").isNotNull(), F.col("t").isNotNull()
    return both.groupBy("deck_id").agg(F.count_if(has & wanted).alias("deleted"), F.count_if(has & ~wanted).alias("kept"), F.count_if(wanted & ~has).alias("missing"))


def bind_pages(texts: DataFrame, images: DataFrame, captions: DataFrame) -> DataFrame:
    """``texts(page, text)`` and ``images(page, file)`` on one row a page, whichever has it, with captioned files counted.

    Captions ``(file, text)`` meet their images before the images are counted a page, so a page never holds them all.
    """
    known = images.join(captions.select("file", F.lit(1).alias("known")).distinct(), "file", "left")
    counted = known.groupBy("page").agg(F.count("*").alias("images"), F.count("known").alias("captioned"))
    rows = texts.join(counted, "page", "full")
    none = F.lit(0).cast("bigint")
    return rows.select("page", F.col("text").isNotNull().alias("has_text"), F.coalesce("images", none).alias("images"), F.coalesce("captioned", none).alias("captioned"))


def binding_summary(bound: DataFrame) -> DataFrame:
    return bound.agg(F.count("*").alias("pages"), F.count_if("has_text").alias("pages_with_text"), F.count_if(F.col("images") > 0).alias("pages_with_image"), F.coalesce(F.sum("images"), F.lit(0)).alias("images"))


#: The kind of every relation that a rule makes, and its link.
RULE_KIND, RULE_LINK = "elaboration", "本块与该页文字共同服务于页面主题（规则回退）"


def rule_relations(objects: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block tied to the first line of its page that isn't blank, cut to 60 characters and numbered on the page.

    The lines of a page are those of its objects' texts in z order; on a page without text the anchor is empty.
    """
    line = F.left(F.trim(F.element_at(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1)), F.lit(60))
    anchors = objects.where(F.trim("text") != "").groupBy("deck_id", "page").agg(F.min_by(line, "z_index").alias("text_anchor"))
    n = F.row_number().over(Window.partitionBy("deck_id", "page").orderBy("z_index"))
    rows = blocks.withColumn("n", n).drop("text").join(anchors, ["deck_id", "page"], "left")
    return rows.select(
        "deck_id", "page", "block_id", F.format_string("rel_%02d_%02d", F.col("page"), F.col("n")).alias("relation_id"), F.coalesce("text_anchor", F.lit("")).alias("text_anchor"),
        F.lit(RULE_KIND).alias("relation_type"), F.lit(RULE_LINK).alias("semantic_link"),
    )


def bind_images(images: DataFrame, captions: DataFrame, entries: DataFrame, manifest: DataFrame, links: DataFrame) -> DataFrame:
    """``images(deck_id, page, file)`` with all that is known of each: caption, number, paragraph, size, place, relation.

    ``captions(deck_id, file, img_id, text)`` and ``links(deck_id, file, relation, role)`` go by file,
    ``manifest(deck_id, page, file, source, form, width, height, shape_w, shape_h, x, y)`` by page and file,
    ``entries(deck_id, page, ord, type, text_id, text)`` give a page's paragraph: the first of contents of four
    characters and more, else the first. A picture without a caption's number has its place among the deck's, or, where
    a caption has that one, a number beyond all of them. What a model should say and does not is said by rule.
    """
    full = (F.col("type") == "内容") & (F.length("text") >= 4)
    place = F.row_number().over(Window.partitionBy("deck_id", "page").orderBy("ord"))
    fit = F.min(F.when(full, F.struct("place", "text_id")))
    chosen = entries.withColumn("place", place).groupBy("deck_id", "page").agg(F.coalesce(fit, F.min(F.struct("place", "text_id"))).alias("e"))
    chosen = chosen.select("deck_id", "page", F.col("e.place").alias("paragraph"), "e.text_id")
    rows = images.join(captions.select("deck_id", "file", F.col("img_id").alias("given"), F.col("text").alias("caption")), ["deck_id", "file"], "left")
    rows = rows.join(manifest, ["deck_id", "page", "file"], "left").join(chosen, ["deck_id", "page"], "left").join(links, ["deck_id", "file"], "left")
    rows = rows.withColumn("given", F.nullif("given", F.lit(""))).withColumn("n", F.row_number().over(Window.partitionBy("deck_id").orderBy("page", "file")))
    rows = rows.withColumn("own", F.coalesce("given", F.format_string("IMG%04d", "n")))
    rows = rows.withColumn("clash", F.col("given").isNull() & (F.count("given").over(Window.partitionBy("deck_id", "own")) > 0))
    number = F.coalesce(F.regexp_extract("given", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    beyond = F.max(F.greatest("n", number)).over(Window.partitionBy("deck_id"))
    late = F.row_number().over(Window.partitionBy("deck_id", "clash").orderBy("page", "file"))
    image_id = F.when(F.col("clash"), F.format_string("IMG%04d", beyond + late)).otherwise(F.col("own"))
    caption, paragraph = F.coalesce("caption", F.lit("")), F.coalesce("paragraph", F.lit(0))
    some = lambda a, b: F.coalesce(F.nullif(a, F.lit(0)), b, F.lit(0))
    return rows.select(
        "deck_id", "page", "file", caption.alias("caption"), F.coalesce("source", F.lit("")).alias("source"), fn.file_kind(F.col("form")).alias("kind"), image_id.alias("image_id"),
        paragraph.alias("paragraph"), F.coalesce("text_id", F.lit("")).alias("text_id"), some("width", F.col("shape_w")).alias("w"), some("height", F.col("shape_h")).alias("h"),
        F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"), fn.position(F.col("page"), paragraph, F.col("role")).alias("position"),
        F.coalesce(F.nullif("relation", F.lit("")), fn.caption_start(caption)).alias("relation"),
    )


def bound_pages(texts: DataFrame, bound: DataFrame) -> DataFrame:
    """``texts(deck_id, page, title, text)`` and images of ``bind_images`` on one row a page, whichever has it."""
    listed = bound.groupBy("deck_id", "page").agg(F.count("*").alias("images"), F.count_if(F.col("relation") != "").alias("relations"), F.count_if(F.col("position") != "").alias("positions"))
    rows = texts.join(listed, ["deck_id", "page"], "full")
    none = F.lit(0).cast("bigint")
    counts = [F.coalesce(c, none).alias(c) for c in ("images", "relations", "positions")]
    return rows.select("deck_id", "page", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), *counts, F.col("images").isNotNull().alias("has_image"))


def image_summary(pages: DataFrame) -> DataFrame:
    """Counts of each deck over ``bound_pages``."""
    return pages.groupBy("deck_id").agg(F.count("*").alias("pages"), F.sum("images").alias("images_total"), F.count_if("has_image").alias("pages_with_image"), F.sum("relations").alias("relations"), F.sum("positions").alias("positions"))
