"""What a finished deck hands on: resources of blocks, the binding file, counts of files and of formulas, the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extension
from .documents import BLOCK
from .objects import PAGE

#: Forms of files that are a block's resources, the folder of pictures that groups refer to, the binding's schema.
RESOURCES, GROUP_PICTURES, SCHEMA = ("vsdx", "vsd", "svg", "wmf", "emf"), "rldimg", "pptx_visual_block_text_binding_v1.0"
#: Where a formula may come from.
FORMULA_SOURCES = ("native", "eq3", "ocr", "placeholder")


def member_resources(members: DataFrame, files: DataFrame) -> DataFrame:
    """``(deck_id, page, block_id, resources)``: the vector and diagram files of a block's members, each once, in their order.

    ``members(deck_id, page, block_id, ord, z_index)``, ``files(deck_id, page, z_index, file, form)``. Blocks without
    any have an empty array.
    """
    fit = files.where((F.col("file") != "") & F.lower("form").isin(*RESOURCES)).select(*PAGE, "z_index", "file")
    rows = members.select(*BLOCK, "ord", "z_index").join(fit, [*PAGE, "z_index"], "left")
    held = rows.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.when(F.col("file").isNotNull(), F.struct("ord", "z_index", "file")))).alias("held"))
    return held.select(*BLOCK, F.array_distinct(F.transform("held", lambda r: r["file"])).alias("resources"))


def resource_files(resources: DataFrame) -> DataFrame:
    """``(deck_id, page, block_id, file, name)``: what each resource is called beside the deck: its page, its block, its form.

    Of resources of one form a block keeps the last.
    """
    rows = resources.select(*BLOCK, F.posexplode("resources").alias("at", "file"))
    name = F.concat(F.format_string("slide_%02d_", F.col("page").cast("bigint")), "block_id", F.lit("."), extension(F.col("file")))
    last = Window.partitionBy("deck_id", "name").orderBy(F.desc("at"))
    return rows.withColumn("name", name).withColumn("n", F.row_number().over(last)).where("n = 1").select(*BLOCK, "file", "name")


def binding_files(pages: DataFrame, blocks: DataFrame, bound: DataFrame, sources: DataFrame) -> DataFrame:
    """``(deck_id, content)``: each deck's binding file, its counts and what ties blocks to texts, as JSON.

    ``pages(deck_id, page)``, ``blocks`` and ``bound`` by deck, page and block, ``sources(deck_id, name)``.
    """
    count = lambda rows, name: rows.groupBy("deck_id").agg(F.count("*").alias(name))
    own = [c for c in bound.columns if c not in ("deck_id", "page", "block_id")]
    entry = F.struct(F.col("page"), F.col("block_id").alias("target_block_id"), *own)
    listed = bound.groupBy("deck_id").agg(F.array_sort(F.collect_list(entry)).alias("bindings"))
    rows = count(pages.select("deck_id", "page").distinct(), "slides").join(count(blocks, "blocks_total"), "deck_id", "left").join(count(bound, "bindings_total"), "deck_id", "left")
    rows = rows.join(source_counts(sources), "deck_id", "left").join(listed, "deck_id", "left")
    whole = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    summary = F.struct("slides", *map(whole, ("blocks_total", "bindings_total", "sources_total", "xml_sources_total", "rldimg_total")))
    none = F.coalesce("bindings", F.filter(F.array(F.lit(None).cast(listed.schema["bindings"].dataType.elementType)), lambda _: F.lit(False)))
    text = F.to_json(F.struct(F.lit(SCHEMA).alias("$schema"), F.col("deck_id").cast("string").alias("stem"), summary.alias("summary"), none.alias("bindings")))
    return rows.select("deck_id", F.encode(text, "UTF-8").alias("content"))


def source_counts(files: DataFrame) -> DataFrame:
    """``(deck_id, sources_total, xml_sources_total, rldimg_total)`` of ``files(deck_id, name)``, names below a deck's sources folder.

    Counted are files of the folder itself and of the folder of group pictures, so after a move this is what is there.
    """
    inside, top = F.col("name").startswith(f"{GROUP_PICTURES}/"), ~F.col("name").contains("/")
    return files.groupBy("deck_id").agg(
        F.count_if(top | inside).alias("sources_total"), F.count_if(top & F.col("name").endswith(".xml")).alias("xml_sources_total"), F.count_if(inside).alias("rldimg_total")
    )


def formula_counts(formulas: DataFrame, expected: DataFrame) -> DataFrame:
    """``(deck, native, eq3, ocr, placeholder, total, filtered, expected, agrees)`` of ``formulas(deck, source, keep)``.

    ``expected(deck, natives, equations)`` is what the deck's XML and embedded equations say; it agrees if what is kept
    and what is filtered out make as many.
    """
    own = [F.count_if(F.col("keep") & (F.col("source") == s)).alias(s) for s in FORMULA_SOURCES]
    found = formulas.groupBy("deck").agg(*own, F.count_if("keep").alias("total"), F.count_if(~F.col("keep")).alias("filtered"))
    rows = expected.join(found, "deck", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    wanted = (zero("natives") + zero("equations")).cast("bigint")
    return rows.select("deck", *[zero(c).alias(c) for c in (*FORMULA_SOURCES, "total", "filtered")], wanted.alias("expected"), (zero("total") + zero("filtered") == wanted).alias("agrees"))


def report(textbook: DataFrame, captions: DataFrame, images: DataFrame) -> DataFrame:
    """``(deck, pages, captions, images)``: headings of pages and of captions in a deck's files, and pictures in its folder.

    ``textbook`` and ``captions`` are lines ``(deck, text)``, ``images(deck, file)``; what is missing counts 0.
    """
    pages = textbook.groupBy("deck").agg(F.count_if(F.col("text").startswith("## 第")).alias("pages"))
    said = captions.groupBy("deck").agg(F.count_if(F.col("text").startswith("### IMG")).alias("captions"))
    held = images.groupBy("deck").agg(F.count("*").alias("images"))
    rows = pages.join(said, "deck", "full").join(held, "deck", "full")
    return rows.select("deck", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pages", "captions", "images")])
