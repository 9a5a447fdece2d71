"""What a model is shown of a deck's pages, and which pages, blocks and pictures of earlier runs are looked at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import page_list
from .documents import BLOCK

#: The heads of a page's parts.
TEXTS, FORMULAS, CAPTIONS = "【文本】", "【公式】", "【图片解读】"


def page_prompts(pages: DataFrame) -> DataFrame:
    """``(deck, page, prompt)`` of ``pages(deck, page, texts, formulas, captions)``, arrays of strings: what a page holds by its parts.

    Parts without entries, null ones too, are left out.
    """
    def part(head: str, column: str, item) -> Column:
        lines = F.array_join(F.transform(column, item), "\n")
        return F.when(F.size(F.coalesce(F.col(column), F.array())) > 0, F.concat(F.lit(f"\n{head}\n"), lines, F.lit("\n"))).otherwise("")

    plain = lambda x: F.concat(F.lit("- "), x)
    whole = F.concat(F.lit("## 第 "), F.col("page").cast("string"), F.lit(" 页"), part(TEXTS, "texts", plain), part(FORMULAS, "formulas", lambda x: F.concat(F.lit("- $$ "), x, F.lit(" $$"))), part(CAPTIONS, "captions", plain))
    return pages.select("deck", "page", whole.alias("prompt"))


def batch_prompts(prompts: DataFrame, batches: DataFrame, subject: Column, context: Column | None = None) -> DataFrame:
    """``(deck, batch, prompt)``: the subject, what is said of the batch if anything, and its pages in order."""
    held = F.array_sort(F.collect_list(F.struct("page", "prompt")))
    rows = prompts.join(batches.select("deck", "page", "batch"), ["deck", "page"]).groupBy("deck", "batch").agg(held.alias("held"))
    said = F.lit("") if context is None else F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"))).otherwise("")
    head = F.concat(F.lit("学科："), subject, F.lit("\n\n"), said)
    return rows.select("deck", "batch", F.concat(head, F.array_join(F.transform("held", lambda r: r["prompt"]), "\n")).alias("prompt"))


def first_pages(pages: DataFrame, most: int, chars: int = 6000) -> DataFrame:
    """``(deck, snippet)``: the first ``most`` pages of ``pages(deck, page, text)`` under their headings, cut to ``chars`` characters."""
    turn = F.row_number().over(Window.partitionBy("deck").orderBy("page"))
    rows = pages.withColumn("turn", turn).where(F.col("turn") <= most)
    part = F.concat(F.lit("## 第 "), F.col("page").cast("string"), F.lit(" 页\n"), F.coalesce("text", F.lit("")))
    held = F.array_sort(F.collect_list(F.struct("page", part.alias("part"))))
    return rows.groupBy("deck").agg(F.left(F.array_join(F.transform(held, lambda r: r["part"]), "\n"), F.lit(chars)).alias("snippet"))


def on_pages(rows: DataFrame, ranges: str | None) -> DataFrame:
    """The rows of the pages that a list such as 1-5,8 names; all without one."""
    return rows if not ranges else rows.where(F.array_contains(page_list(F.lit(ranges)), F.col("page").cast("int")))


def not_interpreted(blocks: DataFrame, interpreted: DataFrame) -> DataFrame:
    """Blocks that no earlier run has a caption of."""
    return blocks.join(interpreted.where(F.trim("caption") != "").select(*BLOCK), BLOCK, "left_anti")


def rendered_image(page: Column, block_id: Column, w: Column, h: Column) -> Column:
    """Where a block's picture is; null for a block without extent."""
    return F.when((w > 0) & (h > 0), F.concat(F.format_string("./images/slide_%02d_", page.cast("bigint")), block_id, F.lit(".png")))


def unreferenced(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pictures of blocks among ``files(deck_id, file)`` that no block has: what a run with other numbers has left."""
    own = blocks.select("deck_id", F.concat(F.format_string("slide_%02d_", F.col("page").cast("bigint")), "block_id", F.lit(".png")).alias("file"))
    return files.where(F.col("file").rlike(r"^slide_.*_blk_.*\.png$")).join(own, ["deck_id", "file"], "left_anti")
