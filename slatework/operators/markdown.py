"""Readers of the Markdown files that decks are written to: pages, text rows, formulas, captions, titles, HTML blocks.

All take ``lines(deck, seq, text)``, the lines of a file in order. A file's lines run through one window; files are
read side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import SYMBOLS_ONLY, inline_html, page_of, strip

#: The headings of pages and captions, and the rows of texts.
PAGE = r"^##\s*第\s*(\d+)\s*(?:页|节)\s*$"
CAPTION = r"^###\s+(IMG\d+)\s*—\s*`?([^`\s]+\.\w+)\s*`?"
TEXT_ROW = r"^\|\s*(TXT[\d\-]+)\s*\|\s*([^|]+?)\s*\|\s*(.*?)\s*\|$"
TITLE = "标题"
#: Numbers of a page's formulas, the head of a new file, and what stands under a formula from a picture.
NUMBERED = r"\(p(\d+)-(?:f|img)\d+\)"
NEW_FILE = ("# 图片公式补充（PowerPoint 渲染 + 视觉识别）", "")
FROM_PICTURE = "  > 来源：图片公式（PowerPoint 渲染+视觉识别）"


def _upto(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _joined(order: str, value: Column, sep: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)


def pages(lines: DataFrame) -> DataFrame:
    """``(deck, page, visit, seq, text)``: lines under the last page heading before them; visit is that heading's line.

    Lines before the first heading are dropped, headings too. A page that has several headings has several visits.
    """
    number = F.nullif(F.regexp_extract(F.trim("text"), PAGE, 1), F.lit("")).try_cast("int")
    rows = lines.withColumn("number", number).withColumn("head", F.last(F.when(F.col("number").isNotNull(), F.struct("number", "seq")), ignorenulls=True).over(_upto("deck")))
    rows = rows.where("head is not null and number is null")
    return rows.select("deck", F.col("head.number").alias("page"), F.col("head.seq").alias("visit"), "seq", "text")


def page_texts(lines: DataFrame) -> DataFrame:
    """``(deck, page, text)``: all lines of a page that aren't blank; pages without any are left out."""
    rows = pages(lines).where(F.trim("text") != "")
    return rows.groupBy("deck", "page").agg(F.trim(_joined("seq", F.col("text"), "\n")).alias("text"))


def last_page_texts(lines: DataFrame, most: int = 3000) -> DataFrame:
    """``(deck, page, text)``: a page's last visit alone, lines stripped, cut to ``most`` characters."""
    found = pages(lines)
    rows = found.groupBy("deck", "page", "visit").agg(_joined("seq", F.when(F.trim("text") != "", F.trim("text")), "\n").alias("text"))
    return rows.groupBy("deck", "page").agg(F.left(F.max_by("text", "visit"), F.lit(most)).alias("text"))


def text_rows(lines: DataFrame) -> DataFrame:
    """``(deck, page, seq, id, type, text)`` of the rows of a page's table of texts."""
    part = lambda group: F.regexp_extract("text", TEXT_ROW, group)
    rows = pages(lines).where(F.col("text").rlike(TEXT_ROW))
    return rows.select("deck", "page", "seq", part(1).alias("id"), part(2).alias("type"), part(3).alias("text"))


def formula_blocks(lines: DataFrame) -> DataFrame:
    """``(deck, page, block, latex)``: what stands between an odd mark of a page and the next; one left open is none."""
    mark = F.trim("text").startswith("$$")
    rows = pages(lines).withColumn("mark", mark).withColumn("marks", F.sum(mark.cast("int")).over(_upto("deck", "page")))
    total = F.max("marks").over(Window.partitionBy("deck", "page"))
    rows = rows.withColumn("total", total).where("marks % 2 = 1 and marks < total")
    latex = F.trim(_joined("seq", F.when(~F.col("mark"), F.trim("text")), " "))
    return rows.groupBy("deck", "page", ((F.col("marks") + 1) / 2).cast("bigint").alias("block")).agg(latex.alias("latex"))


def captions(lines: DataFrame) -> DataFrame:
    """``(deck, seq, img_id, file, page, n_lines, text)`` of every caption in order; text is its lines in one, page its file's."""
    head = F.when(F.col("text").rlike(CAPTION), F.struct("seq", F.regexp_extract("text", CAPTION, 1).alias("img_id"), F.regexp_extract("text", CAPTION, 2).alias("file")))
    rows = lines.withColumn("head", F.last(head, ignorenulls=True).over(_upto("deck"))).where("head is not null")
    line = F.when((F.col("seq") != F.col("head.seq")) & (F.trim("text") != ""), F.trim("text"))
    found = rows.groupBy("deck", "head").agg((F.count("*") - 1).alias("n_lines"), _joined("seq", line, " ").alias("text"))
    return found.select("deck", F.col("head.seq").alias("seq"), "head.img_id", "head.file", page_of(F.col("head.file")).alias("page"), "n_lines", "text")


def captions_by_file(lines: DataFrame) -> DataFrame:
    """``(deck, file, img_id, text)``: the last caption of each file that has lines."""
    last = F.max_by(F.struct("img_id", "text"), "seq")
    return captions(lines).where("n_lines > 0").groupBy("deck", "file").agg(last.alias("c")).select("deck", "file", "c.img_id", "c.text")


def titles(lines: DataFrame) -> DataFrame:
    """``(deck, page, title)``: a page's first title row that isn't made of symbols alone."""
    rows = text_rows(lines).where((F.col("type") == TITLE) & (F.trim("text") != "") & ~F.trim("text").rlike(SYMBOLS_ONLY))
    return rows.groupBy("deck", "page").agg(F.min_by(F.trim("text"), "seq").alias("title"))


def merge_pages(texts: DataFrame, formulas: DataFrame, notes: DataFrame) -> DataFrame:
    """``(deck, page, texts, formulas, captions)``: three sources ``(deck, page, ord, item)`` on one row a page, in order.

    The sources are stacked and grouped once, so a page that any of them has is there, with empty lists for the others.
    """
    stacked = None
    for name, rows in (("texts", texts), ("formulas", formulas), ("captions", notes)):
        own = rows.select("deck", "page", F.lit(name).alias("source"), "ord", "item")
        stacked = own if stacked is None else stacked.unionByName(own)
    side = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("source") == name, F.struct("ord", "item")))), lambda r: r["item"]).alias(name)
    return stacked.groupBy("deck", "page").agg(*[side(n) for n in ("texts", "formulas", "captions")])


def html_blocks(lines: DataFrame) -> DataFrame:
    """``(deck, seq, html)``: Markdown as blocks: formulas between marks, lists of neighbouring items, paragraphs.

    A block has the number of its first line; blank lines separate and are dropped.
    """
    text = strip(F.col("text"))
    rows = lines.withColumn("line", text).withColumn("bare", text == "$$")
    rows = rows.withColumn("open", F.sum(F.col("bare").cast("int")).over(_upto("deck")) % 2 == 1)
    inside = F.col("bare") | F.col("open")
    kind = F.when(inside, "formula").when(F.col("line").startswith("$$"), "one").when(F.col("line") == "", "blank").when(F.col("line").startswith("- "), "item").otherwise("text")
    rows = rows.withColumn("kind", kind)
    before = F.lag("kind").over(Window.partitionBy("deck").orderBy("seq"))
    begins = F.when(F.col("kind") == "formula", F.col("bare") & F.col("open")).when(F.col("kind") == "item", before.isNull() | (before != "item")).otherwise(True)
    rows = rows.withColumn("block", F.last(F.when(begins, F.col("seq")), ignorenulls=True).over(_upto("deck"))).where("kind <> 'blank'")
    said = F.when(F.col("kind") == "formula", F.when(~F.col("bare"), F.col("text"))).when(F.col("kind") == "item", F.concat(F.lit("<li>"), inline_html(F.substring("line", 3, 1 << 30)), F.lit("</li>"))).when(
        F.col("kind") == "one", F.substring("line", 3, 1 << 30)).otherwise(inline_html(F.col("line")))
    found = rows.groupBy("deck", "block").agg(F.max("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("seq", said.alias("v")))).alias("parts"))
    values = F.transform(F.filter("parts", lambda p: p["v"].isNotNull()), lambda p: p["v"])
    formula = F.concat(F.lit('<div class="formula">$$\n'), strip(F.array_join(values, "\n")), F.lit("\n$$</div>"))
    html = F.when(F.col("kind").isin("formula", "one"), formula).when(F.col("kind") == "item", F.concat(F.lit("<ul>"), F.array_join(values, ""), F.lit("</ul>"))).otherwise(F.concat(F.lit("<p>"), F.array_join(values, ""), F.lit("</p>")))
    return found.select("deck", F.col("block").alias("seq"), html.alias("html"))


def place_formulas(lines: DataFrame, formulas: DataFrame) -> DataFrame:
    """``(deck, seq, text)``: a deck's formula file with ``formulas(deck, page, n, latex)`` put in, in order of n within a page.

    A formula stands at the end of its page's section, before the heading of the next larger page, or at the end of the
    file. It is numbered on from the formulas that the file has of its page. A file without headings gets one for the
    first formula, and an empty file a head. Headings and formulas run through one window by descending page, in which a
    formula takes the last heading before it: the smallest larger page. Blank formulas are left out.
    """
    lines = lines.select("deck", F.col("seq").cast("bigint").alias("seq"), "text")
    formulas = formulas.where(F.trim("latex") != "").select("deck", F.col("page").cast("bigint").alias("page"), F.col("n").cast("bigint").alias("n"), F.trim("latex").alias("latex"))
    number = F.nullif(F.regexp_extract(F.trim("text"), PAGE, 1), F.lit("")).try_cast("bigint")
    heads = lines.withColumn("page", number).where("page is not null")
    had = lines.select("deck", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NUMBERED), F.lit(1)))).alias("page")).groupBy("deck", F.col("page").cast("bigint").alias("page")).agg(F.count("*").alias("had"))
    own = F.row_number().over(Window.partitionBy("deck", "page").orderBy("n", "latex"))
    numbered = formulas.withColumn("own", own).join(had, ["deck", "page"], "left").withColumn("own", F.col("own") + F.coalesce("had", F.lit(0))).drop("had")
    # at the same page a formula comes before the heading; of a page's headings the first line is the last to be seen
    marks = heads.select("deck", "page", F.lit(1).alias("kind"), (-F.col("seq")).alias("turn"), F.col("seq").alias("at"), F.lit(None).cast("bigint").alias("own"), F.lit(None).cast("string").alias("latex"))
    asked = numbered.select("deck", "page", F.lit(0).alias("kind"), F.col("own").alias("turn"), F.lit(None).cast("bigint").alias("at"), "own", "latex")
    before = Window.partitionBy("deck").orderBy(F.desc("page"), "kind", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.unionByName(asked).withColumn("at", F.last("at", ignorenulls=True).over(before)).where("kind = 0")
    shape = lines.groupBy("deck").agg(F.max("seq").alias("last"), F.bool_or(number.isNotNull()).alias("headed"))
    first = F.row_number().over(Window.partitionBy("deck").orderBy("page", "own"))
    placed = placed.withColumn("first", first == 1).join(shape, "deck", "left")
    entry = F.concat(F.array(F.concat(F.lit("- **(p"), F.col("page").cast("string"), F.lit("-img"), F.col("own").cast("string"), F.lit(")** $$"))), F.split("latex", "\n"), F.array(F.lit("$$"), F.lit(""), F.lit(FROM_PICTURE)))
    bare = ~F.coalesce("headed", F.lit(False)) & F.col("first")
    head = F.when(F.col("last").isNull(), F.array(*map(F.lit, NEW_FILE))).otherwise(F.array().cast("array<string>"))
    heading = F.concat(head, F.array(F.concat(F.lit("## 第 "), F.col("page").cast("string"), F.lit(" 页")), F.lit("")), entry, F.array(F.lit("")))
    text = F.when(bare, heading).otherwise(F.concat(F.array(F.lit("")), entry))
    end = F.lit((1 << 62) - 1)
    rank = lambda *parts: F.struct(*[p.cast("bigint").alias(f"r{i}") for i, p in enumerate(parts)]).alias("rank")
    added = placed.select("deck", rank(F.coalesce("at", end), F.lit(0), F.col("page"), F.col("own")), F.posexplode(text).alias("part", "text"))
    given = lines.select("deck", rank(F.col("seq"), F.lit(1), F.lit(0), F.lit(0)), F.lit(0).alias("part"), "text")
    seq = F.row_number().over(Window.partitionBy("deck").orderBy("rank", "part")).cast("bigint")
    return given.unionByName(added).select("deck", seq.alias("seq"), "text")
