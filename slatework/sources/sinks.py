"""What decks are written to: Markdown and HTML as ordered lines, manifests as CSV and JSON, tables in a shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import escape, latex_block
from ..operators.markdown import html_blocks

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a temporary one of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-slatework-"))
    return f"{base.rstrip('/')}/slatework/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written once to the shared folder and read from there, for what is read several times."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _lines(rows: DataFrame, *parts: Column) -> DataFrame:
    """Each row's lines, null ones left out; ``rank`` orders rows of a deck."""
    listed = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return rows.select("deck", "rank", F.posexplode(listed).alias("part", "line"))


def _numbered(*blocks: DataFrame) -> DataFrame:
    """``(deck, seq, text)``: the lines of all blocks in order; a line that has breaks is several."""
    rows = blocks[0]
    for more in blocks[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("deck", "rank", "part", F.posexplode(F.split("line", "\n")).alias("at", "text"))
    seq = F.row_number().over(Window.partitionBy("deck").orderBy("rank", "part", "at")).cast("bigint")
    return rows.select("deck", seq.alias("seq"), "text")


def _rank(*parts: Column) -> Column:
    return F.struct(*[p.cast("bigint").alias(f"r{i}") for i, p in enumerate(parts)]).alias("rank")


def texts_markdown(entries: DataFrame) -> DataFrame:
    """Lines of a deck's text file from ``entries(deck, page, seq, kind, id, label, name, text, in_group, x, y, w, h)``.

    A page has a heading and a table of its texts; tables stand between its rows.
    """
    pages = entries.select("deck", "page").distinct().select("deck", _rank(F.col("page"), F.lit(0)), "page")
    heads = _lines(pages, F.format_string("## 第 %d 页", "page"), F.lit(""), F.lit("| ID | 类型 | 文本 | 坐标 |"), F.lit("|---|---|---|---|"))
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    place = F.concat(F.lit("("), whole("x"), F.lit(","), whole("y"), F.lit(") "), whole("w"), F.lit("x"), whole("h"))
    shown = F.concat(F.when(F.col("in_group"), "[图块内文本] ").otherwise(""), F.replace("text", F.lit("|"), F.lit("\\|")))
    row = F.concat(F.lit("| "), "id", F.lit(" | "), "label", F.lit(" | "), shown, F.lit(" | "), place, F.lit(" |"))
    table = F.concat(F.lit("**表格: "), "name", F.lit("** 坐标 "), place, F.lit("\n\n"), "text", F.lit("\n"))
    rows = entries.withColumn("rank", _rank(F.col("page"), F.col("seq")))
    return _numbered(heads, _lines(rows, F.when(F.col("kind") == "table", table).otherwise(row)))


def captions_markdown(entries: DataFrame) -> DataFrame:
    """Lines of a deck's caption file from ``entries(deck, page, n, img_id, file, text)``."""
    pages = entries.select("deck", "page").distinct().select("deck", _rank(F.col("page"), F.lit(-1)), F.format_string("## 第 %d 页\n", "page").alias("line"))
    head = F.format_string("### %s — `%s`  ✅\n", "img_id", "file")
    rows = entries.withColumn("rank", _rank(F.col("page"), F.col("n")))
    return _numbered(_lines(pages, F.col("line")), _lines(rows, head, F.concat("text", F.lit("\n"))))


def formula_entry(page: Column, index: Column, source: Column, latex: Column, display: Column, in_group: Column) -> Column:
    """A formula as an entry of its page; one without LaTeX says so."""
    head = F.concat(F.format_string("- **(p%d-f%d)**", page, index), F.when(in_group, " （组合内公式）").otherwise(""), F.lit(" "))
    body = F.when(source == "omml", latex_block(latex, display)).otherwise(latex_block(latex, F.lit(True)))
    tail = F.when(source == "eq3", "\n\n  > 来源：EQ3-MTEF 解析\n").when(source == "ocr", "\n\n  > 来源：OCR\n").otherwise("")
    return F.when(F.trim(F.coalesce(latex, F.lit(""))) == "", F.concat(head, F.lit("OLE 嵌入对象未获 LaTeX。"))).otherwise(F.concat(head, body, tail))


def textbook_markdown(pages: DataFrame) -> DataFrame:
    """Lines of a deck's textbook from ``pages(deck, page, text, direct)``; a page that is put out as it was says so."""
    note = F.when(F.col("direct"), "> 直出整理（保留原意、尽量不增字数）。\n")
    rows = pages.withColumn("rank", _rank(F.col("page")))
    return _numbered(_lines(rows, F.format_string("## 第 %d 页\n", "page"), note, F.concat("text", F.lit("\n"))))


def html_book(pages: DataFrame) -> DataFrame:
    """``(deck, page, html)``: a section a page from ``pages(deck, page, title, text)``, its Markdown as blocks."""
    lines = pages.select(F.struct("deck", "page").alias("deck"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    blocks = html_blocks(lines).groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("seq", "html"))).alias("blocks"))
    body = F.array_join(F.transform("blocks", lambda b: b["html"]), "\n")
    rows = pages.join(blocks.select("deck.deck", "deck.page", body.alias("body")), ["deck", "page"], "left")
    section = F.concat(F.format_string('<section id="p%d"><h2>', "page"), escape(F.col("title")), F.lit("</h2>\n"), F.coalesce("body", F.lit("")), F.lit("\n</section>"))
    return rows.select("deck", "page", section.alias("html"))


def write_lines(lines: DataFrame, path: str) -> None:
    """``lines(deck, seq, text)`` as text files, a folder a deck, its lines in order."""
    rows = lines.repartition("deck").sortWithinPartitions("deck", "seq").select("deck", F.col("text").alias("value"))
    rows.write.partitionBy("deck").text(path)


def write_manifest(records: DataFrame, path: str) -> None:
    """Records as CSV with a head, for tables, and as JSON, for programs."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in records.dtypes]
    records.select(*flat).write.option("header", "true").csv(f"{path}/manifest_csv")
    records.write.json(f"{path}/manifest_json")


def mark_dropped(records: DataFrame, dropped: DataFrame) -> DataFrame:
    """Records with ``related``: drop for the files of ``dropped(file)``, else null."""
    return records.join(dropped.select("file", F.lit("drop").alias("related")).distinct(), "file", "left")
