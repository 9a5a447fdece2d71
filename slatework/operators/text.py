"""Text operators: exclusion with reasons, numbering, sections, tidying, batching, page merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Placeholders that are never text.
PLACEHOLDERS = ("ftr", "sldNum", "hdr", "dt")
#: Words that speak for a subject, in the order that decides between equals, and the subject without any.
SUBJECTS = {
    "电子信息工程/电子技术": ["放大电路", "电阻", "电容", "晶体管", "运放", "放大器", "信号", "频率", "半导体", "波形", "电流", "电压", "反馈", "振荡", "滤波", "二极管", "场效应", "共射", "静态工作点", "偏置"],
    "数学": ["函数", "导数", "积分", "方程", "矩阵", "概率", "极限", "微分", "级数", "向量", "几何"],
    "物理学": ["力学", "电场", "磁场", "量子", "热学", "光学", "电磁感应", "牛顿", "能量守恒", "波动"],
    "计算机科学与技术": ["算法", "数据结构", "操作系统", "编程", "数据库", "网络协议", "编译器", "进程", "线程", "机器学习"],
    "自动控制": ["控制系统", "传递函数", "稳定性", "闭环", "开环", "PID", "状态空间", "根轨迹", "频域"],
    "经济学": ["需求", "供给", "市场", "价格", "成本", "利润", "GDP", "货币", "投资", "汇率"],
}
NO_SUBJECT = "相关专业"


def exclude(lines: DataFrame, ratio: float = 0.9, min_len: int = 2, fixed: DataFrame | None = None) -> DataFrame:
    """``lines(deck, page_key, seq, text, ph)`` without blank ones, with the reason that excludes a line or null.

    First match: a placeholder; a text of ``fixed(deck, text)``, those of a deck's masters and layouts; a text on
    ``ratio`` of its deck's pages or more (decks of two pages and more); a text shorter than ``min_len``. Pages of a text are counted distinct in two steps, so a text of very many
    lines is summed before it meets others; the join back is on the text, which Spark splits if it is skewed.
    """
    rows = lines.where(F.col("text") != "")
    pages = rows.groupBy("deck", "text", "page_key").agg(F.lit(1).alias("one")).groupBy("deck", "text").agg(F.count("*").alias("on_pages"))
    total = rows.groupBy("deck", "page_key").agg(F.lit(1).alias("one")).groupBy("deck").agg(F.count("*").alias("pages"))
    spread = pages.join(total, "deck").where((F.col("pages") >= 2) & (F.col("on_pages") >= ratio * F.col("pages"))).select("deck", "text", F.lit(True).alias("wide"))
    same = F.lit(False)
    if fixed is not None:
        rows, same = rows.join(fixed.select("deck", "text", F.lit(True).alias("same")).distinct(), ["deck", "text"], "left"), F.col("same")
    reason = F.when(F.col("ph").isin(*PLACEHOLDERS), "placeholder").when(same, "fixed").when(F.col("wide"), "global").when(F.length("text") < min_len, "short")
    return rows.join(spread, ["deck", "text"], "left").select("deck", "page_key", "seq", "text", "ph", reason.alias("reason"))


def number(kept: DataFrame) -> DataFrame:
    """Kept lines with their id, the page and a running number of the page."""
    n = F.row_number().over(Window.partitionBy("deck", "page_key").orderBy("seq"))
    return kept.where("reason is null").select("deck", "page_key", "seq", F.format_string("TXT%03d-%02d", "page_key", n).alias("id"), "text")


def tidy(lines: DataFrame) -> DataFrame:
    """Lines stripped, without blank ones and without those that repeat the line before."""
    rows = lines.select("deck", "page_key", "seq", F.trim("text").alias("text")).where("text <> ''")
    before = F.lag("text").over(Window.partitionBy("deck", "page_key").orderBy("seq"))
    return rows.withColumn("before", before).where("before is null or before <> text").drop("before")


def direct_pages(docs: DataFrame, least: int = 500) -> DataFrame:
    """Documents that are long enough, spaces and newlines aside, to be put out as they are."""
    size = F.length(F.translate("text", " \n", "")).cast("bigint")
    return docs.select("doc_id", size.alias("n_chars_solid")).where(F.col("n_chars_solid") > least)


def subject(docs: DataFrame, keywords: dict[str, list[str]], default: str) -> DataFrame:
    """The subject with most of its keywords in the text; the first of equals, ``default`` without any."""
    hits = [(name, sum((F.col("text").contains(k).cast("int") for k in words), F.lit(0))) for name, words in keywords.items()]
    best = F.greatest(*[n for _, n in hits])
    choice = F.lit(default)
    for name, n in reversed(hits):
        choice = F.when((n == best) & (best > 0), name).otherwise(choice)
    return docs.select("doc_id", choice.alias("subject"), best.cast("bigint").alias("hits"))


def sections(lines: DataFrame, header: F.col, number_of: F.col) -> DataFrame:
    """Lines under the header that was last seen on their page; lines before the first one are dropped, headers too."""
    seen = F.last(F.when(header, number_of), ignorenulls=True).over(Window.partitionBy("deck", "page_key").orderBy("seq"))
    rows = lines.withColumn("section", seen).withColumn("is_header", header)
    return rows.where("section is not null and not is_header").select("deck", "page_key", "section", "seq", "text")


def toggled(lines: DataFrame, mark: F.col) -> DataFrame:
    """Lines between an odd mark and the next; ``block`` counts the blocks of a page from 1."""
    marks = F.sum(mark.cast("int")).over(Window.partitionBy("deck", "page_key").orderBy("seq"))
    rows = lines.withColumn("marks", marks).withColumn("is_mark", mark).where("marks % 2 = 1 and not is_mark")
    return rows.select("deck", "page_key", "seq", ((F.col("marks") + 1) / 2).cast("bigint").alias("block"), "text")


def titles(docs: DataFrame, most: int = 30) -> DataFrame:
    """The first line that isn't blank, cut to 60 characters, then cleaned and cut to ``most`` with a mark."""
    first = F.get(F.filter(F.split("text", "\n"), lambda line: F.trim(line) != ""), 0)  # null if all are blank
    title = F.coalesce(F.left(F.trim(first), F.lit(60)), F.lit(""))
    clean = F.trim(F.regexp_replace(title, "[ \t]+", " "))
    short = F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most)), F.lit("…"))).otherwise(clean)
    return docs.select("doc_id", title.alias("title"), short.alias("short_title"))


def merge_sources(pages: DataFrame, left_role: str, right_role: str) -> DataFrame:
    """Two sources' texts on each page side by side; a page that only one source has keeps an empty other side."""
    def side(role: str, name: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
        joined = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
        return pages.where(F.col("role") == role).groupBy("conv_id", "page").agg(joined.alias(name))

    both = side(left_role, "left_text").join(side(right_role, "right_text"), ["conv_id", "page"], "full")
    return both.select("conv_id", "page", F.coalesce("left_text", F.lit("")).alias("left_text"), F.coalesce("right_text", F.lit("")).alias("right_text"))
