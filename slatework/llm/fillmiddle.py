"""Fill-in-middle transformation: one counted regular expression a row cuts prefix, middle and suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: what stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The unit that is counted, a code point; and how many at a time, so that counting never holds a string for every one.
UNIT, BLOCK = ".", 4096


def code_points(text: Column) -> Column:
    """Units of a text by ``regexp_count``: whole blocks first, then what is left one by one."""
    blocks = F.regexp_count(text, F.lit(f"(?s){UNIT}{{{BLOCK}}}+"))
    rest = F.regexp_replace(text, rf"(?s)\A(?:{UNIT}{{{BLOCK}}}+)++", "")
    return blocks.cast("bigint") * BLOCK + F.regexp_count(rest, F.lit(f"(?s){UNIT}"))


def _draws(ids: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the seed and an id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` turned into ``output``; texts with a marker of their own are plain, so markers are the first ones."""
    ordered = lambda a, b, groups: F.regexp_replace(output, rf"(?s)\A{a}(.*?){b}(.*?){MIDDLE}(.*+)\z", groups)
    return F.when(form == "psm", ordered(PREFIX, SUFFIX, "$1$3$2")).when(form == "spm", ordered(SUFFIX, PREFIX, "$2$3$1")).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every row.

    Prefix, middle and suffix are cut at two places drawn from the seed and the id. A pattern made for the row, with the
    two lengths as possessive counts of units, captures all three in one match, which the replacement puts in order. A
    text is ``plain``, and its own output, if it is empty, holds a marker, or draws ``plain_from`` or more of a hundred;
    else ``spm`` if it draws less than ``spm_below``, or ``psm``.

    A null text is an empty one and a null id draws like an empty one; equal ids draw alike; a text of any length is
    matched once, from its begin, without going back; repeated rows stay; an empty table gives an empty table. Columns
    of docs with a name of the five are replaced, all others kept.
    """
    own = ["n", "form", "prefix_chars", "middle_chars", "output"]
    given = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    h1, h2, h3, h4 = _draws(F.col(f"`{id_col}`"), seed)
    rows = docs.select(given.alias("given"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    rows = rows.withColumn("n", code_points(F.col("text")))
    rows = rows.withColumn("a", F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)))
    rows = rows.withColumn("b", F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= plain_from)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm"))
    pattern = F.concat(F.lit(rf"(?s)\A({UNIT}{{"), F.col("a").cast("string"), F.lit(rf"}}+)({UNIT}{{"), (F.col("b") - F.col("a")).cast("string"), F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    cut = F.col("form") != "plain"
    rows = rows.withColumn("output", F.when(cut, F.regexp_replace("text", pattern, order)).otherwise(F.col("text")))
    kept = [F.col(f"given.c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in own]
    return rows.select(*kept, "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), "output")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
