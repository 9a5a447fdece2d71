"""Record operators: as-of markers, inventories, resume and merge, relevance defaults, markup counts, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def preview_asof(events: DataFrame, marker: str, target: str, within_s: int) -> DataFrame:
    """Each ``target`` event's latest ``marker`` event of the same user, at most ``within_s`` seconds before it, or null.

    Markers and targets run through one window in time order, so a user costs a sort and never a pair of rows each.
    """
    both = events.where(F.col("event_type").isin(marker, target)).withColumn("ts", F.col("ts").cast("timestamp"))
    is_marker = F.col("event_type") == marker
    before = Window.partitionBy("user_id").orderBy("ts", F.when(is_marker, 0).otherwise(1), "event_id")
    last = F.last(F.when(is_marker, F.struct("ts", "event_id")), ignorenulls=True).over(before)
    rows = both.withColumn("last", last).where(~is_marker)
    near = F.unix_micros("ts") - F.unix_micros("last.ts") <= within_s * 1_000_000
    return rows.select("event_id", F.when(near, F.col("last.event_id")).alias("preview_of"))


def record_index(objects: DataFrame) -> DataFrame:
    """Running number of each record among those of its kind on its page, from 1."""
    n = F.row_number().over(Window.partitionBy("deck_id", "page", "kind").orderBy("z_index")).cast("bigint")
    return objects.select("deck_id", "page", "z_index", "kind", n.alias("index"))


def inventory(objects: DataFrame) -> DataFrame:
    """Records of each kind in a deck, and how many are previews of others."""
    return objects.groupBy("deck_id", "kind").agg(F.count("*").alias("records"), F.count_if(F.col("preview_of") != "").alias("previews"))


def reused(references: DataFrame, media: str) -> DataFrame:
    """Media with more than one reference; missing ones don't count."""
    return references.where(F.col(media).isNotNull()).groupBy(F.col(media).alias("media")).agg(F.count("*").alias("refs")).where("refs > 1")


def gallery(images: DataFrame) -> DataFrame:
    """Images numbered through their deck by page and z order.

    A page's images are numbered on the page; only the pages' counts are summed through the deck.
    """
    counts = images.groupBy("deck_id", "page").agg(F.count("*").alias("n"))
    through = Window.partitionBy("deck_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("deck_id", "page", F.coalesce(F.sum("n").over(through), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("deck_id", "page").orderBy("z_index"))
    rows = images.withColumn("own", own).join(starts, ["deck_id", "page"])
    return rows.select("deck_id", "page", "z_index", F.format_string("IMG%04d", F.col("start") + F.col("own")).alias("img_id"))


def relevance(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Documents stay unless a verdict drops them; one without verdict stays."""
    drop = F.coalesce(F.col("toxic") == 1, F.lit(False))
    rows = docs.select("doc_id").join(verdicts.select("doc_id", "toxic"), "doc_id", "left")
    return rows.select("doc_id", (~drop).alias("keep"), F.when(drop, "toxic").when(F.col("toxic").isNull(), "no verdict").otherwise("").alias("reason"))


def reasons(relevant: DataFrame) -> DataFrame:
    """How many documents have each reason; a blank one counts as other."""
    name = F.when(F.trim("reason") == "", "other").otherwise(F.col("reason"))
    return relevant.groupBy(name.alias("reason")).agg(F.count("*").alias("documents"))


def merge_previous(fresh: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """Fresh rows with the previous value where there is one that isn't empty; ``reused`` tells which."""
    old = F.col("_old") if dict(previous.dtypes)[value] != "string" else F.nullif(F.trim("_old"), F.lit(""))
    rows = fresh.join(previous.select(key, F.col(value).alias("_old")), key, "left")
    return rows.select(key, F.coalesce(old, F.col(value)).alias(value), old.isNotNull().alias("reused"))


def tag_histogram(pages: DataFrame, most: int = 12) -> DataFrame:
    """The ``most`` tags that are opened most often, ties by name."""
    tags = pages.select(F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def exclusive_links(pages: DataFrame) -> DataFrame:
    """Every link with the pages that have it; one that a single page has can go with that page."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")).distinct()
    return links.groupBy("link").agg(F.count("*").alias("pages")).withColumn("exclusive", F.col("pages") <= 1)


def state_plan(log: DataFrame) -> DataFrame:
    """What to do with each step of ``log(deck, step, at, n, status, artifact)``, by its last entry."""
    last = log.groupBy("deck", "step").agg(F.max_by(F.struct("status", "artifact"), F.struct("at", "n")).alias("last"))
    done = F.col("last.status") == "done"
    action = F.when(done & F.col("last.artifact"), "skip").when(done, "run").when(F.col("last.status") == "partial", "resume").otherwise("run")
    return last.select("deck", "step", action.alias("action"))
