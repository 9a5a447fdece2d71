"""Exact top-k inner products by norm buckets with length and coordinate pruning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .vectors import GROUP_ROWS, QUERY_ROWS, Block, best, bundles, dealt_queries, every, numbered, pick, search_blocks, valid

#: Vectors of a bucket; coordinates that coordinate pruning looks at; the local threshold from which it is used.
BUCKET, FOCUS, COORDINATE_FROM = 1_024, 4, 0.4
#: Sums of whole numbers below this are exact in doubles, whatever their order.
EXACT = 2.0**53


class Buckets:
    """The integer vectors of a group by descending length, in buckets, searched for one query after the other."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vecs: np.ndarray):
        with np.errstate(over="ignore"):
            norms = np.sqrt((vecs**2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.rows, self.vecs, self.norms = ids[order], rows[order], vecs[order], norms[order]
        self.unit = np.ascontiguousarray((self.vecs / np.maximum(self.norms, 1e-30)[:, None]).T)  # dimension, vector

    def candidates(self, begin: int, end: int, direction: np.ndarray, q_norm: float, bar: float) -> np.ndarray | None:
        """Places in a bucket whose product can reach ``bar``; None if no vector from here on can.

        The local threshold is the cosine that the longest vector of the bucket needs. Low ones prune little by
        direction, so the bucket is cut by length; high ones leave each coordinate of a unit vector an interval.
        """
        if bar <= 0 or q_norm == 0 or not math.isfinite(q_norm * self.norms[begin]):
            return np.arange(begin, end)
        local = bar / (q_norm * max(self.norms[begin], 1e-30)) * (1 - 1e-9)
        if local > 1:
            return None
        if local < COORDINATE_FROM:
            return np.arange(begin, begin + int(np.searchsorted(-self.norms[begin:end], -bar / q_norm * (1 - 1e-9), side="right")))
        keep = np.ones(end - begin, dtype=bool)
        for f in np.argpartition(-np.abs(direction), min(FOCUS, len(direction)) - 1)[:FOCUS]:
            c = direction[f]
            spread = math.sqrt(max(0.0, (1 - local**2) * (1 - c**2)))
            low = -1.0 if -c >= local else local * c - spread
            high = 1.0 if c >= local else local * c + spread
            x = self.unit[f, begin:end]
            keep &= (x >= low - 1e-9) & (x <= high + 1e-9)
        return begin + np.flatnonzero(keep)

    def search(self, own_row: int, query: np.ndarray, k: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best, as far as they reach ``bar``, the k-th best known from elsewhere."""
        with np.errstate(over="ignore"):
            q_norm = math.sqrt(float((query**2).sum()))
        direction = query / max(q_norm, 1e-30)
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for begin in range(0, len(self.ids), BUCKET):
            at = self.candidates(begin, min(begin + BUCKET, len(self.ids)), direction, q_norm, bar)
            if at is None:
                break
            at = at[self.rows[at] != own_row]
            products = whole_products(self.vecs[at], query, q_norm * self.norms[begin])
            near = products >= bar
            ids, scores = np.concatenate([ids, self.ids[at[near]]]), np.concatenate([scores, products[near]])
            top = pick(scores, ids, k)
            ids, scores = ids[top], scores[top]
            if len(scores) == k:
                bar = max(bar, float(scores[-1]) if abs(int(scores[-1])) < EXACT else float(scores[-1]) * (1 - 1e-12))
        return ids, scores


def whole_products(vecs: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers, exactly; ``most`` bounds what all their terms sum to.

    Beyond what doubles hold, with Python's integers. Products beyond 64 bits become the largest or smallest one.
    """
    if most < EXACT:
        return (vecs @ query).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in vecs.tolist()]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact], dtype=np.int64)


def quantise(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """``(id, vec)`` with floor(factor * x) of every component, whole numbers in doubles; vectors that overflow take no part."""
    def whole(x):
        y = x * F.lit(float(factor))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # from there on all doubles are whole

    rows = vectors.select("id", F.transform("vec", whole).alias("vec"))
    return rows.where(~F.exists("vec", lambda x: F.abs(x) == float("inf")))


def exact_top_k(vectors: DataFrame, query_rows: "F.Column", k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest products of whole-number vectors ``(id, vec)``, exactly.

    Vectors are dealt into groups of about GROUP_ROWS by descending length, vectors of one length by a hash. The
    longest group is searched first; the k-th product found there is each query's bar for all other groups. Queries
    are dealt into blocks by the length that a vector needs to reach their bar; a block meets only the groups whose
    longest vector has it. Groups stand by descending length and blocks by ascending need, so that a block meets the first
    of the groups and a group the first of the blocks: one number says how many. There buckets are pruned by their local cosine thresholds, and what is left is verified by
    its product. Only what lies strictly below a bar is pruned, so ties go to the smaller id. A query is no candidate
    of its own; other rows of its id are, and each row of an id that repeats is asked. Vectors of different lengths meet
    as if the shorter one had zeros at its end. Zero vectors take part. An empty table gives
    an empty result; with fewer than k candidates all are returned.

    The driver gets two numbers for every group and every block, and hands one back.
    """
    rows = numbered(vectors.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))), "norms")
    total, n_queries = rows.agg(F.count("*"), F.count_if(query_rows("id"))).first()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    spark = rows.sparkSession

    def search(q: Block, c: Block):
        held = Buckets(c.ids, c.rows, c.vecs)
        bars = q.columns[0] if q.columns else np.full(len(q.ids), -np.inf)
        found = [held.search(int(r), v, k, bar) for r, v, bar in zip(q.rows, q.vecs, bars)]
        ids, scores = (np.concatenate(x) for x in zip(*found))
        return np.repeat(np.arange(len(q.ids)), [len(s) for _, s in found]), ids, scores

    groups = math.ceil(total / GROUP_ROWS)
    placed = rows.repartitionByRange(groups, F.desc("norm"), F.xxhash64("row")) if groups > 1 else rows.coalesce(1)
    placed = materialize(placed.withColumn("grp", F.spark_partition_id().cast("bigint")), "norm-groups")
    tops = sorted((r[0], r[1]) for r in placed.groupBy("grp").agg(F.max("norm")).collect())  # by descending length
    asked = rows.where(query_rows("id"))
    first = tops[0][0]
    n_blocks = max(1, math.ceil(n_queries / QUERY_ROWS))
    blocks = bundles(dealt_queries(asked, n_blocks), ["blk"], []).withColumn("grps", F.array(F.lit(first)))
    own = bundles(placed.where(F.col("grp") == first), ["grp"], []).withColumn("blks", every(n_blocks, "blks"))
    longest = search_blocks(blocks, own, [], search, "bigint")
    if len(tops) == 1:
        return best(longest, k)
    longest = materialize(longest, "longest")
    bars = longest.groupBy("row").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k)
    bars = bars.select("row", F.col("low").cast("double").alias("bar"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    asked = asked.join(bars, "row", "left").select("id", "row", "vec", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
    # a length a little below what the bar asks for, so that rounding prunes nothing
    need = F.when((F.col("bar") > 0) & (norm > 0) & (norm < float("inf")), F.col("bar") / norm * (1 - 1e-9)).otherwise(float("-inf"))
    asked = asked.withColumn("need", need)
    asked = asked.repartitionByRange(n_blocks, "need", F.xxhash64("row")) if n_blocks > 1 else asked.coalesce(1)
    asked = materialize(asked.withColumn("blk", F.spark_partition_id().cast("bigint")), "norm-queries")
    needs = sorted((r[0], r[1]) for r in asked.groupBy("blk").agg(F.min("need")).collect())  # by ascending need
    falling, rising = np.array([-top for _, top in tops[1:]]), np.array([need for _, need in needs])
    reached = np.searchsorted(falling, -rising, side="right")  # how many of the groups reach what a block needs
    asking = np.searchsorted(rising, -falling, side="right")  # how many of the blocks need no more than a group has
    first_of = lambda numbers: F.sequence(F.lit(numbers[0]).cast("bigint"), F.col("last").cast("bigint"))
    last = lambda name, own, counts, of: spark.createDataFrame([(int(n), int(of[c - 1])) for n, c in zip(own, counts) if c], f"{name} bigint, last bigint")
    grp_ids, blk_ids = [g for g, _ in tops[1:]], [b for b, _ in needs]
    blocks = bundles(asked.select("blk", "id", "row", "vec", "bar"), ["blk"], ["bar"]).join(last("blk", blk_ids, reached, grp_ids), "blk").withColumn("grps", first_of(grp_ids)).drop("last")
    others = bundles(placed.where(F.col("grp") != first), ["grp"], []).join(last("grp", grp_ids, asking, blk_ids), "grp").withColumn("blks", first_of(blk_ids)).drop("last")
    return best(longest.unionByName(search_blocks(blocks, others, ["bar"], search, "bigint")), k)


def op9_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return exact_top_k(vectors, lambda c: F.col(c) % 50 == 0)
