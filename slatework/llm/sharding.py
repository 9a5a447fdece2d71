"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: About so many rows of one shard are permuted by one task in the second permutation.
BUCKET_ROWS = 20_000
#: Partitions whose rows of the matrix one task draws; the driver draws a row for each such block.
BLOCK_PARTS = 1_024
#: The library draws hypergeometric numbers from populations below this.
LIBRARY_ROWS = 10**9


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` rows drawn without replacement are among the ``good`` ones; for populations of any size.

    Beyond what the library takes, by rejection under the ratio of uniforms around the mode.
    """
    if good + bad < LIBRARY_ROWS:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low

    def weight(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, good - k, n - k, bad - n + k))

    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    centre, top = n * good / total + 0.5, weight(mode)
    spread = math.sqrt(n * (good / total) * (bad / total) * (total - n) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.uniform(1e-12, 1), rng.uniform(-0.5, 0.5)
        k = math.floor(centre + width * v / u)
        if low <= k <= high and 2 * math.log(u) <= weight(k) - top:
            return k


def shard_sizes(total: int, n_shards: int) -> list[int]:
    """Sizes that differ by one at most."""
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def communication_matrix(part_rows: list[int], sizes: list[int], seed: int | list[int]) -> np.ndarray:
    """How many rows each partition sends to each shard: a draw from all row-to-shard deals of the exact ``sizes``.

    Row i is multivariate hypergeometric given the rows above it: each shard's number given those of the shards before.
    """
    rng, left, rows = np.random.default_rng(seed), list(sizes), []
    for n in part_rows:
        drawn, others = [], sum(left)
        for have in left:
            others -= have
            drawn.append(hypergeometric(have, others, n, rng) if n else 0)
            n -= drawn[-1]
        left = [a - b for a, b in zip(left, drawn)]
        rows.append(drawn)
    return np.array(rows, dtype=np.int64).reshape(len(rows), len(sizes))


def drawn_ends(counts: DataFrame, total: int, n_shards: int, seed: int) -> DataFrame:
    """``(part, ends)``: the running sums of each partition's row of the matrix, from ``counts(part, n)``.

    Drawn in two levels: the driver deals blocks of BLOCK_PARTS partitions, a row each, and a task deals a block's
    row to its partitions.
    """
    spark = counts.sparkSession
    blocked = counts.withColumn("block", F.floor(F.col("part") / BLOCK_PARTS).cast("bigint"))
    blocks = sorted((r["block"], r["n"]) for r in blocked.groupBy("block").agg(F.sum("n").alias("n")).collect())
    matrix = communication_matrix([n for _, n in blocks], shard_sizes(total, n_shards), seed)
    given = spark.createDataFrame([(b, row.tolist()) for (b, _), row in zip(blocks, matrix)], "block bigint, sizes array<bigint>")

    def draw(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("part")
        own = communication_matrix(block["n"].tolist(), block["sizes"].iloc[0].tolist(), [seed, int(key[0])])
        return pd.DataFrame({"part": block["part"], "ends": list(np.cumsum(own, axis=1))})

    return blocked.join(given, "block").groupBy("block").applyInPandas(draw, "part int, ends array<bigint>")


def shard_rows(rows: DataFrame, n_shards: int, seed: int = 42) -> DataFrame:
    """Deal ``rows`` uniformly at random into ``n_shards`` shards whose row counts are at most one apart.

    Returns all columns and ``shard`` (from 0) and ``slot`` (place in the shard, gapless from 0). Columns of
    these two names in the input are replaced; any other name may be used. Null values, empty texts, ties and
    repeated rows are dealt like any row, since only the place of a row in the input counts; an empty table gives
    an empty table. Only the number of rows of each block of partitions goes to the driver. ``rows`` is written
    once before the draw, so that a repeated task sees the places that were counted.
    """
    given = [c for c in rows.columns if c not in ("shard", "slot")]
    inner = [f"c{i}" for i in range(len(given))]  # so that no name of the input meets one used here
    rows = rows.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(given, inner)])
    rows = rows.select(*inner, F.spark_partition_id().alias("part"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("key"))
    rows = materialize(rows, "sharding-rows")
    counts = materialize(rows.groupBy("part").agg(F.count("*").alias("n")), "sharding-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sent = materialize(drawn_ends(counts, total, n_shards, seed), "sharding-matrix")
    # the first permutation: each partition orders its rows at random and cuts that order by its row of the matrix
    first = Window.partitionBy("part").orderBy("key")
    dealt = rows.withColumn("rank", F.row_number().over(first) - 1).join(sent, "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda end: end <= F.col("rank"))).cast("int"))
    # the second: every shard orders what it got at random, in buckets of that order
    bits = max(0, int(np.ceil(np.log2(max(1, total / n_shards / BUCKET_ROWS)))))
    dealt = dealt.withColumn("key", F.xxhash64(F.lit(seed + 1), "part", "rank"))
    dealt = dealt.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("bigint"))
    dealt = dealt.select(*inner, "shard", "part", "rank", "key", "bucket")
    sizes = dealt.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    second = Window.partitionBy("shard", "bucket").orderBy(F.shiftrightunsigned("key", 1), "key", "part", "rank")
    placed = dealt.withColumn("at", F.row_number().over(second) - 1).join(starts, ["shard", "bucket"])
    slot = (F.col("start") + F.col("at")).cast("bigint")
    return placed.select(*[F.col(i).alias(c) for c, i in zip(given, inner)], "shard", slot.alias("slot"))


def write_shards(rows: DataFrame, path: str, n_shards: int, seed: int = 42) -> None:
    """Write the dealt rows as Parquet under ``path``, a folder a shard, each in the order of its slots."""
    dealt = shard_rows(rows, n_shards, seed)
    dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    dealt = shard_rows(rows, 40)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
