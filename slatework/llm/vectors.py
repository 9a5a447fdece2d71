"""Blocks of queries against blocks of candidate vectors: what both vector searches share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Candidates of one group and queries of one block; a task holds one of each.
GROUP_ROWS, QUERY_ROWS = 8_192, 4_096
#: Rows of vectors that travel as one row.
BUNDLE = 512


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, vec)`` without null or empty vectors and those with null or non-finite components; vec as doubles."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & ~bad)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written with a number for each, ``row``, by which a query is told from other rows of its id."""
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), name)


def bundles(rows: DataFrame, keys: list[str], columns: list[str], encode: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows ``(key..., id, row, vec, column...)`` gathered by task: a row per up to BUNDLE of them with equal keys and lengths.

    ids, rows, vecs, codes and the numeric columns become binary arrays: bigints, double matrix by rows of ``dim``, what
    ``encode`` makes of the matrix, and doubles.
    """
    names = keys + ["dim", "ids", "rows", "vecs", "codes"] + columns
    schema = ", ".join([f"{k} bigint" for k in [*keys, "dim"]] + [f"{c} binary" for c in names[len(keys) + 1 :]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            frame["dim"] = frame["vec"].map(len)
            for key, group in frame.groupby([*keys, "dim"], sort=True):
                for at in range(0, len(group), BUNDLE):
                    part = group.iloc[at : at + BUNDLE]
                    matrix = np.stack(part["vec"].to_numpy()).astype(np.float64)
                    values = [[int(k)] for k in key]
                    values += [[part["id"].to_numpy(np.int64).tobytes()], [part["row"].to_numpy(np.int64).tobytes()], [matrix.tobytes()], [b"" if encode is None else encode(matrix).tobytes()]]
                    values += [[part[c].to_numpy(np.float64).tobytes()] for c in columns]
                    yield pa.record_batch([pa.array(v, pa.int64() if i <= len(keys) else pa.binary()) for i, v in enumerate(values)], names=names)

    select = [F.col(k).cast("bigint").alias(k) for k in keys] + ["id", "row", "vec"] + columns
    return rows.select(*select).mapInArrow(run, schema)


class Block(NamedTuple):
    """Bundled rows of one length: ids, numbers, the matrix of vectors, their codes as bytes, and the columns."""

    ids: np.ndarray
    rows: np.ndarray
    vecs: np.ndarray
    codes: np.ndarray
    columns: list[np.ndarray]


def by_length(frame: pd.DataFrame, columns: list[str]) -> list[Block]:
    """The bundles of a task as one block for each length of vectors."""
    out = []
    for dim, own in frame.groupby("dim"):
        def joined(name: str, kind: type, own: pd.DataFrame = own) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, dtype=kind) for x in own[name]])

        ids = joined("ids", np.int64)
        out.append(Block(ids, joined("rows", np.int64), joined("vecs", np.float64).reshape(-1, dim), joined("codes", np.uint8).reshape(len(ids), -1), [joined(c, np.float64) for c in columns]))
    return out


Search = Callable[[Block, Block], tuple[np.ndarray, np.ndarray, np.ndarray]]


def dealt_queries(queries: DataFrame, blocks: int) -> DataFrame:
    """Queries with ``blk``, dealt by their hash."""
    return queries.withColumn("blk", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("bigint"))


def search_blocks(queries: DataFrame, candidates: DataFrame, columns: list[str], search: Search, score: str) -> DataFrame:
    """``(row, query_id, vec_id, score)``: what ``search`` finds for each block of queries in each group of candidates.

    ``queries`` are bundles with ``blk`` and ``grps``, the groups that they have to see, and ``candidates`` are
    bundles with ``grp`` and ``blks``; every block meets every group of its list in one task, so memory is bound by the
    two. Vectors of different lengths meet as if the shorter one had zeros at its end: ``search`` gets, for each pair
    of lengths, both blocks cut to the shorter one, and returns places of queries, ids of candidates and scores.
    """
    asked = queries.withColumn("grp", F.explode("grps")).drop("grps")
    held = candidates.withColumn("blk", F.explode("blks")).drop("blks")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, dtype=np.int64)
        found = [(none, none, none, np.zeros(0))]
        for q in by_length(left, columns):
            for c in by_length(right, []):
                dim = min(q.vecs.shape[1], c.vecs.shape[1])
                cut = [b if b.vecs.shape[1] == dim else b._replace(vecs=np.ascontiguousarray(b.vecs[:, :dim]), codes=b.codes[:, :0]) for b in (q, c)]
                at, ids, scores = search(*cut)
                at = np.asarray(at, dtype=np.int64)
                found.append((q.rows[at], q.ids[at], ids, scores))
        rows, q, v, s = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"row": rows, "query_id": q, "vec_id": v.astype(np.int64), "score": s.astype(np.int64 if score == "bigint" else np.float64)})

    return asked.groupBy("grp", "blk").cogroup(held.groupBy("grp", "blk")).applyInPandas(run, f"row bigint, query_id bigint, vec_id bigint, score {score}")


def every(n: int, name: str) -> Column:
    """All numbers below ``n``, as the list of a bundle."""
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")).alias(name)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each asking row, ties to the smaller id, with their rank from 1."""
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def pick(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, in that order."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
