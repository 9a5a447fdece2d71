"""Sum-of-squares online packing of token sequences into windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import byte_bpe, default_files
from .common import materialize

#: About so many pieces are packed by one task, one after the other; tasks pack side by side. What a group leaves
#: open at its end is padding, and grows more slowly than the group.
GROUP_PIECES = 16_000
#: Sequences are numbered through so many groups at a time by tasks; the driver adds up what they give.
BLOCK_GROUPS = 4_096

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, window: int = 1024, end_id: int = 0, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with ``end_id`` appended, cut at multiples of ``window``: a row per piece.

    A null or empty text is the end id alone, so it has one piece; a very long one has many. Ids stay in the
    task: a piece carries its place, length and crc32. Repeated rows keep a set of pieces each.
    """
    files = files or default_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(*files)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([bpe.ids(text or ""), end])
                raw = memoryview(ids.tobytes())
                n = len(ids)
                for at in range(0, n, window):
                    size = min(window, n - at)
                    out.append((doc, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n))
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


class SumOfSquares:
    """Open windows by fill level; an item goes to the level that keeps the sum of squared counts least.

    ``count[h]`` is how many windows are filled to ``h`` and neither empty nor full. Putting an item of size s
    on level h takes one from ``count[h]`` and gives one to ``count[h + s]``; a new window is level 0 and a full
    one counts no more. Ties go to the fuller level. Memory is the level array and the open windows' numbers.
    """

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """The number of the window, from 0, and the offset in it."""
        room = self.window - size
        gain = 2 * self.count[size : self.window + 1]  # of levels 0 to room, times two: what stands where it would go
        gain[-1] = -1  # a window that gets full leaves the sum
        cost = gain - 2 * self.count[: room + 1] + 2
        cost[self.count[: room + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = gain[0] + 1
        level = room - int(np.argmin(cost[::-1]))
        if level == 0:
            number, self.made = self.made, self.made + 1
        else:
            number = self.open[level].pop()
            self.count[level] -= 1
        if level + size < self.window:
            self.open[level + size].append(number)
            self.count[level + size] += 1
        return number, level


def pack_pieces(rows: DataFrame, window: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack ``rows`` of ``pieces`` into sequences: ``sequence_id`` (gapless from 0) and ``offset`` are added.

    Groups of about ``group_pieces`` pieces, dealt by a hash of the piece, are packed independently, each in
    the order of that hash. Only the number of sequences of each BLOCK_GROUPS groups goes to the driver. An empty
    table gives an empty table.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "packing-pieces")
    groups = max(1, round(rows.count() / group_pieces))
    keyed = rows.withColumn("_key", F.xxhash64("doc_id", "start", "ids_crc32"))
    # a row that repeats very often would put its copies in one group: the place in the table splits them
    keyed = keyed.withColumn("_group", F.pmod(F.xxhash64("_key", F.monotonically_increasing_id()), F.lit(groups)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_key", "doc_id", "start"], kind="stable")
        packer = SumOfSquares(window)
        found = [packer.place(size) for size in group["length"].tolist()]
        group["_sequence"] = [a for a, _ in found]
        group["offset"] = [b for _, b in found]
        return group.drop(columns="_key")

    packed = keyed.groupBy("_group").applyInPandas(pack, PIECES + ", _group bigint, _sequence bigint, offset bigint")
    packed = materialize(packed, "packing-sequences")
    made = packed.groupBy("_group").agg((F.max("_sequence") + 1).alias("_made")).withColumn("_block", F.floor(F.col("_group") / BLOCK_GROUPS))
    starts, before = [], 0
    for block, n in sorted((r[0], r[1]) for r in made.groupBy("_block").agg(F.sum("_made")).collect()):
        starts.append((block, before))
        before += n
    upto = Window.partitionBy("_block").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    inner = made.select("_group", "_block", F.coalesce(F.sum("_made").over(upto), F.lit(0)).alias("_inner"))
    first = inner.join(spark.createDataFrame(starts, "_block bigint, _outer bigint"), "_block").select("_group", (F.col("_inner") + F.col("_outer")).alias("_before"))
    return packed.join(first, "_group").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("_sequence")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, window: int = 1024, end_id: int = 0, files: tuple[str, str] | None = None) -> DataFrame:
    """Pack whole documents: the rows of ``pieces`` with the sequence and the offset of each."""
    return pack_pieces(pieces(docs, window, end_id, files), window)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
