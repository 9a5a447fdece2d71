"""Greedy batches of a deck's pages, found for all stretches of a deck at the same time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored

#: Pages of a stretch; the result does not depend on it.
STRETCH = 4_096
#: Rows of a partition have numbers of so many bits below the partition's own.
ROW_BITS = 33


def positions(pages: DataFrame) -> DataFrame:
    """``(deck, page_key, size, pos)``: pages with their place in the deck from 0, without bringing a deck into one task.

    Pages are sorted by ranges; a place in the range plus what lies in the ranges before it is the place in the deck.
    """
    order = ["deck", "page_key", "size"]
    rows = pages.select("deck", "page_key", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("part", F.shiftright("row", ROW_BITS))
    own = ranged.groupBy("deck", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("deck").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    own = own.select(F.col("deck").alias("of"), F.col("part").alias("at"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    here = F.col("deck").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))
    return ranged.join(own, here).select(*order, (F.col("row") - F.col("first") + F.col("before")).alias("pos"))


def next_starts(sizes: np.ndarray, own: int, most_chars: int, most_pages: int) -> np.ndarray:
    """For each of the first ``own`` pages, the place where the batch that begins with it ends."""
    total = np.cumsum(sizes)
    before = total - sizes
    at = np.arange(own)
    end = np.searchsorted(total, before[:own] + most_chars, side="right")
    return np.clip(end, at + 1, at + most_pages)


def stretches(pages: DataFrame, most_chars: int, most_pages: int) -> DataFrame:
    """A row for each stretch ``(deck, stretch, page_keys, sizes, nexts, exits, counts)``.

    nexts are places from the stretch's begin; a page may begin a batch that ends up to ``most_pages`` later, so a stretch
    also sees that many pages of the next one. exits says, for a batch that begins at each of the first places, where in
    the next stretch the first batch begins, and counts how many begin here.
    """
    length = max(STRETCH, most_pages)
    number = F.expr(f"pos div {length}")
    ahead = F.when((F.col("pos") % length < most_pages) & (F.col("pos") >= length), F.array(number, number - 1)).otherwise(F.array(number))
    rows = pages.select("deck", "page_key", "size", "pos", F.explode(ahead).alias("stretch"))

    def run(table: pa.Table) -> pa.Table:
        stretch = table.column("stretch")[0].as_py()
        place = table.column("pos").to_numpy() - stretch * length
        order = np.argsort(place, kind="stable")
        sizes = table.column("size").to_numpy()[order]
        n = int((place < length).sum())
        nexts = next_starts(sizes, n, most_chars, most_pages)
        # from each page on to the first begin beyond the stretch, by jumps of doubling length
        jump, steps = np.append(nexts, np.arange(n, n + most_pages + 1)), np.append(np.ones(n, dtype=np.int64), np.zeros(most_pages + 1, dtype=np.int64))
        while (jump[:n] < n).any():
            jump, steps = jump[jump], steps + steps[jump]
        entries = np.minimum(np.arange(most_pages), n)
        keys = table.column("page_key").to_numpy()[order][:n]
        whole = lambda values, kind: pa.array([values.tolist()], pa.list_(kind))
        return pa.table({
            "deck": table.column("deck")[:1], "stretch": pa.array([stretch], pa.int64()), "page_keys": whole(keys, pa.int64()), "sizes": whole(sizes[:n], pa.int64()),
            "nexts": whole(nexts, pa.int32()), "exits": whole(jump[entries] - n, pa.int32()), "counts": whole(steps[entries], pa.int64()),
        })

    return rows.groupBy("deck", "stretch").applyInArrow(run, "deck string, stretch bigint, page_keys array<bigint>, sizes array<bigint>, nexts array<int>, exits array<int>, counts array<bigint>")


def entries(found: DataFrame) -> DataFrame:
    """``(deck, stretch, entry, batches)``: the first place of each stretch where a batch begins, and how many began before.

    What stretches do to the place of entry is put together for two, four, eight of them and so on, all at the same time;
    a deck needs as many rounds as doublings make its number of stretches.
    """
    longest = found.agg(F.max("stretch")).first()[0]
    done, width = found.select("deck", "stretch", "exits", "counts"), 1
    while longest is not None and width <= longest:
        other = done.select(F.col("deck").alias("of"), (F.col("stretch") + width).alias("at"), F.col("exits").alias("before"), F.col("counts").alias("begun"))
        both = done.join(other, F.col("deck").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at")), "left")
        exits = F.transform("before", lambda e: F.get("exits", e))
        counts = F.transform("before", lambda e, i: F.get("begun", i) + F.get("counts", e))
        done = stored(both.select("deck", "stretch", F.coalesce(exits, "exits").alias("exits"), F.coalesce(counts, "counts").alias("counts")))
        width *= 2
    after = done.select("deck", (F.col("stretch") + 1).alias("stretch"), F.get("exits", F.lit(0)).alias("entry"), F.get("counts", F.lit(0)).alias("batches"))
    return after.where(F.col("stretch") <= F.lit(longest if longest is not None else -1))


def batches(pages: DataFrame, most_chars: int = 48_000, most_pages: int = 20) -> DataFrame:
    """Greedy batches of ``pages(deck, page_key, size)`` in page order: ``batch`` from 0 in each deck.

    A batch is closed when the next page would take it over ``most_chars`` or it has ``most_pages``; a page over the
    limit is a batch alone. Where a batch ends follows from its first page and the pages right after it. So all stretches
    of a deck are looked at in parallel for every place at which a batch may begin, and what is known of them is put
    together in log rounds. A null size is 0; pages of equal keys are ordered by size; an empty table gives an empty one.
    """
    found = stored(stretches(positions(pages), most_chars, most_pages))
    begun = entries(found).select(F.col("deck").alias("of"), F.col("stretch").alias("at"), "entry", "batches")
    rows = found.join(begun, F.col("deck").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at")), "left")

    def walk(tables):
        for batch in tables:
            out = []
            for deck, keys, sizes, nexts, entry, before in zip(*(batch.column(i).to_pylist() for i in range(6))):
                starts = np.zeros(len(keys), dtype=np.int64)
                at = entry
                while at < len(keys):
                    starts[at] = 1
                    at = nexts[at]
                numbers = before - 1 + np.cumsum(starts)
                out.append(pa.table({"deck": pa.array([deck] * len(keys), pa.string()), "page_key": pa.array(keys, pa.int64()), "size": pa.array(sizes, pa.int64()), "batch": pa.array(numbers)}))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    none = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    joined = rows.select("deck", "page_keys", "sizes", "nexts", none("entry", "int"), none("batches", "bigint"))
    return joined.mapInArrow(walk, "deck string, page_key bigint, size bigint, batch bigint")
