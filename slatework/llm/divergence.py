"""Source divergence audit: how the words of each source of a language differ from other sources and from the language."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize

#: Fixed value: a term, on the bytes of a text. All bytes of other characters than ASCII are among them.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A term of so many of a batch's documents is added up by the task, up to HELD of them; counts of terms in a block of the vocabulary.
OFTEN, HELD, BLOCK = 8, 200_000, 20_000
#: Probabilities are whole numbers of this part; terms of a group that are reported.
SCALE, TOP = 1_000_000_000, 10


def _counted(groups: np.ndarray, texts: list[bytes], n_groups: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts, and for each of them in each group its number, the group's, its count and its documents."""
    found = [TERM.findall(t.lower()) for t in texts]  # of bytes: A-Z only
    sizes = [len(f) for f in found]
    coded = pa.array(itertools.chain.from_iterable(found), pa.binary(), size=sum(sizes)).dictionary_encode()
    term, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), sizes)
    # a term's documents side by side, those of a group together
    turn = np.argsort(groups, kind="stable")
    place = np.empty(len(texts), dtype=np.int64)
    place[turn] = np.arange(len(texts))
    pairs, times = np.unique(term * len(texts) + place[doc], return_counts=True)
    keys = pairs // len(texts) * n_groups + groups[turn][pairs % len(texts)]
    begin = np.flatnonzero(np.diff(keys, prepend=-1))
    return coded.dictionary, keys[begin] // n_groups, keys[begin] % n_groups, np.add.reduceat(times, begin) if len(begin) else times, np.diff(np.append(begin, len(keys)))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term in a group and documents that hold it, from parts of the table.

    Tasks add up a batch of texts at a time, and terms that many of its documents hold over all batches, so that no term
    is in more than one row of a task and group by being frequent.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, bytes], list[int]] = {}

        def out() -> pa.RecordBatch:
            langs, sources, terms = zip(*held)
            n, docs = zip(*held.values())
            held.clear()
            return pa.record_batch([pa.array(langs), pa.array(sources), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=schema)

        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            known = list(dict.fromkeys(names))
            number = {g: i for i, g in enumerate(known)}
            terms, code, group, n, holders = _counted(np.array([number[g] for g in names], dtype=np.int64), [t.as_py() for t in batch.column(2)], max(1, len(known)))
            often = np.bincount(code, weights=holders, minlength=len(terms))[code] >= OFTEN if len(code) else np.zeros(0, dtype=bool)
            for c, g, m, d in zip(terms.take(pa.array(code[often])).to_pylist(), group[often].tolist(), n[often].tolist(), holders[often].tolist()):
                sums = held.setdefault((*known[g], c), [0, 0])
                sums[0] += m
                sums[1] += d
            rest = ~often
            if rest.any():
                of = lambda i: pa.array([g[i] for g in known], pa.string()).take(pa.array(group[rest]))
                yield pa.record_batch([of(0), of(1), terms.take(pa.array(code[rest])).cast(pa.string()), pa.array(n[rest]), pa.array(holders[rest])], schema=schema)
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    rows = docs.select(*_group(lang_col, source_col), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _group(lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]


def probability(count: str, total: str, vocabulary: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * vocabulary)), exactly."""
    whole = "cast({} as decimal(19, 0))".format
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * ({whole(count)} + 2)) div ({whole(total)} + 2 * {whole(vocabulary)})")


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of the runs of a column."""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values))[: len(values)]
    return ends, values[ends - 1]


def divergence(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> int:
    """The sum of floor((p - q)² / (p + q)) over two columns given as runs, from each stretch between run ends once."""
    ends = np.union1d(one[0], two[0])
    p, q = one[1][np.searchsorted(one[0], ends)], two[1][np.searchsorted(two[0], ends)]
    return int(((p - q) ** 2 // (p + q) * np.diff(ends, prepend=0)).sum())


def _pairs_of_block(table: pa.Table) -> pa.Table:
    """All pairs of a language's groups in one block of its vocabulary; place 0 holds what a term without a count has."""
    sources, place, p = (table.column(c) for c in ("source", "place", "p"))
    names = np.array(sorted(set(sources.to_pylist())), dtype=object)
    own = np.searchsorted(names, np.array(sources.to_pylist(), dtype=object))
    place, p = place.to_numpy().astype(np.int64), p.to_numpy().astype(np.int64)
    width = int(place.max())
    none = np.zeros(len(names), dtype=np.int64)
    none[own[place == 0]] = p[place == 0]
    held = place > 0
    order = np.argsort(own[held], kind="stable")
    starts = np.searchsorted(own[held][order], np.arange(len(names) + 1))
    at, values = place[held][order] - 1, p[held][order]
    columns = []
    for g in range(len(names)):  # one full column at a time
        column = np.full(width, none[g], dtype=np.int64)
        column[at[starts[g] : starts[g + 1]]] = values[starts[g] : starts[g + 1]]
        columns.append(runs(column))
    found = [(a, b, divergence(columns[a], columns[b]) if width else 0) for a in range(len(names)) for b in range(a)]
    lang = table.column("lang")[0].as_py()
    take = lambda i: pa.array([names[f[i]] for f in found], pa.string())
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "one": take(0), "two": take(1), "value": pa.array([f[2] for f in found], pa.int64())})


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source is from the others of its language, and by which terms.

    A language keeps the terms that ``least_docs`` of its documents hold. Part ``pair`` has each other source with the
    divergence over all kept terms; part ``term`` the ``top`` terms more frequent in the group than in the language.

    The vocabulary of a language is put in an order in which terms with the same counts stand together: by their counts
    in its three largest groups, then by a hash of all counts. It is dealt into blocks of about BLOCK counts. In a block
    each group's column is run-length encoded, and for two groups the value of each stretch between run ends is
    multiplied by its length. Sums over the blocks give the pairs.

    Null texts, languages and sources are empty ones; documents without terms still make their group, whose terms have
    no count; repeated rows count as documents of their own; terms may be as long as the text; equal values are ranked
    by item in order of bytes; a language that keeps no term has pairs of value 0; an empty table gives an empty result.
    """
    groups = docs.select(*_group(lang_col, source_col)).distinct()
    term = Window.partitionBy("lang", "term")
    # one shuffle by term: counts of its groups and documents of its language meet there, and what too few hold goes
    counts = term_counts(docs, lang_col, source_col, text_col).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.withColumn("held", F.sum("docs").over(term)).withColumn("all", F.sum("n").over(term)).where(F.col("held") >= least_docs)
    kept = materialize(kept.select("lang", "term", "source", "n", "all"), "divergence-kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    stats = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "lang_total", "total"])
    largest = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "source"))
    stats = materialize(stats.withColumn("turn", largest), "divergence-groups")

    # terms are ordered by their counts in the three largest groups, then by all of them
    placed = kept.join(stats, ["lang", "source"]).withColumn("p", probability("n", "total", "v"))
    placed = placed.withColumns({f"c{i}": F.coalesce(F.max(F.when(F.col("turn") == i, F.col("n"))).over(term), F.lit(0)) for i in (1, 2, 3)})
    placed = placed.withColumn("alike", F.bit_xor(F.xxhash64("source", "n")).over(term))
    blocks = max(1, -(-kept.count() // BLOCK))
    order = ["lang", "c1", "c2", "c3", "alike", "term"]
    placed = placed.repartitionByRange(blocks, *order).withColumn("blk", F.spark_partition_id())
    placed = materialize(placed.select(*order, "blk", "source", "n", "all", "lang_total", "v", "p"), "divergence-blocks")

    above = placed.withColumn("q", probability("all", "lang_total", "v")).where("p > q")
    value = F.expr("(p - q) * (p - q) div (p + q)")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = above.select("lang", "source", "term", value.alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # what a group has where it has no count, for every block of its language; a language without terms has one empty block
    none = stats.join(placed.select("lang", "blk").distinct(), "lang", "left").withColumn("blk", F.coalesce("blk", F.lit(0)))
    none = none.select("lang", "blk", "source", F.when(F.col("v") > 0, probability("0", "total", "v")).otherwise(1).alias("p"), *[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in order[1:]])
    both = none.unionByName(placed.select("lang", "blk", "source", "p", *order[1:]))
    at = F.dense_rank().over(Window.partitionBy("lang", "blk").orderBy(*order[1:]))  # nulls come first
    found = both.select("lang", "blk", "source", "p", (at - 1).alias("place")).groupBy("lang", "blk").applyInArrow(_pairs_of_block, "lang string, one string, two string, value bigint")
    sums = found.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))
    pairs = sums.select("lang", F.inline(ways), "value")
    far = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(far).alias("rank"))
    result = materialize(pairs.unionByName(terms), "divergence")
    discard(kept, stats, placed)
    return result


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
