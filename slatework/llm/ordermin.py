"""Order MinHash fingerprints: minimal occurrence-numbered k-mers in text order, sensitive to edits."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions

#: Code points of a k-mer (a power of two), tuples of a fingerprint, and k-mers of a tuple.
K, TUPLES, LENGTH = 8, 64, 2
#: K-mers that are ordered by all orders at once.
STRETCH = 1 << 13
#: What a null id is ordered as.
NO_ID = -(1 << 63)

#: Odd numbers that mix 64 bits.
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@functools.cache
def orders(n: int) -> np.ndarray:
    """Odd multipliers of 32 bits, each of which orders mixed hashes anew."""
    return np.random.default_rng(12).integers(1 << 31, size=n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def numbered_kmers(points: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-mers at all places, and 32-bit ones that also hold how often the k-mer came before.

    A text of fewer than k code points is a single k-mer of its own; an empty one has none.
    """
    if not len(points):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
    grams = points.astype(np.uint64)
    if len(grams) < k:
        grams = np.array([hash_of(grams.tolist())], dtype=np.uint64)
    else:
        grams, width, factor = grams + _M3, 1, int(_M1)
        while width < k:  # sums over twice as many code points from two neighbours, each with factors of its own
            grams = grams[:-width] * np.uint64(factor) + grams[width:]
            width, factor = width * 2, factor * int(_M2) % (1 << 64)
        grams = _mix(grams)
    n = len(grams)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    # equal k-mers side by side, in text order: the upper bits of the hash with the place below
    order = np.sort((grams & ~low) | np.arange(n, dtype=np.uint64))
    group = order >> bits
    begin = np.zeros(n, dtype=np.int64)
    new = np.flatnonzero(group[1:] != group[:-1]) + 1
    begin[new] = new
    np.maximum.accumulate(begin, out=begin)
    before = np.empty(n, dtype=np.uint64)
    before[(order & low).astype(np.int64)] = np.arange(n, dtype=np.int64) - begin
    return grams, (_mix(grams ^ (before * _M1 + _M3)) >> np.uint64(32)).astype(np.uint32)


def hash_of(values: list[int]) -> int:
    """64 bits of a short list of numbers."""
    return int.from_bytes(hashlib.blake2b(b"".join(v.to_bytes(8, "little") for v in values), digest_size=8).digest(), "little")


def signature(points: np.ndarray, k: int = K, tuples: int = TUPLES, length: int = LENGTH) -> np.ndarray:
    """``tuples`` hashes of a text's code points.

    Under each order the ``length`` smallest numbered k-mers are selected, put back into text order and hashed
    together. With fewer k-mers than that all are taken; an empty text has zeros. Ties go to the earlier place.
    """
    grams, numbered = numbered_kmers(points, k)
    n, seeds = len(grams), orders(tuples)
    if not n:
        return np.zeros(tuples, dtype=np.uint32)
    take = min(length, n)
    buffer = np.empty(tuples * min(n, STRETCH), dtype=np.uint32)
    values, places = np.zeros((tuples, 0), dtype=np.uint32), np.zeros((tuples, 0), dtype=np.int64)
    every = np.arange(tuples)
    for begin in range(0, n, STRETCH):
        part = numbered[begin : begin + STRETCH]
        ranks = buffer[: tuples * len(part)].reshape(tuples, len(part))
        np.multiply(part[None, :], seeds[:, None], out=ranks)
        low, at = [], []
        for _ in range(min(take, len(part))):
            at.append(ranks.argmin(axis=1))
            low.append(ranks[every, at[-1]])
            ranks[every, at[-1]] = np.iinfo(np.uint32).max
        values, places = np.column_stack([values, *low]), np.column_stack([places, *(a + begin for a in at)])
        if values.shape[1] > take:
            best = np.argsort(values, axis=1, kind="stable")[:, :take]
            values, places = np.take_along_axis(values, best, 1), np.take_along_axis(places, best, 1)
    places.sort(axis=1)
    chosen = grams[places]
    found = np.full(tuples, _M3, dtype=np.uint64)
    for column in range(take):
        found = _mix(found * _M1 + chosen[:, column])
    return (found >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal tuples."""
    return float((a == b).mean())


def _text(signature_: np.ndarray) -> str:
    return signature_.astype(">u4").tobytes().hex()


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(chunk, late, id, text)`` of every row, in partitions sorted so that each row stands before the next document.

    Documents are ordered by descending id, equal ids by text, null ids last. They are dealt into chunks of successive
    ids, one to a partition, at quantiles of the ids; texts are shuffled once. The row that follows a chunk comes to its
    end too, marked ``late``; after the last document the first one follows. Rows of one id are in one chunk.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text.alias("text"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(NO_ID)))
    parts = max(1, shuffle_partitions(spark))
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    bounds = np.unique(np.array(cuts[: parts - 1], dtype=np.int64))

    @F.pandas_udf("int")
    def chunk_of(key: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, key.to_numpy(np.int64), side="left")).astype(np.int32))

    # one number for every chunk
    firsts = sorted((r[0], r[1]) for r in rows.select("key", chunk_of("key").alias("chunk")).groupBy("chunk").agg(F.max("key")).collect())
    leads = np.array([first for _, first in firsts][::-1], dtype=np.int64)  # ascending ids
    before = np.array([firsts[i - 1][0] for i in range(len(firsts))][::-1], dtype=np.int32)

    @F.pandas_udf("int")
    def follows(key: pd.Series) -> pd.Series:
        """The chunk that a row is the next document of, if it is the first of its own."""
        own = key.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(leads, own), len(leads) - 1)
        return pd.Series(before[at]).where(pd.Series(leads[at] == own)).astype("Int32")

    places = rows.select("id", "text", chunk_of("key").alias("own"), follows("key").alias("other"))
    both = F.array(F.struct(F.col("own").alias("chunk"), F.lit(False).alias("late")), F.struct(F.col("other").alias("chunk"), F.lit(True).alias("late")))
    dealt = places.select("id", "text", F.inline(F.filter(both, lambda p: p["chunk"].isNotNull())))
    return dealt.repartitionById(len(bounds) + 1, F.col("chunk")).sortWithinPartitions("chunk", "late", F.desc_nulls_last("id"), "text").select("chunk", "late", "id", "text")


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, tuples: int = TUPLES, length: int = LENGTH) -> DataFrame:
    """``(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)`` of every row.

    ``edited`` is the sha256 of the text whose last half (rounded down) is replaced by as many code points, or all, of
    the next document in descending order of ids, the first one after the last. Fingerprints are Order MinHashes in
    hexadecimal, and likeness is the share of equal tuples: about the weighted Jaccard similarity of k-mers to the power
    of ``length``, less where their order differs.

    Null texts are empty: they have zeros as fingerprint and are like each other alone. A null id comes last, equal ids
    in order of their texts; repeated rows stay and follow each other; a single document follows itself; an empty table
    gives an empty result. A task streams its rows and holds two texts at a time, about 60 bytes for each code point.
    """
    if k & (k - 1):
        raise ValueError("k must be a power of two")
    bounded_batches(docs.sparkSession, 4 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        rows = ((c.as_py(), late.as_py(), i.as_py(), t.as_py()) for b in batches for c, late, i, t in zip(*b.columns))
        found = []
        batch = lambda: pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)], names=names)
        for _, own in itertools.groupby(rows, key=lambda r: r[0]):
            held = None
            for _, late, i, text in own:
                points = codes(text)
                print_ = signature(points, k, tuples, length)
                if held:
                    found.append(compare(*held, points, print_))
                    if len(found) == 512:
                        yield batch()
                        found = []
                held = (i, points, print_)
                if late:  # no other row follows
                    break
        if found:
            yield batch()

    def compare(i: int | None, points: np.ndarray, own: np.ndarray, after: np.ndarray, next_: np.ndarray) -> tuple:
        half = len(points) // 2
        edited = np.concatenate([points[: len(points) - half], after[:half]])
        other = signature(edited, k, tuples, length)
        digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        return i, len(points), digest, _text(own), _text(other), likeness(own, other), likeness(own, next_)

    schema = "id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs, id_col, text_col).mapInArrow(run, schema)


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnsRenamed({"id": "doc_id", "edited": "edited_sha256"})
