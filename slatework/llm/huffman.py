"""Token ids on disk: canonical length-limited Huffman codes in independent blocks with checkpoints."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import byte_bpe, default_files
from .common import bounded_batches, discard, materialize, pack, shared_dir, shuffle_partitions, unpack

#: Tokens from one checkpoint to the next, and payload bytes at which a block ends.
CHECKPOINT, BLOCK_BYTES = 512, 1 << 20
MAX_BITS = 16
#: Tokens that are coded at a time, and bytes of ids in a batch that a task reads or gives.
STRETCH, BATCH_BYTES = 1 << 16, 2 << 20

TOKENS = "doc_id bigint, ids binary"
CODED = "doc_id bigint, part int, n bigint, bits binary, checkpoints binary"
BLOCKS = "part int, block int, start bigint, n bigint, first_doc bigint, last_doc bigint, index binary, payload binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits by package-merge; 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    max_bits = max(max_bits, math.ceil(math.log2(len(used))))
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    # each level merges the coins with the pairs of the level below; how many coins of each level are taken suffices
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))
        merged = merged[order]
        packages = merged[0 : len(merged) - 1 : 2] + merged[1::2]
    take = 2 * len(used) - 2
    for is_coin in reversed(levels):
        coins = int(is_coin[:take].sum())
        lengths[used[:coins]] += 1
        take = 2 * (take - coins)
    return lengths


class Codes:
    """Canonical codes from code lengths: shorter codes first, then smaller symbols."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        sized = self.lengths[order]
        self.bits = int(sized.max(initial=1))
        steps = np.left_shift(np.int64(1), self.bits - sized)
        starts = np.cumsum(steps) - steps
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[order] = (starts >> (self.bits - sized)).astype(np.uint64)
        self.symbol = np.zeros(1 << self.bits, dtype=np.uint32)
        self.size = np.zeros(1 << self.bits, dtype=np.int64)
        self.symbol[: int(steps.sum())] = np.repeat(order.astype(np.uint32), steps)
        self.size[: int(steps.sum())] = np.repeat(sized, steps)

    def encode(self, documents: list[np.ndarray]) -> list[tuple[bytes, np.ndarray]]:
        """Each document's bits, padded to whole bytes, and the bit offset of every CHECKPOINT-th token.

        Works on STRETCH tokens at a time, so that what it needs besides ids and bits doesn't grow with them.
        """
        counts = np.array([len(d) for d in documents])
        ids = np.concatenate(documents)
        ends = np.cumsum(counts)
        n_bits = np.zeros(len(documents), dtype=np.int64)
        for at in range(0, len(ids), STRETCH):
            doc = np.searchsorted(ends, np.arange(at, min(at + STRETCH, len(ids))), side="right")
            n_bits += np.bincount(doc, weights=self.lengths[ids[at : at + STRETCH]], minlength=len(documents)).astype(np.int64)
        doc_bytes = (n_bits + 7) // 8
        doc_start = np.cumsum(doc_bytes) - doc_bytes
        padding = 8 * doc_start - (np.cumsum(n_bits) - n_bits)
        out = np.zeros(int(doc_bytes.sum()) // 4 + 2, dtype=np.uint64)
        marks, before = [], 0
        for lo in range(0, len(ids), STRETCH):
            place = np.arange(lo, min(lo + STRETCH, len(ids)))
            doc = np.searchsorted(ends, place, side="right")
            size = self.lengths[ids[lo : lo + STRETCH]]
            at = before + np.cumsum(size) - size + padding[doc]
            before += int(size.sum())
            marks.append((at - 8 * doc_start[doc])[(place - ends[doc] + counts[doc]) % CHECKPOINT == 0])
            word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
            value = self.codes[ids[lo : lo + STRETCH]] << shift
            runs = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
            out[word[runs]] += np.add.reduceat(value >> np.uint64(32), runs)
            out[word[runs] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), runs)
        raw = out.astype(">u4").tobytes()
        own = np.split(np.concatenate(marks) if marks else np.zeros(0, dtype=np.int64), np.cumsum(-(-counts // CHECKPOINT))[:-1])
        return [(raw[a : a + n], m) for a, n, m in zip(doc_start.tolist(), doc_bytes.tolist(), own)]

    def decode(self, payload: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of all stretches, one after the other; ``starts`` are bit offsets and ``sizes`` counts of tokens.

        A table of all prefixes gives the symbol and its length. The stretches between checkpoints are
        independent, so they advance together, a token each a step.
        """
        raw = np.frombuffer(payload + bytes(8), dtype=np.uint8).astype(np.uint32)
        window = raw[:-3] << 24
        window |= raw[1:-2] << 16
        window |= raw[2:-1] << 8
        window |= raw[3:]
        order = np.argsort(-sizes, kind="stable")
        at, place = starts[order].astype(np.int64), (np.cumsum(sizes) - sizes)[order]
        active = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
        out = np.empty(int(sizes.sum()), dtype="<u4")
        mask = (1 << self.bits) - 1
        for step, n in enumerate(active.tolist()):
            pos = at[:n]
            key = (window[pos >> 3] >> (32 - self.bits - (pos & 7)).astype(np.uint32)) & mask
            out[place[:n] + step] = self.symbol[key]
            pos += self.size[key]
        return out


def decode_block(codes: Codes, index: bytes, payload: bytes, limit: int = 4 * STRETCH) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents of a block in order, their counts of tokens and all their ids: as many as have ``limit`` tokens, or a longer one."""
    docs, ns, sizes, marks = unpack(index)
    stretches = -(-ns // CHECKPOINT)
    before, bits_at, mark_at = (np.concatenate([[0], np.cumsum(x)]) for x in (ns, sizes, stretches))
    lo = 0
    while lo < len(docs):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + limit, side="right")) - 1)
        own = slice(mark_at[lo], mark_at[hi])
        starts = marks[own].astype(np.int64) + np.repeat(8 * (bits_at[lo:hi] - bits_at[lo]), stretches[lo:hi])
        counts = np.full(len(starts), CHECKPOINT, dtype=np.int64)
        counts[mark_at[lo + 1 : hi + 1] - mark_at[lo] - 1] = ns[lo:hi] - CHECKPOINT * (stretches[lo:hi] - 1)
        yield docs[lo:hi], ns[lo:hi], codes.decode(payload[bits_at[lo] : bits_at[hi]], starts, counts)
        lo = hi


def encode_ids(docs: DataFrame, end_id: int = 0, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every row with ``end_id`` appended, as unsigned 16-bit integers; larger ids are an error.

    Null and empty texts are the end id alone; very long ones are encoded a stretch at a time; repeated rows stay.
    """
    files = files or default_files()
    bounded_batches(docs.sparkSession, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(*files)
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                ids = bpe.ids(text or "")
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError(f"id {ids.max()} does not fit 16 bits")
                found.append(ids.astype("<u2").tobytes() + end)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, TOKENS)


def global_counts(tokens: DataFrame, vocabulary: int = 1 << 16) -> np.ndarray:
    """How often each id occurs in ``tokens``; tasks count, the driver gets a row per id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, dtype="<u2"), minlength=vocabulary) if len(ids) > 65536 else 0
            short = b"".join(ids for ids in batch.column(0).to_pylist() if len(ids) <= 65536)
            total += np.bincount(np.frombuffer(short, dtype="<u2"), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "n"])

    found = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect()
    counts = np.zeros(vocabulary, dtype=np.int64)
    for symbol, n in found:
        counts[symbol] = n
    return counts


def write_ids(tokens: DataFrame, path: str) -> None:
    """Write ``tokens(doc_id, ids)`` in ascending order of doc_id: ``path``/codes, /blocks and /parts.

    codes has the length of every id's code, from which the canonical codes follow. A row of blocks is one
    block: whole documents in order, its payload, and an index of documents, token counts and the bit offset of
    every CHECKPOINT-th token; each can be decoded by itself. parts has the tokens before each part. Null ids
    come first, equal ones in any order. An empty table gives files without blocks.
    """
    spark = tokens.sparkSession
    bounded_batches(spark, BATCH_BYTES)
    lengths = code_lengths(global_counts(tokens))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id bigint, bits int").coalesce(1).write.parquet(f"{path}/codes")
    n_parts = shuffle_partitions(spark)
    cuts = np.array(tokens.approxQuantile("doc_id", [i / n_parts for i in range(1, n_parts)], 0.1 / n_parts) if n_parts > 1 else [], dtype=np.float64)
    cuts = np.unique(cuts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(lengths)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                coded = codes.encode([np.frombuffer(x, dtype="<u2") for x in batch.column(1).to_pylist()])
                doc = batch.column(0).to_pylist()
                yield pa.record_batch(
                    [
                        batch.column(0),
                        pa.array([0 if d is None else int(np.searchsorted(cuts, d, side="right")) for d in doc], pa.int32()),
                        pa.array([len(x) // 2 for x in batch.column(1).to_pylist()], pa.int64()),
                        pa.array([bits for bits, _ in coded], pa.binary()),
                        pa.array([marks.astype("<u4").tobytes() for _, marks in coded], pa.binary()),
                    ],
                    names=["doc_id", "part", "n", "bits", "checkpoints"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, held, size = None, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            docs, ns, bits, marks = zip(*held)
            index = pack((list(docs), np.array(ns), np.array([len(b) for b in bits]), np.concatenate(marks)))
            row = (part, block, start, sum(ns), docs[0], docs[-1], index, b"".join(bits))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "block", "start", "n", "first_doc", "last_doc", "index", "payload"])

        for batch in batches:
            for doc, own, n, bits, marks in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and (own != part or size >= BLOCK_BYTES):
                    yield out()
                    block, start = block + 1, start + sum(h[1] for h in held)
                    held, size = [], 0
                if own != part:
                    part, block, start = own, 0, 0
                held.append((doc, n, bits, np.frombuffer(marks, dtype="<u4")))
                size += len(bits)
        if held:
            yield out()

    coded = tokens.mapInArrow(code, CODED).repartition(n_parts, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"))
    coded.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    sums = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect()
    rows, before = [], 0
    for part, n in sorted((r[0], r[1]) for r in sums):  # a row a part of the table
        rows.append((part, before, n))
        before += n
    spark.createDataFrame(rows, "part int, before bigint, n bigint").coalesce(1).write.parquet(f"{path}/parts")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document in the files: its place among all ids, and its ids as 32-bit integers."""
    table = spark.read.schema("id bigint, bits int").parquet(f"{path}/codes").collect()
    lengths = np.zeros(max([r[0] for r in table], default=0) + 1, dtype=np.uint8)
    for symbol, bits in table:
        lengths[symbol] = bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(lengths)
        for batch in batches:
            for part, start, index, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for docs, ns, found in decode_block(codes, index, payload):
                    raw, ends = found.tobytes(), np.cumsum(ns)  # pyarrow never lets go of memoryviews
                    ids = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), ns.tolist())]
                    yield pa.record_batch(
                        [pa.array(docs, pa.int64()), pa.array([part] * len(docs), pa.int32()), pa.array(start + ends - ns, pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "part", "start", "ids"],
                    )
                    start += int(ends[-1])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("part", "start", "index", "payload")
    found = blocks.mapInArrow(run, "doc_id bigint, part int, start bigint, ids binary")
    parts = spark.read.schema("part int, before bigint, n bigint").parquet(f"{path}/parts").drop("n")
    return found.join(parts, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "ids")


def op5_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = materialize(encode_ids(spark.read.parquet(f"{sf_dir}/documents.parquet")), "huffman-tokens")
    path = f"{shared_dir(spark)}/slatework/huffman-{uuid.uuid4().hex}"
    write_ids(tokens, path)
    discard(tokens)
    ids = read_ids(spark, path)
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
