"""Token counts from counts of distinct pre-tokens, without the ids of any text."""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pack, shuffle_partitions, unpack

#: A chunk of documents ends at so many bytes of text; its distinct pre-tokens are asked for once.
CHUNK_BYTES = 24 << 20
SPACE = "▁"
RUNS = re.compile(r" *[^ ]+| +")

FREQUENCIES, WORDS = 0, 1


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text: white-space marks and what follows them up to the next, the first mark left out.

    The library puts a mark before the text and one for every space, and no piece has a mark after another
    character (``check_pieces``), so no merge crosses a place where a mark follows something else. The mark that
    is left out is the one that the library puts in when it encodes the pre-token by itself. Two or more spaces
    at the end of a text are one pre-token; a single one there is the pre-token SPACE, counted as one mark.
    """
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] or SPACE for run in RUNS.findall(" " + text)]


def check_pieces(pieces: list[str]) -> None:
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece has a white-space mark after another character: texts can't be cut there")


@functools.cache
def processor(model_file: str) -> sentencepiece.SentencePieceProcessor:
    found = sentencepiece.SentencePieceProcessor(model_file=model_file)
    check_pieces([found.id_to_piece(i) for i in range(found.get_piece_size())])
    return found


def count_pieces(model_file: str, words: list[str]) -> np.ndarray:
    """Tokens of each pre-token, as the library counts them."""
    found = processor(model_file)
    lone = [w == SPACE for w in words]
    ids = found.encode(["" if x else w for w, x in zip(words, lone)], num_threads=1)
    return np.array([1 if x else len(i) for i, x in zip(ids, lone)], dtype=np.uint32)


class _Chunk:
    """Documents of one task, up to CHUNK_BYTES: their pre-token frequencies over the chunk's own vocabulary."""

    def __init__(self):
        self.docs, self.sizes, self.ends, self.at, self.times, self.bytes = [], [], [], [], [], 0
        self.words: dict[str, int] = {}

    def add(self, doc: int | None, text: str) -> None:
        freq = Counter(pre_tokens(text))
        words = self.words
        self.at.append(np.array([words.setdefault(w, len(words)) for w in freq], dtype=np.uint32))
        self.times.append(np.fromiter(freq.values(), dtype=np.uint32, count=len(freq)))
        self.docs.append(doc)
        self.sizes.append(len(text) if text.isascii() else len(text.encode()))
        self.ends.append(len(freq))
        self.bytes += self.sizes[-1]

    def rows(self, shards: int) -> Iterator[tuple[int, int, bytes]]:
        """The frequencies, then the vocabulary by shard; words are renumbered in the order of the shards."""
        words = list(self.words)
        shard = np.fromiter((zlib.crc32(w.encode()) % shards for w in words), dtype=np.int64, count=len(words))
        order = np.argsort(shard, kind="stable")
        renumber = np.empty(len(words), dtype=np.uint32)
        renumber[order] = np.arange(len(words), dtype=np.uint32)
        at = renumber[np.concatenate(self.at)] if words else np.zeros(0, dtype=np.uint32)
        low, high = (at & 0xFFFF).astype(np.uint16), (at >> 16).astype(np.uint16)
        times = np.concatenate(self.times)
        yield FREQUENCIES, 0, pack((self.docs, self.sizes, np.array(self.ends, dtype=np.int64), low, high, times))
        ends = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            if ends[s] < ends[s + 1]:
                yield WORDS, s, pack([words[i] for i in order[ends[s] : ends[s + 1]]])


def token_counts(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every row as the sentencepiece library counts, no special tokens added.

    Each task gathers its documents' pre-token frequencies, per document, over a vocabulary of the chunk. The
    vocabularies meet by a hash of the word; a word is encoded once there, however many chunks ask, and the
    counts go back to the chunks, where they are joined to the frequencies and summed. A very common word is
    asked for once a chunk. Null and empty texts have no tokens; a very long text is a chunk of its own;
    repeated rows are counted each; an empty table gives an empty table.
    """
    model_file = model_file or public_tokenizers.path("piece_bpe_32k.model")
    shards = shuffle_partitions(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, chunk = TaskContext.get().partitionId(), 0, _Chunk()

        def out() -> Iterator[pa.RecordBatch]:
            for kind, shard, payload in chunk.rows(shards):
                columns = [pa.array([part << 32 | number], pa.int64()), pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([payload], pa.binary())]
                yield pa.record_batch(columns, names=["chunk", "kind", "shard", "payload"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk.add(doc, text or "")
                if chunk.bytes >= CHUNK_BYTES:
                    yield from out()
                    number, chunk = number + 1, _Chunk()
        if chunk.docs:
            yield from out()

    def encode(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack(p) for p in asked["payload"]]
        known: dict[str, int] = {}
        for words in lists:
            for w in words:
                known.setdefault(w, len(known))
        counts = count_pieces(model_file, list(known))
        replies = [pack(counts[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))]) for words in lists]
        return pd.DataFrame({"chunk": asked["chunk"], "shard": asked["shard"], "reply": replies})

    def total(key: tuple, frequencies: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        docs_, sizes, lengths, low, high, times = unpack(frequencies["payload"].iloc[0])
        counts = [unpack(r) for r in replies.sort_values("shard")["reply"]]
        counts = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, dtype=np.int64)
        at = low.astype(np.int64) | high.astype(np.int64) << 16
        sums = np.concatenate([[0], np.cumsum(counts[at] * times)]).astype(np.int64)
        ends = np.cumsum(lengths)
        return pd.DataFrame({"doc_id": pd.array(docs_, dtype="Int64"), "n_bytes": sizes, "n_tokens": sums[ends] - sums[ends - lengths]})

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    chunks = rows.mapInArrow(gather, "chunk bigint, kind int, shard int, payload binary")
    asked = chunks.where(F.col("kind") == WORDS).select("chunk", "shard", "payload")
    replies = asked.groupBy("shard").applyInPandas(encode, "chunk bigint, shard int, reply binary")
    frequencies = chunks.where(F.col("kind") == FREQUENCIES).select("chunk", "payload")
    return frequencies.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(total, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
