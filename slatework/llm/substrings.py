"""Substring duplicates by relative Lempel-Ziv parsing: documents are factored greedily against indexed blocks of the corpus."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, bundle, chunks, materialize, pack, shuffle_partitions, squeeze, unbundle, unpack, unsqueeze

#: A block of documents ends at so many bytes of text.
BLOCK_BYTES = 4 << 20
#: Distinct words that a worker keeps from one block to the next; beyond that it starts anew.
CACHE_WORDS = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Vocabulary(dict):
    """Numbers of words, given as they are met, and the hash of each; equal numbers are equal words."""

    def __init__(self):
        super().__init__()
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return found


_VOCABULARY = Vocabulary()


def vocabulary() -> Vocabulary:
    """A worker's vocabulary, for one block: the numbers of an earlier block may mean other words."""
    global _VOCABULARY
    if len(_VOCABULARY) > CACHE_WORDS:
        _VOCABULARY = Vocabulary()
    return _VOCABULARY


def split_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space."""
    return (text or b"").split()


class Words:
    """The words of texts as one array of numbers, with the fingerprints of all phrases of ``length`` words."""

    def __init__(self, texts: list[list[bytes]], length: int, known: Vocabulary):
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        get = known.__getitem__
        self.numbers = np.fromiter((n for t in texts for n in map(get, t)), dtype=np.int32, count=int(self.sizes.sum()))
        hashes = np.array(known.hashes, dtype=np.uint64)[self.numbers]
        self.prints, self.starts = phrase_prints(hashes, self.sizes, length)


def phrase_prints(hashes: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of all phrases of ``length`` words within texts of these sizes, and where each starts.

    Sums of word hashes times powers of an odd base, modulo 2^64, so that equal phrases have equal ones wherever they
    start; then mixed. They only say where to look: words decide.
    """
    total = len(hashes)
    counts = np.maximum(sizes - length + 1, 0)
    if not counts.sum():
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(total, BASE))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * powers)])
        back = np.cumprod(np.full(total, INVERSE))
        prints = (sums[length:] - sums[: total - length + 1]) * back[: total - length + 1]
        prints ^= prints >> np.uint64(32)
        prints *= np.uint64(0xD6E8FEB86659FD93)
        prints ^= prints >> np.uint64(32)
    first = np.cumsum(sizes) - sizes
    own = np.zeros(total + 1, dtype=np.int32)  # of all starts, those whose phrase ends in its text
    np.add.at(own, first[counts > 0], 1)
    np.add.at(own, (first + counts)[counts > 0], -1)
    starts = np.flatnonzero(np.cumsum(own)[: len(prints)] > 0)
    return prints[starts], starts


def occurrences(own: Words, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the ``wanted`` fingerprints, in order, occurs first and second in a block; -1 where it does not."""
    place = np.minimum(np.searchsorted(wanted, own.prints), len(wanted) - 1)
    hit = np.flatnonzero(wanted[place] == own.prints)
    order = hit[np.argsort(place[hit], kind="stable")]  # by fingerprint, then where it starts
    found = np.full((2, len(wanted)), -1, dtype=np.int64)
    begins = np.flatnonzero(np.concatenate([[True], place[order][1:] != place[order][:-1]])) if len(order) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(begins, len(order)))
    for i in range(2):
        at = order[begins[sizes > i] + i]
        found[i, place[at]] = own.starts[at]
    return found[0], found[1]


def stretches(words: list[list[bytes]], own: Words, starts: np.ndarray, length: int) -> list[tuple[int, bytes]]:
    """``(at, words)``: the parts of a block that the phrases with these starts cover, neighbouring ones in one."""
    starts = np.sort(starts[starts >= 0])
    if not len(starts):
        return []
    text = np.searchsorted(own.ends, starts, side="right")
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(text) != 0)) + 1
    found = []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(starts)]):
        t = int(text[a])
        before = int(own.ends[t] - own.sizes[t])
        found.append((int(starts[a]), b" ".join(words[t][int(starts[a]) - before : int(starts[b - 1]) - before + length])))
    return found


class Reference:
    """Parts of reference blocks, indexed by the fingerprints of their phrases."""

    def __init__(self, parts: list[tuple[int, int, bytes]], length: int, known: Vocabulary):
        self.blocks, self.at = [p[0] for p in parts], [p[1] for p in parts]
        self.words = Words([p[2].split(b" ") for p in parts], length, known)
        self.order = np.argsort(self.words.prints, kind="stable")
        self.keys = self.words.prints[self.order]

    def longest(self, own: Words, at: int, end: int, key: int, block: int) -> tuple[int, int, int]:
        """The longest match for the words from ``at`` on among all places with this fingerprint: its length, block and place.

        The place itself, in block ``block``, is none; in this block a match may go on beyond the part that is indexed.
        """
        best, fingerprint = (0, -1, -1), self.keys[key]
        while key < len(self.keys) and self.keys[key] == fingerprint:
            start = int(self.words.starts[self.order[key]])
            part = int(np.searchsorted(self.words.ends, start, side="right"))
            place = self.at[part] + start - int(self.words.ends[part] - self.words.sizes[part])
            key += 1
            there, limit = (self.words.numbers[start:], int(self.words.ends[part]) - start)
            if self.blocks[part] == block:
                if place == at:
                    continue
                there, limit = own.numbers[place:], int(own.ends[np.searchsorted(own.ends, place, side="right")]) - place
            n = min(end - at, limit)
            differ = own.numbers[at : at + n] != there[:n]
            best = max(best, (int(differ.argmax()) if differ.any() else n, self.blocks[part], place))
        return best

    def parse(self, own: Words, block: int, length: int) -> list[list[tuple[int, int, int, int]]]:
        """Each text's factors ``(start, end, block, at)`` of ``length`` words or more.

        Greedy: from the first phrase that any block holds, as far as the words are those of one place there. The
        next factor may begin with the first phrase that crosses the end of the last, so that none is missed there.
        """
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in own.sizes]
        if not len(self.keys):
            return found
        places = np.searchsorted(self.keys, own.prints)
        held = np.flatnonzero(self.keys[np.minimum(places, len(self.keys) - 1)] == own.prints)
        starts, texts = own.starts[held], np.searchsorted(own.ends, own.starts[held], side="right")
        i = 0
        while i < len(held):
            at, text = int(starts[i]), int(texts[i])
            begin, end = int(own.ends[text] - own.sizes[text]), int(own.ends[text])
            same, source, place = self.longest(own, at, end, int(places[held[i]]), block)
            if same >= length:
                found[text].append((at - begin, at - begin + same, source, place))
                i = int(np.searchsorted(starts, at + same - length + 1))
            else:
                i += 1
        return found


def removed_words(spans: list[tuple], n_words: int) -> np.ndarray:
    """Which words the spans cover."""
    change = np.zeros(n_words + 1, dtype=np.int32)
    for a, b, *_ in spans:
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change)[:n_words] > 0


SPAN = "struct<start: int, end: int, block: bigint, at: bigint>"


def _parsed(docs: DataFrame, length: int, text_col: str) -> DataFrame:
    """The columns of ``docs`` as c0, c1... with n_words, spans and kept; see ``duplicate_spans``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shards = shuffle_partitions(spark)
    at = docs.columns.index(text_col)
    plain = docs.select(*[F.col(f"`{c}`").cast("string" if i == at else t).alias(f"c{i}") for i, (c, t) in enumerate(docs.dtypes)])
    cuts = np.array([(s << 64) // shards for s in range(1, shards)], dtype=np.uint64)

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in chunks(batches, at, BLOCK_BYTES):
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([bundle(table)], pa.binary())], names=["block", "rows"])

    def read(rows: list[bytes]) -> tuple[list[pa.Table], list[list[bytes]]]:
        tables = [unbundle(blob) for blob in rows]
        return tables, [split_words(t) for table in tables for t in table.column(at).cast(pa.binary()).to_pylist()]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's distinct phrases, by ranges of fingerprints, and which of them it has more than once."""
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Words(read([rows])[1], length, vocabulary())
                distinct, times = np.unique(own.prints, return_counts=True)
                ends = [*np.searchsorted(distinct, cuts, side="left").tolist(), len(distinct)]
                begin = 0
                for shard, end in enumerate(ends):
                    if begin < end:
                        payload = pack((squeeze(distinct[begin:end]), np.packbits(times[begin:end] > 1)), level=1)
                        columns = [pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([payload], pa.binary())]
                        yield pa.record_batch(columns, names=["block", "shard", "payload"])
                    begin = end

    def deal(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        """Which block has to show which phrases to which: each block gets a phrase from the one before it that has it.

        The first gets it from the second, and one that has it twice from itself too. So however many blocks share a
        phrase, none has to show it more than twice.
        """
        asked = asked.sort_values("block")
        blocks = asked["block"].to_numpy()
        lists, many = [], []
        for payload in asked["payload"]:
            squeezed, bits = unpack(payload)
            lists.append(unsqueeze(squeezed))
            many.append(np.unpackbits(bits, count=len(lists[-1])).astype(bool))
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        prints, many = np.concatenate(lists), np.concatenate(many)
        order = np.argsort(prints, kind="stable")
        same = prints[order][1:] == prints[order][:-1]
        later, earlier = order[1:][same], order[:-1][same]
        first = np.flatnonzero(same & ~np.concatenate([[False], same[:-1]]))
        own = np.flatnonzero(many)
        to = np.concatenate([owner[later], owner[order[first]], owner[own]])
        source = np.concatenate([owner[earlier], owner[order[first + 1]], owner[own]])
        wanted = np.concatenate([prints[later], prints[order[first]], prints[own]])
        by = np.argsort(source.astype(np.int64) * len(lists) + to, kind="stable")
        to, source, wanted = to[by], source[by], wanted[by]
        out = []
        for lo, hi in _runs(source):
            wants = [(int(blocks[to[a]]), squeeze(wanted[a:b])) for a, b in ((lo + a, lo + b) for a, b in _runs(to[lo:hi]))]
            out.append((int(blocks[source[lo]]), pack(wants, level=1)))
        return pd.DataFrame({"block": [b for b, _ in out], "wants": [w for _, w in out]})

    def show(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """The parts of a block that others want, a row for each of them."""
        wants: dict[int, list[np.ndarray]] = {}
        for payload in asked.column("wants").to_pylist():
            for to, squeezed in unpack(payload):
                wants.setdefault(to, []).append(unsqueeze(squeezed))
        out: list[tuple[int, bytes]] = []
        if wants and rows.num_rows:
            block = rows.column("block")[0].as_py()
            words = read(rows.column("rows").to_pylist())[1]
            own = Words(words, length, vocabulary())
            every = np.unique(np.concatenate([x for lists in wants.values() for x in lists]))
            first, second = occurrences(own, every)
            for to, lists in wants.items():
                at = np.searchsorted(every, np.concatenate(lists))
                shown = stretches(words, own, first[at], length)
                if to == block:
                    shown += stretches(words, own, second[at], length)
                out.append((to, pack([(block, a, w) for a, w in shown])))
        return pa.table({"block": pa.array([t for t, _ in out], pa.int64()), "parts": pa.array([p for _, p in out], pa.binary())})

    def parse(rows: pa.Table, shown: pa.Table) -> pa.Table:
        out = []
        parts = [part for payload in shown.column("parts").to_pylist() for part in unpack(payload)]
        for block, blob in zip(rows.column("block").to_pylist(), rows.column("rows").to_pylist()):
            tables, words = read([blob])
            if parts:
                known = vocabulary()
                factors = Reference(parts, length, known).parse(Words(words, length, known), block, length)
            else:
                factors = [[] for _ in words]
            spans, kept = [], []
            for own, found in zip(words, factors):
                if found:
                    gone = removed_words(found, len(own))
                    own = [w for w, g in zip(own, gone.tolist()) if not g]
                spans.append([{"start": a, "end": b, "block": c, "at": d} for a, b, c, d in found])
                kept.append(b" ".join(own))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("block", pa.int64()), ("at", pa.int64())]))
            (table,) = tables
            table = table.append_column("n_words", pa.array([len(w) for w in words], pa.int64()))
            table = table.append_column("spans", pa.array(spans, kind))
            out.append(table.append_column("kept", pa.array(kept, pa.binary()).cast(pa.string())))
        return pa.concat_tables(out)

    blocks = materialize(plain.mapInArrow(bundled, "block bigint, rows binary"), "reference-blocks")
    asked = blocks.mapInArrow(ask, "block bigint, shard int, payload binary")
    wants = asked.groupBy("shard").applyInPandas(deal, "block bigint, wants binary")
    dealt = blocks.repartition(shards, "block")
    shown = dealt.groupBy("block").cogroup(wants.groupBy("block")).applyInArrow(show, "block bigint, parts binary")
    fields = ", ".join(f"c{i} {t if i != at else 'string'}" for i, (_, t) in enumerate(docs.dtypes))
    parsed = dealt.groupBy("block").cogroup(shown.groupBy("block"))
    return parsed.applyInArrow(parse, f"{fields}, n_words bigint, spans array<{SPAN}>, kept string")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    cuts = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist() if len(values) else []
    return list(zip([0, *cuts], [*cuts, len(values)])) if len(values) else []


def duplicate_spans(docs: DataFrame, length: int = 35, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and what the parse against the whole corpus found in each.

    Adds ``_n_words``, ``_spans`` (the long factors: word ranges, start and end, with the block and the place in it
    whose words they are) and ``_kept`` (the other words joined by a space); columns of these names in the input are
    replaced. A phrase is ``length`` words in a row of one document; it is a duplicate if it starts at any other place,
    in the same document or another, of the input as it was given.

    Documents are gathered in blocks of about BLOCK_BYTES, written once; every block is reference and input alike.
    Blocks list their distinct phrases by fingerprint. Where a phrase is in several blocks, each of them gets the
    stretch of words around it from the block before it; stretches are as long as neighbouring phrases come from the
    same block, and a block indexes those it gets. Its documents are then factored greedily: a factor goes as far as
    the words, compared one by one, are those of a single place, and the next one is looked for from the first phrase
    that crosses the factor's end. Fingerprints never decide: equal ones of different words only cost a comparison.
    (A duplicate could be missed only if a third phrase had the same 64 bits and stood in a block between.)

    A phrase of any number of copies is asked for once a block and shown twice by each at most, so hot passages cost no
    more than others; memory is bound by the block, by what it wants, and by a range of fingerprints
    (spark.sql.shuffle.partitions ranges). There are never more messages than distinct phrases of blocks.

    Null and empty texts have no words; documents shorter than a phrase keep all words; very long ones are blocks of
    their own; repeated rows are duplicates of each other; an empty table gives an empty table.
    """
    added = {"_n_words": "n_words", "_spans": "spans", "_kept": "kept"}
    given = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in added]
    return _parsed(docs, length, text_col).select(*given, *[F.col(n).alias(c) for c, n in added.items()])


def removed_count(spans: str = "_spans") -> Column:
    """How many words the spans of a row cover; spans are in order and may overlap."""
    def step(acc, span):
        begin = F.greatest(acc["upto"], span["start"])
        return F.struct((acc["n"] + F.greatest(span["end"] - begin, F.lit(0))).alias("n"), F.greatest(acc["upto"], span["end"]).alias("upto"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"].cast("bigint"))


def remove_duplicates(docs: DataFrame, length: int = 35, text_col: str = "text") -> DataFrame:
    """``docs``, columns of any name, with every word of a duplicate phrase removed; texts without any stay as they are."""
    found = _parsed(docs, length, text_col)
    text = [F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col(f"c{i}")) if c == text_col else F.col(f"c{i}") for i, c in enumerate(docs.columns)]
    return found.select(*[x.alias(c) for x, c in zip(text, docs.columns)])


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = duplicate_spans(docs)
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), removed_count().alias("n_removed"), F.sha2(F.encode("_kept", "UTF-8"), 256).alias("kept_sha256")
    )


def kept_digest(words: list[bytes]) -> str:
    """The digest that op7_substrings gives for these kept words; for tests."""
    return hashlib.sha256(b" ".join(words)).hexdigest()
