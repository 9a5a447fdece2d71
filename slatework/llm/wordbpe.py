"""Word BPE encoding and decoding; long texts are encoded in halves that are joined up a tree."""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches

#: Texts of more characters are cut in halves down to leaves of this many at most.
LEAF_CHARS = 8_192
#: Runs without white space of more characters than LONG are cut by themselves, into leaves of at most LEAF symbols.
LONG, LEAF = 512, 256
#: What a leaf keeps of its text at either end, at most, in whole words; none is longer than LONG.
EDGE = 640
#: So many neighbouring leaves are joined by one task; what they make is joined in the next round.
FAN_IN = 64
#: Distinct words whose ids a worker keeps; beyond that it starts anew.
CACHE_WORDS = 300_000
#: Words that the library encodes as one text, with a mark between them that is a token of its own.
TOGETHER, MARK = 256, "\0"
#: The characters with the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE, SPACE = re.compile(f"[^{SPACES}]+"), re.compile(f"[{SPACES}]")
#: str.split() also cuts at these, which aren't White_Space.
SEPARATORS = re.compile("[\x1c-\x1f]")
END = "</w>"


class WordBpe:
    """What one worker keeps of a tokenizer: the library, its merges, and the ids of words seen."""

    def __init__(self, json_file: str):
        self.library = Tokenizer.from_file(json_file)
        self.library.no_truncation()
        self.library.no_padding()
        with open(json_file, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_cut = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.tokens = [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        (self.mark,) = self.library.encode(MARK, add_special_tokens=False).ids
        self.kind = "<u2" if len(self.tokens) <= 1 << 16 else "<u4"
        self.words: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return NOT_SPACE.findall(text) if SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text by its words, as integers of ``kind``; new words are encoded together."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        split, seen = [self.split(t) for t in texts], self.words
        new = list({w for words in split for w in words}.difference(seen))
        plain = [w for w in new if MARK not in w]
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)] + [[w] for w in new if MARK in w]
        for group, found in zip(groups, self.library.encode_batch_fast([f" {MARK} ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, dtype=self.kind)
            raw, size = ids.tobytes(), ids.itemsize
            cuts = (size * np.flatnonzero(ids == self.mark)).tolist() if len(group) > 1 else []
            seen.update(zip(group, [raw[a:b] for a, b in zip([0, *(c + size for c in cuts)], [*cuts, len(raw)])]))
        return [b"".join([seen[w] for w in words]) for words in split]

    def results(self, docs: list, ids: list[bytes]) -> pa.RecordBatch:
        """Documents with their ids and what the library's decode gives: its file has no decoder, so tokens come with spaces between them."""
        numbers = [np.frombuffer(i, dtype=self.kind) for i in ids]
        decoded = [" ".join(map(self.tokens.__getitem__, n.tolist())) for n in numbers]
        columns = [pa.array(docs, pa.int64()), pa.array([n.astype("<u4").tobytes() for n in numbers], pa.binary()), pa.array(decoded, pa.string())]
        return pa.record_batch(columns, names=["doc_id", "ids", "decoded"])

    def runs(self, word: str) -> list[int | str]:
        """A long word as ids of special tokens and pre-tokens, these in the library's byte symbols."""
        out: list[int | str] = []
        at = 0
        for hit in [*self.special_cut.finditer(word), None]:
            plain = word[at : hit.start() if hit else len(word)]
            if plain:
                normal = self.library.normalizer.normalize_str(plain)
                out += [run for run, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
            if hit:
                out.append(self.special[hit.group()])
                at = hit.end()
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE of a run of symbols: always the earliest merge of the list, leftmost first."""
        n, ranks = len(symbols), self.ranks
        part: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or ranks.get((part[i], part[j])) != rank:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in part if p is not None]

    @staticmethod
    def symbols(tokens: list[str], last: bool) -> list[str]:
        """The symbols of tokens; ``last``: they end a pre-token, so that the last symbol has the end mark."""
        text = "".join(tokens)
        if last:
            text = text[: -len(END)]
            return [*text[:-1], text[-1] + END]
        return list(text)

    def leaf(self, text: str, last: bool) -> list[str]:
        return self.merge([*text[:-1], text[-1] + END] if last else list(text))

    def fits(self, a: str, b: str, last: bool) -> bool:
        """Whether these two tokens stay as they are side by side."""
        return self.merge(self.symbols([a, b], last)) == [a, b]

    def join(self, a: list[str], b: list[str], last: bool) -> list[str]:
        """The tokens of two parts' concatenation from theirs.

        A window around the join is encoded anew and grows until its outer tokens stand next to what either side
        has there exactly as they would in one encoding. A row of tokens in which each two neighbours fit is the
        encoding of its text, so nothing further out can change.
        """
        k = 4
        while True:
            left, right = a[-k:], b[:k]
            whole_left, whole_right = len(left) == len(a), len(right) == len(b)
            middle = self.merge(self.symbols(left + right, last and whole_right))
            if (whole_left or self.fits(a[-k - 1], middle[0], last and whole_right and len(middle) == 1)) and (
                whole_right or self.fits(middle[-1], b[k], last and k + 1 == len(b))
            ):
                return a[: len(a) - len(left)] + middle + b[len(right) :]
            k *= 2

    def join_texts(self, a: Leaf, b: Leaf) -> Leaf:
        """Two neighbouring leaves of a text as one.

        A window of words around the cut is encoded anew. It grows until its outer words come out exactly as either
        side has them by themselves: white space lies beyond them, so nothing further out can change.
        """
        if SPACE.match(a.tail[-1:]) or SPACE.match(b.head[:1]):
            own_left = own_right = middle = b""
        else:
            k = 1
            while True:
                left, right = last_words(a.tail, k), first_words(b.head, k)
                own_left, own_right, middle, first, last = self.encode([left, right, left + right, first_words(left, 1), last_words(right, 1)])
                agree = a.ids.endswith(own_left) and b.ids.startswith(own_right)
                inner = (left == a.tail or middle.startswith(first)) and (right == b.head or middle.endswith(last))
                everything = left == a.tail and right == b.head
                if agree and inner and (k > 1 or everything):
                    break
                if everything:
                    raise ValueError("a leaf's ids are not those of its words")
                k *= 2
        ids = a.ids[: len(a.ids) - len(own_left)] + middle + b.ids[len(own_right) :]
        head = head_words(a.head + b.head) if a.whole else a.head
        tail = tail_words(a.tail + b.tail) if b.whole else b.tail
        return Leaf(ids, head, tail, a.whole and b.whole and len(a.head) + len(b.head) <= EDGE)

    def join_tree(self, leaves: list, join: Callable) -> object:
        """Neighbours joined two by two until one is left."""
        while len(leaves) > 1:
            odd = leaves[len(leaves) - len(leaves) % 2 :]
            leaves = [join(a, b) for a, b in zip(leaves[::2], leaves[1::2])] + odd
        return leaves[0]

    def join_symbols(self, a: Symbols, b: Symbols) -> Symbols:
        return Symbols(self.join(a.tokens, b.tokens, b.last), b.last)


class Leaf(NamedTuple):
    """Ids of a stretch of text, and what it begins and ends with; ``whole``: that is all of it, head and tail alike."""

    ids: bytes
    head: str
    tail: str
    whole: bool


class Symbols(NamedTuple):
    """Tokens of a stretch of a pre-token; ``last``: it ends there."""

    tokens: list[str]
    last: bool


def first_words(text: str, k: int) -> str:
    """The text up to the end of its k-th word; all of it if it has no more words."""
    found = [m.end() for m in itertools.islice(NOT_SPACE.finditer(text), k)]
    return text[: found[-1]] if len(found) == k else text


def last_words(text: str, k: int) -> str:
    """The text from the start of its k-th last word; all of it if it has no more words."""
    found = [m.start() for m in NOT_SPACE.finditer(text)]
    return text[found[-k] :] if len(found) >= k else text


def head_words(text: str) -> str:
    """The first EDGE characters without a word that they cut; there is white space among them, for no word is so long."""
    return text if len(text) <= EDGE else text[: SPACE.search(text[:EDGE][::-1]).start() * -1 + EDGE]


def tail_words(text: str) -> str:
    return text if len(text) <= EDGE else text[len(text) - EDGE + SPACE.search(text[-EDGE:]).start() :]


@functools.cache
def word_bpe(json_file: str) -> WordBpe:
    """One of these a worker process."""
    return WordBpe(json_file)


def halves(text: str, limit: int) -> list[str]:
    """A text cut in halves, and those again, down to ``limit`` characters."""
    if len(text) <= limit:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], limit) + halves(text[middle:], limit)


#: Parts of a long text: which document and item, the leaf's number in it, and its text, tokens or ids.
PARTS = "uid bigint, doc_id bigint, item bigint, leaf bigint, kind int, last boolean, text string, tail string, ids binary"
TEXT, SYMBOLS, READY = 0, 1, 2


def cut(rows: DataFrame, json_file: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Leaves of ``rows(uid, id, text)``: stretches of text in halves, long runs without white space by their symbols."""
    long_run = re.compile(f"[^{SPACES}]{{{LONG + 1},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(json_file)
        for batch in batches:
            for uid, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out: list[tuple] = []
                number = itertools.count()

                def stretch(text: str) -> None:
                    item = next(number)
                    out.extend((uid, doc, item, i, TEXT, False, leaf, None, None) for i, leaf in enumerate(halves(text, leaf_chars)))

                at = 0
                for hit in long_run.finditer(text):
                    if hit.start() > at:
                        stretch(text[at : hit.start()])
                    at = hit.end()
                    for found in bpe.runs(hit.group()):
                        item = next(number)
                        if isinstance(found, int):
                            out.append((uid, doc, item, 0, READY, True, None, None, np.array([found], dtype=bpe.kind).tobytes()))
                        else:
                            leaves = halves(found, LEAF)
                            out.extend((uid, doc, item, i, SYMBOLS, i + 1 == len(leaves), leaf, None, None) for i, leaf in enumerate(leaves))
                if at < len(text) or not out:
                    stretch(text[at:])
                yield _parts(out)

    return rows.mapInArrow(run, PARTS)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.binary()]
    names = [field.split()[0] for field in PARTS.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def encode_leaves(parts: DataFrame, json_file: str) -> DataFrame:
    """Every leaf by itself, wherever it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(json_file)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                rows = list(zip(*(c.to_pylist() for c in whole.slice(at, 64).columns)))
                ids = iter(bpe.encode([r[6] for r in rows if r[4] == TEXT]))
                out = []
                for uid, doc, item, leaf, kind, last, text, _, ready in rows:
                    if kind == TEXT:
                        short = len(text) <= EDGE
                        out.append((uid, doc, item, leaf, kind, short, head_words(text), None if short else tail_words(text), next(ids)))
                    elif kind == SYMBOLS:
                        out.append((uid, doc, item, leaf, kind, last, MARK.join(bpe.leaf(text, last)), None, None))
                    else:
                        out.append((uid, doc, item, leaf, kind, last, None, None, ready))
                yield _parts(out)

    return parts.mapInArrow(run, PARTS)


def joined(bpe: WordBpe, rows: list[tuple], number: int = 0) -> tuple:
    """Neighbouring leaves of an item, in order, as one row, the leaf of this number."""
    uid, doc, item, _, kind = rows[0][:5]
    if kind == TEXT:
        found = bpe.join_tree([Leaf(r[8], r[6], r[6] if r[7] is None else r[7], r[5]) for r in rows], bpe.join_texts)
        return uid, doc, item, number, kind, found.whole, found.head, None if found.whole else found.tail, found.ids
    if kind == SYMBOLS:
        found = bpe.join_tree([Symbols(r[6].split(MARK), r[5]) for r in rows], bpe.join_symbols)
        return uid, doc, item, number, kind, found.last, MARK.join(found.tokens), None, None
    return rows[0]


def join_round(parts: DataFrame, json_file: str, fan_in: int = FAN_IN) -> DataFrame:
    """Up to ``fan_in`` neighbouring leaves of an item as one, joined two by two in one task; groups of them in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, rows = word_bpe(json_file), (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for (_, _, number), group in itertools.groupby(rows, key=lambda r: (r[0], r[2], r[3] // fan_in)):
            yield _parts([joined(bpe, list(group), number)])

    dealt = parts.repartition("uid", "item", F.floor(F.col("leaf") / fan_in))
    return dealt.sortWithinPartitions("uid", "item", "leaf").mapInArrow(run, PARTS)


def encode_decode(
    docs: DataFrame, json_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, fan_in: int = FAN_IN
) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row: ids as little-endian unsigned 32-bit integers, and their decoding.

    Both as the tokenizers library gives them for the whole text without special tokens added. A text of more than
    ``leaf_chars`` characters is cut in halves, and those again, into leaves that are rows of their own and encoded in
    parallel wherever they land. Neighbouring leaves are joined up a tree, ``fan_in`` of them in one task and then what
    those made, each join by re-encoding a window around the cut that grows until both sides agree exactly. A cut may
    fall anywhere, within a word too. Runs of over LONG characters without white space are cut the same way by the
    symbols of their pre-tokens. Shorter texts are encoded whole.

    Null and empty texts have no ids and decode to the empty text; repeated rows and ids stay; an empty table gives
    an empty table. As a row holds all ids of its document, so does one task at the end.
    """
    json_file = json_file or public_tokenizers.path("word_bpe_49k.json")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    result = "doc_id bigint, ids binary, decoded string"

    def short_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(json_file)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                ids, texts = (c.to_pylist() for c in whole.slice(at, 256).columns)
                yield bpe.results(ids, bpe.encode(texts))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last joins of every item, and a document's items one after the other; one document is held at a time."""
        bpe, rows = word_bpe(json_file), (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        docs, found, size = [], [], 0
        for (_, doc), parts in itertools.groupby(rows, key=lambda r: r[:2]):
            pieces = []
            for _, item in itertools.groupby(parts, key=lambda r: r[2]):
                whole = joined(bpe, list(item))
                pieces.append(np.array([bpe.vocab[t] for t in whole[6].split(MARK)], dtype=bpe.kind).tobytes() if whole[4] == SYMBOLS else whole[8])
            docs.append(doc)
            found.append(b"".join(pieces))
            size += len(found[-1])
            if size > 1 << 20:
                yield bpe.results(docs, found)
                docs, found, size = [], [], 0
        if docs:
            yield bpe.results(docs, found)

    long = F.length("text") > leaf_chars
    short = rows.where(~long).mapInArrow(short_rows, result)
    longest = rows.agg(F.max(F.length("text"))).first()[0] or 0
    if longest <= leaf_chars:
        return short
    leaves = cut(rows.where(long).select(F.monotonically_increasing_id().alias("uid"), "id", "text"), json_file, leaf_chars)
    parts = encode_leaves(leaves.repartition("uid", "item", "leaf"), json_file)
    most = 2 * longest / leaf_chars  # leaves of a text at most: each is longer than half of what a leaf may be
    while most > fan_in:
        parts, most = join_round(parts, json_file, fan_in), most / fan_in
    ordered = parts.repartition("uid").sortWithinPartitions("uid", "item", "leaf")
    return short.unionByName(ordered.mapInArrow(assemble, result))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
