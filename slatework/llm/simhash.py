"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verification, components."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, components, discard, materialize, squeeze, unsqueeze

#: A block with more fingerprints than this isn't joined with itself; its fingerprints meet on their one-bit variants.
PAIR_BLOCK = 48


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats included; 0 without words.

    Words are runs of bytes other than ASCII white space. With fewer words than a shingle has, the whole
    sequence is the one shingle. A bit is 1 if it is set in over half of the shingles' XXH64 values.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = zip(*(parts[i:] for i in range(words))) if len(parts) >= words else [parts]
    hashes = np.fromiter((digest(s, seed) for s in map(b" ".join, shingles)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row; null and empty texts have fingerprint 0, repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words, seed) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id bigint, fp bigint")


def block_masks(max_bits: int) -> list[int]:
    """Masks of all choices of three among ``max_bits + 3`` blocks of 64 bits.

    Two fingerprints that differ in ``max_bits`` bits or fewer agree on three of the blocks at least, so they
    agree under one of the masks. Three blocks rather than one make a key that few unrelated fingerprints share.
    """
    n = max_bits + 3
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    masks = [a | b | c for a, b, c in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_fingerprints(reps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges ``(u, v)`` of representatives ``reps(fp, rep)`` that connect all fingerprints at ``max_bits`` bits or fewer.

    Small blocks are joined with themselves and each pair's Hamming distance is verified. A block of more than
    ``PAIR_BLOCK`` fingerprints would give pairs in the square of its size; its fingerprints are dealt out by
    their variants with at most one bit flipped. Two of them are within two bits exactly if they share a
    variant, so every group of a variant is linked to its smallest member; that loses no connection.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(max_bits))])
    keyed = reps.select("fp", "rep", F.inline(keys))
    sizes = materialize(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-blocks")
    small = keyed.join(sizes.where(F.col("n") <= PAIR_BLOCK).select("mask", "key"), ["mask", "key"])
    other = small.select("mask", "key", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    pairs = small.join(other, ["mask", "key"]).where("rep < rep2").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits)
    edges = pairs.select(F.col("rep").alias("u"), F.col("rep2").alias("v"))
    hot = keyed.join(sizes.where(F.col("n") > PAIR_BLOCK).select("mask", "key"), ["mask", "key"]).select("fp", "rep").distinct()
    flips = [0] + [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    variants = hot.select("rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("variant"))
    if max_bits == 1:  # a variant then links a fingerprint to the one that it is
        centre = hot.select(F.col("fp").alias("variant"), F.col("rep").alias("u"))
    else:
        centre = variants.groupBy("variant").agg(F.min("rep").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = variants.join(centre, "variant").where("u <> rep").select("u", F.col("rep").alias("v"))
    return edges.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` of every row; component is the smallest id reachable over links of ``max_bits`` bits or fewer.

    Equal fingerprints are one class before any pairing, so copies never multiply. Classes are linked by their
    fingerprints; ids only name what is linked, so unlike texts of one id are not joined by it, and texts without an id
    link others like any. Rows without words share fingerprint 0 and are linked like any other; of very long texts every
    shingle counts. Repeated rows stay; component is null where no id is reachable. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, words, seed, id_col, text_col), "simhash-fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-classes")
    roots = components(link_fingerprints(classes.select("fp", F.col("fp").alias("rep")), max_bits))
    rooted = materialize(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-components")
    least = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = materialize(rooted.join(least, "root").select("fp", "component"), "simhash-named")
    discard(classes, rooted)
    return prints.join(named, "fp").select("id", "fp", "component")


#: The near-copy stage: 64-bit SimHashes of a document, and the first of them, which tell how far apart documents are.
WIDE, PRINTS = 32, 4
#: Keys of a document and how many bits of its SimHashes make one.
KEYS, KEY_BITS = 960, 26
#: Bits of all PRINTS together in which documents of a similarity of 0.8 differ at most: 39 on average, 6 about it.
FAR_BITS = 72
#: Blocks of up to so many documents give their pairs one by one.
SMALL_BLOCK = 8
#: The pairs of a block's members ``m(rep, root, grp)`` that neither a component nor a group has both ends of.
APART = """flatten(transform(m, a -> transform(
    filter(m, b -> a.rep < b.rep and a.root <> b.root and (a.grp is null or b.grp is null or a.grp <> b.grp)),
    b -> struct(a.rep as u, b.rep as v))))"""
#: Shingle hashes of the documents that a task compares all with all, or with as many others.
TILE_HASHES = 1_000_000
#: Bits of the filter that keeps other texts from being shuffled when some are looked up.
FILTER_BITS = 1 << 22
#: Documents are near copies if they share this much of their distinct shingles of so many words.
SIMILARITY, SHINGLE = 0.8, 5
#: What makes hashes of their own for each SimHash.
SALTS = np.random.default_rng(42).integers(1 << 63, size=WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The bits of each key, drawn at random, filled up to 32 with one that is always zero.
PLACES = np.full((KEYS, 32), 64 * WIDE)
PLACES[:, :KEY_BITS] = np.random.default_rng(43).random((KEYS, 64 * WIDE)).argsort(axis=1, kind="stable")[:, :KEY_BITS]
#: Documents whose keys a task deals out at a time, and about how many meet in a task.
DEALT, MET = 1 << 13, 1 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers, each bit of which depends on all bits of the given ones."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(parts: list[bytes], words: int) -> np.ndarray:
    """Sorted XXH64 values of the distinct word shingles; the whole sequence if it has fewer words, none without words."""
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    shingles = zip(*(parts[i:] for i in range(words))) if len(parts) >= words else [parts]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, shingles)), dtype=np.uint64))


def wide_fingerprint(hashes: np.ndarray, prints: int = PRINTS) -> np.ndarray:
    """The first ``prints`` 64-bit SimHashes of sorted shingle hashes, each from hashes of its own; zeros without any.

    A bit is 1 if it is set in over half of the hashes; of exactly half, the smallest hash decides.
    """
    if not len(hashes):
        return np.zeros(prints, dtype=np.int64)
    ones, every, shifts = np.zeros((8, prints * 8), dtype=np.int64), np.uint64(0x0101010101010101), np.arange(8, dtype=np.uint64)
    for at in range(0, len(hashes), 255):  # so many ones fit a byte
        block = mixed(SALTS[:prints, None] + hashes[at : at + 255])
        if not at:
            tie = np.unpackbits(block[:, 0].copy().view(np.uint8), bitorder="little")
        ones += ((block >> shifts[:, None, None]) & every).sum(axis=2).view(np.uint8)
    return np.packbits(2 * ones.T.ravel() + tie > len(hashes), bitorder="little").view(np.int64)


def print_keys(prints: np.ndarray) -> np.ndarray:
    """KEYS keys of each row of WIDE SimHashes: KEY_BITS of their bits each.

    SimHashes of sets at a similarity of 0.8 differ in 15 % of their bits, so a key of theirs agrees 14 times in
    1000 and all KEYS differ 4 times in 100,000.
    """
    found = np.zeros((len(prints), KEYS), dtype=np.uint32)
    for at in range(0, len(prints), 64):
        own = np.ascontiguousarray(prints[at : at + 64]).view(np.uint8)
        bits = np.pad(np.unpackbits(own, axis=1, bitorder="little"), ((0, 0), (0, 1)))
        found[at : at + 64] = np.packbits(bits.take(PLACES.ravel(), axis=1), axis=1, bitorder="little").view(np.uint32)
    return found


def copy_keys(hashes: np.ndarray) -> np.ndarray:
    """The KEYS keys of the SimHashes of sorted shingle hashes."""
    return print_keys(wide_fingerprint(hashes, WIDE)[None])[0]


def key_blocks(reps: DataFrame) -> DataFrame:
    """``(k, block, n, one, rep)``: the documents of ``reps(rep, prints)`` that share their k-th key with others.

    n of them share the key; one is the smallest of them, so the same in many blocks. Tasks deal out their
    documents' keys, sorted and compressed; the keys of one number meet in a task, or, of many documents, those with
    the same first bits.
    """
    split = min(KEY_BITS, (reps.count() // MET).bit_length())

    def dealt(ids: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids)
        keys, whose = print_keys(prints[order]), squeeze(ids[order].view(np.uint64))
        for first in range(0, KEYS, 64):
            rows = []
            for k in range(first, min(first + 64, KEYS)):
                own = np.sort(keys[:, k].astype(np.uint64) << np.uint64(32) | np.arange(len(ids), dtype=np.uint64))
                parts, starts = np.unique(own >> np.uint64(32 + KEY_BITS - split), return_index=True)
                rows += [(k, int(part), whose, squeeze(some)) for part, some in zip(parts, np.split(own, starts[1:]))]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["k", "part", "whose", "own"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, prints, size = [], [], 0
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            prints.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64).reshape(-1, WIDE))
            size += batch.num_rows
            if size >= DEALT:
                yield from dealt(np.concatenate(ids), np.concatenate(prints))
                ids, prints, size = [], [], 0
        if size:
            yield from dealt(np.concatenate(ids), np.concatenate(prints))

    def meet(table: pa.Table) -> pa.Table:
        keys, ids = [], []
        for whose, own in zip(table.column("whose").to_pylist(), table.column("own").to_pylist()):
            own = unsqueeze(own)
            keys.append(own >> np.uint64(32))
            ids.append(unsqueeze(whose)[own & np.uint64(0xFFFFFFFF)].view(np.int64))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        own = np.sort(keys << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
        keys, at = own >> np.uint64(32), (own & np.uint64(0xFFFFFFFF)).astype(np.int64)
        same = keys[1:] == keys[:-1]
        more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        keys, ids = keys[more], ids[at[more]]
        ids = ids[np.lexsort((ids, keys))]
        block, starts, n = np.unique(keys, return_index=True, return_counts=True)
        found = [np.full(len(ids), table.column("k")[0].as_py(), dtype=np.int32), np.repeat(block.astype(np.int64), n), np.repeat(n.astype(np.int64), n), np.repeat(ids[starts], n), ids]
        return pa.table(found, names=["k", "block", "n", "one", "rep"])

    entries = reps.select("rep", "prints").mapInArrow(deal, "k int, part bigint, whose binary, own binary")
    return entries.groupBy("k", "part").applyInArrow(meet, "k int, block bigint, n bigint, one bigint, rep bigint")


def text_key(words: list[bytes]) -> bytes:
    """Texts of equal words have equal keys of 128 bits, others different ones."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def may_hold(ids: DataFrame, column: Column) -> Column:
    """False for most values that are not among ``ids(id)``: a bitmap of FILTER_BITS bits, whatever their number."""
    at = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    found = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    words = found.toPandas()  # a number for each word of the bitmap at most
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        own = at.to_numpy(np.int64)
        return pd.Series(bitmap[own >> 6] >> (own & 63) & 1 == 1)

    return held(F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)))


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(rep, hashes)`` of the texts ``wanted(rep, id, key)``, from ``rows(id, text)``; few other texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for text in batch.column(0):
                words = (text.as_py() or b"").lower().split()
                keys.append(text_key(words))
                found.append(shingle_hashes(words, SHINGLE).tobytes())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["key", "hashes"])

    ids = wanted.select("id").distinct()
    texts = rows.where(may_hold(ids, F.col("id"))).join(ids, "id", "left_semi").select("text").mapInArrow(run, "key binary, hashes binary")
    return texts.join(wanted.select("rep", "key"), "key").select("rep", "hashes").dropDuplicates(["rep"])


def similar(links: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``links(u, v)`` whose texts have a Jaccard similarity of SIMILARITY or more; see ``_sets``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                one, two = np.frombuffer(one, dtype=np.uint64), np.frombuffer(two, dtype=np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                close.append(shared >= SIMILARITY * (len(one) + len(two) - shared))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(close, pa.bool_()))

    ends = links.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
    own = materialize(_sets(rows, classes.join(ends, "rep", "left_semi")), "copies-shingles")
    near = links.join(own.select(F.col("rep").alias("u"), F.col("hashes").alias("a")), "u").join(own.select(F.col("rep").alias("v"), F.col("hashes").alias("b")), "v")
    near = materialize(near.select("u", "v", "a", "b").mapInArrow(verify, "u bigint, v bigint"), "copies-near")
    discard(own)
    return near


def compare_all(reps: np.ndarray, roots: np.ndarray, prints: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all documents of a similarity of SIMILARITY or more, beyond what equal ``roots`` connect already.

    Each document outside the largest component is compared with all documents of other components. A component
    that a link reaches is one with its own from then on, and none of its documents is left out of later comparisons.
    """
    sizes = np.array([len(s) for s in sets])
    _, own = np.unique(roots, return_inverse=True)
    amount = np.bincount(own)
    todo = np.flatnonzero(own != amount.argmax())
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    places = [local[e - n : e] for e, n in zip(ends, sizes)]
    mark, prints = np.zeros(len(local), dtype=bool), prints.view(np.uint64)
    found = []
    for i in todo:
        far = np.bitwise_count(prints ^ prints[i]).sum(axis=1, dtype=np.int32)
        near = (own != own[i]) & (far <= FAR_BITS) & (sizes >= SIMILARITY * sizes[i]) & (sizes * SIMILARITY <= sizes[i])
        at = np.flatnonzero(near)
        if not len(at):
            continue
        mark[places[i]] = True
        starts = np.concatenate([[0], np.cumsum(sizes[at])[:-1]])
        shared = np.add.reduceat(mark[np.concatenate([places[j] for j in at])], starts, dtype=np.int64)
        mark[places[i]] = False
        for j in at[shared >= SIMILARITY * (sizes[i] + sizes[at] - shared)]:
            if own[i] != own[j]:
                found.append((int(reps[i]), int(reps[j])))
                own[own == own[j]] = own[i]
    return found


def _links_in_groups(members: DataFrame, sets: DataFrame, names: list[str]) -> DataFrame:
    """``(u, v)``: what connects the documents of each group of ``members(grp, rep, root, f0...)``, all compared with all.

    Documents of a group's largest component are not compared with each other. They and the others are dealt into
    tiles of about TILE_HASHES shingles; a task compares two tiles. So a group costs in proportion to its size
    times the number of tiles of the documents that are not in its largest component.
    """
    spark = members.sparkSession
    shares = members.groupBy("grp", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    biggest = shares.groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("size").alias("all"), F.max_by("size", F.struct("n", "root")).alias("most"))
    tiles = biggest.select("grp", "main", F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / TILE_HASHES)).cast("bigint").alias("few"), F.greatest(F.lit(1), F.ceil(F.col("most") / TILE_HASHES)).cast("bigint").alias("many"))
    turn = F.xxhash64("rep")
    dealt = members.join(tiles, "grp").withColumn("mine", F.when(F.col("root") == F.col("main"), F.col("few") + F.pmod(turn, "many")).otherwise(F.pmod(turn, "few")))
    others = F.when(F.col("mine") < F.col("few"), F.sequence(F.lit(0).cast("bigint"), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("few") - 1))
    dealt = dealt.select("grp", "rep", "root", *names, "mine", F.explode(others).alias("other"))
    dealt = dealt.select("grp", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "rep", "root", *names)

    def run(table: pa.Table) -> pa.Table:
        prints = np.column_stack([table.column(n).to_numpy() for n in names])
        held = [np.frombuffer(h, dtype=np.uint64) for h in table.column("hashes").to_pylist()]
        found = compare_all(table.column("rep").to_numpy(), table.column("root").to_numpy(), prints, held)
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return dealt.join(sets, "rep").groupBy("grp", "a", "b").applyInArrow(run, "u bigint, v bigint")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, keep)`` of every row: whether a row of its id and text stays when one document of each group of near copies does.

    Near copies have a Jaccard similarity of SIMILARITY or more in distinct five-word shingles. Texts of equal words
    are one class, with a number of its own; ids only choose what stays. Classes meet in the blocks of KEYS keys of
    KEY_BITS bits of their SimHashes each: a pair at a similarity of 0.8 is in no common block 4 times in 100,000, closer
    ones more rarely, very short texts more often. Those whose first PRINTS SimHashes are at a Hamming distance of up to
    FAR_BITS are candidates; similarity is then verified from whole texts.

    First, each text is compared with two of those that blocks name to it, at most: the smallest number, which is the same
    for most of a group of copies, and that of the most shared blocks. Then all pairs of different components that share a
    block are compared: those of larger blocks, with all that they share documents with, in tiles of groups
    (_links_in_groups), and what pairs blocks of up to SMALL_BLOCK have beyond that one by one. So many texts that share
    keys, but are not similar, meet in tiles and not as pairs. The smallest id of a component stays. Texts without words are
    only copies of each other; very long texts count with all their shingles; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found, sizes, texts = np.zeros((n, WIDE), dtype=np.int64), np.zeros(n, dtype=np.int64), []
            for row, text in enumerate(batch.column(1)):  # the words of one text at a time
                words = (text.as_py() or b"").lower().split()
                hashes = shingle_hashes(words, SHINGLE)
                found[row], sizes[row] = wide_fingerprint(hashes, WIDE), len(hashes)
                texts.append(text_key(words))
            columns = [batch.column(0), *[pa.array(found[:, i]) for i in range(PRINTS)], pa.array(sizes), pa.array([row.tobytes() for row in found], pa.binary()), pa.array(texts, pa.binary())]
            yield pa.record_batch(columns, names=["id", *names, "size", "prints", "key"])

    spark = docs.sparkSession
    bounded_batches(spark, 2 << 20)
    names = [f"f{i}" for i in range(PRINTS)]
    rows = _plain(docs, id_col, text_col)
    fields = ", ".join(f"{n} bigint" for n in ["id", *names, "size"])
    prints = materialize(rows.mapInArrow(run, f"{fields}, prints binary, key binary"), "copies-prints")
    reps = prints.groupBy("key").agg(F.min("id").alias("id"), *[F.first(n).alias(n) for n in [*names, "size", "prints"]])
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("rep"), "*"), "copies-classes")  # written, so that numbers stay
    whose = reps.select("rep", "id", "key")
    blocks = materialize(key_blocks(reps.where("size > 0")), "copies-blocks")

    def close(pairs: DataFrame) -> DataFrame:
        """Those of distinct pairs whose SimHashes are near enough to be compared."""
        for end in ("u", "v"):
            pairs = pairs.join(reps.select(F.col("rep").alias(end), *[F.col(n).alias(f"{end}{n}") for n in names]), end)
        far = sum((F.bit_count(F.col(f"u{n}").bitwiseXOR(F.col(f"v{n}"))) for n in names), F.lit(0))
        return materialize(pairs.where(far <= FAR_BITS).select("u", "v"), "copies-links")

    shared = blocks.where("rep <> one").groupBy("rep", "one").agg(F.count("*").alias("times"))
    first = shared.groupBy("rep").agg(F.array(F.min("one"), F.max_by("one", F.struct("times", "one"))).alias("ones"))
    links = close(first.select(F.explode(F.array_distinct("ones")).alias("u"), F.col("rep").alias("v")))
    roots = materialize(components(similar(links, rows, whose)), "copies-roots")
    own = roots.withColumnRenamed("node", "rep")

    # documents that larger blocks connect, unless they are one component
    groups = components(blocks.where((F.col("n") > SMALL_BLOCK) & (F.col("rep") > F.col("one"))).select(F.col("one").alias("u"), F.col("rep").alias("v")).distinct())
    members = groups.select(F.col("node").alias("rep"), F.col("root").alias("grp")).join(own, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    apart = members.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("grp")
    members = materialize(members.join(apart, "grp").join(reps.select("rep", "size", *names), "rep"), "copies-members")
    found = []
    if not members.isEmpty():
        sets = materialize(_sets(rows, whose.join(members.select("rep"), "rep", "left_semi")), "copies-sets")
        found.append(materialize(_links_in_groups(members, sets, names), "copies-tiles"))
        discard(sets)
    place = own.join(members.select("rep", "grp"), "rep", "full")
    small = blocks.where(F.col("n") <= SMALL_BLOCK).join(place, "rep", "left")
    small = small.groupBy("k", "block").agg(F.collect_list(F.struct("rep", F.coalesce("root", "rep").alias("root"), "grp")).alias("m"))
    pairs = close(small.select(F.inline(F.expr(APART))).distinct().join(links, ["u", "v"], "left_anti"))
    found.append(similar(pairs, rows, whose))
    # components of components: links between the roots that there were
    more = functools.reduce(DataFrame.unionByName, found)
    if not more.isEmpty():
        for end in ("u", "v"):
            more = more.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
        upper = components(more.select("u", "v")).select(F.col("node").alias("lower"), F.col("root").alias("upper"))
        below = roots.withColumnRenamed("root", "lower").join(upper, "lower", "left").select("node", F.coalesce("upper", "lower").alias("root"))
        alone = upper.join(roots, F.col("lower") == F.col("node"), "left_anti").select(F.col("lower").alias("node"), F.col("upper").alias("root"))
        roots = materialize(below.unionByName(alone), "copies-roots")
    owned = whose.join(roots, whose.rep == roots.node, "left").withColumn("root", F.coalesce("root", "rep"))
    owned = materialize(owned.groupBy("root").agg(F.min(F.struct("id", "key")).alias("one")).select("one.id", "one.key"), "copies-kept")
    discard(reps, blocks, links, members, pairs, *found, roots)
    return prints.select("id", "key").join(owned.withColumn("keep", F.lit(True)), ["id", "key"], "left").select("id", "key", F.coalesce("keep", F.lit(False)).alias("keep"))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` with the smallest number for null ids and the bytes of texts."""
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).cast("binary").alias("text"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: the smallest id of each group stays, once if rows repeat.

    A null id counts as the smallest of all. Different texts that share an id, or have none, are documents of their own.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns of docs may have any name
    rows = docs.toDF(*names)
    given_id, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    groups = copy_groups(rows, given_id, text).groupBy("id", "key").agg(F.count("*").alias("rows"), F.first("keep").alias("keep"))
    groups = materialize(groups, "copies-rows")
    kept = groups.where("keep").select(F.col("id").alias("copy_id"), F.col("key").alias("copy_key"), F.col("rows").alias("copy_rows"))
    own_id = F.coalesce(F.col(given_id).cast("bigint"), F.lit(-(1 << 63)))
    if groups.groupBy("id").agg(F.sum("rows").alias("n")).where("n > 1").isEmpty():  # an id is enough to tell rows apart
        return rows.join(kept, own_id == F.col("copy_id"), "left_semi").toDF(*docs.columns)

    @F.pandas_udf("binary")
    def key_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: text_key((t or b"").lower().split()))

    rows = rows.withColumn("copy_key", key_of(F.col(text).cast("binary"))).withColumn("copy_id", own_id)
    found = rows.join(kept, ["copy_id", "copy_key"])
    # of repeated rows one stays; the others need no shuffle
    once = found.where("copy_rows = 1").unionByName(found.where("copy_rows > 1").dropDuplicates(["copy_id", "copy_key"]))
    return once.select(*names).toDF(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
