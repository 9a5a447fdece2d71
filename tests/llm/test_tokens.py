import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from slatework.llm.bytebpe import byte_bpe, default_files
from slatework.llm.packing import SumOfSquares, pack_documents, pieces
from slatework.llm.tokencount import token_counts

from .odd import TEXTS

SCHEMA = "doc_id bigint, text string, chunk int, fp int"


def rows():
    return [(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(3, "again and again", 0, 0)] * 3


def test_token_counts_match_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts(spark.createDataFrame(rows(), SCHEMA)).collect()
    want = sorted((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _, _ in rows())
    assert sorted(tuple(r) for r in got) == want


def test_token_counts_of_an_empty_table(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def _gpt_ids(text):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_match_the_library(spark):
    got = {(r.doc_id, r.start): r for r in pieces(spark.createDataFrame(rows()[: len(TEXTS)], SCHEMA), window=64).collect()}
    want = 0
    for i, text in enumerate(TEXTS):
        ids = np.array(_gpt_ids(text), dtype="<u4")
        for at in range(0, len(ids), 64):
            r = got[i, at]
            assert (r.length, r.doc_tokens) == (len(ids[at : at + 64]), len(ids)), (i, text[:30])
            assert r.ids_crc32 == zlib.crc32(ids[at : at + 64].tobytes()), (i, text[:30])
            want += 1
    assert len(got) == want


def test_packing_fills_windows_without_gaps(spark):
    got = pack_documents(spark.createDataFrame(rows(), SCHEMA)).toPandas()
    assert len(got) == sum(-(-len(_gpt_ids(t)) // 1024) for _, t, _, _ in rows())
    for _, window in got.sort_values("offset").groupby("sequence_id"):
        assert window["offset"].tolist() == [0, *window["length"].cumsum().tolist()[:-1]]
        assert window["length"].sum() <= 1024
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].nunique()))


def test_packing_an_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sum_of_squares_against_brute_force():
    rng = np.random.default_rng(1)
    packer, levels = SumOfSquares(50), {}
    for size in rng.integers(1, 51, 400).tolist():
        def cost(level):
            after = dict(levels)
            if level:
                after[level] -= 1
            if level + size < 50:
                after[level + size] = after.get(level + size, 0) + 1
            return sum(n * n for n in after.values())
        open_levels = [h for h, n in levels.items() if n and h + size <= 50] + [0]
        best = min(map(cost, open_levels))
        _, level = packer.place(size)
        assert level in open_levels and cost(level) == best
        if level:
            levels[level] -= 1
        if level + size < 50:
            levels[level + size] = levels.get(level + size, 0) + 1


@pytest.mark.parametrize("leaf_chars, fan_in", [(8192, 64), (24, 2)])
def test_word_bpe_matches_the_library(spark, leaf_chars, fan_in):
    from slatework.llm.wordbpe import encode_decode

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    more = ["".join(rng.choice(list(letters), 3000)) for letters in ("ab", "the", "ing", "aeiourstlnmdé", "!?.#")]
    more += ["".join(rng.choice(list("abe  \n.,'1é́😀"), n)) for n in (2000, 30_000)] + ["don't\0stop " * 2000, (" " * 900 + "it's") * 30]
    given = rows() + [(1000 + i, t, 0, 0) for i, t in enumerate(more)] + [(None, "no id", 0, 0)]
    want = sorted((str(i), np.array((e := library.encode(t or "", add_special_tokens=False)).ids, dtype="<u4").tobytes(), library.decode(e.ids, skip_special_tokens=False)) for i, t, _, _ in given)
    found = encode_decode(spark.createDataFrame(given, SCHEMA), leaf_chars=leaf_chars, fan_in=fan_in)
    got = sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in found.collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b, (a[0], a[2][:80], b[2][:80])
    assert encode_decode(spark.createDataFrame([], SCHEMA)).collect() == []


def test_huffman_round_trip(spark, tmp_path):
    from slatework.llm.huffman import encode_ids, read_ids, write_ids

    tokens = encode_ids(spark.createDataFrame(rows()[: len(TEXTS)], SCHEMA).repartition(3))
    write_ids(tokens, f"file://{tmp_path}/ids")
    got = sorted(tuple(r) for r in read_ids(spark, f"file://{tmp_path}/ids").collect())
    before = 0
    for (doc, start, raw), text in zip(got, TEXTS, strict=True):
        want = np.array(_gpt_ids(text), dtype="<u4")
        assert start == before and bytes(raw) == want.tobytes(), doc
        before += len(want)
    write_ids(encode_ids(spark.createDataFrame([], SCHEMA)), f"file://{tmp_path}/none")
    assert read_ids(spark, f"file://{tmp_path}/none").collect() == []


def test_code_lengths_are_optimal_and_limited():
    import heapq

    from slatework.llm.huffman import code_lengths

    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = rng.integers(0, 1000, 40) ** 2
        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        best = 0
        while len(heap) > 1:
            heapq.heappush(heap, (pair := heapq.heappop(heap) + heapq.heappop(heap)))
            best += pair
        free = code_lengths(counts, 30).astype(int)
        assert (free * counts).sum() == best
        short = code_lengths(counts, 6).astype(int)
        assert short.max() <= 6 and sum(2.0 ** -x for x in short if x) <= 1


def test_byte_ids_match_the_library_around_specials_and_cuts():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a{end} b  {end}{end}c {end[:-1]}", f"  x {end}", "y " * 70_000 + "  \n b", "q" * 70_000, "d\u00e9  \x85 y " * 9_000]
    for text in texts:
        assert byte_bpe(*default_files()).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_blocks_of_ids_are_decoded_a_few_documents_at_a_time():
    from slatework.llm.common import pack
    from slatework.llm.huffman import Codes, code_lengths, decode_block

    rng = np.random.default_rng(6)
    docs = [np.minimum(rng.geometric(0.01, n), 999).astype("<u2") for n in (1, 700, 512, 1024, 9000, 3, 2000, 513, 1)]
    codes = Codes(code_lengths(np.bincount(np.concatenate(docs), minlength=1000)))
    bits, marks = zip(*codes.encode(docs))
    index = pack((list(range(len(docs))), np.array([len(d) for d in docs]), np.array([len(b) for b in bits]), np.concatenate(marks).astype("<u4")))
    got = list(decode_block(codes, index, b"".join(bits), 3000))
    assert [own for own, _, _ in got] == [[0, 1, 2, 3], [4], [5, 6, 7, 8]]
    assert all(ids.tolist() == np.concatenate([docs[i] for i in own]).tolist() and ns.tolist() == [len(docs[i]) for i in own] for own, ns, ids in got)
