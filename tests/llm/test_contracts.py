"""Every registered query of the training-data operators on a small folder of tables, against brute force."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from slatework.llm import quality
from slatework.llm.queries import ORACLE_SQL, QUERIES

from ..compare import expected, given
from .odd import TEXTS
from .test_rows import brute as fingerprint_of
from .test_transforms import minhash_rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of documents, labels and embeddings, and the documents' rows."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(12)
    words = [f"word{i}" for i in range(200)]
    say = lambda n: " ".join(rng.choice(words, n))
    passage = say(50)
    texts = [t for t in TEXTS if t is None or "\0" not in t] + [say(200) for _ in range(30)] + [f"{say(60)} {passage} {say(60)}" for _ in range(3)] + [say(9000), say(1500)]
    rows = [(i, t, ("en", "de", None)[i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(len(TEXTS), len(rows) - 2)] + [(i, 0, 1) for i in range(5)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=12)], "x") for i in range(150)] + [(150, None, "x"), (151, [math.nan] * 12, "x"), (152, [0.0] * 12, "x"), (100, [1.0] * 12, "x")]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label string").write.parquet(f"{folder}/embeddings.parquet")
    return folder, rows


def run(spark, name, tables):
    return QUERIES[name](spark, tables[0]).toPandas()


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_op1(spark, tables):
    got = run(spark, "op1_quality", tables)
    assert sorted(got.doc_id) == sorted(r[0] for r in tables[1])
    empty = got[got.doc_id.isin([r[0] for r in tables[1] if not r[1]])]
    assert empty.keep.all() and empty.perplexity.isna().all()


def test_op2(spark, tables):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = run(spark, "op2_token_counts", tables)
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, *_ in tables[1])
    assert sorted(got[["doc_id", "n_bytes", "n_tokens", "over_limit"]].itertuples(index=False, name=None)) == want and any(w[3] for w in want)


def test_op3(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, "op3_bpe", tables).set_index("doc_id")
    for i, t, *_ in tables[1]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert tuple(got.loc[i, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_op4(spark, tables):
    got = run(spark, "op4_sharding", tables)
    want = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in tables[1])
    assert sorted(got[["doc_id", "size", "text_crc32"]].itertuples(index=False, name=None)) == want
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()
    counts = got.groupby("shard").size().reindex(range(40), fill_value=0)
    assert counts.max() - counts.min() <= 1 and all(sorted(own.slot) == list(range(len(own))) for _, own in got.groupby("shard"))


def test_op5(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, "op5_huffman", tables).sort_values("doc_id")
    before = 0
    for (i, t, *_), row in zip(tables[1], got.itertuples()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, before, len(ids), crc(ids))
        before += len(ids)


def test_op6(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, "op6_packing", tables)
    total = 0
    for i, t, *_ in tables[1]:
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 0], 0
        for row in got[got.doc_id == i].sort_values("start").itertuples():
            assert (row.start, row.doc_tokens, row.ids_crc32) == (at, len(ids), crc(ids[at : at + row.length]))
            at += row.length
        assert at == len(ids)
        total += at
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024
    # little padding: no more than one sequence in twenty beyond what full ones would be, and a few for what is left over
    assert got.sequence_id.nunique() <= 1.05 * total / 1024 + 3


def test_op7(spark, tables):
    got = run(spark, "op7_substrings", tables).set_index("doc_id")
    split = [(t or "").encode().split() for _, t, *_ in tables[1]]
    count = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    for (doc, *_), w in zip(tables[1], split):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert tuple(got.loc[doc, ["n_words", "n_removed", "kept_sha256"]]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_op8(spark, tables):
    got = run(spark, "op8_anisotropic", tables)
    rows = spark.read.parquet(f"{tables[0]}/embeddings.parquet").where("vec_id < 150").toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(np.float64)
    ids, want = rows.vec_id.to_numpy(), collections.Counter()
    for row in np.flatnonzero(ids % 20 == 0):  # id 100 has two rows
        s = (x * x[row]).sum(1)
        want.update((ids[row], ids[i], s[i]) for i in [i for i in np.lexsort((ids, -s)) if i != row][:20])
        scores = {(v, p) for v, p in zip(ids, s)}
        if ids[row] != 100:
            own = got[got.query_id == ids[row]].sort_values("rank")
            assert own["rank"].tolist() == list(range(1, 21)) and all((r.vec_id, r.score) in scores for r in own.itertuples())
    found = collections.Counter((r.query_id, r.vec_id, r.score) for r in got.itertuples())
    assert len(got) == 180 and sum((found & want).values()) >= 0.9 * 180


def test_op9(spark, tables):
    assert given(QUERIES["op9_norm_buckets"](spark, tables[0])) == expected(tables[0], ORACLE_SQL["op9_norm_buckets"], ["embeddings"])


def test_op7_sql(spark, tables):
    assert given(QUERIES["op7_substrings"](spark, tables[0])) == expected(tables[0], ORACLE_SQL["op7_substrings"], ["documents"])


def test_op10(spark, tables):
    got = run(spark, "op10_simhash", tables).set_index("doc_id")
    prints = {i: fingerprint_of(t) for i, t, *_ in tables[1]}
    root = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if bin(prints[a] ^ prints[b]).count("1") <= 2 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    for i, p in prints.items():
        assert tuple(got.loc[i, ["fingerprint", "component_id"]]) == (f"{p:016x}", root[i])


def test_op11(spark, tables):
    assert given(QUERIES["op11_fill_middle"](spark, tables[0])) == expected(tables[0], ORACLE_SQL["op11_fill_middle"], ["documents"])


def test_op12(spark, tables):
    got = QUERIES["op12_order_minhash"](spark, tables[0])
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect()), key=repr) == minhash_rows([r[:2] for r in tables[1]])


def test_op13(spark, tables):
    assert given(QUERIES["op13_source_divergence"](spark, tables[0])) == expected(tables[0], ORACLE_SQL["op13_source_divergence"], ["documents"])


def kneser_ney(train, order=quality.ORDER):
    """Interpolated modified Kneser-Ney over bytes, from its definition: a function of context and byte."""
    mark = bytes([quality.BEFORE]) * (order - 1)
    counts = {order: collections.Counter(p[i : i + order] for t in train for p in [mark + t] for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        own = collections.Counter()
        for g, n in counts[k + 1].items():
            own[g[1:]] += n if g[1] == quality.BEFORE else 1
        counts[k] = own
    rates, after = {}, {}
    for k, own in counts.items():
        n = [0, *(sum(v == i for v in own.values()) for i in range(1, 5))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3)]
        rates[k] = [0.0, *(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))]
        after[k] = collections.defaultdict(list)
        for g, v in own.items():
            after[k][g[:-1]].append(v)

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / 256
        follow = after[k].get(gram[:-1])
        if not follow:
            return lower
        off = rates[k]
        n = counts[k].get(gram, 0)
        return ((n - off[min(n, 3)]) + sum(off[min(v, 3)] for v in follow) * lower) / sum(follow)

    return lambda text: -sum(math.log(p((mark + text)[i : i + order])) for i in range(len(text)))


def test_model_against_its_definition(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(["the", "a", "cat", "sat", "mat", "né", "on"], n))
    train, docs = [text(30) for _ in range(25)], [text(12), "zzz qqq", "the", "né né", "", None]
    model = quality.Model(spark.createDataFrame([(t,) for t in train], "text string"))
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").coalesce(1)
    nats = kneser_ney([t.encode() for t in train])
    for r in quality.score(rows, model).collect():
        want = nats((r.text or "").encode())
        assert r["_bytes"] == len((r.text or "").encode()) and abs(r["_nats"] - want) <= 1e-5 * max(1, want), (r.text, r["_nats"], want)
