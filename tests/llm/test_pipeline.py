import collections

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from slatework.llm import simhash
from slatework.llm.quality import classify, keep_quality
from slatework.llm.simhash import drop_near_copies
from slatework.llm.substrings import remove_duplicates

from .odd import TEXTS

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int"
LABELS = "doc_id bigint, quality int, toxic int"
CLASHING = "doc_id bigint, text string, lang string, id bigint, _keep int, _score int, _rows int, chunk int, code int, rep int, part int, n_chars int"


def prose(rng, n):
    words = ["".join(rng.choice(list("aeioulmnrst"), 2 + i % 6)) for i in range(300)]
    return [" ".join(rng.choice(words, n_words)) for n_words in rng.integers(120, 300, n)]


def junk(rng, n):
    return [" ".join("".join(rng.choice(list("#%&*xqzjkw0123456789"), 7)) for _ in range(150)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Rows of documents and labels, and the ids that have to go or stay."""
    rng = np.random.default_rng(11)
    clean = prose(rng, 60)
    texts = list(clean)
    copies = []
    for at in (0, 1, 2):
        exact, words = len(texts), clean[at].split()
        texts.append(clean[at])
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
        copies.append([at, exact, exact + 1])
    passage = " ".join(prose(rng, 1)[0].split()[:60])
    for at in (20, 30, 40):
        words = texts[at].split()
        texts[at] = " ".join([*words[:50], passage, *words[50:]])
    bad = list(range(len(texts), len(texts) + 8))
    texts += junk(rng, 8)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    labels = [(i, 1, 0) for i in range(3, 60)] + [(i, 0, 0) for i in bad[:2]]
    return rows, labels, copies, bad


def without_repeats(texts, window=35):
    """Brute force: the texts without words in a window whose sequence also starts elsewhere."""
    words = [t.split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    kept = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept.append(" ".join(x for j, x in enumerate(w) if j not in gone))
    return kept


def test_the_pipeline_does_what_its_stages_promise(spark, corpus, tmp_path):
    rows, labels, copies, bad = corpus
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    left = set(got["doc_id"])
    # with one held-out fold for all thresholds a few clean documents may lie above them; all junk does
    assert not left & set(bad)
    for group in copies:
        assert len(left & set(group)) <= 1
    clean = set(range(60)) - {i for g in copies for i in g}
    assert len(left & clean) >= 0.9 * len(clean)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = sorted(left)
    for doc, text in zip(ids, without_repeats([rows[i][1] for i in ids])):
        own = got[got["doc_id"] == doc].sort_values("start")
        n = len(library.encode(text, add_special_tokens=False).ids) + 1
        assert set(own["doc_tokens"]) == {n}, doc
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == n
    for _, window in got.sort_values("offset").groupby("sequence_id"):
        assert window["offset"].tolist() == [0, *window["length"].cumsum().tolist()[:-1]] and window["length"].sum() <= 1024


def test_near_copies_keep_one_of_each_group(spark, corpus):
    rows, _, copies, bad = corpus
    left = {r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    assert left == {r[0] for r in rows} - {i for g in copies for i in g[1:]}


def test_stages_take_odd_rows_and_clashing_columns(spark, corpus):
    rows, labels, _, _ = corpus
    odd = [(1000 + i, t, None, i, 1, 2, 3, 4, 5, 6, 7, 0) for i, t in enumerate(TEXTS)]
    odd += [(None, "no id at all", "en", 1, 1, 2, 3, 4, 5, 6, 7, 0), odd[5], odd[0]]
    odd += [(i, t, lang, 0, 1, 2, 3, 4, 5, 6, 7, 0) for i, t, lang, _, _ in rows[3:40]]
    docs, marks = spark.createDataFrame(odd, CLASHING), spark.createDataFrame(labels, LABELS)
    kept = keep_quality(docs, marks)
    assert kept.columns == docs.columns
    found = collections.Counter(r.doc_id for r in kept.collect())
    assert found[1000] == 2 and found[1001] == 1  # null and empty texts stay, repeated rows too
    single = drop_near_copies(docs)
    assert single.columns == docs.columns
    assert max(collections.Counter(r.doc_id for r in single.collect()).values()) == 1
    assert remove_duplicates(docs).count() == len(odd)
    none = docs.where("doc_id < 0")
    assert keep_quality(none, marks).collect() == drop_near_copies(none).collect() == remove_duplicates(none).collect() == []


def test_the_classifier_takes_columns_of_any_name(spark, corpus):
    rows, labels, _, _ = corpus
    names = ["_nats", "_lang", "_mean", "_l", "_bytes", "_limit", "_score", "a.b"]
    docs = spark.createDataFrame([(i, t, "en", *range(8)) for i, t, *_ in rows[:30]], "doc_id bigint, text string, lang string, " + ", ".join(f"`{n}` int" for n in names))
    got = classify(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["doc_id", "text", "lang", *[n for n in names if n != "_score"], "_perplexity", "_score", "_keep"]
    assert {tuple(r)[3:10] for r in got.collect()} == {(0, 1, 2, 3, 4, 5, 7)}


def test_without_trusted_documents_all_stay(spark, corpus):
    docs = spark.createDataFrame(corpus[0][:5], DOCS)
    found = classify(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(found) == 5 and all(r["_keep"] and r["_perplexity"] is None for r in found)


def test_near_copies_hold_against_brute_force_in_groups_larger_than_a_block(spark):
    rng = np.random.default_rng(5)
    base, other = prose(rng, 2)
    texts = []
    for i in range(90):  # variants of one text, and texts that share half of it
        words = base.split()
        words[i % len(words)] = f"v{i}"
        texts.append(" ".join(words))
    for i in range(6):
        texts.append(" ".join([*base.split()[:60], *other.split()[i : i + 60]]))
    texts += ["", None, "two words", "Two  WORDS", "three little words"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} - {()})
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    expected = {min(i for i, g in enumerate(group) if g == k) for k in set(group)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == expected


def hub_and_copies(n, seed):
    """A text of 300 words and n copies of it with six words changed each: similar to it, not to each other."""
    rng = np.random.default_rng(seed)
    base, texts = [f"w{x}" for x in rng.integers(100_000, size=300)], []
    for i in range(n):
        words = list(base)
        for at in range(6):
            words[4 + 50 * at + int(rng.integers(42))] = f"e{i}x{at}"
        texts.append(" ".join(words))
    return " ".join(base), texts


@pytest.mark.parametrize("tile", [1_000_000, 40_000])
def test_a_hub_joins_its_copies_that_are_not_similar_to_each_other(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_HASHES", tile)
    hub, copies = hub_and_copies(500, 21)
    rows = [(i, t) for i, t in enumerate([*copies[:250], hub, *copies[250:]])]
    # by brute force, copies are linked to the hub alone
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    alike = [(i, j) for i in range(501) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) == 500 and all(250 in pair for pair in alike)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in drop_near_copies(docs).collect()] == [0]
    # without the hub none is a near copy
    assert drop_near_copies(docs.where("doc_id <> 250")).count() == 500


def test_pairs_grow_with_documents_where_many_share_keys(spark, monkeypatch):
    """Copies of one text at all similarities: each pair is compared in a group, few are written one by one."""
    rng, n, looked = np.random.default_rng(51), 400, []
    base, texts = [f"w{x}" for x in rng.integers(100_000, size=150)], []
    for i in range(n):
        words = list(base)
        for at in rng.choice(150, rng.integers(1, 16), replace=False):
            words[at] = f"e{i}x{at}"
        texts.append(" ".join(words))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    similar = simhash.similar

    def counted(links, rows, classes):
        looked.append(links.count())
        return similar(links, rows, classes)

    monkeypatch.setattr(simhash, "similar", counted)
    got = {r.doc_id for r in drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {min(i for i, g in enumerate(group) if g == k) for k in set(group)} and 10 < len(got) < n - 10
    assert 0 < sum(looked) <= 8 * n, looked  # some 30 a document when all of a block met its smallest


def test_keys_meet_nearly_all_pairs_at_the_least_similarity():
    """Sets at a similarity of 0.8 to 0.85: random ones, and a stretch that is replaced or appended."""
    rng, met, close, n = np.random.default_rng(31), 0, 0, 0
    for i in range(1500):
        size = int(rng.integers(90, 600))
        words = [f"w{x}".encode() for x in rng.integers(10**6, size=size)]
        other, cut = list(words), size // 10
        if i % 3 == 0:
            other[:cut] = [f"x{j}".encode() for j in range(cut)]
        elif i % 3 == 1:
            other += [f"x{j}".encode() for j in range(size // 5)]
        else:
            for at in rng.choice(size // 10, size // 48, replace=False):
                other[10 * at + 4] = b"changed"
        a, b = simhash.shingle_hashes(words, 5), simhash.shingle_hashes(other, 5)
        shared = len(np.intersect1d(a, b))
        if not 0.8 <= shared / (len(a) + len(b) - shared) <= 0.85:
            continue
        n += 1
        met += bool((simhash.copy_keys(a) == simhash.copy_keys(b)).any())
        far = simhash.wide_fingerprint(a) ^ simhash.wide_fingerprint(b)
        close += int(np.bitwise_count(far.view(np.uint64)).sum()) <= simhash.FAR_BITS
    assert n > 500 and met == close == n, (n, met, close)


def test_texts_without_an_id_or_with_the_same_are_documents_of_their_own(spark):
    rng = np.random.default_rng(41)
    texts = prose(rng, 8)
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[0]), (9, texts[1]), (10, texts[4]), (11, texts[4])]
    left = drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(0, texts[0]), (0, texts[1]), (7, texts[2]), (7, texts[3]), (10, texts[4])])


@pytest.mark.parametrize("repeated", [False, True])
def test_near_copies_keep_columns_of_any_name(spark, repeated):
    names = ["_copy_id", "_copy_key", "_copy_rows", "copy_id", "copy_key", "copy_rows", "id", "key", "keep", "rows", "a.b", "c0", "c1", "doc_id", "text"]
    rows = [(*(-j - 100 * i for j in range(13)), i, f"text number {i % 7}") for i in range(14)]
    rows += [(*r[:13], 2, "of its own") for r in rows[:2]] if repeated else []
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names[:13]) + ", doc_id int, text string")
    got = drop_near_copies(docs)
    assert got.columns == names
    want = [r for r in rows if r[13] < 7 and r[14] != "of its own"]
    left = sorted(map(tuple, got.collect()))
    assert [r for r in left if r[14] != "of its own"] == sorted(want)
    assert [r for r in left if r[14] == "of its own"] == ([r for r in left if r in rows and r[14] == "of its own"]) and len(left) == 7 + repeated


@pytest.mark.parametrize("size", [1, 4, 7, 600])
def test_keys_of_near_copies_are_bits_of_simhashes(size):
    """By plain counting: each key is made of bits that over half of the shingles' hashes have."""
    hashes = np.unique(np.random.default_rng(size).integers(1 << 63, size=size, dtype=np.uint64))
    bits = []
    for salt in simhash.SALTS:
        own = [int(x) for x in simhash.mixed(hashes + salt)]
        bits += [2 * sum(v >> b & 1 for v in own) + (own[0] >> b & 1) > size for b in range(64)]
    wide = simhash.wide_fingerprint(hashes, simhash.WIDE)
    assert [bool(int(x) >> b & 1) for x in wide for b in range(64)] == bits
    assert (simhash.wide_fingerprint(hashes) == wide[: simhash.PRINTS]).all()
    want = [sum(bits[at] << j for j, at in enumerate(places[: simhash.KEY_BITS])) for places in simhash.PLACES]
    assert simhash.copy_keys(hashes).tolist() == want


@pytest.mark.parametrize("met", [1 << 20, 8])
def test_documents_meet_in_the_blocks_of_all_equal_keys(spark, monkeypatch, met):
    monkeypatch.setattr(simhash, "MET", met)
    monkeypatch.setattr(simhash, "DEALT", 16)
    rng = np.random.default_rng(3)
    prints = rng.integers(-(1 << 63), 1 << 63, size=(40, simhash.WIDE))
    for i in range(1, 40, 2):  # a few bits from the one before, or none
        prints[i] = prints[i - 1] ^ (1 << rng.integers(63, size=simhash.WIDE) if i % 4 == 1 else 0)
    reps = spark.createDataFrame([(5 << 33 | i, bytearray(p.tobytes())) for i, p in enumerate(prints)], "rep bigint, prints binary")
    got = {}
    for r in simhash.key_blocks(reps.repartition(3)).collect():
        got.setdefault((r.k, r.block, r.n, r.one), []).append(r.rep)
    want = collections.defaultdict(list)
    for i, keys in enumerate(simhash.print_keys(prints)):
        for k, key in enumerate(keys.tolist()):
            want[k, key].append(5 << 33 | i)
    want = {at: reps for at, reps in want.items() if len(reps) > 1}
    assert want and {at[:2]: sorted(reps) for at, reps in got.items()} == want
    assert all(n == len(reps) and one in reps for (_, _, n, one), reps in got.items())
