import collections

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slatework.llm.common import components
from slatework.llm import sharding
from slatework.llm.sharding import communication_matrix, hypergeometric, shard_rows, shard_sizes, write_shards
from slatework.llm.simhash import block_masks, fingerprint, near_duplicates

from .odd import TEXTS


def test_matrix_has_exact_sums():
    parts = [10, 0, 7, 33]
    matrix = communication_matrix(parts, shard_sizes(50, 6), 1)
    assert matrix.sum(1).tolist() == parts and matrix.sum(0).tolist() == [9, 9, 8, 8, 8, 8]
    assert communication_matrix([], shard_sizes(0, 4), 1).shape == (0, 4)


def test_matrix_against_dealing_every_row(monkeypatch):
    """Over many draws each entry has the distribution that shuffling the rows themselves gives, by either draw."""
    parts, sizes = [30, 10, 20], [25, 20, 15]
    owner, rng = np.repeat([0, 1, 2], parts), np.random.default_rng(8)
    shard = np.repeat([0, 1, 2], sizes)
    dealt = np.array([np.histogram2d(owner, rng.permutation(shard), bins=(3, 3))[0] for _ in range(4000)])
    for limit in (10**9, 0):
        monkeypatch.setattr(sharding, "LIBRARY_ROWS", limit)
        drawn = np.array([communication_matrix(parts, sizes, [limit, i]) for i in range(4000)])
        assert np.abs(drawn.mean(0) - dealt.mean(0)).max() < 0.2 and np.abs(drawn.std(0) / dealt.std(0) - 1).max() < 0.08
    rng = np.random.default_rng(1)
    large = np.array([hypergeometric(4 * 10**10, 6 * 10**10, 10**6, rng) for _ in range(2000)])
    assert abs(large.mean() - 400_000) < 60 and abs(large.std() / np.sqrt(240_000) - 1) < 0.08


def test_sharding_keeps_columns_of_any_name(spark):
    names = ["doc_id", "_rank", "_bucket", "_at", "_part", "_key", "_ends", "_start", "part", "key", "rank", "c0", "c1", "a.b", "shard"]
    table = spark.createDataFrame([tuple(-i - 100 * j for j in range(len(names))) for i in range(20)], ", ".join(f"`{n}` int" for n in names))
    got = shard_rows(table, 3).collect()
    assert sorted(tuple(r)[:14] for r in got) == sorted(tuple(r)[:14] for r in table.collect())
    assert shard_rows(table, 3).columns == [*names[:-1], "shard", "slot"]


def test_sharding_draws_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_PARTS", 2)
    got = shard_rows(spark.range(1000).repartition(7), 6).toPandas()
    assert sorted(got.groupby("shard").size()) == [166, 166, 167, 167, 167, 167] and got["id"].nunique() == 1000
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_shards_are_even_and_gapless(spark, tmp_path):
    rows = spark.createDataFrame([(i % 90, None if i % 7 == 0 else "t", i) for i in range(205)], "doc_id int, text string, slot int").repartition(5)
    got = shard_rows(rows, 8).toPandas()
    assert len(got) == 205 and set(got.columns) == {"doc_id", "text", "shard", "slot"}
    for shard, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own))) and len(own) in (25, 26)
    assert shard_rows(rows.where("doc_id < 0"), 8).collect() == []
    write_shards(rows, f"file://{tmp_path}/s", 8)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 205


def test_shuffle_is_uniform(spark):
    """Where rows end doesn't depend on where they come from: chi-squared over first and second halves."""
    got = shard_rows(spark.range(8000).repartition(4), 4, seed=3).toPandas()
    table = np.histogram2d(got["id"] // 1000, got["shard"], bins=(8, 4))[0]
    assert ((table - 250) ** 2 / 250).sum() < 55  # 21 degrees of freedom


def brute(text):
    w = (text or "").encode().lower().split()
    s = [w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w] * bool(w)
    h = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


def test_fingerprints_and_components_against_brute_force(spark, monkeypatch):
    import slatework.llm.simhash as sh

    rng = np.random.default_rng(4)
    base = [f"word{i}" for i in range(400)]
    texts = list(TEXTS)
    for _ in range(60):
        own = list(base)
        for at in rng.integers(0, 400, rng.integers(0, 3)):
            own[at] = "new"
        texts.append(" ".join(own))
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, TEXTS[5], 1)]
    prints = [brute(t) for _, t, _ in rows]
    assert [fingerprint(None if t is None else t.encode()) & (1 << 64) - 1 for _, t, _ in rows] == prints
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        for a in range(len(rows)):
            for b in range(a):
                if bin(prints[a] ^ prints[b]).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    low = collections.defaultdict(lambda: 1 << 60)
    for i, r in enumerate(root):
        low[r] = min(low[r], rows[i][0])
    want = sorted((rows[i][0], low[r]) for i, r in enumerate(root))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    for block in (48, 2):
        monkeypatch.setattr(sh, "PAIR_BLOCK", block)
        assert sorted((r.id, r.component) for r in near_duplicates(table).collect()) == want
    assert near_duplicates(table.where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("block", [48, 2])
def test_ids_name_components_but_link_nothing(spark, monkeypatch, block):
    """A text without an id between two that only it links, unlike texts of one id, and a component without any id."""
    import slatework.llm.simhash as sh

    monkeypatch.setattr(sh, "PAIR_BLOCK", block)
    rng = np.random.default_rng(11)
    say = lambda: [f"w{x}" for x in rng.integers(1 << 30, size=400)]
    chain = None
    while chain is None:  # texts a word apart at distances 2, 2 and more than 2
        base = say()
        texts = [" ".join([*base[:at], "new", *base[at + 1 :]]) for at in range(40)]
        found = [brute(t) for t in texts]
        far = [[bin(x ^ y).count("1") for y in found] for x in found]
        near = [(b, a, c) for b in range(40) for a in range(40) for c in range(a) if far[a][b] <= 2 and far[b][c] <= 2 < far[a][c]]
        chain = [texts[i] for i in near[0]] if near else None
    middle, one, two = chain
    far = " ".join(say())
    rows = [(1, one), (None, middle), (3, two), (0, far), (1, far + " x"), (1, "other"), (0, "none"), (None, "alone"), (None, "alone")]
    got = [(r.id, r.component) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).orderBy("fp").collect()]
    prints = [brute(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if bin(prints[a] ^ prints[b]).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    low = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    assert sorted(got, key=repr) == sorted(((rows[i][0], low[r]) for i, r in enumerate(root)), key=repr)
    assert [low[root[i]] for i in (0, 1, 2)] == [1, 1, 1] and low[root[5]] == 1 and low[root[7]] is None


def test_masks_cover_all_close_pairs():
    for bits in (1, 2):
        for _ in range(200):
            flips = np.random.default_rng().choice(64, bits, replace=False)
            x = sum(1 << int(b) for b in flips)
            assert any(x & (m & (1 << 64) - 1) == 0 for m in block_masks(bits))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (7, 7), (5, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).select(F.col("node")).collect() == []
