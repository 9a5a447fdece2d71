import collections
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from slatework.llm.anisotropic import nearest
from slatework.llm.normbuckets import exact_top_k, quantise
from slatework.llm import substrings
from slatework.llm.substrings import Reference, Words, duplicate_spans, kept_digest, occurrences, remove_duplicates, removed_count, removed_words, stretches, vocabulary
from slatework.llm.vectors import valid


def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)) * rng.choice([1.0, 1.0, 3.0], size=(400, 1))
    x[50:90] = x[50]
    rows = [(i, [float(f) for f in v], 0.5, "x") for i, v in enumerate(x)]
    rows += [(400, None, 0.0, "x"), (401, [float("nan")] * 16, 0.0, "x"), (402, [1.0] * 15 + [None], 0.0, "x"), (403, [0.0] * 16, 0.0, "x"), (404, [float("inf")] * 16, 0.0, "x"), (405, [], 0.0, "x")]
    return x, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score double, vec string")


def truth(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), s[i]) for i in order]
    return out


def test_nearest_finds_nearly_all(spark):
    x, table = vectors(spark)
    got = nearest(table, lambda c: F.col(c) % 20 == 0, rerank=60).toPandas()
    want = truth(np.arange(400), x, range(0, 400, 20), 20)
    assert set(got.query_id) == set(want) and (got.groupby("query_id").size() == 20).all()
    hits = sum(len(set(g.vec_id) & {i for i, _ in want[q]}) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * 400
    for r in got.itertuples():
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9 and r.vec_id != r.query_id
    few = nearest(table.where("vec_id < 5"), lambda c: F.col(c) % 20 == 0).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3, 4] and list(few["rank"]) == [1, 2, 3, 4]
    assert nearest(table.where("vec_id < 0"), lambda c: F.col(c) % 20 == 0).collect() == []


def test_exact_top_k(spark, monkeypatch):
    import slatework.llm.normbuckets as nb

    monkeypatch.setattr(nb, "GROUP_ROWS", 60)
    monkeypatch.setattr(nb, "QUERY_ROWS", 4)
    x, table = vectors(spark)
    got = exact_top_k(quantise(valid(table)), lambda c: F.col(c) % 50 == 0).toPandas()
    whole = np.vstack([np.floor(x * 256), np.zeros((1, 16))]).astype(int)
    ids = np.array([*range(400), 403])
    want = truth(ids, whole, range(0, 400, 50), 5)
    for q, g in got.groupby("query_id"):
        assert [(r.vec_id, r.score) for r in g.sort_values("rank").itertuples()] == want[q]
    assert set(got.query_id) == set(want)
    assert exact_top_k(quantise(valid(table.where("vec_id < 0"))), lambda c: F.col(c) % 50 == 0).collect() == []


def documents(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words, n))
    shared, again = say(60), say(36)
    texts = [None, "", " \n ", "one two", shared, "a " + shared + " b", say(50) + "\n" + shared + "\t" + say(30), again + " x " + again, say(34), "r " * 80, say(5000), "é ü " * 10, shared]
    rows = [(i, t, 7, "en") for i, t in enumerate(texts)] + [(4, shared, 7, "en")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, chunk int, rows string")


def test_duplicate_spans_against_brute_force(spark):
    rows, table = documents(spark)
    split = [(t or "").encode().split() for _, t, _, _ in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = []
    for (doc, *_), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((doc, len(w), sum(gone), kept_digest([x for x, g in zip(w, gone) if not g])))
    got = duplicate_spans(table.repartition(3)).select("doc_id", "_n_words", removed_count().alias("n"), "_kept").collect()
    assert sorted((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in got) == sorted(want)
    assert duplicate_spans(table.where("doc_id < 0")).collect() == []


def covered(texts, length):
    """Brute force: which words a window covers whose words also start elsewhere."""
    count = collections.Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def parsed(blocks, length):
    """The parse of each text, block by block, every block showing others what they ask for."""
    own = [Words(b, length, vocabulary()) for b in blocks]
    holders = collections.defaultdict(list)
    for k, w in enumerate(own):
        for f, n in zip(*np.unique(w.prints, return_counts=True)):
            holders[f].append((k, n))
    wants = collections.defaultdict(list)
    for f, held in holders.items():
        for a, b in [(x[0], y[0]) for x, y in zip(held, held[1:])] + [(y[0], x[0]) for x, y in zip(held[:1], held[1:2])] + [(k, k) for k, n in held if n > 1]:
            wants[a, b].append(f)
    parts = collections.defaultdict(list)
    for (source, to), prints in wants.items():
        starts = occurrences(own[source], np.sort(np.array(prints, dtype=np.uint64)))
        shown = [x for again in range(1 + (source == to)) for x in stretches(blocks[source], own[source], starts[again], length)]
        parts[to] += [(source, at, words) for at, words in shown]
    return [(k, t, f) for k, b in enumerate(blocks) for t, f in enumerate(Reference(parts[k], length, vocabulary()).parse(own[k], k, length) if parts[k] else [[] for _ in b])]


def test_parse_against_brute_force_and_with_clashing_fingerprints(monkeypatch):
    rng, plain = np.random.default_rng(6), substrings.phrase_prints
    for trial in range(300):
        length, words = int(rng.choice([2, 3, 5])), [b"w%d" % i for i in range(rng.choice([2, 4, 12]))]
        passages = [list(rng.choice(words, rng.integers(1, 12))) for _ in range(4)]
        text = lambda: sum([list(passages[rng.integers(4)]) if rng.random() < 0.5 else [rng.choice(words)] for _ in range(rng.integers(0, 8))], [])
        blocks = [[[bytes(w) for w in text()] for _ in range(rng.integers(1, 4))] for _ in range(rng.integers(1, 5))]
        want = covered([t for b in blocks for t in b], length)
        monkeypatch.setattr(substrings, "phrase_prints", plain)
        found = parsed(blocks, length)
        assert [removed_words(f, len(blocks[k][t])).tolist() for k, t, f in found] == want
        for k, t, factors in found:  # every factor's words stand where it says
            for a, b, source, at in factors:
                assert sum(blocks[source], [])[at : at + b - a] == blocks[k][t][a:b]
        monkeypatch.setattr(substrings, "phrase_prints", lambda *x: (lambda p, s: (p & np.uint64(7), s))(*plain(*x)))
        for (k, t, f), right in zip(parsed(blocks, length), want):  # eight different fingerprints: nothing wrong is removed
            assert not (np.array(removed_words(f, len(right))) & ~np.array(right, dtype=bool)).any()


def test_a_text_of_one_word_is_one_factor():
    words = [[b"r"] * 5000]
    own = Words(words, 35, vocabulary())
    parts = [(0, a, w) for starts in occurrences(own, np.unique(own.prints)) for a, w in stretches(words, own, starts, 35)]
    assert len(Reference(parts, 35, vocabulary()).parse(own, 0, 35)[0]) <= 2


def test_parse_keeps_columns_of_any_name(spark):
    names = ["_spans", "_kept", "_n_words", "spans", "kept", "n_words", "block", "rows", "c1", "a.b"]
    table = spark.createDataFrame([(i, "w " * 40, *range(10)) for i in range(3)], "doc_id int, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = remove_duplicates(table)
    assert got.columns == table.columns and [tuple(r)[1:] for r in got.collect()] == [("", *range(10))] * 3
    assert duplicate_spans(table).columns == ["doc_id", "text", *names[3:], "_n_words", "_spans", "_kept"]


def test_removal_keeps_columns_and_untouched_texts(spark):
    rows, table = documents(spark)
    got = remove_duplicates(table)
    assert got.columns == table.columns
    texts = pd.DataFrame([(r.doc_id, r.text) for r in got.collect()]).set_index(0)[1]
    assert texts[2] == " \n " and texts[0] is None and texts[5] == "a b" and texts[11] == "é ü " * 10


def test_nearest_among_many_equal_and_nearly_equal_vectors(spark):
    """Production settings: 128 of a group of up to 8,192; a third of the rows are copies, a sixth nearly so."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(8000, 64))
    hot = rng.permutation(8000)[:4000]
    x[hot] = x[0]
    x[hot[:1300]] += rng.normal(size=(1300, 64)) * 0.01
    ids = rng.permutation(8000)
    table = spark.createDataFrame([(int(i), [float(f) for f in v]) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    got = nearest(table, lambda c: F.col(c) % 100 == 0).toPandas()
    hits, equal = [], 0
    for q, g in got.groupby("query_id"):
        s = (x * x[list(ids).index(q)]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits.append(len(set(g.vec_id) & {int(ids[i]) for i in order}) / 20)
        equal += list(g.sort_values("rank").vec_id) == [int(ids[i]) for i in order]
    assert len(hits) == 80 and np.mean(hits) >= 0.98 and min(hits) >= 0.8 and equal >= 60, (np.mean(hits), min(hits), equal)


def test_searches_take_all_lengths_and_rows_of_one_id_find_each_other(spark, monkeypatch):
    import slatework.llm.normbuckets as nb

    monkeypatch.setattr(nb, "GROUP_ROWS", 100)
    x, table = vectors(spark)
    odd = [(900 + i, [2.0] * 17, 0.0, "x") for i in range(3)] + [(100, [float(f) for f in x[100]], 0.5, "x"), (200, [3.0] * 16, 0.5, "x"), (1000, [1.0] * 5, 0.0, "x")]
    more = table.unionByName(spark.createDataFrame(odd, table.schema))
    ids = np.array([*range(400), 900, 901, 902, 100, 200, 1000])
    padded = np.zeros((406, 17))
    padded[:400, :16], padded[400:403], padded[403, :16], padded[404, :16], padded[405, :5] = x, 2.0, x[100], 3.0, 1.0
    for got, k, every, all_ids, values in (
        (nearest(more, lambda c: F.col(c) % 20 == 0, rerank=60), 20, 20, ids, padded),
        (exact_top_k(quantise(valid(more)), lambda c: F.col(c) % 50 == 0), 5, 50, np.append(ids, 403), np.vstack([np.floor(padded * 256), np.zeros((1, 17))])),
    ):
        want = []
        for row in np.flatnonzero(all_ids % every == 0):
            s = (values * values[row]).sum(1)
            order = [i for i in np.lexsort((all_ids, -s)) if i != row][:k]
            want += [(int(all_ids[row]), rank, int(all_ids[i]), float(s[i])) for rank, i in enumerate(order, 1)]
        rows = sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in got.collect())
        if k == 5:
            assert rows == sorted(want)
        near = lambda found: collections.Counter((q, v) for q, _, v, _ in found)
        assert len(rows) == len(want) and sum((near(rows) & near(want)).values()) >= 0.95 * len(want)
        assert near(rows)[100, 100] == 2  # both rows of it ask, and find the other


def test_searches_take_huge_and_tiny_components(spark):
    rng = np.random.default_rng(2)
    for scale in (1e200, 1e-170, 1e15):
        x = rng.normal(size=(60, 8)) * scale
        table = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        got = nearest(table, lambda c: F.col(c) % 20 == 0).toPandas()
        for q, own in got.groupby("query_id"):
            with np.errstate(over="ignore", invalid="ignore"):
                s = (x * x[q]).sum(1)
            order = [i for i in np.lexsort((np.arange(60), -s)) if i != q and not np.isnan(s[i])][:20]
            assert list(own.sort_values("rank").vec_id) == order
        exact = exact_top_k(quantise(valid(table)), lambda c: F.col(c) % 50 == 0).toPandas()
        whole = [[int(np.floor(256 * f)) for f in v] for v in x]
        for q, own in exact.groupby("query_id"):
            s = [min(max(sum(a * b for a, b in zip(v, whole[q])), -(1 << 63)), (1 << 63) - 1) for v in whole]
            assert list(own.sort_values("rank").vec_id) == sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:5], scale
