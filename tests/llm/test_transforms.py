"""Fill-in-middle, Order MinHash and source divergence against plain Python, on odd rows and small tables."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatework.llm import divergence, ordermin
from slatework.llm.divergence import runs, source_divergence
from slatework.llm.fillmiddle import code_points, fill_in_middle, restore
from slatework.llm.ordermin import order_minhash, signature

from .odd import TEXTS

HARD = [*TEXTS, "<P>a", "a<S>", "<M>", "a<P", "<S<", "x" * 4096, "😀" * 9000, "$1 \\2 $", "a\r\nb c\u0085", "<" * 50, "P>S>M>" * 9]


def middle(doc_id, text):
    """n, form, prefix_chars, middle_chars and output by slices."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_in_middle(spark):
    rows = [(None if i % 17 == 5 else i, t, i, "x") for i, t in enumerate(HARD * 8)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` int, form string").repartition(5)
    found = fill_in_middle(table)
    assert found.columns == ["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = {r["a.b"]: r for r in found.withColumn("restored", restore(F.col("output"), F.col("form"))).collect()}
    assert len(got) == len(rows) and {r["form"] for r in got.values()} == {"plain", "psm", "spm"}
    for i, t, at, _ in rows:
        r = got[at]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == middle(i, t), (i, t)
        assert r["restored"] == (t or "")


def test_fill_in_middle_of_very_long_and_no_rows(spark):
    long = "ab😀\n" * 500_000
    table = spark.createDataFrame([(i, long) for i in range(4)], "doc_id int, text string")
    got = fill_in_middle(table).withColumn("same", restore(F.col("output"), F.col("form")) == F.col("text")).collect()
    assert all((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == middle(r["doc_id"], long) and r["same"] for r in got)
    assert fill_in_middle(table.where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 8192, 10_000])
def test_code_points_are_counted_in_blocks(spark, n):
    assert spark.range(1).select(code_points(F.lit("é" * n)).alias("n")).first().n == n


def order_min(text, k=ordermin.K, tuples=ordermin.TUPLES, length=ordermin.LENGTH):
    """By the definition: numbered k-mers by the rank of their hash, the smallest in order of places."""
    if not text:
        return [0] * tuples
    mix = lambda x: int(ordermin._mix(np.array([x % (1 << 64)], dtype=np.uint64))[0])
    one, two, three = int(ordermin._M1), int(ordermin._M2), int(ordermin._M3)
    factors = [one * two**i for i in range(10)]

    def gram(points):
        total = 0
        for i, c in enumerate(points):
            factor = 1
            for bit in range(k.bit_length() - 1):
                if not i >> bit & 1:
                    factor *= factors[bit]
            total += (c + three) * factor
        return mix(total)

    points = [ord(c) for c in text]
    grams = [gram(points[i : i + k]) for i in range(len(points) - k + 1)] or [ordermin.hash_of(points)]
    seen, numbered = collections.Counter(), []
    for g in grams:
        numbered.append(mix(g ^ (seen[g] * one + three) % (1 << 64)) >> 32)
        seen[g] += 1
    found = []
    for seed in ordermin.orders(tuples).tolist():
        chosen = sorted(sorted(range(len(grams)), key=lambda i: (numbered[i] * seed % (1 << 32), i))[:length])
        h = three
        for i in chosen:
            h = mix(h * one + grams[i])
        found.append(h >> 32)
    return found


def test_signatures_follow_their_definition(monkeypatch):
    monkeypatch.setattr(ordermin, "STRETCH", 64)
    rng = np.random.default_rng(5)
    texts = ["", "a", "ab", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaaaaa", "😀é" * 40, "".join(rng.choice(list("abc "), 300)), "".join(rng.choice(list("abcdefghij é"), 129))]
    for t in texts:
        assert signature(ordermin.codes(t)).tolist() == order_min(t), t
        assert signature(ordermin.codes(t), tuples=9, length=3).tolist() == order_min(t, tuples=9, length=3), t


def test_signatures_are_sensitive_to_edits_and_order():
    rng = np.random.default_rng(6)
    words = [f"{w:x}" for w in rng.integers(1 << 28, size=600)]
    near = lambda a, b: ordermin.likeness(signature(ordermin.codes(" ".join(a))), signature(ordermin.codes(" ".join(b))))
    assert near(words, words) == 1 and near(words, words[::-1]) < 0.3
    few, many = list(words), list(words)
    for i in range(0, 600, 60):
        few[i] = "edit"
    for i in range(0, 600, 6):
        many[i] = "edit"
    assert near(words, few) > near(words, many) + 0.2 > 0.2
    # the same k-mers in another order: halves that change places are less alike than one edit makes them
    assert near(words, words[300:] + words[:300]) < 0.75 < near(words, [*words[:-1], "x"])


def minhash_rows(rows):
    """What order_minhash says of ``(id, text)`` rows."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    hexed = lambda s: "".join(f"{x:08x}" for x in s.tolist())
    found = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (signature(ordermin.codes(x)) for x in (t, edited, after))
        found.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), float((a == b).mean()), float((a == c).mean())))
    return sorted(found, key=repr)


def test_order_minhash_rows(spark):
    rng = np.random.default_rng(7)
    texts = [*TEXTS, *("".join(rng.choice(list("abcdef g"), n)) for n in (5, 50, 500, 5000)), "x" * 100_000]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) * 7 - 50, texts)]
    for own in (rows, rows[:1], rows[:2], rows + rows[:9] + [(None, "none"), (None, None), (None, "none"), (-(1 << 63), "low"), ((1 << 63) - 1, "high")], [(4, t) for _, t in rows[:20]]):
        table = spark.createDataFrame([(*r, 1, 2) for r in own], "doc_id bigint, text string, chunk int, late int").repartition(3)
        assert sorted(map(tuple, order_minhash(table).collect()), key=repr) == minhash_rows(own)
    assert order_minhash(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def audit(rows, least=10, top=10):
    """Pairs and terms of ``(lang, source, text)`` rows with Python's integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(low))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    found = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = [s for own, s in counts if own == lang]
        whole = {t: sum(counts[lang, s][t] for s in groups) for t in kept}

        def p(own):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        own, q = {s: p(counts[lang, s]) for s in groups}, p(whole)
        for s in groups:
            pairs = sorted((-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((-f(own[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > q[t])[:top]
            found += [(lang, s, part, item.decode(), -v, i) for part, ranked in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(found)


@pytest.mark.parametrize("often, held, block", [(divergence.OFTEN, divergence.HELD, divergence.BLOCK), (2, 5, 7), (1, 10_000, 50)])
def test_source_divergence(spark, monkeypatch, often, held, block):
    monkeypatch.setattr(divergence, "OFTEN", often)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = np.random.default_rng(9)
    words = ["the", "The", "ÉA", "éa", "naïve", "日本", "x1y", "a_b", "c-d", "😀", "zebra", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(("en", "de", None)[i % 3], ("s1", "s2", "S3", None, "hot", "hot")[int(rng.integers(6))], " ".join(rng.choice(words, 12, p=np.arange(31, 0, -1) / 496))) for i in range(240)]
    rows += [("en", "without", None), ("en", "signs", "1 2 _ @"), ("fr", "only", "alone"), ("it", "a", "x"), ("it", "b", None), ("", "", ""), ("en", "long", "Ab" * 30_000), ("en", "s1", "the " * 5000)]
    rows += rows[:30]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, source string, text string, term int").repartition(4)
    assert sorted(map(tuple, source_divergence(table).collect())) == audit(rows)
    assert sorted(map(tuple, source_divergence(table, least_docs=100, top=2).collect())) == audit(rows, 100, 2)
    assert source_divergence(table.where("term < 0")).collect() == []


def test_runs():
    ends, values = runs(np.array([3, 3, 3, 0, 0, 7]))
    assert ends.tolist() == [3, 5, 6] and values.tolist() == [3, 0, 7]
    assert runs(np.zeros(0, dtype=int))[0].tolist() == []
