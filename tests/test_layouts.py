"""Neighbours, cuts and batches on dense pages and long decks, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatework.operators import batches as bt
from slatework.operators import objects as ob
from slatework.operators import regions as rg
from slatework.operators import spatial as sp

OBJECTS = "deck_id bigint, page bigint, z_index bigint, kind string, x double, y double, w double, h double, text string"


def page(n, size, seed, widest=60.0, deck=1, number=1):
    rng = np.random.default_rng(seed)
    kinds = rng.choice(["shape", "connector", "raster", "vector"], n, p=[0.6, 0.2, 0.1, 0.1])
    side = lambda: np.where(rng.random(n) < 0.02, rng.random(n) * size / 3, rng.random(n) * widest)
    at = np.where(rng.random((n, 1)) < 0.3, rng.random((n, 2)) * size / 40, rng.random((n, 2)) * size)  # a third lies close together
    return [(deck, number, i, str(kinds[i]), float(np.round(at[i, 0], 1)), float(np.round(at[i, 1], 1)), float(np.round(w, 1)), float(np.round(h, 1)), "t" if i % 3 else " ") for i, (w, h) in enumerate(zip(side(), side()))]


def near(a, b, gap=40, text_gap=100):
    gap_x = max(a[4], b[4]) - min(a[4] + a[6], b[4] + b[6])
    gap_y = max(a[5], b[5]) - min(a[5] + a[7], b[5] + b[7])
    wide = text_gap if a[8].strip() and b[8].strip() else gap
    return (gap_x <= wide and gap_y <= gap) or (gap_y <= wide and gap_x <= gap)


def middle(o):
    return o[4] + o[6] / 2, o[5] + o[7] / 2


@pytest.mark.parametrize("small", [64, 0])
def test_neighbours_by_arrays_and_by_cells(spark, monkeypatch, small):
    monkeypatch.setattr(sp, "SMALL_PAGE", small)
    rows = page(220, 3000.0, 1) + page(40, 500.0, 2, number=2) + page(1, 10.0, 3, number=3) + page(3, 10.0, 4, deck=2) + [(2, 9, i, "connector", 5.0, 5.0, 0.0, 0.0, "") for i in range(3)]
    rows += [(3, 1, 0, "shape", None, 1.0, 2.0, 3.0, ""), (3, 1, 1, "shape", -50.0, -60.0, -20.0, 5.0, "x"), (3, 1, 2, "connector", -65.0, -60.0, 1e7, 5.0, "x")]
    table = spark.createDataFrame(rows, OBJECTS).repartition(3)
    pages = {}
    for r in rows:
        if r[4] is not None:
            pages.setdefault(r[:2], []).append(r)
    got = sorted(map(tuple, ob.adjacency(table).collect()))
    assert got == sorted((*k, a[2], b[2]) for k, own in pages.items() for a in own for b in own if a[2] < b[2] and near(a, b))

    def overlap(a, b):
        (ax, ay), (bx, by) = middle(a), middle(b)
        gx, gy = max(0.0, abs(ax - bx) - (a[6] + b[6]) / 2), max(0.0, abs(ay - by) - (a[7] + b[7]) / 2)
        return (gx == 0 and gy <= 40) or (gy == 0 and gx <= 40)

    wide = {k: [r for r in own if r[6] >= 0] for k, own in pages.items()}
    got = sorted(map(tuple, ob.overlapping(table.where("w >= 0")).collect()))
    assert got == sorted((*k, a[2], b[2]) for k, own in wide.items() for a in own for b in own if a[2] < b[2] and overlap(a, b))
    d2 = lambda a, b: (middle(a)[0] - middle(b)[0]) ** 2 + (middle(a)[1] - middle(b)[1]) ** 2
    want = []
    for k, own in pages.items():
        for a in own:
            if a[3] == "connector":
                order = sorted((d2(a, b), b[2]) for b in own if b[3] != "connector")[:2]
                want += [(*k, a[2], i, z) for i, (_, z) in enumerate(order, 1)]
    assert sorted(tuple(r)[:5] for r in ob.nearest_two(table).collect()) == sorted(want)
    want = []
    for k, own in pages.items():
        for a in own:
            ahead = [(d2(a, b), b[2]) for b in own if a[2] != b[2] and (dx := middle(b)[0] - middle(a)[0]) > -10 and (dy := middle(b)[1] - middle(a)[1]) > -10 and (dx > 0 or dy > 0)]
            if ahead and min(ahead)[0] < 160000:
                want.append((*k, a[2], min(ahead)[1]))
    assert sorted(map(tuple, ob.neighbour_edges(table).collect())) == sorted(want)


def test_nearest_nodes_that_ask_themselves(spark, monkeypatch):
    monkeypatch.setattr(sp, "SMALL_PAGE", 0)
    rng = np.random.default_rng(8)
    at = np.round(np.concatenate([rng.random((150, 2)), rng.random((50, 2)) * 1e-3, np.zeros((3, 2))]) * 1000, 1)
    points = spark.createDataFrame([(1, 1, i, float(x), float(y), True, True) for i, (x, y) in enumerate(at)], "deck_id bigint, page bigint, z_index bigint, cx double, cy double, asks boolean, is_node boolean")
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    want = [(1, 1, i, r, z) for i in range(len(at)) for r, (_, z) in enumerate(sorted((d2[i, j], j) for j in range(len(at)) if j != i)[:3], 1)]
    assert sorted(tuple(r)[:5] for r in sp.nearest(points, 3).collect()) == want


def test_a_page_of_100_000_objects(spark):
    """Spread out and in a dense corner, small and very large: what is compared stays near what is found."""
    n, size = 100_000, 60_000.0
    rng = np.random.default_rng(3)
    x, y = (np.where(rng.random(n) < 0.2, rng.random(n) * size / 8, rng.random(n) * size).round(1) for _ in "xy")
    w, h = (np.where(rng.random(n) < 0.001, rng.random(n) * size / 10, rng.random(n) * 60).round(1) for _ in "xy")
    import pandas as pd

    frame = pd.DataFrame({"deck_id": 1, "page": 1, "z_index": np.arange(n), "kind": np.where(np.arange(n) % 5 == 0, "connector", "shape"), "x": x, "y": y, "w": w, "h": h, "text": np.where(np.arange(n) % 2, "t", "")})
    table = spark.createDataFrame(frame).repartition(8)
    found = ob.adjacency(table).toPandas()
    for i in rng.integers(n, size=60):
        gap_x = np.maximum(x, x[i]) - np.minimum(x + w, x[i] + w[i])
        gap_y = np.maximum(y, y[i]) - np.minimum(y + h, y[i] + h[i])
        wide = np.where((np.arange(n) % 2 == 1) & (i % 2 == 1), 100, 40)
        own = set(np.flatnonzero(((gap_x <= wide) & (gap_y <= 40)) | ((gap_y <= wide) & (gap_x <= 40)))) - {i}
        assert set(found.b[found.a == i]) | set(found.a[found.b == i]) == own
    two = ob.nearest_two(table).toPandas()
    assert len(two) == 2 * n // 5
    cx, cy = x + w / 2, y + h / 2
    node = np.arange(n) % 5 != 0
    for i in rng.integers(n // 5, size=40) * 5:
        d2 = np.where(node, (cx - cx[i]) ** 2 + (cy - cy[i]) ** 2, np.inf)
        assert two[two.z_index == i].sort_values("rank").node.tolist() == np.lexsort((np.arange(n), d2))[:2].tolist()
    ahead = ob.neighbour_edges(table).toPandas().set_index("a").b
    for i in rng.integers(n, size=40):
        dx, dy = cx - cx[i], cy - cy[i]
        d2 = np.where((dx > -10) & (dy > -10) & ((dx > 0) | (dy > 0)) & (np.arange(n) != i), dx * dx + dy * dy, np.inf)
        assert (ahead.get(i) == d2.argmin()) if d2.min() < 160000 else i not in ahead.index
    parts = ob.clusters(table).toPandas()
    assert len(parts) == n and (parts.root <= parts.z_index).all() and (parts.set_index("z_index").root.loc[parts.root.unique()].to_numpy() == parts.root.unique()).all()


def split(objects, gap, least):
    """Recursive cuts of ``(z, kind, x, y, w, h)``, one cluster after the other."""
    if len(objects) < 2 or any(o[1] == "connector" for o in objects):
        return [objects]

    def bands(values, tolerance):
        values = sorted(values)
        return 1 + sum(b - a > tolerance for a, b in zip(values, values[1:]))

    if len(objects) >= 4:
        cols, rows = bands([round(o[2] + o[4] / 2) for o in objects], 60), bands([round(o[3] + o[5] / 2) for o in objects], 50)
        if cols >= 2 and rows >= 2 and len(objects) >= 0.6 * cols * rows:
            return [objects]
    area = lambda part: (max(o[2] + o[4] for o in part) - min(o[2] for o in part)) * (max(o[3] + o[5] for o in part) - min(o[3] for o in part))
    for low, size in ((2, 4), (3, 5)):
        total = max(o[low] + o[size] for o in objects) - min(o[low] for o in objects)
        reach = None
        for a, b in sorted((max(0.0, o[low]), min(total, o[low] + o[size])) for o in objects):
            if reach is not None and a - reach > gap:
                cut = (reach + a) / 2
                one, two = [o for o in objects if o[low] + o[size] <= cut], [o for o in objects if o[low] >= cut]
                if one and two and area(one) >= least and area(two) >= least:
                    return split(one, gap, least) + split(two, gap, least)
            reach = max(reach or 0.0, b)
    return [objects]


def test_corridor_cuts_go_on_until_nothing_is_cut(spark):
    rng = np.random.default_rng(17)
    rows = []
    for number in range(40):
        n, spread = int(rng.integers(1, 20)), float(rng.choice([500, 1000, 3000]))
        for z in range(n):
            kind = "connector" if number % 9 == 0 and z == 3 else "shape"
            rows.append((1, number // 2, number % 2, z, kind, *(float(v) for v in (rng.random(2) * spread).round(1)), *(float(v) for v in (rng.random(2) * 120).round(1))))
    # a grid, and a cluster of nothing but one place
    rows += [(2, 1, 0, 4 * i + j, "shape", 200.0 * i, 200.0 * j, 50.0, 50.0) for i in range(4) for j in range(4)] + [(2, 2, 0, z, "shape", 5.0, 5.0, 0.0, 0.0) for z in range(3)]
    table = spark.createDataFrame(rows, "deck_id bigint, page bigint, cluster bigint, z_index bigint, kind string, x double, y double, w double, h double").repartition(3)
    for least in (20_000.0,):
        got = {}
        for r in rg.corridor_cuts(table, 40, least).collect():
            got.setdefault((r.deck_id, r.page, r.cluster), {}).setdefault(r.piece, set()).add(r.z_index)
        want = {}
        for key in {r[:3] for r in rows}:
            want[key] = [{o[0] for o in part} for part in split([r[3:] for r in rows if r[:3] == key], 40, least)]
        assert {k: [own[p] for p in sorted(own)] for k, own in got.items()} == want
    assert max(len(v) for v in want.values()) > 1


def test_regions_stop_at_walls(spark):
    wall = "a text of more than ten"
    rows = [(1, 1, 0, "shape", 0.0, 0.0, 10.0, 10.0, ""), (1, 1, 1, "shape", 20.0, 0.0, 10.0, 10.0, wall), (1, 1, 2, "shape", 60.0, 0.0, 10.0, 10.0, ""), (1, 1, 3, "shape", 90.0, 0.0, 10.0, 10.0, "ten chars!"), (1, 2, 0, "shape", 0.0, 0.0, 1.0, 1.0, wall)]
    got = sorted(map(tuple, rg.regions(spark.createDataFrame(rows, OBJECTS)).collect()))
    assert got == [(1, 1, 0, 1), (1, 1, 2, 2), (1, 1, 3, 2)]


def greedy(sizes, chars, pages):
    found, batch, total, count = [], 0, 0, 0
    for s in sizes:
        if count and (total + s > chars or count >= pages):
            batch, total, count = batch + 1, 0, 0
        total, count = total + s, count + 1
        found.append(batch)
    return found


@pytest.mark.parametrize("stretch", [4096, 20, 64, 7])
def test_batches_of_long_decks(spark, monkeypatch, stretch):
    monkeypatch.setattr(bt, "STRETCH", stretch)
    rng = np.random.default_rng(stretch)
    rows = []
    for deck, n in (("one", 3000), ("two", 41), ("three", 1), (None, 70)):
        sizes = rng.choice([0, 10, 900, 5000, 47_999, 48_000, 60_000], n, p=[0.1, 0.3, 0.3, 0.2, 0.04, 0.03, 0.03])
        rows += [(deck, i * 3 - 50, None if s == 0 else int(s)) for i, s in enumerate(sizes)]
    table = spark.createDataFrame(rows, "deck string, page_key bigint, size bigint").repartition(5)
    got = sorted((str(r.deck), r.page_key, r["size"], r.batch) for r in bt.batches(table).collect())
    want = []
    for deck in {r[0] for r in rows}:
        own = sorted((k, s or 0) for d, k, s in rows if d == deck)
        want += [(str(deck), k, s, b) for (k, s), b in zip(own, greedy([s for _, s in own], 48_000, 20))]
    assert got == sorted(want)
    found = bt.stretches(bt.positions(table), 48_000, 20)
    assert found.where("deck = 'one'").count() == -(-3000 // max(20, stretch))
    assert bt.batches(table.where("page_key < -100")).collect() == []
