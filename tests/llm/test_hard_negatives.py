"""Hard negatives against all pairs; the tree's bounds; odd rows, ties and copies; long vectors of whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hard_negatives
from riskloom.llm.hard_negatives import Block, Search

SCHEMA = "vec_id long, embedding array<float>, label int, x string, row long"


def plain(rows, anchor, positives=5, negatives=10):
    """rows: (id, vector, label); all pairs in a loop."""
    good = [(k, i, [math.floor(256 * c) for c in v], y) for k, (i, v, y) in enumerate(rows) if y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, _, v, _ in good]
    d = max(lengths, key=lambda n: (lengths.count(n), n), default=0)
    good = [r for r in good if len(r[2]) == d]
    found = []
    for k, i, v, y in good:
        if i is None or not anchor(i):
            continue
        scored = sorted(((-sum(map(int.__mul__, v, w)), j is None, j or 0, j, z) for m, j, w, z in good if m != k), key=lambda r: r[:3])
        for p in [r for r in scored if r[4] == y][:positives]:
            inside = [r for r in scored if r[4] != y and 30 * -p[0] <= 100 * -r[0] <= 90 * -p[0]]
            found += [(i, p[3], n + 1, r[3], -p[0], -r[0]) for n, r in enumerate(inside[:negatives])]
    return sorted(found, key=repr)


def got(frame, **more):
    return sorted(map(tuple, hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, **more).collect()), key=repr)


def clustered(n, d, seed, labels=4):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, d))
    return [(k, [float(np.float32(c)) for c in centres[k % 6] * (1 + k % 3) + rnd.normal(size=d) * 0.05], int(rnd.integers(labels))) for k in range(n)]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], SCHEMA).repartition(3)


def test_all_pairs_with_odd_rows_copies_and_ties(spark):
    rows = clustered(400, 6, 1)
    rows += [(1000 + k, rows[3][1], 1) for k in range(150)]  # one vector of many rows
    rows += [(2000, None, 1), (2010, [0.5, None, 0.0, 0.0, 0.0, 0.0], 1), (2020, [float("nan")] * 6, 1), (2030, [float("inf")] * 6, 2), (2040, rows[0][1], None), (2050, [1.0], 1), (2060, [], 1), (None, rows[0][1], 1), (None, rows[1][1], 0), (10, rows[10][1], 3), (2070, [0.0] * 6, 1), (2080, [-c for c in rows[0][1]], 9)]
    rows += [(2090, [1e30, 0.0, 0.0, 0.0, 0.0, 0.0], 1)]  # too long
    want = plain([r for r in rows if r[0] != 2090], lambda i: i % 10 == 0)
    assert len(want) > 1000
    frame = frame_of(spark, rows)
    assert got(frame) == want
    assert got(frame, chunk=7, block=60, shards=(2, 3)) == want  # many chunks and blocks


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 1)], [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], [(0, None, None)]])
def test_tables_with_nothing_to_find(spark, rows):
    assert got(frame_of(spark, rows)) == []


def test_long_vectors_are_multiplied_exactly(spark):
    """Products beyond 2^53 are told apart by one unit."""
    big = float(1 << 19)
    rows = [(0, [big, big], 0), (1, [big, big], 0), *[(k, [big * 0.75, big * 0.75 + k / 256], 1) for k in range(2, 14)]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(frame) == plain(rows, lambda i: i % 10 == 0) != []


def test_the_tree_covers_its_rows_and_skips_nodes():
    rows = clustered(4000, 8, 2)
    x, labels, ids = np.array([[math.floor(256 * c) for c in v] for _, v, _ in rows]), np.array([y for *_, y in rows]), np.array([i for i, *_ in rows])
    block = Block(x, labels, ids, np.zeros(len(ids), bool), ids)
    leaves, open_ = [], list(block.roots)
    augmented = lambda c: np.append(c, math.sqrt(max(0, block.square - float(c @ c))))
    while open_:
        node = open_.pop()
        held, inside = [], [node]
        while inside:
            n = inside.pop()
            inside += n.children or []
            held += [] if n.rows is None else n.rows.tolist()
        apart = np.sqrt(((block.augmented[held] - augmented(node.centre)) ** 2).sum(1))
        assert apart.max() <= node.radius and (node.label is None or set(block.labels[held]) == {node.label})
        open_ += node.children or []
        leaves += [] if node.rows is None else [node.rows]
    assert sorted(np.concatenate(leaves)) == list(range(len(rows))) and len(leaves) > 20
    read = []

    class Counting(Search):
        def verify(self, block, node, active, scores):
            read.append(scores.size)
            super().verify(block, node, active, scores)

    search = Counting(x[:40], labels[:40], ids[:40], np.full((40, 1), -(1 << 62)), np.full((40, 1), 1 << 62), 5, True)
    search.add(block)
    assert sum(read) < 0.5 * 40 * len(rows) * 0.25  # a quarter has the label; half of those at most are read
    anchor, _, score, found, _ = search.best
    products = x[:40] @ block.x.T
    for a in range(40):
        own = sorted((-products[a, r], block.ids[r]) for r in range(len(rows)) if block.labels[r] == labels[a] and block.ids[r] != a)[:5]
        assert sorted(zip(-score[anchor == a], found[anchor == a], strict=True)) == own


def test_random_scores_and_windows():
    rnd = random.Random(4)
    for case in range(20):
        n, d = rnd.randint(1, 300), rnd.randint(1, 4)
        x = np.array([[rnd.randint(-9, 9) for _ in range(d)] for _ in range(n)])
        labels, ids = np.array([rnd.randrange(3) for _ in range(n)]), np.arange(n)
        low = np.array([[rnd.randint(-40, 40) for _ in range(3)] for _ in range(n)])
        search = Search(x, labels, ids, low, low + 25, 4, bool(case % 2))
        search.add(Block(x[: n // 2 + 1], labels[: n // 2 + 1], ids[: n // 2 + 1], np.zeros(n // 2 + 1, bool), ids[: n // 2 + 1]))
        if n // 2 + 1 < n:
            search.add(Block(x[n // 2 + 1 :], labels[n // 2 + 1 :], ids[n // 2 + 1 :], np.zeros(n - n // 2 - 1, bool), ids[n // 2 + 1 :]))
        want = set()
        for a in range(n):
            for w in range(3):
                hits = sorted((-int(x[a] @ x[r]), r) for r in range(n) if r != a and (labels[r] == labels[a]) == search.same and low[a, w] <= x[a] @ x[r] <= low[a, w] + 25)
                want |= {(a, w, -s, r) for s, r in hits[:4]}
        assert set(zip(*(c.tolist() for c in search.best[:4]), strict=True)) == want
