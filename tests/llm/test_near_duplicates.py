import random
import re

import numpy as np

from lodestone.llm import dart_minhash as D
from lodestone.llm.common import components


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0, 5, 60), rng.uniform(0, 5, 60)
    sig = D.darts(np.r_[h, h], np.repeat([0, 1], 60), np.r_[a, b], 2, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (D.darts(h, np.zeros(60, int), np.ones(60), 2, 50)[1] == 0).all()


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, 12)):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.1]) else w for w in base]
            rows.append((n, " ".join(copy).title() if n % 3 else ", ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, ""), (n + 3, "###"), (n + 4, "###"), (n + 5, "two words"), (n + 6, "Two  words!"), (n + 7, "x " * 50_000)]
    df = spark.createDataFrame([*rows, rows[0], (None, "abc")], "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS n", "'k' AS key")
    got = {r.doc_id: r for r in D.near_duplicates(df, block=6).collect()}
    assert set(got) == {i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows if shingles(t)}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] + [(n + 3, n + 4)]
    want = closure(dict(rows), links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (want[i] == i) for i, r in got.items())


def test_empty(spark):
    assert D.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5), (1, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == closure({x for e in real for x in e}, real)
