"""Circles and nested categories against plain searches on small graphs, and on shapes that grow."""

import os
import random

import pytest

from lodestone.operators import graph, links


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    seen = {}
    for a in {x for e in edges for x in e}:
        stack, got = [a], set()
        while stack:
            for t in out.get(stack.pop(), ()):
                if t not in got:
                    got.add(t)
                    stack.append(t)
        seen[a] = got
    return seen


def components_by_search(edges):
    seen = reach(edges)
    return sorted((a, min(b for b in seen if b in seen[a] and a in seen[b])) for a in seen if a in seen[a])


def components(spark, edges):
    return sorted(tuple(r) for r in graph.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect())


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n, m = rng.choice([(12, 14), (40, 44), (60, 200), (30, 25)])
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    assert components(spark, edges) == components_by_search(edges)


def test_rings_chains_and_what_hangs_on_them(spark):
    ring = [(i, (i + 1) % 300) for i in range(300)]
    chain = [(i, i + 1) for i in range(300, 700)]
    handles = [(5, 1000), (1000, 1001), (1001, 9), (1001, 300), (700, 2000), (2000, 2001), (2001, 2000), (3000, 3000), (None, 1), (1, None), (2000, 2001)]
    # 5 -> 1000 -> 1001 -> 9 leads back over the ring, so both are on it
    want = sorted([(i, 0) for i in [*range(300), 1000, 1001]] + [(2000, 2000), (2001, 2000), (3000, 3000)])
    assert components(spark, ring + chain + handles) == want
    assert components(spark, chain) == [] and components(spark, []) == []


def test_a_component_of_many_nodes(spark):
    """20,000 nodes here; 100,000 by LODESTONE_TEST_NODES."""
    n = int(os.environ.get("LODESTONE_TEST_NODES", "20000"))
    edges = spark.range(n).selectExpr(f"explode(array(struct(id AS src, (id * 7919 + 13) % {n} AS dst), struct(id AS src, abs(xxhash64(id)) % {n} AS dst))) AS e").select("e.src", "e.dst")
    edges = edges.union(spark.range(n, n + 500).selectExpr("id AS src", "id + 1 AS dst"))
    got = graph.strong_components(edges)
    sizes = {r.component: r["count"] for r in got.groupBy("component").count().collect()}
    assert max(sizes.values()) > 0.8 * n and got.where(f"node >= {n}").isEmpty()
    assert got.count() == got.select("node").distinct().count()


def answer(claims, sets, cat, code, stack=()):
    """The rule in plain recursion: (category, role, target, accepted) claims, sets of codes by name."""
    if cat in stack:
        return None
    own = [c for c in claims if c[0] == cat]
    if not any(c[1] == "include" for c in own):
        return None

    def holds(target):
        return code in sets[target] if target in sets else answer(claims, sets, target, code, (*stack, cat))

    told = [(role, holds(target) if accepted else None) for _, role, target, accepted in own]
    if ("exclude", True) in told:
        return False
    return None if any(v is None for _, v in told) else ("include", True) in told


def ask(spark, claims, sets, codes):
    named = {None: "unknown", True: "true", False: "false"}
    cats = sorted({c[0] for c in claims} | {"nobody"})
    code = lambda c: (f"A{c:02d}", "A", c, None)
    ranges = [(name, "A", c, "A", c, None) for name, held in sets.items() for c in held] or [("none", "B", 0, "B", 0, None)]
    got = links.membership(
        spark.createDataFrame([code(c) for c in codes], "code string, letter string, major int, minor string"),
        spark.createDataFrame([(c,) for c in cats], "category string"),
        spark.createDataFrame(claims, "category string, role string, target string, accepted boolean"),
        spark.createDataFrame(ranges, "target string, lo_letter string, lo_major int, hi_letter string, hi_major int, minor string"),
    )
    want = {(f"A{c:02d}", cat): named[answer(claims, sets, cat, c)] for c in codes for cat in cats}
    rows = got.collect()
    assert len(rows) == len(want)
    assert {(r.code, r.category): r.answer for r in rows} == want


@pytest.mark.parametrize("seed", range(3))
def test_membership_of_random_categories(spark, seed):
    rng = random.Random(seed)
    sets = {f"set{i}": set(rng.sample(range(12), 4)) for i in range(5)}
    cats = [f"cat{i}" for i in range(7)]
    claims = [(rng.choice(cats), rng.choice(["include", "include", "exclude"]), rng.choice([*sets, *cats, "nothing"]), rng.random() < 0.85) for _ in range(20)]
    ask(spark, claims, sets, range(12))


def test_circles_are_answered_by_where_they_are_asked_from(spark):
    claims = [("a", "include", "b", True), ("b", "include", "a", True), ("b", "exclude", "s", True), ("c", "include", "a", True), ("d", "include", "d", True), ("d", "exclude", "t", True), ("e", "include", "s", True), ("e", "exclude", "d", True)]
    ask(spark, claims, {"s": {1, 2}, "t": {3}}, range(5))


def test_a_ladder_of_thirty_rungs(spark):
    """Two to the thirtieth paths, sixty categories."""
    claims = [(f"{side}{i:02d}", "include", f"{to}{i + 1:02d}", True) for i in range(29) for side in "ab" for to in "ab"]
    claims += [("a29", "include", "s", True), ("b29", "include", "s", True), ("b29", "exclude", "t", True)]
    ranges = [("s", "A", 1, "A", 3, None), ("t", "A", 3, "A", 3, None)]
    base, some = links.answers(
        spark.createDataFrame([(f"A{c:02d}", "A", c, None) for c in range(6)], "code string, letter string, major int, minor string"),
        spark.createDataFrame([("a00",)], "category string"),
        spark.createDataFrame(claims, "category string, role string, target string, accepted boolean"),
        spark.createDataFrame(ranges, "target string, lo_letter string, lo_major int, hi_letter string, hi_major int, minor string"),
    )
    assert [tuple(r) for r in base.collect()] == [("a00", "false")]
    assert sorted(tuple(r) for r in some.collect()) == [("a00", f"A{c:02d}", "true") for c in (1, 2, 3)]
