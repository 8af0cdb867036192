"""Components of few and short chains, where no other chain forces a further round."""

import random

from test_near_duplicates import closure

from lodestone.llm import dart_minhash
from lodestone.llm.common import components


def test_path_alone(spark):
    links = [(0, 4), (4, 2), (2, 3), (3, 1)]
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert sorted((r.node, r.component) for r in got) == [(i, 0) for i in range(5)]


def test_short_chains_in_random_order(spark):
    rng = random.Random(8)
    for _ in range(6):
        order = rng.sample(range(8), 8)
        links = list(zip(order[:-1], order[1:], strict=True))
        got = components(spark.createDataFrame(links, "u long, v long")).collect()
        assert sorted((r.node, r.component) for r in got) == sorted(closure(set(order), links).items())


def test_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(300)]
    chain = [0, 4, 2, 3, 1]  # the k-th of them starts 20 words later, so only neighbours are near copies
    rows = [(doc, " ".join(words[20 * k : 20 * k + 200])) for k, doc in enumerate(chain)]
    got = dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(i, 0, i == 0) for i in range(5)]
