"""Toxicity is learned from every labelled text, whole, by averaging what tasks learn."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import toxicity_cnn


def test_toxicity_is_learned_from_any_place_of_a_long_text(spark):
    # what tells the labels lies between the windows that were read before
    calm = [f"calm{i % 50}" for i in range(9000)]
    text = lambda bad: " ".join(calm[:2000] + (["vile", "awful", "slur"] * 4 if bad else calm[:12]) + calm[2000:])
    both = [text(False), text(True)]
    assert len(both[1]) > 40_000
    ids = spark.range(200).withColumnRenamed("id", "doc_id").repartition(4)
    docs = ids.select("doc_id", F.when(F.col("doc_id") % 2 == 1, both[1]).otherwise(both[0]).alias("text"), F.lit("en").alias("lang"))
    labels = ids.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = toxicity_cnn.toxicity(docs, labels).where("held_out").collect()
    assert len(got) > 20 and all(r.predicted == r.doc_id % 2 for r in got)


def test_a_round_moves_by_the_average_of_its_tasks(spark):
    rows = spark.createDataFrame([("good day", 0), ("vile slur", 1)], "t string, y int").repartition(1)
    moved = []
    for some in (rows, rows.union(rows)):  # one task; two tasks with the same rows
        model = toxicity_cnn.TextCnn()
        toxicity_cnn._turn(some, model, model.state(), (1.0, 1.0), 1, 0)
        moved.append(model)
    assert not np.array_equal(moved[0].emb, toxicity_cnn.TextCnn().emb) and moved[0].base != 0
    for k in ("emb", "filters", "bias", "out", "base"):
        assert np.allclose(getattr(moved[0], k), getattr(moved[1], k), atol=1e-6)


def test_a_word_met_again_is_not_projected_again(monkeypatch):
    seen, plain = [], toxicity_cnn.hashed
    monkeypatch.setattr(toxicity_cnn, "hashed", lambda words: seen.extend(words) or plain(words))
    texts = [" ".join(f"w{i}" for i in range(lo, lo + 10_000)) for lo in range(0, 150_000, 10_000)] + [None, "", "w1 W1 w149999"]
    scorer = toxicity_cnn.Scorer(toxicity_cnn.TextCnn())
    first = np.concatenate([scorer([t])[0] for t in texts])
    again = np.concatenate([scorer([t])[0] for t in texts])
    assert np.array_equal(first, again) and len(seen) == len(set(seen)) == 150_000
    alone = toxicity_cnn.Scorer(toxicity_cnn.TextCnn(), limit=0)  # each text by itself
    assert np.allclose(first, np.concatenate([alone([t])[0] for t in texts]), atol=1e-5)
