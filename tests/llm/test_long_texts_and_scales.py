"""What a page's or text's length, a vector's scale or a repeated row must not change."""

import os

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import block_labeller, impact_search, itq_links, toxicity_cnn

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_a_long_comment_changes_no_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("HTML_", F.lit(1))
    long = pages.withColumn("html", F.concat("html", F.lit(f"<!--{'x' * 200_001}-->")))
    one, two = ({r.page_id: r.text for r in block_labeller.extract(p).collect()} for p in (pages, long))
    assert one == two and sum(map(len, one.values())) > 10_000


def test_training_takes_bounded_neighbours_of_any_page():
    page = "".join(f"<p class=c{i}>{'word ' * 30}{i}" for i in range(500))
    some = block_labeller.slice_of(page, 123_457, 4000)
    assert 0 < sum(len(t) + sum(map(len, p)) for t, p, _ in some) <= 4000
    at = [int(t.split()[-1]) for t, _, _ in some]
    assert at == [(at[0] + k) % 500 for k in range(len(at))] and at[0] == 123_457 % 500
    assert [b[0] for b in block_labeller.slice_of("<p>a<p>b", 7, 4000)] == ["a", "b"]
    cut = block_labeller.slice_of(f"<p>{'y' * 900}", 0, 4000)
    assert "".join(b[0] for b in cut) == "y" * 900 and max(len(b[0]) for b in cut) == 400


def test_deep_pages_are_read_in_linear_time():
    leaves = block_labeller.leaves("<div>x" * 30_000)
    model, features = block_labeller.Labeller(), block_labeller.Features()
    assert len(features.page(leaves, model.p["path"])) == 30_000
    assert len(block_labeller.leaves("<div>" * 20_000 + "</section>x" * 20_000)) == 20_000


def test_path_sums_equal_whole_paths():
    model, features = block_labeller.Labeller(), block_labeller.Features()
    html = "<body><div class='a b'><p>one <b>two</b><ul><li id=x>three<li>four</ul></div>five<div><span class=q><p>six</span></div>"
    page = block_labeller.blocks(html)
    plain = model.inputs([[features.block(b, i, len(page)) for i, b in enumerate(page)]])[0]
    shared = model.inputs([features.page(block_labeller.leaves(html), model.p["path"])])[0]
    assert len(page) == 5 and np.allclose(plain, shared, atol=1e-5)
    assert np.allclose(model.inputs([features.page(block_labeller.leaves("bare"), model.p["path"])])[0], model.inputs([[features.block(("bare", (), 0), 0, 1)]])[0])


def test_blanks_after_a_text_change_no_score(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    long = docs.withColumn("text", F.concat("text", F.lit(" " * 40_001)))
    one, two = ({r.doc_id: r.predicted for r in toxicity_cnn.toxicity(d, labels).collect()} for d in (docs, long))
    assert one == two and sum(one.values()) > 10


def test_long_texts_are_learned_from_in_windows(spark):
    words = lambda bad, i: " ".join(["plain common words of no harm", f"w{i % 7}"] * 30 + (["vile", "awful", "slur"] * 20 if bad else []) + ["more common words"] * 30)
    rows = [(i, words(i % 2, i), "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    model = toxicity_cnn.train(docs, labels, sample=200, longest=400)
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity_cnn.score(F.col("text"), model).alias("s")).collect()}
    assert model is not None and sum((s >= 0.5) == bool(i % 2) for i, s in got.items()) > 400


def test_links_do_not_depend_on_scale(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    near = base + 0.05 * rng.normal(size=base.shape)
    rows, scales = [], [1e-308, 1e-200, 1.0, 1e150, 1e200, 1e300]
    for i, s in enumerate(scales):
        rows += [(10 * i, (base[i] * s).tolist()), (10 * i + 1, (near[i] * s).tolist()), (10 * i + 2, (near[i] * scales[-1 - i]).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq_links.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[10 * i + k] == (2, 10 * i) for i in range(6) for k in range(3))
    tiny = [(i, [5e-324 * (i + 1), 0.0]) for i in range(3)]
    assert {r.n_links for r in itq_links.links(spark.createDataFrame(tiny, "vec_id long, embedding array<double>")).collect()} == {2}


def test_repeated_rows_are_candidates_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (50, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.25, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0])]
    got = impact_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    told = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (50, 100)}
    assert told[50] == [(1, 65536), (1, 65536), (2, 32768)]
    assert len(told[100]) == 3 and {s for _, s in told[100]} == {0}
