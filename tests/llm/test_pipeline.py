"""The corpus pipeline's stages on small tables."""

import random
from collections import Counter

import corpus_pipeline
from lodestone.llm import source_mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=9, n=300):
    rng = random.Random(seed)
    made = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(rng.randint(0, 200))), "en", rng.choice(["a", "a", "a", "b", None]), 0) for i in range(n)]
    return [*made, made[3], made[3], (None, "no id here", None, "b", 0), (None, None, None, None, None)]


def test_mix_does_not_follow_the_partitions(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    one = corpus_pipeline.mix(spark, docs, "").collect()
    two = corpus_pipeline.mix(spark, docs.orderBy("text").repartition(7, "n_chars", "text"), "").collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))


def test_mix_writes_the_words_that_the_schedule_takes(spark):
    given = [r for r in rows() if r[0] is not None and r != rows()[3]]
    docs = spark.createDataFrame(given, DOCS)
    text = {r[0]: r[1] for r in given}
    want = Counter()
    for r in source_mix.mix(docs, shuffle_by=docs.columns).collect():
        for n in (r.first, r.second):
            if n:
                want[r.doc_id, " ".join(text[r.doc_id].split(" ")[:n])] += 1
    got = corpus_pipeline.mix(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(4)
    base = [" ".join(str(rng.randint(0, 10**6)) for _ in range(60)) for _ in range(20)]
    made = [(i, t, "en", "a", len(t)) for i, t in enumerate(base)]
    made += [(100 + i, t, "en", "b", len(t)) for i, t in enumerate(base[:5])] + [(None, base[0], "en", "a", 1)]
    made += [(200, " ".join([*base[7].split(" ")[:-1], "other"]), "en", "a", 1)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(made, DOCS), "").collect()
    assert sorted(r.doc_id for r in got) == list(range(20))


def test_near_duplicates_of_ids_that_repeat(spark):
    rng = random.Random(6)
    say = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(60))
    one, two, three = say(), say(), say()
    made = [(1, one, "en", "a", 1), (1, two, "en", "a", 1), (2, two, "en", "a", 1), (3, three, "en", "b", 1), (3, three, "en", "b", 1), (3, three, "en", "a", 1), (4, None, None, None, None), (4, None, None, None, None), (5, "", "en", "a", 0), (6, "", "en", "a", 0)]
    docs = spark.createDataFrame(made, DOCS).selectExpr("*", "1 AS node", "2 AS digest", "3 AS first", "4 AS many", "5 AS __gone")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    rows_ = got.collect()
    assert Counter(r.text for r in rows_) == Counter([one, two, three, None, "", ""])
    assert {r.doc_id for r in rows_ if r.text == two} <= {1, 2} and next(r.source for r in rows_ if r.text == three) == "a"


def test_stages_take_odd_rows_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    words = [["lovely", "day"], ["nasty", "slur"]]
    made = [(i, " ".join(words[i % 2] * 5) + f" the number {i}", "en" if i % 3 else "de", "a", 1) for i in range(40)]
    made += [(100, None, None, None, None), (101, "", "en", "b", 0), (102, "123 !?", "en", None, 6), (103, "the " * 30_000, "en", "b", 1), made[2], made[2]]
    docs = spark.createDataFrame(made, DOCS).selectExpr("*", "1 AS score", "2 AS p", "3 AS row", "4 AS size", "5 AS n", "'x' AS __row", "7 AS start", "8 AS sequence_id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == {r[0] for r in made}
            continue
        assert out.columns == docs.columns and all(r.score == 1 and r["__row"] == "x" for r in rows)
        ids = Counter(r.doc_id for r in rows)
        if name == "toxicity":
            assert ids[100] == ids[101] == 1 and ids[2] in (0, 3)
        if name == "language":
            assert not ids[100] and not ids[101] and not ids[102] and ids[103] == 1
        if name == "near_duplicates":
            assert ids[2] == 1 and ids[100] == ids[101] == 1
        if name == "mix":
            assert not ids[100] and not ids[101] and all(r.n_chars == len(r.text) for r in rows)


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
