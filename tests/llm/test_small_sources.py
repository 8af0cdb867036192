"""Small sources beside a large one come near their targets."""

from pyspark.sql import functions as F

from lodestone.llm import source_mix


def test_small_sources_beside_a_large_one(spark):
    large = spark.range(52).select(F.col("id").alias("doc_id"), F.lit("z").alias("source"), F.repeat(F.lit("x "), 1_000_000).alias("text"))
    small = [(100 + 10 * i + j, f"s{i}", "y " * 30) for i in range(8) for j in range(i + 1)]
    docs = large.union(spark.createDataFrame(small, "doc_id long, source string, text string"))
    got = source_mix.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 9
    for r in got:
        assert 0.9 * r.target <= r.taken <= 1.1 * r.target, r
