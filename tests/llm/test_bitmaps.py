"""Rows told by bitmaps before a join."""

from lodestone.llm import dart_minhash


def test_bitmaps_keep_all_that_is_wanted(spark):
    rows = spark.range(-5000, 5000).withColumnRenamed("id", "doc")
    wanted = rows.where("doc % 10 = 0")
    kept = {r.doc for r in dart_minhash._perhaps(rows, wanted).collect()}
    assert kept >= set(range(-5000, 5000, 10)) and len(kept) < 1100
    assert dart_minhash._perhaps(rows, wanted, slots=8).count() == 10_000 and dart_minhash._perhaps(rows, wanted.limit(0)).count() == 0


def test_bitmaps_come_before_the_shuffle_of_the_rows(spark):
    rows = spark.range(-5000, 5000).selectExpr("id AS doc", "cast(id AS string) AS text")
    wanted = rows.where("doc % 10 = 0").select("doc")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more ids than are sent to every task
    try:
        met = dart_minhash._met(rows, wanted.union(wanted))
        plan = met._jdf.queryExecution().sparkPlan().toString()
        assert sorted(r.doc for r in met.collect()) == list(range(-5000, 5000, 10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # a plan names what runs last first
    assert 0 <= plan.find("SortMergeJoin") < plan.find("BroadcastHashJoin")
