"""Languages are learned from every labelled document."""

from pyspark.sql import functions as F

from lodestone.llm import piece_langid


def test_the_last_document_of_a_language_is_learned_from(spark):
    ids = [r.id for r in spark.range(1200).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, "aa" if k % 2 else "bb", "common words") for k, i in enumerate(ids[:-2])]  # by hash 599 of each come before
    docs = spark.createDataFrame([*rows, (ids[-2], "aa", "жжж " * 30), (ids[-1], "bb", "щщщ " * 30)], "doc_id long, lang string, text string")
    asked = spark.createDataFrame([(1, "жжж"), (2, "щщщ")], "doc_id long, text string")
    told = lambda model: [r.p["lang_pred"] for r in asked.orderBy("doc_id").select(piece_langid.predict(F.col("text"), model).alias("p")).collect()]
    assert told(piece_langid.train(docs)) == ["aa", "bb"]
    assert told(piece_langid.train(docs, sample=400)) != ["aa", "bb"]
