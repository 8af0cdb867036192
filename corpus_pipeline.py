"""From raw documents to packed sequences: toxicity, language, near-duplicates, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import binary_packing, dart_minhash, piece_langid, source_mix, toxicity_cnn
from lodestone.llm.common import crc_mod, fresh, materialize, table

#: A text whose likeliest language is less probable than this is rejected.
LEAST_LANG_SCORE = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Null texts and texts without a word hold nothing toxic and stay; long texts are scored whole; equal rows share
    their fate; without labels of both kinds, or on an empty table, nothing goes.  Columns of any name
    pass through.
    """
    (score,) = fresh(docs, "score")
    model = toxicity_cnn.train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn(score, toxicity_cnn.score(F.col("text"), model)).where((F.col(score) < 0.5) | ~F.coalesce("text", F.lit("")).rlike(r"(?U)\w")).drop(score)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of no clear language go; a missing lang is filled with the one found.

    So null and empty texts go; equal rows share their fate; without a labelled text nothing can be
    told and all go.  Columns of any name pass through; an empty table stays empty.
    """
    (p,) = fresh(docs, "p")
    model = piece_langid.train(docs.where(crc_mod("doc_id", 3) != 1))
    judged = docs.withColumn(p, piece_langid.predict(F.col("text"), model))
    kept = judged.where((F.col(p)["lang_pred"] != "und") & (F.col(p)["score"] >= LEAST_LANG_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", F.col(p)["lang_pred"])).drop(p)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, the one with the smallest id.

    Rows that share an id, or have none, are documents of their own if their texts differ; of rows that
    share id and text the least by all columns stays.  Null and blank texts are compared with nothing.
    Columns of any name pass through; an empty table stays empty.
    """
    node, digest, first, many = fresh(docs, "node", "digest", "first", "many")
    own = F.coalesce(F.xxhash64("text"), F.lit(0))
    rows = docs.withColumn(digest, own)
    shared = rows.groupBy("doc_id").agg(F.min(digest).alias(first), F.count("*").alias(many)).where((F.col(many) > 1) & F.col("doc_id").isNotNull()).drop(many).withColumnRenamed("doc_id", node)
    rows = rows.join(shared, F.col("doc_id") == F.col(node), "left")
    # a number of its own, above any id in use, for a text that another row's id stands for already
    apart = F.xxhash64("doc_id", digest).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)
    keep_id = F.col("doc_id").isNotNull() & (F.col(first).isNull() | (F.col(first) == F.col(digest)))
    rows = materialize(rows.withColumn(node, F.when(keep_id, F.col("doc_id").cast("long")).otherwise(apart)).drop(first, digest))
    gone = dart_minhash.near_duplicates(rows.select(node, "text"), doc_id=node).where("NOT kept").select(F.col("doc_id").alias(many))
    kept = rows.join(gone, F.col(node) == F.col(many), "left_anti")
    again = materialize(rows.groupBy(node).count().where("count > 1").select(F.col(node).alias(many)))
    # only rows whose id and text repeat are ordered
    alone = kept.join(again, F.col(node) == F.col(many), "left_anti")
    rank = F.row_number().over(Window.partitionBy(node).orderBy(*docs.columns))
    one = kept.join(again, F.col(node) == F.col(many), "left_semi").withColumn(first, rank).where(F.col(first) == 1)
    return alone.select(*docs.columns).unionByName(one.select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the schedule takes: a document once for each round it is in, cut where a source's share ends within it.

    Null texts and texts without words are never taken; a null source is a source; equal rows are mixed
    one by one; long texts are cut by words.  Columns of any name pass through, n_chars counts the text
    anew; an empty table stays empty.
    """
    row, size, n = fresh(docs, "row", "size", "n")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = source_mix.mix(rows, doc_id=row, shuffle_by=docs.columns).select(F.col("doc_id").alias(row), F.col("size").alias(size), F.explode(F.array("first", "second")).alias(n)).where(F.col(n) > 0)
    both = rows.join(taken, row)
    # the first n words: as many characters as the first n words and the white space between them have
    found = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col(n) < F.col(size), F.array_join(F.slice(found, F.lit(1), F.col(n).cast("int")), "")).otherwise(F.col("text"))
    both = both.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return both.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix, packed: null and empty texts as the end id alone, equal rows one by one, long texts in several pieces.

    Returns the columns of the packing whatever those of docs; an empty table gives no rows.
    """
    return binary_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("packing", packing)]

#: Trained models decide what stays, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
