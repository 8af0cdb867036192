"""A Merkle manifest of a table: a tree per language, a tree over their roots, and a proof for every row.

Leaves are ranked within their language in two levels (ranges, then places within a range).  The trees
are built ten levels an aggregate: a block of up to 1,024 neighbours is one row, its levels are arrays
made by SQL functions, and the blocks' tops are the leaves of the next pass.  From the top pass down every
block learns what lies above it.  What was built is stored as node rows, one per node and linked to its
parent, by block of leaves; a block's rows hold its whole way to the root, so no node is a hot key.  A recursive query
climbs from every leaf along the parent links, appends the siblings and folds the (tampered) hash; a round of
it climbs several links, as every round's rows stay until the query ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, materialize, stored

#: Levels that one aggregate builds; a block has up to 2 ** LEVELS leaves.
LEVELS = 10
WIDE = 1 << LEVELS
#: Numbers of a block's nodes from here on are those above the block.
ABOVE = (LEVELS + 1) * WIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WAY = "array<struct<l: string, r: string>>"


def leaf_hash(values: Sequence[Column]) -> Column:
    """sha256 in hex of the values in a row: `-` for null, else the count of UTF-8 bytes, a colon and the value."""
    as_text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in as_text)), 256)


def ranked(rows: DataFrame, tree: str, order: list[str], pos: str = "pos", n: str = "n") -> DataFrame:
    """rows with their place (from 0) among those of their tree by `order`, nulls first, and the tree's number of rows.

    Rows are ranged by (tree, order), ranked within their range, and moved on by what earlier ranges hold
    of their tree; equal rows may be parted, so no range is hot.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [tree, *order, "_tie"]
    rows = materialize(rows.repartitionByRange(parts, *(F.asc_nulls_first(c) for c in keys)).withColumn("_part", F.spark_partition_id()))
    held = materialize(rows.groupBy("_part", tree).agg(F.count("*").alias("_held")))
    by = Window.partitionBy("_part").orderBy(*(F.asc_nulls_first(c) for c in keys))
    within = Window.partitionBy("_part").orderBy(F.asc_nulls_first(tree)).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum("_held").over(earlier), F.lit(0)) - F.coalesce(F.sum("_held").over(within), F.lit(0))
    at = held.select(F.col("_part").alias("_p"), F.col(tree).alias("_t"), moved.alias("_by"), F.sum("_held").over(Window.partitionBy(tree)).alias(n))
    place = rows.withColumn("_at", F.row_number().over(by).cast("long") - 1)
    return place.join(at, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_t"))).withColumn(pos, F.col("_at") + F.col("_by")).drop("_p", "_t", "_at", "_by", "_part", "_tie")


def _parents(level: Column) -> Column:
    """The level above: the hash of every two neighbours, or of the one that is left."""
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(level) - 1, 1)), lambda i: F.sha2(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))), 256))


def _levels(blocks: DataFrame) -> DataFrame:
    """Blocks (l0, height) with their levels l1..l10 as arrays, empty above the height, and their top."""
    for k in range(1, LEVELS + 1):
        blocks = blocks.withColumn(f"l{k}", F.when(F.col("height") >= k, _parents(F.col(f"l{k - 1}"))).otherwise(F.array().cast("array<string>")))
    return blocks.withColumn("top", F.get(F.get(F.array(*(f"l{k}" for k in range(LEVELS + 1))), F.col("height")), F.lit(0)))


def _sides(k: int, i: Column) -> Column:
    """The siblings of the i-th node of level k: the left one, or the right one, or none."""
    row = F.col(f"l{k}")
    return F.struct(F.when(i % 2 == 1, F.get(row, i - 1)).alias("l"), F.when(i % 2 == 0, F.get(row, i + 1)).alias("r"))


def build(leaves: DataFrame) -> list[DataFrame]:
    """The passes of the trees over leaves (tree, n, pos, digest, and what else they carry), blocks of 1,024 a row.

    A pass has (tree, block, depth, height, l0..l10, top), the first also `items`, the leaves in order;
    depth is the tree's.  A tree's root is the top of the block of the pass that reaches its depth.
    """
    depth = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("int")
    rows = leaves.withColumn("depth", depth)
    item = F.struct("pos", *(c for c in leaves.columns if c not in ("tree", "n", "pos")))
    passes: list[DataFrame] = []
    while True:
        done = LEVELS * len(passes)
        block = F.shiftright("pos", LEVELS).alias("block")
        own = rows.groupBy("tree", "depth", block).agg(F.array_sort(F.collect_list(item)).alias("items"))
        own = own.withColumn("l0", F.transform("items", lambda x: x["digest"])).withColumn("height", F.least(F.lit(LEVELS), F.col("depth") - done).cast("int"))
        passes.append(materialize(_levels(own if not passes else own.drop("items"))))
        rows = passes[-1].where(F.col("depth") > done + LEVELS).select("tree", "depth", F.col("block").alias("pos"), F.col("top").alias("digest"))
        item = F.struct("pos", "digest")
        if rows.isEmpty():
            return passes


def roots(passes: list[DataFrame]) -> DataFrame:
    """(tree, root) of the trees."""
    out = None
    for p, own in enumerate(passes):
        rows = own.where((F.col("depth") <= LEVELS * (p + 1)) & ((F.col("depth") > LEVELS * p) | F.lit(p == 0))).select("tree", F.col("top").alias("root"))
        out = rows if out is None else out.unionByName(rows)
    return out


def above(passes: list[DataFrame], start: DataFrame) -> DataFrame:
    """The blocks of the first pass with `way`, the siblings on the way from their top to the end of the way of their tree in start (tree, way)."""
    for p in range(len(passes) - 1, -1, -1):
        own, last = passes[p], F.col("depth") <= LEVELS * (p + 1)
        tops = own.where(last).select("tree", "block").join(start.select(F.col("tree").alias("_t"), "way"), F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
        ways = tops if p == len(passes) - 1 else tops.unionByName(below)
        ways = ways.select(F.col("tree").alias("_t"), F.col("block").alias("_b"), "way")
        met = own.join(ways, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b"))).drop("_t", "_b")
        if not p:
            return met
        i = F.col("i")
        within = F.filter(F.array(*(F.when(F.col("height") > k, _sides(k, F.shiftright(i, k))) for k in range(LEVELS))), lambda x: x.isNotNull())
        below = met.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("l0") - 1))).select("tree", (F.col("block") * WIDE + i).alias("block"), F.concat(within, "way").alias("way"))


def node_rows(blocks: DataFrame) -> DataFrame:
    """(block, node, parent, l, r): the built nodes below the root, numbered within their block of leaves; the root is no node and its children's parent is null."""
    out = F.when(F.size("way") > 0, ABOVE)
    each = lambda k: F.transform(F.sequence(F.lit(0), F.size(f"l{k}") - 1), lambda i: F.struct((i + k * WIDE).alias("node"), F.when(F.col("height") > k + 1, F.shiftright(i, 1) + (k + 1) * WIDE).otherwise(out).alias("parent"), _sides(k, i).alias("s")))
    none = "array<struct<node: int, parent: int, s: struct<l: string, r: string>>>"
    inner = [F.when(F.col("height") > k, each(k)).otherwise(F.array().cast(none)) for k in range(LEVELS)]
    outer = F.transform("way", lambda s, i: F.struct((i + ABOVE).alias("node"), F.when(i + 1 < F.size("way"), i + ABOVE + 1).alias("parent"), s.alias("s")))
    rows = [blocks.select("block", F.explode(a).alias("x")) for a in (F.concat(*inner), outer)]
    return rows[0].unionAll(rows[1]).select("block", "x.node", "x.parent", F.col("x.s.l").alias("l"), F.col("x.s.r").alias("r"))


def climb(spark: SparkSession, leaves: str, nodes: str, links: int = 8) -> DataFrame:
    """(block, i, hash, proof) of leaves (block, i, node, hash) at the end of their way; proof: the siblings' bytes in order.

    leaves, nodes: paths of tables.  The recursive query runs in a session of its own, whose settings lift
    the limits of recursion and let joins by (block, node) keep rows where their block is.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    own.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.read.parquet(leaves).createOrReplaceTempView("leaves")
    own.read.parquet(nodes).createOrReplaceTempView("nodes")
    step = "SELECT /*+ REPARTITION(block) */ block, i, node, hash, proof FROM climb WHERE node IS NOT NULL"
    for _ in range(links):
        step = f"""SELECT c.block, c.i, n.parent AS node,
 CASE WHEN n.node IS NULL THEN c.hash ELSE sha2(concat(coalesce(n.l, ''), c.hash, coalesce(n.r, '')), 256) END AS hash,
 concat(c.proof, coalesce(unhex(n.l), X''), coalesce(unhex(n.r), X'')) AS proof
FROM ({step}) c LEFT JOIN nodes n ON c.block = n.block AND c.node = n.node"""
    return own.sql(f"""WITH RECURSIVE climb AS (
SELECT block, i, node, hash, X'' AS proof FROM leaves
UNION ALL {step})
SELECT block, i, hash, proof FROM climb WHERE node IS NULL""")


def manifest(docs: DataFrame, tamper_every: int = 7, links: int = 8) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of documents.

    A row's leaf hashes doc_id, source, lang, n_chars and text.  The leaves of a lang, a null one too, ascend by doc_id (null
    first; rows that share one by their leaf); pairs, at the end of an odd level the one left, are hashed until one is left, the
    subroot; subroots by lang, null first, likewise give the root.  The proof is the siblings from the leaf
    up.  folded_root is what they give from a tampered leaf, of rows whose id's crc32 `tamper_every` divides (a null id counts
    as the empty text): n_chars one more; a null n_chars can't be tampered with and stays.  Repeated rows are
    leaves of their own, with equal leaf and possibly different proofs; texts of any length, empty or null, are
    hashed whole; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    whole = [F.col(c) for c in FIELDS]
    touched = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.when((crc_mod("doc_id", tamper_every) == 0) & F.col("n_chars").isNotNull(), leaf_hash(touched))
    rows = materialize(docs.select(F.col("lang").alias("tree"), "doc_id", leaf_hash(whole).alias("digest"), tampered.alias("tampered")))
    passes = build(ranked(rows, "tree", ["doc_id", "digest"]))
    subroots = materialize(roots(passes).select(F.lit(0).alias("all"), F.col("tree").alias("lang"), F.col("root").alias("digest")))
    tops = build(ranked(subroots, "all", ["lang"]).withColumnRenamed("all", "tree"))
    top = above(tops, spark.createDataFrame([(0, [])], f"tree int, way {WAY}"))
    i = F.col("i")
    within = F.filter(F.array(*(F.when(F.col("height") > k, _sides(k, F.shiftright(i, k))) for k in range(LEVELS))), lambda x: x.isNotNull())
    ends = top.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("l0") - 1))).select(F.get("items", i)["lang"].alias("tree"), F.get("items", i)["digest"].alias("subroot"), F.concat(within, "way").alias("way"))
    root = roots(tops).select("root")
    ends = materialize(ends.join(root))  # one row
    blocks = materialize(above(passes, ends.select("tree", "way")).withColumn("block", F.monotonically_increasing_id()).drop("top"))
    nodes = stored(node_rows(blocks))
    each = blocks.select("tree", "block", "height", F.size("way").alias("ways"), F.posexplode("items").alias("i", "x")).select("tree", "block", "i", F.when(F.col("height") > 0, F.col("i")).when(F.col("ways") > 0, ABOVE).alias("node"), "x.doc_id", F.col("x.digest").alias("leaf"), F.coalesce("x.tampered", "x.digest").alias("hash"))
    leaves = stored(each)
    up = spark.read.schema("block long, i int, hash string, proof binary").parquet(stored(climb(spark, leaves, nodes, links)))
    told = spark.read.schema(each.schema).parquet(leaves).drop("hash", "node").join(up, ["block", "i"])
    told = told.join(ends.select(F.col("tree").alias("_t"), "subroot", "root"), F.col("tree").eqNullSafe(F.col("_t")))
    return told.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"), F.col("hash").alias("folded_root"), (F.col("hash") == F.col("root")).alias("verified"))
