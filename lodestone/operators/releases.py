"""Releases frozen as hash trees: as many levels as the members need, and verification that goes down only where hashes differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import Growing, Scratch

#: Between the parts of a hashed line, and between lines.
PART, LINE = "\u001f", "\u001e"
RULES = "rule_files"


def _depth(n: Column, leaf: int) -> Column:
    """The least d for which n members are at most leaf * 16 ** d."""
    steps = [d for d in range(15) if leaf * 16**d < 2**62]
    out = F.lit(len(steps))
    for d in reversed(steps):
        out = F.when(n <= leaf * 16**d, d).otherwise(out)
    return out


def tree(members: DataFrame, leaf: int = 1000, depths: DataFrame | None = None) -> DataFrame:
    """(release, tree, prefix, depth, n, hash): the nodes of each release's trees, over members (release, section, id, digest).

    A release has one tree for its rule files (section rule_files, id the path) and one for all else.  Members lie in the leaf that the
    first hex digits of the hash of their section and id name, about `leaf` of them in each; a node's hash is that of its up to 16
    children, the root's prefix is empty.  Rows that repeat are one member.  depths (release, tree, depth) keeps those of a
    frozen tree.  Nulls are told from empty texts.
    """
    scratch = Scratch(members.sparkSession)
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    kind = F.when(F.col("section") == RULES, RULES).otherwise("members")
    lines = members.select("release", kind.alias("tree"), F.sha2(F.concat_ws(PART, text("section"), text("id")), 256).alias("key"), F.concat_ws(PART, text("section"), text("id"), text("digest")).alias("line")).distinct()
    lines = scratch.keep(lines)
    if depths is None:
        depths = lines.groupBy("release", "tree").agg(_depth(F.count("*"), leaf).alias("depth"))
    depths = scratch.keep(depths.select(F.col("release").alias("_r"), F.col("tree").alias("_t"), "depth"))
    nodes = Growing(scratch, f"release {members.schema['release'].dataType.simpleString()}, tree string, prefix string, depth int, n long, hash string")
    at = lines.join(depths, F.col("release").eqNullSafe(F.col("_r")) & (F.col("tree") == F.col("_t"))).drop("_r", "_t")
    joined = lambda rows, own: F.sha2(F.array_join(F.transform(F.array_sort(rows), own), LINE), 256)
    nodes.add(at.groupBy("release", "tree", F.expr("substring(key, 1, depth)").alias("prefix"), "depth").agg(F.count("*").alias("n"), joined(F.collect_list(F.struct("key", "line")), lambda x: x["line"]).alias("hash")))
    most = depths.agg(F.max("depth")).first()[0] or 0
    for size in range(most, 0, -1):
        own = nodes.rows().where(F.length("prefix") == size)
        up = own.groupBy("release", "tree", F.substring("prefix", 1, size - 1).alias("prefix"), "depth")
        nodes.add(up.agg(F.sum("n").alias("n"), joined(F.collect_list(F.struct("prefix", "hash")), lambda x: F.concat(x["prefix"], F.lit(PART), x["hash"])).alias("hash")))
    scratch.drop(lines, depths)
    return nodes.rows()


def frozen(nodes: DataFrame) -> DataFrame:
    """(release, members, rule_files, members_sha256, rules_sha256, content_sha256) of trees; a release without rule files has a hash of none."""
    roots = nodes.where("prefix = ''")
    pick = lambda tree, c: F.max(F.when(F.col("tree") == tree, F.col(c)))
    none = F.sha2(F.lit(""), 256)
    out = roots.groupBy("release").agg(F.coalesce(pick("members", "n"), F.lit(0)).alias("members"), F.coalesce(pick(RULES, "n"), F.lit(0)).alias("rule_files"), F.coalesce(pick("members", "hash"), none).alias("members_sha256"), F.coalesce(pick(RULES, "hash"), none).alias("rules_sha256"))
    return out.withColumn("content_sha256", F.sha2(F.concat("members_sha256", F.lit(LINE), "rules_sha256"), 256))


def differing(before: DataFrame, now: DataFrame) -> DataFrame:
    """(release, tree, prefix) of the leaves that differ between two sets of trees of equal depths, found from the roots down: a level is compared only below nodes that differ."""
    side = lambda nodes, h: nodes.select(F.col("release").alias("_r"), "tree", "prefix", "depth", F.col("hash").alias(h))
    both = side(before, "_a").join(side(now, "_b"), ["tree", "prefix", "depth", "_r"], "full_outer")
    scratch = Scratch(before.sparkSession)
    both = scratch.keep(both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(F.col("_r").alias("release"), "tree", "prefix", "depth"))
    out, open_ = both.where("prefix = '' AND depth = 0"), both.where("prefix = '' AND depth > 0")
    size = 0
    while not open_.isEmpty():
        size += 1
        up = open_.select(F.col("release").alias("_r"), F.col("tree").alias("_t"), F.col("prefix").alias("_p"))
        here = both.where(F.length("prefix") == size).join(up, F.col("release").eqNullSafe(F.col("_r")) & (F.col("tree") == F.col("_t")) & (F.substring("prefix", 1, size - 1) == F.col("_p"))).drop("_r", "_t", "_p")
        out, open_ = out.unionByName(here.where(F.col("depth") == size)), here.where(F.col("depth") > size)
    return out.select("release", "tree", "prefix")


def integrity(nodes: DataFrame, listed: DataFrame, stored: DataFrame) -> DataFrame:
    """(code, subject, message, release), K15: what a frozen release's members have become.

    nodes: its frozen trees; listed (release, section, id): its members and rule files; stored (section, id, digest): what is there
    now.  A listed member that isn't stored is missing_member; a release whose rule files differ is
    rule_hash_differs, else one whose content differs content_hash_differs.
    """
    have = stored.select(F.col("section").alias("_s"), F.col("id").alias("_i"), "digest", F.lit(True).alias("_here"))
    met = listed.select("release", "section", "id").distinct().join(have, (F.col("section") == F.col("_s")) & (F.col("id") == F.col("_i")), "left")
    missing = met.where(F.col("_here").isNull() & (F.col("section") != RULES)).select(F.lit("K15").alias("code"), F.col("id").cast("string").alias("subject"), F.lit("missing_member").alias("message"), "release")
    now = tree(met.where((F.col("section") == RULES) | F.col("_here")).select("release", "section", "id", "digest"), depths=nodes.where("prefix = ''").select("release", "tree", "depth"))
    a, b = frozen(nodes), frozen(now).select(F.col("release").alias("_r"), F.col("rules_sha256").alias("_rules"), F.col("content_sha256").alias("_content"))
    both = a.join(b, F.col("release").eqNullSafe(F.col("_r")), "left")
    empty = F.sha2(F.lit(""), 256)
    why = F.when(F.coalesce("_rules", empty) != F.col("rules_sha256"), "rule_hash_differs").when(~F.coalesce(F.col("_content") == F.col("content_sha256"), F.lit(False)), "content_hash_differs")
    return missing.unionByName(both.withColumn("message", why).where("message IS NOT NULL").select(F.lit("K15").alias("code"), F.col("release").cast("string").alias("subject"), "message", "release"))
