"""Reachability and strong components over edge tables, by rounds of joins over tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only on one machine that names none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one loop in the shared folder, to be dropped when no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark).rstrip('/')}/loop-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []  # a frame's id is its own only while it lives

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and read it back."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(read)] = path
        self.held.append(read)
        return read

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                _delete(self.spark, path)

    def drop_all(self, *but: DataFrame) -> None:
        self.drop(*(f for f in self.held if all(f is not b for b in but)))


class Growing:
    """A table that grows by parts: what is added is written once and never rewritten."""

    def __init__(self, scratch: Scratch, schema: str):
        self.spark, self.schema, self.path, self.parts = scratch.spark, schema, f"{scratch.base}/grown-{uuid.uuid4().hex}", 0

    def add(self, rows: DataFrame) -> DataFrame:
        """Append rows and give them back as stored."""
        path = f"{self.path}/part={self.parts}"
        self.parts += 1
        rows.write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/part={i}" for i in range(self.parts))) if self.parts else self.spark.createDataFrame([], self.schema)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def _proper(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): every node reached from a root over edges (src, dst), by its least depth; roots reach themselves at 0.

    Each round joins only the pairs that the round before found and appends what is new; it stops when nothing is,
    so cycles end.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(_proper(edges))
    if roots is None:
        roots = edges.select(F.col("src").alias("root")).union(edges.select(F.col("dst"))).distinct()
    kind = edges.schema["src"].dataType.simpleString()
    seen = Growing(scratch, f"root {roots.schema['root'].dataType.simpleString()}, node {kind}, depth int")
    new = seen.add(roots.select("root", F.col("root").cast(kind).alias("node"), F.lit(0).alias("depth")))
    while not new.isEmpty():
        step = new.join(edges, new["node"] == edges["src"]).select("root", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        new = seen.add(step.join(seen.rows().select("root", "node"), ["root", "node"], "left_anti"))
    scratch.drop(edges)
    return seen.rows()


def _ends(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n_out) and (node, n_in)."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out")), edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))


def _coin(node: Column, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn)).bitwiseAND(F.lit(1)) == 1


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on a cycle; component is the smallest node that it reaches and is reached by.

    Three steps take turns until no edge is left.  Trimming drops nodes without an edge in or out.
    Bypassing takes nodes with one edge in and one out off their chain, a random set without neighbours at
    once, so chains and rings of any length shrink by a share each time; such a node is later given the
    component that both its neighbours are in.  Colouring gives every node the greatest (by a random
    order) node that reaches it; what reaches that node within its colour is a component, and edges between colours are on
    no cycle, so the graph falls apart.  All tables have at most a row per node or edge.  Rounds grow with
    the longest shortest way among nodes that branch.  Nulls are no nodes.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    kind = edges.schema["src"].dataType.simpleString()
    found = Growing(scratch, f"node {kind}, root {kind}")
    start = scratch.keep(_proper(edges))
    loops = scratch.keep(start.where("src = dst").select(F.col("src").alias("node")))
    left, bypassed, turn = scratch.keep(start.where("src <> dst")), [], 0
    size = left.count()
    while size:
        turn += 1
        left, size = _trimmed(scratch, left, size)
        left, size = _shortened(scratch, left, size, bypassed)
        if size:
            left, size = _coloured(scratch, left, turn, found)
    known = scratch.keep(found.rows())
    for via in reversed(bypassed):
        a, b = (known.select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("before", "_a"), ("after", "_b")))
        met = via.join(a, "before", "left").join(b, "after", "left")
        ring = F.col("before") == F.col("after")
        own = met.where(ring | (F.col("_a") == F.col("_b"))).select("node", F.coalesce("_a", F.when(ring, F.col("before"))).alias("root"))
        heads = met.where(ring & F.col("_a").isNull()).select(F.col("before").alias("node"), F.col("before").alias("root")).distinct()
        known = scratch.keep(known.unionByName(own).unionByName(heads))
    alone = loops.join(known, "node", "left_anti").select("node", F.col("node").alias("root"))
    many = known.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("_n")).where("_n > 1")
    out = known.join(many, "root").select("node", "component").unionByName(known.join(loops, "node", "left_semi").join(many, "root", "left_anti").select("node", F.col("node").alias("component")))
    out = scratch.keep(out.unionByName(alone.select("node", F.col("root").alias("component"))))
    scratch.drop_all(out)
    found.drop()
    return out


def _trimmed(scratch: Scratch, left: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Edges less those of nodes without an edge in or out, as long as a tenth goes each time."""
    while size:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        now = scratch.keep(inner.select("src", "dst"))
        n = now.count()
        scratch.drop(left)
        left, size, before = now, n, size
        if 10 * (before - n) < before:
            break
    return left, size


def _shortened(scratch: Scratch, left: DataFrame, size: int, bypassed: list[DataFrame]) -> tuple[DataFrame, int]:
    """Edges with nodes of one edge in and one out bypassed, as long as a twentieth of the edges goes each time; what was bypassed is added to the list."""
    while size:
        out, into = _ends(left)
        thin = out.join(into, "node").where("n_out = 1 AND n_in = 1").select("node")
        up = thin.where(_coin(F.col("node"), len(bypassed)))
        # no two that are bypassed are neighbours
        chosen = up.join(left.join(up.select(F.col("node").alias("src")), "src", "left_semi").join(up.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("node")), "node", "left_anti")
        before = left.select(F.col("src").alias("before"), F.col("dst").alias("node"))
        after = left.select(F.col("src").alias("node"), F.col("dst").alias("after"))
        via = scratch.keep(chosen.join(before, "node").join(after, "node").select("node", "before", "after"))
        gone = via.select("node")
        kept = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        now = scratch.keep(kept.select("src", "dst").union(via.where("before <> after").select("before", "after")).distinct())
        n = now.count()
        scratch.drop(left)
        bypassed.append(via)
        left, size, was = now, n, size
        if 20 * (was - n) < was:
            break
    return left, size


def _coloured(scratch: Scratch, left: DataFrame, turn: int, found: Growing) -> tuple[DataFrame, int]:
    """Finds one component a colour; returns the edges within colours among the nodes that are in none of them."""
    nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
    colour = scratch.keep(nodes.select("node", F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("of")).alias("c"), F.lit(True).alias("new")))
    while True:
        told = colour.where("new").select(F.col("node").alias("src"), "c").join(left, "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("m"))
        better = F.coalesce(F.col("m") > F.col("c"), F.lit(False))
        now = scratch.keep(colour.join(told, "node", "left").select("node", F.when(better, F.col("m")).otherwise(F.col("c")).alias("c"), better.alias("new")))
        scratch.drop(colour)
        colour = now
        if colour.where("new").isEmpty():
            break
    of = colour.select("node", F.col("c.of").alias("root"))
    ends = left.join(of.select(F.col("node").alias("src"), F.col("root").alias("_r")), "src").join(of.select(F.col("node").alias("dst"), "root"), "dst")
    same = scratch.keep(ends.where("_r = root").select("src", "dst", "root"))
    own = Growing(scratch, found.schema)
    new = own.add(same.where("dst = root").select(F.col("root").alias("node"), "root").distinct())
    while not new.isEmpty():
        step = same.join(new.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "root").distinct()
        new = own.add(step.join(own.rows().select("node"), "node", "left_anti"))
    mine = own.rows()
    found.add(mine)
    rest = same.select("src", "dst")
    for end in ("src", "dst"):
        rest = rest.join(mine.select(F.col("node").alias(end)), end, "left_anti")
    rest = scratch.keep(rest.select("src", "dst"))
    scratch.drop(left, colour, same)
    own.drop()
    return rest, rest.count()


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node): the nodes that reach themselves over at least one edge."""
    return strong_components(edges).select("node")


def undirected(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): what a change of the roots may touch over links in either direction."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return closure(both, roots)
