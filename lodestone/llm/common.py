"""What several operators share: reading, shared scratch tables, hashing, graph components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables.  Its texts are large, so workers get them in small Arrow batches, unless the session says otherwise."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":  # Spark's default
        spark.conf.set(size, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only on one machine that names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not found:
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> str:
    """The path of a new scratch table in the shared folder that holds df as Parquet."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


#: Scratch tables of this process that are still there.
_WRITTEN: list[str] = []


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete some of the scratch tables."""
    for name in list(paths):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(name)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this process; to be called when no result over them is needed any more."""
    drop(spark, _WRITTEN)


def crc_mod(column: str, n: int):
    """crc32 of the value as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def give_back() -> None:
    """Return freed memory to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def trimmed(run):
    """run, a generator over batches, giving freed memory back to the system when it ends: Python workers live on between tasks."""

    @functools.wraps(run)
    def out(batches):
        yield from run(batches)
        give_back()

    return out


_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, elementwise."""
    x = (x + _GOLDEN).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """uint64 hashes to doubles in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v): (node, component), component the smallest member.

    Alternates the large-star and small-star steps (Kiveris et al. 2014) on tables in the shared
    folder until every node points at one root alone, so rounds grow with the logarithm of the size and no
    node's neighbourhood is gathered in one place.  Self links, repeats and nulls add nothing; an
    empty input gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    kind, at = e.schema, stored(e)
    e = spark.read.schema(kind).parquet(at)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        middle = stored(large)
        large = spark.read.schema(kind).parquet(middle)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        end = stored(small.where("u > v").distinct())
        drop(spark, [at, middle])
        at, e = end, spark.read.schema(kind).parquet(end)
        several = e.groupBy("u").count().where("count > 1")
        if several.isEmpty() and e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
