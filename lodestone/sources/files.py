"""Readers and writers: sections and criteria as JSON, registries as CSV, logs as JSON lines, versioned tables, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REJECTED = "_rejected"


def load_sections(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """The records of one section of JSON documents {section: [records]}."""
    rows = spark.read.option("multiLine", True).schema(f"{section} array<struct<{schema}>>").json(path)
    return rows.select(F.explode(section).alias("r")).select("r.*")


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule_path, content, sha256) of every rule file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("rule_path"), F.col("content"), F.sha2("content", 256).alias("sha256"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(key, sha256, size) of everything below a folder, keys relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/").split(":")[-1]
    return files.select(F.substring_index("path", f"{base}/", -1).alias("key"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def read_registry(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected (line, reason)) of CSV files with a header each.

    A file whose header does not name the schema's columns in their order is rejected whole, told by its header (reason header);
    a line that lacks cells, has too many or does not fit the schema is rejected (reason cells).  Blank lines are none.
    """
    at = F.monotonically_increasing_id()  # lines of a file ascend, and its first block begins at 0
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), at.alias("n"))
    head = lines.where("start = 0").groupBy("file").agg(F.min("n").alias("first"), F.min_by("value", "n").alias("head"))
    names = F.transform(F.split("head", ","), lambda c: F.regexp_replace(F.trim(c), r'^\ufeff?"?|"?$', ""))
    fits = names == F.array(*[F.lit(f.name) for f in StructType.fromDDL(schema)])
    own = lines.join(head.withColumn("fits", fits), "file").where("value <> ''")
    read = own.where("fits AND n <> first").select("value", F.from_csv("value", f"{schema}, {REJECTED} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED}).alias("r"))
    bad = read.where(f"r.{REJECTED} IS NOT NULL").select(F.col("value").alias("line"), F.lit("cells").alias("reason"))
    return read.where(f"r.{REJECTED} IS NULL").select("r.*").drop(REJECTED), head.where(~fits).select(F.col("head").alias("line"), F.lit("header").alias("reason")).union(bad)


def read_criteria(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(versions with their sources as rows, findings): JSON documents {criterion, versions: [{version, effective, sources: [ref]}]}, one a file or one a line.

    A key that begins with `default` is reserved, and a criterion without versions is empty; both are findings.
    """
    text = spark.read.text(path, wholetext=not lines)
    kind = "criterion string, versions array<struct<version: int, effective: string, sources: array<string>>>"
    docs = text.select("value", F.from_json("value", kind).alias("d"))
    why = F.array_compact(F.array(F.when(F.col("value").rlike(r'"default[A-Za-z0-9_]*"\s*:'), "reserved_key"), F.when(F.coalesce(F.size("d.versions"), F.lit(0)) <= 0, "no_versions")))
    rows = docs.select("d.criterion", F.explode_outer("d.versions").alias("v")).where("v IS NOT NULL").select("criterion", "v.version", "v.effective", F.explode_outer("v.sources").alias("source"))
    return rows, docs.select("d.criterion", F.explode(why).alias("finding"))


def read_observations(spark: SparkSession, path: str, schema: str, **bad: Column) -> DataFrame:
    """JSON lines with their violations, an array of the names whose condition holds."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in bad.items()])))


def read_gap_log(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...] = (1,)) -> DataFrame:
    """The gap log; a malformed line or one of an unknown version fails the read."""
    rows = spark.read.schema(f"{schema}, version int").json(path, mode="FAILFAST")
    known = F.when(F.col("version").isin(*versions), F.col("version")).otherwise(F.raise_error(F.lit("unknown version of the gap log")).cast("int"))
    return rows.withColumn("version", known)


def append_gaps(rows: DataFrame, path: str, version: int = 1) -> None:
    rows.withColumn("version", F.lit(version)).write.mode("append").json(path)


def write_versioned(rows: DataFrame, path: str, version: str, violations: Column) -> str:
    """The folder of the valid rows, named by the version and their content; the same content is written once and never changed.

    The content hash is taken over sorted hashes of rows in buckets, so no table is gathered.
    """
    good = rows.where(F.size(violations) == 0)
    row = F.sha2(F.to_json(F.struct(*sorted(good.columns)), {"ignoreNullFields": "false"}), 256)
    part = good.select(row.alias("h")).groupBy(F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    (digest,) = part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256)).first()
    folder = f"{path.rstrip('/')}/extractor_version={version}/content_sha256={digest}"
    spark = rows.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        good.write.mode("errorifexists").csv(folder, header=True)
    return folder


def read_versioned(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a versioned table; a header in another order fails."""
    return spark.read.csv(folder, schema=schema, header=True, enforceSchema=False)


def export_person(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, document): all rows of every person, table by table, as one JSON text each."""
    out = None
    for name, rows in sorted(tables.items()):
        side = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != key]))).alias(name))
        out = side if out is None else out.join(side, key, "full_outer")
    return out.select(key, F.to_json(F.struct(*sorted(tables))).alias("document"))
