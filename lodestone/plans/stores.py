"""Queries that write the star schema in the formats of the sources and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import _SQL, query, read
from lodestone.functions import text as X
from lodestone.operators import history, jobs, links
from lodestone.plans import knowledge as K
from lodestone.sources import files
from lodestone.streaming.streams import scratch


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def sections(spark, sf_dir):
    """Suppliers as the records of a section, one document a nation."""
    path = scratch(spark)
    read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("nodes")).select("nodes").repartition(4).write.option("maxRecordsPerFile", 1).json(path)
    return files.load_sections(spark, path, "nodes", "id: bigint, name: string")


@query("SELECT sha256(n_name || chr(10)) AS sha256, length(n_name) + 1 AS size FROM nation")
def archive_listing(spark, sf_dir):
    """Nations' names as files, listed with their hashes."""
    path = scratch(spark)
    read(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path)
    return files.listing(spark, path).where("key LIKE '%.txt'").select("sha256", "size")


@query("SELECT sha256(n_name || chr(10)) AS sha256 FROM nation")
def rule_files(spark, sf_dir):
    path = scratch(spark)
    read(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path)
    return files.load_rules(spark, path).where("rule_path LIKE '%.txt'").select("sha256")


@query("SELECT 'kept' AS what, count(*) AS n FROM customer WHERE c_custkey % 10 NOT IN (3, 4) UNION ALL SELECT 'rejected', count(*) FROM customer WHERE c_custkey % 10 IN (3, 4)")
def registry_csv(spark, sf_dir):
    """Customers as lines of a registry, some with a cell too few and some with a word for a number."""
    k = F.col("c_custkey")
    line = F.when(k % 10 == 3, F.concat(k.cast("string"), F.lit(",x"))).when(k % 10 == 4, "word,x,1").otherwise(F.concat_ws(",", k.cast("string"), F.lit("x"), F.lit("2")))
    path = scratch(spark)
    lines = read(spark, sf_dir, "customer").select(line.alias("value")).repartition(4)
    parts = lines.groupBy(F.spark_partition_id().alias("p")).agg(F.concat(F.lit("id,name,n\n"), F.array_join(F.collect_list("value"), "\n")).alias("value"))
    parts.select("value").write.option("maxRecordsPerFile", 1).text(path)
    kept, rejected = files.read_registry(spark, path, "id bigint, name string, n int")
    return kept.select(F.lit("kept").alias("what")).union(rejected.select(F.lit("rejected"))).groupBy("what").agg(F.count("*").alias("n"))


@query("SELECT concat('crit:', o_custkey) AS criterion, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS version, concat('raw:', o_orderkey) AS source FROM orders")
def criteria_files(spark, sf_dir):
    """Customers as criteria, their orders as versions with a source each."""
    path = scratch(spark)
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    versions = F.transform("ks", lambda k, i: F.struct((i + 1).alias("version"), F.lit("2026-01-01").alias("effective"), F.array(F.concat(F.lit("raw:"), k.cast("string"))).alias("sources")))
    doc = F.to_json(F.struct(F.concat(F.lit("crit:"), F.col("o_custkey").cast("string")).alias("criterion"), versions.alias("versions")))
    o.select(doc.alias("value")).write.text(path)
    rows, _ = files.read_criteria(spark, path, lines=True)
    return rows.select("criterion", "version", "source")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END AS violations FROM events")
def observation_files(spark, sf_dir):
    path = scratch(spark)
    read(spark, sf_dir, "events").select("event_id", "event_type").write.json(path)
    got = files.read_observations(spark, path, "event_id bigint, event_type string", failed=F.col("event_type") == "error")
    return got.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def gap_log(spark, sf_dir):
    """Failed events appended to a gap log in two goes."""
    path, e = scratch(spark), read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id")
    for part in (0, 1):
        files.append_gaps(e.where(F.col("event_id") % 2 == part), path)
    return files.read_gap_log(spark, path, "event_id bigint, user_id bigint").select("event_id", "user_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 7 <> 0")
def versioned_table(spark, sf_dir):
    """The valid parts written under their content's hash, twice to the same end, and read back."""
    path, p = scratch(spark), read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    bad = F.array_compact(F.array(F.when(F.col("p_size") % 7 == 0, "odd")))
    first, again = (files.write_versioned(rows, path, "1", bad) for rows in (p, p.repartition(3)))
    assert first == again
    return files.read_versioned(spark, first, "p_partkey bigint, p_name string, p_size int").select("p_partkey", "p_name")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, 1 AS names FROM customer")
def exported_persons(spark, sf_dir):
    """Every customer's own data as one document."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    doc = files.export_person({"orders": o, "person": read(spark, sf_dir, "customer").select("c_custkey", "c_name")}, "c_custkey")
    n = lambda field: F.coalesce(F.json_array_length(F.get_json_object("document", f"$.{field}")), F.lit(0))
    return doc.select("c_custkey", n("orders").cast("bigint").alias("orders"), n("person").alias("names"))


@query("SELECT conv_id, turn, 'article-' || turn AS slug, 'clause:seg:000000000000:p1-99:terms:s-1/article-' || turn || '#p' || turn || ':x@1' AS clause FROM conversations WHERE turn % 2 = 0 AND turn > 0")
def clause_rows(spark, sf_dir):
    """Turns as lines of a document, every second with a heading."""
    t = F.col("turn").cast("string")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("제"), t, F.lit("조(x)"))).otherwise(F.concat(F.lit("see 제"), t, F.lit("조")))
    lines = read(spark, sf_dir, "conversations").where("turn > 0").select("conv_id", "turn", text.alias("text"))
    got = jobs.clause_rows(lines.withColumn("s", F.lit("seg:000000000000:p1-99:terms:s-1")), "s", "turn", "text", "x@1", ["conv_id"])
    return got.select("conv_id", "turn", "slug", "clause")


@query("SELECT page_id, CAST(page_id % 4 + 1 AS BIGINT) AS members FROM pages")
def member_rows(spark, sf_dir):
    """Every page with a table of members written into it, a row short of a cell among them, read back."""
    i = F.col("page_id")
    row = lambda n: F.concat(F.lit("<tr><td>http://m"), n.cast("string"), F.lit("</td><td>name <b>"), n.cast("string"), F.lit("</b></td><td>x</td></tr>"))
    table = F.concat(F.lit("<table class=members><tr><th>Site</th><th>Name</th><th>Kind</th></tr><tr><td>short</td></tr>"), F.array_join(F.transform(F.sequence(F.lit(0), i % 4), row), ""), F.lit("</table>"))
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), table).alias("html"))
    got = jobs.member_rows(pages, ("Name", "Site"), cls="members").where(F.element_at("cells", 1).startswith("name ") & F.element_at("cells", 2).startswith("http"))
    return got.groupBy("page_id").agg(F.count("*").alias("members"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 2 THEN 'undeclared' WHEN l_quantity = 9 THEN 'differs' ELSE 'agrees' END AS status FROM lineitem")
def screen_numbers(spark, sf_dir):
    """The amounts that lines show against the sources they declare."""
    li = read(spark, sf_dir, "lineitem")
    said = F.concat(F.lit("월 "), X.format_krw(F.col("l_partkey") * 7 + F.when(F.col("l_quantity") == 9, 1).otherwise(0)), F.lit(" 지급"))
    shown = li.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("line"), F.when(F.col("l_linenumber") == 2, "none").otherwise("premium").alias("kind"), F.col("l_partkey").cast("string").alias("ref"), F.element_at(X.money_tokens(said), 1).alias("krw"))
    sources = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ref"), (F.col("p_partkey") * 7).alias("krw"))
    status = jobs.amount_sources(shown, {"premium": sources})
    return status.select("line.*", F.when(F.col("status") == "unknown_kind", "undeclared").otherwise(F.col("status")).alias("status"))


@query(" UNION ALL ".join(f"SELECT code, subject::VARCHAR AS subject, message FROM ({_SQL[n]})" for n in ("check_release", "check_evidence", "check_nodes", "check_rules", "check_forks", "check_enabled", "check_prices", "check_realized", "check_editions", "check_service", "check_manifest", "check_private", "check_scope_claims")) + f" UNION ALL SELECT 'K4', node, 'cycle' FROM ({_SQL['check_scope_cycles']})")
def violations(spark, sf_dir):
    """All checks, K1 to K16, KP and KM, as one frame."""
    store = K.Store(spark, sf_dir)
    of_claims = (K.check_evidence, K.check_nodes, K.check_rules, K.check_forks, K.check_enabled, K.check_realized, K.check_editions, K.check_service, K.check_scope_claims)
    out = K.check_scope_cycles(spark, sf_dir, store).select(F.lit("K4").alias("code"), F.col("node").alias("subject"), F.lit("cycle").alias("message"))
    for found in (*(check(spark, sf_dir, store) for check in of_claims), *(check(spark, sf_dir) for check in (K.check_release, K.check_prices, K.check_manifest, K.check_private))):
        out = out.union(found.select("code", F.col("subject").cast("string"), "message"))
    return out


@query("""WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderstatus FROM orders), t AS (SELECT o_custkey, arg_max(o_orderkey, version) AS id, arg_max(o_orderstatus, version) AS s FROM v GROUP BY 1), b AS (SELECT substr(sha256(id::VARCHAR), 1, 2) AS b, count(*) AS n, sha256(string_agg(id || chr(31) || s, chr(30) ORDER BY id || chr(31) || s)) AS h FROM t GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS members, sha256(string_agg(b || h, chr(30) ORDER BY b)) AS content_sha256 FROM b""")
def criteria_freeze(spark, sf_dir):
    """The newest version of every customer's record as a release."""
    from lodestone.catalog import versions

    tips = history.tip_versions(versions(spark, sf_dir), "o_custkey", "version").withColumn("release", F.lit(1))
    return links.freeze(tips, "release", "o_orderkey", F.col("o_orderstatus")).drop("release")
