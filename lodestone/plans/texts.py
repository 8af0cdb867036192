"""Queries over text functions: notations written from the star schema's numbers and read back, and texts of documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import query, read
from lodestone.functions import rules
from lodestone.functions import text as X
from lodestone.operators import jobs

def K():
    return F.col("o_orderkey")


def N():
    return F.col("o_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 3 <> 1 THEN o_custkey * 100 + o_orderkey % 100 END AS num, CASE WHEN o_orderkey % 3 <> 1 THEN 100 END AS den,
 CASE WHEN o_orderkey % 4 <> 3 THEN chr(CAST(65 + o_custkey % 26 AS INT)) END AS letter, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_custkey % 100 AS INT) END AS major, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 1000 AS VARCHAR) END AS minor, o_orderkey % 6 NOT IN (1, 4) AS instant FROM orders""")
def parsed_texts(spark, sf_dir):
    """Dates, rates, codes and instants written from orders, some of them wrongly."""
    day = F.to_date("o_orderdate").cast("string")
    date = F.when(K() % 5 == 0, "2025-02-30").when(K() % 7 == 2, F.concat(day, F.lit(" "))).otherwise(day)
    rate = F.concat(N().cast("string"), F.when(K() % 3 == 1, ".").otherwise(F.concat(F.lit("."), F.lpad((K() % 100).cast("string"), 2, "0"))))
    code = F.concat(F.char(65 + N() % 26), F.lpad((N() % 100).cast("string"), 2, "0"), F.when(K() % 4 == 0, F.concat(F.lit("."), (N() % 1000).cast("string"))).when(K() % 4 == 3, ".").otherwise(""))
    instant = F.concat(day, F.when(K() % 6 == 0, "T23:59:59Z").when(K() % 6 == 1, "T24:00:00Z").when(K() % 6 == 2, "t01:02:03.5+09:00").when(K() % 6 == 3, "T00:00:00-00:30").when(K() % 6 == 4, "T10:00:00").otherwise("T10:00:00.123456z"))
    df = read(spark, sf_dir, "orders").select("o_orderkey", X.parse_date(date).alias("day"), X.parse_rate(rate).alias("r"), X.parse_code(code).alias("c"), X.is_rfc3339(instant).alias("instant"))
    return df.select("o_orderkey", "day", F.col("r.num").alias("num"), F.col("r.den").alias("den"), "c.letter", "c.major", "c.minor", "instant")


MONEY = "CAST(round(o_totalprice) AS BIGINT)"


@query(f"""WITH m AS (SELECT o_orderkey, {MONEY} * CASE WHEN o_orderkey % 3 = 0 THEN 10000 ELSE 1 END AS w FROM orders)
SELECT o_orderkey, CASE WHEN w <> 0 AND w % 10000 = 0 THEN format('{{:,}}', w // 10000) || '만원' ELSE format('{{:,}}', w) || '원' END AS krw, '월 ' || ((w + 500) // 1000 // 10) || '.' || ((w + 500) // 1000 % 10) || '만' AS man,
 array_to_string(list_sort(list_value(w, 15000)), ',') AS money, o_orderkey || '%,3개월,' || o_orderkey % 90 || '세' AS units, CASE o_orderkey % 4 WHEN 0 THEN 'large_unit' WHEN 1 THEN 'currency_sign' WHEN 2 THEN 'spelt_number' ELSE 'bare_unit' END AS forbidden FROM m""")
def money_texts(spark, sf_dir):
    """Amounts written out and read back, units, and the notations that are not allowed."""
    w = F.round("o_totalprice").cast("bigint") * F.when(K() % 3 == 0, 10000).otherwise(1)
    line = F.concat(F.lit("보험료 "), X.format_krw(w), F.lit(" 또는 1.5 만 원, "), K().cast("string"), F.lit(" % / 3개월 / "), (K() % 90).cast("string"), F.lit(" 세"))
    odd = F.when(K() % 4 == 0, "3억").when(K() % 4 == 1, "₩100").when(K() % 4 == 2, "백 만원").otherwise("월 5만 ")
    return read(spark, sf_dir, "orders").withColumn("w", w).withColumn("line", line).select("o_orderkey", X.format_krw(F.col("w")).alias("krw"), X.man_display(F.col("w")).alias("man"), F.array_join(X.money_tokens(F.col("line")).cast("array<string>"), ",").alias("money"), F.array_join(X.unit_tokens(F.regexp_replace("line", ".*원, ", "")), ",").alias("units"), F.array_join(X.forbidden_money(odd), ",").alias("forbidden"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'article-' || o_custkey WHEN 1 THEN 'article-' || o_custkey || '-2' WHEN 2 THEN 'article-' || o_custkey END AS slug, CASE WHEN o_orderkey % 5 < 3 THEN 'clause:seg:' || substr(sha256(o_custkey::VARCHAR), 1, 12) || ':p1-9:terms:seg-1/article-' || o_custkey || CASE WHEN o_orderkey % 5 = 1 THEN '-2' ELSE '' END || '#p3:x@1' END AS clause FROM orders")
def article_paths(spark, sf_dir):
    """Heading lines, one of five kinds each, as slugs and clause ids."""
    n = N().cast("string")
    line = F.when(K() % 5 == 0, F.concat(F.lit("제 "), n, F.lit("조 (목적)"))).when(K() % 5 == 1, F.concat(F.lit("제"), n, F.lit("조의 2(기간)"))).when(K() % 5 == 2, F.concat(F.lit("Article "), n)).when(K() % 5 == 3, F.concat(F.lit("Article "), n, F.lit(" applies"))).otherwise(F.concat(F.lit(" 제"), n, F.lit("조")))
    slug = X.article_path(line)["slug"]
    sid = X.segment_id(F.sha2(n, 256), F.lit(1), F.lit(9), F.lit("terms"), F.lit("seg-1"))
    return read(spark, sf_dir, "orders").select("o_orderkey", slug.alias("slug"), X.clause_id(sid, slug, F.lit(3), F.lit("x@1")).alias("clause"))


@query("SELECT doc_id, 'objects/sha256/' || substr(d, 1, 2) || '/' || substr(d, 3, 2) || '/' || d AS object, 'observations/' || source || '/20260102T030405Z_' || substr(d, 1, 16) || '.json' AS observation, sha256(coalesce(source, '')) AS model FROM (SELECT doc_id, source, sha256(coalesce(text, '')) AS d FROM documents)")
def archive_keys(spark, sf_dir):
    d = F.sha2(F.coalesce("text", F.lit("")), 256)
    return read(spark, sf_dir, "documents").select("doc_id", X.object_key(d).alias("object"), X.observation_key(F.col("source"), F.lit("2026-01-02T03:04:05Z"), d).alias("observation"), X.model_ref_hash(F.col("source")).alias("model"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'reachable' WHEN 1 THEN 'origin_denied' WHEN 2 THEN 'not_checked' WHEN 3 THEN 'geo_blocked' WHEN 4 THEN 'proxy_error' WHEN 5 THEN 'reachable' WHEN 6 THEN 'rate_limited' END AS access,
 CASE WHEN event_id % 3 = 0 THEN 'unqueried' ELSE CASE event_id % 8 WHEN 0 THEN 'failed' WHEN 5 THEN 'failed' WHEN 1 THEN 'blocked' WHEN 3 THEN 'blocked' WHEN 4 THEN 'failed' WHEN 6 THEN 'failed' WHEN 2 THEN 'unqueried' ELSE 'unqueried' END END AS status,
 CASE WHEN event_id % 5 = 0 THEN 'awaiting_T-DT-04;awaiting_domestic_env' || CASE WHEN event_id % 3 <> 0 THEN ';disclosure_entry_missing' ELSE '' END || CASE WHEN event_id % 8 = 3 THEN ';foreign_sandbox_geo_blocked' ELSE '' END ELSE 'kept' END AS codes FROM events""")
def registry_access(spark, sf_dir):
    """Access results of eight kinds, the state of the disclosure room and the codes of its product list."""
    i = F.col("event_id")
    raw = F.when(i % 8 == 0, "200").when(i % 8 == 1, "302 -> 403 (http://x/y)").when(i % 8 == 2, " ").when(i % 8 == 3, "301 -> foreign").when(i % 8 == 4, "503").when(i % 8 == 5, "reachable").when(i % 8 == 6, "429")
    access = X.host_access(F.when(i % 8 == 7, "strange").otherwise(raw), ("reachable", "geo_blocked", "origin_denied"), {"foreign": "geo_blocked"})
    url, dis = F.when(i % 3 == 0, "http://x").otherwise(""), F.when(i % 3 < 2, "reachable")
    maps = {"reachable": "archived", "origin_denied": "blocked", "geo_blocked": "blocked", "proxy_error": "failed", "rate_limited": "failed", "not_checked": "unqueried"}
    return read(spark, sf_dir, "events").withColumn("a", access).select("event_id", F.col("a").alias("access"), X.disclosure_status(url, dis, F.col("a"), maps)["status"].alias("status"), X.product_list_codes(F.when(i % 5 == 0, "unqueried").otherwise("listed"), F.lit("kept"), url, dis, F.col("a")).alias("codes"))


@query("SELECT l_orderkey, l_linenumber, sha256('class\x1f' || l_returnflag || chr(30) || 'price\x1f' || CASE WHEN l_linenumber = 3 THEN chr(0) ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) END) AS digest FROM lineitem")
def content_hashes(spark, sf_dir):
    """A hash over a row's named columns in name order, a null apart from every text."""
    price = F.when(F.col("l_linenumber") != 3, F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.content_hash(**{"price": price, "class": F.col("l_returnflag")}).alias("digest"))


@query("SELECT event_id, 'k' AS texts FROM events")
def json_texts(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.array_join(X.json_texts(F.col("props")), "|").alias("texts"))


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS n FROM documents")
def squeezed(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.length(X.squeeze(F.coalesce("text", F.lit("")))).cast("bigint").alias("n"))


@query("WITH c AS (SELECT o_orderkey, o_custkey AS u, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, sha256('day=' || d || chr(31) || 'user=' || u) AS digest FROM c")
def input_hash(spark, sf_dir):
    """The hash of a request's typed inputs in name order."""
    return read(spark, sf_dir, "orders").select("o_orderkey", rules.row_hash(user=N(), day=F.to_date("o_orderdate")).alias("digest"))


@query("""WITH c AS (SELECT l_returnflag, CAST(round(l_extendedprice) AS BIGINT) AS a, CAST(round(l_tax * 100000) AS BIGINT) AS b, CAST(l_linenumber AS BIGINT) AS n FROM lineitem)
SELECT l_returnflag, CAST(sum(a + b) AS BIGINT) AS added, CAST(sum(least(a, b)) AS BIGINT) AS capped, CAST(sum(greatest(a, b)) AS BIGINT) AS most, CAST(sum(a * n) AS BIGINT) AS times, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS less FROM c GROUP BY 1""")
def rule_sums(spark, sf_dir):
    """Sum, cap, maximum, product by a count and difference of amounts."""
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", F.round("l_extendedprice").cast("bigint").alias("a"), F.round(F.col("l_tax") * 100000).cast("bigint").alias("b"), F.col("l_linenumber").cast("bigint").alias("n"))
    a, b, n = rules.given_amount("a"), rules.given_amount("b"), rules.given("n", "bigint")
    for name, v in (("added", rules.add(a, b)), ("capped", rules.apply_cap(a, b)), ("most", rules.greatest(a, b)), ("times", rules.multiply_count(a, n)), ("less", rules.subtract_floor0(a, b))):
        df, _ = rules.keep(df, name, v)
    return df.groupBy("l_returnflag").agg(*[F.sum(f"{c}__lo").alias(c) for c in ("added", "capped", "most", "times", "less")])


@query("SELECT conv_id, count(*) AS n, CAST(sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS BIGINT) AS chars FROM conversations WHERE turn % 2 = 1 AND text IS NOT NULL AND length(regexp_replace(text, '\\s+', '', 'g')) > 0 GROUP BY 1")
def quoted_passages(spark, sf_dir):
    """Conversations as extracts whose odd turns are quoted, each turn on a page of its own."""
    t = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    line = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("```text\n[PDF p."), F.col("turn").cast("string"), F.lit("]\n"), F.regexp_replace("text", "[`.]{3,}", ""), F.lit("\n```\n"))).otherwise(F.concat(F.regexp_replace("text", "`", "'"), F.lit("\n")))
    md = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "").alias("md"))
    return jobs.passages(md, "conv_id", "md").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("passage")).cast("bigint").alias("chars"))
