"""Queries over row checks: the star schema's rows read as claims, prices, results, decisions, documents and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import query, read
from lodestone.functions import text as X
from lodestone.operators import rows as R


def said(pairs: dict[str, str]) -> str:
    """SQL of the names whose condition holds, joined by commas, in order."""
    return "array_to_string(list_filter(list_value(" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs.items()) + "), lambda v: v IS NOT NULL), ',')"


def report(df, key, violations):
    return df.select(*([key] if isinstance(key, str) else key), F.array_join(violations, ",").alias("violations")).where("violations <> ''")


def faults(table: str, key: str, pairs: dict[str, str]) -> str:
    return f"WITH v AS (SELECT {key}, {said(pairs)} AS violations FROM {table}) SELECT * FROM v WHERE violations <> ''"


CLAIMS = """o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'candidate' END AS status, CASE WHEN o_orderkey % 4 <> 1 THEN o_custkey END AS decision,
 CASE WHEN o_orderkey % 5 = 2 THEN 'fixture' ELSE 'extracted' END AS origin, CASE WHEN o_orderkey % 3 <> 0 THEN 'x' END AS object, CASE WHEN o_orderkey % 3 <> 1 THEN 'y' END AS value"""


@query(faults(f"(SELECT {CLAIMS} FROM orders)", "id", {"accepted_needs_decision": "status = 'accepted' AND id % 4 = 1", "fixture_never_accepted": "status = 'accepted' AND id % 5 = 2", "object_xor_value": "id % 3 = 2"}))
def assertion_rows(spark, sf_dir):
    return report(read(spark, sf_dir, "orders").selectExpr(*_cut(CLAIMS)), "id", R.assertion_rows())


def _cut(text):
    from lodestone.plans.knowledge import _columns

    return _columns(text)


PRICES = """p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'accepted' ELSE 'hold' END AS status, CASE WHEN p_size % 7 <> 3 THEN p_partkey END AS decision, CASE WHEN p_size % 9 = 4 THEN 'fixture' ELSE 'extracted' END AS origin, p_partkey % 2 = 0 AS eligible,
 CASE WHEN p_size % 5 <> 0 THEN map('age', '40', 'sex', 'male') WHEN p_size % 2 = 0 THEN map('age', '40') END AS conditions, CASE WHEN p_size % 6 <> 1 THEN p_brand END AS binding, CASE WHEN p_size % 8 <> 5 THEN '2026-01-01' END AS as_of,
 CASE WHEN p_size % 3 = 0 THEN array('package_binding') WHEN p_size % 3 = 1 THEN array('sex') ELSE cast(array() as array<string>) END AS missing"""


def prices(spark, sf_dir):
    return read(spark, sf_dir, "part").selectExpr(*_cut(PRICES))


_BARE = "p_size % 5 = 0 AND p_size % 2 <> 0 OR p_size % 6 = 1 OR p_size % 8 = 5 OR p_size % 3 <> 2"


@query(faults("part", "p_partkey AS id", {"accepted_needs_decision": "p_size % 2 = 0 AND p_size % 7 = 3", "fixture_never_accepted": "p_size % 2 = 0 AND p_size % 9 = 4", "eligible_needs_fields": f"p_partkey % 2 = 0 AND ({_BARE})", "eligible_needs_acceptance": "p_partkey % 2 = 0 AND p_size % 2 <> 0"}))
def premium_rows(spark, sf_dir):
    return report(prices(spark, sf_dir), "id", R.premium_rows())


@query(faults("part", "p_partkey AS id", {"conditions_required": "p_size % 5 = 0 AND p_size % 2 <> 0", "missing_package": "(p_size % 6 = 1) <> (p_size % 3 = 0)", "missing_as_of": "p_size % 8 = 5", "raw_vs_eligible": f"p_partkey % 2 = 0 AND ({_BARE} OR p_size % 2 <> 0)"}))
def premium_constraints(spark, sf_dir):
    """The store's own constraints on the same prices."""
    return report(prices(spark, sf_dir), "id", R.premium_constraints())


AMOUNT = "struct(CASE k % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'range' ELSE 'unknown' END AS kind, CASE WHEN k % 4 < 2 THEN 5 END AS krw, CASE WHEN k % 5 < 3 THEN k % 7 END AS lo, CASE WHEN k % 5 < 3 THEN 3 END AS hi)"
RESULTS = f"""k, CASE WHEN k % 4 = 0 THEN 'false' WHEN k % 4 = 3 THEN 'unknown' ELSE 'true' END AS eligibility, CASE k % 6 WHEN 0 THEN 'not_payable' WHEN 3 THEN 'undetermined' ELSE 'payable' END AS payout,
 CASE WHEN k % 6 NOT IN (0, 3) OR k % 11 = 0 THEN {AMOUNT} END AS amount, CASE WHEN k % 6 = 3 AND k % 13 <> 0 THEN {AMOUNT} END AS conditional,
 CASE WHEN k % 8 = 0 THEN array('zero_denominator') ELSE cast(array() as array<string>) END AS issues, CASE k % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'applies' WHEN 2 THEN 'undetermined' WHEN 3 THEN 'odd' END AS effect_kind,
 CASE WHEN k % 5 = 1 AND k % 7 <> 0 OR k % 17 = 0 THEN 'terminate' END AS effect, CASE WHEN k % 5 = 2 THEN 'terminate' END AS conditional_effect"""

_HAS, _IF = "(k % 6 NOT IN (0, 3) OR k % 11 = 0)", "(k % 6 = 3 AND k % 13 <> 0)"
_WRONG = "NOT CASE k % 3 WHEN 0 THEN k % 4 < 2 AND k % 5 >= 3 WHEN 1 THEN k % 4 >= 2 AND k % 5 < 3 AND k % 7 <= 3 ELSE k % 4 >= 2 AND k % 5 >= 3 END"
_EFFECT = "(k % 5 = 1 AND k % 7 <> 0 OR k % 17 = 0)"


@query(faults("(SELECT o_orderkey AS k FROM orders)", "k", {
    "payout_matches_eligibility": "(CASE k % 4 WHEN 0 THEN 0 WHEN 3 THEN 3 ELSE 1 END) <> (CASE k % 6 WHEN 0 THEN 0 WHEN 3 THEN 3 ELSE 1 END)",
    "payout_fields_match_kind": f"{_HAS} <> (k % 6 NOT IN (0, 3)) OR {_IF} <> (k % 6 = 3)",
    "amount_fields_match_kind": f"{_HAS} AND {_WRONG}",
    "amount_fields_match_kind'||'": f"{_IF} AND {_WRONG}",
    "issue_means_unknown_amount": f"k % 8 = 0 AND NOT (({_HAS} OR {_IF}) AND k % 3 = 2)",
    "effect_kind_known": "k % 5 = 3",
    "effect_fields_match_kind": f"k % 5 < 3 AND ({_EFFECT} <> (k % 5 = 1) OR FALSE)",
    "effect_matches_eligibility": "k % 5 < 3 AND NOT (k % 5 = 0 OR k % 4 IN (1, 2) AND k % 5 = 1 OR k % 4 = 3 AND k % 5 = 2)",
}))
def evaluation_rows(spark, sf_dir):
    """Result rows whose parts are dealt by their number, so every fault occurs; amounts are checked with them."""
    return report(read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr(*_cut(RESULTS)), "k", R.evaluation_rows())


@query(faults("(SELECT o_orderkey AS k FROM orders)", "k", {"amount_fields_match_kind": _WRONG}))
def amount_rows(spark, sf_dir):
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr("k", f"{AMOUNT} AS a").select("k", "a.*")
    return report(df, "k", R.amount_rows(F.col("kind"), F.col("krw"), F.col("lo"), F.col("hi")))


@query(faults("(SELECT o_orderkey AS k FROM orders)", "k", {"blocked_means_no_call": "k % 5 = 0 AND (k % 3 = 0 OR k % 4 = 0)", "issue_means_hold": "k % 3 = 0 AND k % 8 = 0 AND k % 7 <> 1"}))
def scenario_rows(spark, sf_dir):
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr("k", "if(k % 5 = 0, array('x'), cast(array() as array<string>)) AS blocked_by", "k % 3 = 0 AS evaluated", "k % 4 = 0 AS explained", "if(k % 8 = 0, array('z'), cast(array() as array<string>)) AS issues", "if(k % 7 = 1, 'hold', 'shown') AS display")
    return report(df, "k", R.scenario_rows())


@query("SELECT o_custkey, bool_and(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 <> 1 WHEN o_orderkey % 4 = 3 THEN FALSE ELSE o_orderkey % 5 IN (0, 2) END AND o_orderkey % 9 <> 8) AS ok FROM orders GROUP BY 1")
def evidence_valid(spark, sf_dir):
    """Each customer's orders as a list of evidence."""
    k = F.col("o_orderkey")
    role = F.when(k % 4 == 0, "observation").when(k % 4 == 3, "gossip").otherwise("basis")
    ref = F.concat(F.when(k % 5 == 1, "rule").when(k % 5 == 2, "clause").when(k % 5 == 0, "clause").when(k % 5 == 3, "obs").otherwise("raw"), F.lit(":"), F.when(k % 9 == 8, "").otherwise(k.cast("string")))
    got = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(ref.alias("ref"), role.alias("role"))).alias("e"))
    return got.select("o_custkey", R.evidence_valid(F.col("e"), ("basis", "cross_check", "observation")).alias("ok"))


@query("SELECT l_suppkey, bool_and(l_linenumber <> 5 AND l_quantity <> 13 AND l_quantity <> 17) AS ok FROM lineitem GROUP BY 1")
def edition_parts(spark, sf_dir):
    """Each supplier's line items as the parts of an edition."""
    li = F.col("l_linenumber")
    part = F.struct(F.when(li == 5, "Body").otherwise("body_1").alias("role"), F.when(F.col("l_quantity") != 13, "fp-0.1").alias("rule"), F.when(F.col("l_quantity") == 17, F.lit("ABC")).otherwise(F.sha2(F.col("l_orderkey").cast("string"), 256)).alias("sha256"))
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_list(part).alias("p")).select("l_suppkey", R.edition_parts_valid(F.col("p")).alias("ok"))


@query("""WITH f AS (SELECT l_orderkey AS k, count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') AS n FROM lineitem GROUP BY 1), v AS (SELECT k, array_to_string(list_filter(list_value(CASE WHEN n < 2 THEN 'two_families' END, CASE WHEN k % 2 = 0 AND (k % 3 = 0 OR k % 5 = 1 OR k % 7 = 2) THEN 'accepted_needs_sound_checks' END), lambda v: v IS NOT NULL), ',') AS violations FROM f) SELECT * FROM v WHERE violations <> ''""")
def review_decisions(spark, sf_dir):
    """Orders as decisions, the return flags of their lines as the families that reviewed; N is no label."""
    df = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("")).alias("families"))
    k = F.col("k")
    df = df.withColumns({"result": F.when(k % 2 == 0, "accepted").otherwise("hold"), "checks_passed": k % 3 != 0, "counterexamples": F.when(k % 5 == 1, 2).otherwise(0), "conflict": k % 7 == 2})
    return report(df, "k", R.review_decisions())


@query("SELECT l_orderkey, bool_and(l_quantity <> 11 AND l_returnflag <> 'A') AS ok FROM lineitem GROUP BY 1")
def json_items(spark, sf_dir):
    """Each order's lines as steps of a deletion, a target and a state each."""
    step = F.when(F.col("l_quantity") == 11, F.create_map(F.lit("target"), F.lit("raw"))).otherwise(F.create_map(F.lit("target"), F.lit("raw"), F.lit("state"), F.when(F.col("l_returnflag") == "A", "lost").when(F.col("l_returnflag") == "R", "failed").otherwise("done")))
    df = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(step).alias("steps"))
    ok = R.json_items(F.col("steps"), ("target", "state"), {"target": ("raw", "extracted", "index", "cache", "derived", "external"), "state": ("pending", "done", "failed")})
    return df.select("l_orderkey", ok.alias("ok"))


TABLE = """l_orderkey AS k, l_linenumber AS n, CASE WHEN l_quantity = 7 THEN 'none' ELSE sha2(cast(l_orderkey as string), 256) END AS sha256, CASE WHEN l_quantity % 10 = 3 THEN '0' WHEN l_quantity % 10 = 4 THEN ' ' WHEN l_quantity % 10 = 5 THEN 'table 2' ELSE cast(l_linenumber as string) END AS page,
 CASE WHEN l_returnflag = 'R' THEN 'needs_review' WHEN l_returnflag = 'A' THEN 'ok' ELSE 'odd' END AS status, CASE WHEN l_tax = 0.05 THEN '' ELSE 'v1.2' END AS version, CASE WHEN l_discount < 0.03 THEN '' ELSE '2026' END AS valid_from, '2027' AS valid_to, CASE WHEN l_linestatus = 'O' THEN ' ' ELSE 'not stated' END AS reason"""
_TABLE = {"no_evidence": "l_quantity = 7", "no_page": "l_quantity % 10 IN (3, 4)", "bad_status": "l_returnflag = 'N'", "bad_version": "l_tax = 0.05", "no_reason": "l_discount < 0.03 AND l_linestatus = 'O'"}


@query(faults("lineitem", "l_orderkey AS k, l_linenumber AS n", _TABLE))
def table_rows(spark, sf_dir):
    """Line items as extracted rows: no evidence, no row."""
    return report(read(spark, sf_dir, "lineitem").selectExpr(*_cut(TABLE)), ["k", "n"], R.table_rows())


@query(f"SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE NOT ({' OR '.join(f'({c})' for c in _TABLE.values())}) GROUP BY 1")
def service_view(spark, sf_dir):
    """Only rows without violations are served."""
    df = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS flag", *_cut(TABLE))
    return R.service_view(df, R.table_rows()).groupBy("flag").agg(F.count("*").alias("n"))


_TEXT = "lower(substr(html, 1, 8192))"


def _has(words):
    return "(" + " OR ".join("contains({}, '{}')".format(_TEXT, w.replace("'", "''")) for w in words) + ")"


@query(f"""SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN page_id % 6 = 1 THEN CASE WHEN page_id % 4 = 2 THEN 'mime_mismatch' END
 WHEN page_id % 4 = 0 OR {_has(R.HTML)} THEN CASE WHEN {_has(R.CHALLENGE)} THEN 'challenge_html' WHEN {_has(R.LOGIN)} THEN 'login_html' WHEN {_has(R.ERROR)} THEN 'error_html' ELSE 'unexpected_html' END
 WHEN page_id % 4 = 2 THEN 'mime_mismatch' ELSE 'magic_mismatch' END AS reason FROM pages""")
def admit_documents(spark, sf_dir):
    """Pages in answer to a request for a PDF; every sixth has its signature before the text."""
    i = F.col("page_id")
    body = F.when(i % 6 == 1, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.col("html"))
    mime = F.when(i % 4 == 0, "text/html; charset=utf-8").when(i % 4 == 2, "image/png").otherwise("application/pdf")
    return read(spark, sf_dir, "pages").withColumn("body", body).select("page_id", R.admit_document(F.col("body"), mime, "application/pdf").alias("reason"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'empty' WHEN event_id % 5 = 1 AND event_id % 3 <> 0 THEN 'declared_type_mismatch' WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'wrong_magic' WHEN event_id % 3 = 1 AND event_id % 2 = 1 THEN 'not_parseable' WHEN event_id % 3 = 2 THEN 'wrong_magic' END AS failure FROM events""")
def format_failures(spark, sf_dir):
    """Events' properties as bodies that were expected to be pages, data or PDFs."""
    i = F.col("event_id")
    expected = F.when(i % 3 == 0, "html").when(i % 3 == 1, "json").otherwise("pdf")
    body = F.when(i % 7 == 0, "").when((i % 3 == 0) & (i % 2 == 1), F.concat(F.lit(" \n<p>"), "props")).when((i % 3 == 1) & (i % 2 == 1), F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    mime = F.when(i % 5 == 1, "Text/HTML").otherwise("application/x")
    return read(spark, sf_dir, "events").select("event_id", R.format_failure(expected, mime, body).alias("failure"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN l_quantity % 7 >= l_linenumber WHEN l_orderkey % 4 = 1 THEN l_quantity % 7 >= l_linenumber AND l_quantity >= l_linenumber AND l_quantity <= l_quantity % 7 WHEN l_orderkey % 4 = 2 THEN TRUE ELSE FALSE END AS ok FROM lineitem""")
def reference_ids(spark, sf_dir):
    """Line items as references to segments and clauses, their numbers as pages."""
    k, a, b = F.col("l_orderkey"), F.col("l_linenumber"), (F.col("l_quantity") % 7).cast("int")
    sid = X.segment_id(F.sha2(k.cast("string"), 256), a, b, F.lit("terms"), F.lit("seg-1.0"))
    ref = F.when(k % 4 == 0, sid).when(k % 4 == 1, X.clause_id(sid, F.lit("article-1"), F.col("l_quantity").cast("int"), F.lit("x@1"))).when(k % 4 == 2, F.concat(F.lit("raw:"), k.cast("string"))).otherwise(F.concat(F.lit("odd:"), k.cast("string")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.ids_valid(ref).alias("ok"))


@query(faults("customer", "c_custkey AS id", {"bad_axis": "c_mktsegment = 'BUILDING'", "no_evidence": "c_custkey % 6 = 1", "hold_needs_reason": "(c_custkey % 4 = 0) <> (c_custkey % 5 = 0)", "unknown_needs_reason": "c_custkey % 3 = 0 AND c_custkey % 7 <> 0", "observed_needs_value": "c_custkey % 3 = 1 AND c_acctbal < 1000"}))
def field_rows(spark, sf_dir):
    """Customers as fields read from documents."""
    k = F.col("c_custkey")
    cols = {"axis": F.col("c_mktsegment"), "refs": F.when(k % 6 != 1, F.array(F.lit("clause:1"))), "status": F.when(k % 4 == 0, "hold").otherwise("accepted"), "hold_reason": F.when(k % 5 == 0, "unclear").otherwise(""), "value_state": F.when(k % 3 == 0, "unknown").when(k % 3 == 1, "observed").otherwise("conflicting"), "unknown_reason": F.when(k % 7 == 0, "blank"), "normalized": F.when(F.col("c_acctbal") >= 1000, F.col("c_acctbal"))}
    return report(read(spark, sf_dir, "customer").withColumns(cols).withColumnRenamed("c_custkey", "id"), "id", R.field_rows(("MACHINERY", "HOUSEHOLD", "AUTOMOBILE", "FURNITURE")))


@query(faults("part", "p_partkey AS id", {"no_amount_needs_reason": "p_size % 10 = 1 AND p_size % 3 <> 0", "amount_not_positive": "p_size % 10 = 2", "derived_needs_derivation": "p_size % 10 NOT IN (1, 2) AND p_size % 4 = 0 AND p_size % 5 <> 0", "no_basis": "p_brand = 'Brand#2'", "age_open": "p_size % 5 = 0 AND p_size % 2 <> 0", "sex_open": "p_size % 5 = 0 AND p_size % 3 <> 1", "bad_cycle": "p_size % 6 = 5"}))
def price_rows(spark, sf_dir):
    n = F.col("p_size")
    cols = {"amount": F.when(n % 10 != 1, F.when(n % 10 == 2, 0).otherwise(n * 100)), "unavailable": F.when(n % 3 == 0, "not listed"), "value_state": F.when(n % 4 == 0, "derived").otherwise("observed"), "derivation": F.when(n % 5 == 0, "sum"), "basis": F.when(F.col("p_brand") != "Brand#2", F.col("p_brand")), "cycle": F.when(n % 6 == 5, "weekly").when(n % 6 == 4, "annual").when(n % 6 == 3, "monthly")}
    raw = read(spark, sf_dir, "part").selectExpr("p_size", "p_brand", *_cut(PRICES)).withColumns(cols)
    return report(raw, "id", R.price_rows())


@query(faults("orders", "o_orderkey AS k", {"id_not_versioned": "o_orderkey % 8 = 3", "bad_criterion": "o_orderkey % 9 = 4", "empty_scope": "o_orderkey % 5 = 2", "bad_date": "o_orderkey % 7 = 6", "bad_instant": "o_orderkey % 11 = 5", "no_source": "o_orderkey % 6 = 0", "bad_source": "o_orderkey % 6 = 1", "repeated_source": "o_orderkey % 6 = 2"}))
def criteria_rows(spark, sf_dir):
    """Orders as versions of criteria."""
    k = F.col("o_orderkey")
    crit = F.when(k % 9 == 4, "Crit").otherwise(F.concat(F.lit("crit:"), k.cast("string")))
    array = lambda *x: F.array(*map(F.lit, x))
    cols = {"criterion": crit, "version": F.lit(2), "id": F.concat(crit, F.lit("@"), F.when(k % 8 == 3, "1").otherwise("2")), "scope": F.when(k % 5 != 2, array("x")).otherwise(F.array().cast("array<string>")), "effective": F.when(k % 7 == 6, "2025-02-29").when(k % 7 != 5, F.to_date("o_orderdate").cast("string")), "recorded": F.concat(F.to_date("o_orderdate").cast("string"), F.when(k % 11 == 5, " 10:00").otherwise("T10:00:00Z")), "sources": F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 6 == 1, array("web:1")).when(k % 6 == 2, array("raw:1", "raw:1")).otherwise(array("raw:1", "clause:2"))}
    return report(read(spark, sf_dir, "orders").withColumns(cols).withColumn("k", k), "k", R.criteria_rows((X.parse_date, X.is_rfc3339)))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#2' AND p_partkey > 40 ORDER BY p_partkey LIMIT 25")
def search_products(spark, sf_dir):
    """A page of a brand's parts after a cursor."""
    return R.search(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", 40, 25, p_brand="Brand#2")
