"""The queries for the policy-knowledge operators, by name, with their SQL.

Cases, requests, observations and releases are read from the given star schema: line items are cases
of a rule (the order date is the contract's, the ship date the event's), orders are versions and
requests, events are observations and ledger records.  Money is made whole units once, at the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as X
from lodestone.operators import checks, graph, history, links, registry, usage
from lodestone.streaming import streams

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark, sf_dir):
    """Line items as cases: contract and event day, amount in whole units; the event day is unknown for flag N."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").cast("string").alias("contract"))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate").cast("string")).alias("event"), F.to_date("l_shipdate").alias("ship"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"), F.col("l_quantity").cast("bigint").alias("qty"))
    return li.join(o, "l_orderkey")


CASES = """SELECT l_orderkey, l_linenumber, l_returnflag, CAST(o_orderdate AS DATE) AS contract, CAST(l_shipdate AS DATE) AS ship,
  CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS DATE) END AS event, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


@query(f"""WITH c AS ({CASES}), e AS (
  SELECT *, event >= contract AND event >= contract + 90 AS ok, CASE WHEN event < contract + 180 THEN amount // 2 ELSE amount END AS pay FROM c),
r AS (SELECT CASE WHEN event IS NULL THEN 'undetermined' WHEN ok THEN 'payable' ELSE 'not_payable' END AS kind, CASE WHEN event IS NULL THEN 'event' ELSE '' END AS missing, CASE WHEN ok THEN pay END AS pay, l_returnflag FROM e)
SELECT l_returnflag, kind, missing, count(*) AS n, CAST(sum(pay) AS BIGINT) AS paid FROM r GROUP BY ALL""")
def rule_payout(spark, sf_dir):
    """A waiting-period rule over all cases: nothing in the first 90 days, half below 180 days."""
    df = cases(spark, sf_dir)
    df, contract = R.keep(df, "c", R.given("contract", "date"))
    df, event = R.keep(df, "e", R.given("event", "date"))
    df, amount = R.keep(df, "a", R.given_amount("amount"))
    df, waited = R.keep(df, "w", R.compare("gte", event, R.date_add(contract, 90, "day")))
    df, after = R.keep(df, "s", R.compare("gte", event, contract))
    df, early = R.keep(df, "x", R.compare("lt", event, R.date_add(contract, 180, "day")))
    df, half = R.keep(df, "h", R.multiply_rate(amount, 1, 2, "floor"))
    df, eligible = R.keep(df, "ok", R.all_of(after, waited))
    df, paid = R.keep(df, "p", R.choose_amount(early, half, amount))
    done = df.select("l_returnflag", R.payout(eligible, paid, "terminate").alias("p"))
    return done.groupBy("l_returnflag", F.col("p.kind").alias("kind"), F.array_join("p.missing", ",").alias("missing")).agg(F.count("*").alias("n"), F.sum("p.min_krw").alias("paid"))


@query(f"""WITH c AS ({CASES}), p AS (SELECT l_returnflag, CAST(amount AS HUGEINT) * 3 AS n, CAST(7000 AS HUGEINT) AS d FROM c)
SELECT l_returnflag, CAST(sum(n // d * 1000) AS BIGINT) AS floored, CAST(sum((n // d + CASE WHEN n % d > 0 THEN 1 ELSE 0 END) * 1000) AS BIGINT) AS ceiled,
 CAST(sum((n // d + CASE WHEN 2 * (n % d) >= d THEN 1 ELSE 0 END) * 1000) AS BIGINT) AS half_up,
 CAST(sum((n // d + CASE WHEN 2 * (n % d) > d OR (2 * (n % d) = d AND (n // d) % 2 = 1) THEN 1 ELSE 0 END) * 1000) AS BIGINT) AS half_even,
 CAST(sum(CASE WHEN n % d > 0 THEN 1000 ELSE 0 END) AS BIGINT) AS open_width FROM p GROUP BY 1""")
def rule_rounding(spark, sf_dir):
    """amount * 3/7 to whole thousands in every rounding mode, summed."""
    df, a = R.keep(cases(spark, sf_dir), "a", R.given_amount("amount"))
    a.hi, by = a.lo, {}  # exact amounts
    for m in ("floor", "ceil", "half_up", "half_even", "unspecified"):
        df, by[m] = R.keep(df, m, R.multiply_rate(a, 3, 7, m, 1000))
    return df.groupBy("l_returnflag").agg(F.sum(by["floor"].lo).alias("floored"), F.sum(by["ceil"].lo).alias("ceiled"), F.sum(by["half_up"].lo).alias("half_up"), F.sum(by["half_even"].lo).alias("half_even"), F.sum(by["unspecified"].hi - by["unspecified"].lo).alias("open_width"))


@query(f"""WITH c AS ({CASES}), v AS (SELECT event >= contract + 30 AS a, qty > 25 AS b FROM c)
SELECT a AND b AS both_hold, a OR b AS one_holds, CASE WHEN a IS NULL AND b THEN 'event' ELSE '' END AS both_missing, CASE WHEN a IS NULL AND NOT b THEN 'event' ELSE '' END AS one_missing, count(*) AS n FROM v GROUP BY ALL""")
def rule_kleene(spark, sf_dir):
    """A decisive child absorbs an unknown one; otherwise the unknown names its input."""
    a = R.compare("gte", R.given("event", "date"), R.date_add(R.given("contract", "date"), 30, "day"))
    b = R.compare("gt", R.given("qty", "bigint"), R.lit(25))
    both, one = R.all_of(a, b), R.any_of(a, b)
    return cases(spark, sf_dir).select(both.value.alias("both_hold"), one.value.alias("one_holds"), F.array_join(both.missing, ",").alias("both_missing"), F.array_join(one.missing, ",").alias("one_missing")).groupBy("both_hold", "one_holds", "both_missing", "one_missing").agg(F.count("*").alias("n"))


@query(f"""WITH c AS ({CASES}), d AS (SELECT *, ship - contract AS days FROM c WHERE ship >= contract)
SELECT l_returnflag, count(*) AS n, CAST(sum(greatest(days - 1, 0)) AS BIGINT) AS between_days, CAST(sum(CAST(amount AS HUGEINT) * least(days, 365) // 365) AS BIGINT) AS pro_rata,
 CAST(sum(CASE WHEN qty > 0 THEN amount // qty END) AS BIGINT) AS per_unit FROM d GROUP BY 1""")
def rule_proportions(spark, sf_dir):
    """Days between, pro rata by days of a year, and division by a count; reversed dates drop out as errors."""
    days = R.days_between(R.given("contract", "date"), R.Val(F.col("ship"), R.no_causes(), R.none()))
    part = R.Val(F.least(F.datediff("ship", F.col("contract").cast("date")), F.lit(365)).cast("bigint"), R.no_causes(), R.none())
    a = R.given_amount("amount")
    pro, per = R.pro_rata(a, part, R.lit(365)), R.divide_count(a, R.given("qty", "bigint"))
    rows = cases(spark, sf_dir).select("l_returnflag", days.value.alias("d"), days.error.alias("e"), pro.lo.alias("p"), per.lo.alias("u")).where("e is null")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("d").alias("between_days"), F.sum("p").alias("pro_rata"), F.sum("u").alias("per_unit"))


@query(f"""WITH c AS ({CASES}), y AS (SELECT contract, ship, year(ship) - year(contract) AS k FROM c WHERE ship >= contract),
z AS (SELECT CASE WHEN CAST(contract + to_months(CAST(12 * k AS INTEGER)) AS DATE) <= ship THEN k ELSE k - 1 END AS years FROM y)
SELECT CASE WHEN years >= 5 THEN 100 WHEN years >= 2 THEN 50 WHEN years >= 1 THEN 20 ELSE 0 END AS band, count(*) AS n FROM z GROUP BY 1""")
def rule_anniversary_band(spark, sf_dir):
    """The band of completed years from contract to event."""
    band = R.anniversary_band(R.given("contract", "date"), R.Val(F.col("ship"), R.no_causes(), R.none()), [(0, 0), (1, 20), (2, 50), (5, 100)])
    return cases(spark, sf_dir).select(band.value.alias("band"), band.error.alias("e")).where("e is null").groupBy("band").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT l_orderkey, l_returnflag AS class, CAST(round(l_extendedprice * 100) AS BIGINT) AS krw FROM lineitem), m AS (SELECT l_orderkey, class, max(krw) AS top FROM i GROUP BY 1, 2)
SELECT l_orderkey, CAST(sum(top) AS BIGINT) AS total FROM m GROUP BY 1""")
def rule_max_over(spark, sf_dir):
    """Per order the sum over classes of the class's greatest amount."""
    items = read(spark, sf_dir, "lineitem").withColumn("krw", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return R.max_over_rows(items, "l_orderkey", "l_returnflag", "krw")


@query(f"""WITH c AS ({CASES}), w AS (SELECT CASE WHEN ship BETWEEN contract + 1 AND CAST(contract + INTERVAL 3 MONTH AS DATE) THEN 'within' ELSE 'outside' END AS w3, CASE WHEN ship BETWEEN contract AND contract + 29 THEN 'within' ELSE 'outside' END AS w30 FROM c)
SELECT w3, w30, count(*) AS n FROM w GROUP BY ALL""")
def judge_time(spark, sf_dir):
    """Whether the event lies in three calendar months not counting the anchor, and in 30 days counting it."""
    contract = F.col("contract").cast("date")
    say = lambda w: F.when(w["within"], "within").otherwise("outside")
    return cases(spark, sf_dir).select(say(R.time_window(contract, 3, "calendar_month", None, F.col("ship"))).alias("w3"), say(R.time_window(contract, 30, "day", True, F.col("ship"))).alias("w30")).groupBy("w3", "w30").agg(F.count("*").alias("n"))


def versions(spark, sf_dir):
    """Orders as the versions of their customer's record."""
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("version"), F.lag("o_orderkey").over(by).alias("supersedes"), "o_orderstatus")


VERSIONS = "SELECT o_custkey, o_orderkey, row_number() OVER w AS version, lag(o_orderkey) OVER w AS supersedes, o_orderstatus FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"WITH v AS ({VERSIONS}) SELECT o_custkey, o_orderkey, CAST(version AS INTEGER) AS version FROM v QUALIFY version = max(version) OVER (PARTITION BY o_custkey)")
def tip_versions(spark, sf_dir):
    return history.tip_versions(versions(spark, sf_dir), "o_custkey", "version").select("o_custkey", "o_orderkey", "version")


@query(f"WITH v AS ({VERSIONS}) SELECT o_custkey, o_orderkey FROM v WHERE o_orderkey NOT IN (SELECT supersedes FROM v WHERE supersedes IS NOT NULL)")
def current_rows(spark, sf_dir):
    return history.current(versions(spark, sf_dir), "o_orderkey", "supersedes").select("o_custkey", "o_orderkey")


@query(f"""WITH v AS (SELECT * FROM ({VERSIONS}) WHERE o_orderkey % 7 <> 3), s AS (SELECT *, lag(o_orderkey) OVER w AS i, lag(version) OVER w AS p FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY version))
SELECT o_custkey, o_orderkey FROM s WHERE CASE WHEN p IS NULL THEN version <> 1 OR supersedes IS NOT NULL ELSE version <> p + 1 OR supersedes IS DISTINCT FROM i END""")
def correction_chain_breaks(spark, sf_dir):
    """Chains in which every seventh order was lost."""
    return history.chain_breaks(versions(spark, sf_dir).where("o_orderkey % 7 <> 3"), "o_custkey", "version", "o_orderkey", "supersedes").select("o_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def reference_integrity(spark, sf_dir):
    """Customers that no finished order refers back to."""
    return links.orphans(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "c_custkey", "o_custkey").select("c_custkey")


@query("""WITH a AS (SELECT p_partkey AS config, DATE '1993-01-01' + CAST(p_partkey * 13 % 2500 AS INTEGER) AS f, DATE '1993-01-01' + CAST(p_partkey * 13 % 2500 + p_size * 40 AS INTEGER) AS t FROM part),
h AS (SELECT l_orderkey AS request, count(DISTINCT config) AS n, min(config) AS one FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN a ON config = l_partkey WHERE CAST(o_orderdate AS DATE) BETWEEN f AND CASE WHEN config % 5 = 0 THEN DATE '9999-12-31' ELSE t END GROUP BY 1)
SELECT o_orderkey AS request, coalesce(n, 0) AS n_in_force, CASE WHEN n = 1 THEN one END AS config, CASE WHEN n = 1 THEN 'selected' WHEN n > 1 THEN 'multiple_candidates' ELSE 'no_uses_edition' END AS outcome FROM orders LEFT JOIN h ON request = o_orderkey""")
def select_config(spark, sf_dir):
    """Orders as requests on their date; their parts are candidates with a validity of their own, every fifth open-ended."""
    requests = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.to_date("o_orderdate").alias("day"))
    candidates = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_partkey").alias("config"))
    start = F.date_add(F.lit("1993-01-01").cast("date"), (F.col("p_partkey") * 13 % 2500).cast("int"))
    end = F.when(F.col("p_partkey") % 5 != 0, F.date_add(start, (F.col("p_size") * 40).cast("int")))
    return links.select_config(requests, candidates, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("config"), start.alias("valid_from"), end.alias("valid_to")))


CLAIMED = """WITH claim AS (SELECT n_regionkey AS category, CASE WHEN n_nationkey % 4 = 3 THEN 'exclude' ELSE 'include' END AS role, n_nationkey % 11 <> 5 AS accepted, n_nationkey AS s, CASE WHEN n_nationkey % 7 = 6 OR n_nationkey % 25 = 24 THEN (n_regionkey + CASE WHEN n_nationkey % 25 = 24 THEN 4 ELSE 1 END) % 5 END AS inner_ FROM nation),
 rng AS (SELECT n_nationkey AS s, n_nationkey % 26 AS l0, n_nationkey * 3 % 60 AS m0, least(25, n_nationkey % 26 + n_regionkey % 3) AS l1, n_nationkey * 3 % 60 + 30 AS m1 FROM nation),
 code AS (SELECT DISTINCT chr(CAST(65 + p_partkey % 26 AS INT)) || lpad(CAST(p_size AS VARCHAR), 2, '0') AS code, p_partkey % 26 AS l, p_size AS m FROM part),
 hit AS (SELECT s, code FROM code JOIN rng ON (l, m) >= (l0, m0) AND (l, m) <= (l1, m1)),
 p0 AS (SELECT list_value(r_regionkey) AS path, r_regionkey AS node FROM region)"""


def _unfold(depth: int) -> str:
    """The levels of paths downwards and their answers upwards, written out as deep as there are categories."""
    down = "".join(f""",
 p{d} AS (SELECT list_append(path, inner_) AS path, inner_ AS node FROM p{d - 1} JOIN claim ON category = node WHERE accepted AND inner_ IS NOT NULL AND NOT list_contains(path, inner_))""" for d in range(1, depth))
    up = ""
    for d in range(depth - 1, -1, -1):
        child = f"(SELECT w.v FROM w{d + 1} w WHERE w.path = list_append(p.path, c.inner_) AND w.code = k.code)" if d < depth - 1 else "NULL"
        up += f""",
 t{d} AS (SELECT p.path, k.code, c.role, CASE WHEN NOT c.accepted THEN NULL WHEN c.inner_ IS NULL THEN EXISTS (SELECT 1 FROM hit h WHERE h.s = c.s AND h.code = k.code) WHEN list_contains(p.path, c.inner_) THEN NULL ELSE {child} END AS v, c.accepted FROM p{d} p CROSS JOIN code k LEFT JOIN claim c ON c.category = p.node),
 w{d} AS (SELECT path, code, CASE WHEN count(*) FILTER (role = 'include') = 0 THEN NULL WHEN coalesce(bool_or(role = 'exclude' AND v), FALSE) THEN FALSE WHEN bool_or(v IS NULL) THEN NULL ELSE bool_or(role = 'include' AND v) END AS v FROM t{d} GROUP BY 1, 2)"""
    return down + up


@query(f"{CLAIMED}{_unfold(5)} SELECT code, path[1] AS category, CASE v WHEN TRUE THEN 'true' WHEN FALSE THEN 'false' ELSE 'unknown' END AS answer FROM w0")
def membership(spark, sf_dir):
    """Which regions' categories hold a code: nations are claims on ranges across letters, or on another region's category, some in circles."""
    return links.membership(*categories(spark, sf_dir)).select("code", F.substring("category", 5, 9).cast("int").alias("category"), "answer")


def categories(spark, sf_dir):
    """(codes, asked, claims, ranges) of regions as categories."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    nation = read(spark, sf_dir, "nation")
    name = lambda kind, i: F.concat(F.lit(kind), i.cast("string"))
    other = F.when(k % 25 == 24, (r + 4) % 5).when(k % 7 == 6, (r + 1) % 5)
    claims = nation.select(name("cat:", r).alias("category"), F.when(k % 4 == 3, "exclude").otherwise("include").alias("role"), F.coalesce(name("cat:", other), name("set:", k)).alias("target"), (k % 11 != 5).alias("accepted"))
    ranges = nation.select(name("set:", k).alias("target"), F.char(65 + k % 26).alias("lo_letter"), (k * 3 % 60).alias("lo_major"), F.char(F.least(F.lit(90), 65 + k % 26 + r % 3)).alias("hi_letter"), (k * 3 % 60 + 30).alias("hi_major"))
    codes = read(spark, sf_dir, "part").select(F.char(65 + F.col("p_partkey") % 26).alias("letter"), F.col("p_size").alias("major")).distinct().withColumn("code", F.concat("letter", F.lpad(F.col("major").cast("string"), 2, "0")))
    asked = read(spark, sf_dir, "region").select(name("cat:", F.col("r_regionkey")).alias("category"))
    return codes, asked, claims, ranges


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey // 3 AS dst FROM supplier WHERE s_suppkey > 0),
t AS (SELECT src AS root, src AS node, 0 AS depth FROM e UNION SELECT 0, 0, 0 UNION SELECT root, dst, depth + 1 FROM t JOIN e ON node = src) SELECT root, node, depth FROM t""")
def category_closure(spark, sf_dir):
    """All ancestors of every supplier in a tree of three branches."""
    edges = read(spark, sf_dir, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("src"), F.expr("s_suppkey div 3").alias("dst"))
    return graph.closure(edges)


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS src, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS dst FROM supplier WHERE s_suppkey % 5 <> 0),
t AS (SELECT src AS root, dst AS node FROM e UNION SELECT root, dst FROM t JOIN e ON node = src) SELECT root AS node FROM t WHERE root = node""")
def scope_cycles(spark, sf_dir):
    """Suppliers on a cycle of a graph with one edge each."""
    s = read(spark, sf_dir, "supplier")
    n = s.agg(F.count("*").alias("n"))
    edges = s.where("s_suppkey % 5 <> 0").join(F.broadcast(n)).select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + 3) % F.col("n")).alias("dst"))
    return graph.on_cycles(edges)


DOC = "sha256(coalesce(text, chr(0)) || '|' || coalesce(lang, chr(0)))"


def doc_hash():
    return F.sha2(F.concat(F.coalesce("text", F.lit("\x00")), F.lit("|"), F.coalesce("lang", F.lit("\x00"))), 256)


@query("""WITH e AS (SELECT source, doc_id, sha256(coalesce(text, chr(0)) || '|' || coalesce(lang, chr(0))) AS d FROM documents)
SELECT source, count(*) AS members, min(d) AS least, max(d) AS most FROM e GROUP BY 1""")
def release_members(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("source", doc_hash().alias("d")).groupBy("source").agg(F.count("*").alias("members"), F.min("d").alias("least"), F.max("d").alias("most"))


@query("""WITH e AS (SELECT source, doc_id::VARCHAR AS i, sha256(coalesce(text, chr(0)) || '|' || coalesce(lang, chr(0))) AS d FROM documents), b AS (SELECT source, substr(sha256(i), 1, 2) AS b, count(*) AS n, sha256(string_agg(i || chr(31) || d, chr(30) ORDER BY i || chr(31) || d)) AS h FROM e GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS members, sha256(string_agg(b || h, chr(30) ORDER BY b)) AS content_sha256 FROM b GROUP BY 1""")
def release_freeze(spark, sf_dir):
    """A content hash for every source as a release of its documents."""
    return links.freeze(read(spark, sf_dir, "documents"), "source", "doc_id", doc_hash())


def snapshots(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", doc_hash().alias("digest"))
    return d.where("doc_id % 10 <> 0"), d.where("doc_id % 7 <> 0").withColumn("digest", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("x"), "digest")).otherwise(F.col("digest")))


SNAPS = f"WITH d AS (SELECT doc_id, {DOC} AS digest FROM documents), a AS (SELECT * FROM d WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'x' || digest ELSE digest END AS digest FROM d WHERE doc_id % 7 <> 0)"


@query(SNAPS + " SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'corrected' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.digest IS DISTINCT FROM b.digest")
def release_diff(spark, sf_dir):
    return links.diff(*snapshots(spark, sf_dir), "doc_id", "digest")


@query(SNAPS + " SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'extra' WHEN b.doc_id IS NULL THEN 'missing' WHEN a.digest = b.digest THEN 'byte_identical' ELSE 'hash_mismatch' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def verify_copy(spark, sf_dir):
    return links.verify_copy(*snapshots(spark, sf_dir), "doc_id", "digest")


@query("""WITH n AS (SELECT 'note-' || p_brand AS notice, p_partkey AS c FROM part WHERE p_size % 9 = 0), h AS (SELECT l_orderkey AS request, list_sort(list(DISTINCT notice)) AS notices FROM lineitem JOIN n ON c = l_partkey GROUP BY 1)
SELECT o_orderkey AS request, array_to_string(notices, ',') AS notices, notices IS NULL AS allowed FROM orders LEFT JOIN h ON request = o_orderkey""")
def service_allowed(spark, sf_dir):
    """Orders whose parts are named by an open notice of their brand."""
    notices = read(spark, sf_dir, "part").where("p_size % 9 = 0").groupBy("p_brand").agg(F.collect_list("p_partkey").alias("affects")).select(F.concat(F.lit("note-"), "p_brand").alias("notice"), "affects", F.lit(True).alias("open"))
    asked = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_partkey").alias("coverage"))
    requests = asked.unionByName(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.lit(None).cast("bigint").alias("coverage")))
    done = links.notices_for(requests, notices)
    return done.select("request", F.array_join("notices", ",").alias("notices"), "allowed").distinct()


def observations(spark, sf_dir):
    """Events as fetches of (user, event type): every fourth fails, every ninth is not modified."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("int")).when(F.col("event_id") % 9 == 0, 304).otherwise(200)
    return e.select("event_id", "ts", "user_id", "event_type", status.alias("status"), (F.floor("value") % 5).cast("string").alias("digest"))


OBS = "SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 304 ELSE 200 END AS status, CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR) AS digest FROM events"


@query(f"""WITH o AS ({OBS}), b AS (SELECT *, last_value(CASE WHEN status = 200 THEN digest END IGNORE NULLS) OVER w AS p, last_value(CASE WHEN status = 200 THEN event_id % 3 <> 1 END IGNORE NULLS) OVER w AS kept FROM o WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN status = 304 AND p IS NOT NULL AND kept THEN 'unchanged' WHEN status IS NULL OR status <> 200 THEN 'invalid' WHEN p IS NULL THEN 'new' WHEN p = digest THEN 'unchanged_same_hash' ELSE 'changed' END AS decision FROM b""")
def change_decisions(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("retained", F.col("event_id") % 3 != 1)
    return history.change_decisions(obs, ["user_id", "event_type"], ["ts", "event_id"], "status", "digest", "retained").select("event_id", "decision")


FAILS = f"""WITH o AS (SELECT *, event_type IN ('error', 'signup', 'view') AS f FROM ({OBS})), i AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM o),
r AS (SELECT event_id, f, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS failures FROM i)"""


@query(FAILS + " SELECT event_id, failures FROM r")
def consecutive_failures(spark, sf_dir):
    return history.failure_runs(observations(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "signup", "view")).select("event_id", "failures")


@query(FAILS + " SELECT event_id FROM r WHERE f AND failures = 3")
def third_failure_alerts(spark, sf_dir):
    return history.failure_runs(observations(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "signup", "view")).where("alert").select("event_id")


STATE = f"SELECT user_id, event_type, arg_max(digest, event_id) FILTER (status = 200) AS digest, max(event_id) FILTER (status IN (200, 304)) AS verified, max(event_id) AS seen FROM ({OBS}) GROUP BY 1, 2"


@query(STATE)
def crawl_state(spark, sf_dir):
    return history.crawl_state(observations(spark, sf_dir), ["user_id", "event_type"], F.col("event_id"), "status", "digest")


@query(STATE)
def crawl_state_stream(spark, sf_dir):
    """The same state kept by a streaming aggregate over events that come in three batches."""
    obs = observations(spark, sf_dir).withColumn("status", F.coalesce("status", F.lit(0)))
    out = streams.replay(obs, F.col("event_id"), lambda rows: streams.state_updates(rows, ["user_id", "event_type"], "event_id"), "update")
    return streams.latest(spark, out, ["user_id", "event_type"])


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS used FROM events GROUP BY 1, 2")
def usage_stream(spark, sf_dir):
    """Daily totals per user kept by a windowed stream."""
    job = lambda rows: streams.daily(rows, ["user_id"], "ts", F.round(F.col("value") * 100).cast("bigint"))
    return streams.latest(spark, streams.replay(read(spark, sf_dir, "events"), F.unix_micros(F.col("ts").cast("timestamp")), job, "update"), ["user_id", "day"])


@query("SELECT user_id, max(ts) FILTER (event_type <> 'error') AS last_success, max(ts) FILTER (event_type = 'error') AS last_failure, count(*) AS n FROM events GROUP BY 1")
def source_status(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(~bad, F.col("ts"))).alias("last_success"), F.max(F.when(bad, F.col("ts"))).alias("last_failure"), F.count("*").alias("n"))


DIMS = ["up", "down"]
LEDGER = "SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'reservation' WHEN event_id % 3 = 1 THEN 'settlement' ELSE 'pre_ledger_usage' END AS kind, CASE WHEN event_id % 3 = 1 AND event_id % 5 <> 0 THEN event_id - 1 END AS reservation_seq, CASE WHEN event_id % 3 = 1 AND event_id % 7 <> 0 THEN event_id - 1 ELSE event_id END AS run, CAST(round(value * 100) AS BIGINT) AS up, event_id % 50 AS down, user_id, CAST(ts AS DATE) AS day FROM events"


def ledger(spark, sf_dir):
    """Events as ledger records in threes: a reservation, usually its settlement, at times by another run, and usage from before the ledger."""
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(i.alias("seq"), F.when(i % 3 == 0, "reservation").when(i % 3 == 1, "settlement").otherwise("pre_ledger_usage").alias("kind"), F.when((i % 3 == 1) & (i % 5 != 0), i - 1).alias("reservation_seq"), F.when((i % 3 == 1) & (i % 7 != 0), i - 1).otherwise(i).alias("run"), F.round(F.col("value") * 100).cast("bigint").alias("up"), (i % 50).alias("down"), "user_id", F.to_date("ts").alias("day"))


def _usage(admissions: str = "") -> str:
    return f"""WITH l AS ({LEDGER}), s AS (SELECT reservation_seq AS seq, run, max(up) AS u, max(down) AS d FROM l WHERE kind = 'settlement' GROUP BY 1, 2),
    x AS (SELECT user_id, day, least(up, coalesce(u, up)) AS up, least(down, coalesce(d, down)) AS down, CASE WHEN u IS NULL THEN 1 ELSE 0 END AS open, 1 AS n FROM l LEFT JOIN s USING (seq, run) WHERE kind = 'reservation' UNION ALL SELECT user_id, day, up, down, 0, 1 FROM l WHERE kind = 'pre_ledger_usage' {admissions})
    SELECT user_id, day, CAST(sum(up) AS BIGINT) AS up, CAST(sum(down) AS BIGINT) AS down, CAST(sum(n) AS BIGINT) AS n, CAST(sum(open) AS BIGINT) AS open FROM x GROUP BY 1, 2"""


@query(_usage("UNION ALL SELECT user_id, day, 700, 9, 0, 0 FROM l WHERE seq % 4 = 0 AND seq NOT IN (SELECT run FROM l WHERE kind = 'settlement')"))
def usage_totals(spark, sf_dir):
    """Per user and day in two dimensions; every fourth record's run was admitted, and counts at the limits if it settled nothing."""
    rows = ledger(spark, sf_dir)
    admitted = rows.where("seq % 4 = 0").select(F.col("seq").alias("run"), "user_id", "day")
    return usage.usage(rows, ["user_id", "day"], DIMS, admitted, {"up": 700, "down": 9})


@query(_usage())
def usage_checkpoint(spark, sf_dir):
    """A checkpoint of the older half of the ledger, resumed with the newer; reservations that were open are settled after it."""
    rows, by = ledger(spark, sf_dir), ["user_id", "day"]
    half = F.col("seq") % 6 < 4  # some settlements come later than their reservations' checkpoint
    totals, opened = usage.checkpoint(rows.where(half & ((F.col("kind") != "settlement") | (F.col("seq") % 4 < 2))), by, DIMS)
    late = rows.where(~(half & ((F.col("kind") != "settlement") | (F.col("seq") % 4 < 2))))
    return usage.resume(totals, opened, late, by, DIMS)


@query("""WITH c AS (SELECT event_id, user_id, coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT event_id, CAST(before AS BIGINT) AS spent_before, before >= 5000 AS cap_reached FROM c""")
def cap_before_call(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("cost", F.round(F.col("value") * 100).cast("bigint"))
    return history.running_before(e, ["user_id", "day"], ["ts", "event_id"], "cost", "spent_before").select("event_id", F.col("spent_before").cast("bigint").alias("spent_before"), (F.col("spent_before") >= 5000).alias("cap_reached"))


@query("""WITH a AS (SELECT event_id, user_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 10007, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT event_id FROM a WHERE ts <= before""")
def out_of_order(spark, sf_dir):
    """Events that arrive, in a shuffled order, after a later one of their user."""
    e = read(spark, sf_dir, "events").withColumn("arrived", F.struct(F.col("event_id") * 7919 % 10007, F.col("event_id")))
    return history.out_of_order(e, ["user_id"], "arrived", "ts").select("event_id")


@query("SELECT l_returnflag AS layer, l_linestatus AS org, count(*) FILTER (l_discount > 0.03) AS acquired, count(*) AS denominator FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def coverage_layers(spark, sf_dir):
    """Counts per layer and organisation and per layer, never averaged ratios."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupingSets([[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")]], F.col("l_returnflag"), F.col("l_linestatus")).agg(F.count(F.when(F.col("l_discount") > 0.03, 1)).alias("acquired"), F.count("*").alias("denominator")).withColumnsRenamed({"l_returnflag": "layer", "l_linestatus": "org"})


@query("""SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CAST(round(p_retailprice * 100) AS BIGINT), p_partkey) AS INTEGER) AS place, NULL AS reason FROM part WHERE p_size % 4 <> 0
UNION ALL SELECT p_partkey, p_brand, NULL, 'not_comparable' FROM part WHERE p_size % 4 = 0""")
def price_order(spark, sf_dir):
    """Prices in order within one comparison basis; rows that cannot be compared stay, with a reason."""
    from pyspark.sql import Window

    p = read(spark, sf_dir, "part")
    ok = F.col("p_size") % 4 != 0
    placed = p.where(ok).withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.round(F.col("p_retailprice") * 100).cast("bigint"), "p_partkey")))
    return placed.select("p_partkey", "p_brand", "place", F.lit(None).cast("string").alias("reason")).union(p.where(~ok).select("p_partkey", "p_brand", F.lit(None).cast("int"), F.lit("not_comparable")))


@query("""WITH k AS (SELECT event_id, event_type, unnest(json_keys(props)) AS f FROM events)
SELECT event_id, string_agg(v, ',' ORDER BY v) AS violations FROM (
 SELECT event_id, 'unknown_event' AS v FROM events WHERE event_type = 'signup' UNION ALL
 SELECT event_id, 'not_allowed:' || f FROM k WHERE event_type = 'error' UNION ALL
 SELECT event_id, 'missing:price' FROM events WHERE event_type = 'purchase') GROUP BY 1""")
def check_events(spark, sf_dir):
    """Event fields against an allow list that lacks signups, forbids k in errors and asks purchases for a price."""
    allowed = spark.createDataFrame([("view", "k", True), ("click", "k", False), ("purchase", "k", False), ("purchase", "price", True), ("error", "code", False)], "kind string, field string, required boolean")
    e = read(spark, sf_dir, "events").withColumn("fields", F.from_json("props", "map<string,string>"))
    return checks.check_events(e, allowed).where("size(violations) > 0").select("event_id", F.array_join("violations", ",").alias("violations"))


@query("""WITH v AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ',balance' ELSE '' END || CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$') THEN ',name' ELSE '' END || CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN ',segment' ELSE '' END AS v FROM customer)
SELECT c_custkey, substr(v, 2) AS violations FROM v WHERE v <> ''""")
def table_constraints(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    found = checks.violations(balance=F.col("c_acctbal") >= 0, name=F.col("c_name").rlike(r"\ACustomer#[0-9]*[02468]\z"), segment=F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.select("c_custkey", F.array_join(found, ",").alias("violations")).where("violations <> ''")


@query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(^|[^a-z0-9_])(contract|person|upload|del|consent|assume):', 'i') UNION ALL SELECT doc_id, NULL FROM documents WHERE regexp_matches(text, '(^|[^a-z0-9_])(contract|person|upload|del|consent|assume):', 'i')")
def private_id_scan(spark, sf_dir):
    """Turns and documents that hold a private id."""
    t = read(spark, sf_dir, "conversations").where(X.has_private_id(F.col("text"))).select("conv_id", "turn")
    return t.union(read(spark, sf_dir, "documents").where(X.has_private_id(F.col("text"))).select("doc_id", F.lit(None).cast("bigint")))


@query("SELECT conv_id, turn, NULL::BIGINT AS doc_id FROM conversations WHERE regexp_matches(text, '(^|[^a-z0-9_])(contract|person|upload|del|consent|assume):', 'i') UNION ALL SELECT NULL, NULL, doc_id FROM documents WHERE regexp_matches(text, '(^|[^a-z0-9_])(contract|person|upload|del|consent|assume):', 'i')")
def private_id_scan_all(spark, sf_dir):
    """Every turn and every document whose own text holds a private id."""
    none = F.lit(None).cast("bigint")
    t = read(spark, sf_dir, "conversations").where(X.has_private_id(F.col("text"))).select("conv_id", "turn", none.alias("doc_id"))
    d = read(spark, sf_dir, "documents").where(X.has_private_id(F.col("text")))
    return t.union(d.select(none, none, "doc_id"))


@query("""WITH p AS (SELECT page_id, split_part(url, '#', 1) AS u, CASE WHEN contains(url, '#') THEN '#' || regexp_extract(url, '#(.*)$', 1) ELSE '' END AS f FROM pages),
q AS (SELECT page_id, f, split_part(u, '?', 1) AS b, list_filter(string_split(CASE WHEN contains(u, '?') THEN substr(u, strpos(u, '?') + 1) || '&' ELSE '' END || 'sid=7&PHPSESSID=x&a=b%20c&' || CASE WHEN page_id % 2 = 0 THEN '_t=1' ELSE 'JSessionId=2' END, '&'), lambda x: x <> '') AS k FROM p),
r AS (SELECT page_id, f, b, list_transform(list_filter(k, lambda x: lower(split_part(x, '=', 1)) NOT IN ('jsessionid', 'sessionid', 'phpsessid')), lambda x: replace(x, '%20', '+')) AS k FROM q)
SELECT page_id, b || '?' || array_to_string(k, '&') || f AS url FROM r""")
def clean_links(spark, sf_dir):
    """Every page's URL with session parameters written in; sid and _t are none on these hosts and stay, as does the fragment."""
    u = F.col("url")
    base, mark = F.regexp_extract(u, r"(?s)\A([^#]*)", 1), F.regexp_extract(u, r"(?s)(#.*)\z", 1)
    more = F.concat(F.lit("sid=7&PHPSESSID=x&a=b%20c&"), F.when(F.col("page_id") % 2 == 0, "_t=1").otherwise("JSessionId=2"))
    full = F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), more, mark)
    return read(spark, sf_dir, "pages").select("page_id", X.clean_link(full).alias("url"))


@query("WITH d AS (SELECT sha256(text) AS h, doc_id FROM documents WHERE text IS NOT NULL) SELECT h AS digest, count(*) AS n, min(doc_id) AS first_id FROM d GROUP BY 1 HAVING count(*) > 1")
def duplicate_rows(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN b.n < a.n THEN 'reduced' WHEN b.n > a.n THEN 'increased' ELSE 'unchanged' END AS item FROM a FULL JOIN b ON a.k = b.k""")
def plan_diff(spark, sf_dir):
    """The current and the proposed items side by side; losses always show."""
    o = read(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n)) for s, n in (("F", "a"), ("O", "b")))
    item = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("b") < F.col("a"), "reduced").when(F.col("b") > F.col("a"), "increased").otherwise("unchanged")
    return a.join(b, "k", "full_outer").select("k", item.alias("item"))


@query("""WITH c AS (SELECT o_orderkey, o_orderstatus = 'F' AS linked, count(DISTINCT l_suppkey) AS e, bool_or(l_discount > 0.08) AS d, max(l_quantity) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN e = 0 THEN 'no_uses_edition' WHEN e > 6 THEN 'competing_editions' WHEN NOT linked THEN 'link_unapproved' WHEN d THEN 'edition_identity_unconfirmed' WHEN q < 20 THEN 'no_rule' ELSE 'linked' END AS outcome FROM c""")
def resolve_chain(spark, sf_dir):
    """Requests that are linked, or the first of the ordered reasons why not, whatever the order of their rows."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("e"), F.bool_or(F.col("l_discount") > 0.08).alias("d"), F.max("l_quantity").alias("q"))
    c = read(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    why = links.first_reason(("no_uses_edition", F.col("e").isNull()), ("competing_editions", F.col("e") > 6), ("link_unapproved", F.col("o_orderstatus") != "F"), ("edition_identity_unconfirmed", F.col("d")), ("no_rule", F.col("q") < 20))
    return c.select("o_orderkey", why.alias("outcome"))


@query("""WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS found FROM orders GROUP BY 1), e AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS stated FROM customer)
SELECT c_custkey, stated, found FROM e LEFT JOIN l ON o_custkey = c_custkey WHERE stated IS DISTINCT FROM found""")
def latest_access_mismatches(spark, sf_dir):
    """Customers whose stated status is not that of their latest order."""
    k = F.col("c_custkey")
    stated = F.when(k % 3 == 0, "F").when(k % 3 == 1, "O").otherwise("P")
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("found"))
    return registry.latest_access_mismatches(read(spark, sf_dir, "customer").select(k, stated.alias("stated")), log, "c_custkey", ["o_orderdate", "o_orderkey"], "stated", "found")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey)")
def source_without_observation(spark, sf_dir):
    """Part and supplier pairs of a register that no line item backs."""
    n = read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    pairs = read(spark, sf_dir, "part").join(F.broadcast(n)).select("p_partkey", (F.col("p_partkey") % F.col("n")).alias("s_suppkey"))
    real = pairs.join(read(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", "left_semi")
    log = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    return registry.without_observation(real, log, ["p_partkey", "s_suppkey"]).select("p_partkey", "s_suppkey")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS times, bool_or(o_orderpriority = '1-URGENT') AS x FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 1)
SELECT coalesce(a.k, r.k) AS k, coalesce(times, 0) AS times, CASE WHEN a.k IS NULL THEN 'unlisted' WHEN x THEN 'excluded' WHEN times > 1 THEN 'duplicate' WHEN r.k IS NOT NULL THEN 'matched' ELSE 'missing' END AS outcome FROM a FULL JOIN r ON a.k = r.k""")
def authority_crosscheck(spark, sf_dir):
    """Customers listed by their orders against a register that lacks every fourth."""
    listed = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    return registry.crosscheck(listed, read(spark, sf_dir, "customer").where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("k")), "k", F.col("o_orderpriority") == "1-URGENT")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS times, bool_or(o_orderpriority = '1-URGENT') AS x FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 1)
SELECT coalesce(a.k, r.k) AS k, coalesce(times, 0) AS times, CASE WHEN a.k IS NULL THEN 'unlisted' WHEN x THEN 'excluded' WHEN times > 1 THEN 'duplicate' WHEN r.k IS NOT NULL THEN 'matched' ELSE 'missing' END AS outcome FROM a FULL JOIN r ON a.k = r.k""")
def authority_crosscheck_all(spark, sf_dir):
    """Customers listed by all their orders against the same register."""
    listed = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    return registry.crosscheck(listed, read(spark, sf_dir, "customer").where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("k")), "k", F.col("o_orderpriority") == "1-URGENT")


@query("""WITH u AS (SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS used FROM events GROUP BY 1), c AS (SELECT u.*, CASE WHEN user_id % 6 = 5 THEN 0 ELSE 20000 + user_id * 300 END AS cap FROM u)
SELECT user_id, used, CAST(cap - used AS BIGINT) AS headroom, used > cap AS over, used * 5 >= cap * 4 AS near FROM c""")
def headroom(spark, sf_dir):
    """What every user has left of a cap of their own; every sixth has no cap."""
    e = read(spark, sf_dir, "events")
    used = e.groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("used"))
    caps = e.select("user_id").distinct().where("user_id % 6 <> 5").withColumn("cap", 20000 + F.col("user_id") * 300)
    return registry.headroom(used, caps, "user_id")


@query("""SELECT date_trunc('month', ts)::DATE AS month, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cost, count(*) FILTER (event_type = 'error') AS failed, count(*) AS calls, sum(CAST(round(value * 100) AS BIGINT)) >= 1000000 AS cap_reached FROM events GROUP BY 1""")
def call_cost(spark, sf_dir):
    """Cost, failures and calls by month, and whether the month's cap is reached."""
    cost = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    rows = read(spark, sf_dir, "events").groupBy(F.trunc("ts", "month").alias("month"))
    return rows.agg(cost.alias("cost"), F.count(F.when(F.col("event_type") == "error", 1)).alias("failed"), F.count("*").alias("calls"), (cost >= 1000000).alias("cap_reached"))


@query("""WITH h AS (SELECT user_id, event_id, sha256(event_id::VARCHAR || event_type) AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events), g AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE lag(d) OVER (PARTITION BY user_id ORDER BY seq) END AS prev FROM h),
k AS (SELECT * FROM g WHERE event_id % 17 <> 0), l AS (SELECT *, lag(seq) OVER w AS ls, lag(d) OVER w AS ld FROM k WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT event_id, CASE WHEN ls IS NOT NULL AND seq <> ls + 1 THEN 'sequence_gap' ELSE 'hash_differs' END AS reason FROM l WHERE (ls IS NOT NULL AND seq <> ls + 1) OR prev IS DISTINCT FROM ld""")
def ledger_chain_breaks(spark, sf_dir):
    """A hash chain of each user's events in which every 13th was altered and every 17th lost."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.sha2(F.concat(F.col("event_id").cast("string"), "event_type"), 256).alias("d"), F.row_number().over(by).alias("seq"))
    rows = rows.withColumn("prev", F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.lag("d").over(by))).where("event_id % 17 <> 0")
    return registry.chain_breaks(rows, ["user_id"], "seq", "d", "prev").select("event_id", "reason")


@query("SELECT o_orderkey // 10 AS target, array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') AS successors FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 1")
def supersedes_forks(spark, sf_dir):
    """Targets superseded by several orders."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderkey div 10").alias("target"))
    return registry.forks(rows, "target", "o_orderkey").select("target", F.array_join(F.col("successors").cast("array<string>"), ",").alias("successors"))


@query("SELECT o_orderkey // 10 AS target, array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') AS successors FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 1")
def supersedes_forks_all(spark, sf_dir):
    """Targets superseded by several of all orders."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderkey div 10").alias("target"))
    return registry.forks(rows, "target", "o_orderkey").select("target", F.array_join(F.col("successors").cast("array<string>"), ",").alias("successors"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN (SELECT DISTINCT upper(p) FROM (SELECT unnest(['building', 'machinery', 'household']) AS p))")
def vocabulary_check(spark, sf_dir):
    """Customers of a segment that the code table lacks."""
    codes = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("HOUSEHOLD",)], "code string")
    return registry.outside_vocabulary(read(spark, sf_dir, "customer"), "c_mktsegment", codes, "code").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, sf_dir):
    """The fifty orders after a cursor."""
    return registry.page_after(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 50)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity <> 7 AND l_linenumber NOT IN (3, 5) AND CAST(round(l_extendedprice) AS BIGINT) < 1000 OR l_quantity <> 7 AND l_linenumber NOT IN (3, 5, 6) AS stated FROM lineitem")
def amount_in_passage(spark, sf_dir):
    """Prices against passages that give them whole, another price, with a further digit, before a full stop, or without separators."""
    n = F.round("l_extendedprice").cast("bigint")
    said = F.when(F.col("l_quantity") == 7, F.format_number(n + 1, 0)).when(F.col("l_linenumber") == 3, F.concat(F.format_number(n, 0), F.lit("5"))).when(F.col("l_linenumber") == 5, F.concat(F.format_number(n, 0), F.lit("."))).when(F.col("l_linenumber") == 6, n.cast("string")).otherwise(F.concat(F.format_number(n, 0), F.lit("won")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", registry.has_amount(F.concat(F.lit("costs "), said, F.lit(" a month")), n).alias("stated"))


@query("SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 4")
def affected_conclusions(spark, sf_dir):
    """Orders that rest on a changed part."""
    orders = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return registry.dependents(read(spark, sf_dir, "part").where("p_size < 4"), orders, "p_partkey", "parts")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')")
def release_view(spark, sf_dir):
    """The customers that a release, its members kept in arrays, lists."""
    manifest = read(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").groupBy((F.col("o_orderkey") % 64).alias("part")).agg(F.collect_set("o_custkey").alias("members"))
    return registry.release_view(read(spark, sf_dir, "customer"), manifest, "c_custkey", "members").select("c_custkey", "c_name")


@query(f"""WITH m AS ({_SQL["membership"]}),
p AS (SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey),
s AS (SELECT p.a, p.b, bool_or(x.answer = 'unknown' OR y.answer = 'unknown') AS u, count(*) FILTER (x.answer = 'true' AND y.answer = 'true') AS both_in, count(*) FILTER (x.answer = 'true' AND y.answer <> 'true') AS only_a, count(*) FILTER (y.answer = 'true' AND x.answer <> 'true') AS only_b
 FROM p JOIN m x ON x.category = p.a JOIN m y ON y.category = p.b AND y.code = x.code GROUP BY 1, 2)
SELECT p.a, p.b, CASE WHEN coalesce(u, true) THEN 'not_comparable' WHEN only_a = 0 AND only_b = 0 THEN 'same_scope' WHEN only_a = 0 THEN 'narrower' WHEN only_b = 0 THEN 'broader' WHEN both_in > 0 THEN 'overlaps' ELSE 'disjoint' END AS relation FROM p LEFT JOIN s USING (a, b)""")
def scope_relation(spark, sf_dir):
    """How the code sets of every two regions lie to each other, over all codes in use."""
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("a"))
    pairs = r.join(r.withColumnRenamed("a", "b"), F.col("a") != F.col("b"))
    codes, asked, claims, ranges = categories(spark, sf_dir)
    named = pairs.select(*[F.concat(F.lit("cat:"), F.col(c).cast("string")).alias(c) for c in ("a", "b")])
    found = links.scope_relations(named, codes, *links.answers(codes, asked, claims, ranges))
    return found.select(*[F.substring(c, 5, 9).cast("int").alias(c) for c in ("a", "b")], "relation")


@query("""WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderpriority AS reason FROM orders), a AS (SELECT o_custkey, arg_max(o_orderkey, version) AS before FROM v WHERE version < 4 AND o_custkey % 9 <> 1 GROUP BY 1), b AS (SELECT o_custkey, arg_max(o_orderkey, version) AS after FROM v WHERE o_custkey % 7 <> 2 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'corrected' END AS change, before, after, CASE WHEN before <> after THEN (SELECT any_value(reason) FROM v WHERE o_orderkey = after) END AS reason FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE before IS DISTINCT FROM after""")
def release_changes(spark, sf_dir):
    """Two releases of customers' versions, with the ids before and after and the reason of a correction."""
    v = versions(spark, sf_dir)
    tip = lambda rows: history.tip_versions(rows, "o_custkey", "version")
    reasons = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("reason"))
    return links.release_changes(tip(v.where("version < 4 AND o_custkey % 9 <> 1")), tip(v.where("o_custkey % 7 <> 2")), "o_custkey", "o_orderkey", reasons)


@query(f"SELECT status, count(*) AS n FROM ({_SQL['verify_copy']}) GROUP BY 1")
def verify_counts(spark, sf_dir):
    return links.status_counts(verify_copy(spark, sf_dir))


@query(f"""WITH o AS ({OBS}), a AS (SELECT DISTINCT user_id, t.event_type FROM events CROSS JOIN (SELECT DISTINCT event_type FROM events) t),
s AS (SELECT user_id, event_type, bool_or(status = 200) AS stored, max(ts) FILTER (status IN (200, 304)) AS verified FROM o GROUP BY 1, 2), n AS (SELECT max(ts) AS now FROM events)
SELECT a.user_id, a.event_type, NOT coalesce(stored, false) OR a.user_id % 11 = 5 OR verified IS NULL OR epoch_us(now) - epoch_us(verified) >= 864000000000 AS due FROM a LEFT JOIN s USING (user_id, event_type), n""")
def full_check_due(spark, sf_dir):
    """Which (user, event type) must be fetched whole again, ten days after the last verification at the latest."""
    e = read(spark, sf_dir, "events")
    # the kinds of events are a handful, so every user meets them through one array
    kinds = e.agg(F.collect_set("event_type").alias("kinds"), F.max("ts").cast("timestamp").alias("now"))
    asked = e.select("user_id").distinct().join(F.broadcast(kinds)).select("user_id", F.explode("kinds").alias("event_type"), "now")
    obs = observations(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    state = history.crawl_state(obs, ["user_id", "event_type"], F.col("ts"), "status", "digest").withColumn("retained", F.col("user_id") % 11 != 5)
    return history.full_check_due(asked, state, ["user_id", "event_type"], F.col("now"), 864_000)


@query(f"SELECT user_id, count(*) AS total, count(*) FILTER (event_id % 3 <> 0) AS new FROM ({OBS}) WHERE status IS NULL GROUP BY 1")
def gap_summary(spark, sf_dir):
    """Gaps of every user, and those since the counts last published, which held every third."""
    gaps = observations(spark, sf_dir).where("status IS NULL")
    return history.gap_summary(gaps, gaps.where("event_id % 3 = 0").groupBy("user_id").count(), "user_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_payout(spark, sf_dir)


# further queries, which register themselves
from lodestone.plans import knowledge, rows, runs, stores, texts  # noqa: E402, F401
