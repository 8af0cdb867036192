"""Queries that run whole jobs: streams over event files, evaluated requests, page and document jobs, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.catalog import _SQL, CASES, DIMS, OBS, _usage, cases, ledger, observations, query, read
from lodestone.functions import rules as R
from lodestone.operators import evaluation, graph, history, jobs, pages, releases, sketches, usage
from lodestone.operators.knowledge import latest_assumptions
from lodestone.plans import knowledge as K
from lodestone.streaming import streams


def watched(spark, sf_dir):
    """Events as observations; failures have status 0."""
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.when(i % 4 == 0, 0).when(i % 9 == 0, 304).otherwise(200).alias("status"), (F.floor("value") % 5).cast("string").alias("digest"), (i % 3 != 1).alias("retained"), F.col("event_type").isin("error", "signup", "view").alias("failed"))


def came(spark, rows, job, mode="append", parts=3, order=None):
    """The output of a job over rows that come in batches in the order of their instants."""
    out = streams.replay(rows, order if order is not None else F.unix_micros(F.col("ts").cast("timestamp")), job, mode, parts)
    return spark.read.parquet(out).drop("batch")


@query(_SQL["change_decisions"])
def change_stream(spark, sf_dir):
    return came(spark, watched(spark, sf_dir), lambda obs: streams.changes(obs, ["user_id", "event_type"], ["ts", "event_id"], "event_id"))


@query(_SQL["third_failure_alerts"])
def failure_alerts_stream(spark, sf_dir):
    return came(spark, watched(spark, sf_dir), lambda obs: streams.failure_alerts(obs, ["user_id"], ["ts", "event_id"], "event_id"))


@query(_SQL["out_of_order"])
def late_rows_stream(spark, sf_dir):
    """Rows in a shuffled order of arrival that are not later than one of their user before them."""
    obs = watched(spark, sf_dir).select("event_id", "user_id", (F.col("event_id") * 7919 % 10007).alias("arrived"), F.unix_micros("ts").alias("at"))
    return came(spark, obs, lambda rows: streams.late_rows(rows, ["user_id"], ["arrived", "event_id"], "at", "event_id"), order=F.col("arrived"))


@query("SELECT user_id, event_type, count(DISTINCT CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR)) AS n FROM events GROUP BY 1, 2")
def distinct_stream(spark, sf_dir):
    """Observations of a user and event type without repeats of the same digest."""
    said = ["user_id", "event_type", "digest"]
    return came(spark, watched(spark, sf_dir), lambda obs: streams.distinct_observations(obs.select(*said), said)).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


BEGUN = "event_type = 'signup' AND event_id % 10 = 0"


@query("""WITH d AS (SELECT user_id, min(ts) AS begun FROM events WHERE event_type = 'signup' AND event_id % 10 = 0 GROUP BY 1),
w AS (SELECT event_id, e.user_id, ts, coalesce(ts >= begun, FALSE) AS refused FROM events e LEFT JOIN d USING (user_id) WHERE NOT (event_type = 'signup' AND event_id % 10 = 0))
SELECT event_id, user_id, refused, CASE WHEN refused THEN row_number() OVER (PARTITION BY user_id, refused ORDER BY ts, event_id) END AS late_no FROM w""")
def late_writes_stream(spark, sf_dir):
    """Writes beside a stream of deletions, both cut into batches: what comes after a user's deletion began is refused and counted."""

    def job(rows):
        return streams.late_writes(rows.where(f"NOT ({BEGUN})").select("event_id", "user_id", "ts"), rows.where(BEGUN).select("user_id", "ts"), "user_id", "ts")

    return came(spark, watched(spark, sf_dir), job).select("event_id", "user_id", "refused", "late_no")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000)")
def late_write_filter(spark, sf_dir):
    """Events of users, as customers, of whom no deletion has begun."""
    gone = read(spark, sf_dir, "customer").where("c_acctbal < 2000").select(F.col("c_custkey").alias("user_id"))
    return came(spark, watched(spark, sf_dir), lambda rows: streams.allowed_writes(rows.select("event_id", "user_id"), gone, "user_id")).select("event_id", "user_id")


@query("""WITH l AS (SELECT user_id, ts AS last, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS news, max(ts) OVER () AS now FROM events)
SELECT user_id, last FROM l WHERE epoch_us(news) - epoch_us(last) > 129600000000 OR (news IS NULL AND epoch_ms(now) - epoch_ms(last) > 129600000)""")
def silence_alerts(spark, sf_dir):
    """Every silence of a user of more than 36 hours, raised by a timer of event time or by the news that ended it."""
    return came(spark, watched(spark, sf_dir), lambda rows: streams.silence_alerts(rows, ["user_id"], "ts"), parts=5)


@query("WITH l AS (SELECT user_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events GROUP BY 1) SELECT user_id, last, (SELECT max(last) FROM l) - last > 129600 AS stale FROM l")
def stale_heartbeat(spark, sf_dir):
    """Users not heard of in the 36 hours before the newest event."""
    out = streams.replay(watched(spark, sf_dir), F.unix_micros("ts"), lambda rows: streams.stale(rows, ["user_id"], "ts"), "update")
    last = streams.latest(spark, out, ["user_id"])
    return last.join(F.broadcast(last.agg(F.max("last").alias("now")))).select("user_id", "last", (F.col("now") - F.col("last") > 129_600).alias("stale"))


@query("SELECT event_id, sha256(event_type || event_id) AS digest FROM events")
def append_guard(spark, sf_dir):
    """The stream of events appended twice under the guard: the second time adds nothing, as nothing has changed."""
    rows = read(spark, sf_dir, "events").select("event_id", F.sha2(F.concat("event_type", F.col("event_id").cast("string")), 256).alias("digest"))
    path = streams.scratch(spark)
    spark.createDataFrame([], "event_id long, digest string").write.parquet(f"{path}/batch=-1")
    both = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    streams.replay(both, F.col("again"), lambda r: r.select("event_id", "digest"), "append", 2, streams.guarded_append(path, "event_id", "digest"))
    return spark.read.parquet(path).select("event_id", "digest")


MONTHS = _usage("UNION ALL SELECT user_id, day, 700, 9, 0, 0 FROM l WHERE seq % 4 = 0 AND seq NOT IN (SELECT run FROM l WHERE kind = 'settlement')")


@query(f"SELECT user_id, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(up) AS BIGINT) AS up, CAST(sum(down) AS BIGINT) AS down, CAST(sum(n) AS BIGINT) AS n, CAST(sum(open) AS BIGINT) AS open FROM ({MONTHS}) GROUP BY 1, 2")
def usage_ledger_stream(spark, sf_dir):
    """Months of a ledger that comes in five batches in a shuffled order, so that settlements come before and after their reservations; every fourth record's run was admitted."""
    rows, by = ledger(spark, sf_dir), ["user_id", "day"]
    order = F.abs(F.xxhash64("seq")) % 1_000_000
    streams.replay(rows, order, lambda r: streams.ledger_changes(r, by, DIMS), "append", 5, streams.summed(by, one := streams.scratch(spark)))
    admitted = rows.where("seq % 4 = 0").select(F.lit("admission").alias("kind"), F.col("seq").alias("run"), *by).unionByName(rows.where("kind = 'settlement'").select("kind", "run", *by))
    streams.replay(admitted, F.abs(F.xxhash64("run", "kind")) % 1_000_000, lambda r: streams.admission_changes(r, by, DIMS, {"up": 700, "down": 9}), "append", 5, streams.summed(by, two := streams.scratch(spark)))
    return streams.rolled_up([spark.read.parquet(p).drop("batch") for p in (one, two)], {"user_id": F.col("user_id"), "month": F.trunc("day", "month")})


@query(f"SELECT user_id, event_type, ts, count(DISTINCT digest) AS payloads FROM ({OBS.replace('ts,', 'date_trunc(\'hour\', ts) AS ts,', 1)}) GROUP BY 1, 2, 3 HAVING count(DISTINCT digest) > 1")
def differing_repeats(spark, sf_dir):
    """Observations of one user, kind and hour that say different things."""
    obs = observations(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    return obs.groupBy("user_id", "event_type", "ts").agg(F.count_distinct("digest").alias("payloads")).where("payloads > 1")


def waiting_rule(event="event", amount="amount"):
    """Nothing in the first 90 days, half below 180 days, for what is covered."""

    def rule(df):
        df, contract = R.keep(df, "c", R.given("day", "date"))
        df, at = R.keep(df, "e", R.given(event, "date", "event"))
        df, a = R.keep(df, "a", R.given_amount(amount, "amount"))
        df, covered = R.keep(df, "k", R.given("covered", "boolean"))
        df, waited = R.keep(df, "w", R.compare("gte", at, R.date_add(contract, 90, "day")))
        df, early = R.keep(df, "x", R.compare("lt", at, R.date_add(contract, 180, "day")))
        df, half = R.keep(df, "h", R.multiply_rate(a, 1, 2, "floor"))
        df, eligible = R.keep(df, "ok", R.all_of(covered, waited))
        df, paid = R.keep(df, "p", R.choose_amount(early, half, a))
        return df, eligible, paid

    return rule


REQ = """r AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 101 = 7 THEN '2300-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE o_orderkey % 7 WHEN 0 THEN 'no_rule' WHEN 1 THEN 'link_unapproved' ELSE 'linked' END AS outcome,
 l.ship AS event, CAST(round(o_totalprice) AS BIGINT) AS amount, chr(CAST(65 + o_custkey % 26 AS INT)) || lpad(CAST(o_custkey % 50 + 1 AS VARCHAR), 2, '0') AS code, CAST(o_orderkey % 5 AS INT) AS category
 FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN l_orderkey % 4 <> 3 THEN CAST(max(l_shipdate) AS DATE) END AS ship FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)"""


@query(f"""WITH m AS ({_SQL['membership']}), {REQ}, g AS (SELECT r.*, CASE WHEN day > '2199-12-31' THEN 'bad_date' WHEN outcome <> 'linked' THEN outcome END AS blocked_by, CASE m.answer WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS covered FROM r LEFT JOIN m ON m.code = r.code AND m.category = r.category),
 e AS (SELECT *, CASE WHEN blocked_by IS NULL THEN covered AND event >= CAST(day AS DATE) + 90 END AS ok, CASE WHEN blocked_by IS NULL THEN CASE WHEN event < CAST(day AS DATE) + 180 THEN amount // 2 WHEN event IS NOT NULL THEN amount END END AS pay FROM g)
SELECT request, blocked_by, CASE WHEN blocked_by IS NOT NULL THEN 'hold' WHEN ok IS NULL THEN 'input_missing' ELSE 'shown' END AS display, CASE WHEN blocked_by IS NULL THEN CASE WHEN ok IS NULL THEN 'undetermined' WHEN ok THEN 'payable' ELSE 'not_payable' END END AS kind, CASE WHEN ok IS NULL OR ok THEN pay END AS paid,
 CASE WHEN blocked_by IS NULL AND ok IS NULL THEN array_to_string(list_filter(list_value(CASE WHEN covered IS NULL THEN 'covered' END, CASE WHEN event IS NULL THEN 'event' END), lambda x: x IS NOT NULL), ',') ELSE CASE WHEN blocked_by IS NULL THEN '' END END AS missing FROM e""")
def evaluate_requests(spark, sf_dir):
    """Orders as requests: dates, links and the category of a code decide whether the waiting-period rule runs, and on what."""
    from lodestone.catalog import membership

    k = F.col("o_orderkey")
    ship = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("ship"))
    o = read(spark, sf_dir, "orders").join(ship, k == F.col("l_orderkey"), "left")
    code = F.concat(F.char(65 + F.col("o_custkey") % 26), F.lpad((F.col("o_custkey") % 50 + 1).cast("string"), 2, "0"))
    requests = o.select(k.alias("request"), F.when(k % 101 == 7, "2300-01-01").otherwise(F.to_date("o_orderdate").cast("string")).alias("day"), F.when(k % 4 != 3, F.col("ship")).cast("string").alias("event"), F.round("o_totalprice").cast("bigint").alias("amount"), code.alias("code"), (k % 5).cast("int").alias("category"))
    chain = o.select(k.alias("request"), F.when(k % 7 == 0, "no_rule").when(k % 7 == 1, "link_unapproved").otherwise("linked").alias("outcome"))
    sound = K.check_release(spark, sf_dir).where("false")  # a release without findings
    done = evaluation.evaluate_requests(requests, chain, sound, {"covered": ("ontology", graph.cut(membership(spark, sf_dir)))}, waiting_rule())
    return done.select("request", "blocked_by", "display", F.col("p.kind").alias("kind"), F.col("p.min_krw").alias("paid"), F.array_join("p.missing", ",").alias("missing"))


def linked_claims(spark, sf_dir):
    """Suppliers as sales configurations with an edition, a coverage and a rule of their own, some links of which are unapproved, ended or held."""
    s = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(s.cast("string").alias("s"), s)
    text = lambda c: F.lit(c).cast("string")

    def claim(predicate, subject, object_, accepted, criticality="C2", valid_to=None, rule_path=None):
        name = lambda kind: F.concat(F.lit(kind), "s") if isinstance(kind, str) else kind
        day = F.lit(None).cast("date")
        return rows.select(F.concat(F.lit(f"{predicate}:"), "s").alias("id"), F.lit(predicate).alias("predicate"), name(subject).alias("subject"), name(object_).alias("object") if object_ is not None else text(None).alias("object"), text(None).alias("value"), F.lit(criticality).alias("criticality"), accepted.alias("accepted"), day.alias("valid_from"), (day if valid_to is None else valid_to).alias("valid_to"), (text(None) if rule_path is None else rule_path).alias("rule_path"), F.lit(None).cast("array<string>").alias("covers_editions"))

    yes = F.lit(True)
    parts = (
        claim("uses_edition", "sc:", "ed:", s % 11 != 3, valid_to=F.when(s % 7 == 2, F.lit("1995-12-31").cast("date"))),
        claim("in_edition", "cov:", "ed:", s % 13 != 5),
        claim("uses_definition", "cov:", F.concat(F.lit("cat:"), (s % 5).cast("string")), yes),
        claim("implemented_by", "cov:", None, s % 17 != 6, rule_path=F.concat(F.lit("rules/"), "s", F.lit(".json"))),
        claim("has_condition", "cov:", "cond:", s % 19 != 4, criticality="C0"),
    )
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH mem AS ({_SQL['membership']}), r0 AS (SELECT o_orderkey AS request, o_custkey % 25 AS release, CAST(o_orderdate AS DATE) AS asked, coalesce(l.s, 1) AS s, CASE WHEN o_orderkey % 101 = 7 THEN '2300-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, l.ship AS event, CAST(round(o_totalprice) AS BIGINT) AS amount, chr(CAST(65 + o_custkey % 26 AS INT)) || lpad(CAST(o_custkey % 50 + 1 AS VARCHAR), 2, '0') AS code
 FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s, CASE WHEN l_orderkey % 4 <> 3 THEN CAST(max(l_shipdate) AS DATE) END AS ship FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey),
 chain AS (SELECT *, CASE WHEN s_suppkey IS NULL OR (s % 7 = 2 AND asked > DATE '1995-12-31') THEN 'no_uses_edition' WHEN s % 11 = 3 THEN 'link_unapproved' WHEN s % 13 = 5 THEN 'cov_not_in_edition' WHEN s % 23 = 7 THEN 'edition_identity_unconfirmed' WHEN s % 19 = 4 THEN 'link_unapproved' WHEN s % 17 = 6 THEN 'no_rule' ELSE 'linked' END AS outcome FROM r0 LEFT JOIN supplier ON s_suppkey = s),
 g AS (SELECT c.*, CASE WHEN release IN (1, 3) THEN 'release_broken' WHEN day > '2199-12-31' THEN 'bad_date' WHEN outcome <> 'linked' THEN outcome END AS blocked_by, CASE mem.answer WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS covered FROM chain c LEFT JOIN mem ON mem.code = c.code AND mem.category = s % 5),
 e AS (SELECT *, CASE WHEN blocked_by IS NULL THEN covered AND event >= CAST(day AS DATE) + 90 END AS ok, CASE WHEN blocked_by IS NULL THEN CASE WHEN event < CAST(day AS DATE) + 180 THEN amount // 2 WHEN event IS NOT NULL THEN amount END END AS pay FROM g)
SELECT request, blocked_by, CASE WHEN blocked_by IS NOT NULL THEN 'hold' WHEN ok IS NULL THEN 'input_missing' ELSE 'shown' END AS display, CASE WHEN blocked_by IS NULL THEN CASE WHEN ok IS NULL THEN 'undetermined' WHEN ok THEN 'payable' ELSE 'not_payable' END END AS kind, CASE WHEN ok IS NULL OR ok THEN pay END AS paid FROM e""")
def evaluate_end_to_end(spark, sf_dir):
    """Orders as requests of releases: the integrity of each release, the date, the link to a rule and its category, and only then the rule."""
    from lodestone.catalog import membership

    k, i = F.col("o_orderkey"), F.col("doc_id")
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("ship"), F.min("l_suppkey").alias("supp"))
    o = read(spark, sf_dir, "orders").join(li, k == F.col("l_orderkey"), "left").withColumn("s", F.coalesce("supp", F.lit(1)).cast("string"))
    code = F.concat(F.char(65 + F.col("o_custkey") % 26), F.lpad((F.col("o_custkey") % 50 + 1).cast("string"), 2, "0"))
    live = graph.cut(linked_claims(spark, sf_dir))
    categories = read(spark, sf_dir, "region").select(F.concat(F.lit("cat:"), F.col("r_regionkey").cast("string")).alias("node"))
    none = spark.createDataFrame([], "listed array<string>, state string")
    allowed = K.knowledge.simulate_allowed(live, K.knowledge.coverage_scope(live, categories), none)
    confirmed = read(spark, sf_dir, "supplier").where("s_suppkey % 23 <> 7").select(F.concat(F.lit("ed:"), F.col("s_suppkey").cast("string")).alias("edition"))
    asked = o.select(k.alias("request"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("cov:"), "s").alias("coverage"))
    linked = graph.cut(K.knowledge.resolve_request(K.knowledge.resolve_chain(asked, o.select(k.alias("request"), F.concat(F.lit("sc:"), "s").alias("config")), live, confirmed, allowed)))
    requests = o.select(k.alias("request"), (F.col("o_custkey") % 25).alias("release"), F.when(k % 101 == 7, "2300-01-01").otherwise(F.to_date("o_orderdate").cast("string")).alias("day"), F.when(k % 4 != 3, F.col("ship")).cast("string").alias("event"), F.round("o_totalprice").cast("bigint").alias("amount"), code.alias("code"))
    requests = requests.join(linked.select("request", "category"), "request")
    # a release's documents and rule files as they were frozen, and the store, that lost some documents of one release and edited rules of another
    d = read(spark, sf_dir, "documents").select((i % 25).alias("release"), i)
    rows = lambda section, digest: d.select("release", F.lit(section).alias("section"), i.cast("string").alias("id"), digest.alias("digest"))
    frozen = rows("documents", i.cast("string")).unionByName(rows(releases.RULES, i.cast("string")))
    stored = rows("documents", i.cast("string")).where("release <> 1 OR id NOT LIKE '%1'").unionByName(rows(releases.RULES, F.when(i % 25 == 3, F.concat(i.cast("string"), F.lit("x"))).otherwise(i.cast("string"))))
    findings = releases.integrity(releases.tree(frozen), frozen, stored.drop("release"))
    answers = membership(spark, sf_dir).withColumn("category", F.concat(F.lit("cat:"), "category"))
    done = evaluation.evaluate_requests(requests, linked, findings, {"covered": ("ontology", graph.cut(answers))}, waiting_rule())
    return done.select("request", "blocked_by", "display", F.col("p.kind").alias("kind"), F.col("p.min_krw").alias("paid"))


@query(f"""WITH c AS ({CASES}), x AS (SELECT *, CASE WHEN qty > 25 THEN TRUE WHEN qty > 10 THEN FALSE END AS covered FROM c), p AS (SELECT l_orderkey, l_linenumber, l_returnflag, covered AND event >= contract + 90 AS a, covered AND event >= contract + 60 AS b FROM x)
SELECT l_returnflag, count(*) AS n FROM p WHERE a IS DISTINCT FROM b GROUP BY 1""")
def shadow_compare(spark, sf_dir):
    """Line items on which a waiting period of 60 days would decide otherwise than one of 90."""
    q = F.col("qty")
    rows = cases(spark, sf_dir).select(F.monotonically_increasing_id().alias("case"), "l_returnflag", F.col("contract").alias("day"), "event", F.lit(5).cast("bigint").alias("amount"), F.when(q > 25, True).when(q > 10, False).alias("covered"))
    rows = graph.cut(rows)

    def rule(days):
        def run(df):
            df, contract = R.keep(df, "c", R.given("day", "date"))
            df, at = R.keep(df, "e", R.given("event", "date"))
            df, covered = R.keep(df, "k", R.given("covered", "boolean"))
            return df, R.all_of(covered, R.compare("gte", at, R.date_add(contract, days, "day"))), R.given_amount("amount")

        return run

    differ = evaluation.shadow_compare(rows, "case", rule(90), rule(60))
    # the amount of an undetermined case does not change, so differing payouts are differing answers
    return differ.join(rows, "case").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(f"""WITH c AS ({CASES}) SELECT CASE WHEN l_linenumber = 2 THEN 'error' WHEN event IS NULL THEN 'undetermined' WHEN event >= contract THEN 'payable' ELSE 'not_payable' END AS kind, CASE WHEN l_linenumber = 2 THEN 'wrong_type' END AS error, count(*) AS n FROM c GROUP BY 1, 2""")
def run_case_table(spark, sf_dir):
    """Line items as cases, every second line with a text where a date should be: it alone fails."""

    def rule(df):
        df, contract = R.keep(df, "c", R.given("day", "date"))
        df, at = R.keep(df, "e", R.given("event", "date"))
        return df, R.compare("gte", at, contract), R.given_amount("amount")

    rows = cases(spark, sf_dir).select("l_linenumber", F.when(F.col("l_linenumber") == 2, "soon").otherwise(F.col("contract")).alias("day"), "event", "amount")
    return evaluation.run_case_table(rows, rule, "l_linenumber").groupBy("kind", "error").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'v' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '{"confirmed_empty":true}' ELSE 'c' END WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'f' END AS a, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'assumed' END AS b FROM orders""")
def prepare_facts(spark, sf_dir):
    """Facts of four sources, the later winning; empty lists and forged marks by where they come from."""
    k = F.col("o_orderkey")
    one = lambda name, value: F.create_map(F.lit(name), value)
    facts = one("a", F.when(k % 7 == 0, "[]").otherwise("f"))
    assumed = F.map_concat(one("a", F.lit("x")), one("b", F.when(k % 11 == 0, evaluation.EMPTY).otherwise("assumed")))
    confirmed, verified = F.when(k % 3 == 0, one("a", F.when(k % 2 == 0, "[]").otherwise("c"))), F.when(k % 5 == 0, one("a", F.lit("v")))
    got = evaluation.prepare_facts(facts, assumed, confirmed, verified)
    return read(spark, sf_dir, "orders").select("o_orderkey", got["a"].alias("a"), got["b"].alias("b"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'hash_mismatch' WHEN doc_id % 5 = 0 THEN 'quote_mismatch' WHEN doc_id % 4 = 0 THEN 'derived_unverified' WHEN doc_id % 4 = 1 THEN 'derived_mismatch' WHEN doc_id % 4 = 2 THEN 'derived_unverified' ELSE 'reproduced' END AS status FROM documents")
def reproduction_status(spark, sf_dir):
    i, d = F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)
    states = F.when(i % 4 == 1, F.array(F.lit("byte_identical"), F.lit("differs"))).when(i % 4 == 2, F.array(F.lit("not_rerun"))).when(i % 4 == 3, F.array(F.lit("byte_identical")))
    archived = F.when(i % 9 != 0, F.when(i % 7 == 0, F.reverse(d)).otherwise(d))
    return read(spark, sf_dir, "documents").select("doc_id", jobs.reproduction_status(archived, d, F.when(i % 5 == 0, 2).otherwise(0), states).alias("status"))


@query("SELECT url, CASE WHEN page_id % 7 = 0 THEN 'fetch_failed' WHEN page_id % 3 = 0 THEN 'unchanged_bytes' WHEN page_id % 3 = 1 AND page_id % 5 <> 0 THEN 'bytes_changed_content_same' ELSE 'changed' END AS status FROM (SELECT page_id, 'p' || page_id AS url FROM pages)")
def source_change(spark, sf_dir):
    """Pages fetched again: as they were, with a comment and a script added, or with a word; every fifth was hashed under another rule."""
    i = F.col("page_id")
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), i.cast("string")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    seen = lambda html: F.sha2(pages.visible_text(html, F.lit("x.example")), 256)
    new = F.when(i % 3 == 0, F.col("html")).when(i % 3 == 1, F.concat("html", F.lit("<!-- later --><script>var n = 1</script>"))).otherwise(F.concat("html", F.lit("<p>more</p>")))
    now = p.withColumn("new", new).select("url", F.when(i % 7 != 0, F.sha2("new", 256)).alias("sha256"), seen(F.col("new")).alias("content_sha256"))
    before = p.select("url", F.sha2("html", 256).alias("sha256"), seen(F.col("html")).alias("content_sha256"), F.when(i % 5 == 0, "older").otherwise(jobs.RULE).alias("rule"))
    return jobs.source_change(now, before)


@query("SELECT page_id, CASE WHEN contains(html, '<nav') THEN 'complete' ELSE 'structure_changed' END AS status, len(list_distinct(regexp_extract_all(regexp_extract(html, '(?s)<nav.*?</nav>'), 'href=\"([^\"]*)\"', 1))) AS targets FROM pages WHERE html IS NOT NULL")
def discover_links(spark, sf_dir):
    """The links of every page's menu."""
    got = jobs.discover_links(read(spark, sf_dir, "pages").where("html IS NOT NULL"), "nav")
    return got.groupBy("page_id", "status").agg(F.count("target").cast("int").alias("targets"))


@query("""WITH c AS (SELECT o_custkey AS root, count(*) AS n, CAST(ceil(count(*) / 2) AS BIGINT) AS k FROM orders GROUP BY 1)
SELECT root, CASE WHEN root % 7 = 3 AND k >= 2 THEN 'structure_changed' WHEN root % 13 = 4 THEN 'blocked' WHEN root % 11 = 5 AND k = 1 THEN 'structure_changed' WHEN k > 10 THEN 'structure_changed' ELSE 'complete' END AS status,
 CASE WHEN root % 7 = 3 AND k >= 2 THEN 'missing_expected_structure' WHEN root % 13 = 4 THEN 'access_blocked' WHEN root % 11 = 5 AND k = 1 THEN 'invalid_next_page' WHEN k > 10 THEN 'pagination_limit' END AS reason,
 CASE WHEN root % 7 = 3 AND k >= 2 THEN 2 WHEN root % 13 = 4 THEN 1 WHEN k > 10 THEN 10 ELSE k END AS pages, CASE WHEN root % 7 = 3 AND k >= 2 THEN 2 WHEN root % 13 = 4 THEN 0 WHEN root % 11 = 5 AND k = 1 THEN 0 WHEN k > 10 THEN 20 ELSE n END AS documents FROM c""")
def follow_pages(spark, sf_dir):
    """Customers' orders as documents, two a listing page: some second pages have lost their container, some first ones refuse, some last ones lead back to the first."""
    by = Window.partitionBy("root").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), "o_orderkey")
    o = o.withColumn("p", F.floor((F.row_number().over(by) + 1) / 2).cast("int"))
    anchor = F.concat(F.lit('<li><a href="../doc/'), F.col("o_orderkey"), F.lit('.pdf?v=1#top">Order '), F.col("o_orderkey"), F.lit("</a></li>"))
    page = o.groupBy("root", "p").agg(F.array_join(F.sort_array(F.collect_list(anchor)), "").alias("own")).withColumn("last", F.col("p") == F.max("p").over(Window.partitionBy("root")))
    r = F.col("root")
    address = lambda p: F.concat(F.lit("https://h.example/list/"), r, F.lit("/"), p)
    broken, refused = (r % 7 == 3) & (F.col("p") == 2), (r % 13 == 4) & (F.col("p") == 1) & ~((r % 7 == 3) & ~F.col("last"))
    box = F.concat(F.when(broken, "<div id=other>").otherwise("<div id=documents>"), F.lit("<ul>"), F.col("own"), F.lit("</ul></div>"))
    to = F.when(~F.col("last"), F.col("p") + 1).when(r % 11 == 5, F.lit(1))
    onward = F.when(to.isNotNull(), F.concat(F.lit('<a rel="nofollow next" href="'), F.concat(F.lit("/list/"), r, F.lit("/"), to), F.lit('">more</a>'))).otherwise("")
    html = F.concat(F.lit("<html><title>List</title>"), F.when(refused, "<h1>Access <b>denied</b></h1>").otherwise(""), box, onward, F.lit("<a href='https://u:p@h.example/x.pdf'>x</a></html>"))
    listed = pages.listings(page.select(r, address(F.col("p")).alias("url"), html.alias("html")), key="root")
    return pages.follow_pages(page.where("p = 1").select("root", address(F.lit(1)).alias("url")), listed.drop("root"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'age' ELSE 'age,sex' END AS matched, CASE WHEN p_size % 3 = 0 THEN 'sex' ELSE '' END AS mismatched, CASE WHEN p_size % 2 = 0 THEN 'plan' ELSE '' END AS not_in_source FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'age,plan' ELSE 'age,plan,sex' END, CASE WHEN p_size % 3 = 0 THEN 'sex' ELSE '' END, '' FROM part WHERE p_size % 2 <> 0")
def condition_match(spark, sf_dir):
    n = F.col("p_size")
    m = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    profile = m("age", "40", "sex", "male", "plan", "a")
    price = F.map_concat(m("age", "40", "sex", F.when(n % 3 == 0, "female").otherwise("male")), F.when(n % 2 != 0, m("plan", "a")).otherwise(F.expr("cast(map() as map<string, string>)")))
    got = jobs.condition_match(profile, price)
    return read(spark, sf_dir, "part").select("p_partkey", *[F.array_join(got[c], ",").alias(c) for c in ("matched", "mismatched", "not_in_source")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 4 THEN 'unknown_kind' WHEN l_linenumber = 5 THEN 'no_source' WHEN (l_quantity = 9) THEN 'differs' ELSE 'agrees' END AS status FROM lineitem")
def amount_sources(spark, sf_dir):
    """Line items' amounts against parts' prices and suppliers' balances as their sources."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ref"), (F.col("p_partkey") * 7).alias("krw"))
    supp = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ref"), (F.col("s_suppkey") * 3).alias("krw"))
    n = F.col("l_linenumber")
    first = n % 2 == 0
    li = read(spark, sf_dir, "lineitem")
    lines = li.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("line"), F.when(n == 4, "other").when(first, "premium").otherwise("scenario").alias("kind"), F.when(n == 5, "none").when(first, F.col("l_partkey").cast("string")).otherwise(F.col("l_suppkey").cast("string")).alias("ref"), (F.when(first, F.col("l_partkey") * 7).otherwise(F.col("l_suppkey") * 3) + F.when(F.col("l_quantity") == 9, 1).otherwise(0)).alias("krw"))
    return jobs.amount_sources(lines, {"premium": part, "scenario": supp}).select("line.*", "status")


@query("""WITH t AS (SELECT n_nationkey AS k, DATE '1992-01-01' + CAST(n_nationkey * 30 AS INT) AS f, CASE WHEN n_nationkey % 3 <> 0 THEN DATE '1998-01-01' END AS t, n_nationkey * 10 AS v FROM nation UNION ALL SELECT n_nationkey, DATE '1997-06-01', NULL, 1 FROM nation WHERE n_nationkey % 4 = 0),
h AS (SELECT o_orderkey, count(v) AS n, min(v) AS v FROM orders LEFT JOIN t ON k = o_custkey % 25 AND CAST(o_orderdate AS DATE) >= f AND (t IS NULL OR CAST(o_orderdate AS DATE) <= t) GROUP BY 1) SELECT o_orderkey, CASE WHEN n <= 1 THEN v END AS value, CASE WHEN n > 1 THEN 'several_in_force' END AS error FROM h""")
def parameter_lookup(spark, sf_dir):
    """The parameter of an order's group in force on its day."""
    k = F.col("n_nationkey")
    day = lambda text: F.lit(text).cast("date")
    n = read(spark, sf_dir, "nation")
    table = n.select(k.alias("g"), F.date_add(day("1992-01-01"), k * 30).alias("valid_from"), F.when(k % 3 != 0, day("1998-01-01")).alias("valid_to"), (k * 10).alias("value"))
    table = table.union(n.where("n_nationkey % 4 = 0").select(k, day("1997-06-01"), F.lit(None).cast("date"), F.lit(1)))
    requests = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("g"), F.to_date("o_orderdate").alias("day"))
    return jobs.lookup(requests, table, "g", "day").select("o_orderkey", "value", "error")


@query("SELECT CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000) THEN 'refused' ELSE 'kept' END AS what, count(*) AS n FROM events GROUP BY 1")
def reject_late_writes(spark, sf_dir):
    """Events as writes; every second names only its evaluation."""
    e = read(spark, sf_dir, "events")
    writes = e.select("event_id", F.col("event_id").alias("evaluation"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("person"))
    kept, refused = jobs.reject_late(writes, read(spark, sf_dir, "customer").where("c_acctbal < 2000").select(F.col("c_custkey").alias("person")), e.select(F.col("event_id").alias("evaluation"), F.col("user_id").alias("person")))
    return kept.withColumn("what", F.lit("kept")).union(refused.withColumn("what", F.lit("refused"))).groupBy("what").agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) > 0 AND doc_id % 3 <> 1 AS found FROM documents WHERE text IS NOT NULL AND length(regexp_replace(text, '\\s+', '', 'g')) > 0")
def quote_containment(spark, sf_dir):
    """Quotes of every document's middle against its own text as the passage, every third against another page."""
    d = read(spark, sf_dir, "documents").where("text is not null").withColumn("p", jobs.squeeze(F.col("text"))).where("p <> ''")
    n = F.length("text")
    quote = F.substring("text", F.floor(n / 3).cast("int") + 1, F.floor(n / 3).cast("int") + 1)
    claims = d.select(F.col("doc_id").alias("claim"), "doc_id", F.when(F.col("doc_id") % 3 == 1, 2).otherwise(1).alias("page"), quote.alias("quote"))
    return jobs.quote_containment(claims, d.select("doc_id", F.lit(1).alias("page"), F.col("p").alias("passage")), "doc_id").select(F.col("claim").alias("doc_id"), "found")


@query("SELECT conv_id, sha256(string_agg(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), '' ORDER BY turn)) AS sha256 FROM conversations GROUP BY 1")
def fingerprints(spark, sf_dir):
    """Conversations as documents, their turns as pages."""
    return jobs.fingerprint(read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), "conv_id", "turn", "text")


@query("SELECT conv_id, turn, CASE WHEN turn <= 2 THEN 'a' ELSE 'b' END AS segment FROM conversations WHERE turn <= 2 OR turn BETWEEN 4 AND 9")
def segment_pages(spark, sf_dir):
    """Turns as pages in two segments a conversation."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    specs = t.select("conv_id").distinct().withColumn("s", F.explode(F.array(F.struct(F.lit("a").alias("segment"), F.lit(0).alias("first"), F.lit(2).alias("last")), F.struct(F.lit("b").alias("segment"), F.lit(4).alias("first"), F.lit(9).alias("last"))))).select("conv_id", "s.*")
    return jobs.segment_pages(t, specs, "conv_id", "turn")[0].select("conv_id", "turn", "segment")


@query("SELECT source AS source_id, sha256(coalesce(text, '')) AS content_hash, lang AS parser_version, count(*) AS asked FROM documents GROUP BY 1, 2, 3")
def dedupe_work(spark, sf_dir):
    return jobs.dedupe_work(read(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.col("lang").alias("parser_version")))


@query("SELECT o_orderkey AS doc, CAST(l_linenumber AS INT) AS line, l_returnflag AS name, CAST(l_partkey AS VARCHAR) AS amount, '1' AS extractor_version FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber, first(l_returnflag) OVER w AS l_returnflag, first(l_partkey) OVER w AS l_partkey FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_returnflag)) WHERE l_linenumber <> 3")
def extracted_rows(spark, sf_dir):
    """Orders' lines written as one text each and read back by a registered extractor; line 3 is a remark."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_returnflag")).alias("s"))
    said = F.when(F.col("l_linenumber") == 3, "# left out").otherwise(F.concat_ws(" | ", "s.l_returnflag", F.lit("all"), F.col("s.l_partkey").cast("string"), F.lit("1y"), F.lit("p1")))
    lines = li.withColumn("said", said).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "said"))).alias("m"), F.max("l_linenumber").alias("n"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), "\n")
    return jobs.extract(lines.select(F.col("l_orderkey").alias("doc"), text.alias("text")), "price_lines", "1").select("doc", "line", "name", "amount", "extractor_version")


@query("SELECT s_suppkey AS root, count(*) AS touched FROM supplier JOIN (SELECT s_suppkey AS x FROM supplier) y ON x // 3 = s_suppkey // 3 AND x // 3 >= 0 GROUP BY 1")
def impact_closure(spark, sf_dir):
    """What a change of a supplier may touch over links to its neighbours of three, in either direction."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    top = s.agg(F.max("s_suppkey").alias("top"))
    edges = s.where("s_suppkey % 3 <> 2").join(F.broadcast(top)).where("s_suppkey < top").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"))
    return graph.undirected(edges, s.select(F.col("s_suppkey").alias("root"))).groupBy("root").agg(F.count("*").alias("touched"))


@query("WITH c AS (SELECT DISTINCT l_orderkey AS o, p_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 4) SELECT count(DISTINCT p) AS products, count(DISTINCT o_custkey) AS contracts, count(DISTINCT o) AS plans FROM c JOIN orders ON o_orderkey = o")
def change_impact(spark, sf_dir):
    """Parts that changed, and the orders and customers that rest on them."""
    hit = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").where("p_size < 4").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    both = hit.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.agg(F.count_distinct("l_partkey").alias("products"), F.count_distinct("o_custkey").alias("contracts"), F.count_distinct("l_orderkey").alias("plans"))


@query("""WITH u AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS gaps, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS used FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT count(*) AS sources, CAST(sum(gaps) AS BIGINT) AS gaps, CAST(sum(used) AS BIGINT) AS used, count(*) FILTER (epoch(now) - epoch(ok) > 129600 OR ok IS NULL) AS stale, sum(gaps) > 100 AS new_gap, sum(used) * 5 >= 5000000 * 4 AS near_cap FROM u, n""")
def status_snapshot(spark, sf_dir):
    """One row over all sources: counts, gaps, use, and the flags that raise an alert."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bad = F.col("event_type") == "error"
    by = e.groupBy("user_id").agg(F.max(F.when(~bad, F.col("ts"))).alias("ok"), F.count_if(bad).alias("gaps"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("used"), F.max("ts").alias("seen"))
    now = by.agg(F.max("seen").alias("now"))
    age = F.unix_micros("now") - F.unix_micros("ok")
    done = by.join(F.broadcast(now)).agg(F.count("*").alias("sources"), F.sum("gaps").alias("gaps"), F.sum("used").alias("used"), F.count_if(F.coalesce(age > 129_600_000_000, F.lit(True))).alias("stale"))
    return done.withColumns({"new_gap": F.col("gaps") > 100, "near_cap": F.col("used") * 5 >= 5_000_000 * 4})


@query("SELECT CASE WHEN lang IS NULL THEN 'no_language' WHEN n_chars < 50 THEN 'too_short' ELSE 'listed' END AS code, count(*) AS n FROM documents GROUP BY 1")
def unacquired_reasons(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.when(F.col("lang").isNull(), "no_language").when(F.col("n_chars") < 50, "too_short").otherwise("listed").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT s_nationkey AS org, count(*) FILTER (l_quantity > 5) AS numerator, count(*) AS denominator, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def quality_metrics(spark, sf_dir):
    """Per organisation a numerator over its denominator, and exact percentiles of what took long."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("s_nationkey").alias("org")).agg(F.count_if(F.col("l_quantity") > 5).alias("numerator"), F.count("*").alias("denominator"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity)").alias("p95"))


@query("""WITH i AS (SELECT l_orderkey, l_returnflag AS class, CASE WHEN l_orderkey % 12 = 5 AND l_linenumber = 1 THEN NULL WHEN l_orderkey % 12 = 3 AND l_linenumber = 1 THEN -1 ELSE CAST(round(l_extendedprice) AS BIGINT) END AS krw FROM lineitem),
 t AS (SELECT l_orderkey, class, max(krw) AS top, min(krw) < 0 AS wrong, bool_or(krw IS NULL) AS open_ FROM i GROUP BY 1, 2), s AS (SELECT l_orderkey, bool_or(coalesce(wrong, FALSE)) AS wrong, bool_or(open_) AS open_, CASE WHEN NOT bool_or(open_) THEN CAST(sum(top) AS BIGINT) END AS total FROM t GROUP BY 1)
SELECT l_orderkey AS request, CASE WHEN k = 2 THEN 'inputs_not_object' WHEN k = 4 THEN 'undeclared:extra' WHEN wrong THEN 'wrong_type:items' WHEN k = 6 THEN 'wrong_type:day' END AS error,
 CASE WHEN k = 1 THEN 0 WHEN k IN (0, 2, 4, 6, 7) OR wrong THEN NULL ELSE total END AS total, CASE WHEN k IN (0, 7) OR open_ THEN 'items' ELSE '' END AS missing FROM (SELECT *, l_orderkey % 12 AS k FROM s)""")
def list_inputs(spark, sf_dir):
    """Orders as cases whose inputs come as JSON, a list of classes and amounts among them: empty, confirmed empty, null, wrong, undeclared, of unknown amount, or whole."""
    k, first = F.col("l_orderkey") % 12, F.col("l_linenumber") == 1
    amount = F.when((k == 5) & first, None).when((k == 3) & first, -1).otherwise(F.round("l_extendedprice").cast("bigint"))
    item = F.concat(F.lit('{"class":"'), "l_returnflag", F.lit('","krw":'), F.coalesce(amount.cast("string"), F.lit("null")), F.lit("}"))
    cases_ = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(item)), ","), F.lit("]")).alias("items"))
    items = F.when(k == 0, "[]").when(k == 1, '{"confirmed_empty": true}').when(k == 7, "null").otherwise(F.col("items"))
    day = F.when(k == 6, "2026-02-30").otherwise("2026-02-28")
    text = F.when(k == 2, "[1]").otherwise(F.concat(F.lit('{"items":'), items, F.lit(',"day":"'), day, F.lit('"'), F.when(k == 4, ',"extra":1').otherwise(""), F.lit("}")))
    rows, given = R.typed_inputs(cases_.select(F.col("l_orderkey").alias("request"), text.alias("inputs")), "inputs", {"items": "classes", "day": "date"})
    total = R.max_over_list(given["items"], "items")
    return rows.select("request", total.error.alias("error"), total.lo.alias("total"), F.array_join(total.missing, ",").alias("missing"))


@query("""WITH c AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, CASE WHEN event_id % 8 <> 3 THEN user_id END AS user, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) AS c FROM events)
SELECT month, NULL AS user, NULL AS day, count(*) AS calls, CAST(sum(c) AS BIGINT) AS cost, sum(c) >= 1000000 AS reached FROM c GROUP BY 1 UNION ALL SELECT NULL, user, day, count(*), CAST(sum(c) AS BIGINT), sum(c) >= 5000 FROM c WHERE user IS NOT NULL GROUP BY 2, 3""")
def call_costs(spark, sf_dir):
    """Events as model calls, every eighth without a user: costs by month and by user and day, against the caps of both."""
    calls = read(spark, sf_dir, "events").withColumn("who", F.when(F.col("event_id") % 8 != 3, F.col("user_id")))
    return usage.call_costs(calls, "ts", "who", F.round(F.col("value") * 100).cast("bigint"), 1_000_000, 5000)


@query("""WITH o AS (SELECT user_id, event_type, epoch_us(ts) AS t, event_id % 4 <> 0 AS ok, coalesce(CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) + event_id % 7 * 3600000000 END, epoch_us(ts)) AS due FROM events),
s AS (SELECT user_id, event_type, max(t) FILTER (ok) AS good, max(t) FILTER (NOT ok) AS bad, arg_max(due, t) AS due FROM o GROUP BY 1, 2)
SELECT user_id, max(good) AS last_success, max(bad) AS last_failure, min(due) AS next_due FROM s GROUP BY 1""")
def source_due(spark, sf_dir):
    """Users as sources of pages by event type: last success and failure, and when the first of their pages is due again."""
    i = F.col("event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    obs = read(spark, sf_dir, "events").select("user_id", "event_type", at.alias("at"), F.when(i % 4 != 0, F.when(i % 9 == 0, 304).otherwise(200)).alias("status"), F.when(i % 5 != 0, at + i % 7 * 3_600_000_000).alias("due"))
    return history.source_status(history.due_state(obs, ["user_id", "event_type"], "at", "status", "due"), ["user_id"])


@query("SELECT s_nationkey AS org, count(*) AS n, CAST(quantile_disc(l_quantity, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(l_quantity, 0.95) AS DOUBLE) AS p95 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def latency_quantiles(spark, sf_dir):
    """Percentiles of an organisation from sketches kept by day, merged over months; exact here, as an organisation has fewer values than the sketch holds."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("org"), F.to_date("l_shipdate").alias("day"), "l_quantity")
    k = 8192
    days = sketches.quantile_sketches(rows, ["org", "day"], F.col("l_quantity"), k)
    months = sketches.merged(days.withColumn("month", F.trunc("day", "month")), ["org", "month"], k)
    return sketches.quantiles(sketches.merged(months, ["org"], k), {"p50": 0.5, "p95": 0.95})


@query("SELECT o_custkey, o_orderpriority, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1, 2")
def assumption_versions(spark, sf_dir):
    """The newest of a customer's assumptions of every kind."""
    rows = read(spark, sf_dir, "orders").withColumn("v", F.struct("o_orderdate", "o_orderkey"))
    return latest_assumptions(rows, "o_custkey", "o_orderpriority", "v").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""WITH a AS (SELECT l_suppkey AS s, list(DISTINCT l_partkey % 40) AS x FROM lineitem GROUP BY 1) SELECT a.s AS a, b.s AS b, CAST(len(list_intersect(a.x, b.x)) AS INT) AS shared, len(list_filter(a.x, lambda v: NOT list_contains(b.x, v))) = 0 AS subset FROM a JOIN a b ON b.s = a.s + 1""")
def set_relations(spark, sf_dir):
    """What neighbouring suppliers' groups of parts have in common, and whether one holds the other."""
    a = graph.cut(read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a")).agg(F.collect_set(F.col("l_partkey") % 40).alias("x")))
    both = a.join(a.select(F.col("a").alias("b"), F.col("x").alias("y")), F.col("b") == F.col("a") + 1)
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size(F.array_except("x", "y")) == 0).alias("subset"))


@query("SELECT p_brand, count(*) FILTER (p_size % 3 = 0) AS axis_0, count(*) FILTER (p_size % 3 = 1) AS axis_1, count(*) FILTER (p_size % 3 = 2) AS axis_2, min(CASE WHEN p_size % 4 <> 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) END) AS price, count(*) FILTER (p_size % 4 = 0) AS not_comparable FROM part GROUP BY 1")
def comparison_view(spark, sf_dir):
    """Brands side by side: what they have on every axis, the least comparable price, and how many have none."""
    p = read(spark, sf_dir, "part")
    n = F.col("p_size")
    return p.groupBy("p_brand").agg(*[F.count_if(n % 3 == i).alias(f"axis_{i}") for i in range(3)], F.min(F.when(n % 4 != 0, F.round(F.col("p_retailprice") * 100).cast("bigint"))).alias("price"), F.count_if(n % 4 == 0).alias("not_comparable"))

