"""Queries over claims: the star schema read as a store of claims, editions, segments, conditions and requests.

Every order is a claim.  Its number, in twelves, gives the predicate; its customer, part and supplier,
dealt to fewer entities, its subject and object.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from lodestone.catalog import _SQL, doc_hash, private_id_scan_all, query, read, scope_relation
from lodestone.operators import graph, knowledge, links, releases
from lodestone.operators.graph import cut

PREDICATES = ("uses_edition", "realizes", "in_edition", "implemented_by", "uses_definition", "includes_codes", "applies_to", "application_scope_complete", "same_benefit_as", "scope_relation", "has_condition", "same_duration_as")
_NAMES = ", ".join(f"'{p}'" for p in PREDICATES)

#: One text for both engines: columns of claims over b (k, m, cust, part, supp, day).
CLAIM = f"""
 concat('a', k) AS id, element_at(array({_NAMES}), cast(k % 12 AS int) + 1) AS predicate,
 CASE WHEN k % 12 IN (0, 7) THEN concat('sc:', cust % 600) WHEN k % 12 = 1 THEN concat('seg:', cust % 600) WHEN k % 12 IN (2, 3, 4, 8, 10) THEN concat('cov:', part % 600)
  WHEN k % 12 IN (5, 9) THEN concat('cat:', part % 25) WHEN k % 12 = 6 THEN concat('ed:', supp % 40) ELSE concat('cond:', part % 50) END AS subject,
 CASE WHEN k % 12 IN (0, 2) THEN CASE WHEN m % 29 <> 3 THEN concat('ed:', supp % 40) END WHEN k % 12 = 1 THEN concat('ed:', CASE WHEN m % 60 = 1 THEN supp % 40 ELSE cust % 600 % 40 END)
  WHEN k % 12 = 4 THEN concat('cat:', cust % 25) WHEN k % 12 = 5 THEN concat(CASE WHEN m % 3 = 0 THEN 'cat:' ELSE 'set:' END, cust % 25) WHEN k % 12 IN (6, 8) THEN concat('cov:', cust % 600)
  WHEN k % 12 = 9 THEN concat('cat:', (part + 1 + m % 3) % 25) WHEN k % 12 IN (10, 11) THEN concat('cond:', cust % 50) END AS object,
 CASE WHEN k % 12 = 7 THEN CASE WHEN m % 2 = 0 THEN 'true' ELSE 'false' END WHEN k % 12 = 9 THEN CASE m % 4 WHEN 0 THEN 'broader' WHEN 1 THEN 'same_scope' ELSE 'narrower' END END AS value,
 CASE WHEN m % 9 = 0 THEN 'C0' ELSE 'C2' END AS criticality, (m % 17 <> 3 OR (m % 9 = 0 AND m % 1224 <> 54)) AS accepted, CASE WHEN m % 70 = 4 THEN 'import' WHEN m % 5 = 0 THEN 'fixture_assumption' ELSE 'review_decision' END AS decided_by,
 CASE WHEN m % 2 = 1 THEN concat('fp:', cust % 600 % 40 + 40) END AS covers, CASE WHEN m % 13 = 6 THEN 'fixture' ELSE 'extracted' END AS origin, CASE WHEN m % 2 = 0 THEN 'observed' ELSE 'derived' END AS value_state,
 CASE WHEN m % 4 <> 0 THEN day END AS valid_from, CASE WHEN m % 3 <> 0 THEN date_add(day, cast(m % 900 - 20 AS int)) END AS valid_to,
 CASE WHEN m % 10 = 9 THEN concat('a', k - 12) WHEN m % 20 = 10 THEN concat('a', k - 24) END AS supersedes, CASE WHEN k % 12 = 3 AND m % 11 <> 3 THEN concat('rules/r', m % 40, '.json') END AS rule_path,
 CASE WHEN k % 12 = 3 AND m % 3 <> 0 THEN array(concat('ed:', supp % 40), concat('ed:', (supp + 7) % 40)) END AS covers_editions, concat('clause:', part) AS basis, CASE WHEN m % 3 <> 1 THEN TRUE ELSE FALSE END AS observed"""


def _duck(text: str) -> str:
    """The shared text with the few functions that the other engine names differently."""
    return text.replace("element_at(array(", "list_extract(list_value(").replace("array(concat", "list_value(concat").replace("date_add(day, cast(m % 900 - 20 AS int))", "day + cast(m % 900 - 20 AS int)")


BASE = """b AS (SELECT o_orderkey AS k, o_orderkey // 12 AS m, o_custkey AS cust, coalesce(p, 0) AS part, coalesce(s, 0) AS supp, CAST(o_orderdate AS DATE) AS day FROM orders
 LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
LIVE = f"{BASE}, a AS (SELECT {_duck(CLAIM)} FROM b), live AS (SELECT * FROM a WHERE id NOT IN (SELECT supersedes FROM a WHERE supersedes IS NOT NULL))"


def base(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    o = read(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.selectExpr("o_orderkey AS k", "o_orderkey div 12 AS m", "o_custkey AS cust", "coalesce(p, 0) AS part", "coalesce(s, 0) AS supp", "to_date(o_orderdate) AS day")


def claims(spark, sf_dir, numbers=None):
    """All claims, read off the numbers of base or of a table of them."""
    rows = (base(spark, sf_dir) if numbers is None else numbers).selectExpr(*_columns(CLAIM))
    evidence = F.concat(F.array(F.struct(F.lit("basis").alias("role"), F.col("basis").alias("target"))), F.when(F.col("observed"), F.array(F.struct(F.lit("observation").alias("role"), F.col("subject").alias("target")))).otherwise(F.expr("cast(array() as array<struct<role string, target string>>)")))
    return rows.withColumn("evidence", evidence).drop("basis", "observed")


def _columns(text: str) -> list[str]:
    """The comma-separated columns of a text, apart at commas outside brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


SEGMENTS = "seg AS (SELECT DISTINCT concat('seg:', c_custkey % 600) AS segment, list_extract(list_value('terms', 'rider_terms', 'annex', 'summary'), CAST(c_custkey % 600 % 4 AS INT) + 1) AS doc_role, CASE WHEN c_custkey % 600 % 3 = 2 THEN 'fp-0.2' ELSE 'fp-0.1' END AS rule, CASE WHEN c_custkey % 600 % 200 <> 5 THEN concat('fp:', CASE WHEN c_custkey % 600 % 50 = 7 THEN 99 ELSE c_custkey % 600 % 40 END) END AS sha256 FROM customer)"
EDITIONS = "ed AS (SELECT DISTINCT concat('ed:', s_suppkey % 40) AS edition, s_suppkey % 40 AS e FROM supplier), part_of AS (SELECT edition, r.rule, concat('fp:', e) AS sha256 FROM ed, (VALUES ('fp-0.1'), ('fp-0.2')) r(rule) UNION ALL SELECT edition, 'fp-0.1', concat('fp:', e + 40) FROM ed WHERE e % 3 = 0)"


def segments(spark, sf_dir):
    i = F.col("c_custkey") % 600
    role = F.element_at(F.array(*map(F.lit, ("terms", "rider_terms", "annex", "summary"))), (i % 4 + 1).cast("int"))
    sha = F.when(i % 200 != 5, F.concat(F.lit("fp:"), F.when(i % 50 == 7, 99).otherwise(i % 40).cast("string")))
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("seg:"), i.cast("string")).alias("segment"), role.alias("doc_role"), F.when(i % 3 == 2, "fp-0.2").otherwise("fp-0.1").alias("rule"), sha.alias("sha256")).distinct()


def editions(spark, sf_dir):
    e = F.col("s_suppkey") % 40
    part = lambda rule, n: F.struct(F.lit(rule).alias("rule"), F.concat(F.lit("fp:"), n.cast("string")).alias("sha256"))
    parts = F.concat(F.array(part("fp-0.1", e), part("fp-0.2", e)), F.when(e % 3 == 0, F.array(part("fp-0.1", e + 40))).otherwise(F.array().cast("array<struct<rule string, sha256 string>>")))
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("ed:"), e.cast("string")).alias("edition"), parts.alias("parts")).distinct()


def clauses(spark, sf_dir):
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.concat(F.lit("clause:"), p.cast("string")).alias("clause"), F.concat(F.lit("seg:"), (p % 600).cast("string")).alias("segment"))


TERMS = f"{LIVE}, {SEGMENTS}, tied AS (SELECT subject, arg_max(object, id) AS edition FROM live WHERE predicate = 'realizes' AND accepted AND object IS NOT NULL GROUP BY 1), terms AS (SELECT concat('clause:', p_partkey) AS clause, edition FROM part JOIN seg ON segment = concat('seg:', p_partkey % 600) JOIN tied ON subject = segment WHERE doc_role <> 'summary')"


def kept(df):
    """df as a table in the shared folder."""
    return graph.Scratch(df.sparkSession).keep(df)


class Store:
    """What checks of one store read, each made when it is first asked for and once for all of them."""

    def __init__(self, spark, sf_dir):
        self.at = spark, sf_dir

    @cached_property
    def numbers(self):
        return kept(base(*self.at))

    @cached_property
    def claims(self):
        return claims(*self.at, self.numbers)

    @cached_property
    def live(self):
        return live_of(*self.at, self.numbers)

    @cached_property
    def terms(self):
        return kept(knowledge.terms_clauses(clauses(*self.at), segments(*self.at), self.live))

    @cached_property
    def scope(self):
        return scope_of(*self.at, self.live)

    @cached_property
    def allowed(self):
        return knowledge.simulate_allowed(self.live, self.scope, conflicts(*self.at))


def live_of(spark, sf_dir, numbers=None):
    """The live claims, read off a table of their numbers, which take less room than their texts."""
    numbers = kept(base(spark, sf_dir)) if numbers is None else numbers
    named = numbers.selectExpr("*", *[c for c in _columns(CLAIM) if c.endswith((" AS id", " AS supersedes"))])
    return claims(spark, sf_dir, kept(knowledge.live_claims(named).select(*numbers.columns)))


@query(f"WITH {TERMS} SELECT clause, edition FROM terms")
def terms_clauses(spark, sf_dir):
    return knowledge.terms_clauses(clauses(spark, sf_dir), segments(spark, sf_dir), live_of(spark, sf_dir))


STATUS = f"""{TERMS}, {EDITIONS}, r AS (SELECT l.id, l.object AS edition, s.sha256, s.rule, decided_by, EXISTS (SELECT 1 FROM part_of p WHERE p.edition = l.object AND p.sha256 = s.sha256 AND p.rule = s.rule) AS equal,
  CASE WHEN decided_by = 'review_decision' THEN covers END AS reviewed FROM live l JOIN seg s ON s.segment = l.subject JOIN ed ON ed.edition = l.object WHERE predicate = 'realizes' AND accepted),
 bad AS (SELECT edition, id, CASE WHEN sha256 IS NOT NULL THEN 'content_difference_candidate' ELSE 'not_comparable' END AS kind FROM r WHERE NOT equal AND reviewed IS NULL),
 gap AS (SELECT DISTINCT p.edition, p.sha256, p.rule FROM part_of p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.edition = p.edition AND (CASE WHEN equal THEN r.sha256 ELSE reviewed END) = p.sha256)),
 st0 AS (SELECT edition, (SELECT count(*) FROM r WHERE r.edition = ed.edition) AS accepted, (SELECT count(*) FROM gap WHERE gap.edition = ed.edition) AS n_missing,
  (SELECT count(*) FROM bad WHERE bad.edition = ed.edition) AS n_bad, (SELECT count(*) FROM r WHERE r.edition = ed.edition AND decided_by = 'import') AS n_import FROM ed),
 st AS (SELECT edition, accepted, n_missing, accepted > 0 AND n_missing = 0 AND n_bad = 0 AND n_import = 0 AS ok FROM st0)"""


def status_of(spark, sf_dir, live):
    return knowledge.edition_status(editions(spark, sf_dir), segments(spark, sf_dir), live)


@query(f"WITH {STATUS} SELECT edition, accepted, n_missing AS missing, CASE WHEN ok THEN 'confirmed' ELSE 'identity_unconfirmed' END AS state FROM st")
def edition_status(spark, sf_dir):
    """Editions by how their segments' fingerprints cover them."""
    status, _ = status_of(spark, sf_dir, live_of(spark, sf_dir))
    return status.select("edition", "accepted", F.size("missing").cast("bigint").alias("missing"), "state")


SCOPE = """ inner_ AS (SELECT subject AS src, object AS dst FROM live WHERE predicate = 'includes_codes' AND object LIKE 'cat:%'),
 scope AS (SELECT DISTINCT subject AS coverage, subject AS node FROM live WHERE subject LIKE 'cov:%' UNION SELECT subject, object FROM live WHERE predicate = 'uses_definition' AND object IS NOT NULL
  UNION SELECT scope.coverage, dst FROM scope JOIN inner_ ON src = node WHERE node LIKE 'cat:%')"""


def scope_of(spark, sf_dir, live):
    categories = read(spark, sf_dir, "nation").select(F.concat(F.lit("cat:"), F.col("n_nationkey").cast("string")).alias("node"))
    return cut(knowledge.coverage_scope(live, categories))


@query(f"WITH RECURSIVE {LIVE}, {SCOPE} SELECT coverage, node FROM scope")
def coverage_scope(spark, sf_dir):
    return scope_of(spark, sf_dir, live_of(spark, sf_dir))


CONFLICTS = "conflict AS (SELECT concat('a', 12 * (20 * c_custkey + 9) + c_custkey % 12) AS x, concat('a', 12 * (20 * c_custkey + 10) + c_custkey % 12) AS y, CASE WHEN c_custkey % 4 = 0 THEN 'resolved' ELSE 'open' END AS state FROM customer WHERE c_custkey % 2 = 0)"


def conflicts(spark, sf_dir):
    c = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("a"), (12 * (20 * c + n) + c % 12).cast("string"))
    return read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.array(name(9), name(10)).alias("listed"), F.when(c % 4 == 0, "resolved").otherwise("open").alias("state"))


ALLOWED = f"""{SCOPE}, {CONFLICTS}, allow AS (SELECT coverage, (SELECT count(DISTINCT l.id) FROM live l JOIN scope s ON s.node = l.subject WHERE s.coverage = c.coverage AND criticality = 'C0' AND NOT accepted) AS held,
  NOT EXISTS (SELECT 1 FROM live l WHERE l.subject = c.coverage AND predicate = 'implemented_by' AND accepted) AS no_rule,
  EXISTS (SELECT 1 FROM live l JOIN conflict f ON l.id IN (f.x, f.y) WHERE l.subject = c.coverage AND f.state <> 'resolved') AS in_conflict FROM (SELECT DISTINCT coverage FROM scope) c)"""


@query(f"WITH RECURSIVE {LIVE}, {ALLOWED} SELECT coverage, held, no_rule, in_conflict, held = 0 AND NOT no_rule AND NOT in_conflict AS allowed FROM allow")
def simulate_allowed(spark, sf_dir):
    return Store(spark, sf_dir).allowed


CHAIN = f"""{STATUS}, {ALLOWED},
 q AS (SELECT k AS request, day, concat('cov:', part % 600) AS coverage, cust, k FROM b),
 cand AS (SELECT request, concat('sc:', cust % 600) AS config FROM q UNION SELECT request, concat('sc:', (cust + 1) % 600) FROM q WHERE k % 25 = 0),
 hit AS (SELECT q.request, q.coverage, config, object AS edition, accepted FROM q JOIN cand USING (request) JOIN live ON subject = config AND predicate = 'uses_edition' WHERE (valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR day <= valid_to)),
 u AS (SELECT request, count(DISTINCT config) AS configs, min(config) AS config, bool_or(edition IS NULL) AS so, bool_or(NOT accepted) AS ua, count(DISTINCT edition) AS n_ed FROM hit GROUP BY 1),
 d AS (SELECT request, count(DISTINCT h.edition) AS found, min(h.edition) AS edition, bool_or(NOT h.accepted) AS lo FROM hit h WHERE EXISTS (SELECT 1 FROM live l WHERE l.predicate = 'in_edition' AND l.accepted AND l.subject = h.coverage AND l.object = h.edition) GROUP BY 1),
 rl AS (SELECT subject, id, rule_path, covers_editions FROM live WHERE predicate = 'implemented_by' AND accepted QUALIFY row_number() OVER (PARTITION BY subject ORDER BY id) = 1),
 df AS (SELECT subject, object FROM live WHERE predicate = 'uses_definition' QUALIFY row_number() OVER (PARTITION BY subject ORDER BY id) = 1),
 ap AS (SELECT object, bool_or(NOT accepted) AS pending, list(DISTINCT subject) AS froms FROM live WHERE predicate = 'applies_to' GROUP BY 1),
 co AS (SELECT DISTINCT subject FROM live WHERE predicate = 'application_scope_complete' AND accepted AND value = 'true'),
 chain AS (SELECT q.request, u.config, d.edition, df.object AS category, rl.id AS rule_claim, rl.rule_path, CASE
  WHEN u.request IS NULL THEN 'no_uses_edition' WHEN configs > 1 THEN 'multiple_candidates' WHEN so THEN 'scope_unknown'
  WHEN d.request IS NULL THEN CASE WHEN ua THEN 'link_unapproved' ELSE 'cov_not_in_edition' END
  WHEN found > 1 THEN 'competing_editions' WHEN lo THEN 'link_unapproved' WHEN NOT st.ok THEN 'edition_identity_unconfirmed' WHEN pending THEN 'application_scope_unverified'
  WHEN len(list_filter(froms, lambda f: NOT list_contains(coalesce(rl.covers_editions, list_value(d.edition)), f))) > 0 THEN 'applies_from_other_edition_unmodeled'
  WHEN n_ed > 1 AND co.subject IS NULL THEN 'application_scope_unverified'
  WHEN allow.coverage IS NULL OR (allow.no_rule AND allow.held = 0 AND NOT allow.in_conflict) THEN 'no_rule' WHEN allow.no_rule OR allow.held > 0 OR allow.in_conflict THEN 'simulate_blocked'
  WHEN rl.rule_path IS NULL THEN 'no_rule' ELSE 'linked' END AS outcome
  FROM q LEFT JOIN u USING (request) LEFT JOIN d ON d.request = q.request LEFT JOIN st ON st.edition = d.edition LEFT JOIN ap ON ap.object = q.coverage LEFT JOIN rl ON rl.subject = q.coverage
  LEFT JOIN df ON df.subject = q.coverage LEFT JOIN co ON co.subject = u.config LEFT JOIN allow ON allow.coverage = q.coverage)"""


def chain(spark, sf_dir):
    store = Store(spark, sf_dir)
    live, b = store.live, store.numbers
    requests = b.select(F.col("k").alias("request"), "day", F.concat(F.lit("cov:"), (F.col("part") % 600).cast("string")).alias("coverage"), "cust")
    config = lambda n: F.concat(F.lit("sc:"), ((F.col("cust") + n) % 600).cast("string")).alias("config")
    candidates = requests.select("request", config(0)).union(requests.where("request % 25 = 0").select("request", config(1)))
    status, _ = status_of(spark, sf_dir, live)
    return knowledge.resolve_chain(requests.drop("cust"), candidates, live, status.where("state = 'confirmed'"), store.allowed)


@query(f"WITH RECURSIVE {CHAIN} SELECT request, outcome, CASE WHEN outcome = 'linked' THEN config END AS config, CASE WHEN outcome = 'linked' THEN edition END AS edition, CASE WHEN outcome = 'linked' THEN category END AS category, CASE WHEN outcome = 'linked' THEN rule_claim END AS rule_claim, CASE WHEN outcome = 'linked' THEN rule_path END AS rule_path FROM chain")
def link_chain(spark, sf_dir):
    """Every order as a request for its part's coverage on its day: linked to a rule, or the reason why not."""
    return chain(spark, sf_dir)


@query(f"WITH RECURSIVE {CHAIN} SELECT request, CASE outcome WHEN 'simulate_blocked' THEN 'link_unapproved' ELSE outcome END AS outcome FROM chain")
def resolve_request(spark, sf_dir):
    return knowledge.resolve_request(chain(spark, sf_dir)).select("request", "outcome")


@query(f"""WITH {TERMS}, n AS (SELECT id, count(DISTINCT edition) AS n FROM live LEFT JOIN terms ON clause = basis GROUP BY 1)
SELECT 'K1' AS code, id AS subject, CASE WHEN predicate IN ('in_edition', 'uses_edition', 'realizes') THEN 'no_observation' ELSE 'no_basis' END AS message FROM live JOIN n USING (id)
 WHERE criticality = 'C0' AND accepted AND CASE WHEN predicate IN ('in_edition', 'uses_edition', 'realizes') THEN NOT observed ELSE n = 0 END
UNION ALL SELECT 'K2', id, 'needs_two_editions' FROM live JOIN n USING (id) WHERE predicate = 'same_benefit_as' AND n < 2""")
def check_evidence(spark, sf_dir, store=None):
    """K1 and K2."""
    store = store or Store(spark, sf_dir)
    return knowledge.check_evidence(store.live, store.terms)


NODES = """node AS (SELECT concat('set:', n_nationkey) AS node, 'CodeSet' AS class, CASE WHEN n_nationkey % 4 <> 1 THEN 'kcd' END AS code_system, CASE WHEN n_nationkey % 7 <> 2 THEN '8' END AS edition, n_name AS effective, CASE WHEN n_nationkey % 5 <> 3 THEN 'x' END AS judged_as_of, NULL AS anchor, NULL AS unit, NULL AS kind, NULL AS text, 0 AS targets FROM nation
 UNION ALL SELECT DISTINCT concat('cond:', p_partkey % 50), 'Condition', NULL, NULL, NULL, NULL, list_extract(list_value('contract_date', 'diagnosis_date', 'moon'), CAST(p_partkey % 50 % 3 AS INT) + 1), list_extract(list_value('day', 'calendar_month', 'calendar_year', 'week'), CAST(p_partkey % 50 % 4 AS INT) + 1),
  CASE WHEN p_partkey % 50 % 2 = 0 THEN 'reduction' ELSE 'waiting' END, CASE WHEN p_partkey % 50 % 6 = 0 THEN 'none' ELSE 'half' END, CASE WHEN p_partkey % 50 % 8 < 4 THEN 1 ELSE 0 END FROM part)"""


def nodes(spark, sf_dir):
    k, c = F.col("n_nationkey"), F.col("p_partkey") % 50
    none = F.lit(None).cast("string")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    sets = read(spark, sf_dir, "nation").select(F.concat(F.lit("set:"), k.cast("string")).alias("node"), F.lit("CodeSet").alias("class"), F.when(k % 4 != 1, "kcd").alias("code_system"), F.when(k % 7 != 2, "8").alias("edition"), F.col("n_name").alias("effective"), F.when(k % 5 != 3, "x").alias("judged_as_of"), *[none.alias(n) for n in ("anchor", "unit", "kind", "text")], F.lit(None).cast("array<string>").alias("applies_to"))
    conds = read(spark, sf_dir, "part").select(F.concat(F.lit("cond:"), c.cast("string")).alias("node"), F.lit("Condition").alias("class"), *[none.alias(n) for n in ("code_system", "edition", "effective", "judged_as_of")], pick(("contract_date", "diagnosis_date", "moon"), c % 3).alias("anchor"), pick(("day", "calendar_month", "calendar_year", "week"), c % 4).alias("unit"), F.when(c % 2 == 0, "reduction").otherwise("waiting").alias("kind"), F.when(c % 6 == 0, "none").otherwise("half").alias("text"), F.when(c % 8 < 4, F.array(F.lit("all"))).otherwise(F.array().cast("array<string>")).alias("applies_to"))
    return sets.unionByName(conds.distinct())


@query(f"""WITH {LIVE}, {NODES}
SELECT 'K3' AS code, node AS subject, 'lacks ' || f AS message FROM (SELECT node, unnest(list_value(CASE WHEN code_system IS NULL THEN 'code_system' END, CASE WHEN edition IS NULL THEN 'edition' END, CASE WHEN judged_as_of IS NULL THEN 'judged_as_of' END)) AS f FROM node WHERE class = 'CodeSet') WHERE f IS NOT NULL
UNION ALL SELECT 'K5', id, 'ends_before_start' FROM a WHERE valid_from > valid_to UNION ALL SELECT 'K5', node, 'unknown_anchor' FROM node WHERE anchor = 'moon' UNION ALL SELECT 'K6', node, 'unknown_unit' FROM node WHERE unit = 'week'
UNION ALL SELECT 'K6', id, 'units_differ' FROM live JOIN node x ON x.node = subject JOIN node y ON y.node = object WHERE predicate = 'same_duration_as' AND x.unit <> y.unit
UNION ALL SELECT 'K7', id, 'no_target' FROM live JOIN node ON node = object WHERE predicate = 'has_condition' AND value_state = 'observed' AND kind = 'reduction' AND text <> 'none' AND targets = 0""")
def check_nodes(spark, sf_dir, store=None):
    """K3, K5, K6 and K7."""
    store = store or Store(spark, sf_dir)
    return knowledge.check_nodes(nodes(spark, sf_dir), store.claims, store.live, ("contract_date", "diagnosis_date"))


@query(f"""WITH RECURSIVE {LIVE}, e AS (SELECT DISTINCT CASE value WHEN 'narrower' THEN subject ELSE object END AS src, CASE value WHEN 'narrower' THEN object ELSE subject END AS dst FROM live WHERE predicate = 'scope_relation' AND value <> 'same_scope'),
 t AS (SELECT src AS root, dst AS node FROM e UNION SELECT root, dst FROM t JOIN e ON node = src) SELECT root AS node FROM t WHERE root = node""")
def check_scope_cycles(spark, sf_dir, store=None):
    """K4."""
    return graph.on_cycles(knowledge.scope_edges((store or Store(spark, sf_dir)).live))


REFS = "refs AS (SELECT concat('rules/r', r, '.json') AS rule_path, list_value(concat('clause:', r * 3), concat('clause:', r * 5)) AS refs FROM (SELECT DISTINCT s_suppkey % 39 AS r FROM supplier))"


@query(f"""WITH RECURSIVE {LIVE}, {SCOPE}, {REFS}, bs AS (SELECT coverage, list(DISTINCT basis) AS bases FROM scope JOIN live ON subject = node WHERE criticality = 'C0' AND accepted GROUP BY 1),
 w AS (SELECT id, subject, l.rule_path, refs, list_filter(refs, lambda x: NOT list_contains(coalesce(bases, []), x)) AS beyond FROM live l LEFT JOIN refs ON refs.rule_path = l.rule_path LEFT JOIN bs ON bs.coverage = l.subject WHERE predicate = 'implemented_by' AND accepted)
SELECT 'K9' AS code, id AS subject, CASE WHEN rule_path IS NULL THEN 'no_rule_path' WHEN refs IS NULL THEN 'no_rule_file' ELSE 'beyond ' || array_to_string(list_sort(list_distinct(beyond)), ',') END AS message FROM w WHERE rule_path IS NULL OR refs IS NULL OR len(beyond) > 0""")
def check_rules(spark, sf_dir, store=None):
    """K9."""
    store, r = store or Store(spark, sf_dir), F.col("s_suppkey") % 39
    clause = lambda n: F.concat(F.lit("clause:"), n.cast("string"))
    refs = read(spark, sf_dir, "supplier").select(F.concat(F.lit("rules/r"), r.cast("string"), F.lit(".json")).alias("rule_path"), F.array(clause(r * 3), clause(r * 5)).alias("refs")).distinct()
    return knowledge.check_rules(store.live, store.scope, refs)


@query(f"WITH {BASE}, a AS (SELECT {_duck(CLAIM)} FROM b), {CONFLICTS}, f AS (SELECT supersedes AS t, min(id) AS i, max(id) AS j FROM a WHERE supersedes IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) > 1) SELECT 'K10' AS code, t AS subject, 'fork' AS message FROM f WHERE NOT EXISTS (SELECT 1 FROM conflict c WHERE (c.x, c.y) IN ((i, j), (j, i)))")
def check_forks(spark, sf_dir, store=None):
    """K10."""
    return knowledge.check_forks(store.claims if store else claims(spark, sf_dir), conflicts(spark, sf_dir))


@query(f"WITH RECURSIVE {LIVE}, {ALLOWED} SELECT DISTINCT 'K11' AS code, concat('cov:', p_partkey % 600) AS subject, 'not_allowed' AS message FROM part LEFT JOIN allow ON coverage = concat('cov:', p_partkey % 600) WHERE p_partkey % 600 % 3 = 0 AND (coverage IS NULL OR held > 0 OR no_rule OR in_conflict)")
def check_enabled(spark, sf_dir, store=None):
    """K11, every third coverage being declared enabled."""
    declared = read(spark, sf_dir, "part").where("p_partkey % 600 % 3 = 0").select(F.concat(F.lit("cov:"), (F.col("p_partkey") % 600).cast("string")).alias("coverage"), F.lit("enabled").alias("capability")).distinct()
    return knowledge.check_enabled(declared, (store or Store(spark, sf_dir)).allowed)


@query("""WITH p AS (SELECT p_partkey, unnest(list_value(CASE WHEN p_size % 5 = 0 THEN 'conditions' END, CASE WHEN p_size % 7 = 0 THEN 'package_binding' END, CASE WHEN p_size % 11 = 0 THEN 'as_of' END)) AS f FROM part WHERE p_partkey % 2 = 0) SELECT 'K13' AS code, p_partkey AS subject, 'lacks ' || f AS message FROM p WHERE f IS NOT NULL""")
def check_prices(spark, sf_dir):
    """K13 over parts, every second of which may be compared."""
    n = F.col("p_size")
    prices = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 2 == 0).alias("eligible"), F.when(n % 5 == 0, F.when(n % 2 == 0, F.expr("cast(map() as map<string, string>)"))).otherwise(F.create_map(F.lit("age"), F.lit("40"))).alias("conditions"), F.when(n % 7 != 0, F.col("p_brand")).alias("binding"), F.when(n % 11 != 0, F.lit("2026-01-01")).alias("as_of"))
    return knowledge.check_prices(prices)


@query(f"""WITH {TERMS} SELECT 'K14' AS code, id AS subject, CASE WHEN sha256 IS NULL THEN 'no_fingerprint' WHEN NOT observed THEN 'no_observation' ELSE 'not_reviewed' END AS message FROM live LEFT JOIN seg ON segment = subject WHERE predicate = 'realizes' AND accepted AND (sha256 IS NULL OR NOT observed OR decided_by = 'import')""")
def check_realized(spark, sf_dir, store=None):
    """K14."""
    return knowledge.check_realized((store or Store(spark, sf_dir)).live, segments(spark, sf_dir))


@query(f"WITH {STATUS} SELECT 'K16' AS code, id AS subject, kind AS message FROM bad UNION ALL SELECT 'K16', edition, 'uncovered ' || n_missing FROM st WHERE accepted > 0 AND n_missing > 0")
def check_editions(spark, sf_dir, store=None):
    """K16."""
    return knowledge.check_editions(*status_of(spark, sf_dir, (store or Store(spark, sf_dir)).live))


@query(f"WITH {BASE}, a AS (SELECT {_duck(CLAIM)} FROM b) SELECT 'KP' AS code, id AS subject, CASE WHEN origin = 'fixture' THEN 'fixture' ELSE 'fixture_assumption' END AS message FROM a WHERE accepted AND (origin = 'fixture' OR decided_by = 'fixture_assumption')")
def check_service(spark, sf_dir, store=None):
    """KP."""
    return knowledge.check_service(store.claims if store else claims(spark, sf_dir))


@query("""WITH s AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS d FROM documents WHERE doc_id % 13 <> 4), l AS (SELECT doc_id AS id, sha256(coalesce(text, '') || CASE WHEN doc_id % 17 = 3 THEN 'x' ELSE '' END) AS d FROM documents)
SELECT 'K15' AS code, l.id AS subject, CASE WHEN s.id IS NULL THEN 'missing_member' ELSE 'hash_differs' END AS message FROM l LEFT JOIN s ON s.id = l.id WHERE s.id IS NULL OR s.d <> l.d""")
def check_release(spark, sf_dir):
    """K15: a release of all documents against a store that lost every 13th, some having been another text."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    d = read(spark, sf_dir, "documents")
    listed = d.select(F.lit("r").alias("release"), i.alias("id"), F.sha2(F.concat(text, F.when(i % 17 == 3, "x").otherwise("")), 256).alias("digest"))
    return knowledge.check_release(listed, d.where("doc_id % 13 <> 4").select(i.alias("id"), F.sha2(text, 256).alias("digest")))


@query("""WITH m AS (SELECT o_custkey AS release, o_custkey % 2 = 0 AS production, CASE WHEN o_custkey % 3 = 0 THEN list_sort(list(DISTINCT o_orderkey)) ELSE list_reverse(list_sort(list(DISTINCT o_orderkey))) END AS members FROM orders GROUP BY 1, 2), e AS (SELECT release, production, unnest(members) AS id FROM m)
SELECT 'KM' AS code, release AS subject, 'not_sorted' AS message FROM m WHERE list_sort(list_distinct(members)) <> members UNION ALL SELECT 'KM', release, 'not_stored ' || id FROM e WHERE id % 9 = 8 UNION ALL SELECT 'KM', release, 'fixture ' || id FROM e WHERE production AND id % 9 <> 8 AND id % 7 = 0""")
def check_manifest(spark, sf_dir):
    """KM: every customer's orders as a release's members, two of three listed backwards."""
    o = read(spark, sf_dir, "orders")
    sorted_ = F.array_sort(F.collect_set("o_orderkey"))
    manifest = o.groupBy(F.col("o_custkey").alias("release")).agg(F.when(F.first("o_custkey") % 3 == 0, sorted_).otherwise(F.reverse(sorted_)).alias("members")).withColumn("production", F.col("release") % 2 == 0)
    return knowledge.check_manifest(manifest, o.where("o_orderkey % 9 <> 8").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7 == 0).alias("fixture")))


@query(f"""WITH {LIVE}, rel AS (SELECT concat('cat:', a) AS a, concat('cat:', b) AS b, relation FROM ({_SQL['scope_relation']})), w AS (SELECT id, value, accepted, coalesce(relation, 'not_comparable') AS relation FROM live LEFT JOIN rel ON a = subject AND b = object WHERE predicate = 'scope_relation' AND object IS NOT NULL)
SELECT 'K12' AS code, id AS subject, CASE WHEN relation = 'not_comparable' THEN 'accepted_without_comparison' ELSE 'computed ' || relation END AS message FROM w WHERE CASE WHEN relation = 'not_comparable' THEN accepted ELSE relation IS DISTINCT FROM value END""")
def check_scope_claims(spark, sf_dir, store=None):
    """K12: claimed relations of categories against those computed over all codes; categories that are no region's can't be compared."""
    name = lambda c: F.concat(F.lit("cat:"), F.col(c).cast("string")).alias(c)
    return knowledge.check_scope_claims((store or Store(spark, sf_dir)).live, scope_relation(spark, sf_dir).select(name("a"), name("b"), "relation"))


@query(f"SELECT 'K8' AS code, CASE WHEN doc_id IS NULL THEN 'conv:' || conv_id || ':' || turn ELSE 'doc:' || doc_id END AS subject, 'private_id' AS message FROM ({_SQL['private_id_scan_all']})")
def check_private(spark, sf_dir):
    """K8: turns and documents whose text holds a private id."""
    subject = F.when(F.col("doc_id").isNull(), F.concat_ws(":", F.lit("conv"), "conv_id", "turn")).otherwise(F.concat_ws(":", F.lit("doc"), "doc_id"))
    return private_id_scan_all(spark, sf_dir).select(F.lit("K8").alias("code"), subject.alias("subject"), F.lit("private_id").alias("message"))


def _levels(top: int) -> str:
    """The nodes of prefixes from `top` digits down, written out."""
    return "".join(f""",
 t{n} AS (SELECT release, substr(prefix, 1, {n}) AS prefix, depth, sha256(string_agg(prefix || chr(31) || h, chr(30) ORDER BY prefix)) AS h, sum(n) AS n FROM t{n + 1} GROUP BY 1, 2, 3 UNION ALL SELECT * FROM leaf WHERE length(prefix) = {n})""" for n in range(top - 1, -1, -1))


@query(f"""WITH m AS (SELECT source AS release, '=documents' || chr(31) || coalesce('=' || doc_id, '-') AS k, sha256(coalesce(text, chr(0)) || '|' || coalesce(lang, chr(0))) AS d FROM documents),
 z AS (SELECT release, CASE WHEN count(*) <= 16 THEN 0 WHEN count(*) <= 256 THEN 1 WHEN count(*) <= 4096 THEN 2 ELSE 3 END AS depth FROM m GROUP BY 1),
 leaf AS (SELECT release, substr(sha256(k), 1, depth) AS prefix, depth, sha256(string_agg(k || chr(31) || '=' || d, chr(30) ORDER BY sha256(k))) AS h, count(*) AS n FROM m JOIN z USING (release) GROUP BY 1, 2, 3),
 t3 AS (SELECT * FROM leaf WHERE length(prefix) = 3){_levels(3)}
SELECT release, CAST(n AS BIGINT) AS members, depth, h AS members_sha256, sha256(h || chr(30) || sha256('')) AS content_sha256 FROM t0""")
def release_tree(spark, sf_dir):
    """Every source's documents as a release, hashed as a tree of as many levels as it needs for 16 members a leaf."""
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("release"), F.lit("documents").alias("section"), F.col("doc_id").alias("id"), doc_hash().alias("digest"))
    nodes = releases.tree(rows, 16)
    return releases.frozen(nodes).join(nodes.where("prefix = '' AND tree = 'members'").select("release", "depth"), "release").select("release", "members", "depth", "members_sha256", "content_sha256")


@query("""WITH d AS (SELECT source, doc_id FROM documents), r AS (SELECT source, count(*) FILTER (doc_id % 131 = 4) AS lost, count(*) FILTER (doc_id % 173 = 3) AS changed, count(*) FILTER (doc_id % 199 = 8) AS ruled FROM d GROUP BY 1)
SELECT 'K15' AS code, doc_id::VARCHAR AS subject, 'missing_member' AS message FROM d WHERE doc_id % 131 = 4
UNION ALL SELECT 'K15', source, CASE WHEN ruled > 0 THEN 'rule_hash_differs' ELSE 'content_hash_differs' END FROM r WHERE ruled > 0 OR lost > 0 OR changed > 0""")
def check_release_tree(spark, sf_dir):
    """K15: sources as frozen releases with a rule file for every document, against a store that lost some documents, changed some and some rule files."""
    i, d = F.col("doc_id"), read(spark, sf_dir, "documents")
    member = lambda changed: d.select(F.col("source").alias("release"), F.lit("documents").alias("section"), i.cast("string").alias("id"), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(changed, "x").otherwise("")), 256).alias("digest"))
    rule = lambda changed: d.select(F.col("source").alias("release"), F.lit(releases.RULES).alias("section"), F.concat(F.lit("rules/"), i, F.lit(".json")).alias("id"), F.sha2(F.concat(i.cast("string"), F.when(changed, "x").otherwise("")), 256).alias("digest"))
    no = F.lit(False)
    before = member(no).unionByName(rule(no))
    now = member(i % 173 == 3).where("CAST(id AS BIGINT) % 131 <> 4").unionByName(rule(i % 199 == 8)).drop("release")
    return releases.integrity(releases.tree(before, 16), before, now).drop("release")
