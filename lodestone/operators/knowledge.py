"""Claims with evidence: editions, scopes, constraint checks and the chain from a request to a rule.

Claims are rows (id, subject, predicate, object, value, criticality, accepted, status, decided_by, covers,
origin, value_state, valid_from, valid_to, supersedes, rule_path, covers_editions ARRAY<STRING>,
evidence ARRAY<STRUCT<role, target>>).  Every check gives (code, subject, message).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import Scratch, closure
from lodestone.operators.history import between_changes, current, in_force, merged
from lodestone.operators.links import first_reason

#: Roles of documents that hold terms, claims about structure, anchors and duration units.
TERMS_ROLES = ("terms", "rider_terms", "annex")
STRUCTURAL = ("in_edition", "uses_edition", "realizes")
UNITS = ("day", "calendar_month", "calendar_year")
DECIDED = ("review_decision", "fixture_assumption")


def claims_of(claims: DataFrame, predicate: str, accepted: bool = False) -> DataFrame:
    rows = claims.where(F.col("predicate") == predicate)
    return rows.where("accepted") if accepted else rows


def terms_clauses(clauses: DataFrame, segments: DataFrame, live: DataFrame) -> DataFrame:
    """(clause, edition): clauses (clause, segment) of segments (segment, doc_role) that hold terms and an accepted claim ties to an edition, the last claim by id."""
    tied = claims_of(live, "realizes", True).where("object IS NOT NULL").groupBy(F.col("subject").alias("segment")).agg(F.max_by("object", "id").alias("edition"))
    return clauses.join(segments.where(F.col("doc_role").isin(*TERMS_ROLES)).select("segment"), "segment").join(tied, "segment").select("clause", "edition")


def edition_status(editions: DataFrame, segments: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((edition, accepted, missing ARRAY, state), mismatches (edition, id, kind)).

    editions (edition, parts ARRAY<STRUCT<rule, sha256>>), segments (segment, rule, sha256).  A segment's
    fingerprint covers the equal part; another one only what a review decision says it covers, else it
    is a candidate for a difference in content under the same rule, and not comparable otherwise.
    Confirmed: something accepted, every part covered, nothing mismatched, all decided by review.
    """
    tied = claims_of(live, "realizes", True).select("id", F.col("subject").alias("segment"), F.col("object").alias("edition"), "decided_by", "covers")
    tied = tied.join(segments.select("segment", "rule", "sha256"), "segment").join(editions, "edition")
    equal = F.exists("parts", lambda p: (p["sha256"] == F.col("sha256")) & (p["rule"] == F.col("rule")))
    equal = F.coalesce(equal, F.lit(False))
    reviewed = F.when(F.col("decided_by") == "review_decision", F.col("covers"))
    rows = tied.withColumn("covered", F.when(equal, F.col("sha256")).otherwise(reviewed)).withColumn("bad", ~equal & reviewed.isNull())
    kind = F.when(F.col("sha256").isNotNull() & F.exists("parts", lambda p: p["rule"] == F.col("rule")), "content_difference_candidate").otherwise("not_comparable")
    mismatches = rows.where("bad").select("edition", "id", kind.alias("kind"))
    seen = rows.groupBy("edition").agg(F.count("*").alias("accepted"), F.collect_set("covered").alias("covered"), F.bool_or("bad").alias("bad"), F.bool_or(~F.coalesce(F.col("decided_by").isin(*DECIDED), F.lit(False))).alias("unreviewed"))
    done = editions.join(seen, "edition", "left")
    missing = F.filter(F.transform("parts", lambda p: p["sha256"]), lambda s: ~F.array_contains(F.coalesce("covered", F.expr("cast(array() as array<string>)")), s))
    ok = (F.coalesce("accepted", F.lit(0)) > 0) & (F.size(missing) == 0) & ~F.col("bad") & ~F.col("unreviewed")
    return done.select("edition", F.coalesce("accepted", F.lit(0)).alias("accepted"), missing.alias("missing"), F.when(ok, "confirmed").otherwise("identity_unconfirmed").alias("state")), mismatches


def coverage_scope(live: DataFrame, categories: DataFrame) -> DataFrame:
    """(coverage, node): a coverage, its definitions and the tree of categories (node) below them."""
    links = claims_of(live, "uses_definition").union(claims_of(live, "includes_codes")).union(claims_of(live, "excludes_codes")).where("object IS NOT NULL")
    inner = links.where("predicate <> 'uses_definition'").join(categories.select(F.col("node").alias("object")), "object", "left_semi").select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    first = links.where("predicate = 'uses_definition'").select(F.col("subject").alias("coverage"), F.col("object").alias("root")).distinct()
    below = closure(inner, first.select("root").distinct()).select("root", "node")
    own = live.select("subject").where("subject LIKE 'cov:%'").distinct().select(F.col("subject").alias("coverage"), F.col("subject").alias("node"))
    return own.union(first.join(below, "root").select("coverage", "node")).distinct()


def simulate_allowed(live: DataFrame, scope: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(coverage, held, no_rule, in_conflict, allowed): may a coverage be simulated, and the three kinds of reasons why not.

    held: claims of criticality C0 about its scope that are not accepted; conflicts (listed ARRAY, state)
    count unless resolved and when they list a claim about the coverage itself.
    """
    held = live.where("upper(criticality) = 'C0' AND NOT accepted").select(F.col("subject").alias("node"), "id")
    held = held.groupBy("node").agg(F.count_distinct("id").alias("_n"))  # a claim is about one node, so nodes' counts add up
    held = scope.select("coverage", "node").distinct().join(held, "node").groupBy("coverage").agg(F.sum("_n").alias("held"))
    ruled = claims_of(live, "implemented_by", True).select(F.col("subject").alias("coverage")).distinct().withColumn("_ruled", F.lit(True))
    open_ = conflicts.where("state IS NULL OR state <> 'resolved'").select(F.explode("listed").alias("id")).distinct()
    about = live.join(open_, "id").select(F.col("subject").alias("coverage")).distinct().withColumn("_conflict", F.lit(True))
    rows = scope.select("coverage").distinct().join(held, "coverage", "left").join(ruled, "coverage", "left").join(about, "coverage", "left")
    rows = rows.select("coverage", F.coalesce("held", F.lit(0)).alias("held"), F.col("_ruled").isNull().alias("no_rule"), F.col("_conflict").isNotNull().alias("in_conflict"))
    return rows.withColumn("allowed", (F.col("held") == 0) & ~F.col("no_rule") & ~F.col("in_conflict"))


def resolve_chain(requests: DataFrame, candidates: DataFrame, live: DataFrame, confirmed: DataFrame, allowed: DataFrame) -> DataFrame:
    """(request, outcome, config, edition, category, rule_claim, rule_path): linked, or the first of the ordered reasons why not.

    requests (request, day, coverage), candidates (request, config), live claims, confirmed (edition),
    allowed as from simulate_allowed.  Nothing depends on the order of rows.
    """
    scratch = Scratch(live.sparkSession)
    lo, hi = requests.agg(*[F.coalesce(F.unix_date(f(F.col("day").cast("date"))), F.lit(0)) for f in (F.min, F.max)]).first()
    dayless, first, last = (F.date_from_unix_date(F.lit(n)) for n in (lo - 1, lo, hi))  # a request without a day meets what is open on both ends
    span = (dayless, last)
    # what a configuration uses changes on few days: its claims are merged, and a request meets the one state of its day
    start = F.when(F.col("valid_from").isNull() & F.col("valid_to").isNull(), dayless).otherwise(F.greatest(F.col("valid_from").cast("date"), first))
    use = claims_of(live, "uses_edition").select(F.col("subject").alias("config"), F.col("object").alias("edition"), "accepted", start.alias("valid_from"), F.least(F.col("valid_to").cast("date"), last).alias("valid_to"))
    use = scratch.keep(merged(use, ["config", "edition", "accepted"]))
    changes = between_changes(use, "config", "valid_from", "valid_to", "since", "until")
    states = in_force(changes, use, "config", "since", span=span).groupBy("config", "since", "until")
    states = scratch.keep(states.agg(F.bool_or(F.col("edition").isNull()).alias("scope_open"), F.bool_or(~F.col("accepted")).alias("unaccepted"), F.collect_set("edition").alias("editions"), F.collect_set(F.when(~F.col("accepted"), F.col("edition"))).alias("loose")))
    asked = candidates.select("request", "config").join(requests.select("request", F.coalesce(F.col("day").cast("date"), dayless).alias("day")), "request")
    hits = in_force(asked, states.select("config", "since", "until", "scope_open", "unaccepted", (F.size("editions") > 1).alias("others")), "config", "day", "since", "until", span=span)
    used = hits.groupBy("request").agg((F.min("config") != F.max("config")).alias("many"), F.min("config").alias("config"), F.min("since").alias("since"), *[F.bool_or(c).alias(c) for c in ("scope_open", "unaccepted", "others")])
    told = scratch.keep(requests.select("request", "coverage").join(used, "request", "left"))
    # with no configuration or several, or an open scope, the outcome is clear; only the rest meet editions and coverages
    clear = F.coalesce(F.col("config").isNull() | F.col("many") | F.col("scope_open"), F.lit(False))
    there = claims_of(live, "in_edition", True).where("object IS NOT NULL").groupBy(F.col("subject").alias("coverage")).agg(F.collect_set("object").alias("there"))
    applies = claims_of(live, "applies_to").where("object IS NOT NULL").groupBy(F.col("object").alias("coverage")).agg(F.bool_or(~F.col("accepted")).alias("pending"), F.collect_set("subject").alias("applies_from"))
    rule = claims_of(live, "implemented_by", True).groupBy(F.col("subject").alias("coverage")).agg(F.min(F.struct("id", "rule_path", "covers_editions")).alias("rule"))
    category = claims_of(live, "uses_definition").groupBy(F.col("subject").alias("coverage")).agg(F.min(F.struct("id", "object")).alias("d")).select("coverage", F.col("d.object").alias("category"))
    whole = claims_of(live, "application_scope_complete", True).where("value = 'true'").select(F.col("subject").alias("config")).distinct().withColumn("complete", F.lit(True))
    rows = told.where(~clear).join(states.select("config", "since", "editions", "loose"), ["config", "since"]).join(there, "coverage", "left")
    met = F.array_intersect("editions", "there")
    rows = rows.select("request", "coverage", "config", "many", "scope_open", "unaccepted", "others", F.when(F.size(met) > 0, F.size(met)).alias("found"), F.array_min(met).alias("edition"), F.arrays_overlap("loose", "there").alias("link_open"))
    for side, on in ((confirmed.select("edition").distinct().withColumn("known", F.lit(True)), "edition"), (applies, "coverage"), (rule, "coverage"), (category, "coverage"), (whole, "config"), (allowed, "coverage")):
        rows = rows.join(side, on, "left")
    rows = rows.unionByName(told.where(clear).drop("since"), allowMissingColumns=True)
    covers = F.coalesce("rule.covers_editions", F.array("edition"))
    no = lambda c: F.coalesce(c, F.lit(False))
    only_rule = no(F.col("no_rule")) & (F.col("held") == 0) & ~F.col("in_conflict")
    outcome = first_reason(
        ("no_uses_edition", F.col("config").isNull()),
        ("multiple_candidates", F.col("many")),
        ("scope_unknown", F.col("scope_open")),
        ("link_unapproved", F.col("found").isNull() & F.col("unaccepted")),
        ("cov_not_in_edition", F.col("found").isNull()),
        ("competing_editions", F.col("found") > 1),
        ("link_unapproved", F.col("link_open")),
        ("edition_identity_unconfirmed", F.col("known").isNull()),
        ("application_scope_unverified", F.col("pending")),
        ("applies_from_other_edition_unmodeled", F.size(F.array_except("applies_from", covers)) > 0),
        ("application_scope_unverified", F.col("others") & F.col("complete").isNull()),
        ("no_rule", F.coalesce(only_rule, F.lit(True)) & ~no(F.col("allowed"))),
        ("simulate_blocked", ~no(F.col("allowed"))),
        ("no_rule", F.col("rule.rule_path").isNull()),
    )
    rows = rows.withColumn("outcome", outcome)
    when = lambda c: F.when(F.col("outcome") == "linked", F.col(c))
    return rows.select("request", "outcome", *[when(c).alias(n) for c, n in (("config", "config"), ("edition", "edition"), ("category", "category"), ("rule.id", "rule_claim"), ("rule.rule_path", "rule_path"))])


def resolve_request(chain: DataFrame) -> DataFrame:
    """The chain as it is shown: a blocked simulation as a link that is not approved."""
    return chain.withColumn("outcome", F.when(F.col("outcome") == "simulate_blocked", "link_unapproved").otherwise(F.col("outcome")))


def _found(rows: DataFrame, code: str, subject: str | Column, message: str | Column) -> DataFrame:
    message = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(code).alias("code"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject"), message.alias("message"))


def check_evidence(live: DataFrame, terms: DataFrame) -> DataFrame:
    """K1: an accepted C0 claim about structure needs an observation, any other a basis in a clause of an edition.  K2: same_benefit_as needs bases in two editions."""
    asked = live.where("(upper(criticality) = 'C0' AND accepted) OR predicate = 'same_benefit_as'")
    basis = asked.select("id", F.explode_outer("evidence").alias("e")).where("e.role = 'basis'").join(terms, F.col("e.target") == F.col("clause")).groupBy("id").agg(F.count_distinct("edition").alias("editions"))
    rows = asked.join(basis, "id", "left").withColumn("editions", F.coalesce("editions", F.lit(0)))
    c0 = rows.where("upper(criticality) = 'C0' AND accepted")
    seen = F.coalesce(F.exists("evidence", lambda e: e["role"] == "observation"), F.lit(False))
    bare = c0.where(F.col("predicate").isin(*STRUCTURAL) & ~seen)
    loose = c0.where(~F.col("predicate").isin(*STRUCTURAL) & (F.col("editions") == 0))
    return _found(bare, "K1", "id", "no_observation").union(_found(loose, "K1", "id", "no_basis")).union(_found(claims_of(rows, "same_benefit_as").where("editions < 2"), "K2", "id", "needs_two_editions"))


def check_nodes(nodes: DataFrame, claims: DataFrame, live: DataFrame, anchors: tuple[str, ...]) -> DataFrame:
    """K3, K5, K6, K7 over nodes (node, class, code_system, edition, effective, judged_as_of, anchor, unit, kind, text, applies_to ARRAY)."""
    fields = ("code_system", "edition", "effective", "judged_as_of")
    k3 = nodes.where("class = 'CodeSet'").select("node", F.explode(F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))).alias("field"))
    condition = nodes.where("class = 'Condition'")
    unit = nodes.where("unit IS NOT NULL").select(F.col("node").alias("_n"), F.col("unit").alias("_u"))
    same = claims_of(live, "same_duration_as").join(unit.select(F.col("_n").alias("subject"), F.col("_u").alias("a")), "subject").join(unit.select(F.col("_n").alias("object"), F.col("_u").alias("b")), "object")
    cuts = claims_of(live, "has_condition").where("value_state = 'observed'").join(nodes.select(F.col("node").alias("object"), "kind", "text", "applies_to"), "object")
    aimless = cuts.where((F.col("kind") == "reduction") & ~F.coalesce(F.col("text") == "none", F.lit(False)) & (F.coalesce(F.size("applies_to"), F.lit(0)) <= 0))
    return reduce(
        DataFrame.union,
        (
            _found(k3, "K3", "node", F.concat(F.lit("lacks "), F.col("field"))),
            _found(claims.where("valid_from > valid_to"), "K5", "id", "ends_before_start"),
            _found(condition.where(F.col("anchor").isNotNull() & ~F.col("anchor").isin(*anchors)), "K5", "node", "unknown_anchor"),
            _found(condition.where(F.col("unit").isNotNull() & ~F.col("unit").isin(*UNITS)), "K6", "node", "unknown_unit"),
            _found(same.where("a <> b"), "K6", "id", "units_differ"),
            _found(aimless, "K7", "id", "no_target"),
        ),
    )


def scope_edges(live: DataFrame) -> DataFrame:
    """(src, dst): src is contained in dst, from narrower and broader claims."""
    rows = claims_of(live, "scope_relation").where("object IS NOT NULL")
    return rows.where("value = 'narrower'").select(F.col("subject").alias("src"), F.col("object").alias("dst")).union(rows.where("value = 'broader'").select(F.col("object"), F.col("subject"))).distinct()


def check_rules(live: DataFrame, scope: DataFrame, rule_refs: DataFrame) -> DataFrame:
    """K9: an accepted rule cites nothing beyond the C0 bases of its coverage's scope; rule_refs (rule_path, refs ARRAY), refs NULL where none can be read."""
    ruled = claims_of(live, "implemented_by", True).select("id", F.col("subject").alias("coverage"), "rule_path")
    rows = ruled.join(rule_refs.withColumn("_file", F.lit(True)), "rule_path", "left")
    # only what is cited is looked for, so no coverage meets all the bases below it
    cited = rows.select("coverage", F.explode("refs").alias("target")).distinct()
    basis = live.where("upper(criticality) = 'C0' AND accepted").select(F.col("subject").alias("node"), F.explode("evidence").alias("e")).where("e.role = 'basis'").select("node", F.col("e.target").alias("target"))
    basis = basis.join(cited.select("target").distinct(), "target", "left_semi").distinct()
    based = cited.join(scope, "coverage").join(basis, ["node", "target"]).groupBy("coverage").agg(F.collect_set("target").alias("basis"))
    rows = rows.join(based, "coverage", "left")
    beyond = F.array_except("refs", F.coalesce("basis", F.expr("cast(array() as array<string>)")))
    why = F.when(F.col("rule_path").isNull(), "no_rule_path").when(F.col("_file").isNull(), "no_rule_file").when(F.col("refs").isNull(), "no_refs").when(F.size(beyond) > 0, F.concat(F.lit("beyond "), F.array_join(F.array_sort(beyond), ",")))
    return _found(rows.withColumn("why", why).where("why IS NOT NULL"), "K9", "id", F.col("why"))


def check_enabled(declared: DataFrame, allowed: DataFrame) -> DataFrame:
    """K11: coverages (coverage, capability) declared enabled that may not be simulated."""
    rows = declared.where("capability = 'enabled'").join(allowed, "coverage", "left")
    return _found(rows.where(~F.coalesce("allowed", F.lit(False))), "K11", "coverage", "not_allowed")


def check_scope_claims(live: DataFrame, relations: DataFrame) -> DataFrame:
    """K12: claimed scope relations against computed ones (a, b, relation)."""
    rows = claims_of(live, "scope_relation").where("object IS NOT NULL").join(relations, (F.col("subject") == F.col("a")) & (F.col("object") == F.col("b")), "left")
    none = F.coalesce(F.col("relation") == "not_comparable", F.lit(True))
    bad = F.when(none, F.when(F.col("accepted"), "accepted_without_comparison")).when(~F.col("relation").eqNullSafe(F.col("value")), F.concat(F.lit("computed "), F.col("relation")))
    return _found(rows.withColumn("why", bad).where("why IS NOT NULL"), "K12", "id", F.col("why"))


def check_prices(prices: DataFrame) -> DataFrame:
    """K13: prices (id, eligible, conditions MAP, binding, as_of) that may be compared need all three."""
    lacks = F.array_compact(F.array(F.when(F.coalesce(F.size("conditions"), F.lit(0)) <= 0, "conditions"), F.when(F.coalesce("binding", F.lit("")) == "", "package_binding"), F.when(F.col("as_of").isNull(), "as_of")))
    return _found(prices.where("eligible").select("id", F.explode(lacks).alias("field")), "K13", "id", F.concat(F.lit("lacks "), F.col("field")))


def check_realized(live: DataFrame, segments: DataFrame) -> DataFrame:
    """K14: an accepted realizes needs a fingerprint, an observation of its segment, and a review decision; the first that fails."""
    rows = claims_of(live, "realizes", True).join(segments.select(F.col("segment").alias("subject"), "sha256"), "subject", "left")
    seen = F.coalesce(F.exists("evidence", lambda e: (e["role"] == "observation") & (e["target"] == F.col("subject"))), F.lit(False))
    why = F.when(F.col("sha256").isNull(), "no_fingerprint").when(~seen, "no_observation").when(~F.coalesce(F.col("decided_by").isin(*DECIDED), F.lit(False)), "not_reviewed")
    return _found(rows.withColumn("why", why).where("why IS NOT NULL"), "K14", "id", F.col("why"))


def check_editions(status: DataFrame, mismatches: DataFrame) -> DataFrame:
    """K16: mismatches without a review, and accepted editions with parts left uncovered."""
    open_ = status.where((F.col("accepted") > 0) & (F.size("missing") > 0))
    return _found(mismatches, "K16", "id", F.col("kind")).union(_found(open_, "K16", "edition", F.concat(F.lit("uncovered "), F.size("missing").cast("string"))))


def check_service(claims: DataFrame) -> DataFrame:
    """KP: accepted claims, superseded ones too, that are fixtures or rest on an assumption for tests."""
    why = F.when(F.col("origin") == "fixture", "fixture").when(F.col("decided_by") == "fixture_assumption", "fixture_assumption")
    return _found(claims.where("accepted").withColumn("why", why).where("why IS NOT NULL"), "KP", "id", F.col("why"))


def check_release(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """K15: members (release, id, digest) that are not stored (id, digest), or whose stored digest differs."""
    rows = listed.join(stored.select("id", F.col("digest").alias("_now")), "id", "left")
    why = F.when(F.col("_now").isNull(), "missing_member").when(F.col("_now") != F.col("digest"), "hash_differs")
    return _found(rows.withColumn("why", why).where("why IS NOT NULL"), "K15", "id", F.col("why"))


def check_manifest(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """KM: member arrays (release, production, members) that are not sorted and unique, members not stored (id, fixture), fixtures in production."""
    order = manifest.where(~F.array_sort(F.array_distinct("members")).eqNullSafe(F.col("members")))
    each = manifest.select("release", "production", F.explode("members").alias("id")).distinct().join(stored.select("id", "fixture", F.lit(True).alias("_here")), "id", "left")
    return _found(order, "KM", "release", "not_sorted").union(_found(each.where("_here IS NULL"), "KM", "release", F.concat(F.lit("not_stored "), F.col("id")))).union(_found(each.where("production AND fixture"), "KM", "release", F.concat(F.lit("fixture "), F.col("id"))))


def check_forks(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """K10: claims that several supersede without a conflict that lists them all."""
    from lodestone.operators.registry import forks

    return _found(forks(claims, "supersedes", "id", conflicts), "K10", "supersedes", "fork")


def live_claims(claims: DataFrame) -> DataFrame:
    return current(claims, "id", "supersedes")


def latest_assumptions(rows: DataFrame, person: str, key: str, version: str) -> DataFrame:
    """The newest version of every assumption of a person."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(person, key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")
