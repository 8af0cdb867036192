"""Checks and chains over claims: the rows that they make, and answers worked out by plain searches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import knowledge

CLAIM = "id string, predicate string, subject string, object string, value string, criticality string, accepted boolean, decided_by string, covers string, valid_from date, valid_to date, rule_path string, covers_editions array<string>, evidence array<struct<role string, target string>>"


def claim(id_, predicate, subject, object_=None, accepted=True, criticality="C2", basis=None, value=None, start=None, end=None, path=None, editions=None):
    return (id_, predicate, subject, object_, value, criticality, accepted, "review_decision", None, start, end, path, editions, [("basis", basis)] if basis else [])


def most_rows(df):
    """The most rows that any step of the collected df made."""

    def below(plan):
        name = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        found = plan.metrics().get("numOutputRows")
        return max([found.get().value() if found.isDefined() else 0, *map(below, inner)])

    return below(df._jdf.queryExecution().executedPlan())


def test_a_rule_meets_what_it_cites_and_not_all_bases_below_its_coverage(spark):
    n, bases = 40, 400
    rows = [claim(f"b{i}", "has_condition", "cat:1", "cond:1", criticality="C0", basis=f"clause:{i}") for i in range(bases)]
    rows += [claim(f"s{i}", "scope_of", "cov:0", criticality="C0", accepted=False, basis="clause:open") for i in range(2)]
    rows += [claim(f"r{i}", "implemented_by", f"cov:{i}", path=f"r{i % 4}") for i in range(n)] + [claim("x", "implemented_by", "cov:1"), claim("y", "implemented_by", "cov:2", path="gone"), claim("z", "implemented_by", "cov:77", path="r0")]
    refs = [("r0", ["clause:1", "clause:2"]), ("r1", ["clause:3", "clause:other"]), ("r2", None), ("r3", ["clause:open", "clause:open", None])]
    scope = [(f"cov:{i}", node) for i in range(n) for node in (f"cov:{i}", "cat:1")]
    found = knowledge.check_rules(spark.createDataFrame(rows, CLAIM), spark.createDataFrame(scope, "coverage string, node string"), spark.createDataFrame(refs, "rule_path string, refs array<string>"))
    got = {(r.code, r.subject, r.message) for r in found.collect()}
    want = {1: "beyond clause:other", 2: "no_refs", 3: "beyond clause:open"}
    assert got == {("K9", f"r{i}", want[i % 4]) for i in range(n) if i % 4} | {("K9", "x", "no_rule_path"), ("K9", "y", "no_rule_file"), ("K9", "z", "beyond clause:1,clause:2")}
    assert most_rows(found) < n * bases / 10


DAY = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def plainly(request, candidates, claims, confirmed, allowed):
    """A request's chain, claim by claim."""
    of = lambda predicate, **on: [c for c in claims if c["predicate"] == predicate and all(c[k] == v for k, v in on.items())]
    rid, on, coverage = request
    holds = lambda c: (c["valid_from"] is None or (on is not None and c["valid_from"] <= on)) and (c["valid_to"] is None or (on is not None and on <= c["valid_to"]))
    hits = [c for r, config in candidates if r == rid for c in of("uses_edition", subject=config) if holds(c)]
    configs = {c["subject"] for c in hits}
    if not configs:
        return "no_uses_edition"
    if len(configs) > 1:
        return "multiple_candidates"
    if any(c["object"] is None for c in hits):
        return "scope_unknown"
    there = {c["object"] for c in of("in_edition", subject=coverage, accepted=True)} - {None}
    met = [c for c in hits if c["object"] in there]
    if not met:
        return "link_unapproved" if any(c["accepted"] is False for c in hits) else "cov_not_in_edition"
    if len({c["object"] for c in met}) > 1:
        return "competing_editions"
    if any(c["accepted"] is False for c in met):
        return "link_unapproved"
    edition = met[0]["object"]
    if edition not in confirmed:
        return "edition_identity_unconfirmed"
    applies = of("applies_to", object=coverage)
    if any(c["accepted"] is False for c in applies):
        return "application_scope_unverified"
    rule = min((c for c in of("implemented_by", subject=coverage, accepted=True)), key=lambda c: c["id"], default=None)
    if {c["subject"] for c in applies} - set(rule["covers_editions"] if rule and rule["covers_editions"] is not None else [edition]):
        return "applies_from_other_edition_unmodeled"
    if len({c["object"] for c in hits}) > 1 and not of("application_scope_complete", subject=next(iter(configs)), accepted=True, value="true"):
        return "application_scope_unverified"
    if coverage not in allowed:
        return "no_rule"
    if not allowed[coverage]:
        return "simulate_blocked"
    return ("linked", next(iter(configs)), edition, rule["id"]) if rule and rule["rule_path"] else "no_rule"


def test_chains_equal_a_plain_search(spark):
    names = [c.split()[0] for c in CLAIM.split(", ") if not c.startswith("target")]
    for seed in range(2):
        dice = random.Random(seed)
        some = lambda *x: dice.choice(x)
        rows, n = [], 120
        for i in range(50):
            start, end = some(None, dice.randint(0, 150)), some(None, dice.randint(60, 200))
            rows.append(claim(f"u{i}", "uses_edition", f"sc:{i % 6}", None if dice.random() < 0.05 else f"ed:{dice.randint(0, 3)}", some(True, True, True, True, True, False, None), start=day(start), end=day(end)))
        rows += [claim(f"i{c}{e}", "in_edition", f"cov:{c}", f"ed:{e}", dice.random() < 0.9) for c in range(8) for e in range(4) if dice.random() < 0.35]
        rows += [claim(f"r{c}", "implemented_by", f"cov:{c}", path=f"rules/{c}" if c != 3 else None, editions=[f"ed:{e}" for e in range(3)] if c % 2 else None) for c in range(7)]
        rows += [claim(f"a{c}", "applies_to", f"ed:{dice.randint(0, 3)}", f"cov:{c}", c != 5) for c in (1, 2, 5)] + [claim("w", "application_scope_complete", "sc:1", value="true"), claim("d", "uses_definition", "cov:1", "cat:1")]
        requests = [(i, day(None if i % 17 == 0 else dice.randint(0, 210)), None if i % 40 == 39 else f"cov:{dice.randint(0, 7)}") for i in range(n)]
        candidates = [(i, f"sc:{dice.randint(0, 6)}") for i in range(n - 2)] + [(i, f"sc:{dice.randint(0, 6)}") for i in range(0, n, 9)] + [(4, "sc:1"), (4, "sc:1")]
        allowed = {f"cov:{c}": c != 4 for c in range(7)}
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        could = frame([(c, 0, False, not ok, ok) for c, ok in allowed.items()], "coverage string, held long, no_rule boolean, in_conflict boolean, allowed boolean")
        chain = knowledge.resolve_chain(frame(requests, "request long, day date, coverage string"), frame(candidates, "request long, config string"), frame(rows, CLAIM), frame([("ed:0",), ("ed:1",), ("ed:2",)], "edition string"), could)
        got = {r.request: ("linked", r.config, r.edition, r.rule_claim) if r.outcome == "linked" else r.outcome for r in chain.collect()}
        told = [dict(zip(names, r, strict=True)) for r in rows]
        assert got == {r[0]: plainly(r, candidates, told, {"ed:0", "ed:1", "ed:2"}, allowed) for r in requests}
        assert len(set(got.values())) > 8


def test_a_request_meets_the_state_of_its_day_and_not_every_claim(spark):
    n, claims = 200, 100
    rows = [claim(f"u{i}", "uses_edition", "sc:1", f"ed:{i % 2}", start=day(i), end=day(i + 400)) for i in range(claims)] + [claim("i", "in_edition", "cov:1", "ed:1")]
    requests = spark.createDataFrame([(i, day(100 + i % 50), "cov:1") for i in range(n)], "request long, day date, coverage string")
    none = spark.createDataFrame([], "coverage string, held long, no_rule boolean, in_conflict boolean, allowed boolean")
    chain = knowledge.resolve_chain(requests, requests.select("request", F.lit("sc:1").alias("config")), spark.createDataFrame(rows, CLAIM), spark.createDataFrame([("ed:1",)], "edition string"), none)
    assert {r.outcome for r in chain.collect()} == {"application_scope_unverified"}
    assert most_rows(chain) < n * claims / 10


def test_all_checks_read_one_table_of_claims(spark, monkeypatch):
    violations = catalog.queries()["violations"]
    from lodestone.plans import knowledge as plans

    read, base = [], plans.base
    monkeypatch.setattr(plans, "base", lambda *at: read.append(at) or base(*at))
    monkeypatch.setattr(plans.graph, "on_cycles", lambda edges: edges.select(F.col("src").alias("node")))  # many small jobs, not of interest here
    monkeypatch.setattr(plans, "scope_relation", lambda spark, _: spark.createDataFrame([], "a int, b int, relation string"))
    violations(spark, "/root/testdata/sf0.001")
    assert len(read) == 1
