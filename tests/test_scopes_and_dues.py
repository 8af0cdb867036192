"""Scope relations, full checks and gap counts on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import history, links, usage


def test_scope_relation_names_every_case(spark):
    sets = {"a": "12", "b": "12", "c": "1", "d": "23", "e": "4", "f": "", "g": "?"}
    answers = [(c, k, "unknown" if inside == "?" else "true" if c in inside else "false") for k, inside in sets.items() for c in "1234"]
    pairs = [("a", "b"), ("c", "a"), ("a", "c"), ("a", "d"), ("a", "e"), ("f", "a"), ("a", "f"), ("f", "f"), ("a", "g"), ("a", "z")]
    got = links.scope_relation(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(answers, "code string, category string, answer string")).collect()
    want = ["same_scope", "narrower", "broader", "overlaps", "disjoint", "narrower", "broader", "same_scope", "not_comparable", "not_comparable"]
    assert {(r.a, r.b): r.relation for r in got} == dict(zip(pairs, want, strict=True))


def test_full_check_due_at_the_limit_and_without_state(spark):
    now = dt.datetime(2024, 5, 2, 12)
    ago = lambda s: now - dt.timedelta(seconds=s)
    state = [(1, "h", True, ago(59)), (2, "h", True, ago(60)), (3, None, True, ago(1)), (4, "h", False, ago(1)), (5, "h", True, None), (6, "h", None, ago(1))]
    asked = spark.createDataFrame([(i,) for i in range(8)], "k int")
    got = history.full_check_due(asked, spark.createDataFrame(state, "k int, digest string, retained boolean, verified timestamp"), ["k"], F.lit(now), 60)
    assert {r.k for r in got.collect() if not r.due} == {1}


def test_gap_summary_counts_what_is_new_and_refuses_a_shrunken_log(spark):
    gaps = spark.createDataFrame([("a",), ("a",), ("b",)], "s string")
    done = spark.createDataFrame([("a", 1)], "s string, count long")
    assert {(r.s, r.total, r.new) for r in history.gap_summary(gaps, done, "s").collect()} == {("a", 2, 1), ("b", 1, 1)}
    with pytest.raises(Exception, match="behind the published count"):
        history.gap_summary(gaps, spark.createDataFrame([("b", 2)], "s string, count long"), "s").collect()


def test_next_dues_of_pages_and_sources(spark):
    rows = [("s", "p", 1, 200, 9), ("s", "p", 3, 304, None), ("s", "p", 2, None, 50), ("s", "q", 5, 500, 7), ("t", "r", 4, 200, 40)]
    state = history.due_state(spark.createDataFrame(rows, "s string, p string, at long, status int, due long"), ["s", "p"], "at", "status", "due")
    assert {tuple(r) for r in state.collect()} == {("s", "p", 3, 2, 3), ("s", "q", None, 5, 7), ("t", "r", 4, None, 40)}
    assert {tuple(r) for r in history.source_status(state, ["s"]).collect()} == {("s", 3, 5, 3), ("t", 4, None, 40)}


def test_costs_by_month_and_by_user_and_day(spark):
    rows = [("2026-01-01 10:00:00", "u", 60), ("2026-01-01 11:00:00", "u", 40), ("2026-01-02 01:00:00", "u", 1), ("2026-01-31 01:00:00", None, 99), ("2026-02-01 00:00:00", "v", 100)]
    calls = spark.createDataFrame(rows, "t string, who string, c int").withColumn("t", F.col("t").cast("timestamp"))
    got = {(str(r.month) if r.month else None, r.user, str(r.day) if r.day else None): (r.calls, r.cost, r.reached) for r in usage.call_costs(calls, "t", "who", F.col("c"), 200, 100).collect()}
    assert got == {("2026-01-01", None, None): (4, 200, True), ("2026-02-01", None, None): (1, 100, False), (None, "u", "2026-01-01"): (2, 100, True), (None, "u", "2026-01-02"): (1, 1, False), (None, "v", "2026-02-01"): (1, 100, True)}


def test_content_addressed_keys_must_be_their_hash(spark):
    want = [("a", "h1"), ("objects/sha256/h1", "h1"), ("objects/sha256/h2", "h3"), ("gone", "x"), ("b", "y")]
    have = [("a", "h1"), ("objects/sha256/h1", "h1"), ("objects/sha256/h2", "h3"), ("b", "z"), ("more", "m")]
    got = links.verify_copy(spark.createDataFrame(want, "k string, d string"), spark.createDataFrame(have, "k string, d string"), "k", "d")
    assert {r.k: r.status for r in got.collect()} == {"a": "byte_identical", "objects/sha256/h1": "byte_identical", "objects/sha256/h2": "hash_mismatch", "gone": "missing", "b": "hash_mismatch", "more": "extra"}


def test_relations_from_few_answers_equal_those_from_all(spark):
    rng = random.Random(11)
    cats, codes = [f"c{i}" for i in range(8)], [f"x{i}" for i in range(12)]
    base = {c: rng.choice(["true", "false", "false", "false", "unknown"]) for c in cats}
    some = {(c, x): v for c in cats for x in rng.sample(codes, rng.choice([0, 3, 6, 12])) if (v := rng.choice(["true", "true", "false"])) != base[c]}
    answers = [(x, c, some.get((c, x), base[c])) for c in cats for x in codes]
    pairs = spark.createDataFrame([(a, b) for a in [*cats, "none"] for b in cats if a != b], "a string, b string")
    whole = links.scope_relation(pairs, spark.createDataFrame(answers, "code string, category string, answer string"))
    few = links.scope_relations(pairs, spark.createDataFrame([(x,) for x in codes], "code string"), spark.createDataFrame(list(base.items()), "category string, base string"), spark.createDataFrame([(*k, v) for k, v in some.items()], "category string, code string, answer string"))
    got = {tuple(r) for r in few.collect()}
    assert got == {tuple(r) for r in whole.collect()} and len({r[2] for r in got}) >= 4
    nothing = links.scope_relations(pairs, spark.createDataFrame([], "code string"), spark.createDataFrame(list(base.items()), "category string, base string"), spark.createDataFrame([], "category string, code string, answer string"))
    assert {r.relation for r in nothing.collect()} == {"not_comparable"}
