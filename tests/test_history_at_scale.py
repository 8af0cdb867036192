"""Histories in two levels, intervals by bins and quantiles by sketches, against plain forms, with one key that holds most rows."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import history, links, registry, sketches


@pytest.fixture(scope="module")
def hot(spark):
    """30,000 rows of which 25,000 are one key's, and a null key."""
    rng = random.Random(4)
    rows = [(i, "hot" if i % 6 else rng.choice(["a", "b", None]), i, rng.choice([200, 200, 304, 0, None]), rng.choice(["x", "y", None]), rng.random() < 0.5, rng.randrange(100)) for i in range(30_000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, k string, at long, status int, digest string, kept boolean, v long").repartition(5).cache()


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[2]):
        out.setdefault(r[1], []).append(r)
    return out


def test_no_range_holds_a_hot_key(spark, hot):
    _, df = hot
    ranged = history.ranged(df, ["k"], ["at"], 3000)
    assert max(r["count"] for r in ranged.groupBy("_part").count().collect()) < 9000
    assert ranged.where("k = 'hot'").select("_part").distinct().count() >= 5


def test_what_came_before(spark, hot):
    rows, df = hot
    ranged = history.ranged(df, ["k"], ["at"], 3000)
    got = history.before(ranged, ["k"], ["at"], last={"l": F.when(F.col("status") == 200, F.col("digest"))}, total={"t": F.col("v")}, most={"m": F.col("v")}, previous={"p": F.col("digest"), "q": F.col("id")})
    want = {}
    for own in by_key(rows).values():
        last, total, most, prev = None, 0, None, (None, None)
        for r in own:
            want[r[0]] = (last, total, most, *prev)
            last = r[4] if r[3] == 200 and r[4] is not None else last
            total, most, prev = total + r[6], r[6] if most is None else max(most, r[6]), (r[4], r[0])
    assert {r.id: (r.l, r.t, r.m, r.p, r.q) for r in got.collect()} == want


def test_decisions_runs_and_sums_over_a_hot_key(spark, hot):
    rows, df = hot
    decided, failures, sums, late = {}, {}, {}, set()
    for own in by_key(rows).values():
        stored = kept = None
        run = spent = 0
        for i, _, _, status, digest, keep, v in own:
            if status == 304 and stored is not None and kept:
                decided[i] = "unchanged"
            elif status != 200 or digest is None:
                decided[i] = "invalid"
            else:
                decided[i] = "new" if stored is None else "unchanged_same_hash" if stored == digest else "changed"
            stored = digest if status == 200 and digest is not None else stored
            kept = keep if status == 200 else kept
            run = run + 1 if status == 0 else 0
            failures[i], sums[i] = run, spent
            spent += v
        top = None
        for i, *_, v in own:
            if top is not None and v <= top:
                late.add(i)
            top = v if top is None else max(top, v)
    assert {r.id: r.decision for r in history.change_decisions(df, ["k"], ["at"], "status", "digest", "kept").collect()} == decided
    runs = history.failure_runs(df, ["k"], ["at"], F.col("status") == 0).collect()
    assert {r.id: r.failures for r in runs} == failures and {r.id for r in runs if r.alert} == {i for i, n in failures.items() if n == 3}
    assert {r.id: r.s for r in history.running_before(df, ["k"], ["at"], "v", "s").collect()} == sums
    assert {r.id for r in history.out_of_order(df, ["k"], "at", "v").collect()} == late


def test_ledger_chains_over_ranges(spark):
    rows = [("a", i, f"d{i}", f"d{i - 1}" if i > 1 else None) for i in range(1, 5000) if i != 700]
    rows[2500] = (*rows[2500][:3], "forged")
    bad = registry.chain_breaks(spark.createDataFrame(rows, "k string, seq long, d string, p string"), ["k"], "seq", "d", "p").collect()
    assert sorted((r.seq, r.reason) for r in bad) == [(701, "sequence_gap"), (2502, "hash_differs")]


def test_intervals_by_bins_equal_all_comparisons(spark):
    rng = random.Random(7)
    day = lambda: date(2020, 1, 1) + timedelta(days=rng.randrange(2000))
    rows = [(i, rng.choice("kkkl"), day() if i % 50 else None) for i in range(400)]
    versions = [(v, rng.choice("kl"), *sorted((day(), day()))) for v in range(120)]
    versions = [(v, k, a if v % 9 else None, b if v % 7 else None) for v, k, a, b in versions] + [(900, "k", date(2023, 1, 2), date(2023, 1, 1))]
    want = {(i, v) for i, k, d in rows for v, w, a, b in versions if d and k == w and (a is None or a <= d) and (b is None or d <= b)}
    for days in (1, 64, 5000):
        got = history.in_force(spark.createDataFrame(rows, "i int, k string, day date"), spark.createDataFrame(versions, "v int, k string, valid_from date, valid_to date"), "k", "day", days=days)
        pairs = [(r.i, r.v) for r in got.collect()]
        assert set(pairs) == want and len(pairs) == len(want)


def test_many_requests_on_one_key_meet_in_many_groups(spark):
    requests = spark.range(1_000_000).selectExpr("id AS request", "date_add(DATE '2000-01-01', cast(id % 5000 AS int)) AS day")
    candidates = spark.range(1_000_000).selectExpr("id AS request", "1 AS config")
    versions = spark.range(50).selectExpr("1 AS config", "date_add(DATE '2000-01-01', cast(id * 100 AS int)) AS valid_from", "date_add(DATE '2000-01-01', cast(id * 100 + 49 AS int)) AS valid_to")
    got = links.select_config(requests, candidates, versions).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in got} == {"selected": 500_000, "no_uses_edition": 500_000}
    bins = history.in_force(candidates.join(requests, "request"), versions, "config", "day").selectExpr("floor(unix_date(day) / 64) AS b").groupBy("b").count()
    assert bins.count() > 70 and bins.agg(F.max("count")).first()[0] < 13_000


def test_merged_sketches_tell_ranks(spark):
    rows = spark.range(200_000).selectExpr("id % 3 AS g", "id % 40 AS day", "cast(abs(xxhash64(id)) % 1000003 AS double) AS v")
    rows = rows.union(spark.createDataFrame([(0, 1, None), (7, 1, None)], "g long, day long, v double"))
    days = sketches.quantile_sketches(rows, ["g", "day"], F.col("v"))
    told = {r.g: r for r in sketches.quantiles(sketches.merged(days, ["g"]), {"p1": 0.01, "p50": 0.5, "p95": 0.95}).collect()}
    exact = {r.g: sorted(r.v) for r in rows.where("v is not null").groupBy("g").agg(F.collect_list("v").alias("v")).collect()}
    assert set(told) == set(exact)
    for g, values in exact.items():
        assert told[g].n == len(values)
        for name, q in (("p1", 0.01), ("p50", 0.5), ("p95", 0.95)):
            rank = sum(v <= told[g][name] for v in values) / len(values)
            assert abs(rank - q) < 0.02
    few = sketches.quantiles(sketches.quantile_sketches(spark.createDataFrame([(1, v) for v in range(1, 101)], "g int, v int"), ["g"], F.col("v")), {"p50": 0.5, "p95": 0.95}).first()
    assert (few.p50, few.p95) == (50.0, 95.0)
