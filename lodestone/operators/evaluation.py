"""Requests to results: facts by precedence, judged inputs, rules over linked requests, and what is shown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules as R

#: What an empty list from an explicit source becomes; the same text from anywhere else is forged.
EMPTY = '{"confirmed_empty":true}'


def prepare_facts(facts: Column, assumptions: Column, confirmed: Column, verified: Column) -> Column:
    """One map of inputs (JSON texts): assumptions, then facts, confirmed and verified ones, the later winning.

    An empty list is the confirmed empty list from an explicit source (all but facts) and unknown
    otherwise; the mark of a confirmed empty list is unknown wherever it was given.
    """
    none = F.expr("cast(map() as map<string, string>)")
    text = F.lit(None).cast("string")

    def of(source, explicit):
        fix = lambda k, v: F.when(v == "[]", F.lit(EMPTY) if explicit else text).when(v == EMPTY, text).otherwise(v)
        return F.transform_values(F.coalesce(source, none), fix)

    def over(below, later):
        return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(later, k)), later)

    return over(over(over(of(assumptions, True), of(facts, False)), of(confirmed, True)), of(verified, True))


#: Kinds of judgement, as functions of (requests with their facts, answers) to requests with the judged input.
def _by_membership(requests: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """code and category are looked up; an unknown answer leaves the input unknown."""
    got = answers.select(F.col("code").alias("_c"), F.col("category").alias("_k"), F.col("answer").alias("_a"))
    met = requests.join(got, (F.col("code") == F.col("_c")) & F.col("category").eqNullSafe(F.col("_k")), "left")
    return met.withColumn(name, F.when(F.col("_a") == "true", True).when(F.col("_a") == "false", False)).drop("_c", "_k", "_a")


def _by_time(requests: DataFrame, answers, name: str) -> DataFrame:
    """Whether the event lies within the window of (anchor, length, unit)."""
    anchor, n, unit = answers
    return requests.withColumn(name, R.time_window(F.col(anchor), n, unit, None, F.col("event"))["within"])


JUDGES: dict[str, Callable | None] = {"ontology": _by_membership, "time_stage": _by_time, "clause_reading": None, "table_lookup": None}


def fill_inputs(requests: DataFrame, judgements: dict[str, tuple[str, object]]) -> DataFrame:
    """requests with every judged input (name: kind, what it judges by); a kind that is declared and refused is an error of the row."""
    requests = requests.withColumn("error", F.lit(None).cast("string"))
    for name, (kind, by) in judgements.items():
        judge = JUDGES[kind]
        if judge is None:
            requests = requests.withColumn(name, F.lit(None).cast("boolean")).withColumn("error", F.coalesce("error", F.lit(f"refused:{kind}")))
        else:
            requests = judge(requests, by, name)
    return requests


def display_status(blocked: Column, issues: Column, missing: Column, error: Column) -> Column:
    """hold when blocked, in error or with an issue of the amount; input_missing; shown."""
    return F.when(blocked.isNotNull() | error.isNotNull() | (F.size(issues) > 0), "hold").when(F.size(missing) > 0, "input_missing").otherwise("shown")


def evaluate_requests(requests: DataFrame, chain: DataFrame, broken: DataFrame, judgements: dict, rule: Callable, effect: str = "terminate") -> DataFrame:
    """(request, blocked_by, display, result.., ): each request gated, linked, judged and evaluated; no rule runs on a blocked one.

    requests (request, day, ..) with their facts as columns; chain (request, outcome) as it is shown;
    broken (message) findings of the release's integrity, any of which blocks all, or, with a column release there
    and in the requests, all of that release; rule(df) gives (df, eligible, amount).  A row's error stays with the row.
    """
    rows = requests.join(chain.select("request", "outcome"), "request", "left")
    if "release" in broken.columns and "release" in requests.columns:
        rows = rows.join(broken.select("release").distinct().withColumn("_broken", F.lit(True)), "release", "left").withColumn("_broken", F.coalesce("_broken", F.lit(False)))
    else:
        rows = rows.join(F.broadcast(broken.agg((F.count("*") > 0).alias("_broken"))))
    date = R.in_calendar(F.col("day").try_cast("date"))
    gate = F.when(F.col("_broken"), "release_broken").when(~F.coalesce(date, F.lit(False)), "bad_date").when(F.col("outcome") != "linked", F.col("outcome")).when(F.col("outcome").isNull(), "no_uses_edition")
    rows = rows.withColumn("blocked_by", gate).drop("_broken")
    free = fill_inputs(rows.where("blocked_by IS NULL"), judgements)
    free, eligible, amount = rule(free)
    free = free.withColumn("p", R.payout(eligible, amount, effect))
    why = F.coalesce(F.col("error"), F.col("p.error"))
    done = free.select("request", "blocked_by", display_status(F.col("blocked_by"), F.col("p.issues"), F.col("p.missing"), why).alias("display"), F.when(F.col("error").isNull(), F.col("p")).alias("p"), why.alias("error"))
    held = rows.where("blocked_by IS NOT NULL").select("request", "blocked_by", F.lit("hold").alias("display"))
    return done.unionByName(held, allowMissingColumns=True)


def shadow_compare(cases: DataFrame, key: str, old: Callable, new: Callable) -> DataFrame:
    """(key, before, after) of the cases on which two rules, evaluated on the same inputs, differ."""

    def run(rule, name):
        df, eligible, amount = rule(cases)
        return df.select(key, F.to_json(R.payout(eligible, amount)).alias(name))

    return run(old, "before").join(run(new, "after"), key).where(~F.col("before").eqNullSafe(F.col("after")))


def run_case_table(cases: DataFrame, rule: Callable, key: str) -> DataFrame:
    """(key, kind, error): every case by itself; one that fails says why and stops no other."""
    df, eligible, amount = rule(cases)
    return df.withColumn("p", R.payout(eligible, amount)).select(key, F.col("p.kind").alias("kind"), F.col("p.error").alias("error"))
