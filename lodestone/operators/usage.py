"""Ledger totals: reservations, settlements, admissions, caps and their checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(records: DataFrame, dims: list[str]) -> DataFrame:
    """Reservations and usage from before the ledger, with what each counts and whether it is still open.

    records (kind, seq, reservation_seq, run, and the dimensions).  A reservation counts the smaller of
    itself and the greatest settlement by its own run, an open one in full; the rest counts as it is.
    """
    top = [F.max(d).alias(f"_{d}") for d in dims]
    done = records.where("kind = 'settlement'").groupBy(F.col("reservation_seq").alias("seq"), "run").agg(*top, F.lit(True).alias("_done"))
    kept = records.where("kind IN ('reservation', 'pre_ledger_usage')").join(done, ["seq", "run"], "left")
    own = F.col("kind") == "reservation"
    used = {d: F.when(own & F.col("_done"), F.least(F.coalesce(d, F.lit(0)), F.coalesce(f"_{d}", F.lit(0)))).otherwise(F.coalesce(d, F.lit(0))) for d in dims}
    return kept.withColumns(used).withColumn("open", own & F.col("_done").isNull()).drop("_done", *[f"_{d}" for d in dims])


def usage(records: DataFrame, by: list[str], dims: list[str], admissions: DataFrame | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """Totals of every dimension, n and open per group.

    admissions (run and the group columns) whose run never settled anything count at the limits.
    """
    rows = settle(records, dims).select(*by, *dims, F.lit(1).alias("n"), F.col("open").cast("int").alias("open"))
    if admissions is not None:
        runs = records.where("kind = 'settlement'").select("run").distinct()
        idle = admissions.join(runs, "run", "left_anti")
        rows = rows.unionByName(idle.select(*by, *[F.lit((limits or {}).get(d, 0)).cast("bigint").alias(d) for d in dims], F.lit(0).alias("n"), F.lit(0).alias("open")))
    return rows.groupBy(*by).agg(*[F.sum(d).cast("bigint").alias(d) for d in dims], F.sum("n").cast("bigint").alias("n"), F.sum("open").cast("bigint").alias("open"))


def checkpoint(records: DataFrame, by: list[str], dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """(totals of what is settled, the open reservations whole): what a ledger's older records come to."""
    rows = settle(records, dims)
    totals = rows.where("NOT open").groupBy(*by).agg(*[F.sum(d).cast("bigint").alias(d) for d in dims], F.count("*").alias("n"))
    opened = records.join(rows.where("open").select("seq", "run"), ["seq", "run"], "left_semi").where("kind = 'reservation'")
    return totals, opened


def resume(totals: DataFrame, opened: DataFrame, newer: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    """usage over a checkpoint and the records since, equal to usage over all: an open reservation may still be settled.

    Settlements of reservations that neither are open nor came since are the checkpoint's already.
    """
    live = opened.unionByName(newer.where("kind <> 'settlement'"), allowMissingColumns=True)
    late = newer.where("kind = 'settlement'").join(live.where("kind = 'reservation'").select(F.col("seq").alias("reservation_seq")).distinct(), "reservation_seq", "left_semi")
    rest = usage(live.unionByName(late, allowMissingColumns=True), by, dims)
    both = totals.withColumn("open", F.lit(0).cast("bigint")).unionByName(rest)
    return both.groupBy(*by).agg(*[F.sum(c).cast("bigint").alias(c) for c in [*dims, "n", "open"]])


def call_costs(calls: DataFrame, at: str, user: str, cost: Column, monthly: int, daily: int) -> DataFrame:
    """(month, user, day, calls, cost, reached) of calls: a row for each month and one for each user and day, the other columns null; reached against the cap of its kind.

    Calls without a user count to their month alone.  Both kinds come from one pass.
    """
    rows = calls.select(F.trunc(at, "month").alias("month"), F.col(user).alias("user"), F.to_date(at).alias("day"), cost.cast("bigint").alias("_c"))
    sets = rows.groupingSets([[F.col("month")], [F.col("user"), F.col("day")]], "month", "user", "day")
    of_user = F.grouping("user") == 0
    out = sets.agg(F.count("*").alias("calls"), F.sum("_c").alias("cost"), of_user.alias("_own"))
    return out.where("NOT _own OR user IS NOT NULL").withColumn("reached", F.col("cost") >= F.when(F.col("_own"), daily).otherwise(monthly)).drop("_own")
