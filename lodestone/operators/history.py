"""Versions, validity and per-key history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import Scratch


def valid_on(start: Column, end: Column, day: Column) -> Column:
    """Inclusive on both ends; an open end is always valid."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (day <= end))


def in_force(rows: DataFrame, versions: DataFrame, key: str, day: str, start: str = "valid_from", end: str = "valid_to", days: int = 64, span: tuple[Column, Column] | None = None) -> DataFrame:
    """rows joined to the versions of their key that are valid on their day; rows without one, or without a day, are left out.

    A version stands in every bin of `days` days that it touches, so the join is an equality of key and bin: a key with many
    versions meets only those about a row's day, and a key with many rows is split by their days.  Open ends are
    taken to the first and last day asked for, which are found in the rows unless `span` has them.
    """
    bin_ = lambda d: F.floor(F.unix_date(d.cast("date")) / days).cast("int")
    asked = rows.withColumn("_bin", bin_(F.col(day)))
    ends = asked.agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi")) if span is None else rows.sparkSession.range(1).select(bin_(span[0]).alias("_lo"), bin_(span[1]).alias("_hi"))  # one row
    first, last = F.greatest(F.coalesce(bin_(F.col(start)), F.col("_lo")), F.col("_lo")), F.least(F.coalesce(bin_(F.col(end)), F.col("_hi")), F.col("_hi"))
    spread = versions.join(F.broadcast(ends)).withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    spread = spread.withColumn("_bin", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last", "_lo", "_hi")
    return asked.join(spread, [key, "_bin"]).where(valid_on(F.col(start), F.col(end), F.col(day))).drop("_bin")


def merged(rows: DataFrame, key: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(key.., start, end): the days that a key's rows cover, both ends given and included, as few stretches as can be; a key comes down to a row a day at most before they are put in order."""
    ends = rows.where(F.col(start) <= F.col(end)).groupBy(*key, start).agg(F.max(end).alias(end))
    by = Window.partitionBy(*key).orderBy(start)
    so_far = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = ends.withColumn("_new", (so_far.isNull() | (F.col(start) > F.date_add(so_far, 1))).cast("int")).withColumn("_run", F.sum("_new").over(by))
    return runs.groupBy(*key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def between_changes(rows: DataFrame, key: str, start: str, end: str, since: str, until: str) -> DataFrame:
    """(key, since, until): the stretches of days in which the same of a key's rows hold, both ends given and included."""
    days = rows.select(key, F.explode(F.array(F.col(start), F.date_add(end, 1))).alias(since)).distinct()
    return days.withColumn(until, F.date_sub(F.lead(since).over(Window.partitionBy(key).orderBy(since)), 1)).where(F.col(until).isNotNull())


def ranged(rows: DataFrame, key: list[str], order: list[str], at_most: int = 100_000) -> DataFrame:
    """rows with `_part`, the number of their range by (key, order), as a table: about `at_most` rows a range, however many a key has."""
    scratch = Scratch(rows.sparkSession)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    parts = max(1, min(least, -(-n // 1000)), -(-n // at_most))
    return scratch.keep(rows.repartitionByRange(parts, *key, *order).withColumn("_part", F.spark_partition_id()))


def before(rows: DataFrame, key: list[str], order: list[str], last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, most: dict[str, Column] | None = None, previous: dict[str, Column] | None = None) -> DataFrame:
    """rows of `ranged` with columns over the rows of their key before them: the last value that isn't null, the sum (0 without rows), the greatest value, the value of the row just before.

    In two levels: within each range, and over what every earlier range hands on, a row a range and key; so no
    task holds more than a range, and the rows that a key hands on.
    """
    values = {f"_l_{n}": c for n, c in (last or {}).items()} | {f"_t_{n}": c for n, c in (total or {}).items()} | {f"_m_{n}": c for n, c in (most or {}).items()} | {f"_p_{n}": c for n, c in (previous or {}).items()}
    keep = rows.columns
    rows = rows.withColumns(values)
    own = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    there = rows.groupBy("_part", *key).agg(
        *[F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), at)).alias(f"_l_{n}") for n in last or {}],
        *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in total or {}],
        *[F.max(f"_m_{n}").alias(f"_m_{n}") for n in most or {}],
        *[F.max_by(F.struct(F.col(f"_p_{n}").alias("v")), at).alias(f"_p_{n}") for n in previous or {}],
    )
    on = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    told = {"l": lambda c, w: F.last(c, ignorenulls=True).over(w), "t": lambda c, w: F.sum(c).over(w), "m": lambda c, w: F.max(c).over(w), "p": lambda c, w: F.last(c).over(w)}
    handed = there.select(F.col("_part").alias("_q"), *[F.col(k).alias(f"_k_{k}") for k in key], *[told[n[1]](n, on).alias(f"_on{n}") for n in values])
    within = rows.select(*keep, *[told[n[1]](F.struct(F.col(n).alias("v")) if n[1] == "p" else n, own).alias(n) for n in values])
    same = F.col("_part") == F.col("_q")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    met = within.join(handed, same, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = {"l": lambda n: F.coalesce(n, f"_on{n}"), "t": lambda n: zero(n) + zero(f"_on{n}"), "m": lambda n: F.greatest(n, f"_on{n}"), "p": lambda n: F.coalesce(n, f"_on{n}")["v"]}
    return met.select(*keep, *[out[n[1]](n).alias(n[3:]) for n in values])


def current(rows: DataFrame, id_: str, supersedes: str) -> DataFrame:
    """Rows that no row supersedes."""
    return rows.join(rows.select(F.col(supersedes).alias(id_)).where(F.col(id_).isNotNull()), id_, "left_anti")


def tip_versions(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The highest version of every key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")


def chain_breaks(rows: DataFrame, key: str, version: str, id_: str, supersedes: str) -> DataFrame:
    """Versions that do not follow the one before: the first must supersede nothing, version n the id of n - 1."""
    by = Window.partitionBy(key).orderBy(version)
    seen = rows.withColumn("_id", F.lag(id_).over(by)).withColumn("_v", F.lag(version).over(by))
    bad = F.when(F.col("_v").isNull(), (F.col(version) != 1) | F.col(supersedes).isNotNull()).otherwise((F.col(version) != F.col("_v") + 1) | ~F.col(supersedes).eqNullSafe(F.col("_id")))
    return seen.where(bad).drop("_id", "_v")


def change_decisions(obs: DataFrame, key: list[str], order: list[str], status: str, digest: str, retained: str | None = None) -> DataFrame:
    """new, changed, unchanged_same_hash, unchanged (304) or invalid, against the last hash stored before; a 304 needs its original retained."""
    got = F.col(status) == 200
    seen = before(ranged(obs, key, order), key, order, last={"_stored": F.when(got, F.col(digest)), "_kept": F.when(got, F.lit(True) if retained is None else F.col(retained))})
    stored, there = F.col("_stored"), F.lit(True) if retained is None else F.coalesce("_kept", F.lit(False))
    what = F.when((F.col(status) == 304) & stored.isNotNull() & there, "unchanged").when((F.col(status) != 200) | F.col(status).isNull() | F.col(digest).isNull(), "invalid").when(stored.isNull(), "new").when(stored == F.col(digest), "unchanged_same_hash").otherwise("changed")
    return seen.withColumn("decision", what).drop("_stored", "_kept", "_part")


def failure_runs(obs: DataFrame, key: list[str], order: list[str], failed: Column) -> DataFrame:
    """failures: how many observations failed since the last success, this one included; alert on exactly the third."""
    rows = ranged(obs.withColumn("_f", F.coalesce(failed.cast("int"), F.lit(0))), key, order)
    all_ = before(rows, key, order, total={"_n": F.col("_f")}).withColumn("_n", F.col("_n") + F.col("_f"))
    runs = before(all_, key, order, last={"_at": F.when(F.col("_f") == 0, F.col("_n"))})
    runs = runs.withColumn("failures", F.when(F.col("_f") == 0, 0).otherwise(F.col("_n") - F.coalesce("_at", F.lit(0))).cast("bigint"))
    return runs.withColumn("alert", (F.col("_f") == 1) & (F.col("failures") == 3)).drop("_f", "_n", "_at", "_part")


def due_state(obs: DataFrame, key: list[str], at: str, status: str, due: str) -> DataFrame:
    """(key.., last_success, last_failure, next_due): when a key was last fetched (200 or 304), last failed, and is to be fetched again: as its newest observation says, at once if that says nothing."""
    ok = F.coalesce(F.col(status).isin(200, 304), F.lit(False))
    return obs.groupBy(*key).agg(F.max(F.when(ok, F.col(at))).alias("last_success"), F.max(F.when(~ok, F.col(at))).alias("last_failure"), F.max_by(F.coalesce(due, at), at).alias("next_due"))


def source_status(state: DataFrame, source: list[str]) -> DataFrame:
    """(source.., last_success, last_failure, next_due) of sources from the states of their pages: the newest, the newest and the earliest."""
    return state.groupBy(*source).agg(F.max("last_success").alias("last_success"), F.max("last_failure").alias("last_failure"), F.min("next_due").alias("next_due"))


def crawl_state(obs: DataFrame, key: list[str], order: Column, status: str, digest: str) -> DataFrame:
    """One row per key: the hash and order of the last 200, of the last 200 or 304, and of the last observation."""
    ok = F.col(status) == 200
    return obs.groupBy(*key).agg(
        F.max_by(F.when(ok, F.col(digest)), F.when(ok, order)).alias("digest"),
        F.max(F.when(ok | (F.col(status) == 304), order)).alias("verified"),
        F.max(order).alias("seen"),
    )


def running_before(rows: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The sum of a key's rows before each row."""
    return before(ranged(rows, key, order), key, order, total={out: F.col(value)}).drop("_part")


def out_of_order(obs: DataFrame, key: list[str], arrived: str, at: str) -> DataFrame:
    """Observations that are not later than the latest one that arrived before."""
    seen = before(ranged(obs, key, [arrived]), key, [arrived], most={"latest_before": F.col(at)})
    return seen.where(F.col(at) <= F.col("latest_before")).drop("_part")


def full_check_due(asked: DataFrame, state: DataFrame, key: list[str], now: Column, every_s: int) -> DataFrame:
    """asked with `due`: no state, no stored hash, the original not retained, never verified, or verified every_s seconds ago or more.

    state (key, digest, retained, verified), one row per key.
    """
    age = F.unix_micros(now) - F.unix_micros("verified")
    due = F.col("digest").isNull() | ~F.coalesce("retained", F.lit(False)) | F.col("verified").isNull() | (age >= every_s * 1_000_000)
    return asked.join(state, key, "left").select(*key, due.alias("due"))


def gap_summary(gaps: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """(key, total, new): all gaps of a key, and those beyond the count last published (key, count); fewer than published is an error."""
    have = gaps.groupBy(key).agg(F.count("*").alias("_n"))
    total, before = F.coalesce("_n", F.lit(0)), F.coalesce("count", F.lit(0))
    new = F.when(total < before, F.raise_error(F.lit("gap log is behind the published count")).cast("bigint")).otherwise(total - before)
    return have.join(published, key, "full_outer").select(key, total.alias("total"), new.alias("new"))
