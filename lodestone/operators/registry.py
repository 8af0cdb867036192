"""Registries against their access logs and against each other, budgets, vocabularies, pages of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.history import before, ranged


def latest(log: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each key; an aggregate, so partial results are combined before the shuffle."""
    last = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("__last")
    return log.groupBy(*keys).agg(last).select(*keys, *[F.col("__last")[v].alias(v) for v in values])


def latest_access_mismatches(entities: DataFrame, log: DataFrame, key: str, order: list[str], stated: str, found: str) -> DataFrame:
    """Entities whose stated access is not what their last attempt found, or that were never tried."""
    seen = latest(log, [key], order, [found])
    return entities.join(seen, key, "left").where(~F.col(stated).eqNullSafe(F.col(found))).select(key, stated, found)


def without_observation(sources: DataFrame, log: DataFrame, on: list[str]) -> DataFrame:
    """Sources that no attempt in the log backs on all the columns of on; a null backs nothing."""
    return sources.join(log.select(*on), on, "left_anti")


def crosscheck(listed: DataFrame, registry: DataFrame, on: str, excluded: Column) -> DataFrame:
    """on, times (rows in the list), outcome: matched, excluded, duplicate (listed twice), missing (not registered), unlisted (only registered)."""
    rows = listed.groupBy(on).agg(F.count("*").alias("times"), F.bool_or(excluded).alias("__out"))
    both = rows.join(registry.select(on).distinct().withColumn("__in", F.lit(True)), on, "full_outer")
    outcome = F.when(F.col("times").isNull(), "unlisted").when(F.col("__out"), "excluded").when(F.col("times") > 1, "duplicate").when(F.col("__in"), "matched").otherwise("missing")
    return both.select(on, F.coalesce("times", F.lit(0)).alias("times"), outcome.alias("outcome"))


def headroom(used: DataFrame, caps: DataFrame, on: str, alert: tuple[int, int] = (4, 5)) -> DataFrame:
    """What each dimension has left; over beyond its cap, near from alert (a fraction) of it on.  Dimensions without a cap have none left."""
    cap = F.coalesce("cap", F.lit(0))
    n, d = alert
    return used.join(caps, on, "left").select(on, "used", (cap - F.col("used")).alias("headroom"), (F.col("used") > cap).alias("over"), (F.col("used") * d >= cap * n).alias("near"))


def chain_breaks(ledger: DataFrame, by: list[str], seq: str, digest: str, previous: str) -> DataFrame:
    """Records whose number does not follow the one before or whose previous hash is not that record's hash; the first of a key must state none."""
    rows = before(ranged(ledger, by, [seq]), by, [seq], previous={"__seq": F.col(seq), "__digest": F.col(digest)}).drop("_part")
    gap = F.col("__seq").isNotNull() & (F.col(seq) != F.col("__seq") + 1)
    why = F.when(gap, "sequence_gap").when(~F.col(previous).eqNullSafe(F.col("__digest")), "hash_differs")
    return rows.withColumn("reason", why).where("reason IS NOT NULL").drop("__seq", "__digest")


def forks(rows: DataFrame, target: str, by: str, conflicts: DataFrame | None = None) -> DataFrame:
    """Targets that more than one row supersedes, with those rows; none that one of the conflicts (listed ARRAY) lists whole."""
    found = rows.where(F.col(target).isNotNull()).groupBy(target).agg(F.array_sort(F.collect_set(by)).alias("successors"))
    found = found.where(F.size("successors") > 1)
    if conflicts is None:
        return found
    # a conflict that lists all successors lists the first
    listed = conflicts.select(F.explode("listed").alias("_first"), "listed").distinct()
    known = found.withColumn("_first", F.element_at("successors", 1)).join(listed, "_first").where(F.size(F.array_except("successors", "listed")) == 0)
    return found.join(known.select(target), target, "left_anti")


def outside_vocabulary(rows: DataFrame, column: str, codes: DataFrame, code: str) -> DataFrame:
    """Rows whose value is no code; nulls are left to the checks for missing values."""
    return rows.where(F.col(column).isNotNull()).join(codes.select(F.col(code).alias("__code")).distinct(), F.col(column) == F.col("__code"), "left_anti")


def page_after(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next `size` rows in key order after a cursor (None: from the start); the last key is the next cursor."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def has_amount(text: Column, amount: Column) -> Column:
    """Whether a text holds the amount, thousands separated by commas, with no digit, comma or full stop beside it."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\d,.])"), F.format_number(amount, 0), F.lit(r"(?![\d,.])")))


def dependents(changed: DataFrame, conclusions: DataFrame, key: str, refs: str) -> DataFrame:
    """Conclusions that list a changed row among their references, each once."""
    rows = conclusions.withColumn("__ref", F.explode(refs))
    hit = rows.join(changed.select(F.col(key).alias("__ref")).distinct(), "__ref", "left_semi")
    return hit.drop("__ref", refs).distinct()


def release_view(rows: DataFrame, manifest: DataFrame, key: str, members: str) -> DataFrame:
    """The rows that a release lists as members."""
    return rows.join(manifest.select(F.explode(members).alias("__member")), F.col(key) == F.col("__member"), "left_semi")
