"""Row checks that return an array of violations, and event checks against an allow list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(**checks: Column) -> Column:
    """The sorted names of the checks that a row breaks; a check that cannot be decided counts as broken."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(checks.items())])))


def check_events(events: DataFrame, allowed: DataFrame, id_: str = "event_id", kind: str = "event_type", fields: str = "fields") -> DataFrame:
    """(id, violations): fields not allowed for the event's kind, kinds not listed, and required fields missing.

    events carry a MAP of fields; allowed (kind, field, required).
    """
    kinds = allowed.select("kind").distinct().withColumn("_known", F.lit(True))
    rules = allowed.groupBy("kind").agg(F.collect_set("field").alias("_ok"), F.collect_set(F.when(F.col("required"), F.col("field"))).alias("_must"))
    joined = events.join(kinds, F.col(kind) == kinds["kind"], "left").drop(kinds["kind"]).join(rules, F.col(kind) == rules["kind"], "left")
    keys = F.coalesce(F.map_keys(fields), F.expr("cast(array() as array<string>)"))
    say = lambda names, what: F.transform(names, lambda n: F.concat(F.lit(f"{what}:"), n))
    found = F.when(F.col("_known").isNull(), F.array(F.lit("unknown_event"))).otherwise(F.concat(say(F.array_except(keys, "_ok"), "not_allowed"), say(F.array_except("_must", keys), "missing")))
    return joined.select(id_, F.array_sort(found).alias("violations"))


def evidence_valid(evidence: Column, roles: tuple[str, ...]) -> Column:
    """At least one item, every item with a known role and a well-formed reference."""
    return (F.size(evidence) > 0) & F.forall(evidence, lambda e: e["role"].isin(*roles) & e["ref"].rlike(r"\A[a-z]+:[^\s]+\z"))


def edition_parts_valid(parts: Column) -> Column:
    """At least one part, every part with a lower-case SHA-256 fingerprint."""
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p["sha256"].rlike(r"\A[0-9a-f]{64}\z"))
