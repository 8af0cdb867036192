"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots, of one source each and of equally many words within a source.  Slot n
draws its source by sending the n-th golden-ratio point through the cumulative shares of the slots
that the targets come to; the r-th slot of a source takes the
r-th block of that source's documents in shuffled order, beginning again after the last block.
Ranks and running sums are taken in two steps (within small ranges, then over their totals), so no
source, however large, is ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2
#: A source's size and target each come to at least so many slots, down to a word a slot.
LEAST_SLOTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target): shares of the total by cycling weights, at most limit times a source's size.

    Input (source, source_size), one row per source.  The shared level rises with the sum until no
    source is above its limit: sources in order of limit / weight are full as long as the level of
    the rest exceeds theirs.  Empty sources get 0.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(order, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(limit))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * float(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"]
    return s.withColumn("rest", rest).select("source", "source_size", F.when(F.col("full") | F.col("rest").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("rest") * F.col("w"))).alias("target"))


#: The golden ratio's fraction times 2^62, to an odd whole number: its low and high 31 bits.
GOLDEN = int(0.6180339887498949 * 2**62) | 1


def golden_point(n: Column) -> Column:
    """The n-th golden-ratio point on [0, 2^62): n * GOLDEN modulo 2^62, which repeats after 2^62 points."""
    half = 2**31
    g0, g1 = F.lit(GOLDEN % half), F.lit(GOLDEN // half)
    n0, n1 = F.pmod(n, F.lit(half)), F.shiftright(n, 31)
    middle = F.pmod(n0 * g1 + n1 * g0, F.lit(half))
    return (n0 * g0 + middle * F.lit(half)).bitwiseAND(F.lit(half * half - 1))


def _running(df: DataFrame, key: list[str], part: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of value over the rows of the key before a row, ordered by part, then order."""
    sums = df.groupBy(*key, part).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(part).alias("_part"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key] + [F.col(part) == F.col("_part")]
    within = Window.partitionBy(*key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    done = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, on)
    return done.withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_in", "_before", "_part", *[f"_{k}" for k in key])


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 17, text: str = "text", source: str = "source", doc_id: str = "doc_id", shuffle_by: list[str] | None = None, block: int = 256) -> DataFrame:
    """doc_id, size, source_size, target, taken, first, second: one row per row of docs.

    size is the row's words, target its source's words to take, taken the words the schedule takes of
    the row; first and second are its words in the first and the second round through the source
    (taken = first + second).  Blocks hold `block` words; those of a source whose size or target is
    below 64 of them hold a 64th of it, a word at least, so that a small source comes near its target
    in any corpus.  A source's slots stop at `limit` rounds.  Null texts have size 0 and are never taken; a null source is a
    source, last in order.  Repeated rows are shuffled like any other.  Reruns agree: rows are shuffled
    by the hash of their text and of the columns shuffle_by (doc_id if None), so where doc_id differs
    from run to run, naming the other columns makes the mix the same up to equal rows.  Rows that tie in
    hash and id stand in either order.  An empty table gives no rows; other columns are ignored.
    Sources are ranked in one task, so they, not rows, must be few enough for it (millions).
    """
    sized = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), *[F.col(c) for c in shuffle_by or [doc_id]], F.xxhash64(F.col(text))).alias("h")))
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    plan = materialize(by_source)
    own = F.floor(F.least(F.col("source_size").cast("double"), "target") / LEAST_SLOTS)
    plan = plan.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), own)).cast("long")).withColumn("slots", F.col("target") / F.col("block"))
    wanted = float(plan.agg(F.sum("slots")).first()[0] or 0.0)
    slots = math.ceil(wanted)

    # cumulative shares of the sources on [0, 2^62), as fine as a double tells
    up = Window.orderBy(F.col("source").asc_nulls_last())
    edge = lambda x: F.least(F.floor(x / max(wanted, 1e-300) * float(2**62)).cast("long"), F.lit(2**62))
    shares = plan.withColumn("hi", edge(F.sum("slots").over(up.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("lo", edge(F.coalesce(F.sum("slots").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))).where("hi > lo")
    # a point meets its source through a grid of cells, so the number of sources is not bounded by a broadcast
    cell = 52
    shares = shares.select("source", "source_size", F.col("block").alias("words"), "lo", "hi", F.explode(F.sequence(F.shiftright("lo", cell), F.shiftright(F.col("hi") - 1, cell))).alias("cell"))
    drawn = docs.sparkSession.range(slots).withColumn("p", golden_point(F.col("id"))).withColumn("cell", F.shiftright("p", cell))
    drawn = drawn.join(shares, "cell").where("p >= lo and p < hi").select("source", "source_size", "words", "id", F.floor(F.col("id") / 8192).alias("chunk"), F.lit(1).alias("one"))
    ranked = _running(drawn, ["source"], "chunk", ["id"], "one", "rank")
    blocks = F.ceil(F.col("source_size") / F.col("words"))
    rounds = ranked.where(F.col("rank") < blocks * limit).select("source", F.pmod("rank", blocks).cast("long").alias("block")).groupBy("source", "block").agg(F.count("*").alias("times"))

    parts = max(1, sized.count() // 5000)
    live = sized.where("size > 0").withColumn("part", F.pmod(F.shiftrightunsigned("h", 8), F.lit(parts)).cast("int"))
    placed = _running(live, ["source"], "part", ["h", "doc_id"], "size", "at")
    length = plan.select(F.col("source").alias("_s"), F.col("block").alias("words"))
    pieces = placed.join(length, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    pieces = pieces.select("source", "doc_id", "h", "size", "at", "words", F.explode(F.sequence(F.floor(F.col("at") / F.col("words")), F.floor((F.col("at") + F.col("size") - 1) / F.col("words")))).alias("block"))
    covered = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("words")) - F.greatest("at", F.col("block") * F.col("words"))
    rounds = rounds.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "times")
    got = pieces.withColumn("covered", covered).join(rounds, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    taken = got.groupBy("source", "at", "doc_id", "size").agg(F.sum(F.when(F.col("times") >= 1, F.col("covered")).otherwise(0)).alias("first"), F.sum((F.col("times") - 1) * F.col("covered")).alias("second"))
    taken = taken.select(F.col("source").alias("_s"), F.col("at").alias("_at"), "first", "second")
    done = placed.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("_at")), "left").select("source", "doc_id", "size", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("second", F.lit(0)).alias("second"))
    done = done.unionByName(sized.where("size = 0").select("source", "doc_id", "size", F.lit(0).alias("first"), F.lit(0).alias("second")))
    plan = plan.select(F.col("source").alias("_s"), "source_size", "target")
    return done.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", (F.col("first") + F.col("second")).cast("long").alias("taken"), F.col("first").cast("long").alias("first"), F.col("second").cast("long").alias("second"))
