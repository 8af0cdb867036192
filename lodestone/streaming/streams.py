"""Structured Streaming jobs over the caller's streams; each equals its batch form.

Per key, rows are folded in order within a micro-batch and the state goes on to the next.  No job has a
watermark that drops rows unless the caller asks for one.
"""

from __future__ import annotations

import functools
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one; on one machine that names none, below a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="lodestone-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of a table's files; the last letter as a class makes the one path a pattern, as the source wants."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def drain(df: DataFrame, mode: str, write: Callable | None = None, out: str | None = None, checkpoint: str | None = None) -> str:
    """Run a stream over all that is there and return the folder of its output, a part `batch=<number>` for each micro-batch.

    A micro-batch that runs again after a failure replaces its part.  With the checkpoint of an earlier
    call the stream goes on where that one ended.
    """
    out = out or scratch(df.sparkSession)
    if write is None:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    put = write or (lambda rows, i: rows.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or scratch(df.sparkSession)).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return out


def replay(rows: DataFrame, order: Column, job: Callable[[DataFrame], DataFrame], mode: str, parts: int = 3, write: Callable | None = None) -> str:
    """Run a streaming job over a table as if its rows had come in `parts` batches in order, with a restart after each; returns the folder of the output.

    `order` is a whole number; rows are cut at its approximate quantiles and equal ones stay together, so each
    batch is later than all before it.  The job's state goes from run to run by its checkpoint.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("_order", order.cast("long"))
    cuts = sorted(set(numbered.approxQuantile("_order", [(i + 1) / parts for i in range(parts - 1)], 0.01))) if parts > 1 else []
    folder, checkpoint, out = scratch(spark), scratch(spark), scratch(spark)
    at = F.coalesce(F.col("_order"), F.lit(-(2**62)))
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        own = numbered if low is None else numbered.where(at > int(low))
        own = own if high is None else own.where(at <= int(high))
        own.drop("_order").write.parquet(f"{folder}/{i}")
        drain(job(spark.readStream.schema(rows.schema).parquet(f"{folder}/*")), mode, write, out, checkpoint)
    return out


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last update of every key that a drained stream wrote."""
    by = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return spark.read.parquet(out).withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r", "batch")


def _packed(rows: DataFrame, by: list[str]) -> Column:
    """The named columns as one text."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def fold(obs: DataFrame, keys: list[str], order: list[str], columns: list[str], start: tuple, step: Callable, out: str, buckets: int = 1024) -> DataFrame:
    """Rows emitted by step(state, row) -> (state, rows), over the rows of a key in order; a row has the named columns, a state what JSON holds.

    Keys are dealt to buckets by their hash.  The keys of a bucket are folded in one call and kept as one text, so a key costs
    no call of its own; a call holds a bucket's rows of one micro-batch.  A stream keeps its number of buckets.
    """
    names = [c.split()[0] for c in out.split(", ")]
    key = _packed(obs, keys).alias("_key")
    rows = obs.select(key, *dict.fromkeys([*order, *columns])).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))

    def run(_, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        states, done = json.loads(kept.get[0]) if kept.exists else {}, []
        rows = pd.concat(list(parts)).sort_values(order)
        for who, row in zip(rows["_key"], rows[columns].itertuples(index=False), strict=True):
            states[who], told = step(states.get(who, start), row)
            done += told
        kept.update((json.dumps(states),))
        yield pd.DataFrame(done, columns=names)

    return rows.groupBy("_bucket").applyInPandasWithState(run, out, "kept string", "append", GroupStateTimeout.NoTimeout)


def changes(obs: DataFrame, keys: list[str], order: list[str], id_: str) -> DataFrame:
    """(id, decision) of observations (id, status with 0 for a failure, digest, retained): each against the last hash stored before it."""

    def step(state, r):
        digest, kept = state
        if r.status == 304 and digest is not None and kept:
            return state, [(getattr(r, id_), "unchanged")]
        if r.status != 200 or r.digest is None:
            return state, [(getattr(r, id_), "invalid")]
        what = "new" if digest is None else "unchanged_same_hash" if digest == r.digest else "changed"
        return (r.digest, bool(r.retained)), [(getattr(r, id_), what)]

    return fold(obs, keys, order, [id_, "status", "digest", "retained"], (None, False), step, f"{id_} long, decision string")


def failure_alerts(obs: DataFrame, keys: list[str], order: list[str], id_: str) -> DataFrame:
    """(id) of the third failure in a row of observations (id, failed); a success starts anew."""

    def step(state, r):
        n = state[0] + 1 if r.failed else 0
        return (n,), [(getattr(r, id_),)] if n == 3 else []

    return fold(obs, keys, order, [id_, "failed"], (0,), step, f"{id_} long")


def late_rows(obs: DataFrame, keys: list[str], order: list[str], at: str, id_: str) -> DataFrame:
    """(id) of rows that are not later, by the whole number `at`, than one of their key that came before."""

    def step(state, r):
        now = int(getattr(r, at))
        return (max(state[0], now),), [(getattr(r, id_),)] if now <= state[0] else []

    return fold(obs, keys, order, [id_, at], (-(2**62),), step, f"{id_} long")


def state_updates(obs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys.., digest, verified, seen) after every micro-batch that has rows of a key: observations (keys, order, status with 0 for a failure, digest)."""
    at, ok = F.col(order), F.col("status") == 200
    return obs.groupBy(*keys).agg(F.max_by("digest", F.when(ok, at)).alias("digest"), F.max(F.when(F.col("status").isin(200, 304), at)).alias("verified"), F.max(at).alias("seen"))


def daily(rows: DataFrame, keys: list[str], at: str, value: Column, watermark: str | None = None) -> DataFrame:
    """(keys.., day, n, used) by tumbling one-day windows; a watermark, if given, bounds the state and drops what is later."""
    rows = rows.withColumn("_at", F.col(at).cast("timestamp")).withColumn("_v", value)
    rows = rows.withWatermark("_at", watermark) if watermark else rows
    return rows.groupBy(*keys, F.window("_at", "1 day").alias("_w")).agg(F.count("*").alias("n"), F.sum("_v").alias("used")).select(*keys, F.to_date("_w.start").alias("day"), "n", "used")


def distinct_observations(obs: DataFrame, on: list[str], at: str | None = None, within: str | None = None) -> DataFrame:
    """Observations without identical repeats; within a watermark on `at` if one is given, over all time otherwise."""
    if within:
        return obs.withWatermark(at, within).dropDuplicatesWithinWatermark(on)
    return obs.dropDuplicates(on)


def allowed_writes(writes: DataFrame, deletions: DataFrame, person: str) -> DataFrame:
    """The rows of a stream whose person has no deletion under way, by the table as it is at every batch."""
    return writes.join(deletions.select(F.col(person)).distinct(), person, "left_anti")


def late_writes(writes: DataFrame, deletions: DataFrame, person: str, at: str) -> DataFrame:
    """(the columns of writes, refused, late_no) of a stream of writes beside one of deletions (person, at).

    A write is refused once its person's deletion has begun: in an earlier micro-batch, or in its own by
    `at`, an equal instant included.  Deletions are kept as state per person, with the number of writes refused
    so far, which late_no counts on; a write without a person meets no deletion.  Rows of a person in a micro-batch
    are ordered by `at` in one worker.
    """
    kind = writes.schema
    whole = F.to_json(F.struct(*writes.columns), {"ignoreNullFields": "false"})
    key = F.col(person).cast("string").alias("_who")
    time = F.unix_micros(F.col(at).cast("timestamp")).alias("_at")
    rows = writes.where(F.col(person).isNotNull()).select(key, time, whole.alias("_row")).unionByName(deletions.where(F.col(person).isNotNull()).select(key, time, F.lit(None).cast("string").alias("_row")))

    def run(who, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, late = state.get if state.exists else (False, 0)
        told = []
        for row, _, _ in sorted(((r, t, r is not None) for p in parts for t, r in zip(p["_at"], p["_row"], strict=True)), key=lambda x: (x[1], x[2])):
            if row is None:
                begun = True
            else:
                late += begun
                told.append((row, begun, late if begun else -1))
        state.update((begun, late))
        yield pd.DataFrame(told, columns=["_row", "refused", "late_no"])

    judged = rows.groupBy("_who").applyInPandasWithState(run, "_row string, refused boolean, late_no long", "begun boolean, late long", "append", GroupStateTimeout.NoTimeout)
    nobody = writes.where(F.col(person).isNull()).select(whole.alias("_row"), F.lit(False).alias("refused"), F.lit(-1).cast("long").alias("late_no"))
    told = judged.unionByName(nobody)
    return told.select(F.from_json("_row", kind).alias("_r"), "refused", F.nullif("late_no", F.lit(-1).cast("long")).alias("late_no")).select("_r.*", "refused", "late_no")


def apart(out: str) -> Callable:
    """A foreachBatch function for late_writes: accepted and refused rows to tables of their own below `out`, a part for each micro-batch."""

    def put(rows: DataFrame, i: int) -> None:
        rows = rows.persist()
        for name, own in (("accepted", rows.where("NOT refused").drop("refused", "late_no")), ("refused", rows.where("refused").drop("refused"))):
            own.write.mode("overwrite").parquet(f"{out}/{name}/batch={i}")
        rows.unpersist()

    return put


def silence_alerts(beats: DataFrame, keys: list[str], at: str, limit: int = 129_600, delay: str = "0 seconds") -> DataFrame:
    """(keys.., last) once for every silence of a key: when it was last heard of before `limit` seconds passed without news.

    A timer of event time runs for every key and raises the alert as soon as the watermark, the newest `at` of all keys
    less the delay, is past it; news sets it anew.  A silence that only the news after it shows is told then.
    News of a null instant is none; what is older than the watermark is left out, as the stream has passed it.
    """
    rows = beats.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("timestamp").alias("_at"), F.unix_micros(F.col(at).cast("timestamp")).alias("_us")).withWatermark("_at", delay)
    out = ", ".join([*(f"{k} {beats.schema[k].dataType.simpleString()}" for k in keys), "last_us long"])

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, False)
        alerts = []
        if state.hasTimedOut:
            alerts, told = [last], True
        else:
            heard = np.sort(np.concatenate([p["_us"].to_numpy(np.int64) for p in parts]))
            heard = heard if last is None else heard[heard > last]
            if len(heard):
                before = np.r_[heard[0] if last is None else last, heard[:-1]]
                silent = heard - before > limit * 1_000_000
                silent[0] &= not told
                alerts, last, told = before[silent].tolist(), int(heard[-1]), False
        due = last // 1000 + limit * 1000
        if not told and due < state.getCurrentWatermarkMs():
            alerts, told = [*alerts, last], True
        state.update((last, told))
        if not told:
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({**{k: [v] * len(alerts) for k, v in zip(keys, key, strict=True)}, "last_us": alerts})

    found = rows.groupBy(*keys).applyInPandasWithState(run, out, "last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*keys, F.timestamp_micros("last_us").alias("last"))


def ledger_changes(records: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    """(by.., dims.., n, open, rows, and which reservation it is about) of a ledger's records, from which `summed` tells how every micro-batch changes the totals.

    records (kind, seq, reservation_seq, run, by.., dims..).  A reservation counts in full until its own run
    settles it, and later settlements may raise what it counts; a settlement may come before its
    reservation.  What counts is as in `usage.settle`; a reservation's (seq, run) is its own, a repeat is dropped.
    """
    amount = [F.coalesce(F.col(d), F.lit(0)).cast("long").alias(d) for d in dims]
    count = lambda c, n: c.cast("long").alias(n)
    held = F.col("kind") == "reservation"
    seq = F.when(held, F.col("seq")).otherwise(F.col("reservation_seq"))
    own = records.where("kind IN ('reservation', 'settlement') AND run IS NOT NULL").where(seq.isNotNull())
    own = own.select(*by, *amount, *[count(F.lit(0), c) for c in ("n", "open", "rows")], seq.alias("_seq"), F.col("run").cast("string").alias("_run"), held.alias("_held"))
    plain = records.where("kind = 'pre_ledger_usage' OR (kind = 'reservation' AND (run IS NULL OR seq IS NULL))")
    return own.unionByName(plain.select(*by, *amount, count(F.lit(1), "n"), count(held, "open"), count(F.lit(1), "rows")), allowMissingColumns=True)


def admission_changes(events: DataFrame, by: list[str], dims: list[str], limits: dict[str, int]) -> DataFrame:
    """As ledger_changes, for events (kind admission or settlement, run, by..): an admission counts at the limits until its run settles anything."""
    rows = events.where("kind IN ('admission', 'settlement') AND run IS NOT NULL")
    held = F.col("kind") == "admission"
    count = lambda n, c: F.when(held, n).otherwise(0).cast("long").alias(c)
    return rows.select(*by, *[count(limits.get(d, 0), d) for d in dims], count(0, "n"), count(0, "open"), count(1, "rows"), F.col("run").cast("string").alias("_run"), held.alias("_held"))


def _of_reservations(rows: DataFrame, by: list[str], values: list[str]) -> tuple[DataFrame, Callable]:
    """A micro-batch's rows by reservation, to be kept, and the changes of totals from what is kept (with batch) at a micro-batch."""
    dims = [c for c in values if c not in ("n", "open", "rows")]
    own = rows.where("_run IS NOT NULL").groupBy("_seq", "_run").agg(F.min(F.when(F.col("_held"), F.struct(*by, *dims))).alias("_own"), *[F.max(F.when(~F.col("_held"), F.col(d))).alias(f"_most_{d}") for d in dims], F.bool_or(~F.col("_held")).alias("_done"))

    def changes(kept: DataFrame, i: int) -> DataFrame:
        earlier = F.col("batch") < i
        sides = {"_a": F.lit(True), "_b": earlier}  # after and before
        told = kept.groupBy("_seq", "_run").agg(
            F.bool_or(~earlier).alias("_now"),
            *[F.min_by("_own", F.when(F.col("_own").isNotNull() & when, F.col("batch"))).alias(f"_own{s}") for s, when in sides.items()],
            *[F.max(F.when(when, F.col(f"_most_{d}"))).alias(f"_most_{d}{s}") for d in dims for s, when in sides.items()],
            *[F.coalesce(F.bool_or(F.when(when, F.col("_done"))), F.lit(False)).alias(f"_done{s}") for s, when in sides.items()],
        )

        def counts(d: str, s: str) -> Column:
            amount = F.col(f"_own{s}")[d]
            return F.when(F.col(f"_own{s}").isNull(), 0).when(F.col(f"_done{s}"), F.least(amount, F.greatest(F.col(f"_most_{d}{s}"), F.lit(0)))).otherwise(amount)

        there = lambda s: F.col(f"_own{s}").isNotNull()
        open_ = lambda s: (there(s) & ~F.col(f"_done{s}")).cast("long")
        new = (there("_a").cast("long") - there("_b").cast("long")).alias
        told = told.where("_now AND _own_a IS NOT NULL")
        return told.select(*[F.col("_own_a")[b].alias(b) for b in by], *[(counts(d, "_a") - counts(d, "_b")).alias(d) for d in dims], new("n"), (open_("_a") - open_("_b")).alias("open"), new("rows"))

    return own, changes


def _of_admissions(rows: DataFrame, by: list[str], values: list[str]) -> tuple[DataFrame, Callable]:
    """As _of_reservations, for the admissions and settlements of runs."""
    own = rows.groupBy("_run", *[F.when(F.col("_held"), F.col(b)).alias(b) for b in by]).agg(*[F.sum(c).alias(c) for c in values], F.bool_or(~F.col("_held")).alias("_done"))

    def changes(kept: DataFrame, i: int) -> DataFrame:
        earlier, run = F.col("batch") < i, Window.partitionBy("_run")
        told = kept.groupBy("_run", *by).agg(*[F.sum(c).alias(c) for c in values], *[F.coalesce(F.sum(F.when(earlier, F.col(c))), F.lit(0)).alias(f"_b_{c}") for c in values], F.bool_or("_done").alias("_done"), F.coalesce(F.bool_or(earlier & F.col("_done")), F.lit(False)).alias("_done_b"), F.bool_or(~earlier).alias("_now"))
        told = told.withColumns({c: F.bool_or(c).over(run) for c in ("_done", "_done_b", "_now")}).where("_now AND NOT _done_b")
        return told.select(*by, *[(F.when(F.col("_done"), 0).otherwise(F.col(c)) - F.col(f"_b_{c}")).alias(c) for c in values]).where(" OR ".join(f"`{c}` <> 0" for c in values))

    return own, changes


def summed(by: list[str], out: str) -> Callable:
    """A foreachBatch function that keeps by how much every micro-batch of a ledger changes its totals, as signed sums by group, below `out`.

    What reservations and runs have come to is kept beside it, a part `batch=<number>` for each micro-batch, so the state is a
    table in the shared folder and not in anyone's memory; a micro-batch that runs again replaces both its parts.
    """

    def put(rows: DataFrame, i: int) -> None:
        values = [c for c in rows.columns if c not in by and not c.startswith("_")]
        if "_run" in rows.columns:
            own, changes = (_of_reservations if "_seq" in rows.columns else _of_admissions)(rows, by, values)
            own.write.mode("overwrite").parquet(f"{out}-kept/batch={i}")
            kept = rows.sparkSession.read.parquet(f"{out}-kept").where(F.col("batch") <= i)
            rows = rows.where("_run IS NULL").select(*by, *values).unionByName(changes(kept, i))
        rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in values]).write.mode("overwrite").parquet(f"{out}/batch={i}")

    return put


def rolled_up(changes: list[DataFrame], by: dict[str, Column]) -> DataFrame:
    """Totals of changes by coarser groups, such as months of days; groups that hold nothing any more are left out."""
    rows = functools.reduce(DataFrame.unionByName, changes)
    values = [c for c in rows.columns if rows.schema[c].dataType.simpleString() == "bigint" and c not in by]
    return rows.groupBy(*[c.alias(k) for k, c in by.items()]).agg(*[F.sum(c).cast("bigint").alias(c) for c in values]).where("rows > 0").drop("rows")


def stale(status: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys.., last) after every micro-batch: when a key was last heard of, in whole seconds; `last` more than a limit ago is stale."""
    return status.groupBy(*keys).agg(F.max(F.unix_timestamp(F.col(at).cast("timestamp"))).alias("last"))


def guarded_append(path: str, id_: str, digest: str) -> Callable:
    """A foreachBatch function that appends rows new by id to the table at path and refuses a batch that would change what an id stands for.

    A batch is refused whole if one of its ids has two digests, in it or beside what is stored, or if an id or a
    digest is null.  Identical repeats are dropped.  A batch's rows are the part `batch=<number>`, which a
    batch that runs again replaces, so it is appended once.
    """

    def put(rows: DataFrame, i: int) -> None:
        rows = rows.dropDuplicates().persist()
        try:
            if not rows.where(F.col(id_).isNull() | F.col(digest).isNull()).isEmpty():
                raise ValueError(f"batch {i} has a row without {id_} or {digest}")
            if not rows.groupBy(id_).agg(F.count_distinct(digest).alias("_n")).where("_n > 1").isEmpty():
                raise ValueError(f"batch {i} says two things of one {id_}")
            stored = rows.sparkSession.read.parquet(path)
            known = stored.where(F.col("batch") != i).select(F.col(id_), F.col(digest).alias("_old"))
            met = rows.join(known, id_, "left")
            if not met.where(F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col(digest))).isEmpty():
                raise ValueError(f"batch {i} changes stored rows")
            met.where("_old IS NULL").drop("_old").write.mode("overwrite").parquet(f"{path}/batch={i}")
        finally:
            rows.unpersist()

    return put
