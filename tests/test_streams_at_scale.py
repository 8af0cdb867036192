"""Streams of many keys: what their state is made of, and totals of a ledger against those of all its records at once."""

import os
import random

from pyspark.sql import functions as F

from lodestone.operators import usage
from lodestone.streaming import streams

LEDGER = "kind string, seq long, reservation_seq long, run string, job string, day string, up long, down long"


def stream_of(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_keys_share_the_calls_and_the_state_of_a_bucket(spark, tmp_path):
    n, schema = 3000, "id long, who string, at long, status int, digest string, retained boolean"
    out, checkpoint, found = f"{tmp_path}/out", f"{tmp_path}/checkpoint", []
    for batch in range(2):
        rows = [(batch * n + i, f'k"{i}' if i else None, batch, 200 if (i + batch) % 4 else 304, f"d{i % 3 if batch else i % 2}", i % 5 > 0) for i in range(n)]
        found += rows
        streams.drain(streams.changes(stream_of(spark, f"{tmp_path}/in", rows, schema), ["who"], ["at", "id"], "id"), "append", None, out, checkpoint)
    want, last = {}, {}
    for id_, who, _, status, digest, retained in found:
        before, kept = last.get(who, (None, False))
        want[id_] = "unchanged" if status == 304 and before and kept else "invalid" if status != 200 else "new" if before is None else "unchanged_same_hash" if before == digest else "changed"
        last[who] = (digest, retained) if status == 200 else (before, kept)
    assert {r.id: r.decision for r in spark.read.parquet(out).collect()} == want
    assert len(set(want.values())) == 5
    assert spark.read.format("statestore").load(checkpoint).count() <= 1024


def test_a_ledger_keeps_no_state_a_key_and_equals_its_records_at_once(spark, tmp_path):
    dice, by, dims = random.Random(3), ["job", "day"], ["up", "down"]
    amount = lambda: dice.choice([None, dice.randint(0, 90)])
    rows = [("reservation", i, None, f"r{i % 37}" if i % 11 else None, f"j{i % 3}", f"2026-01-0{i % 5 + 1}", amount(), amount()) for i in range(200)]
    rows += [("settlement", 1000 + i, dice.randint(0, 199), f"r{dice.randint(0, 36)}" if i % 9 else None, None, None, amount(), amount()) for i in range(600)]
    rows += [("settlement", 2000 + i, i, f"r{i % 37}", "x", None, amount(), amount()) for i in range(0, 200, 2)] + [("pre_ledger_usage", None, None, None, None, "2026-02-01", 5, None)]
    dice.shuffle(rows)
    out, checkpoint = f"{tmp_path}/sums", f"{tmp_path}/checkpoint"
    put = streams.summed(by, out)
    for k in range(4):
        own = rows[k::4]
        streams.drain(streams.ledger_changes(stream_of(spark, f"{tmp_path}/in", own, LEDGER), by, dims), "append", put, out, checkpoint)
        put(streams.ledger_changes(spark.createDataFrame(own, LEDGER), by, dims), k)  # the micro-batch runs again
        told = streams.rolled_up([spark.read.parquet(out).drop("batch")], {b: F.col(b) for b in by})
        whole = spark.createDataFrame([r for j in range(k + 1) for r in rows[j::4]], LEDGER)
        plain = usage.usage(whole.where("kind <> 'settlement' OR run IS NOT NULL"), by, dims)
        assert sorted(map(str, map(tuple, told.collect()))) == sorted(map(str, map(tuple, plain.select(told.columns).collect())))
    assert not os.path.exists(f"{checkpoint}/state")


def test_admissions_equal_a_plain_count_after_every_batch(spark, tmp_path):
    dice, out = random.Random(5), f"{tmp_path}/sums"
    events = [(dice.choice(["admission", "admission", "settlement"]), f"r{dice.randint(0, 60)}", f"j{dice.randint(0, 2)}") for _ in range(160)]
    put = streams.summed(["job"], out)
    for k in range(4):
        rows = streams.admission_changes(spark.createDataFrame(events[40 * k : 40 * k + 40], "kind string, run string, job string"), ["job"], ["up"], {"up": 7})
        for _ in range(2):
            put(rows, k)
        seen = events[: 40 * k + 40]
        settled = {run for kind, run, _ in seen if kind == "settlement"}
        want = {}
        for kind, run, job in seen:
            if kind == "admission" and run not in settled:
                want[job] = want.get(job, 0) + 7
        told = streams.rolled_up([spark.read.parquet(out).drop("batch")], {"job": F.col("job")})
        assert {r.job: r.up for r in told.collect()} == want
