"""Embedding near-duplicates by iterative quantisation.

Rotations are learned on a bounded sample so that the signs of the rotated, centred vectors are
balanced and close to them (Gong and Lazebnik 2011).  A vector's code is cut into substrings, one
hash table for each (multi-index hashing): two codes that differ in fewer bits than there are tables
agree on a whole substring.  Vectors that share a table's bucket are reranked by the cosine of the
original vectors in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, materialize


def fit_rotations(x: np.ndarray, bits: int, turns: int = 25, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection d x bits): as many learned rotations as the bits need."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    v, d = x - mean, x.shape[1]
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(turns if len(x) > d else 0):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        parts.append(r)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors with their greatest component moved near 1 by a power of two, so that no square over- or underflows and no bit is lost."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))
    return np.ldexp(x, -power)


def plan(n: int, threshold: float, miss: float, bucket: int = 256):
    """(width, tables of a width) for n rows: a bit of two vectors at the threshold agrees with probability 1 - angle / pi."""
    agree = 1.0 - math.acos(threshold) / math.pi
    width = min(30, max(4, math.ceil(math.log2(max(1, n) / bucket))))
    return width, lambda w: math.ceil(math.log(miss) / math.log1p(-(agree**w)))


def links(vectors: DataFrame, threshold: float = 0.9, tables: int | None = None, width: int | None = None, miss: float = 5e-4, sample: int = 4000, block: int = 2048, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors are linked when a table brings them together and their cosine is at least the
    threshold.  Substrings are as wide as keeps a bucket at a few hundred rows (log2 of the rows less 8
    bits, 4 at least), and so many tables are kept that a pair at the threshold is missed with
    probability `miss` at most; `plan` gives both, so the work of a row hardly grows with the table.
    Equal vectors are one class that is looked up once; its members are linked with one another and
    share its links.  Buckets are split into blocks, a task holds two blocks, and a pair counts in
    the first table that brings it together, so links are counted without being written out.
    Vectors of any finite length are told apart by their angle alone.  Vectors that are null, zero, or hold null or non-finite values link with nothing; vectors of
    different lengths neither.  Repeated ids are one row, by their least vector.  Rows with a null id are
    left out; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    v = F.col(vector)
    parts = F.transform(v, lambda c: c.cast("double"))
    fit_for = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.where(F.col(vec_id).isNotNull()).groupBy(F.col(vec_id).cast("long").alias("vec")).agg(F.min(F.when(fit_for, parts)).alias("x"))
    rows = materialize(rows)
    classes = materialize(rows.where("x is not null").groupBy("x").agg(F.min("vec").alias("class"), F.count("*").alias("m")))
    wide, many = plan(classes.count(), threshold, miss)
    width = width or wide
    tables = tables or many(width)
    bits = tables * width
    models = {}
    for (d,) in classes.select(F.size("x")).distinct().collect():  # a handful of vector lengths
        some = classes.where(F.size("x") == d).orderBy(F.xxhash64("class"), "class").limit(sample).select("x").toPandas()["x"]
        s = scaled(np.array(some.tolist(), dtype=np.float64).reshape(-1, d))
        models[d] = fit_rotations(s / np.linalg.norm(s, axis=1, keepdims=True), bits)
    place = 1 << np.arange(width)

    def code(batches):
        for part in batches:
            for d, g in part.groupby(part["x"].map(len)):
                mean, turn = models[d]
                for lo in range(0, len(g), 512):
                    some = g.iloc[lo : lo + 512]
                    y = scaled(np.array(some["x"].tolist(), dtype=np.float64))
                    y /= np.linalg.norm(y, axis=1, keepdims=True)
                    keys = (((y - mean) @ turn >= 0).reshape(len(some), tables, width) @ place).astype(np.int32)
                    yield pd.DataFrame({"class": some["class"], "m": some["m"], "x": some["x"], "keys": list(keys)})

    coded = materialize(classes.mapInPandas(code, "class long, m long, x array<double>, keys array<int>"))
    posted = coded.select(F.size("x").alias("d"), F.posexplode("keys").alias("t", "key"), "class")
    crowd = posted.groupBy("d", "t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / F.lit(float(block))).cast("int"))
    posted = posted.join(crowd, ["d", "t", "key"]).withColumn("b", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    mates = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.least("b", y) * F.col("blocks") + F.greatest("b", y)))
    posted = posted.select("d", "t", "key", mates.alias("part"), "b", "class").join(coded, "class")

    def compare(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t = key[1]
        g = g.sort_values("class")
        x = scaled(np.array(g["x"].tolist(), dtype=np.float64))
        norm = np.sqrt((x * x).sum(axis=1))
        keys, ids, m, b = np.array(g["keys"].tolist()), g["class"].to_numpy(), g["m"].to_numpy(), g["b"].to_numpy()
        two = len(np.unique(b)) > 1
        count, low = np.zeros(len(ids), np.int64), ids.copy()
        pairs = []
        for lo in range(0, len(ids), 512):
            c = (x[lo : lo + 512] @ x[lo:].T) / (norm[lo : lo + 512, None] * norm[None, lo:])
            i, j = np.nonzero(c >= threshold)
            i, j = i + lo, j + lo
            keep = (i < j) & ((b[i] != b[j]) if two else True)
            i, j = i[keep], j[keep]
            new = ~(keys[i, :t] == keys[j, :t]).any(axis=1)
            pairs.append((i[new], j[new]))
        i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
        np.add.at(count, i, m[j])
        np.add.at(count, j, m[i])
        while True:  # the least id that links reach within the task
            was = low.copy()
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
            if (was == low).all():
                break
        hit = count > 0
        return pd.DataFrame({"class": ids[hit], "links": count[hit], "low": low[hit]})

    found = materialize(posted.groupBy("d", "t", "key", "part").applyInPandas(compare, "class long, links long, low long"))
    label = components(found.select(F.col("class").alias("u"), F.col("low").alias("v")))
    total = found.groupBy("class").agg(F.sum("links").alias("links"))
    done = classes.join(total, "class", "left").join(label.select(F.col("node").alias("class"), "component"), "class", "left")
    done = done.select("x", F.col("m"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("component"))
    whole = rows.where("x is not null").join(done, "x").select("vec", (F.col("m") - 1 + F.col("links")).alias("n_links"), "component")
    whole = whole.union(rows.where("x is null").select("vec", F.lit(0).cast("long"), "vec"))
    return whole.select(F.col("vec").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec") == F.col("component")).alias("kept"))
