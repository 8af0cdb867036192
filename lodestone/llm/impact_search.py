"""Exact top-k inner products over integer vectors with an impact-ordered index.

Candidates lie in shards; a shard's index is built once and answers every query.  In it each
dimension's values are quantised to levels, and a posting segment holds the rows of one (dimension,
level).  A query's segments are processed by descending quantised impact, a band of impacts at a time
and for a batch of queries at once; after every band each row's score has an upper bound.  A query
stops only when the bounds prove that few rows can be among its k best, and all rows that still can are
scored again exactly.  Every query first meets a bounded seed set, whose exact k-th score is the
threshold that it carries into all shards.  Each shard's best k of each query are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, trimmed

#: Shares of a query's postings that its bands of descending impact reach.
BANDS = (0.75, 1.0)
NEVER = -(2**62)


class Shard:
    """The impact-ordered index of some integer vectors of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, width: int = 16):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order].astype(np.int64)
        self.n, self.d = self.x.shape
        self.most = int(np.abs(self.x).max()) if self.x.size else 0
        self.rows, dim, low, high = [], [], [], []
        for d in range(self.d):
            v = self.x[:, d]
            by = np.argsort(v // width, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff((v // width)[by]) != 0, True])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                rows = np.sort(by[a:b])
                self.rows.append(rows)
                dim.append(d)
                low.append(v[rows].min())
                high.append(v[rows].max())
        self.dim = np.array(dim, dtype=np.int64)
        self.low, self.high = (np.array(v, dtype=np.int64) for v in (low, high))
        self.size = np.array([len(r) for r in self.rows], dtype=np.int64)

    def search(self, own: np.ndarray, q: np.ndarray, at_least: np.ndarray, k: int, batch: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best rows of every query other than rows of its own id, ties to smaller ids.

        at_least: a score per query that its k-th best is known to reach; rows below it may be left out.
        """
        if self.most * int(np.abs(q).max() if q.size else 0) * max(1, self.d) >= 2**62:
            raise ValueError("the inner products of these vectors do not fit 64 bits")
        parts = [self._batch(own[lo : lo + batch], q[lo : lo + batch].astype(np.int64), at_least[lo : lo + batch], k) for lo in range(0, len(q) if self.n else 0, batch)]
        return tuple(np.concatenate(p) if parts else np.empty(0, np.int64) for p in (zip(*parts, strict=True) if parts else ((), (), ())))

    def _batch(self, own, q, at_least, k):
        w = q[:, self.dim].T  # segment by query
        low, high = w * self.low[:, None], w * self.high[:, None]
        top, bottom = np.maximum(low, high), np.minimum(low, high)
        floor = np.zeros((self.d, len(q)), np.int64)  # no value of the dimension gives less
        starts = np.flatnonzero(np.r_[True, np.diff(self.dim) != 0]) if self.d else np.empty(0, np.int64)
        if self.d:
            floor = np.minimum.reduceat(bottom, starts, axis=0)
        gain = top - floor[self.dim]
        err = np.maximum.reduceat(top - bottom, starts, axis=0).sum(axis=0) if self.d else np.zeros(len(q), np.int64)
        base = floor.sum(axis=0)
        bits = int(self.d).bit_length()
        total = int(np.maximum.reduceat(gain, starts, axis=0).sum(axis=0).max()) if self.d else 0
        kind = np.int32 if (total << bits) < 2**31 else np.int64
        if (total << bits) >= 2**62:
            return self._exact(np.ones((self.n, len(q)), bool), own, q, k)
        # the impact down to which a band reaches, by query
        order = np.argsort(-gain, axis=0)
        share = np.cumsum(self.size[order], axis=0) / max(1, self.size.sum())
        acc = np.zeros((self.n, len(q)), kind)  # what the processed segments give over their floors, and how many they are
        live, above = np.arange(len(q)), None
        possible = np.zeros((self.n, len(q)), bool)
        for band in BANDS:
            last = np.minimum((share < band).sum(axis=0), len(order) - 1) if self.d else np.zeros(len(q), np.int64)
            down = np.take_along_axis(gain, order, 0)[last, np.arange(len(q))] if band < 1 and self.d else np.full(len(q), NEVER)
            now = gain >= down if above is None else (gain >= down) & (gain < above)
            now = now[:, live]
            add = np.where(now, (gain[:, live] << bits) + 1, 0).astype(kind)
            for s in np.flatnonzero(now.any(axis=1)):
                acc[self.rows[s]] += add[s]
            above = down
            rest = np.maximum(down[live], 0)  # no segment yet to come gives more
            bound = base[live] + (acc >> bits) + (self.d - (acc & ((1 << bits) - 1))) * rest
            self._strike(bound, own[live])
            need = at_least[live]
            if band == 1 and self.n >= k:  # the k-th best lower bound of the shard
                need = np.maximum(need, np.partition(bound, self.n - k, axis=0)[self.n - k] - err[live])
            can = (bound >= need) & (bound > NEVER)
            done = (can.sum(axis=0) <= 4 * k) | (band == 1)
            possible[:, live[done]] = can[:, done]
            if done.all():
                break
            if done.any():
                live, acc = live[~done], np.ascontiguousarray(acc[:, ~done])
        return self._exact(possible, own, q, k)

    def _strike(self, bound, own) -> None:
        """A query's own rows are no candidates."""
        a, b = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        for c in np.flatnonzero(b > a):
            bound[a[c] : b[c], c] = NEVER

    def _exact(self, possible, own, q, k):
        c, r = np.nonzero(possible.T)
        keep = self.ids[r] != own[c]
        c, r = c[keep], r[keep]
        score = np.concatenate([np.einsum("pd,pd->p", self.x[r[lo : lo + 50_000]], q[c[lo : lo + 50_000]]) for lo in range(0, len(r), 50_000)] or [np.empty(0, np.int64)])
        by = np.lexsort((self.ids[r], -score, c))
        c, r, score = c[by], r[by], score[by]
        rank = np.arange(len(c)) - np.searchsorted(c, c, "left")
        keep = rank < k
        return own[c[keep]], self.ids[r[keep]], score[keep]


def quantise(vectors: DataFrame, scale: float = 256.0, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec, x ARRAY<BIGINT>): floor(scale * value) of every vector without null or non-finite parts; a part beyond 64 bits is an error."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**62, F.floor(c.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component does not fit 64 bits")).cast("long"))
    return vectors.where(F.col(vec_id).isNotNull() & v.isNotNull() & finite).select(F.col(vec_id).cast("long").alias("vec"), F.transform(v, whole).alias("x"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard: int = 8192, seeds: int = 1024, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every row whose id is divisible by `every`.

    Candidates are all rows but the query's own id; ties go to smaller ids; fewer rows than k are all
    returned.  Vectors that are null, or hold null or non-finite values, take no part; vectors of
    different lengths are only compared with their like.  Rows that share an id are candidates of their own to others
    and none to each other; a query's id that repeats asks once for each of its rows, for one list.
    Scores that could leave 64 bits are an error.  An empty table gives no rows; other columns of the
    table, whatever their names, are ignored.

    Queries stream through each shard of about `shard` rows, so a task holds one shard and one batch of
    queries.  At most `seeds` rows, first by the hash of their id, reach the driver; they only bound
    the search from below, and are candidates in their shards like any row.
    """
    rows = materialize(quantise(vectors, vector=vector, vec_id=vec_id).withColumn("len", F.size("x")))
    shards = max(1, -(-rows.count() // shard))
    some = rows.orderBy(F.xxhash64("vec"), "vec", "x").limit(seeds).toPandas()
    known = {int(n): (g["vec"].to_numpy(), _matrix(g["x"])) for n, g in some.groupby("len")}
    kind = "len int, vec long, x array<long>, at_least long"

    @trimmed
    def seeded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {n: Shard(*v) for n, v in known.items()}
        for part in parts:
            for n, g in part.groupby("len"):
                best: dict[int, list[int]] = {}
                if n in index:
                    for i, s in zip(*(c.tolist() for c in index[n].search(g["vec"].to_numpy(), _matrix(g["x"]), np.full(len(g), NEVER), k)[::2]), strict=True):
                        best.setdefault(i, []).append(s)
                yield pd.DataFrame({"len": n, "vec": g["vec"], "x": g["x"], "at_least": [sorted(best[i], reverse=True)[k - 1] if len(best.get(i, ())) >= k else NEVER for i in g["vec"]]})

    asks = rows.where(F.pmod("vec", F.lit(every)) == 0)
    asks = materialize(asks.select("len", "vec", "x").mapInPandas(seeded, kind))
    c = rows.select("len", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec", "x", F.lit(NEVER).cast("long").alias("at_least"))
    q = asks.select("len", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec", "x", "at_least")

    @trimmed
    def answer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, index = None, [], None
        for part in parts:
            for (n, s, asking), g in part.groupby(["len", "shard", "asks"], sort=True):
                if (n, s) != key:
                    key, held, index = (n, s), [], None
                if not asking:
                    held.append((g["vec"].to_numpy(), _matrix(g["x"])))
                    continue
                if index is None and held:
                    index = Shard(np.concatenate([v for v, _ in held]), np.concatenate([x for _, x in held]))
                if index is not None:
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), index.search(g["vec"].to_numpy(), _matrix(g["x"]), g["at_least"].to_numpy(), k), strict=True)))

    met = c.unionByName(q).repartition("len", "shard").sortWithinPartitions("len", "shard", "asks")
    best = met.mapInPandas(answer, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
