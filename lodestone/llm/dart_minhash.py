"""MinHash near-duplicates by DartMinHash.

Every element of a weighted set owns a strip (its weight) of the weight axis; hashed darts fall on the
(weight, rank) plane of each element as a Poisson process of unit intensity that depends on the
element alone.  Darts inside the strip count; each carries one of k coordinates, and the earliest
(lowest rank) dart of a coordinate is that coordinate's value.  Two sets agree on a coordinate with
probability equal to their weighted Jaccard similarity.  Only darts below a rank threshold of about
(k ln k) / total weight are looked at, and the threshold is doubled for a set that left a coordinate
empty, so the work is the number of elements plus O(k log k).

Pairs meet in bands of the signature and are then verified on their exact shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, materialize, mix64, trimmed, unit

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 18, 5
_WORD = re.compile(r"\w+")
#: Cumulative probabilities of a Poisson variable of mean 1, up to 17 darts in a cell.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))


def shingle_sets(texts: list[str], words: int, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owner, count): the distinct word shingles of each text, sorted by owner then hash.

    Words are the \\w+ runs of the lower-cased text.  A text of fewer words is one shingle; one
    without words but with other characters is its stripped self; null and blank texts have none.
    """
    ids, owners = [], []
    for i, text in enumerate(texts):
        found = _WORD.findall(text.lower()) if text else []
        if not found:
            found = [text.strip()] if text and text.strip() else []
        if not found:
            continue
        if len(cache) > 300_000:
            cache.clear()
        for w in found:
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, found), dtype=np.uint64, count=len(found))
        n = max(1, len(h) - words + 1)
        acc = np.full(n, np.uint64(min(len(h), words)), dtype=np.uint64)
        for j in range(min(words, len(h))):
            acc = mix64(acc ^ h[j : j + n])
        ids.append(acc)
        owners.append(np.full(n, i, dtype=np.int64))
    if not ids:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.float64)
    h, o = np.concatenate(ids), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.r_[at, len(h)]).astype(np.float64)


def darts(h: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """The n_sets x k signature: the hash of the earliest dart of every coordinate; 0 for empty sets."""
    out = np.zeros((n_sets, k), dtype=np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n_sets)
    theta = np.where(total > 0, k * (np.log(k) + 3.0) / np.maximum(total, 1e-300), 0.0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        chosen = np.zeros(n_sets, dtype=bool)
        chosen[todo] = True
        pick = chosen[owner]
        keys, ranks, names = _thrown(h[pick], owner[pick], weight[pick], theta, k)
        order = np.lexsort((names, ranks, keys))
        keys, names = keys[order], names[order]
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        out.reshape(-1)[keys[first]] = names[first]
        seen = np.bincount(keys[first] // k, minlength=n_sets)
        todo = todo[seen[todo] < k]
        theta[todo] *= 2.0
    return out


def _thrown(h, owner, weight, theta, k):
    """Darts below each set's threshold and inside its elements' strips: (set * k + coordinate, rank, hash)."""
    keys, ranks, names = [], [], []
    low, width, level = 0.0, 1.0, 0
    while len(h):
        cells = np.ceil(theta[owner] * width).astype(np.int64)
        at = np.repeat(np.arange(len(h)), cells)
        row = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        g = mix64(h[at] ^ mix64((np.uint64(level) << np.uint64(40)) + row.astype(np.uint64)))
        n = np.searchsorted(_POISSON, unit(g), side="right")
        cell = np.repeat(np.arange(len(at)), n)
        s = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
        a = mix64(g[cell] + mix64(s.astype(np.uint64) + np.uint64(1)))
        b, c = mix64(a), mix64(a ^ np.uint64(0x5DEECE66D))
        own = at[cell]
        rank = (row[cell] + unit(b)) / width
        keep = (rank < theta[owner[own]]) & (low + width * unit(c) < weight[own])
        keys.append(owner[own[keep]] * k + (a[keep] % np.uint64(k)).astype(np.int64))
        ranks.append(rank[keep])
        names.append(a[keep] | np.uint64(1))
        low, width, level = low + width, (width if level == 0 else width * 2.0), level + 1
        more = weight > low
        h, owner, weight = h[more], owner[more], weight[more]
    if not keys:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64)
    return np.concatenate(keys), np.concatenate(ranks), np.concatenate(names)


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weighting: str = "set", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, fp1, fp2, n, bands, coords): a 128-bit fingerprint of the weighted shingle set, its size, the hash of every band and 16 bits of every coordinate.

    weighting "set" gives every distinct shingle the weight 1 (plain Jaccard), "count" its number of
    occurrences (weighted Jaccard).  Texts without shingles have n = 0 and no bands.
    """
    k = bands * rows

    @trimmed
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for part in parts:
            for lo in range(0, len(part), 200):
                some = part.iloc[lo : lo + 200]
                h, o, w = shingle_sets(some["text"].tolist(), words, cache)
                w = w if weighting == "count" else np.ones_like(w)
                n = len(some)
                sig = darts(h, o, w, n, k)
                acc = np.zeros((n, bands), dtype=np.uint64)
                for r in range(rows):
                    acc = mix64(acc ^ sig[:, r::rows][:, :bands])
                acc = mix64(acc ^ np.arange(bands, dtype=np.uint64))
                size, f1, f2 = _fingerprints(h, o, w, n)
                yield pd.DataFrame({"doc": some["doc"].to_numpy(), "fp1": f1, "fp2": f2, "n": size, "bands": [list(b) if m else [] for b, m in zip(acc.view(np.int64), size, strict=True)], "coords": [c.tobytes() for c in (sig >> np.uint64(48)).astype(np.uint16)]})

    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).mapInPandas(run, "doc long, fp1 long, fp2 long, n long, bands array<long>, coords binary")


def _fingerprints(h: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of elements, two 64-bit sums over hashed elements) of each of n sets."""
    size, f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
    if len(at):
        own, each = owner[at], mix64(h ^ mix64(weight.astype(np.uint64)))
        size[own] = np.diff(np.r_[at, len(owner)])
        f1[own] = np.add.reduceat(each, at)
        f2[own] = np.add.reduceat(mix64(each), at)
    return size, f1.view(np.int64), f2.view(np.int64)


def _sets(docs: DataFrame, words: int, weighting: str) -> DataFrame:
    """(doc, fp1, fp2, hashes, counts): the sorted shingle hashes and counts of each text, as bytes."""

    @trimmed
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for part in parts:
            for lo in range(0, len(part), 200):
                some = part.iloc[lo : lo + 200]
                h, o, w = shingle_sets(some["text"].tolist(), words, cache)
                cut = np.searchsorted(o, np.arange(len(some) + 1))
                _, f1, f2 = _fingerprints(h, o, w if weighting == "count" else np.ones_like(w), len(some))
                yield pd.DataFrame({"doc": some["doc"].to_numpy(), "fp1": f1, "fp2": f2, "hashes": [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], "counts": [w[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    return docs.mapInPandas(run, "doc long, fp1 long, fp2 long, hashes binary, counts binary")


def _overlap(x: bytes, y: bytes, cx: bytes, cy: bytes, weighting: str) -> float:
    """Exact (weighted) Jaccard similarity of two packed sets."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    if weighting == "set":
        both, every = int(same.sum()), len(x) + len(y)
    else:
        p, q = np.frombuffer(cx, np.int32), np.frombuffer(cy, np.int32)
        both, every = int(np.minimum(p[same], q[at[same]]).sum()), int(p.sum() + q.sum())
    return both / max(1, every - both)


def _similar(weighting: str, threshold: float) -> Column:
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series, ca: pd.Series, cb: pd.Series) -> pd.Series:
        return pd.Series([_overlap(*x, weighting) >= threshold - 1e-12 for x in zip(a, b, ca, cb, strict=True)], dtype=bool)

    return similar("ha", "hb", "ca", "cb")


def _groups(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys of a sorted partition, each whole, one after the other."""
    kept: list[pd.DataFrame] = []
    for part in parts:
        if part.empty:
            continue
        k = part[keys].to_numpy()
        cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(part)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            run = part.iloc[a:b]
            if kept and not (kept[0][keys].iloc[0].to_numpy() == run[keys].iloc[0].to_numpy()).all():
                yield pd.concat(kept)
                kept = []
            kept.append(run)
    if kept:
        yield pd.concat(kept)


def _compare(bands: int, rows: int, threshold: float, weighting: str):
    """For sorted runs of (key, part): exact links between members of different components, enough to join all that are linked."""
    k = bands * rows
    least = (threshold - 5.0 * (threshold * (1.0 - threshold) / k) ** 0.5) * k

    @trimmed
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(parts, ["key", "part"]):
            g = g.sort_values("doc")
            doc, label, n, block = (g[c].to_numpy() for c in ("doc", "label", "n", "block"))
            root = {x: x for x in label.tolist()}

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            coords = np.frombuffer(b"".join(g["coords"]), np.uint16).reshape(-1, k)
            keys = np.array(g["bands"].tolist(), dtype=np.int64)
            values, counts = np.unique(label, return_counts=True)
            large = values[counts.argmax()]
            two = len(np.unique(block)) > 1
            found = []
            for i in np.flatnonzero(label != large):
                can = (label != label[i]) & ((label == large) | (doc > doc[i]))
                if two:  # a pair of blocks: what lies within one block is another run's work
                    can &= block != block[i]
                j = np.flatnonzero(can & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]) if weighting == "set" else can))
                first = (keys[j] == keys[i]).argmax(axis=1)  # every pair once: in the first band that it shares
                j = j[keys[i][first] == g["key"].iloc[0]]
                same = (coords[j] == coords[i]).sum(axis=1)
                for m in j[np.argsort(-same)][: int((same >= least).sum())]:
                    a, b = find(label[i]), find(label[m])
                    if a != b and _overlap(g["hashes"].iloc[i], g["hashes"].iloc[m], g["counts"].iloc[i], g["counts"].iloc[m], weighting) >= threshold - 1e-12:
                        root[max(a, b)] = min(a, b)
                        found.append((min(doc[i], doc[m]), max(doc[i], doc[m])))
            if found:
                yield pd.DataFrame(found, columns=["u", "v"])

    return run


def _perhaps(rows: DataFrame, wanted: DataFrame, slots: int = 1 << 26) -> DataFrame:
    """The rows whose doc is among those wanted, and few others, told by bitmaps of hashed ids that go to every task (8 MB at most).

    A join that shuffles the rows then need not shuffle all of their texts; if the bitmaps are full, it shuffles all, as it would anyway.
    """
    slot = F.pmod(F.xxhash64("doc"), F.lit(slots)) + 1
    maps = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substr("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(slot) == F.col("at"))
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def _met(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc is among those wanted, each once.

    The join is an inner one: Spark moves a semi join below that with the bitmaps, and would shuffle all rows first.
    """
    return _perhaps(rows, wanted).join(wanted.distinct(), "doc")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weighting: str = "set", block: int = 2000, salts: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, class_id, component_id, kept.

    Documents with equal shingle sets form one class (class_id, its smallest id), and only a class's
    representative is compared.  Two representatives that share a band are linked when their exact
    Jaccard similarity over five-word shingles is at least 0.8; component_id is the smallest id
    reachable by links, kept marks it.  Everyone in a bucket is first compared with the bucket's
    leader; members that then still lie in different components are compared with one another, in
    tasks of at most two blocks of `block` rows, and only links that join components leave a task.
    So no link that could join two components goes unseen, and a group of n copies yields about n
    rows.  At similarity 0.8 a pair shares a band with probability 0.9992; a pair is compared exactly
    unless its signature lies five standard deviations below the threshold.

    Null and blank texts are alone in their class.  Rows with the same id are one document, compared
    by the one of its texts with the largest shingle set, ties to the least fingerprint.  Rows with a
    null id are left out.  Texts are read whole, however long.  An empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    own = F.struct("n", (-F.col("fp1").cast("decimal(20,0)")).alias("f"), "fp1", "fp2", "bands", "coords")
    sig = materialize(signatures(docs, words, bands, rows, weighting, text, doc_id))
    again = sig.groupBy("doc").agg(F.count("*").alias("k")).where("k > 1").select("doc")
    if not again.isEmpty():  # ids that repeat, of which one row is chosen
        again = materialize(again)
        one = sig.join(again, "doc", "left_semi").groupBy("doc").agg(F.max(own).alias("o")).select("doc", "o.fp1", "o.fp2", "o.n", "o.bands", "o.coords")
        sig = materialize(sig.join(again, "doc", "left_anti").unionByName(one))
    some = sig.where("n > 0")
    classes = materialize(some.groupBy("fp1", "fp2").agg(F.min("doc").alias("class_id"), F.count("*").alias("m")))
    # classes of several members, once for each salt, so that a large one is not joined in one task
    shared = classes.where("m > 1").select("fp1", "fp2", "class_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = some.select("doc", "fp1", "fp2", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt"))
    member = sig.where("n = 0").select("doc", F.col("doc").alias("class_id")).union(salted.join(shared, ["fp1", "fp2", "salt"], "left").select("doc", F.coalesce("class_id", "doc")))
    reps = sig.join(classes.select(F.col("class_id").alias("doc")), "doc", "left_semi")
    keyed = reps.select("doc", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("doc").alias("leader")).where("m > 1")
    buckets = materialize(keyed.join(crowded, "key"))
    met = buckets.select("doc")
    texts = _met(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")), met)
    # of an id that repeats, the text whose signature was taken
    sets = _sets(texts, words, weighting).join(reps.select("doc", "fp1", "fp2"), ["doc", "fp1", "fp2"], "left_semi")
    sets = materialize(sets.groupBy("doc").agg(F.min(F.struct("hashes", "counts")).alias("s")).select("doc", "s.hashes", "s.counts"))

    star = buckets.where("doc <> leader").select(F.col("leader").alias("u"), F.col("doc").alias("v")).distinct()
    side = lambda d, h, c: sets.select(F.col("doc").alias(d), F.col("hashes").alias(h), F.col("counts").alias(c))
    links = materialize(star.join(side("v", "hb", "cb"), "v").join(side("u", "ha", "ca"), "u").where(_similar(weighting, threshold)).select("u", "v"))

    label = components(links)
    placed = buckets.join(label.select(F.col("node").alias("doc"), "component"), "doc", "left").select("key", "doc", "m", F.coalesce("component", "doc").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    blocks = F.ceil(F.col("m") / F.lit(float(block))).cast("int")
    placed = placed.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("doc"), blocks).cast("int"))
    # a run for every pair of blocks: block x takes part in the runs (x, y) and (y, x)
    mates = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda y: F.least("block", y) * blocks + F.greatest("block", y)))
    placed = placed.select("key", mates.alias("part"), "doc", "label", "block")
    placed = placed.join(reps.select("doc", "n", "bands", "coords"), "doc").join(sets, "doc")
    more = placed.repartition("key", "part").sortWithinPartitions("key", "part").mapInPandas(_compare(bands, rows, threshold, weighting), "u long, v long")
    label = materialize(components(links.union(more)))
    return member.join(label.select(F.col("node").alias("class_id"), "component"), "class_id", "left").select(F.col("doc").alias("doc_id"), "class_id", F.coalesce("component", "class_id").alias("component_id"), (F.col("doc") == F.coalesce("component", "class_id")).alias("kept"))
