"""Toxicity by a convolutional text classifier in numpy.

A word is the sum of hashed embeddings: one for the word, and the scaled sum of those of its character
four-grams.  Filters of several widths slide over the words, each is max-pooled over the text, and a
logistic layer reads the maxima.  Max pooling lets the gradient reach only the windows that won, so
training is light.  The decision threshold is calibrated for each language, which is guessed from
the text alone by word counts; the score is shifted so that 0.5 is the threshold.

Every labelled text is learned from, whole.  Training is a few rounds of Spark jobs: each task descends
over its own texts from the same parameters, Spark averages what the tasks changed, and the average is where
the next round starts.  Language counts and the scores that thresholds are taken from are summed in Spark as
well, so the driver holds a table of fixed size and no text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, drop, mix64, stored, trimmed

_WORD = re.compile(r"\w+")
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 12, 8, (1, 2, 3)
SLOTS = [(w, o) for w in WIDTHS for o in range(w)]
#: Hashed words that tell languages; rows of embeddings averaged at once; steps of scores in a unit, for thresholds.
PROFILE, BLOCK, GRID = 1 << 15, 1 << 10, 256


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, buckets of all four-grams, owner of each four-gram)."""
    c = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.array([len(w) + 2 for w in words])
    end = np.cumsum(n)
    owner = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(c)) - np.repeat(end - n, n)
    whole = mix64(np.add.reduceat(mix64(c + (at.astype(np.uint64) << np.uint64(32))), end - n))
    i = np.flatnonzero(np.arange(len(c)) + 3 < end[owner])
    pair = lambda k: c[i + k] + (c[i + k + 1] << np.uint64(32))
    gram = mix64(mix64(pair(0)) ^ pair(2))
    return (whole % np.uint64(BUCKETS)).astype(np.int64), (gram % np.uint64(BUCKETS)).astype(np.int64), owner[i]


def hashed_in_parts(words: list[str], size: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hashed, of a part of the words at a time and in 32 bits, as its working arrays are many times its result."""
    whole, grams, owner = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for lo in range(0, len(words), size):
        w, g, o = hashed(words[lo : lo + size])
        whole.append(w.astype(np.int32))
        grams.append(g.astype(np.int32))
        owner.append((o + lo).astype(np.int32))
    return np.concatenate(whole), np.concatenate(grams), np.concatenate(owner)


class TextCnn:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.filters = rng.normal(0, 0.4, (len(SLOTS), DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(0.0)
        self.langs: list[str] = []
        self.profile = np.zeros((PROFILE, 1), np.float32)
        self.threshold = np.zeros(1)

    def vectors(self, whole: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The embedding of each word: of its bucket and of its n four-grams, which lie one word after the other."""
        v = self.emb[whole]
        some = np.flatnonzero(n)
        if len(some):
            first = np.cumsum(n[some]) - n[some]
            v[some] += np.add.reduceat(self.emb[grams], first) / np.sqrt(n[some])[:, None]
        return v

    def projected(self, whole: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """What each word, as from `hashed`, adds to every (width, offset, filter)."""
        return np.einsum("nd,sdf->nsf", self.vectors(whole, grams, np.bincount(owner, minlength=len(whole))), self.filters, optimize=True).astype(np.float32)

    def pooled(self, proj: np.ndarray, at: np.ndarray, sizes: np.ndarray, step: int = 20_000) -> np.ndarray:
        """The maximum of every filter over each text; at: word rows of all texts, each followed by two 0 rows."""
        top = np.full((len(sizes), len(self.bias)), -np.inf, np.float32)
        ends = np.cumsum(sizes + 2)
        owner = np.repeat(np.arange(len(sizes)), sizes + 2)
        real = np.arange(len(at)) < (ends - 2)[owner]
        for lo in range(0, len(at), step):
            hi = min(len(at), lo + step)
            some = proj[at[lo : min(len(at), hi + 2)]]
            n, s = hi - lo, 0
            if len(some) < n + 2:
                some = np.concatenate([some, np.zeros((n + 2 - len(some), *some.shape[1:]), np.float32)])
            y, own = np.empty((n, len(self.bias)), np.float32), owner[lo:hi]
            for m, w in enumerate(WIDTHS):
                part = y[:, m * FILTERS : (m + 1) * FILTERS]
                part[:] = some[:n, s]
                for o in range(1, w):
                    part += some[o : o + n, s + o]
                s += w
            y[~real[lo:hi]] = -np.inf  # the rows of 0 start no window
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            top[own[first]] = np.maximum(top[own[first]], np.maximum.reduceat(y, first))
        return top

    def logits(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + self.bias, 0.0) @ self.out + self.base

    def state(self) -> dict[str, np.ndarray]:
        """The start of Adagrad's sums."""
        return {k: np.full_like(getattr(self, k), 1e-3) for k in ("emb", "filters", "bias", "out", "base")}

    def fit(self, words: list[str], rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, sums: dict[str, np.ndarray], epochs: int = 8, batch: int = 32, rate: float = 0.1, seed: int = 2) -> None:
        """Adagrad on the weighted logistic loss, from its sums so far; words and rows as from `numbered`."""
        if not words:
            return
        whole, grams, owner = hashed_in_parts(words)
        start = np.searchsorted(owner, np.arange(len(words) + 1))
        del owner
        rng = np.random.default_rng(seed)

        def grams_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = start[own + 1] - start[own]
            return grams[np.repeat(start[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], n

        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                used, at = np.unique(np.concatenate([rows[i] for i in some]), return_inverse=True)
                x = np.zeros((len(used), DIM), np.float32)
                lead = int(used[0] == 0)
                if len(used) > lead:
                    x[lead:] = self.vectors(whole[used[lead:] - 1], *grams_of(used[lead:] - 1))
                proj = np.einsum("nd,sdf->nsf", x, self.filters, optimize=True)
                y, win, d = np.zeros((len(some), len(self.bias)), np.float32), np.zeros((len(some), len(self.bias)), np.int64), 0
                for k, i in enumerate(some):
                    n = len(rows[i]) - 2
                    if n:
                        p, s = proj[at[d : d + n + 2]], 0
                        for m, w in enumerate(WIDTHS):
                            z = sum(p[o : o + n, s + o] for o in range(w))
                            f = slice(m * FILTERS, (m + 1) * FILTERS)
                            win[k, f] = z.argmax(axis=0) + d
                            y[k, f] = z.max(axis=0)
                            s += w
                    d += n + 2
                hidden = np.maximum(y + self.bias, 0.0)
                err = 1.0 / (1.0 + np.exp(-np.clip(hidden @ self.out + self.base, -30, 30))) - labels[some]
                err = (err * weights[some] / len(some)).astype(np.float32)
                dh = err[:, None] * self.out * (hidden > 0)
                dx, df = np.zeros_like(x), np.zeros_like(self.filters)
                s = 0
                for m, w in enumerate(WIDTHS):
                    f = slice(m * FILTERS, (m + 1) * FILTERS)
                    for o in range(w):
                        r = at[win[:, f] + o]
                        g = dh[:, f]
                        np.add.at(dx, r, g[..., None] * self.filters[s + o].T[None])
                        df[s + o] = np.einsum("kfd,kf->df", x[r], g)
                    s += w
                dx[:lead] = 0
                hit = np.flatnonzero(np.abs(dx).sum(axis=1) > 0)
                own = used[hit] - 1
                if len(own):
                    flat, n = grams_of(own)
                    bucket = np.concatenate([whole[own], flat])
                    grad = np.concatenate([dx[hit], np.repeat(dx[hit] / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)])
                    place, inv = np.unique(bucket, return_inverse=True)
                    g = np.zeros((len(place), DIM), np.float32)
                    np.add.at(g, inv, grad)
                    sums["emb"][place] += g * g
                    self.emb[place] -= rate * g / np.sqrt(sums["emb"][place])
                for k, g in (("filters", df), ("bias", dh.sum(axis=0)), ("out", err @ hidden), ("base", err.sum())):
                    sums[k] = sums[k] + g * g
                    setattr(self, k, (getattr(self, k) - rate * g / np.sqrt(sums[k])).astype(np.float32))

    def learn_languages(self, langs: list[str], count: np.ndarray, total: np.ndarray, least: int = 5) -> None:
        """Log ratios of the shares of texts that hold a word; count: by hashed word and language the texts that hold one, of total by language."""
        self.langs = langs
        p = np.log((count + 0.1) / (total + 0.2))
        self.profile = np.where((count.sum(axis=1) >= least)[:, None], p - p.mean(axis=1, keepdims=True), 0.0).astype(np.float32)

    def guess(self, counts: np.ndarray) -> np.ndarray:
        return counts.argmax(axis=1)

    def calibrate(self, logits: np.ndarray, guessed: np.ndarray, hits: np.ndarray, n: np.ndarray, least: int = 20) -> None:
        """For each language the threshold of the best F1, in the middle of the gap; the common one where positives are few.

        Of n texts with this logit and guessed language hits are toxic; equal scores are decided together.
        """

        def best(m):
            z, at = np.unique(-logits[m], return_inverse=True)
            y, every = np.bincount(at, hits[m]), np.bincount(at, n[m])
            if not y.any() or (y == every).all():
                return 0.0
            f1 = 2 * np.cumsum(y) / (np.cumsum(every) + y.sum())
            k = int(f1.argmax())
            return float(-(z[k] + z[k + 1]) / 2 if k + 1 < len(z) else -z[k] - 1.0)

        common = best(np.ones(len(n), bool))
        own = [(guessed == k) for k in range(max(1, len(self.langs)))]
        self.threshold = np.array([best(m) if hits[m].sum() >= least else common for m in own])


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _numbers(text: str | None, known: dict[str, int], kind: type) -> np.ndarray:
    """The numbers of a text's words; known gives one that is new the next number."""
    words = words_of(text)
    return np.fromiter(map(known.__getitem__, words), kind, len(words))


def numbered(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words, sorted, and each text as their numbers from 1, followed by two 0s; no word is held twice."""
    seen: dict[str, int] = defaultdict(count().__next__)
    found = [_numbers(t, seen, np.int32) for t in texts]
    words = sorted(seen)
    number = np.empty(len(words), np.int32)
    number[[seen[w] for w in words]] = np.arange(1, len(words) + 1)
    return words, [np.r_[number[f], np.zeros(2, np.int32)] for f in found]


class Scorer:
    """Scores texts with a fitted model; words are projected once and remembered."""

    def __init__(self, model: TextCnn, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.reset()

    def reset(self) -> None:
        m = self.model
        self.known: dict[str, int] = defaultdict(count(1).__next__)
        self.proj = np.zeros((1, len(SLOTS), FILTERS), np.float32)
        self.lang = np.zeros((1, max(1, len(m.langs))), np.float32)

    def _learn(self, new: list[str]) -> None:
        """Project the words numbered last; tables have room to grow, so that they are seldom copied."""
        lo, hi = len(self.known) + 1 - len(new), len(self.known) + 1
        if hi > len(self.proj):
            room = max(hi, 2 * len(self.proj))
            for name in ("proj", "lang"):
                old = getattr(self, name)
                table = np.empty((room, *old.shape[1:]), np.float32)
                table[:lo] = old[:lo]
                setattr(self, name, table)
        whole, grams, owner = hashed(new)
        self.proj[lo:hi] = self.model.projected(whole, grams, owner)
        self.lang[lo:hi] = self.model.profile[whole % PROFILE]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, guessed language)."""
        if len(self.known) > self.limit:
            self.reset()
        m, before = self.model, len(self.known)
        found = [_numbers(t, self.known, np.int64) for t in texts]
        n = len(self.known) - before
        if n:
            self._learn(list(islice(reversed(self.known), n))[::-1])
        sizes = np.array([len(own) for own in found])
        at = np.zeros(int(sizes.sum()) + 2 * len(found), np.int64)
        d, guess = 0, np.zeros((len(found), self.lang.shape[1]))
        for i, own in enumerate(found):
            at[d : d + len(own)] = own
            guess[i] = self.lang[own].sum(axis=0)
            d += len(own) + 2
        return m.logits(m.pooled(self.proj, at, sizes)), m.guess(guess)


def _windows(text: Column, longest: int, n: int = 4) -> Column:
    """A text of words parted by one blank, or if it is longer, n windows of whole words, spread from its start to its end; words that are longer than a window are cut."""
    part = max(1, longest // n)
    cut = lambda x, size, at, length: [at(x, F.floor((length(x) - size) * k / (n - 1)).cast("int") + 1, F.lit(size)) for k in range(n)]
    words = F.split(text, " ")
    each = max(1, part // 8)
    some = F.when(F.size(words) > n * each, F.array_join(F.concat(*cut(words, each, F.slice, F.size)), " ")).otherwise(text)
    some = F.when(F.length(some) > longest, F.concat_ws(" ", *cut(some, part, F.substring, F.length))).otherwise(some)
    return F.when(F.length(text) <= longest, text).otherwise(some)


def _learning_rows(docs: DataFrame, labels: DataFrame, sample: int | None, longest: int | None, text: str, lang: str, doc_id: str, label: str) -> DataFrame:
    """(i, h, y, cal, t, l): every labelled document to learn from, once, in an order by hash."""
    if longest is not None:
        docs = docs.withColumn(text, _windows(F.trim(F.regexp_replace(text, r"\s+", " ")), longest))
    seen = F.col(doc_id).isNotNull() & (crc_mod(doc_id, 5) != 0)
    known = labels.where(seen & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("i")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.where("y IN (0, 1)").withColumn("cal", (F.crc32(F.col("i").cast("string").cast("binary")) % 5) == 1).withColumn("h", F.xxhash64("i"))
    own = docs.where(seen).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    if sample is not None:
        there = known.join(own.select("i").distinct(), "i", "left_semi")
        parts = [there.where((F.col("y") == y) & (F.col("cal") == c)).orderBy("h", "i").limit(sample) for y in (0, 1) for c in (False, True)]
        known = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    rows = own.join(known, "i").groupBy("i", "h", "y", "cal").agg(F.min(F.struct("t", "l")).alias("o"))
    return rows.select("i", "h", "y", "cal", "o.t", "o.l").sortWithinPartitions("h", "i")


def _language_counts(rows: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts that hold a hashed word, by word and language; texts by language)."""

    @trimmed
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros((PROFILE + 1, max(1, len(langs))), np.int64)
        for part in parts:
            words, texts = numbered(part["t"].tolist())
            at = np.r_[0, hashed_in_parts(words)[0] % PROFILE + 1]
            for row, lang in zip(texts, part["l"], strict=True):
                if isinstance(lang, str):
                    here = np.unique(at[row])
                    here[0] = 0  # the texts; also if a text has no word, as each ends with two 0s
                    count[here, langs.index(lang)] += 1
        word, k = np.nonzero(count)
        yield pd.DataFrame({"word": word, "k": k, "n": count[word, k]})

    found = rows.select("t", "l").mapInPandas(run, "word long, k long, n long").groupBy("word", "k").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros((PROFILE + 1, max(1, len(langs))))
    count[found["word"], found["k"]] = found["n"]
    return count[1:], count[0]


def _turn(rows: DataFrame, model: TextCnn, sums: dict[str, np.ndarray], weight: tuple[float, float], passes: int, seed: int) -> None:
    """One round: tasks descend from the model over their rows, 1,000 at a time; model and sums move by the average of their changes.

    A row of embeddings moves by the average of the tasks that changed it, everything else by that of all tasks.
    """
    dense = ("filters", "bias", "out", "base")
    flat = lambda m, s: np.concatenate([*(np.ravel(getattr(m, k)) for k in dense), *(np.ravel(s[k]) for k in dense)])
    before = flat(model, sums)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, total, done = TextCnn(), {k: v.copy() for k, v in sums.items()}, 0
        for k in ("emb", *dense):
            setattr(own, k, getattr(model, k).copy())
        for part in parts:
            for lo in range(0, len(part), 1000):
                some = part.iloc[lo : lo + 1000]
                y = some["y"].to_numpy(np.float32)
                own.fit(*numbered(some["t"].tolist()), y, np.where(y == 1, weight[1], weight[0]), total, passes, seed=seed * 1_000_003 + done)
                done += len(some)
        if done:
            touched = np.flatnonzero((total["emb"] != sums["emb"]).any(axis=1))
            out = [(-1, np.zeros(1, np.int32), (flat(own, total) - before)[None])]
            for b in np.unique(touched // BLOCK):
                at = touched[touched // BLOCK == b]
                out.append((b, (at - b * BLOCK).astype(np.int32), np.hstack([own.emb[at] - model.emb[at], total["emb"][at] - sums["emb"][at]])))
            yield pd.DataFrame([(int(b), at.tobytes(), change.astype(np.float32).tobytes()) for b, at, change in out], columns=["block", "at", "change"])

    def mean(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, acc = None, np.empty(0), np.empty(0)

        def whole():
            at = np.flatnonzero(n)
            return pd.DataFrame([(now, at.astype(np.int32).tobytes(), (acc[at] / n[at, None]).astype(np.float32).tobytes())], columns=["block", "at", "change"])

        for part in parts:
            for block, at, change in zip(part["block"], part["at"], part["change"], strict=True):
                at = np.frombuffer(at, np.int32)
                change = np.frombuffer(change, np.float32).reshape(len(at), -1)
                if block != now:
                    if now is not None:
                        yield whole()
                    now, n, acc = block, np.zeros(BLOCK), np.zeros((BLOCK if block >= 0 else 1, change.shape[1]))
                    n = n[: len(acc)]
                n[at] += 1
                acc[at] += change
        if now is not None:
            yield whole()

    kind = "block int, at binary, change binary"
    moved = rows.select("t", "y").mapInPandas(trimmed(run), kind)
    found = moved.repartition("block").sortWithinPartitions("block").mapInPandas(mean, kind).toPandas()
    for block, at, change in found.itertuples(index=False):
        at = np.frombuffer(at, np.int32)
        change = np.frombuffer(change, np.float32).reshape(len(at), -1)
        if block >= 0:
            model.emb[at + block * BLOCK] += change[:, :DIM]
            sums["emb"][at + block * BLOCK] += change[:, DIM:]
            continue
        parts, lo = before + change[0], 0
        for put in (lambda k, x: setattr(model, k, x), sums.__setitem__):
            for k in dense:
                like = getattr(model, k)
                put(k, parts[lo : lo + np.size(like)].reshape(np.shape(like)).astype(np.float32))
                lo += np.size(like)


def _scored(rows: DataFrame, model: TextCnn) -> pd.DataFrame:
    """(k, z, hits, n): of the texts with guessed language k and logit z, on a grid, how many are toxic and how many there are."""

    @trimmed
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for part in parts:
            for lo in range(0, len(part), 200):
                z, k = scorer(part["t"].iloc[lo : lo + 200].tolist())
                yield pd.DataFrame({"k": k, "z": np.rint(np.clip(z, -30, 30) * GRID).astype(np.int64), "y": part["y"].iloc[lo : lo + 200].to_numpy()})

    found = rows.select("t", "y").mapInPandas(run, "k long, z long, y long").groupBy("k", "z").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).toPandas()
    return found.assign(z=found["z"] / GRID)


def train(docs: DataFrame, labels: DataFrame, sample: int | None = None, longest: int | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", label: str = "toxic", rounds: int = 2, passes: int = 2, share: int = 2000) -> TextCnn | None:
    """A model from labelled rows whose crc32 of the id as text is not 0 modulo 5; None without both labels.

    Those with 2, 3 or 4 train it and those with 1 calibrate it, all of them and whole.  In each of `rounds` jobs
    a task passes `passes` times over about `share` documents or more; both labels weigh the same in all.  A caller
    may bound what is learned from: `sample`, documents of each label and part, first by the hash of their id, and
    `longest`, characters of a text, of a longer one four windows of whole words; neither is bounded
    otherwise.  Labels that differ for one id count as toxic; of rows that share an id the least text is used.
    """
    spark = docs.sparkSession
    at = stored(_learning_rows(docs, labels, sample, longest, text, lang, doc_id, label))
    rows = spark.read.parquet(at)
    found = rows.groupBy("cal", "y", "l").count().collect()
    n = {(c, y): sum(r["count"] for r in found if r.cal == c and (r.y == 1) == y) for c in (False, True) for y in (False, True)}
    if not n[False, False] or not n[False, True]:
        drop(spark, [at])
        return None
    learn, every = rows.where("NOT cal"), n[False, False] + n[False, True]
    model = TextCnn()
    langs = sorted({r.l for r in found if r.l is not None and not r.cal})
    model.learn_languages(langs, *_language_counts(learn, langs))
    sums, weight = model.state(), tuple(every / (2.0 * n[False, y]) for y in (False, True))
    for k in range(rounds):
        _turn(learn.coalesce(max(1, every // share)), model, sums, weight, passes, k)
    got = _scored(rows.where("cal") if n[True, False] and n[True, True] else learn, model)
    model.calibrate(*(got[c].to_numpy() for c in ("z", "k", "hits", "n")))
    drop(spark, [at])
    return model


def score(text: Column, model: TextCnn | None) -> Column:
    """The probability-like score of the whole text, 0.5 at the threshold of its guessed language; 0 if nothing was learned."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    @trimmed
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for batch in batches:
            out = []
            for lo in range(0, len(batch), 200):
                z, guessed = scorer(batch.iloc[lo : lo + 200].tolist())
                out.append(1.0 / (1.0 + np.exp(-np.clip(z - model.threshold[guessed], -30, 30))))
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    return judge(text)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs.

    held_out marks crc32 of the id as text 0 modulo 5, which nothing is learned from.  Null and empty
    texts are scored as texts without words, long ones whole.  Repeated rows get the same score; an empty
    table gives no rows; other columns, whatever their names, are ignored.
    """
    model = train(docs, labels, sample, text=text, lang=lang, doc_id=doc_id, label=label)
    scored = docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(doc_id, 5) == 0).alias("held_out"), score(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
