"""Exact ranked lexical search by groups of documents that hold the same of an item's terms.

One pass over the documents keeps, of every text, its number of terms and how often it holds each term that
an item asks for.  From that the weights follow.  The second pass goes over this table in place, without a
shuffle: a task holds some thousand documents at a time with one bitmap a term; for an item the bitmaps of
its terms, laid side by side, give every document's mask of matched terms, and documents of one mask
are a group.  A mask's score is at most the sum of its terms' best contributions there.  Groups are scored in
full by descending bound until an item's k-th best score is above the next bound.  A task carries that
score on to the documents that it meets later and gives k rows an item; those are merged.

Items are taken in blocks with a bounded number of terms, so what is shipped to the tasks is bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import give_back, materialize
from lodestone.llm.compression_bands import pieces

#: ASCII letters in small form, digits and every byte of another character stay; all else parts terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Terms of items that one pass looks for, at most (but one item's at least).
BLOCK_TERMS = 1_000_000
SHARD = 8192


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in order, some at a time."""
    folded = raw.translate(FOLD)
    return (p.split() for p in pieces(folded))


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): the distinct terms of every item; rows that share an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, cell in enumerate(batch.column(1)):
                own = {t for some in terms(cell.as_py() or b"") for t in some}
                at += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], names=["item", "term"])

    kind = items.schema[item_id].dataType.simpleString()
    return items.select(items[item_id].alias("item"), items[text].cast("binary").alias("raw")).mapInArrow(run, f"item {kind}, term binary").distinct()


def holdings(docs: DataFrame, known: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, term ARRAY, tf ARRAY) of documents with a term: all their terms counted, the known ones by number and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.keys()
        for batch in batches:
            keep, n, own, often = [], [], [], []
            for i, cell in enumerate(batch.column(1)):
                count: Counter[bytes] = Counter()
                total = 0
                for some in terms(cell.as_py() or b""):
                    total += len(some)
                    count.update(some)
                if total:
                    hit = sorted((known[t], count[t]) for t in count.keys() & wanted)
                    keep.append(i)
                    n.append(total)
                    own.append([t for t, _ in hit])
                    often.append([c for _, c in hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))], names=["doc_id", "n", "term", "tf"])
        give_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("binary").alias("raw")).mapInArrow(run, f"doc_id {kind}, n long, term array<int>, tf array<long>")


class Shard:
    """Some documents with a bitmap for each term that they hold."""

    def __init__(self, n: np.ndarray, starts: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        self.size, self.starts, self.term = len(n), starts, term
        row = np.repeat(np.arange(self.size), np.diff(starts))
        # beyond 64 bits the same in whole numbers of any size
        exact = n.astype(object) if len(n) and 50 * int(n.max()) * n_docs >= 2**63 else n
        m = (50 + (50 * exact * n_docs) // n_terms).astype(np.int64)
        self.gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        order = np.argsort(term, kind="stable")
        self.held, first = np.unique(term[order], return_index=True)
        self.most = np.maximum.reduceat(self.gain[order], first) if len(order) else np.empty(0, np.int64)
        bits = np.zeros((len(self.held), self.size), bool)
        bits[np.searchsorted(self.held, term), row] = True
        self.bits = np.packbits(bits, axis=1)

    def masks(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bound of every mask, mask of every document) for terms that documents here hold, by their place among the held."""
        planes = np.unpackbits(self.bits[asked], axis=1, count=self.size)
        group, bound = np.zeros(self.size, np.int64), np.zeros(1, np.int64)
        for lo in range(0, len(asked), 32):  # 32 terms a word; words are combined by the number of the mask so far
            some = planes[lo : lo + 32]
            word = np.zeros(self.size, np.int64)
            for j, plane in enumerate(some):
                word |= plane.astype(np.int64) << j
            both, first, now = np.unique((group << 32) | word, return_index=True, return_inverse=True)
            bound = bound[both >> 32] + some[:, first].T.astype(np.int64) @ self.most[asked[lo : lo + 32]]
            group = now
        return bound, group

    def score(self, rows: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """The scores of some documents, over the terms that `mine` marks."""
        size = self.starts[rows + 1] - self.starts[rows]
        to = np.cumsum(size)
        at = np.arange(to[-1] if len(to) else 0) + np.repeat(self.starts[rows] - (to - size), size)
        sums = np.r_[0, np.cumsum(np.where(mine[self.term[at]], self.gain[at], 0))]
        return sums[to] - sums[to - size]

    def best(self, asked: np.ndarray, mine: np.ndarray, k: int, above: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of documents that may be among an item's k best, given that k documents elsewhere score `above` or more."""
        bound, group = self.masks(asked)
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[group], kind="stable")  # documents by descending bound of their mask
        ends = np.cumsum(np.bincount(place[group], minlength=len(order)))
        rows, scores, done, want = [], np.empty(0, np.int64), 0, k
        g = 0
        while g < len(order) and bound[order[g]] > 0 and bound[order[g]] >= above:
            # whole groups, until there are enough documents to look again
            last = max(g, min(int(np.searchsorted(ends, done + want)), len(order) - 1))
            if bound[order[last]] < max(above, 1):
                last = g + int((bound[order[g : last + 1]] >= max(above, 1)).sum()) - 1
            some = by[done : ends[last]]
            rows.append(some)
            scores = np.r_[scores, self.score(some, mine)]
            done, g, want = int(ends[last]), last + 1, 2 * want
            if len(scores) >= k:
                above = max(above, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        row = np.concatenate(rows) if rows else np.empty(0, np.int64)
        keep = (scores > 0) & (scores >= above)
        return row[keep], scores[keep]


def _cut(ids: pa.Array, scores: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The k best by score, ties to the smaller id, null ids last."""
    by = pc.sort_indices(pa.table({"s": scores, "i": ids}), sort_keys=[("s", "descending"), ("i", "ascending")], null_placement="at_end")[:k]
    return ids.take(by), scores[by.to_numpy()]


def rank(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS, shard: int = SHARD, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: every item's k documents of highest score above 0, ties to the smaller doc_id, null ids last.

    Every row of docs is a document, repeated ids and texts too; those without a term count for nothing.
    Rows of items that share an id are one item, a null one too; an item without a term, or whose terms no document holds,
    gives no rows.  Texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    asked = materialize(item_terms(items, item_id))
    sizes = asked.groupBy("item").agg(F.count("*").alias("size"))
    # blocks of whole items: those of one hash range, as many as the terms need
    blocks = -(-(asked.count() or 1) // block_terms)
    hashed = F.pmod(F.xxhash64("item"), F.lit(blocks))
    totals, out = None, None
    id_kind = docs.schema[doc_id].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    if not sizes.isEmpty():
        for b in range(blocks):
            rows = asked.where(hashed == b).toArrow()
            names, coded = np.unique(np.array(rows["term"].to_pylist(), object), return_inverse=True) if len(rows) else (np.empty(0, object), np.empty(0, int))
            own = materialize(holdings(docs, {t: i for i, t in enumerate(names)}, doc_id))
            totals = totals or own.agg(F.count("*"), F.sum("n")).first()
            n_docs, n_terms = totals[0], totals[1] or 0
            df = np.zeros(len(names), np.int64)
            held = own.select(F.explode("term").alias("t")).groupBy("t").count().toArrow()
            df[held["t"].to_numpy()] = held["count"].to_numpy()
            weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in df.tolist()], np.int64)
            each = rows["item"].combine_chunks().dictionary_encode(null_encoding="encode")
            by = each.indices.to_numpy()
            wanted = [np.sort(coded[by == i]) for i in range(len(each.dictionary))]
            found = own.mapInArrow(_search(wanted, weight, n_docs, n_terms, k, shard), f"item int, doc_id {id_kind}, score long, task int")
            ids = docs.sparkSession.createDataFrame(list(enumerate(each.dictionary.to_pylist())), f"item int, item_id {item_kind}")
            order = [F.desc("score"), F.asc_nulls_last("doc_id")]
            # merged in two steps, so no item's rows of all tasks meet in one place
            for key in (["item", F.col("task") % 64], ["item"]):
                found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
            found = found.join(ids, "item").select("item_id", "rank", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {id_kind}, score long")


def _search(wanted: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int, shard: int):
    """Over holdings: the k best documents of this task for every item, given by its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: dict[int, tuple[pa.Array, np.ndarray]] = {}
        mine, at_held = np.zeros(len(weight), bool), np.full(len(weight), -1)

        def meet(part: pa.Table) -> None:
            part = part.combine_chunks()
            flat = lambda c: pc.list_flatten(part[c]).to_numpy().astype(np.int64)
            starts = np.r_[0, np.cumsum(pc.list_value_length(part["term"]).to_numpy())].astype(np.int64)
            here = Shard(part["n"].to_numpy(), starts, flat("term"), flat("tf"), weight, n_docs, n_terms)
            at_held[here.held] = np.arange(len(here.held))
            ids = part["doc_id"].combine_chunks()
            for i, own in enumerate(wanted):
                at = at_held[own]
                at = at[at >= 0]
                if not len(at):
                    continue
                known = best.get(i)
                mine[own] = True
                row, score = here.best(at, mine, k, int(known[1].min()) if known and len(known[1]) >= k else 0)
                mine[own] = False
                if len(row):
                    new = ids.take(pa.array(row))
                    best[i] = _cut(pa.concat_arrays([known[0], new]), np.r_[known[1], score], k) if known else _cut(new, score, k)
            at_held[here.held] = -1

        held: list[pa.RecordBatch] = []
        for part in batches:
            held.append(part)
            if sum(map(len, held)) >= shard:
                meet(pa.Table.from_batches(held))
                held = []
        if sum(map(len, held)):
            meet(pa.Table.from_batches(held))
        task = TaskContext.get().partitionId()
        for i, (ids, scores) in best.items():
            same = lambda v: pa.array(np.full(len(scores), v), pa.int32())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(i), ids, pa.array(scores, pa.int64()), same(task)], names=["item", "doc_id", "score", "task"])
        give_back()

    return run
