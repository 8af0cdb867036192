"""Packing by power-of-two decomposition.

Every document is cut into pieces of 2048 tokens and, for the rest, of the powers of two in its
binary form; a sequence holds pieces of one length only, so it is full without a document crossing
into another's sequence.  The few pieces of a group that do not fill a last sequence are put together
to shorter sequences whose lengths are powers of two again, so nothing is padded.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, trimmed

SEQUENCE = 2048
#: Texts on which encoding by chunks is compared with the tokenizer itself.
PROBES = ("The quick, brown  fox.", "Élan naïve Straße\tÜber\nGARÇON, été.", "a1b2 c-d it's (x) \"y\" 3.14 Ünïcode… 的 ﬁ İi Σς e\u0301", " leading and trailing ", "HELLO hello Hello, hello. x,y .z")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens, longest first."""
    out = [(i * sequence, sequence) for i in range(n // sequence)]
    at, bit = len(out) * sequence, sequence >> 1
    while bit:
        if n % sequence & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


class ChunkIds:
    """Token ids of chunks without white space, as little-endian bytes; chunks and their words are remembered up to a bound."""

    def __init__(self, path: str, limit: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.apart = True
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.letters: dict[str, str] = {}
        # what is taken for granted of the tokenizer holds for it, or else texts are encoded whole
        self.apart = all(self.text(t) == self.encode(t) for t in PROBES)
        self.chunks, self.words = {"": b""}, {}

    def text(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not self.apart:
            return self.encode(text)
        return self(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))

    def letter(self, c: str) -> str:
        """A letter as the model spells its bytes."""
        if c not in self.letters:
            self.letters[c] = "".join(piece for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(c))
        return self.letters[c]

    def encode(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, chunks: list[str]) -> bytes:
        new = {c for c in chunks if c not in self.chunks}
        if new:
            if len(self.chunks) > self.limit:
                self.chunks = {"": b""}
                new = set(chunks) - {""}
            if len(self.words) > self.limit:
                self.words.clear()
            parts = {}
            for c in new:
                # the tokenizer lower-cases and takes letters and a full stop or comma after them apart
                word = c[:-1] if c[-1] in ".," else c
                parts[c] = (word.lower(), c[len(word) :]) if word.isalpha() and "İ" not in word and "Σ" not in word and unicodedata.is_normalized("NFC", word) else (None, c)
            for word in {w for w, _ in parts.values() if w is not None}:
                if word not in self.words:  # a word of letters is one pre-token, which the model cuts
                    spelt = word if word.isascii() else "".join(map(self.letter, word))
                    self.words[word] = array("I", [t.id for t in self.tok.model.tokenize(spelt)]).tobytes()
            for c, (word, rest) in parts.items():
                if word is None:
                    self.chunks[c] = self.encode(c)
                else:
                    if rest and rest not in self.words:
                        self.words[rest] = self.encode(rest)
                    self.chunks[c] = self.words[word] + self.words[rest] if rest else self.words[word]
        return b"".join(map(self.chunks.__getitem__, chunks))


def token_pieces(text: Column, path: str | None = None, end: int = 1, sequence: int = SEQUENCE) -> Column:
    """ARRAY<STRUCT<start, length, ids_crc32, doc_tokens>> of a text's ids and the end id.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its
    chunks between blanks, tabs and line ends.  Null counts as empty.
    """
    path = path or tokenizer_path()
    kind = "array<struct<start: bigint, length: bigint, ids_crc32: bigint, doc_tokens: bigint>>"
    last = np.array([end], dtype="<u4").tobytes()

    @F.pandas_udf(kind)
    @trimmed
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = ChunkIds(path)
        for batch in batches:
            out = []
            for text in batch:
                ids = encode.text(text or "") + last
                n = len(ids) // 4
                out.append([{"start": s, "length": m, "ids_crc32": zlib.crc32(ids[4 * s : 4 * (s + m)]), "doc_tokens": n} for s, m in pieces(n, sequence)])
            yield pd.Series(out)

    return cut(text)


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, group: int = 4000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces are dealt by the hash of their id, start and ids into groups of about `group` documents' pieces;
    sequences are filled within a group, so no length and no id is ordered in one task and reruns agree.
    Null and empty texts are one piece, the end id.  Repeated rows are packed one by one.  Texts are
    encoded whole, however long.  An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(token_pieces(F.col(text), path, sequence=sequence)).alias("p")).select("doc_id", "p.*")
    rows = materialize(rows)
    groups = max(1, rows.where("start = 0").count() // group)
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    key = Window.partitionBy("g", "length")
    i = (F.row_number().over(key.orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1).cast("long")
    rows = rows.withColumn("i", i).withColumn("n", F.count("*").over(key)).withColumn("per", (F.lit(sequence) / F.col("length")).cast("long"))
    full = F.col("n") - F.pmod("n", F.col("per"))  # pieces in full sequences
    # of the m pieces left, piece j lies in the power of two at the highest bit in which j and m differ
    j, m = F.col("i") - full, F.pmod("n", F.col("per"))
    bit = F.floor(F.log2((j.bitwiseXOR(m)).cast("double"))).cast("int")
    size = F.when(F.col("i") < full, F.col("per")).otherwise(F.expr("shiftleft(1L, bit)"))
    rows = rows.withColumn("full", full).withColumn("bit", F.when(F.col("i") >= full, bit))
    first = F.when(F.col("i") < F.col("full"), F.col("i") - F.pmod("i", F.col("per"))).otherwise(F.col("full") + j - F.pmod(j, size))
    rows = rows.withColumn("first", first)
    # unique by construction: group, log2 of the length, first piece of the sequence
    seq = (F.col("g").cast("long") * 16 + F.log2(F.col("length").cast("double")).cast("long")) * F.lit(2**32) + F.col("first")
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", seq.alias("sequence_id"), ((F.col("i") - F.col("first")) * F.col("length")).alias("offset"))
