"""Quality rules on whole texts: counts of words, symbols and repeats, and bands of compression.

A text's zstandard ratio (bytes over compressed bytes) is high where it repeats itself and near one where
it is noise; how high an ordinary text's can be depends on its length, so the limits do.  The ratio is taken of the
whole text and of chunks of a fixed size, as a stretch of repeats or noise is diluted in a long text.
"""

from __future__ import annotations

import bisect
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lodestone.llm.common import give_back

#: (bytes from which the limits hold, least ratio, greatest ratio) of ordinary prose in any script.
LIMITS = ((0, 0.0, 3.0), (64, 0.7, 3.0), (256, 1.1, 3.4), (1024, 1.25, 3.6), (4096, 1.4, 4.0), (16_384, 1.4, 5.0), (65_536, 1.4, 6.0))
CHUNK = 4096
#: A text goes when more than this share of its chunks is out of bounds.
CHUNKS_OUT = 0.25
LEVEL = 3

SPACE = np.array([0x20, *range(0x09, 0x0E)])
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
PIECE = 1 << 20


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """raw in pieces of about `size` bytes, none cut within a word."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[at:end]
        at = end


def n_repeated(ids: np.ndarray, window: int = 5) -> int:
    """Places within windows of `window` ids that occur at least twice; windows are compared in full, by ranks of pairs."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    run = ids[:n].astype(np.int64)
    for k in range(1, window):
        _, run = np.unique(run * (int(ids.max()) + 1) + ids[k : n + k], return_inverse=True)
    often = np.bincount(run)[run] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(often), 1)
    np.add.at(edge, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in p.split()], np.int64) for p in pieces(raw)]
    ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
    each = sum((np.bincount(np.frombuffer(p, np.uint8), minlength=256) for p in pieces(raw)), np.zeros(256, np.int64))
    chars = int(each.sum() - each[0x80:0xC0].sum() - each[SPACE].sum())
    seen: set[bytes] = set()
    repeats = 0
    for line in io.BytesIO(raw):
        line = line.removesuffix(b"\n")
        if line.strip():
            repeats += line in seen
            seen.add(line)
    return len(ids), chars, int(each[SYMBOLS].sum()), repeats, n_repeated(ids)


def within(n: int, compressed: int, limits=LIMITS) -> bool:
    """Whether n bytes that compress to so many are within the limits of their length."""
    _, low, high = limits[bisect.bisect_right([b[0] for b in limits], n) - 1]
    return low * compressed <= n <= high * compressed


def bands(raw: bytes, coder: zstandard.ZstdCompressor, chunk: int = CHUNK, limits=LIMITS) -> tuple[float, bool, int, int]:
    """(ratio, whether it is within its limits, chunks, chunks out of their limits) of a text that is not empty.

    A text is cut into chunks of `chunk` bytes, the last of up to twice as many; a shorter text is one chunk.
    """
    small = len(coder.compress(raw))
    starts = range(0, max(1, len(raw) // chunk) * chunk, chunk)
    ends = [*starts[1:], len(raw)]
    out = sum(not within(b - a, len(coder.compress(raw[a:b])), limits) for a, b in zip(starts, ends, strict=True)) if len(ends) > 1 else int(not within(len(raw), small, limits))
    return len(raw) / small, within(len(raw), small, limits), len(ends), out


def judge(docs: DataFrame, chunk: int = CHUNK, chunks_out: float = CHUNKS_OUT, limits=LIMITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, n_chunks, n_chunks_out of every row.

    Words are what ASCII white space parts.  base_failed: fewer than 10 words, or more than a fifth of them in 5-word
    windows that the text has twice.  kept: not base_failed, the text's ratio within the limits of its length, and no more
    than `chunks_out` of its chunks out of theirs.  Null and empty texts have no words, ratio or chunks and aren't kept.
    Repeated rows are judged one by one, long texts whole; an empty table gives no rows; other columns are ignored.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_chunks_out"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                whole = cell.as_py() or b""
                n = counts(whole)
                failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
                ratio, fits, chunks, out = bands(whole, coder, chunk, limits) if whole else (None, False, 0, 0)
                rows.append((*n, failed, not failed and fits and out <= chunks_out * chunks, ratio, chunks, out))
            cells = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], names=names)
        give_back()

    id_kind = docs.schema[doc_id].dataType.simpleString()
    told = f"doc_id {id_kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_out long"
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("binary").alias("raw")).mapInArrow(run, told)
