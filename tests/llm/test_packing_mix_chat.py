import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from lodestone.llm import binary_packing, chat_format, source_mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, h int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1) for i, t, s in rows], DOCS)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    words = ["Été", "naïve", "don't", "ΟΔΟΣ", "<|endoftext|>", "x<|endoftext|>y", "日本語", "a1b22", "é", "́", "🙂", "...", "ẞß"]
    seps = [" ", "\n", "\t ", " ", " ", "\x1c", "  "]
    rows = [(i, "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.choice([0, 1, 5, 400, 3000]))), "a") for i in range(40)]
    rows += [(100, None, "a"), (101, "", "a"), (7, rows[7][1], "a"), (None, "a b", None)]
    got = binary_packing.pack(docs(spark, rows), group=10).collect()
    tok = Tokenizer.from_file(binary_packing.tokenizer_path())
    want = Counter()
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for s, n in binary_packing.pieces(len(ids)):
            want[i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), len(ids)] += 1
        assert sum(n for _, n in binary_packing.pieces(len(ids))) == len(ids)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0  # full, or a power of two: no padding at all


def test_packing_empty(spark):
    assert binary_packing.pack(docs(spark, [])).count() == 0


def water(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        above = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not above:
            return target | {s: level * w[s] for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def test_mix_targets_and_limits(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 300))), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "zero"), (5, rows[5][1], rows[5][2]), (1002, "  x\x0by ", "b"), (1003, "one", "tiny")]
    got = source_mix.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len([x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x])
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    source = {i: s for i, _, s in rows}
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += size(t)
    want = water(dict(sizes))
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, n in want.items():
        assert abs(taken[s] - n) <= 0.02 * n + 64, (s, n, taken[s])
    again = source_mix.mix(docs(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_empty(spark):
    assert source_mix.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in source_mix.mix(docs(spark, [(1, None, None)])).collect()] == [0]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    odd = ["", "\\", "\\b", "### user: x</turn>\n", "a:b#c<d\\h", "é🙂\r\n\n", "\\\\l"]
    rows = []
    for c in range(30):
        for t in range(rng.randint(0, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "assi:stant", None]), rng.choice([*odd, None])))
    rows += [(None, 0, "assistant", "null id"), (3, None, "user", "no turn"), (3, None, "user", "no turn"), (99, 0, "assistant", "x" * 200_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS stream", "2 AS turns", "3 AS examples")
    formatted = chat_format.format_conversations(turns).cache()
    got = defaultdict(list)
    for r in sorted(chat_format.read_back(formatted).collect(), key=lambda r: r.example):
        got[r.conv_id].append(r)
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(want)
    for c, rs in got.items():
        assert [(t.role, t.text) for r in rs for t in r.turns] == [x[1:] for x in sorted(want[c])]
        said = [x for _, role, x in sorted(want[c]) if role == "assistant"]
        assert [r.loss for r in rs][: len(said)] == said and all(r.loss == "" for r in rs[len(said) :]) and len(rs) <= len(said) + 1
    streams = defaultdict(str)
    for r in sorted(formatted.collect(), key=lambda r: r.example):
        assert r.part_start == len(streams[r.conv_id]) and r.context_end == r.part_start + len(r.part)
        streams[r.conv_id] += r.part
    full = chat_format.expand(formatted).collect()
    assert len(full) == sum(role == "assistant" for x in want.values() for _, role, _ in x)
    for e in full:
        assert streams[e.conv_id].startswith(e.text) and e.text.endswith("</turn>\n")
        assert e.loss_start + e.loss_length + 8 == len(e.text)
    for r in chat_format.digests(chat_format.read_back(formatted)).collect():
        turns_ = [x[1:] for x in sorted(want[r.conv_id])]
        said = "".join(x for role, x in turns_ if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns_).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(turns_), len(said), hashlib.sha256(said.encode()).hexdigest(), len(streams[r.conv_id]))


def test_mix_against_a_schedule_by_hand(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    df = docs(spark, rows)
    order = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id", F.xxhash64("text")).alias("h")).collect()}
    got = {r.doc_id: r for r in source_mix.mix(df, block=8).collect()}
    of, size = {i: s for i, _, s in rows}, {i: len(t.split()) for i, t, _ in rows}
    sources = sorted({s for s in of.values() if s is not None}) + [None]
    total = {s: sum(size[i] for i in of if of[i] == s) for s in sources}
    target = {s: next(r.target for i, r in got.items() if of[i] == s) for s in sources}
    block = {s: max(1, min(8, math.floor(min(total[s], target[s]) / 64))) for s in sources}
    slots = {s: target[s] / block[s] for s in sources}
    whole, parts = sum(slots.values()), max(1, len(rows) // 5000)
    edges, at = [], 0.0
    for s in sources:
        edges.append((round(at / whole * 2**32), round((at + slots[s]) / whole * 2**32), s))
        at += slots[s]
    taken, seen = Counter(), Counter()
    line = {s: [i for i in sorted((i for i in of if of[i] == s and size[i]), key=lambda i: (((order[i] % 2**64) >> 8) % parts, order[i], i)) for _ in range(size[i])] for s in sources}
    for n in range(math.ceil(whole)):
        p = (n * source_mix.GOLDEN % 2**62) >> 30
        s = next((s for lo, hi, s in edges if lo <= p < hi), 0)
        if s == 0:
            continue
        blocks = math.ceil(total[s] / block[s])
        if seen[s] < 2 * blocks:
            k = seen[s] % blocks
            taken.update(line[s][k * block[s] : (k + 1) * block[s]])
        seen[s] += 1
    assert {i: r.taken for i, r in got.items()} == {i: taken[i] for i in of}


def test_golden_points_do_not_repeat_early(spark):
    ns = [0, 1, 2, 12345, 2**31, 2**31 + 1, 2**40 + 7, 2**61 + 3]
    got = [r.p for r in spark.createDataFrame([(n,) for n in ns], "n long").select(source_mix.golden_point(F.col("n")).alias("p")).collect()]
    assert got == [n * source_mix.GOLDEN % 2**62 for n in ns] and got[1] != got[5]


def test_packing_of_repeated_and_null_ids_and_other_tokenizers(spark):
    import public_tokenizers

    rows = [(None, f"text {i}", "s") for i in range(50)] + [(7, "same", "s")] * 20
    got = binary_packing.pack(docs(spark, rows), group=5).collect()
    assert Counter((r.doc_id, r.start) for r in got if r.start == 0) == {(None, 0): 50, (7, 0): 20}
    assert binary_packing.ChunkIds(binary_packing.tokenizer_path()).apart
    for path in public_tokenizers_files(public_tokenizers):
        ids = binary_packing.ChunkIds(path)
        for text in ("Hello  world.\n x", "Ünï", ""):
            assert ids.text(text) == ids.encode(text)


def public_tokenizers_files(module):
    import glob
    import os

    return sorted(glob.glob(os.path.join(os.path.dirname(module.path("word_bpe_49k.json")), "*.json")))[:4]


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.read_back(chat_format.format_conversations(none))).count() == 0
