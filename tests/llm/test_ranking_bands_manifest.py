import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodestone.llm import compression_bands, mask_ranking, merkle_manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some_docs(n, seed=1, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "naïve", "日本"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.choice([1, 5, 30, 80])))
        rows.append((i, text, rng.choice(langs), rng.choice(["a", "b"]), len(text)))
    return rows


# ranking


def ranked_by_hand(docs, items, k):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(find(t))) for d, t in docs if find(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in {i for i, _ in items}:
        own = {t for i, x in items if i == item for t in find(x)}
        told = []
        for d, c in held:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                told.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(told, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def ranks(spark, docs, items, **kw):
    got = mask_ranking.rank(spark.createDataFrame(docs, "doc_id long, text string, Item string, score int").repartition(3), spark.createDataFrame(items, "item_id long, text string, rank string"), **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_ranking_equals_all_scores(spark):
    docs = [(d, t) for d, t, *_ in some_docs(900)] + [(None, "w3 w3 w4"), (5, "w3 w4"), (7, None), (8, ""), (9, "?! --"), (2**60 + 1, "W3 naïve " * 400)]
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices([f"W{j}" for j in range(45)] + ["ÜBER", "Über", "naïve", "日本"], k=rng.choice([1, 3, 12, 60])))) for i in range(12)]
    items += [(3, "w39 w38"), (None, "w1"), (50, None), (51, "..."), (52, "nobody")]
    want = ranked_by_hand(docs, items, 5)
    full = [(*d, None, 0) for d in docs]
    asked = [(*i, None) for i in items]
    assert ranks(spark, full, asked, k=5, shard=64) == want
    assert ranks(spark, full, asked, k=5, block_terms=20) == want  # several blocks of items


def test_ranking_of_repeated_rows_and_empty_tables(spark):
    docs = [(1, "a b", None, 0)] * 3 + [(2, "c", None, 0)]
    got = ranks(spark, docs, [(0, "a", None)], k=2)
    assert [(r[1], r[2]) for r in got] == [(1, 1), (2, 1)]
    assert ranks(spark, [], [(0, "a", None)]) == [] and ranks(spark, docs, []) == []


def test_masks_stop_early_and_lose_nothing():
    import numpy as np

    rng = np.random.default_rng(0)
    n_docs, n_terms = 3000, 70
    rows = [np.sort(rng.choice(n_terms, size=rng.integers(1, 12), replace=False)) for _ in range(n_docs)]
    starts = np.r_[0, np.cumsum([len(r) for r in rows])]
    term, tf = np.concatenate(rows), rng.integers(1, 9, starts[-1])
    weight = np.sort(rng.integers(1, 5000, n_terms))
    shard = mask_ranking.Shard(rng.integers(5, 500, n_docs), starts, term, tf, weight, 10**6, 10**8)
    asked = np.arange(0, n_terms, 2)
    mine = np.zeros(n_terms, bool)
    mine[asked] = True
    bound, group = shard.masks(asked)
    exact = shard.score(np.arange(n_docs), mine)
    assert (exact <= bound[group]).all()
    sets = [frozenset(set(r) & set(asked.tolist())) for r in rows]
    assert len(set(zip(sets, group.tolist(), strict=True))) == len(set(sets)) == len(bound)  # a mask is a group
    row, score = shard.best(asked, mine, 10, 0)
    assert len(row) < n_docs and sorted(score)[-10:] == sorted(exact)[-10:]
    big = mask_ranking.Shard(np.array([10**12]), np.array([0, 1]), np.array([0]), np.array([5]), weight, 10**9, 10**12)
    assert big.gain[0] == weight[0] * (5 * 10**9 // (5000 + 20 * (50 + 50 * 10**9)))


# compression bands


def counted_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(runs)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len({i + j for i, r in enumerate(runs) if often[r] > 1 for j in range(5)}))


ODD = ["", " ", "\n\n", "a", "a " * 9, "a b c d e f g h i j", "x y z v w " * 3, "#* $ |<\n#* $ |<\n\n \n a\x0bb\x0cc\x1cd e", "é" * 50, "l1\nl1\n l1\nl1", "日本 語 " * 40, "\x00 \x00 a\r\nb\r\na\r\n"]


@pytest.mark.parametrize("text", ODD)
def test_counts_by_hand(text):
    assert compression_bands.counts(text.encode()) == counted_by_hand(text)


def test_counts_of_random_texts_and_pieces():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choices("ab \n#é", k=rng.randrange(400)))
        assert compression_bands.counts(text.encode()) == counted_by_hand(text)
        assert b"".join(compression_bands.pieces(text.encode(), 7)) == text.encode()


def prose(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("etaoinshrdlu", weights=range(12, 0, -1), k=rng.randint(2, 9))) for _ in range(3000)]
    return " ".join(rng.choices(words, weights=[1 / (i + 3) for i in range(3000)], k=n))


def test_bands_reject_repeats_and_noise_of_any_length(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join(base64.b85encode(rng.randbytes(40)).decode() for _ in range(n))
    listed = " ".join(f"item {i} of the list {i} is here" for i in range(3000))  # windows differ, text repeats
    cases = {"prose": (prose(400), True), "short": (prose(12), True), "long": (prose(60_000), True), "noise": (noise(300), False), "listed": (listed, False), "half": (prose(9000) + " " + listed, False), "noisy end": (prose(3000) + " " + noise(800), False), "few": ("a b c", False), "null": (None, False), "empty": ("", False)}
    rows = [(i, t, None, 1) for i, (t, _) in enumerate(cases.values())]
    got = {r.doc_id: r for r in compression_bands.judge(spark.createDataFrame(rows * 2, "doc_id long, text string, raw string, n_words int")).collect()}
    assert {k: got[i].kept for i, k in enumerate(cases)} == {k: v for k, (_, v) in cases.items()}
    for i, (text, _) in enumerate(cases.values()):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted_by_hand(text or "")
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert not got[3].base_failed and not got[4].base_failed and got[8].ratio is None and got[9].n_chunks == 0
    empty = compression_bands.judge(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns[:2] == ["doc_id", "n_words"]


# manifest

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf_by_hand(row, add=0):
    doc_id, text, lang, source, n_chars = row[:5]
    values = (doc_id, source, lang, None if n_chars is None else n_chars + add, text)
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_by_hand(leaves):
    """The root, and for every leaf its (left, right) siblings from below."""
    nodes, ways = [(h, [i]) for i, h in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        nxt = []
        for a in range(0, len(nodes), 2):
            run = nodes[a : a + 2]
            for j, (_, below) in enumerate(run):
                for i in below:
                    ways[i].append(("", "".join(h for h, _ in run[1:])) if j == 0 else (run[0][0], ""))
            nxt.append((H("".join(h for h, _ in run)), [i for _, below in run for i in below]))
        nodes = nxt
    return nodes[0][0], ways


def manifest_by_hand(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = lambda x: (x is not None, x if x is None or isinstance(x, int) else x.encode())
    langs, subs = sorted(by, key=lambda x: (x is not None, (x or "").encode())), {}
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(r)))
        subs[lang] = (own, *tree_by_hand([leaf_by_hand(r) for r in own]))
    root, tops = tree_by_hand([subs[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        own, subroot, ways = subs[lang]
        for r, way in zip(own, ways, strict=True):
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0
            fold = leaf_by_hand(r, int(tampered))
            for left, right in way + top:
                fold = H(left + fold + right)
            out.append((r[0], leaf_by_hand(r), subroot, root, H("".join(a + b for a, b in way + top)), fold, fold == root))
    return sorted(out, key=str)


def manifests(spark, rows, **kw):
    got = merkle_manifest.manifest(spark.createDataFrame([(*r, None, 1) for r in rows], DOCS + ", tree string, Block int").repartition(3), **kw)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_manifest_by_hand(spark):
    rows = some_docs(60) + [(None, None, None, None, None), (None, "x", "en", "a", 3), (7, None, "en", None, None), (7, None, "en", None, None), (-9, "é" * 30_000, "zz", "s", 30_000), (900, "", "Ω", "s", 0)]
    got = manifests(spark, rows)
    assert got == manifest_by_hand(rows)
    assert {True, False} == {r[-1] for r in got}
    # a row that can't be or isn't tampered with is verified, any other not
    tampered = {r[0] for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 0}
    assert all(r[-1] or r[0] in tampered for r in got)


def test_manifest_of_several_blocks(spark):
    rows = [(i, None, "en" if i < 2500 else "de" if i < 3525 else None, None, 1) for i in range(3526)]
    assert manifests(spark, rows, links=3) == manifest_by_hand(rows)


def test_manifest_of_one_row_and_of_none(spark):
    assert manifests(spark, [(1, "a", "en", "s", 1)]) == manifest_by_hand([(1, "a", "en", "s", 1)])
    assert manifests(spark, []) == []


def test_session_settings_stay(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    manifests(spark, [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)])
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
