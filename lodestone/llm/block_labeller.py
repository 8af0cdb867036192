"""HTML main-text extraction by a recurrent block labeller.

A page is read into its leaf blocks: runs of text that no block-level tag interrupts, each with the
path of open elements above it.  A bidirectional LSTM in numpy reads the sequence of blocks, each as
the sum of hashed path-token vectors, the mean of hashed word vectors and a few lengths, and labels
every block with the whole page as context.  It is trained on a bounded sample of pages whose blocks
are labelled by what their elements mean, with page furniture of many kinds mixed in.
"""

from __future__ import annotations

import html as html_lib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"\w+")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg iframe object textarea title head select".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: An opening tag ends an open element of these names, as far as the nearest of the enclosing names.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
#: Words in element names, classes and ids that tell what an element is for; fixed values of the labelling rule.
CONTENT = frozenset("article main content post entry story body text articlebody".split())
FURNITURE = frozenset("ad ads adv advert advertisement banner sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot copyright sidebar side aside widget related share sharing social comment comments reply replies discussion respond notice alert cookie consent gdpr popup modal newsletter subscribe signup login form search pagination pager tags toolbar skip disclaimer".split())
PATHS, WORDS = 1 << 10, 1 << 11


def tags(html: str):
    """(start, end, closing, name, attributes) of every tag, comment (no name) and declaration, in order.

    A quoted attribute value ends at its quote however far that is; a quote without an end is an
    ordinary character.  There is at most one such of each kind, so the scan is linear.  What follows
    a tag without `>` is text.
    """
    at, dead = 0, set()
    while (at := html.find("<", at)) >= 0:
        m = _OPEN.match(html, at)
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield at, end, "", "", ""
        elif m:
            pos, end = m.end(), -1
            while end < 0:
                stop = _STOP.search(html, pos)
                if not stop:
                    return
                pos = stop.end()
                if stop[0] == ">":
                    end = pos
                elif stop.start() not in dead:
                    close = html.find(stop[0], pos)
                    if close < 0:  # the last quote of its kind; read the tag again without it
                        dead.add(stop.start())
                        pos = m.end()
                    else:
                        pos = close + 1
            found = yield at, end, m[1], m[2].lower(), html[m.end() : end - 1]
            end = end if found is None else found
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            if end < 0:
                return
            end += 1
            yield at, end, "", "", ""
        else:
            end = at + 1
        at = end


class Step:
    """An open element on a path: its tokens and the step above it, which its neighbours share."""

    __slots__ = ("above", "tokens")

    def __init__(self, above: Step | None, tokens: tuple[str, ...]):
        self.above, self.tokens = above, tokens

    def path(self) -> tuple[str, ...]:
        parts, at = [], self
        while at is not None:
            parts.append(at.tokens)
            at = at.above
        return tuple(t for ts in reversed(parts) for t in ts)


TOP = Step(None, ())


def blocks(html: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path tokens, characters inside links) of every non-empty leaf block, in page order."""
    return [(text, step.path(), linked) for text, step, linked in leaves(html)]


def leaves(html: str | None) -> list[tuple[str, Step, int]]:
    """The blocks with their paths as steps, which share what lies above: linear in the page however deep it is nested."""
    out: list[tuple[str, Step, int]] = []
    if not html:
        return out
    stack: list[tuple[str, Step]] = []
    opened: dict[str, int] = {}  # how many elements of a name are open
    parts: list[str] = []
    silent = link = linked = at = depth = 0  # depth: how much of the stack the block's path has

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            at_ = min(depth, len(stack))
            out.append((text, stack[at_ - 1][1] if at_ else TOP, min(linked, len(text))))
        parts.clear()
        linked = 0

    def say(raw):
        nonlocal linked
        if raw and not silent:
            text = html_lib.unescape(raw)
            parts.append(text)
            linked += len(text.strip()) if link else 0

    def drop(n):
        nonlocal silent, link
        for name, _ in stack[n:]:
            silent -= name in SILENT
            link -= name == "a"
            opened[name] -= 1
        del stack[n:]

    scan, skip = tags(html), None
    while True:
        try:
            start, end, closing, name, attrs = scan.send(skip)
        except StopIteration:
            say(html[at:])
            break
        skip = None
        say(html[at:start])
        at = end
        if not name:
            continue
        block = name in BLOCKS
        if name == "br":
            parts.append("\n")
            continue
        if block:
            flush()
        if closing:
            for n in range(len(stack) - 1, -1, -1) if opened.get(name) else ():
                if stack[n][0] == name:
                    drop(n)
                    break
                if not block and stack[n][0] in BLOCKS:
                    break  # an inline end tag closes nothing beyond its block
        elif name not in VOID:
            if block and name not in ("button", "label", "option") and opened.get("p"):
                for n in range(len(stack) - 1, -1, -1):  # a block-level tag ends an open paragraph
                    if stack[n][0] == "p":
                        drop(n)
                        break
                    if stack[n][0] in BLOCKS:
                        break
            if name == "body" and opened.get("head"):
                for n, (k, _) in enumerate(stack):
                    if k == "head":
                        drop(n)
                        break
            if name in ENDS:
                ended, within = (x.split() for x in ENDS[name])
                for n in range(len(stack) - 1, -1, -1) if any(map(opened.get, ended)) else ():
                    if stack[n][0] in ended:
                        drop(n)
                        break
                    if stack[n][0] in within:
                        break
            if attrs.endswith("/") and not block:
                continue
            tokens = [name] if block else []
            for key, a, b, c in _NAMED.findall(attrs):
                for word in re.split(r"[\s_]+|(?<=[a-z])-|(?<=[a-z])(?=[A-Z])", a or b or c):
                    if word:
                        tokens.append(f"{key.lower()}={word.lower()}")
            stack.append((name, Step(stack[-1][1] if stack else None, tuple(tokens))))
            opened[name] = opened.get(name, 0) + 1
            silent += name in SILENT
            link += name == "a"
            if name in RAW:
                end = re.compile(rf"</{name}\s*>|</{name}(?=[\s/>])", re.I).search(html, at)
                at = skip = end.start() if end else len(html)
        if block or closing or not parts:
            depth = len(stack)
    flush()
    return out


def rule_label(path: tuple[str, ...]) -> int | None:
    """1 inside an article or main element without page furniture in between, 0 inside furniture, None if the elements don't tell."""
    inside = None
    for token in path:
        word = token.partition("=")[2] or token
        if word in FURNITURE or word in ("form", "button", "label", "fieldset"):
            return 0
        if word in CONTENT and token != "body":
            inside = 1
    return inside


class Features:
    """Hashed path and word ids of blocks, remembered."""

    def __init__(self):
        self.path: dict[tuple[str, ...], np.ndarray] = {}
        self.word: dict[str, int] = {}

    def paths(self, path):
        if path not in self.path:
            if len(self.path) > 50_000:
                self.path.clear()
            named = [*path, *(f"{a}>{b}" for a, b in zip(path[:-1], path[1:], strict=True))]
            self.path[path] = np.array([zlib.crc32(t.encode("utf-8", "replace")) % PATHS for t in named] or [0])
        return self.path[path]

    def words(self, text):
        found = _WORD.findall(text.lower())
        if len(self.word) > 500_000:
            self.word.clear()
        for w in found:
            if w not in self.word:
                self.word[w] = zlib.crc32(w.encode("utf-8", "replace")) % WORDS
        return np.fromiter(map(self.word.__getitem__, found), np.int64, len(found))

    def sums(self, page, table):
        """The rows of a table that each block's path has, summed: along the steps, each of which is added up once."""
        done: dict[int, tuple[np.ndarray, str | None]] = {}
        for _, step, _ in page:
            way = []
            while step is not None and id(step) not in done:
                way.append(step)
                step = step.above
            total, last = done[id(step)] if step is not None else (np.zeros(table.shape[1], np.float32), None)
            for step in reversed(way):
                if step.tokens:
                    before = (last,) if last is not None else ()
                    total = total + table[self.paths(before + step.tokens)].sum(axis=0) - (table[self.paths(before)].sum(axis=0) if before else 0)
                    last = step.tokens[-1]
                done[id(step)] = total, last
        none = table[self.paths(())].sum(axis=0)
        return [done[id(step)][0] if done[id(step)][1] is not None else none for _, step, _ in page]

    def page(self, page, table):
        """The features of a page's leaves, for a model with that table of path vectors."""
        return [self.block((text, way.astype(np.float32), linked), i, len(page)) for i, ((text, _, linked), way) in enumerate(zip(page, self.sums(page, table), strict=True))]

    def block(self, b, i, n):
        text, path, linked = b
        w = self.words(text)
        return path if isinstance(path, np.ndarray) else self.paths(path), w, np.array([np.log1p(len(text)) / 8, np.log1p(len(w)) / 6, linked / max(1, len(text)), text[-1:] in ".!?…", i / max(1, n)], np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic output on both states and the input."""

    def __init__(self, dim: int = 12, word_dim: int = 6, hidden: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        d = dim + word_dim + 5
        normal = lambda *s: rng.normal(0, s[-2] ** -0.5 if len(s) > 1 else 0.1, s).astype(np.float32)
        self.h = hidden
        self.p = {"path": rng.normal(0, 0.1, (PATHS, dim)).astype(np.float32), "word": rng.normal(0, 0.1, (WORDS, word_dim)).astype(np.float32), "out": normal(2 * hidden + d, 1)[:, 0], "base": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": normal(d, 4 * hidden), f"h{side}": normal(hidden, 4 * hidden), f"c{side}": np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)].astype(np.float32)}
        self.adam = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        self.steps = 0

    def inputs(self, pages):
        """(x[page, block, d], mask) of pages given as lists of block features."""
        t = max(1, max(len(p) for p in pages))
        dim, wdim = self.p["path"].shape[1], self.p["word"].shape[1]
        x, mask = np.zeros((len(pages), t, dim + wdim + 5), np.float32), np.zeros((len(pages), t), np.float32)
        for i, page in enumerate(pages):
            for j, (paths, words, numbers) in enumerate(page):
                x[i, j, :dim] = paths if paths.dtype == np.float32 else self.p["path"][paths].sum(axis=0)
                if len(words):
                    x[i, j, dim : dim + wdim] = np.bincount(words, minlength=WORDS) @ self.p["word"] / len(words) if len(words) > 4000 else self.p["word"][words].mean(axis=0)
                x[i, j, dim + wdim :] = numbers
            mask[i, : len(page)] = 1
        return x, mask

    def _run(self, x, mask, side, keep=False):
        h = c = np.zeros((len(x), self.h), np.float32)
        pre, wh, n = x @ self.p[f"x{side}"] + self.p[f"c{side}"], self.p[f"h{side}"], self.h
        out, tape = np.zeros((*x.shape[:2], n), np.float32), []
        for t in range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1):
            z = pre[:, t] + h @ wh
            g = sigmoid(z[:, : 3 * n])
            u = np.tanh(z[:, 3 * n :])
            m = mask[:, t : t + 1]
            new = g[:, n : 2 * n] * c + g[:, :n] * u
            th = np.tanh(new)
            hn = g[:, 2 * n :] * th
            if keep:
                tape.append((t, h, c, g, u, th, m))
            h, c = m * hn + (1 - m) * h, m * new + (1 - m) * c
            out[:, t] = h
        return out, tape

    def logits(self, x, mask):
        return np.concatenate([self._run(x, mask, "f")[0], self._run(x, mask, "b")[0], x], axis=2) @ self.p["out"] + self.p["base"]

    def step(self, pages, labels, rate=0.01):
        """One Adam step on the mean logistic loss over the labelled blocks (label -1: not counted)."""
        x, mask = self.inputs(pages)
        y = np.full(mask.shape, -1.0, np.float32)
        for i, label in enumerate(labels):
            y[i, : len(label)] = label
        (hf, tf), (hb, tb) = self._run(x, mask, "f", True), self._run(x, mask, "b", True)
        full = np.concatenate([hf, hb, x], axis=2)
        known = (y >= 0) & (mask > 0)
        dz = np.where(known, sigmoid(full @ self.p["out"] + self.p["base"]) - y, 0.0).astype(np.float32) / max(1, known.sum())
        grad = {"out": np.einsum("ntd,nt->d", full, dz), "base": np.array([dz.sum()], np.float32)}
        dfull = dz[..., None] * self.p["out"]
        dx, n = dfull[:, :, 2 * self.h :].copy(), self.h
        for side, tape, dh_all in (("f", tf, dfull[:, :, :n]), ("b", tb, dfull[:, :, n : 2 * n])):
            wx, wh = self.p[f"x{side}"], self.p[f"h{side}"]
            gx, gh, gc = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * n, np.float32)
            dh = dc = np.zeros((len(x), n), np.float32)
            for t, h0, c0, g, u, th, m in reversed(tape):
                dh = dh + dh_all[:, t]
                live_h, live_c = dh * m, dc * m
                go, gi, gf = g[:, 2 * n :], g[:, :n], g[:, n : 2 * n]
                live_c = live_c + live_h * go * (1 - th * th)
                z = np.concatenate([live_c * u * gi * (1 - gi), live_c * c0 * gf * (1 - gf), live_h * th * go * (1 - go), live_c * gi * (1 - u * u)], axis=1)
                gx += x[:, t].T @ z
                gh += h0.T @ z
                gc += z.sum(axis=0)
                dx[:, t] += z @ wx.T
                dh, dc = z @ wh.T + dh * (1 - m), live_c * gf + dc * (1 - m)
            grad |= {f"x{side}": gx, f"h{side}": gh, f"c{side}": gc}
        gp, gw = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        dim, wdim = gp.shape[1], gw.shape[1]
        for i, page in enumerate(pages):
            for j, (paths, words, _) in enumerate(page):
                np.add.at(gp, paths, dx[i, j, :dim])
                if len(words):
                    np.add.at(gw, words, dx[i, j, dim : dim + wdim] / len(words))
        grad |= {"path": gp, "word": gw}
        self.steps += 1
        for k, g in grad.items():
            a, b = self.adam[k]
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            self.p[k] -= rate * (a / (1 - 0.9**self.steps)) / (np.sqrt(b / (1 - 0.999**self.steps)) + 1e-8)

    def label(self, pages, size: int = 64) -> list[np.ndarray]:
        """True for every block of main text; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
        for lo in range(0, len(order), size):
            some = order[lo : lo + size]
            x, mask = self.inputs([pages[i] for i in some])
            z = self.logits(x, mask)
            for k, i in enumerate(some):
                out[i] = z[k, : len(pages[i])] >= 0
        return out


#: Containers that training pages are mixed with, by what they are for.
AROUND = ("article", "main", "div class=content", "div id=content", "div class=post", "section class=entry", "div class=article body", "div role=main", "div itemprop=articlebody", "div class=story", "section class=text")
AMONG = ("nav", "header", "footer", "aside", "form", "div class=ad", "div class=ads", "div class=advert", "div class=sidebar", "div id=sidebar", "div class=menu", "ul class=menu", "div class=comments", "section class=comments", "div id=comments", "div class=comment", "ol class=comment", "div class=notice", "div class=cookie", "div class=banner", "div class=promo", "div class=related", "div class=share", "div class=newsletter", "div class=footer", "div class=header", "div class=breadcrumb", "section class=reply", "div class=popup", "div class=widget", "p class=notice", "div class=login", "form class=search", "div class=pagination", "header class=masthead")


#: Elements whose name tells what they are for.
TELLING = frozenset("article main nav header footer aside section form".split())


def _tokens(container: str) -> tuple[str, ...]:
    name, _, attrs = container.partition(" ")
    key, _, words = attrs.partition("=")
    return (name, *(f"{key}={w}" for w in words.split()))


def varied(page, pool, rng: random.Random):
    """A training page: the same blocks, often in another container, with furniture from a pool of texts mixed in; and its labels.

    On some pages class and id words are replaced by meaningless ones, and on some of those the telling
    elements by plain div, so that the labeller also learns from words, links, lengths and neighbours.
    """
    around = _tokens(rng.choice(AROUND)) if rng.random() < 0.6 else None
    out = []
    for text, path, linked in page:
        label = rule_label(path)
        if around and label == 1 and "article" in path:
            at = path.index("article")
            path = (*path[:at], *around, *path[at + 1 :])
        out.append((text, path, linked, -1 if label is None else label))
    inner = [b for b in out if b[3] == 1]
    for _ in range(rng.randint(0, 5)):
        text = rng.choice(pool)
        if rng.random() < 0.5:
            words = text.split()
            at = rng.randrange(len(words))
            text = " ".join(words[at : at + rng.randint(1, 12)])
        stem = inner[0][1][:-1] if inner and rng.random() < 0.5 else ("html", "body")
        path = (*stem, *_tokens(rng.choice(AMONG)), *rng.choice([(), ("p",), ("ul", "li"), ("div",), ("h2",), ("h3",)]))
        many = rng.choice([1, 1, 3])
        at = rng.randint(0, len(out))
        out[at:at] = [(text, path, len(text) if rng.random() < 0.4 else 0, 0)] * many
    if rng.random() < 0.4:
        salt, bare = rng.randrange(10**6), rng.random() < 0.5
        hide = lambda t: f"class=x{zlib.crc32(f'{salt} {t}'.encode('utf-8', 'replace')) % 10**6}" if "=" in t else "div" if bare and t in TELLING else t
        out = [(text, tuple(map(hide, path)), linked, y) for text, path, linked, y in out]
    return [b[:3] for b in out], [b[3] for b in out]


def slice_of(html: str, key: int, most: int) -> list[tuple[str, tuple[str, ...], int]]:
    """Neighbouring blocks of a page, from a place that the key tells, with at most `most` characters of texts and paths; all blocks where they fit.

    A block of more than a tenth of that is taken in pieces, as blocks of their own.
    """
    part = max(1, most // 10)
    page = [(text[lo : lo + part], step, min(linked, part)) for text, step, linked in leaves(html) for lo in range(0, len(text), part)]
    sizes = [len(text) for text, _, _ in page]
    at = 0 if sum(sizes) <= most else key % len(page)
    out, left = [], most
    for text, step, linked in page[at:] + page[:at] if at else page:
        path = step.path()
        left -= len(text) + sum(map(len, path))
        if left < 0:
            break
        out.append((text, path, linked))
    return out


def train(pages: DataFrame, sample: int = 300, epochs: int = 16, window: int = 40, longest: int = 200_000, html: str = "html", page_id: str = "page_id", seed: int = 9) -> Labeller:
    """A labeller from at most `sample` pages, first by the hash of their id, each cut into windows of `window` blocks.

    Tasks read the pages whole; of each, blocks with at most `longest` characters of text and path reach the driver, so what it
    learns from is bounded, and a page's length doesn't matter.  Of rows that share an id the least html is used.
    """
    pages = pages.select(page_id, html)
    chosen = pages.where(F.col(page_id).isNotNull() & F.col(html).isNotNull()).select(F.col(page_id).alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = pages.select(F.col(page_id).alias("i"), F.col(html).alias("t")).join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("t").alias("t")).select("i", F.pmod(F.xxhash64("i"), F.lit(2**31)).alias("key"), "t")

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [slice_of(t, int(k), longest) for t, k in zip(batch["t"], batch["key"], strict=True)]
            yield pd.DataFrame({"i": batch["i"], "b": [[{"text": t, "path": list(p), "linked": n} for t, p, n in page] for page in read]})

    kind = pages.schema[page_id].dataType.simpleString()
    cut = rows.mapInPandas(parts, f"i {kind}, b array<struct<text: string, path: array<string>, linked: int>>").collect()
    read = [[(b.text, tuple(b.path), b.linked) for b in r.b] for r in sorted(cut, key=lambda r: r.i) if r.b]
    model, rng, features = Labeller(), random.Random(seed), Features()
    pool = [b[0] for p in read for b in p] or ["menu"]
    if not any(rule_label(b[1]) == 1 for p in read for b in p):  # nothing to learn from: pages of the same texts in known containers
        read += [[(t, ("html", "body", "article", "p"), 0) for t in pool[i : i + 8]] for i in range(0, min(len(pool), 800), 8)]
    for _ in range(epochs):
        work = []
        for page in read:
            body, labels = varied(page, pool, rng)
            at = rng.randrange(max(1, len(body) - window + 1))
            body, labels = body[at : at + window], labels[at : at + window]
            work.append(([features.block(b, at + i, at + len(body)) for i, b in enumerate(body)], labels))
        rng.shuffle(work)
        for lo in range(0, len(work), 16):
            model.step([w[0] for w in work[lo : lo + 16]], [w[1] for w in work[lo : lo + 16]])
    model.adam = {}
    return model


def main_text(html: Column, model: Labeller) -> Column:
    """The main text of a page: its blocks labelled so, joined by line feeds; empty for null pages."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features()
        for batch in batches:
            out: list[str] = []
            for lo in range(0, len(batch), 256):
                read = [leaves(h) for h in batch.iloc[lo : lo + 256]]
                keep = model.label([features.page(p, model.p["path"]) for p in read])
                out += ["\n".join(b[0] for b, k in zip(p, ks, strict=True) if k) for p, ks in zip(read, keep, strict=True)]
            yield pd.Series(out, dtype=object)

    return extract(html)


def extract(pages: DataFrame, sample: int = 300, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages.

    Null and empty pages give an empty text, pages without markup one block.  Pages and attributes of any
    length are read whole, in time linear in the page.  Repeated rows are read alike; a block is main
    text when its two labels tie; an empty table gives no rows; other columns, whatever their names,
    are ignored.
    """
    model = train(pages, sample, html=html, page_id=page_id)
    done = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), main_text(F.col(html), model).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
