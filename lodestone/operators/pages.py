"""Pages as events: one pass over a page's characters tells its texts, tags and links; what is asked of a page is a step over those."""

from __future__ import annotations

import codecs
import html as entities
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import clean_link
from lodestone.operators.graph import Growing, Scratch

# Which attribute of an element is a link, marks of a title that vary by host, charsets in order of trial,
# elements without an end, ports left out of a URL, texts that tell a refusal, and the elements that part words.
LINKS = {"a": "href", "iframe": "src", "embed": "src", "object": "data", "form": "action"}
TITLE_MARKS = {"kbinsure.co.kr": r"\s*\[[A-Z]\]\s*$"}
CHARSETS = ("utf-8", "euc-kr", "cp949")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PORTS = {"http": 80, "https": 443}
REFUSALS = ("captcha", "verify you are human", "login required", "로그인이 필요", "access denied", "접근이 차단")
PARTING = frozenset("br p div td th tr".split())

KEPT = frozenset((*LINKS.values(), "onclick", "rel", "id", "type"))
_MARK = re.compile(r"<(?:(?P<note>!--)|(?P<other>[!?])|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+))")
_PART = re.compile(r"""[\s/]*+(?:(?P<close>>)|(?P<key>[^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"(?P<a>[^"]*+)"|'(?P<b>[^']*+)'|(?P<c>[^\s>"']*+)))?+)""")
EVENT = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "tag", "name", "value")]))


def events(html: str | None) -> Iterator[tuple[str, str, str, str]]:
    """(kind, tag, name, value) of a page in order: text, title (the text of one), note (a comment or declaration), open and close of a tag, and after an open one attr for each of its kept attributes.

    What scripts and styles hold says nothing; an unfinished tag or comment is the end of the page.
    """
    html, at = html or "", 0
    while at < len(html):
        mark = _MARK.search(html, at)
        upto = mark.start() if mark else len(html)
        if upto > at:
            yield "text", "", "", entities.unescape(html[at:upto])
        if not mark:
            return
        at = mark.end()
        if mark["note"] or mark["other"]:
            stop = "-->" if mark["note"] else ">"
            until = html.find(stop, at)
            yield "note", "", "", ""
            if until < 0:
                return
            at = until + len(stop)
            continue
        tag, told = mark["name"].lower(), []
        while True:
            part = _PART.match(html, at)
            if not part:
                return
            at = part.end()
            if part["close"]:
                break
            value = next((v for v in part.group("a", "b", "c") if v is not None), None)
            if part["key"].lower() in KEPT:
                told.append((part["key"].lower(), None if value is None else entities.unescape(value)))
        yield "close" if mark["end"] else "open", tag, "", ""
        if mark["end"]:
            continue
        for name, value in told:
            yield "attr", tag, name, value
        if tag in ("script", "style", "title"):
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else len(html)
            if tag == "title":
                yield "title", tag, "", entities.unescape(html[at:stop])
            at = stop


@F.pandas_udf(EVENT)
def page_events(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [dict(zip(("kind", "tag", "name", "value"), e, strict=True)) for e in events(p)])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())]))
def decoded(pages: pd.Series) -> pd.DataFrame:
    """A page's bytes as text, and the charset that read them: the one it declares in its first 4,096 bytes, else those to be tried, else UTF-8 with replacements."""
    rows = []
    for raw in pages:
        raw = bytes(raw or b"")
        said = re.search(rb"<meta[^>]+charset\s*=\s*['\"]?([\w-]+)", raw[:4096], re.I)
        for charset in (*([said[1].decode("ascii", "ignore")] if said else []), *CHARSETS):
            try:
                rows.append((raw.decode(codecs.lookup(charset).name), charset))
                break
            except (LookupError, UnicodeDecodeError):
                continue
        else:
            rows.append((raw.decode("utf-8", "replace"), "utf-8-replace"))
    return pd.DataFrame(rows, columns=["text", "charset"])


def _of_host(host: Column, suffix: str) -> Column:
    name = F.split_part(F.substring_index(F.lower(F.coalesce(host, F.lit(""))), "@", -1), F.lit(":"), F.lit(1))
    return (name == suffix) | name.endswith(f".{suffix}")


def visible_text(html: Column, host: Column) -> Column:
    """What a page says: its texts, its titles without what varies on their host, cleaned link targets as [link:..] and handlers as [onclick:..], white space as single blanks.

    The page is read in Arrow batches; all else are built-in functions over its events.
    """
    is_link = lambda e: reduce(lambda a, b: a | b, [(e["tag"] == tag) & (e["name"] == name) for tag, name in LINKS.items()])
    title = lambda v: reduce(lambda v, m: F.when(_of_host(host, m[0]), F.regexp_replace(v, m[1], "")).otherwise(v), TITLE_MARKS.items(), v)

    def shown(e: Column) -> Column:
        v, blank = e["value"], F.lit(" ")
        attr = F.when(v.isNull(), "").when(is_link(e), F.concat(F.lit(" [link:"), clean_link(v, host), F.lit("] "))).when((e["name"] == "onclick") & (F.trim(v) != ""), F.concat(F.lit(" [onclick:"), v, F.lit("] "))).otherwise("")
        return F.when(e["kind"] == "text", v).when(e["kind"] == "title", F.concat(blank, title(v), blank)).when(e["kind"] == "attr", attr).otherwise(blank)

    return F.trim(F.regexp_replace(F.array_join(F.transform(page_events(html), shown), ""), r"(?U)\s+", " "))


def http_url(href: str | None, base: str = "") -> str | None:
    """A link's absolute form without fragment and default port, or None: for blanks, control signs or backslashes in it, other schemes, no host, a user name, or what is no URL."""
    link = (href or "").strip()
    if not link or re.search(r"[\x00-\x20\\]", link):
        return None
    try:
        full = urlsplit(urldefrag(urljoin(base, link)).url)
        name, port = full.hostname, full.port
    except ValueError:
        return None
    if full.scheme not in PORTS or not name or "@" in full.netloc:
        return None
    place = (f"[{name}]" if ":" in name else name) + ("" if port in (None, PORTS[full.scheme]) else f":{port}")
    return full._replace(netloc=place, path=full.path or "/").geturl()


class _Outline:
    """What a listing page shows of itself: its anchors, the element of one id, and a refusal."""

    def __init__(self, html: str | None, base: str, id_: str, nodes: int, depth: int, longest: int):
        self.error = self.refusal = None
        self.anchors: list[dict] = []
        self.boxes: list[list] = []  # [closed, from, to, element, still open] of the elements of the id, in pieces of what is said
        self.said: list[str] = []
        stack: list[list] = []  # [tag, attributes, place of its text, anchor]
        outer = quiet = count = 0
        current: list | None = None

        def leave(n: int, closed: bool) -> None:
            nonlocal outer, quiet
            for own in reversed(stack[n:]):
                whole = closed and own is stack[n]
                quiet -= own[0] in ("script", "style", "template")
                if own[3] is not None:
                    text = self._text(own[2], len(self.said), longest)
                    own[3] |= {"title": text, "closed": whole}
                for box in self.boxes:
                    if box[3] is own:
                        box[0], box[2], box[4] = whole, len(self.said), False
                if own[0] in ("title", "h1", "p"):
                    outer -= 1
                    text = None if outer else self._text(own[2], len(self.said), longest)
                    self.error = "text_limit" if not outer and text is None else self.error
                    if text and any(m in text.casefold() for m in REFUSALS):
                        self.refusal = self.refusal or "access_blocked"
                if own[0] in PARTING:
                    self.said.append(" ")
            del stack[n:]

        def ready() -> None:
            """The tag whose attributes are known."""
            nonlocal current
            own, current = current, None
            if own is None:
                return
            attrs = own[1]
            if own[0] == "input" and (attrs.get("type") or "").lower() == "password":
                self.refusal = self.refusal or "login_required"
            if attrs.get("id") == id_:
                self.boxes.append([own[0] in VOID, len(self.said), len(self.said), own, own[0] not in VOID])
            if own[0] == "a":
                own[3] = {"url": http_url(attrs.get("href"), base), "rel": "next" in (attrs.get("rel") or "").lower().split(), "at": len(self.said), "title": None, "closed": False, "boxed": any(b[4] for b in self.boxes)}
                self.anchors.append(own[3])
            if own[0] in VOID:
                stack.pop()

        for kind, tag, name, value in events(html):
            if kind == "attr" and current is not None:
                if name in current[1]:
                    self.error = "duplicate_attributes"
                    return
                current[1][name] = value
                continue
            ready()
            if kind == "open":
                count += 1
                if count > nodes or len(stack) >= depth:
                    self.error = "html_structure_limit"
                    return
                if tag in PARTING:
                    self.said.append(" ")
                quiet += tag in ("script", "style", "template")
                outer += tag in ("title", "h1", "p")
                current = [tag, {}, len(self.said), None]
                stack.append(current)
            elif kind == "close":
                n = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == tag), None)
                if n is not None:
                    leave(n, True)
            elif kind in ("text", "title") and not quiet:
                self.said.append(value)
        ready()
        leave(0, False)
        if any(a["title"] is None for a in self.anchors):
            self.error = "text_limit"

    def _text(self, start: int, end: int, longest: int) -> str | None:
        """The text said from one piece to another with single blanks; None if it is too long for a title."""
        size, parts = 0, []
        for piece in self.said[start:end]:
            size += len(piece)
            if size > longest:
                return None
            parts.append(piece)
        return " ".join("".join(parts).split())


OUTLINE = "struct<base: string, error: string, refusal: string, boxes: int, closed: boolean, text: string, anchors: array<struct<url: string, host: string, rel: boolean, title: string, closed: boolean, boxed: boolean>>>"


def listings(pages: DataFrame, key: str = "page_id", container: str = "documents", suffixes: tuple[str, ...] = (".pdf", ".hwp", ".zip"), pattern: str | None = None, pattern_kind: str = "pdf", hosts: tuple[str, ...] = (), next_texts: tuple[str, ...] = ("next", "다음"), empty_texts: tuple[str, ...] = ("no results", "검색 결과가 없습니다"), nodes: int = 8192, depth: int = 64, longest: int = 8192) -> DataFrame:
    """(key, url, status, reason, documents ARRAY<STRUCT<url, kind, title>>, next_page) of listing pages (key, url, html).

    complete with documents or a next page; empty_ok only where the container says that it is empty; blocked for refusals;
    else structure_changed, with the reason and the documents found before it: invalid_source_url,
    duplicate_attributes, html_structure_limit, text_limit, missing_expected_structure, invalid_next_page, ambiguous_next_page,
    unclosed_document_link, unverified_empty_listing.  Links to other hosts than the page's and those named are left out.
    """

    @F.pandas_udf(OUTLINE)
    def outlined(htmls: pd.Series, urls: pd.Series) -> pd.DataFrame:
        rows = []
        for html, url in zip(htmls, urls, strict=True):
            base = http_url(url)
            o = _Outline(html, base or "", container, nodes, depth, longest)
            box = o.boxes[0] if len(o.boxes) == 1 else None
            said = " ".join("".join(o.said[box[1] : box[2]]).split()) if box else None
            anchors = [{"url": a["url"], "host": urlsplit(a["url"]).hostname if a["url"] else None, "rel": a["rel"], "title": a["title"], "closed": a["closed"], "boxed": a["boxed"]} for a in o.anchors]
            rows.append((base, o.error, o.refusal, len(o.boxes), bool(box and box[0]), said, anchors))
        return pd.DataFrame(rows, columns=["base", "error", "refusal", "boxes", "closed", "text", "anchors"])

    o = F.col("_o")
    rows = pages.select(key, "url", "html").withColumn("_o", outlined("html", "url"))
    allowed = F.array_append(F.array(*[F.lit(h.lower()) for h in hosts]).cast("array<string>"), F.regexp_extract(o["base"], r"\Ahttps?://(\[[^\]]*\]|[^/:?]*)", 1))
    bare = F.transform(allowed, lambda h: F.regexp_replace(h, r"[\[\]]", ""))
    onward = lambda a: a["rel"] | F.lower(a["title"]).isin(*[" ".join(t.split()).lower() for t in next_texts])
    ours = lambda a: F.coalesce(F.array_contains(bare, a["host"]), F.lit(False))
    on = F.filter(o["anchors"], onward)
    bad_next = F.exists(on, lambda a: ~a["closed"] | a["url"].isNull() | ~ours(a) | (a["url"] == o["base"]))
    after = F.array_distinct(F.transform(on, lambda a: a["url"]))
    path = lambda u: F.lower(F.regexp_extract(u, r"\A[^?]*", 0))
    kind = lambda u: F.coalesce(*[F.when(path(u).endswith(s), s[1:]) for s in suffixes], F.when(u.rlike(pattern), pattern_kind) if pattern else F.lit(None).cast("string"))
    found = F.filter(o["anchors"], lambda a: a["boxed"] & a["url"].isNotNull() & ours(a) & ~F.array_contains(F.col("_after"), a["url"]) & kind(a["url"]).isNotNull())
    first = F.filter(F.col("_found"), lambda a, i: ~F.exists(F.slice(F.col("_found"), F.lit(1), i), lambda b: b["url"] == a["url"]))
    rows = rows.withColumn("_after", after).withColumn("_found", found).withColumn("_first", first)
    unclosed = F.array_position(F.transform("_first", lambda a: a["closed"]), False)
    whole = F.when(unclosed > 0, F.slice("_first", F.lit(1), (unclosed - 1).cast("int"))).otherwise(F.col("_first"))
    documents = F.transform(whole, lambda a: F.struct(a["url"].alias("url"), kind(a["url"]).alias("kind"), F.nullif(a["title"], F.lit("")).alias("title")))
    empty = reduce(lambda a, b: a | b, [F.contains(F.lower(o["text"]), F.lit(t.lower())) for t in empty_texts], F.lit(False))
    broken = F.when(o["base"].isNull(), "invalid_source_url").when(o["error"].isNotNull(), o["error"])
    early = F.when((o["boxes"] != 1) | ~o["closed"], "missing_expected_structure").when(bad_next, "invalid_next_page").when(F.size("_after") > 1, "ambiguous_next_page")
    late = F.when(unclosed > 0, "unclosed_document_link").when((F.size("_first") == 0) & (F.size("_after") == 0) & ~empty, "unverified_empty_listing")
    blocked = broken.isNull() & o["refusal"].isNotNull()
    reason = F.coalesce(broken, o["refusal"], early, late)
    status = F.when(blocked, "blocked").when(reason.isNotNull(), "structure_changed").when((F.size("_first") == 0) & (F.size("_after") == 0), "empty_ok").otherwise("complete")
    held = F.when(F.coalesce(broken, o["refusal"], early).isNull(), documents).otherwise(F.array().cast("array<struct<url: string, kind: string, title: string>>"))
    return rows.select(key, "url", status.alias("status"), reason.alias("reason"), held.alias("documents"), F.when(status == "complete", F.get("_after", F.lit(0))).alias("next_page"))


def follow_pages(roots: DataFrame, listed: DataFrame, most: int = 10) -> DataFrame:
    """(root, status, reason, pages, documents): what the pages after each root (root, url) come to, over listings as given by `listings`.

    From page to page by next_page, each URL once a root and `most` pages at most.  A root is complete only if its chain ends and every page is
    complete or empty_ok; else its status and reason are those of the first page that isn't, missing_page for one that was not listed, or
    structure_changed with pagination_limit where a page beyond the last allowed is named and not visited.  documents counts distinct URLs.
    """
    spark, scratch = listed.sparkSession, Scratch(listed.sparkSession)
    by_url = scratch.keep(listed.where("url IS NOT NULL").groupBy("url").agg(F.min_by(F.struct("status", "reason", "documents", "next_page"), F.struct("status", "reason", "next_page")).alias("l")).select("url", "l.*"))
    kind = roots.schema["root"].dataType.simpleString()
    seen = Growing(scratch, f"root {kind}, url string, n int, status string, reason string, documents array<string>, next_page string")
    here, n = roots.select("root", "url").where("root IS NOT NULL").distinct(), 1
    while True:
        met = here.join(by_url, "url", "left")
        new = seen.add(met.select("root", "url", F.lit(n).alias("n"), F.coalesce("status", F.lit("missing_page")).alias("status"), "reason", F.transform("documents", lambda d: d["url"]).alias("documents"), "next_page"))
        been = seen.rows().select("root", "url")
        here = new.where("next_page IS NOT NULL").select("root", F.col("next_page").alias("url")).distinct().join(been, ["root", "url"], "left_anti")
        if n == most or new.isEmpty():
            break
        n += 1
    over = here.select("root").distinct().withColumn("_over", F.lit(True))
    rows = seen.rows()
    bad = rows.where("status NOT IN ('complete', 'empty_ok')").groupBy("root").agg(F.min_by(F.struct("status", "reason"), "n").alias("_bad"))
    held = rows.select("root", F.explode("documents").alias("d")).distinct().groupBy("root").agg(F.count("*").alias("_docs"))
    out = rows.groupBy("root").agg(F.count("*").alias("pages")).join(held, "root", "left").join(bad, "root", "left").join(over, "root", "left")
    status = F.when(F.col("_bad").isNotNull(), F.col("_bad.status")).when(F.col("_over"), "structure_changed").otherwise("complete")
    reason = F.when(F.col("_bad").isNotNull(), F.col("_bad.reason")).when(F.col("_over"), "pagination_limit")
    out = scratch.keep(out.select("root", status.alias("status"), reason.alias("reason"), "pages", F.coalesce("_docs", F.lit(0)).cast("bigint").alias("documents")))
    scratch.drop_all(out)
    seen.drop()
    return out
