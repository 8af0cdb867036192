"""Jobs over pages, documents, tables and sources: passages, quotes, page content, links, segments, clauses, fingerprints."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import article_path, clause_id, squeeze
from lodestone.operators.history import in_force
from lodestone.operators.pages import http_url

#: The rule by which pages' contents are hashed now: the text of `pages.visible_text`.
RULE = "visible-text-2"


def passages(md: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, passage): the quoted blocks of an extract without white space, apart at page marks and omissions.

    A block stands between ```text and ```; `[PDF p.N]` alone on a line begins page N, `...` a new passage.
    """
    blocks = md.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)```text\n(.*?)```"), F.lit(1))).alias("block", "body"))
    lines = blocks.select(key, "block", F.posexplode(F.split("body", "\n")).alias("line", "said"))
    page = F.regexp_extract("said", r"\A\s*\[PDF p\.(\d+)\]\s*\z", 1)
    lines = lines.withColumn("mark", F.when(page != "", page.try_cast("int"))).withColumn("cut", F.col("mark").isNotNull() | (F.trim("said") == "..."))
    by = Window.partitionBy(key, "block").orderBy("line")
    lines = lines.withColumn("page", F.last("mark", ignorenulls=True).over(by)).withColumn("part", F.sum(F.col("cut").cast("int")).over(by)).where("NOT cut")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n")
    done = lines.groupBy(key, "block", "part").agg(F.first("page", ignorenulls=True).alias("page"), squeeze(whole).alias("passage"))
    return done.where("passage <> ''").select(key, "page", "passage")


def quote_containment(claims: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(claim, found): whether a claim's quote (claim, key, page, quote), without white space, lies inside one passage of its document and page."""
    want = claims.withColumn("_q", squeeze(F.col("quote")))
    met = want.join(parts.select(F.col(key).alias("_k"), F.col("page").alias("_p"), "passage"), (F.col(key) == F.col("_k")) & F.col("page").eqNullSafe(F.col("_p")))
    hit = met.where(F.col("passage").contains(F.col("_q"))).select("claim").distinct().withColumn("found", F.lit(True))
    return claims.select("claim").distinct().join(hit, "claim", "left").select("claim", F.coalesce("found", F.lit(False)).alias("found"))


def condition_match(profile: Column, price: Column) -> Column:
    """STRUCT<matched, mismatched, not_in_source>: a profile's conditions against those a price states, maps both."""
    keys = F.array_sort(F.map_keys(profile))
    same = lambda k: F.try_element_at(profile, k) == F.try_element_at(price, k)
    has = lambda k: F.map_contains_key(price, k)
    return F.struct(F.filter(keys, lambda k: has(k) & F.coalesce(same(k), F.lit(False))).alias("matched"), F.filter(keys, lambda k: has(k) & ~F.coalesce(same(k), F.lit(False))).alias("mismatched"), F.filter(keys, lambda k: ~has(k)).alias("not_in_source"))


def amount_sources(lines: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """(line, status): lines (line, kind, ref, krw) against the table of their kind (ref, krw), each joined once: agrees, differs, no_source or unknown_kind."""
    every = None
    for kind, rows in sources.items():
        side = rows.select(F.lit(kind).alias("kind"), "ref", F.col("krw").alias("_krw"))
        every = side if every is None else every.unionByName(side)
    known = F.col("kind").isin(*sources)
    met = lines.join(every, ["kind", "ref"], "left")
    status = F.when(~known, "unknown_kind").when(F.col("_krw").isNull(), "no_source").when(F.col("_krw") == F.col("krw"), "agrees").otherwise("differs")
    return met.select("line", status.alias("status"))


def lookup(requests: DataFrame, table: DataFrame, key: str, day: str) -> DataFrame:
    """requests with the value of the table (key, valid_from, valid_to, value) in force on their day; several in force are an error, none NULL."""
    n = in_force(requests, table, key, day).groupBy(*requests.columns).agg(F.count("value").alias("_n"), F.min("value").alias("value"))
    none = requests.distinct().withColumn("_n", F.lit(0).cast("bigint")).withColumn("value", F.lit(None).cast(table.schema["value"].dataType))
    n = n.unionByName(none).groupBy(*requests.columns).agg(F.max("_n").alias("_n"), F.min("value").alias("value"))
    return n.withColumn("error", F.when(F.col("_n") > 1, "several_in_force")).withColumn("value", F.when(F.col("_n") <= 1, F.col("value"))).drop("_n")


def reject_late(writes: DataFrame, deletions: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, refused): writes (person or evaluation) of people whose deletion has begun are refused; owners (evaluation, person) name the person where a write does not."""
    named = writes.join(owners.select(F.col("evaluation"), F.col("person").alias("_owner")), "evaluation", "left").withColumn("_who", F.coalesce("person", "_owner"))
    gone = deletions.select(F.col("person").alias("_who")).distinct()
    kept, refused = (named.join(gone, "_who", how).select(*writes.columns) for how in ("left_anti", "left_semi"))
    return kept, refused


def source_change(now: DataFrame, before: DataFrame, rule: str = RULE) -> DataFrame:
    """(url, status): now (url, sha256, content_sha256), a NULL sha256 where the fetch failed, before (url, sha256, content_sha256, rule).

    Contents compare only under the same rule.
    """
    b = before.select("url", F.col("sha256").alias("_s"), F.col("content_sha256").alias("_c"), F.col("rule").alias("_r"))
    same = (F.col("_r") == rule) & (F.col("content_sha256") == F.col("_c"))
    status = F.when(F.col("sha256").isNull(), "fetch_failed").when(F.col("sha256") == F.col("_s"), "unchanged_bytes").when(F.coalesce(same, F.lit(False)), "bytes_changed_content_same").otherwise("changed")
    return b.join(now, "url").select("url", status.alias("status"))


class _Anchors(HTMLParser):
    """(href, text) of the anchors inside the elements of one name and class, and the cells of their tables' rows."""

    def __init__(self, tag: str, cls: str | None):
        super().__init__(convert_charrefs=True)
        self.want, self.depth, self.found, self.seen = (tag, cls), 0, [], 0
        self.rows, self.row, self.cell, self.open = [], None, None, None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == self.want[0]:
            if self.depth:
                self.depth += 1
            elif self.want[1] is None or self.want[1] in (own.get("class") or "").split():
                self.depth, self.seen = 1, self.seen + 1
        if self.depth and tag == "a" and own.get("href"):
            self.open = [own["href"], []]
        if self.depth and tag == "tr":
            self.row = []
        if self.depth and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.found.append((self.open[0], " ".join("".join(self.open[1]).split())))
            self.open = None
        if tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        if tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None
        if self.depth and tag == self.want[0]:
            self.depth -= 1

    def handle_data(self, data):
        for part in (self.open[1] if self.open else None, self.cell):
            if part is not None:
                part.append(data)


def _read(html: str | None, tag: str, cls: str | None) -> _Anchors:
    reader = _Anchors(tag, cls)
    reader.feed(html or "")
    reader.close()
    return reader


def discover_links(pages: DataFrame, tag: str, cls: str | None = None, pattern: str = ".", hosts: tuple[str, ...] = (), key: str = "page_id") -> DataFrame:
    """(key, status, target, text): the links of a page's one container whose target fits the pattern and whose host is allowed, each target once.

    complete, empty_ok (a container without links), or structure_changed (no or several containers), the
    latter two with a NULL target.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits = re.compile(pattern)
        for part in parts:
            out = []
            for i, url, html in zip(part[key], part["url"], part["html"], strict=True):
                read = _read(html, tag, cls)
                if read.seen != 1:
                    out.append((i, "structure_changed", None, None))
                    continue
                seen = {}
                for href, text in read.found:
                    to = http_url(href, url or "")
                    if to and fits.search(to) and (not hosts or urlsplit(to).hostname in hosts):
                        seen.setdefault(to, text)
                out += [(i, "complete", t, x) for t, x in seen.items()] or [(i, "empty_ok", None, None)]
            yield pd.DataFrame(out, columns=[key, "status", "target", "text"])

    return pages.select(key, "url", "html").mapInPandas(run, f"{key} long, status string, target string, text string")


def member_rows(pages: DataFrame, labels: tuple[str, ...], tag: str = "table", cls: str | None = None, key: str = "page_id") -> DataFrame:
    """(key, row, cells ARRAY): the rows below a table's header that names the columns, in any order; the cells in the labels' order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, html in zip(part[key], part["html"], strict=True):
                rows = _read(html, tag, cls).rows
                at = next((n for n, r in enumerate(rows) if set(labels) <= set(r)), None)
                if at is not None:
                    order = [rows[at].index(name) for name in labels]
                    out += [(i, n, [r[k] for k in order]) for n, r in enumerate(rows[at + 1 :], 1) if len(r) == len(rows[at])]
            yield pd.DataFrame(out, columns=[key, "row", "cells"])

    return pages.select(key, "html").mapInPandas(run, f"{key} long, row int, cells array<string>")


def segment_pages(pages: DataFrame, specs: DataFrame, doc: str = "doc", page: str = "page") -> tuple[DataFrame, DataFrame]:
    """(pages with the segment that holds them, specs that overlap another): specs (doc, segment, first, last), inclusive."""
    met = pages.join(specs.withColumnRenamed(doc, "_d"), (F.col(doc) == F.col("_d")) & F.col(page).between(F.col("first"), F.col("last"))).drop("_d")
    by = Window.partitionBy(doc).orderBy("first", "last", "segment")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("first").over(by.rowsBetween(1, Window.unboundedFollowing))
    clash = specs.withColumn("_b", before).withColumn("_a", after).where((F.col("_b") >= F.col("first")) | (F.col("_a") <= F.col("last"))).drop("_a", "_b")
    return met, clash


def clause_rows(lines: DataFrame, segment: str, page: str, text: str, edition: str, keep: list[str] | None = None) -> DataFrame:
    """Heading lines as clauses: lines (segment, page, text and the columns to keep) with path, slug and clause id; other lines are dropped."""
    rows = lines.withColumn("_a", article_path(F.col(text))).where("_a IS NOT NULL")
    return rows.select(*(keep or []), segment, page, F.col("_a.printed").alias("path"), F.col("_a.slug").alias("slug"), clause_id(F.col(segment), F.col("_a.slug"), F.col(page), F.lit(edition)).alias("clause"))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def fingerprint(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, sha256): the hash of a document's pages in order, composed and without white space."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda x: x[text]), "")
    return pages.groupBy(doc).agg(whole.alias("_t")).select(doc, F.sha2(squeeze(_nfc("_t")), 256).alias("sha256"))


def reproduction_status(archived: Column, recorded: Column, quotes_missing: Column, derived: Column) -> Column:
    """missing, hash_mismatch, quote_mismatch, then by the states of the derived outputs (ARRAY, NULL without a record): derived_unverified, derived_mismatch or reproduced."""
    verdict = F.when(derived.isNull() | (F.size(derived) == 0), "derived_unverified").when(F.array_contains(derived, "record_error"), "derived_record_invalid").when(F.array_contains(derived, "differs"), "derived_mismatch").when(F.exists(derived, lambda s: s != "byte_identical"), "derived_unverified").otherwise("reproduced")
    return F.when(archived.isNull(), "missing").when(archived != recorded, "hash_mismatch").when(quotes_missing > 0, "quote_mismatch").otherwise(verdict)


def dedupe_work(observations: DataFrame, on: tuple[str, ...] = ("source_id", "content_hash", "parser_version")) -> DataFrame:
    """The work that observations ask for, once for each source, content and parser, with how many asked; the observations stay."""
    return observations.groupBy(*on).agg(F.count("*").alias("asked"))


#: Extractors and adapters by (name, version): functions for mapInPandas that a user registers.
REGISTRY: dict[tuple[str, str], tuple[Callable, str]] = {}


def register(name: str, version: str, schema: str):
    """Register a function over batches under a name and version; a version is never replaced."""

    def add(f):
        if (name, version) in REGISTRY:
            raise ValueError(f"{name} {version} is registered already")
        REGISTRY[name, version] = (f, schema)
        return f

    return add


def extract(rows: DataFrame, name: str, version: str) -> DataFrame:
    """The rows that a registered function makes, with the version that made them."""
    f, schema = REGISTRY[name, version]
    return rows.mapInPandas(f, schema).withColumn("extractor_version", F.lit(version))


@register("price_lines", "1", "doc long, line int, name string, conditions string, amount string, period string, page string")
def price_lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of `name|conditions|amount|period|page` lines of (doc, text); blanks and lines that begin with # are skipped."""
    for part in parts:
        out = []
        for doc, text in zip(part["doc"], part["text"], strict=True):
            for n, line in enumerate((text or "").split("\n"), 1):
                cells = [c.strip() for c in line.split("|")]
                if line.strip() and not line.lstrip().startswith("#") and len(cells) == 5:
                    out.append((doc, n, *cells))
        yield pd.DataFrame(out, columns=["doc", "line", "name", "conditions", "amount", "period", "page"])
