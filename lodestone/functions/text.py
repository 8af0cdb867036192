"""Scalar functions on codes, dates, money texts, links, ids and hashes, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of private ids; query names that hold a session on every host, and further ones on some.
PRIVATE = ("contract", "person", "upload", "del", "consent", "assume")
SESSION_PARAMS = ("jsessionid", "sessionid", "phpsessid")
HOST_PARAMS = {"kbinsure.co.kr": ("_t",)}
#: How money, units and forbidden notations of money are written.
MONEY = r"(\d[\d,]*(?:\.\d+)?)\s*(만\s*원|원)"
UNITS = r"(\d[\d,.]*)\s*(%|개월|시간|일|년|세|회|종)"
FORBIDDEN = {
    "currency_sign": r"(?i)₩|\\|KRW",
    "large_unit": r"\d\s*억|\d\s*천\s*원|\d\s*천만",
    "spelt_number": r"[일이삼사오육칠팔구십백천]+\s*만\s*원|[일이삼사오육칠팔구십백천]+\s*원(?![가-힣])",
    "bare_unit": r"\d\s*만(?!\s*원)(?=[\s·,)]|$)",
}


def parse_date(text: Column) -> Column:
    """Exactly YYYY-MM-DD, a real day of 1900-2199; else NULL."""
    d = F.try_to_date(F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), text), "yyyy-MM-dd")
    return F.when(F.year(d).between(1900, 2199), d)


def parse_rate(text: Column) -> Column:
    """STRUCT<num, den> of a plain decimal of at most nine digits each side; else NULL."""
    ok = text.rlike(r"\A\d{1,9}(\.\d{1,9})?\z")
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    return F.when(ok, F.struct(F.concat(whole, part).cast("bigint").alias("num"), F.rpad(F.lit("1"), (F.length(part) + 1).cast("int"), F.lit("0")).cast("bigint").alias("den")))


def parse_code(text: Column) -> Column:
    """STRUCT<letter, major, minor> of a code such as C50 or C50.1; else NULL."""
    got = lambda i: F.regexp_extract(text, r"\A([A-Z])([0-9]{2})(?:\.([0-9]+))?\z", i)
    return F.when(text.rlike(r"\A[A-Z][0-9]{2}(\.[0-9]+)?\z"), F.struct(got(1).alias("letter"), got(2).cast("int").alias("major"), F.nullif(got(3), F.lit("")).alias("minor")))


def is_rfc3339(text: Column) -> Column:
    shape = text.rlike(r"\A\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z")
    real = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()
    clock = F.substring(text, 12, 2).try_cast("int").between(0, 23) & F.substring(text, 15, 2).try_cast("int").between(0, 59) & F.substring(text, 18, 2).try_cast("int").between(0, 59)
    zone = F.regexp_extract(text, r"[+-](\d{2}):(\d{2})\z", 1), F.regexp_extract(text, r"[+-](\d{2}):(\d{2})\z", 2)
    return F.coalesce(shape & real & clock & ((zone[0] == "") | (zone[0].try_cast("int").between(0, 23) & zone[1].try_cast("int").between(0, 59))), F.lit(False))


def has_private_id(text: Column, prefixes=PRIVATE) -> Column:
    """Whether a private id's prefix stands at a token boundary anywhere in the text, in any case."""
    return text.rlike(rf"(?i)(^|[^a-z0-9_])({'|'.join(prefixes)}):")


def squeeze(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def format_krw(amount: Column) -> Column:
    """Whole ten-thousands as such, other amounts in single units, both with separators and their unit."""
    tens = (amount != 0) & (amount % 10000 == 0)
    return F.when(tens, F.concat(F.format_number(F.call_function("div", amount, F.lit(10000)), 0), F.lit("만원"))).otherwise(F.concat(F.format_number(amount, 0), F.lit("원")))


def man_display(amount: Column) -> Column:
    """A month's amount in ten-thousands with one decimal, half away from zero."""
    tenths = F.call_function("div", F.abs(amount) + 500, F.lit(1000))
    return F.concat(F.lit("월 "), F.when((amount < 0) & (tenths > 0), "-").otherwise(""), F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("만"))


def money_tokens(text: Column) -> Column:
    """The amounts written with a unit, in single units, ascending."""
    numbers, units = (F.regexp_extract_all(text, F.lit(MONEY), F.lit(i)) for i in (1, 2))
    value = lambda n, unit: F.floor(F.replace(n, F.lit(",")).try_cast("decimal(28,8)") * F.when(unit.startswith("만"), 10000).otherwise(1)).cast("bigint")
    return F.array_sort(F.zip_with(numbers, units, value))


def unit_tokens(text: Column) -> Column:
    """Numbers with their units, in order, without the space between."""
    return F.zip_with(F.regexp_extract_all(text, F.lit(UNITS), F.lit(1)), F.regexp_extract_all(text, F.lit(UNITS), F.lit(2)), lambda n, unit: F.concat(n, unit))


def forbidden_money(text: Column) -> Column:
    """The names of the notations of money that a text must not use."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in FORBIDDEN.items()]))


def clean_link(url: Column, host: Column | None = None, params=SESSION_PARAMS, host_params=HOST_PARAMS) -> Column:
    """The URL without session parameters; those that are volatile on some hosts go where the link's host, or else the page's, is one.

    Kept parameters are written anew as form data; parameters without `=` count as nothing, empty values stay.
    """
    bare = F.regexp_replace(url, r"(?i);jsessionid=[^?#]*", "")
    rest, mark = F.regexp_extract(bare, r"(?s)\A([^#]*)", 1), F.regexp_extract(bare, r"(?s)\A[^#]*#(.+)\z", 1)
    base, query = F.regexp_extract(rest, r"(?s)\A([^?]*)", 1), F.regexp_extract(rest, r"(?s)\A[^?]*\?(.*)\z", 1)
    own = F.regexp_extract(bare, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    where = F.lower(F.when(own != "", own).otherwise(host if host is not None else F.lit("")))
    where = F.split_part(F.substring_index(where, "@", -1), F.lit(":"), F.lit(1))
    plain = lambda v: F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%20"))), v)
    form = lambda v: F.replace(F.replace(F.url_encode(plain(v)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    key, value = lambda p: F.split_part(p, F.lit("="), F.lit(1)), lambda p: F.regexp_extract(p, r"(?s)\A[^=]*=(.*)\z", 1)
    volatile = lambda k: reduce(lambda a, b: a | b, [((where == h) | where.endswith("." + h)) & k.isin(*names) for h, names in host_params.items()], k.isin(*params))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~volatile(F.lower(plain(key(p)))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(form(key(p)), F.lit("="), form(value(p)))), "&")
    return F.concat(base, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), F.when(mark == "", "").otherwise(F.concat(F.lit("#"), mark)))


def article_path(line: Column) -> Column:
    """STRUCT<printed, slug> of the heading that a line begins with, before a bracket or the line's end; NULL if it begins with none."""
    pattern = r"\A(제\s*(\d+)\s*조(?:\s*의\s*(\d+))?|Article\s+(\d+))(?=\s*(?:\(|$))"
    part = lambda i: F.regexp_extract(line, pattern, i)
    number = F.when(part(2) != "", part(2)).otherwise(part(4))
    return F.when(part(1) != "", F.struct(part(1).alias("printed"), F.concat(F.lit("article-"), number, F.when(part(3) != "", F.concat(F.lit("-"), part(3))).otherwise("")).alias("slug")))


def segment_id(digest: Column, start: Column, end: Column, role: Column, rule: Column) -> Column:
    return F.concat(F.lit("seg:"), F.substring(digest, 1, 12), F.lit(":p"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), role, F.lit(":"), rule)


def clause_id(segment: Column, slug: Column, page: Column, edition: Column) -> Column:
    return F.concat(F.lit("clause:"), segment, F.lit("/"), slug, F.lit("#p"), page.cast("string"), F.lit(":"), edition)


def object_key(digest: Column) -> Column:
    return F.concat(F.lit("objects/sha256/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest)


def observation_key(source: Column, at: Column, digest: Column) -> Column:
    """at: the observation's RFC 3339 time, of which digits, T and Z stay."""
    return F.concat(F.lit("observations/"), source, F.lit("/"), F.regexp_replace(at, "[^0-9TZ]", ""), F.lit("_"), F.substring(digest, 1, 16), F.lit(".json"))


def host_access(raw: Column, codes: tuple[str, ...], aliases: dict[str, str]) -> Column:
    """The code of an access result: itself, or the last hop of `A -> B (url)` by code, alias or HTTP status; NULL if none fits."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    final = F.trim(F.regexp_replace(F.trim(F.element_at(F.split(text, "->"), -1)), r"(?s)\s*\(.*\)$", ""))
    alias = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    known = F.when(text == "", "not_checked").when(text.isin(*codes), text).when(final.isin(*codes), final)
    http = F.when(final.isin("200", "301", "302", "307"), "reachable").when(final == "403", "origin_denied").when(final == "429", "rate_limited").when(final.isin("502", "503", "504"), "proxy_error")
    return F.coalesce(known, *([F.try_element_at(alias, final)] if alias is not None else []), http)


def entry_reachable(url: Column, access: Column) -> Column:
    return (F.trim(F.coalesce(url, F.lit(""))) != "") & F.coalesce(access == "reachable", F.lit(False))


def disclosure_status(url: Column, access: Column, home: Column, maps_to: dict[str, str]) -> Column:
    """STRUCT<status, reason> of a disclosure room: reason is a code, or the home page's access."""
    home = F.coalesce(home, F.lit("not_checked"))
    to = F.try_element_at(F.create_map(*[F.lit(x) for kv in maps_to.items() for x in kv]), home)
    row = lambda s, r: F.struct((s if isinstance(s, Column) else F.lit(s)).alias("status"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return F.when(entry_reachable(url, access), row("unqueried", "entry_reachable")).when(home.isin("reachable", "js_shell"), row("failed", "entry_not_found")).when(to == "unqueried", row("unqueried", "not_queried")).otherwise(row(to, F.concat(F.lit("home:"), home)))


def product_list_codes(status: Column, codes: Column, url: Column, access: Column, home: Column) -> Column:
    """Why a product list has not been enumerated, joined by semicolons; the stored codes once it has a status."""
    blocked = F.coalesce(home == "geo_blocked", F.lit(False)) | F.coalesce(access == "geo_blocked", F.lit(False))
    why = F.array_compact(F.array(F.lit("awaiting_T-DT-04"), F.lit("awaiting_domestic_env"), F.when(~entry_reachable(url, access), "disclosure_entry_missing"), F.when(blocked, "foreign_sandbox_geo_blocked")))
    return F.when(status == "unqueried", F.array_join(why, ";")).otherwise(F.coalesce(codes, F.lit("")))


def content_hash(**columns: Column) -> Column:
    """SHA-256 over (name, value) pairs in name order, separated by control characters; NULL differs from every text."""
    parts = [F.concat(F.lit(f"{k}\u001f"), F.coalesce(v.cast("string"), F.lit("\u0000"))) for k, v in sorted(columns.items())]
    return F.sha2(F.concat_ws("\u001e", *parts), 256)


def json_texts(document: Column) -> Column:
    """Every string and key that a JSON text holds, quotes taken off and simple escapes undone, in order."""
    found = F.regexp_extract_all(document, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.transform(found, lambda s: F.replace(F.replace(F.replace(s, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\")))


def model_ref_hash(model_ref: Column) -> Column:
    """The hash of a model's reference; a call that failed before it named one has that of the empty text."""
    return F.sha2(F.coalesce(model_ref, F.lit("")), 256)
