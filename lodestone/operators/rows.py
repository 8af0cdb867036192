"""Row checks: every function gives the violations of a row as an array of names, so one pass yields clean rows and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reference kinds, what each role may cite, signatures, media types and words of pages that are no documents.
REFS = "seg|clause|ted|premium|assertion|rule|obs|raw|eval|crit"
MIMES = {"pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
MAGIC = {"pdf": "255044462D", "doc": "D0CF11E0A1B11AE1", "docx": "504B0304"}
GENERIC = ("", "application/octet-stream", "binary/octet-stream")
HTML = ("<!doctype html", "<html", "<head", "<body", "<form", "<title", "<script")
CHALLENGE = ("captcha", "verify you are human", "unusual traffic")
LOGIN = ("login required", "please log in", "sign in to continue", 'type="password"', "type='password'", "로그인이 필요", "로그인 후")
ERROR = ("access denied", "not found", "internal server error", "service unavailable", "서비스 점검", "오류가 발생", "접근이 차단")


def broken(**bad: Column) -> Column:
    """The names whose condition holds, in the order given; an undecided condition does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in bad.items()]))


def empty(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def assertion_rows() -> Column:
    """Columns status, decision, origin, object, value."""
    accepted = F.col("status") == "accepted"
    return broken(accepted_needs_decision=accepted & F.col("decision").isNull(), fixture_never_accepted=accepted & (F.col("origin") == "fixture"), object_xor_value=F.col("object").isNull() == F.col("value").isNull())


def premium_rows() -> Column:
    """Columns status, decision, origin, eligible, conditions MAP, binding, as_of, missing ARRAY."""
    accepted = F.col("status") == "accepted"
    bare = (F.coalesce(F.size("conditions"), F.lit(0)) <= 0) | F.col("binding").isNull() | F.col("as_of").isNull() | (F.coalesce(F.size("missing"), F.lit(0)) > 0)
    return broken(accepted_needs_decision=accepted & F.col("decision").isNull(), fixture_never_accepted=accepted & (F.col("origin") == "fixture"), eligible_needs_fields=F.col("eligible") & bare, eligible_needs_acceptance=F.col("eligible") & ~F.coalesce(accepted, F.lit(False)))


def premium_constraints() -> Column:
    """The same rows as the store constrains them: conditions there, and missing saying exactly what is."""
    says = lambda name: F.coalesce(F.array_contains("missing", name), F.lit(False))
    whole = (F.coalesce(F.size("conditions"), F.lit(0)) > 0) & F.col("binding").isNotNull() & F.col("as_of").isNotNull() & (F.size("missing") == 0) & (F.col("status") == "accepted")
    return broken(conditions_required=F.coalesce(F.size("conditions"), F.lit(0)) <= 0, missing_has_null=F.exists("missing", lambda x: x.isNull()), missing_package=F.col("binding").isNull() != says("package_binding"), missing_as_of=F.col("as_of").isNull() != says("as_of"), raw_vs_eligible=F.col("eligible") & ~F.coalesce(whole, F.lit(False)))


def amount_rows(kind: Column, krw: Column, lo: Column, hi: Column) -> Column:
    k, a, b = krw.isNotNull(), lo.isNotNull(), hi.isNotNull()
    ok = F.when(kind == "exact", k & ~a & ~b).when(kind == "range", ~k & a & b & (lo <= hi)).when(kind == "unknown", ~k & ~a & ~b)
    return broken(amount_fields_match_kind=kind.isNotNull() & ~F.coalesce(ok, F.lit(False)))


def evaluation_rows() -> Column:
    """Columns eligibility, payout, amount and conditional STRUCT<kind, krw, lo, hi>, issues ARRAY, effect_kind, effect, conditional_effect."""
    e, p, kind = F.col("eligibility"), F.col("payout"), F.col("effect_kind")
    want = F.when(e == "true", "payable").when(e == "false", "not_payable").otherwise("undetermined")
    has, has_if = F.col("amount").isNotNull(), F.col("conditional").isNotNull()
    fields = (has != (p == "payable")) | (has_if != (p == "undetermined"))
    paid = F.coalesce("amount.kind", "conditional.kind")
    effect = (F.col("effect").isNotNull() != (kind == "applies")) | (F.col("conditional_effect").isNotNull() != (kind == "undetermined"))
    known = kind.isin("none", "applies", "undetermined")
    allowed = (kind == "none") | ((e == "true") & (kind == "applies")) | ((e == "unknown") & (kind == "undetermined"))
    amounts = F.concat(*[amount_rows(F.col(f"{c}.kind"), F.col(f"{c}.krw"), F.col(f"{c}.lo"), F.col(f"{c}.hi")) for c in ("amount", "conditional")])
    shape = broken(payout_matches_eligibility=p != want, payout_fields_match_kind=fields)
    return F.concat(shape, amounts, broken(issue_means_unknown_amount=(F.size("issues") > 0) & ~F.coalesce(paid == "unknown", F.lit(False)), effect_kind_known=kind.isNotNull() & ~known, effect_fields_match_kind=known & effect, effect_matches_eligibility=known & ~allowed))


def scenario_rows() -> Column:
    """Columns blocked_by ARRAY, evaluated, explained, issues ARRAY, display."""
    return broken(blocked_means_no_call=(F.size("blocked_by") > 0) & (F.col("evaluated") | F.col("explained")), issue_means_hold=F.col("evaluated") & (F.size("issues") > 0) & ~F.coalesce(F.col("display") == "hold", F.lit(False)))


def evidence_valid(evidence: Column, roles: tuple[str, ...]) -> Column:
    """At least one item, each of a known role with a well-formed reference; basis and cross_check cite clauses, observation what was observed."""
    ref = lambda e: e["ref"].rlike(rf"\A({REFS}):\S+\z")
    fits = lambda e: ~(e["role"].isin("basis", "cross_check") & ~e["ref"].startswith("clause:")) & ~((e["role"] == "observation") & ~e["ref"].rlike(r"\A(obs|seg|raw|clause):"))
    return F.coalesce((F.size(evidence) > 0) & F.forall(evidence, lambda e: e["role"].isin(*roles) & ref(e) & fits(e)), F.lit(False))


def edition_parts_valid(parts: Column) -> Column:
    """At least one part, each with a role and a lower-case SHA-256 under a rule."""
    return F.coalesce((F.size(parts) > 0) & F.forall(parts, lambda p: p["role"].rlike(r"\A[a-z][a-z0-9_]*\z") & p["rule"].isNotNull() & p["sha256"].rlike(r"\A[0-9a-f]{64}\z")), F.lit(False))


def review_decisions() -> Column:
    """Columns families ARRAY, result, checks_passed, counterexamples, conflict."""
    two = F.size(F.array_distinct(F.filter("families", lambda x: x.isNotNull() & (x != "")))) >= 2
    sound = F.col("checks_passed") & (F.col("counterexamples") == 0) & ~F.col("conflict")
    return broken(two_families=~F.coalesce(two, F.lit(False)), accepted_needs_sound_checks=(F.col("result") == "accepted") & ~F.coalesce(sound, F.lit(False)))


def json_items(items: Column, needs: tuple[str, ...], codes: dict[str, tuple[str, ...]]) -> Column:
    """Whether every item, a MAP, has the fields and, where codes are given, one of them."""
    has = lambda e: F.forall(F.array(*map(F.lit, needs)), lambda n: F.map_contains_key(e, n))

    def ok(e):
        out = has(e)
        for field, of in codes.items():
            out = out & F.coalesce(F.try_element_at(e, F.lit(field)).isin(*of), F.lit(False))
        return out

    return F.coalesce(F.forall(items, ok), F.lit(False))


def table_rows(version: str = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z", states: tuple[str, ...] = ("ok", "needs_review")) -> Column:
    """Columns sha256, page, status, version, valid_from, valid_to, reason: no evidence, no row."""
    return broken(no_evidence=~F.coalesce(F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)), no_page=~F.coalesce((F.col("page").try_cast("int") > 0) | (F.col("page").try_cast("int").isNull() & (F.trim("page") != "")), F.lit(False)), bad_status=~F.coalesce(F.col("status").isin(*states), F.lit(False)), bad_version=~F.coalesce(F.col("version").rlike(version), F.lit(False)), no_reason=(empty(F.col("valid_from")) | empty(F.col("valid_to"))) & empty(F.trim("reason")))


def service_view(rows: DataFrame, violations: Column) -> DataFrame:
    """The rows without violations."""
    return rows.where(F.size(violations) == 0)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def admit_document(body: Column, mime: Column, declared: str, size: Column | None = None, cap: int = 64 << 20) -> Column:
    """Why a body is not the document declared (pdf, doc, docx), or NULL; only its first 8,192 bytes are looked at.

    Order: unsupported, too large, empty, length, then for bodies without the signature a challenge,
    login, error or other page, the media type, and the signature.
    """
    kind = next((k for k, m in MIMES.items() if declared in (k, m)), None)
    if kind is None:
        return F.lit("unsupported_type")
    body = body.cast("binary")
    n = F.octet_length(body)
    head = F.substring(body, 1, 8192)
    signed = F.hex(head).startswith(MAGIC[kind])
    text = F.lower(head.cast("string"))
    mime = F.lower(F.trim(F.split_part(F.coalesce(mime, F.lit("")), F.lit(";"), F.lit(1))))
    page = ~signed & (mime.isin("text/html", "application/xhtml+xml") | _any(text, HTML))
    why = F.when(F.greatest(n, F.coalesce(size, n) if size is not None else n) > cap, "too_large").when(F.coalesce(n, F.lit(0)) == 0, "empty")
    if size is not None:
        why = why.when(size.isNotNull() & (size != n), "length_mismatch")
    for words, name in ((CHALLENGE, "challenge_html"), (LOGIN, "login_html"), (ERROR, "error_html")):
        why = why.when(page & _any(text, words), name)
    return why.when(page, "unexpected_html").when(~mime.isin(MIMES[kind], *GENERIC), "mime_mismatch").when(~signed, "magic_mismatch")


def format_failure(expected: Column, mime: Column, body: Column) -> Column:
    """empty, declared_type_mismatch, wrong_magic or not_parseable; NULL when the body is what was expected."""
    text = F.coalesce(body, F.lit(""))
    # as the one element of an array, so that nothing may follow it
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    parses = inside.isNotNull() & F.try_variant_get(inside, "$[0]", "variant").isNotNull() & F.try_variant_get(inside, "$[1]", "variant").isNull()
    return F.when(text == "", "empty").when((expected != "html") & F.startswith(F.lower(mime), F.lit("text/html")), "declared_type_mismatch").when((expected == "pdf") & ~text.startswith("%PDF-"), "wrong_magic").when((expected == "html") & ~text.rlike(r"(?s)\A[ \t\n\f\r]*<"), "wrong_magic").when((expected == "json") & ~parses, "not_parseable")


def ids_valid(ref: Column) -> Column:
    """A reference of a known kind; a segment's pages in order, and a clause's page inside its segment."""
    page = lambda pattern, i: F.regexp_extract(ref, pattern, i).try_cast("int")
    seg = r":p([0-9]+)-([0-9]+):[a-z_]+:[a-z][a-z0-9.-]*"
    kind = F.split_part(ref, F.lit(":"), F.lit(1))
    segment = ref.rlike(rf"\Aseg:[0-9a-f]{{12}}{seg}\z") & (page(seg, 1) >= 1) & (page(seg, 1) <= page(seg, 2))
    tail = rf"{seg}/[^#\s]+#p([0-9]+):\S+\z"
    clause = ref.rlike(rf"\Aclause:seg:[0-9a-f]{{12}}{tail}") & (page(tail, 1) <= page(tail, 3)) & (page(tail, 3) <= page(tail, 2))
    other = ref.rlike(rf"\A({REFS}):\S+\z")
    return F.coalesce(F.when(kind == "seg", segment).when(kind == "clause", clause).otherwise(other), F.lit(False))


def field_rows(axes: tuple[str, ...]) -> Column:
    """Columns axis, refs ARRAY, status, hold_reason, value_state, unknown_reason, normalized."""
    return broken(bad_axis=~F.coalesce(F.col("axis").isin(*axes), F.lit(False)), no_evidence=F.coalesce(F.size("refs"), F.lit(0)) <= 0, hold_needs_reason=F.coalesce(F.col("status") == "hold", F.lit(False)) == empty(F.col("hold_reason")), unknown_needs_reason=F.col("value_state").isin("unknown", "not_stated") & empty(F.col("unknown_reason")), observed_needs_value=F.col("value_state").isin("observed", "derived") & F.col("normalized").isNull())


def price_rows() -> Column:
    """Columns amount, unavailable, value_state, derivation, basis, conditions MAP, missing ARRAY, cycle."""
    stated = lambda d: F.coalesce(F.map_contains_key("conditions", d), F.lit(False)) | F.coalesce(F.array_contains("missing", d), F.lit(False))
    return broken(no_amount_needs_reason=F.col("amount").isNull() & empty(F.col("unavailable")), amount_not_positive=F.col("amount") <= 0, derived_needs_derivation=(F.col("amount") > 0) & (F.col("value_state") == "derived") & empty(F.col("derivation")), no_basis=empty(F.col("basis")), age_open=~stated("age"), sex_open=~stated("sex"), bad_cycle=F.col("cycle").isNotNull() & ~F.col("cycle").isin("monthly", "annual", "single"))


def criteria_rows(parse) -> Column:
    """Columns id, criterion, version, scope ARRAY, effective, recorded, sources ARRAY<STRING>; parse (date, instant) are the text functions."""
    date, instant = parse
    kinds = F.forall("sources", lambda s: s.rlike(r"\A(raw|clause|obs):\S+\z"))
    return broken(id_not_versioned=F.col("id") != F.concat("criterion", F.lit("@"), F.col("version").cast("string")), bad_criterion=~F.coalesce(F.col("criterion").rlike(r"\Acrit:[a-z0-9][a-z0-9_.-]*\z"), F.lit(False)), empty_scope=F.coalesce(F.size("scope"), F.lit(0)) <= 0, bad_date=F.col("effective").isNotNull() & date(F.col("effective")).isNull(), bad_instant=~instant(F.col("recorded")), no_source=F.coalesce(F.size("sources"), F.lit(0)) <= 0, bad_source=~F.coalesce(kinds, F.lit(True)), repeated_source=F.size(F.array_distinct("sources")) < F.size("sources"))


def search(rows: DataFrame, key: str, after=None, size: int = 20, **equal) -> DataFrame:
    """A page of rows in key order after a cursor that equal the values given; what has not been acquired stays in the list."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)
