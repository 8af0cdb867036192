"""Rule functions: Columns over values that may be unknown or in error.

A value is `Val(value, missing, error)`: a NULL value with an empty error is unknown because of the
named missing inputs; a non-NULL error tells why no value exists.  Amounts are inclusive ranges
(lo, hi) in whole units.  Everything is a built-in expression, safe under ANSI mode.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def none() -> Column:
    return F.lit(None).cast("string")


def no_causes() -> Column:
    return F.expr("cast(array() as array<string>)")


@dataclass
class Val:
    """A three-valued boolean, a date, a count or a text, with what it lacks."""

    value: Column
    missing: Column
    error: Column


@dataclass
class Amount:
    """An inclusive range of whole money, with what it lacks and the issues of getting it."""

    lo: Column
    hi: Column
    missing: Column
    issues: Column
    error: Column


def union(*arrays: Column) -> Column:
    return F.array_sort(reduce(F.array_union, arrays))


def lit(value) -> Val:
    return Val(F.lit(value), no_causes(), none())


def krw(value) -> Amount:
    v = F.lit(value).cast("bigint")
    return Amount(v, v, no_causes(), no_causes(), none())


def given(column: str, kind: str, name: str | None = None) -> Val:
    """An input: NULL is unknown and blamed on its name; a text that is not of the kind is an error."""
    raw = F.col(column)
    value = raw.try_cast(kind)
    return Val(value, F.when(raw.isNull(), F.array(F.lit(name or column))).otherwise(no_causes()), F.when(raw.isNotNull() & value.isNull(), F.lit("wrong_type")).otherwise(none()))


def given_amount(column: str, name: str | None = None) -> Amount:
    v = given(column, "bigint", name)
    return Amount(v.value, v.value, v.missing, no_causes(), F.coalesce(v.error, F.when(v.value < 0, F.lit("negative_amount"))))


def _decide(children: tuple[Val, ...], decisive: bool) -> Val:
    hit = reduce(lambda a, b: a | b, [F.coalesce(c.value == decisive, F.lit(False)) for c in children])
    error = F.coalesce(*[c.error for c in children])
    unknown = reduce(lambda a, b: a | b, [c.value.isNull() for c in children])
    value = F.when(hit, F.lit(decisive)).when(error.isNotNull() | unknown, F.lit(None).cast("boolean")).otherwise(F.lit(not decisive))
    blame = F.when(~hit & error.isNull() & unknown, union(*[F.when(c.value.isNull(), c.missing).otherwise(no_causes()) for c in children])).otherwise(no_causes())
    return Val(value, blame, F.when(hit, none()).otherwise(error))


def all_of(*children: Val) -> Val:
    """False as soon as one child is false, whatever the others; else the first error; else unknown; else true."""
    return _decide(children, False)


def any_of(*children: Val) -> Val:
    return _decide(children, True)


def negate(v: Val) -> Val:
    return Val(~v.value, v.missing, v.error)


def compare(op: str, a: Val, b: Val) -> Val:
    """eq ne lt lte gt gte; unknown with the causes of both if either is unknown."""
    value = {"eq": a.value == b.value, "ne": a.value != b.value, "lt": a.value < b.value, "lte": a.value <= b.value, "gt": a.value > b.value, "gte": a.value >= b.value}[op]
    error = F.coalesce(a.error, b.error)
    return Val(F.when(error.isNull(), value), F.when(error.isNull() & value.isNull(), union(a.missing, b.missing)).otherwise(no_causes()), error)


def exact(a: Amount) -> Val:
    """An amount as a value to compare; a true range has no order, so comparing it is an error."""
    return Val(F.when(a.lo == a.hi, a.lo), a.missing, F.coalesce(a.error, F.when(a.lo != a.hi, F.lit("range_compared"))))


def compare_rates(op: str, a_num: Column, a_den: Column, b_num: Column, b_den: Column) -> Column:
    """Two fractions of positive denominators by their cross products, exactly."""
    wide = lambda x: x.cast("decimal(19,0)")
    x, y = wide(a_num) * wide(b_den), wide(b_num) * wide(a_den)
    return {"eq": x == y, "ne": x != y, "lt": x < y, "lte": x <= y, "gt": x > y, "gte": x >= y}[op]


def choose(cond: Val, then: Val, other: Val) -> Val:
    """The branch of a known condition; of an unknown one the common value of both branches, else unknown with all causes."""
    same = cond.value.isNull() & cond.error.isNull() & then.error.isNull() & other.error.isNull() & (then.value == other.value)
    both_fail = then.error.isNotNull() & other.error.isNotNull()
    value = F.when(cond.error.isNotNull(), F.lit(None)).when(cond.value, then.value).when(~cond.value, other.value).when(same, then.value)
    error = F.when(cond.error.isNotNull(), cond.error).when(cond.value, then.error).when(~cond.value, other.error).when(both_fail, then.error)
    blame = F.when(error.isNotNull() | value.isNotNull(), no_causes()).when(cond.value, then.missing).when(~cond.value, other.missing).otherwise(union(cond.missing, then.missing, other.missing))
    return Val(value, blame, error)


def keep(df: DataFrame, name: str, v: Val | Amount) -> tuple[DataFrame, Val | Amount]:
    """df with the parts of a step as columns of that name, and the step as a reference to them.

    A rule of many steps keeps each, so that the next one names its operands instead of repeating them
    and the plan grows with the rule's length.
    """
    parts = {f.name: f"{name}__{f.name}" for f in fields(v)}
    df = df.withColumns({column: getattr(v, k) for k, column in parts.items()})
    return df, type(v)(**{k: F.col(column) for k, column in parts.items()})


def _ranged(lo: Column, hi: Column, parts: list, issue: Column | None = None, domain: Column | None = None) -> Amount:
    """The amount lo..hi of known operands.  An operand's error comes first; `issue` then makes it unknown; a domain error counts when all are known."""
    error = F.coalesce(*[p.error for p in parts])
    known = reduce(lambda a, b: a & b, [(p.lo if isinstance(p, Amount) else p.value).isNotNull() for p in parts])
    if domain is not None:
        error = F.coalesce(error, F.when(known, domain))
    stopped = F.lit(False) if issue is None else issue.isNotNull()
    error = F.coalesce(error, F.when(known & ~stopped & (lo.isNull() | hi.isNull()), F.lit("overflow")))
    unknown = error.isNull() & (~known | stopped)
    null = F.lit(None).cast("bigint")
    live = error.isNull() & ~unknown
    missing = F.when(unknown & ~stopped, union(*[p.missing for p in parts])).otherwise(no_causes())
    causes = [p.issues for p in parts if isinstance(p, Amount)]
    issues = F.when(unknown & stopped, F.array(issue)).when(unknown, union(*causes)).otherwise(no_causes()) if issue is not None else F.when(unknown, union(*causes)).otherwise(no_causes())
    return Amount(F.when(live, lo).otherwise(null), F.when(live, hi).otherwise(null), missing, issues, error)


def rounded(x: Column, num: Column, den: Column, mode: str, unit: int) -> tuple[Column, Column]:
    """x * num / den to a whole multiple of the unit, as (lo, hi); NULL beyond BIGINT.

    Whole 64-bit numbers where the product fits them, DECIMAL(38,0) otherwise.
    """

    def pick(q, r, d, one):
        up = q + F.when(r > 0, one).otherwise(one - one)
        half_up = q + F.when(r >= d - r, one).otherwise(one - one)
        half_even = q + F.when((r > d - r) | ((r == d - r) & (q % 2 == 1)), one).otherwise(one - one)
        return {"floor": (q, q), "ceil": (up, up), "half_up": (half_up, half_up), "half_even": (half_even, half_even), "unspecified": (q, up)}[mode]

    d = F.when(den > 0, F.try_multiply(den.cast("bigint"), F.lit(unit).cast("bigint")))
    p = F.try_multiply(x, num.cast("bigint"))
    small = pick(F.call_function("div", p, d), p % d, d, F.lit(1).cast("bigint"))
    wd = F.when(den > 0, (den.cast("decimal(19,0)") * F.lit(unit).cast("decimal(4,0)")).cast(WIDE))
    wp = (x.cast("decimal(19,0)") * num.cast("decimal(18,0)")).cast(WIDE)
    rest = wp % wd
    wide = pick(F.try_divide(wp - rest, wd).cast(WIDE), rest, wd, F.lit(1).cast("decimal(1,0)"))
    back = lambda s, w: F.try_multiply(F.coalesce(s, w.cast(WIDE).try_cast("bigint")), F.lit(unit).cast("bigint"))
    lo = back(small[0], wide[0])
    return lo, (lo if mode != "unspecified" else back(small[1], wide[1]))


def _scaled(a: Amount, num: Column, den: Column, mode: str, unit: int) -> tuple[Column, Column]:
    lo, up = rounded(a.lo, num, den, mode, unit)
    return lo, (up if a.hi is a.lo else rounded(a.hi, num, den, mode, unit)[1])


def multiply_rate(a: Amount, num: int, den: int, mode: str = "floor", unit: int = 1) -> Amount:
    return _ranged(*_scaled(a, F.lit(num).cast("bigint"), F.lit(den).cast("bigint"), mode, unit), [a])


def pro_rata(a: Amount, part: Val, whole: Val, mode: str = "floor", unit: int = 1) -> Amount:
    """amount * part / whole.

    Of known operands a negative part or whole is an error, then a whole of 0 an issue, then a part over
    the whole an error.  A known whole of 0 is the issue whatever else is unknown.
    """
    negative = (part.value < 0) | (whole.value < 0)
    known = a.lo.isNotNull() & part.value.isNotNull()
    zero = F.when((whole.value == 0) & ~F.coalesce(known & negative, F.lit(False)), F.lit("zero_denominator"))
    bad = F.when(negative | ((whole.value != 0) & (part.value > whole.value)), F.lit("bad_proportion"))
    return _ranged(*_scaled(a, part.value, whole.value, mode, unit), [a, part, whole], zero, bad)


def divide_count(a: Amount, n: Val, mode: str = "floor", unit: int = 1) -> Amount:
    """amount / n; a known 0 is an issue whatever the amount, a negative count of a known amount an error."""
    zero = F.when(n.value == 0, F.lit("zero_denominator"))
    return _ranged(*_scaled(a, F.lit(1).cast("bigint"), n.value, mode, unit), [a, n], zero, F.when(n.value < 0, F.lit("negative_count")))


def multiply_count(a: Amount, n: Val) -> Amount:
    return _ranged(F.try_multiply(a.lo, n.value.cast("bigint")), F.try_multiply(a.hi, n.value.cast("bigint")), [a, n], domain=F.when(n.value < 0, F.lit("negative_count")))


def add(a: Amount, b: Amount) -> Amount:
    return _ranged(F.try_add(a.lo, b.lo), F.try_add(a.hi, b.hi), [a, b])


def least(a: Amount, b: Amount) -> Amount:
    return _ranged(F.least(a.lo, b.lo), F.least(a.hi, b.hi), [a, b])


apply_cap = least


def greatest(a: Amount, b: Amount) -> Amount:
    return _ranged(F.greatest(a.lo, b.lo), F.greatest(a.hi, b.hi), [a, b])


def subtract_floor0(a: Amount, b: Amount) -> Amount:
    zero = F.lit(0).cast("bigint")
    return _ranged(F.greatest(a.lo - b.hi, zero), F.greatest(a.hi - b.lo, zero), [a, b])


def choose_amount(cond: Val, then: Amount, other: Amount) -> Amount:
    same = cond.value.isNull() & cond.error.isNull() & (then.lo == other.lo) & (then.hi == other.hi)
    pick = lambda t, o: F.when(cond.error.isNotNull(), F.lit(None)).when(cond.value, t).when(~cond.value, o).when(same, t)
    error = F.when(cond.error.isNotNull(), cond.error).when(cond.value, then.error).when(~cond.value, other.error).when(then.error.isNotNull() & other.error.isNotNull(), then.error)
    lo = pick(then.lo, other.lo)
    open_ = error.isNull() & lo.isNull()
    blame = F.when(~open_, no_causes()).when(cond.value, then.missing).when(~cond.value, other.missing).otherwise(union(cond.missing, then.missing, other.missing))
    both = (F.size(then.issues) > 0) & (F.size(other.issues) > 0)
    issues = F.when(~open_, no_causes()).when(cond.value, then.issues).when(~cond.value, other.issues).when(both, union(then.issues, other.issues)).otherwise(no_causes())
    return Amount(lo, pick(then.hi, other.hi), blame, issues, error)


def in_calendar(d: Column) -> Column:
    return (F.year(d) >= 1900) & (F.year(d) <= 2199)


def date_add(d: Val, n: int, unit: str) -> Val:
    """n days, months or years later, clamped to the month's end; outside 1900-2199 an error."""
    value = F.date_add(d.value, n) if unit == "day" else F.add_months(d.value, n * (12 if unit == "year" else 1))
    return Val(F.when(in_calendar(value), value), d.missing, F.coalesce(d.error, F.when(~in_calendar(value), F.lit("date_out_of_range"))))


def days_between(a: Val, b: Val, include_start: bool = False, include_end: bool = False) -> Val:
    """Days from a to b; reversed dates are an error."""
    diff = F.datediff(b.value, a.value)
    error = F.coalesce(a.error, b.error, F.when(diff < 0, F.lit("reversed_dates")))
    days = F.greatest(diff - 1 + int(include_start) + int(include_end), F.lit(0)).cast("bigint")
    return Val(F.when(error.isNull(), days), F.when(error.isNull() & days.isNull(), union(a.missing, b.missing)).otherwise(no_causes()), error)


def completed_years(start: Column, at: Column) -> Column:
    k = F.year(at) - F.year(start)
    return F.when(F.add_months(start, 12 * k) <= at, k).otherwise(k - 1)


def anniversary_band(start: Val, at: Val, bands: list[tuple[int, int]], boundary: str = "lower_inclusive") -> Val:
    """The value of the last band (years, value) that the completed years reach; reversed dates are an error."""
    years = completed_years(start.value, at.value)
    exact = F.add_months(start.value, 12 * years) == at.value
    value = F.lit(bands[0][1])
    for from_years, v in bands[1:]:
        reached = (years >= from_years) if boundary == "lower_inclusive" else (years > from_years) | ((years == from_years) & ~exact)
        value = F.when(reached, F.lit(v)).otherwise(value)
    error = F.coalesce(start.error, at.error, F.when(at.value < start.value, F.lit("reversed_dates")))
    known = error.isNull() & years.isNotNull()
    return Val(F.when(known, value), F.when(error.isNull() & ~known, union(start.missing, at.missing)).otherwise(no_causes()), error)


def max_over(items: Column) -> Column:
    """Sum over classes of the class's greatest amount in ARRAY<STRUCT<class, krw>>; NULL if any amount is unknown.

    One pass: the greatest amount so far of every class is kept in a map.  For rows that are not
    gathered yet, `max_over_rows` needs no array.
    """
    first = F.expr("cast(map() as map<string, bigint>)")
    put = lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: k != x["class"]), F.create_map(x["class"], F.greatest(x["krw"].cast("bigint"), F.try_element_at(acc, x["class"]))))
    top = F.map_values(F.aggregate(items, first, put))
    total = F.aggregate(top, F.lit(0).cast("bigint"), F.try_add)
    return F.when(~F.exists(items, lambda x: x["krw"].isNull()), total)


#: What a declared input may be.
INPUT_KINDS = ("boolean", "integer", "money", "date", "string", "classes")
CLASSES = "array<struct<class string, krw bigint>>"
MOST_CLASSES = 1000


def _typed(v: Column, kind: str) -> tuple[Column, Column, Column]:
    """(value, whether it is of the kind, whether it says that nothing is known) of a JSON value that isn't null."""
    is_ = lambda v, *names: F.schema_of_variant(v).rlike(rf"\A(?:{'|'.join(names)})")
    get = lambda v, path, to: F.try_variant_get(v, path, to)
    no = F.lit(False)
    if kind == "boolean":
        return get(v, "$", "boolean"), is_(v, "BOOLEAN"), no
    if kind in ("integer", "money"):
        n = get(v, "$", "bigint")
        return n, is_(v, "BIGINT") & (n.isNotNull() if kind == "integer" else F.coalesce(n >= 0, no)), no
    if kind == "date":
        text = F.when(is_(v, "STRING"), get(v, "$", "string"))
        d = F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))
        return d, F.coalesce(in_calendar(d), no), no
    if kind == "string":
        return get(v, "$", "string"), is_(v, "STRING"), no
    if kind != "classes":
        raise ValueError(f"{kind} is none of {INPUT_KINDS}")
    none_ = F.to_json(v) == F.lit('{"confirmed_empty":true}')
    rows = F.when(is_(v, "ARRAY"), get(v, "$", "array<variant>"))

    def sound(e: Column) -> Column:
        name, krw_ = get(e, "$.class", "variant"), get(e, "$.krw", "variant")
        named = F.coalesce(is_(name, "STRING") & (F.trim(get(name, "$", "string")) != ""), no)
        paid = F.coalesce(is_(krw_, "VOID") | (is_(krw_, "BIGINT") & (get(krw_, "$", "bigint") >= 0)), no)
        return is_(e, "OBJECT") & (F.size(F.json_object_keys(F.to_json(e))) == 2) & named & paid

    fits = F.coalesce((F.size(rows) <= MOST_CLASSES) & F.forall(rows, sound), no)
    value = F.transform(rows, lambda e: F.struct(get(e, "$.class", "string").alias("class"), get(e, "$.krw", "bigint").alias("krw")))
    return F.when(none_, F.array().cast(CLASSES)).otherwise(value), none_ | fits, F.coalesce(F.size(rows) == 0, no)


def typed_inputs(df: DataFrame, inputs: str, declared: dict[str, str]) -> tuple[DataFrame, dict[str, Val]]:
    """df with the declared inputs (name to kind) of a JSON object, and each as a value.

    An input that is absent or null is unknown; so is an empty list of classes, unless it is given as
    {"confirmed_empty": true}.  A case is in error, in all its inputs, if it is no object (inputs_not_object), names an
    input that isn't declared (undeclared:NAME), or one is not of its kind (wrong_type:NAME); the first by name.  A list holds at most
    1,000 {class, krw}, krw a whole number from 0 or null.
    """
    whole = "_inputs"
    df = df.withColumn(whole, F.try_parse_json(inputs))
    shaped = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    names = sorted(declared)
    beyond = F.array_sort(F.array_except(F.json_object_keys(F.col(inputs)), F.array(*map(F.lit, names)).cast("array<string>")))
    wrong, values = none(), {}
    for name in reversed(names):
        v = F.when(shaped, F.try_variant_get(F.col(whole), f"$['{name}']", "variant"))
        there = v.isNotNull() & ~F.coalesce(F.schema_of_variant(v) == "VOID", F.lit(True))
        value, fits, open_ = _typed(v, declared[name])
        wrong = F.when(there & ~open_ & ~fits, f"wrong_type:{name}").otherwise(wrong)
        values[name] = F.when(there & ~open_ & fits, value)
    error = F.when(~shaped, "inputs_not_object").when(F.size(beyond) > 0, F.concat(F.lit("undeclared:"), F.get(beyond, F.lit(0)))).otherwise(wrong)
    df = df.withColumn("_error", error).withColumns({f"_in_{n}": v for n, v in values.items()})
    out = {n: Val(F.when(F.col("_error").isNull(), F.col(f"_in_{n}")), F.when(F.col("_error").isNull() & F.col(f"_in_{n}").isNull(), F.array(F.lit(n))).otherwise(no_causes()), F.col("_error")) for n in names}
    return df.drop(whole), out


def max_over_list(items: Val, name: str) -> Amount:
    """max_over of a list of classes; an amount that isn't known leaves the whole unknown, by the list's name; beyond 64 bits is an error."""
    total = max_over(items.value)
    open_ = items.value.isNotNull() & F.exists(items.value, lambda x: x["krw"].isNull())
    missing = F.when(F.coalesce(open_, F.lit(False)), F.array(F.lit(name))).otherwise(items.missing)
    error = F.coalesce(items.error, F.when(items.value.isNotNull() & ~open_ & total.isNull(), F.lit("overflow")))
    return Amount(total, total, missing, no_causes(), error)


def max_over_rows(rows: DataFrame, case: str, kind: str, krw: str) -> DataFrame:
    """(case, total): max_over of rows (case, class, amount) by two aggregates, each combined before its shuffle."""
    best = rows.groupBy(case, kind).agg(F.max(krw).alias("_top"), F.count_if(F.col(krw).isNull()).alias("_open"))
    return best.groupBy(case).agg(F.when(F.sum("_open") == 0, F.try_sum("_top")).alias("total"))


def payout(eligible: Val, amount: Amount, effect: str = "none") -> Column:
    """STRUCT<eligibility, kind, min_krw, max_krw, effect, missing, issues, error> of a rule for a case."""
    kind = F.when(eligible.error.isNotNull(), F.lit("error")).when(~eligible.value, F.lit("not_payable")).when(eligible.value & amount.error.isNotNull(), F.lit("error")).when(eligible.value & amount.lo.isNotNull(), F.lit("payable")).otherwise(F.lit("undetermined"))
    paid = kind.isin("payable", "undetermined")
    missing = F.when(kind == "undetermined", union(eligible.missing, amount.missing)).otherwise(no_causes())
    return F.struct(
        F.when(eligible.error.isNull(), F.coalesce(eligible.value.cast("string"), F.lit("unknown"))).alias("eligibility"),
        kind.alias("kind"),
        F.when(paid, amount.lo).alias("min_krw"),
        F.when(paid, amount.hi).alias("max_krw"),
        F.when(kind == "payable", F.lit(effect)).when(kind == "undetermined", F.lit(f"conditional:{effect}")).otherwise(F.lit("none")).alias("effect"),
        missing.alias("missing"),
        F.when(kind == "undetermined", amount.issues).otherwise(no_causes()).alias("issues"),
        F.when(kind == "error", F.coalesce(eligible.error, amount.error)).alias("error"),
    )


def time_window(anchor: Column, n: int, unit: str, counted: bool | None, at: Column) -> Column:
    """STRUCT<first, last, within, assumptions>: the window of a duration from an anchor.

    Whether the anchor is counted may be left open: it then is not, and that is listed as assumed, as is
    an end that was moved to the last day of a shorter month.
    """
    end = F.date_add(anchor, n) if unit == "day" else F.add_months(anchor, n * (12 if unit == "calendar_year" else 1))
    first, last = (anchor, F.date_sub(end, 1)) if counted else (F.date_add(anchor, 1), end)
    ok = in_calendar(end)
    return F.struct(F.when(ok, first).alias("first"), F.when(ok, last).alias("last"), F.when(ok, (at >= first) & (at <= last)).alias("within"), F.array_compact(F.array(F.lit("anchor_not_counted" if counted is None else None), F.when(F.lit(unit != "day") & (F.day(end) != F.day(anchor)), F.lit("month_end")))).alias("assumptions"))


def row_hash(**columns: Column) -> Column:
    """SHA-256 over the named values in name order; NULL differs from every text."""
    return F.sha2(F.concat_ws("\u001f", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("\\0"))) for k, v in sorted(columns.items())]), 256)
