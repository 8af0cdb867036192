"""Typed inputs from JSON: what is known, unknown or wrong, by hand."""

import pytest

from lodestone.functions import rules as R

DECLARED = {"items": "classes", "paid": "money", "n": "integer", "day": "date", "name": "string", "ok": "boolean"}
CASES = [
    ("{}", None, {}),
    ("null", "inputs_not_object", {}),
    (None, "inputs_not_object", {}),
    ("{", "inputs_not_object", {}),
    ("[]", "inputs_not_object", {}),
    ('{"n": 1, "zz": 2, "aa": 1}', "undeclared:aa", {}),
    ('{"n": -3, "paid": 0, "day": "2026-02-28", "name": "", "ok": false}', None, {"n": -3, "paid": 0, "day": "2026-02-28", "name": "", "ok": "false"}),
    ('{"n": null, "items": null}', None, {}),
    ('{"n": 1.0}', "wrong_type:n", {}),
    ('{"n": "1"}', "wrong_type:n", {}),
    ('{"n": true, "day": 3}', "wrong_type:day", {}),  # the first by name
    ('{"paid": -1}', "wrong_type:paid", {}),
    ('{"day": "2026-02-30"}', "wrong_type:day", {}),
    ('{"day": "1899-12-31"}', "wrong_type:day", {}),
    ('{"day": "2026-2-3"}', "wrong_type:day", {}),
    ('{"name": 5}', "wrong_type:name", {}),
    ('{"ok": "true"}', "wrong_type:ok", {}),
    ('{"items": []}', None, {}),
    ('{"items": {"confirmed_empty": true}}', None, {"items": []}),
    ('{"items": {"confirmed_empty": false}}', "wrong_type:items", {}),
    ('{"items": {"confirmed_empty": true, "x": 1}}', "wrong_type:items", {}),
    ('{"items": [{"class": "a", "krw": 5}, {"krw": null, "class": "b"}]}', None, {"items": [("a", 5), ("b", None)]}),
    ('{"items": [{"class": "a"}]}', "wrong_type:items", {}),
    ('{"items": [{"class": "a", "krw": 1, "x": 2}]}', "wrong_type:items", {}),
    ('{"items": [{"class": " ", "krw": 1}]}', "wrong_type:items", {}),
    ('{"items": [{"class": "a", "krw": -1}]}', "wrong_type:items", {}),
    ('{"items": [{"class": "a", "krw": 1.5}]}', "wrong_type:items", {}),
    ('{"items": [{"class": 3, "krw": 1}]}', "wrong_type:items", {}),
    ('{"items": [null]}', "wrong_type:items", {}),
    ('{"items": "a"}', "wrong_type:items", {}),
    ('{"items": [' + ",".join(['{"class":"a","krw":1}'] * 1001) + "]}", "wrong_type:items", {}),
]


@pytest.fixture(scope="module")
def got(spark):
    df, given = R.typed_inputs(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, j string"), "j", DECLARED)
    total = R.max_over_list(given["items"], "items")
    columns = [v.value.cast("string").alias(n) if n != "items" else v.value.alias(n) for n, v in given.items()]
    return {r.i: r for r in df.select("i", given["n"].error.alias("error"), given["n"].missing.alias("n_missing"), *columns, total.lo.alias("total"), total.missing.alias("missing"), total.error.alias("total_error")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(got, i):
    text, error, known = CASES[i]
    r = got[i]
    assert r.error == error
    told = {n: r[n] for n in DECLARED if r[n] is not None}
    told = {n: [(x["class"], x["krw"]) for x in v] if n == "items" else v for n, v in told.items()}
    assert told == {n: v if n == "items" else str(v) for n, v in known.items()}
    assert r.n_missing == (["n"] if error is None and "n" not in known else [])


def test_totals_of_lists(spark):
    cases = ['{"items": [{"class":"a","krw":5},{"class":"a","krw":7},{"class":"b","krw":1}]}', '{"items": {"confirmed_empty": true}}', '{"items": [{"class":"a","krw":5},{"class":"b","krw":null}]}', '{"items": []}', '{"items": 3}', '{"items": [{"class":"a","krw":9223372036854775807},{"class":"b","krw":1}]}']
    df, given = R.typed_inputs(spark.createDataFrame(list(enumerate(cases)), "i int, j string"), "j", {"items": "classes"})
    total = R.max_over_list(given["items"], "items")
    got = [(r.lo, r.missing, r.error) for r in df.select("i", total.lo.alias("lo"), total.missing.alias("missing"), total.error.alias("error")).orderBy("i").collect()]
    assert got == [(8, [], None), (0, [], None), (None, ["items"], None), (None, ["items"], None), (None, [], "wrong_type:items"), (None, [], "overflow")]
