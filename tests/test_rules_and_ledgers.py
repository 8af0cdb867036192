"""Rule functions, ledgers, chains of claims and readers on small cases with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as X
from lodestone.operators import evaluation, graph, jobs, links, pages, usage
from lodestone.sources import files


def amount(spark, rows, make, schema="a long, p long, w long"):
    df, v = R.keep(spark.createDataFrame(rows, schema), "r", make())
    return [(r.r__lo, r.r__hi, r.r__missing, r.r__issues, r.r__error) for r in df.collect()]


def test_proportions_decide_zero_error_and_unknown_in_order(spark):
    a, p, w = R.given_amount("a"), R.given("p", "bigint"), R.given("w", "bigint")
    rows = [(100, 1, 3), (None, 5, 3), (None, 5, 0), (100, -1, 0), (100, 5, 3), (100, 2, 0), (100, None, 0), (100, -1, 3), (None, -1, 3)]
    got = amount(spark, rows, lambda: R.pro_rata(a, p, w))
    assert [g[0] for g in got] == [33] + [None] * 8
    assert [g[4] for g in got] == [None, None, None, "bad_proportion", "bad_proportion", None, None, "bad_proportion", None]
    assert [g[3] for g in got] == [[], [], ["zero_denominator"], [], [], ["zero_denominator"], ["zero_denominator"], [], []]
    assert got[1][2] == ["a"] and got[2][2] == [] and got[8][2] == ["a"]


def test_counts(spark):
    a, n = R.given_amount("a"), R.given("p", "bigint")
    rows = [(100, 3, 0), (None, 0, 0), (None, -1, 0), (100, -1, 0), (2**62, 4, 0), (100, None, 0)]
    got = amount(spark, rows, lambda: R.divide_count(a, n, "ceil"))
    assert [(g[0], g[3], g[4]) for g in got] == [(34, [], None), (None, ["zero_denominator"], None), (None, [], None), (None, [], "negative_count"), (2**60, [], None), (None, [], None)]
    got = amount(spark, rows, lambda: R.multiply_count(a, n))
    assert [(g[0], g[4]) for g in got] == [(300, None), (None, None), (None, None), (None, "negative_count"), (None, "overflow"), (None, None)]


@pytest.mark.parametrize(("mode", "want"), [("floor", 30), ("ceil", 40), ("half_up", 40), ("half_even", 40), ("unspecified", 30)])
def test_rounding_in_units_and_beyond_64_bit_products(spark, mode, want):
    got = amount(spark, [(35, 0, 0), (2**62, 0, 0)], lambda: R.multiply_rate(R.given_amount("a"), 1, 1, mode, 10))
    assert got[0][0] == want and got[0][1] == (40 if mode == "unspecified" else want)
    wide = amount(spark, [(2**62, 0, 0)], lambda: R.multiply_rate(R.given_amount("a"), 999_999_999, 1_000_000_000, mode))
    exact = divmod(2**62 * 999_999_999, 10**9)
    assert wide[0][0] in (exact[0], exact[0] + 1)


def test_equal_branches_of_an_unknown_condition(spark):
    df = spark.createDataFrame([(None, 5, 5), (None, 5, 6)], "c boolean, x long, y long")
    v = R.choose_amount(R.given("c", "boolean"), R.given_amount("x"), R.given_amount("y"))
    got = [(r.r__lo, r.r__missing) for r in R.keep(df, "r", v)[0].collect()]
    assert got == [(5, []), (None, ["c"])]
    assert [r.v for r in df.select(R.negate(R.given("c", "boolean")).value.alias("v")).collect()] == [None, None]


def test_ranges_are_not_compared_and_rates_are(spark):
    df = spark.createDataFrame([(10,)], "a long")
    open_ = R.multiply_rate(R.given_amount("a"), 1, 3, "unspecified")
    assert df.select(R.compare("lt", R.exact(open_), R.lit(5)).error.alias("e")).first().e == "range_compared"
    rate = lambda n, d: (F.lit(n), F.lit(d))
    assert df.select(R.compare_rates("lt", *rate(1, 3), *rate(34, 100)).alias("v")).first().v


LEDGER = "kind string, seq long, reservation_seq long, run string, up long"


def test_another_runs_settlement_counts_for_nothing(spark):
    rows = [("reservation", 1, None, "r1", 100), ("settlement", 2, 1, "r2", 5)]
    got = usage.usage(spark.createDataFrame(rows, LEDGER), [], ["up"]).first()
    assert (got.up, got.open) == (100, 1)


def test_a_reservation_open_at_the_checkpoint_is_settled_after_it(spark):
    rows = spark.createDataFrame([("reservation", 1, None, "r1", 100), ("pre_ledger_usage", 2, None, None, 7)], LEDGER)
    late = spark.createDataFrame([("settlement", 3, 1, "r1", 5), ("settlement", 4, 99, "old", 1)], LEDGER)
    totals, opened = usage.checkpoint(rows, [], ["up"])
    got = usage.resume(totals, opened, late, [], ["up"]).first()
    full = usage.usage(rows.union(late), [], ["up"]).first()
    assert (got.up, got.n, got.open) == (full.up, full.n, full.open) == (12, 2, 0)


def test_admissions_whose_run_settled_nothing_count_at_the_limits(spark):
    rows = spark.createDataFrame([("reservation", 1, None, "r1", 100), ("settlement", 2, 1, "r1", 40)], LEDGER)
    admitted = spark.createDataFrame([("r1",), ("r9",)], "run string")
    assert usage.usage(rows, [], ["up"], admitted, {"up": 1000}).first().up == 1040


def member(spark, claims):
    codes = spark.createDataFrame([("C50.1", "C", 50, "1"), ("D05", "D", 5, None)], "code string, letter string, major int, minor string")
    ranges = spark.createDataFrame([("breast", "C", 50, "C", 50, None), ("insitu", "D", 0, "D", 9, None), ("c501", "C", 50, "C", 50, "1")], "target string, lo_letter string, lo_major int, hi_letter string, hi_major int, minor string")
    asked = spark.createDataFrame([("x",)], "category string")
    rows = spark.createDataFrame(claims, "category string, role string, target string, accepted boolean")
    return {r.code: r.answer for r in links.membership(codes, asked, rows, ranges).collect()}


@pytest.mark.parametrize(
    ("claims", "c501", "d05"),
    [
        ([("x", "include", "breast", True)], "true", "false"),
        ([("x", "include", "breast", True), ("x", "include", "insitu", False)], "unknown", "unknown"),
        ([("x", "include", "breast", True), ("x", "include", "insitu", False), ("x", "exclude", "c501", True)], "false", "unknown"),
        ([("x", "exclude", "c501", True)], "unknown", "unknown"),
        ([("x", "include", "y", True), ("y", "include", "breast", True), ("y", "include", "insitu", True)], "true", "true"),
        ([("x", "include", "breast", True), ("x", "exclude", "y", True), ("y", "include", "c501", True)], "false", "false"),
        ([("x", "include", "breast", True), ("x", "include", "y", True), ("y", "include", "x", True)], "unknown", "unknown"),
        ([("x", "include", "nowhere", True)], "unknown", "unknown"),
    ],
)
def test_membership(spark, claims, c501, d05):
    assert member(spark, claims) == {"C50.1": c501, "D05": d05}


def test_links_keep_what_identifies_a_document(spark):
    urls = ["https://a.com/x?sid=1&a=b#f", "https://m.kbinsure.co.kr/x;jsessionid=9?_t=3&a=b", "https://a.com/x?_t=3&PHPSESSID=1", "x?a=b?c=1&z=2", "?q=ä b"]
    got = [r.v for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(X.clean_link(F.col("u"), F.lit("a.com")).alias("v")).collect()]
    assert got == ["https://a.com/x?sid=1&a=b#f", "https://m.kbinsure.co.kr/x?a=b", "https://a.com/x?_t=3", "x?a=b%3Fc%3D1&z=2", "?q=%C3%A4+b"]


def test_visible_text(spark):
    page = '<title>T</title><style>x</style><p>one<!-- no -->two <a href="/y?jsessionid=1&b=2">go</a></p><script>var a</script><b onclick="f(1)">&amp;</b>'
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    assert [r.v for r in df.select(pages.visible_text(F.col("h"), F.lit("a.com")).alias("v")).collect()] == ["T one two [link:/y?b=2] go [onclick:f(1)] &", "", ""]


def test_passages_end_at_pages_and_omissions(spark):
    md = "```text\nno page\n[PDF p.3]\na b\n...\nc\n```\nnot quoted\n```text\nd\n```"
    got = jobs.passages(spark.createDataFrame([(1, md)], "k int, md string"), "k", "md").collect()
    assert sorted((r.page or 0, r.passage) for r in got) == [(0, "d"), (0, "nopage"), (3, "ab"), (3, "c")]


def test_links_of_one_container(spark):
    html = '<div class="list x"><a href="/a.pdf">A</a><a href="/a.pdf#p">again</a><a href="http://other.org/b.pdf">B</a><a href="/c.txt">C</a></div><a href="/d.pdf">D</a>'
    rows = spark.createDataFrame([(1, "http://h.org/x/", html), (2, "http://h.org/", "<p>"), (3, "http://h.org/", '<div class=list></div>')], "page_id long, url string, html string")
    got = jobs.discover_links(rows, "div", "list", r"\.pdf$", ("h.org",)).collect()
    assert [(r.page_id, r.status, r.target, r.text) for r in got] == [(1, "complete", "http://h.org/a.pdf", "A"), (2, "structure_changed", None, None), (3, "empty_ok", None, None)]


def test_refused_judgements_are_errors_of_their_rows(spark):
    rows = spark.createDataFrame([(1, "2020-01-01")], "request long, day string")
    got = evaluation.fill_inputs(rows, {"x": ("clause_reading", None)}).first()
    assert got.error == "refused:clause_reading" and got.x is None


def test_a_broken_release_blocks_everything(spark):
    rows = spark.createDataFrame([(1, "2020-01-01")], "request long, day string")
    chain = spark.createDataFrame([(1, "linked")], "request long, outcome string")
    rule = lambda df: (df, R.lit(True), R.krw(5))
    run = lambda broken: evaluation.evaluate_requests(rows, chain, spark.createDataFrame(broken, "message string"), {}, rule).first()
    assert run([("x",)]).blocked_by == "release_broken" and run([]).p.min_krw == 5


def test_gap_log_of_an_unknown_version_fails(spark, tmp_path):
    files.append_gaps(spark.createDataFrame([(1,)], "i int"), f"{tmp_path}/g", version=9)
    with pytest.raises(Exception, match="unknown version"):
        files.read_gap_log(spark, f"{tmp_path}/g", "i int").collect()


def test_cycles_between_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (5, 6), (0, 1), (7, 7)], "src long, dst long")
    assert {r.node for r in graph.on_cycles(edges).collect()} == {1, 2, 4, 5, 7}
    assert graph.on_cycles(edges.where("src < dst")).count() == 0


def test_registries_with_wrong_headers_are_rejected(spark, tmp_path):
    texts = {"a": "id,name,n\n1,x,2\n2,y\n3,z,w\n\n4,\"q,r\",5\n5,a,6,7", "b": "wrong,columns,here\n9,x,2", "c": "\"id\", name ,n\n7,x,", "d": "name,id,n\nx,8,2", "e": "id,name\n1,x"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    kept, rejected = files.read_registry(spark, str(tmp_path), "id bigint, name string, n int")
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "x", 2), (4, "q,r", 5), (7, "x", None)]
    assert sorted(tuple(r) for r in rejected.collect()) == [("2,y", "cells"), ("3,z,w", "cells"), ("5,a,6,7", "cells"), ("id,name", "header"), ("name,id,n", "header"), ("wrong,columns,here", "header")]
