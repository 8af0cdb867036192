"""Pages, links and listings by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import pages


def text_of(spark, html, host="www.kbinsure.co.kr"):
    return spark.createDataFrame([(html,)], "h string").select(pages.visible_text(F.col("h"), F.lit(host)).alias("v")).first().v


SEEN = [
    ("<title>Terms [A]</title><p>x", "Terms x"),
    ("<TITLE>Terms [AB]</TITLE>x", "Terms [AB] x"),
    ("<title>open [C]", "open"),
    ("a<!-- <th>b</th> -->c<!doctype html>d", "a c d"),
    ("<script>var a = '<p>no</p>'</script><style>p{}</style >yes", "yes"),
    ("<a data-href=/decoy.pdf HREF=/x.pdf>terms</a>", "[link:/x.pdf] terms"),
    ("<a href='/x.pdf?_t=1&amp;sid=2'>t</a>", "[link:/x.pdf?sid=2] t"),
    ("<iframe src=a><embed src=b><object data=c></object><form action='d'><img src=e>", "[link:a] [link:b] [link:c] [link:d]"),
    ("<button ONCLICK = \"fnDown(&quot;x.pdf&quot;)\">go</button><b onclick=' '>s</b><b onclick>t</b>", '[onclick:fnDown("x.pdf")] go s t'),
    ("&lt;b&gt; &amp;lt; &nbsp;&copy;", "<b> &lt; ©"),
    ("1 < 2 <3 > x", "1 < 2 <3 > x"),
    ("<p title='a > b'>one</p><p title=\"x", "one"),
    ("　 a \t\n b ", "a b"),
    (None, ""),
]


@pytest.mark.parametrize(("html", "want"), SEEN)
def test_what_a_page_says(spark, html, want):
    assert text_of(spark, html) == want


def test_title_marks_vary_on_their_host_only(spark):
    assert text_of(spark, "<title>T [A]</title>", "example.org") == "T [A]"
    assert text_of(spark, "<title>T [A]</title>", "KBINSURE.co.kr:443") == "T"
    assert text_of(spark, "<title>T [A]</title>", "notkbinsure.co.kr") == "T [A]"


def test_charsets(spark):
    korean = "약관"
    raw = [(1, korean.encode()), (2, korean.encode("euc-kr")), (3, b"<meta charset='latin-1'>\xe9"), (4, b"<META http-equiv=x content='text/html; charset=EUC-KR'>" + korean.encode("euc-kr")), (5, b"<meta charset=nonsense>" + "é".encode()), (6, b"\xff\xff\xff"), (7, None), (8, "똠".encode("cp949"))]
    got = {r.i: (r.d.text, r.d.charset) for r in spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in raw], "i int, b binary").select("i", pages.decoded("b").alias("d")).collect()}
    assert got[1] == (korean, "utf-8") and got[2] == (korean, "euc-kr") and got[3][0].endswith("é") and got[3][1] == "latin-1"
    assert got[4][0].endswith(korean) and got[4][1] == "EUC-KR" and got[5][0].endswith("é") and got[5][1] == "utf-8"
    assert got[6] == ("�" * 3, "utf-8-replace") and got[7] == ("", "utf-8") and got[8] == ("똠", "cp949")


URLS = [
    ("/a.pdf#p2", "http://h.org/x/y", "http://h.org/a.pdf"),
    (" b.pdf ", "http://h.org/x/y?q=1", "http://h.org/x/b.pdf"),
    ("HTTPS://H.org:443", "", "https://h.org/"),
    ("http://h.org:8080/a?b=c#d", "", "http://h.org:8080/a?b=c"),
    ("//o.org/z", "https://h.org/", "https://o.org/z"),
    ("http://[::1]/x", "", "http://[::1]/x"),
    ("http://[::1]:81/x", "", "http://[::1]:81/x"),
    ("http://u:p@h.org/x", "", None),
    ("http://@h.org/x", "", None),
    ("http://h.org\\@evil.org/x", "", None),
    ("a\nb", "http://h.org/", None),
    ("a b", "http://h.org/", None),
    ("java\tscript:x", "http://h.org/", None),
    ("javascript:x", "http://h.org/", None),
    ("mailto:a@h.org", "http://h.org/", None),
    ("http://h.org:99999/", "", None),
    ("http://[::1/x", "", None),
    ("http:///x", "", None),
    ("a.pdf", "", None),
    ("", "http://h.org/", None),
    (None, "http://h.org/", None),
]


@pytest.mark.parametrize(("href", "base", "want"), URLS)
def test_http_urls(href, base, want):
    assert pages.http_url(href, base) == want


BOX = '<div id="documents">{}</div>'
URL = "https://h.org/list/1"
LISTED = {
    "complete": (BOX.format('<a href="a.pdf">A <b>b</b></a><a href=a.pdf#x>again</a><a href="c.zip"></a><a href="d.txt">D</a><a href="https://o.org/e.pdf">E</a>') + '<a href="/f.pdf">F</a>', "complete", None, ["https://h.org/list/a.pdf|pdf|A b", "https://h.org/list/c.zip|zip|None"], None),
    "next by rel": (BOX.format("") + '<a rel="x NEXT" href="2">2</a>', "complete", None, [], "https://h.org/list/2"),
    "next by text": (BOX.format('<a href="2.pdf"> 다음 </a><a href="b.hwp">b</a>'), "complete", None, ["https://h.org/list/b.hwp|hwp|b"], "https://h.org/list/2.pdf"),
    "two nexts": (BOX.format("") + '<a rel=next href="2">2</a><a href="3">next</a>', "structure_changed", "ambiguous_next_page", [], None),
    "same next twice": (BOX.format("") + '<a rel=next href="2">2</a><a href="2#x">next</a>', "complete", None, [], "https://h.org/list/2"),
    "next to itself": (BOX.format("") + '<a rel=next href="1#y">2</a>', "structure_changed", "invalid_next_page", [], None),
    "next elsewhere": (BOX.format("") + '<a rel=next href="https://o.org/">2</a>', "structure_changed", "invalid_next_page", [], None),
    "next unclosed": (BOX.format("") + '<a rel=next href="2">2', "structure_changed", "invalid_next_page", [], None),
    "empty": (BOX.format("<p>No  RESULTS today</p>"), "empty_ok", None, [], None),
    "empty unsaid": (BOX.format("nothing") + "no results", "structure_changed", "unverified_empty_listing", [], None),
    "no box": ("<p>x</p>", "structure_changed", "missing_expected_structure", [], None),
    "two boxes": (BOX.format("") * 2, "structure_changed", "missing_expected_structure", [], None),
    "open box": ('<div id=documents><a href="a.pdf">A</a>', "structure_changed", "missing_expected_structure", [], None),
    "login": (BOX.format('<a href="a.pdf">A</a>') + "<input TYPE=Password>", "blocked", "login_required", [], None),
    "refused": ("<title>x</title><h1>Verify you are <i>human</i></h1>" + BOX.format(""), "blocked", "access_blocked", [], None),
    "not refused": ("<div>captcha</div>" + BOX.format('<a href="a.pdf">A</a>'), "complete", None, ["https://h.org/list/a.pdf|pdf|A"], None),
    "unclosed link": (BOX.format('<a href="a.pdf">A</a><a href="b.pdf">B'), "structure_changed", "unclosed_document_link", ["https://h.org/list/a.pdf|pdf|A"], None),
    "attributes": (BOX.format('<a href="a.pdf" HREF="b.pdf">A</a>'), "structure_changed", "duplicate_attributes", [], None),
    "deep": ("<div>" * 70 + BOX.format(""), "structure_changed", "html_structure_limit", [], None),
    "long": (BOX.format(f'<a href="a.pdf">{"x" * 9000}</a>'), "structure_changed", "text_limit", [], None),
    "null": (None, "structure_changed", "missing_expected_structure", [], None),
}


def test_listings(spark):
    rows = [(i, URL, html) for i, (html, *_) in enumerate(LISTED.values())] + [(99, "ftp://h.org/", BOX.format("")), (98, None, "x")]
    got = {r.page_id: r for r in pages.listings(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (name, (_, status, reason, documents, onward)) in enumerate(LISTED.items()):
        r = got[i]
        assert (name, r.status, r.reason, [f"{d.url}|{d.kind}|{d.title}" for d in r.documents], r.next_page) == (name, status, reason, documents, onward)
    assert got[99].reason == got[98].reason == "invalid_source_url"
    more = pages.listings(spark.createDataFrame([(1, URL, BOX.format('<a href="//o.org/e?id=7">E</a>'))], "page_id long, url string, html string"), hosts=("O.org",), pattern=r"id=\d+").first()
    assert [(d.url, d.kind) for d in more.documents] == [("https://o.org/e?id=7", "pdf")]


def test_following_pages(spark):
    chain = lambda root, n, last=None: [(f"{root}{i}", "complete", None, [(f"{root}doc{i}", "pdf", None), (f"{root}doc0", "pdf", None)], f"{root}{i + 1}" if i < n else last) for i in range(1, n + 1)]
    listed = chain("a", 3) + chain("b", 4) + chain("c", 3, "c1") + chain("d", 2, "gone") + chain("e", 1, "e2") + [("e2", "blocked", "access_blocked", [], None), ("f1", "empty_ok", None, [], None)] + chain("g", 3, "g2")
    frame = spark.createDataFrame(listed, "url string, status string, reason string, documents array<struct<url: string, kind: string, title: string>>, next_page string")
    roots = spark.createDataFrame([(x, f"{x}1") for x in "abcdefg"] + [("h", "nowhere"), (None, "a1")], "root string, url string")
    got = {r.root: tuple(r)[1:] for r in pages.follow_pages(roots, frame, 3).collect()}
    assert got == {
        "a": ("complete", None, 3, 4),
        "b": ("structure_changed", "pagination_limit", 3, 4),
        "c": ("complete", None, 3, 4),  # led back to where it began
        "d": ("missing_page", None, 3, 3),
        "e": ("blocked", "access_blocked", 2, 2),
        "f": ("complete", None, 1, 0),
        "g": ("complete", None, 3, 4),
        "h": ("missing_page", None, 1, 0),
    }
