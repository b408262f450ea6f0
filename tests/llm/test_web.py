import pytest

from docloom.llm import html_extract, warc

PAGE = b"<p>page %d WARC/1.1\r\n\r\n and more</p>"


def records():
    return [warc.record(i, f"http://x/{i}", PAGE % i * 20) for i in range(6)]


def ids(found):
    return [h["warc-record-id"] for _, h, _ in found]


@pytest.mark.parametrize("frame", [lambda r: r + warc.END, warc.gzip_member])
def test_round_trip(frame):
    found, gaps = warc.salvage(b"".join(map(frame, records())))
    assert not gaps and [b for _, _, b in found] == [PAGE % i * 20 for i in range(6)]


@pytest.mark.parametrize("frame", [lambda r: r + warc.END, warc.gzip_member])
def test_damage_anywhere_costs_only_the_records_it_hits(frame):
    parts = list(map(frame, records()))
    data = b"".join(parts)
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    for at in range(0, len(data), 37):
        bad = bytearray(data)
        bad[at] ^= 0x55
        found, gaps = warc.salvage(bytes(bad))
        hit = max(i for i in range(6) if starts[i] <= at)
        missing = {f"<urn:page:{i}>" for i in range(6)} - set(ids(found))
        assert missing <= {f"<urn:page:{hit}>"}
        if missing:
            assert gaps and min(g[0] for g in gaps) >= starts[hit] and max(g[1] for g in gaps) <= starts[hit + 1]


def test_lost_and_inserted_bytes():
    data = b"".join(r + warc.END for r in records())
    found, gaps = warc.salvage(b"garbage" + data[:-30])
    assert ids(found) == [f"<urn:page:{i}>" for i in range(5)]
    assert gaps[0][:2] == (0, 7) and gaps[-1][1] == len(data) - 23
    assert warc.salvage(b"") == ([], [])
    assert warc.salvage(b"nothing here") == ([], [(0, 12, "no version line")])


def test_warc_edge_cases(spark, tmp_path):
    rows = [(3, "http://a/1", "<p>same</p>", "x"), (1, "http://a/2", "<p>same</p>", "x"), (2, None, None, "x"), (5, "http://a/3", "", "x"), (4, "u\r\nX: y", "é" * 3000, "x"), (None, "http://n", "<p>same</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    warc.write_warc(pages, f"file://{tmp_path}/w", file_bytes=1000)
    got = {r["record_id"]: (r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    same, empty = warc.payload_digest(b"<p>same</p>"), warc.payload_digest(b"")
    assert got == {
        "<urn:page:1>": ("response", 11, same, None),
        "<urn:page:3>": ("revisit", 11, same, "<urn:page:1>"),
        "<urn:page:>": ("revisit", 11, same, "<urn:page:1>"),
        "<urn:page:2>": ("response", 0, empty, None),
        "<urn:page:5>": ("revisit", 0, empty, "<urn:page:2>"),
        "<urn:page:4>": ("response", 6000, warc.payload_digest("é".encode() * 3000), None),
    }
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_small_payloads_are_written_in_full(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert {r["page_id"]: r["refers_to"] for r in warc.with_references(pages, 4).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_warc_query_matches_its_sql(spark, sf):
    from tests.oracle import assert_same

    assert_same(spark, sf, "op6_warc")


# --- HTML ---


def text_of(html):
    return " ".join(t for _, t in html_extract.blocks(html_extract.parse(html)))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>one<p>two  <b>th</b>ree", "one two three"),
        ("<nav>menu</nav><article><h1>T</h1><p>a&amp;b&nbsp;c</p></article><footer>f</footer>", "T a&b c"),
        ("<body><div class='ad banner'>buy</div><div id=main><p>x</div><aside>s</aside>", "x"),
        ("<script>var t='</p>';</script><style>p{}</style><p>y</p><!-- <p>no</p> -->", "y"),
        ("<article><p>a<br>b</p><ul><li>c<li>d</ul><form><p>no</p></form></article>", "a b c d"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut off <a hre", "cut off"),
        ("<article><p>kept</p><article class='comment'><p>first!</p></article></article>", "kept"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<div hidden>no</div><div role=navigation>no</div><p class='shared-heading'>yes</p>", "yes"),
    ],
)
def test_blocks(html, text):
    assert text_of(html) == text


def test_recurring_subtrees_of_a_host_go(spark):
    def page(i, host, mark):
        return (i, f"http://{host}/{i}", f"<body><div class=top><p>Welcome to {mark}</p></div><div><p>Story {i} of {host}</p><p>told again and again</p></div><div class=links>all the links</div></body>")

    rows = [page(i, "a.example", "A") for i in range(12)] + [page(100 + i, "b.example", "B") for i in range(2)]
    rows += [(200 + i, "http://c.example/x", "<body><div><p>the same page twelve times</p></div></body>") for i in range(12)]
    rows += [(300, None, None), (301, "no url", ""), (302, "//a.example", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert got[3] == ("Story 3 of a.example", 20)
    assert got[100][0] == "Welcome to B Story 100 of b.example told again and again all the links"
    assert got[205][0] == "the same page twelve times"
    assert got[300] == got[301] == ("", 0) and got[302][0] == "x"
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_query_is_the_text_of_the_article(spark, sf):
    import html as entities
    import re

    from docloom.llm.common import table

    want = {}
    for r in table(spark, sf, "pages").collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", r["html"] or "", re.S)
        body = re.sub(r"</?b>|<[^>]*\Z", "", m[1]) if m else ""
        want[r["page_id"]] = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", body)).split())
    assert {r["page_id"]: r["text"] for r in html_extract.op9_html_extraction(spark, sf).collect()} == want
