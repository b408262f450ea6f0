"""Template removal by counts alone, its two ways, and pages made to be slow."""

import random
import time

import pytest

from docloom.llm import html_extract


def told(i: int) -> str:
    rng = random.Random(i)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(9))


def site(n: int, host: str = "a.example"):
    """Pages with menus in three versions, a notice, an advert in a plain paragraph and a story each; half of the pages are copies of one story."""
    rows = []
    for i in range(n):
        story = f"<h1>Story {i}</h1><p>{told(i)}</p><p>More of day {i} follows.</p>"
        menu = f"<nav><ul><li><a href='/{i % 3}'>To part {i % 3}</a><li><a href='/'>Home</a></ul></nav>"
        rows.append((i, f"http://{host}/{i}", f"<body>{menu}<script>n={i}</script><div class='x1'><p>Buy now and save</p></div><article>{story}<p>All rights reserved by us.</p></article><footer>Version {i % 4}</footer></body>"))
    copy = "<h1>A story told on many pages</h1><p>It is the same on each of them, word by word.</p><p>Nothing is new.</p>"
    rows += [(1000 + i, f"http://{host}/c{i}", f"<body><script>n={i}</script><article>{copy}</article></body>") for i in range(n)]
    return rows


@pytest.mark.parametrize("held", [html_extract.HELD_TEMPLATES, 0])
def test_counts_alone_find_the_template(spark, held):
    pages = spark.createDataFrame(site(24), "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(pages, names=False, held_templates=held).collect()}
    for i in range(24):
        assert got[i]["text"] == f"Story {i} {told(i)} More of day {i} follows."
        assert (got[i]["n_template"], got[i]["n_named"]) == (5, 0)
        # Copies of a story are many pages but one story, so it is no template.
        assert got[1000 + i]["text"] == "A story told on many pages It is the same on each of them, word by word. Nothing is new."


def test_names_come_second(spark):
    pages = spark.createDataFrame([(1, "http://b.example/", "<nav>menu</nav><div class=ad>buy</div><article><p>x y z</p></article>")], "page_id long, url string, html string")
    r = html_extract.extract(pages).first()
    assert (r["text"], r["n_template"], r["n_named"]) == ("x y z", 0, 2)


@pytest.mark.parametrize(
    "html, text",
    [
        ('<body class="has-sidebar"><article><p>Real text</article>', "Real text"),
        ('<article class="post comments-open"><p>Real text</article>', "Real text"),
        ('<div class="page sidebar"><main><p>Real text</main></div>', "Real text"),
        ('<div id="search-page"><p>Real text of some length</p></div>', "Real text of some length"),
        ('<form action=x><div><p>A page within a form</p></div></form>', "A page within a form"),
        ('<article><p>Main text</p></article><article class="comment"><p>first!</p></article>', "Main text"),
    ],
)
def test_names_never_remove_the_page_itself(html, text):
    assert " ".join(t for _, t in html_extract.blocks(html_extract.parse(html))) == text


@pytest.mark.parametrize("unit", ["<a ", "</x>", "<b><hr>", "<b><li></li>", '<a x=">"', '<a x="', "<!--", "<p><b>", "<div>", "<a x='\"><b>", "<ul><li><b>"])
def test_time_is_in_proportion_to_length(unit):
    def seconds(n):
        began = time.process_time()
        html_extract.main_text(unit * n, "", None)
        return time.process_time() - began

    seconds(1000)
    assert seconds(16_000) < 8 * seconds(4_000) + 0.5


def test_text_below_the_deepest_level_stays():
    assert html_extract.main_text("<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>after", "", None)[0] == "deep after"
