"""Counts decide what is template, within articles too."""

from docloom.llm import html_extract


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_a_notice_within_articles_goes_and_words_of_sentences_stay(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><article><h1>Story {i}</h1><p>It is <b>not</b> story {i + 1}.</p><p>Read our terms.</p><ul><li>Share this<li>Tag {i}</ul></article></body>") for i in range(12)]
    assert texts(spark, rows)[3] == "Story 3 It is not story 4. Tag 3"


def test_each_section_of_a_large_host_has_its_own_template(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div><p>Section {i % 5} at a glance</p></div><div><p>Story {i}</p></div></body>") for i in range(5 * html_extract.MANY_PAGES)]
    assert texts(spark, rows)[7] == "Story 7"
    assert texts(spark, rows[:-5])[7] == "Section 2 at a glance Story 7"
