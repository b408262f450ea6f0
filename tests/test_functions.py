import pytest
from pyspark.sql import functions as F

from docloom.functions import dates, text


def value(spark, expression, *args):
    df = spark.createDataFrame([tuple(args) + (0,)], ", ".join([f"c{i} string" for i in range(len(args))] + ["z int"]))
    return df.select(expression(*[F.col(f"c{i}") for i in range(len(args))])).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("27-JUN-2024 14:00:00", "2024-06-27T14:00:00-05:00"),
        ("July 9, 2024 at 2:00 PM CST", "2024-07-09T14:00:00-05:00"),
        ("July 9, 2024at 2:00PM", "2024-07-09T14:00:00-05:00"),
        ("07/09/2024 03:00 PM EDT", "2024-07-09T15:00:00-04:00"),
        ("06/10/2024", "2024-06-10T00:00:00-05:00"),
        ("January 9, 2024 2:00 PM CST", "2024-01-09T14:00:00-06:00"),
        ("2024-07-09T14:00:00-05:00", "2024-07-09T14:00:00-05:00"),
        ("2024-07-09T14:00:00Z", "2024-07-09T14:00:00+00:00"),
        ("", None), ("   ", None), ("not a date", None), ("N/A", None), ("-", None),
    ],
)
def test_dates(spark, raw, want):
    assert value(spark, lambda c: dates.normalize_datetime(c, "America/Chicago"), raw) == want


def test_same_instant_in_two_notations(spark):
    a = value(spark, dates.iso_instant, "July 9, 2024 at 2:00 PM CST")
    assert a == value(spark, dates.iso_instant, "07/09/2024 03:00 PM EDT") == "2024-07-09T19:00:00+00:00"


def test_naive_dates_stay_naive(spark):
    assert value(spark, dates.normalize_datetime, "06/10/2024") == "2024-06-10T00:00:00"


@pytest.mark.parametrize(
    ("function", "raw", "want"),
    [
        (text.deconcatenate_labels, "BuyerALZATE, JASMINE", "Buyer ALZATE, JASMINE"),
        (text.collapse_whitespace, "a   b\tc", "a b c"),
        (text.collapse_whitespace, "a\r\n   b", "a\n b"),
        (text.dehyphenate, "informa-\ntion", "information"),
        (text.fix_unicode, "“A – ﬁne…​” ①", '"A - fine..." 1'),
        (text.strip_leading_label, "Description: what it is", "what it is"),
        (lambda c: text.clean_text(c, 5), "abc def ghi", "abc d..."),
        (text.clean_text, "long text… See more", "long text"),
        (text.clean_text, "  ", None),
        (text.to_list, "210-BLYZ, 379-BFNZ; 619-ARSB", ["210-BLYZ", "379-BFNZ", "619-ARSB"]),
        (text.to_list, "N/A, none, 210-BLYZ", ["210-BLYZ"]),
        (lambda c: text.prune_subsumed(F.split(c, "\\|")), "Latitude 5550|Dell Latitude 5550|WD22TB4", ["Dell Latitude 5550", "WD22TB4"]),
        (lambda c: text.distinct_ignoring_case(F.split(c, " ")), "a B A c", ["a", "B", "c"]),
        (text.norm_label, "Bid #: (Number)", "bid # number"),
        (text.slug, "JA-207652 x", "ja-207652-x"),
        (text.slug, "--", "package"),
        (text.tokenize, "The WD22TB4, a dock!", ["wd22tb4", "dock"]),
        (text.identifiers, "CC7802 and 12345 or abcde", ["cc7802"]),
        (text.qty_value, "50,000 Each", 50000),
        (text.qty_value, "none", 0),
        (text.estimate_tokens, "one two three", 3),
        (text.strip_boilerplate_lines, "a\nPage 3 of 9\n4 | 5\nb", "a\nb"),
    ],
)
def test_text(spark, function, raw, want):
    assert value(spark, function, raw) == want


def test_sentences_and_spans(spark):
    t = "First one. The bond is required\nNext line. Last"
    at = t.index("bond")
    assert value(spark, lambda c: text.sentence_of(c, F.lit(at), F.lit(at + 4)), t) == "The bond is required"
    assert value(spark, lambda c: text.span_around(c, F.lit(at), F.lit(at + 4), 5), t) == "...The bond is r..."


def test_placeholders(spark):
    for v, want in (("", True), ("N/A", True), ("tbd", True), ("Due Date:", True), ("June 1", False)):
        assert value(spark, text.is_placeholder, v, "Due date") is want


def test_zone_votes(spark):
    rows = [("p", 0, "portal_notice", "EST EST EST"), ("p", 1, "master_rfp", "at 2 PM CST, or EDT"), ("q", 0, "portal_notice", "3 PM MST"), ("r", 0, "master_rfp", "none")]
    docs = spark.createDataFrame(rows, "package_id string, doc_ord int, doc_type string, text string")
    assert sorted(tuple(r) for r in dates.zone_votes(docs).collect()) == [("p", "CST", "America/Chicago"), ("q", "MST", "America/Denver")]
