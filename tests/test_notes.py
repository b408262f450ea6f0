import re

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import classify

TEXTS = [
    "The due date stays. A revised due date of May 3, 2030 now applies here. Bidders will now be asked to sign this page again.",
    "This Addendum hereby supersedes all of the earlier ones. THIS ADDENDUM HEREBY SUPERSEDES ALL OF THE EARLIER ONES.",
    "No end of a sentence that would replace anything at all",
    "Short amends. .. This sentence shall be kept as it is...The purpose of this addendum is to answer questions, and it shall be binding.",
    "",
    None,
]


def brute_force(text):
    found = [" ".join(m.split()) for p in classify.SUPERSEDES for m in re.findall(p, text)]
    out = {}
    for x in found:
        if 25 <= len(x) <= 400:
            out.setdefault(x.lower(), x)
    return list(out.values())[:8]


def test_notes_match_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    got = {r["id"]: r["notes"] for r in df.select("id", classify.supersession_notes(F.col("text")).alias("notes")).collect()}
    assert got == {i: None if t is None else brute_force(t) for i, t in enumerate(TEXTS)}
    assert sum(len(x or ()) for x in got.values()) >= 5


def test_first_of_items_that_differ_in_case(spark):
    df = spark.createDataFrame([(["a", "A", "b", None, "B ", "b", "ä", "Ä"],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(T.distinct_ignoring_case(F.col("x"))).collect()] == [["a", "b", "B ", "ä"], [], None]
