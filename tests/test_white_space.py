"""White space is that of (?U)\\s, without its slow patterns, and containment is linear in pairs that are looked at."""

import random
import re
import time

from pyspark.sql import functions as F

from docloom import catalog
from docloom.functions import text as T


def test_strip_and_squish_are_the_patterns_written_out(spark):
    rng = random.Random(1)
    chars = list(T.WHITE) + list("ab.\x1c\x1f᠎​é") + [" "] * 6
    texts = [None, "", " ", "\n"] + ["".join(rng.choice(chars if i % 2 else "ab \t\n\x0b\x1c") for _ in range(rng.randint(1, 30))) for i in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    wrong = df.where(~T.strip(F.col("t")).eqNullSafe(strip(F.col("t"))) | ~T.squish(F.col("t")).eqNullSafe(strip(F.regexp_replace("t", r"(?U)\s+", " "))))
    assert wrong.collect() == []


def test_squish_has_no_unicode_pattern_for_ascii(spark):
    """Before, every single blank of every line was matched and written anew."""
    assert not re.search(T.SPACE_ASCII, "a line of words") and "(?U)" not in T.SPACE_ASCII


def test_held_lines_by_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "\n".join("".join(rng.choice("aAb ") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 25)))) for i in range(200)] + [(900, None), (901, ""), (902, "ÄÖÜß\nxäöüßx"), (903, "abcd\nabcd\nABCD")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in rows:
        own = {" ".join(x.split(" ")).strip() for x in map(lambda x: re.sub(r"\s+", " ", x), (t or "").split("\n"))}
        n = sum(len(x) >= 4 and any(len(y) > len(x) and x.lower() in y.lower() for y in own) for x in own)
        if n:
            want[i] = n
    assert {r["doc_id"]: r["contained"] for r in catalog.near_containment(spark, str(tmp_path)).collect()} == want and want[902] == 1


def test_many_lines_take_seconds():
    lines = [f"line {i} of a long document with some words" for i in range(6000)]
    began = time.process_time()
    assert T.held_by_longer(lines, [len(x) for x in lines], 4) == 0
    assert time.process_time() - began < 20
