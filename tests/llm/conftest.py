import os
import random

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def edge_rows():
    """Rows with nulls, blanks, a very long text, ties and repeats: (doc_id, text, lang)."""
    rng = random.Random(1)
    common = "this very common line is in all of them"
    prose = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]) for _ in range(60))
    long = "\n".join(" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(40)) for _ in range(1500))
    rows = [
        (1, None, None),
        (2, "", "en"),
        (3, " \t\n\x0b ", "en"),
        (4, prose, "en"),
        (5, prose.upper(), "en"),
        (6, prose + " omega", "en"),
        (7, prose, "fr"),
        (7, prose, "fr"),
        (8, long, "en"),
        (9, "É" + long, None),
        (10, f"first\n{common}\nlast", "en"),
        (11, f"{common.upper()}  \nÜber\n\t{common}", "de"),
        (12, f"{common}\n", "en"),
        (13, "one two three", "en"),
        (14, "ONE two\tthree", "en"),
        (15, "one two four", "en"),
        (16, "…!?", "en"),
        (17, "a b c d e", None),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string")
    return df.select("*", F.lit("x").alias("digest"), F.lit(1).alias("pos"), F.lit(2).alias("n"), F.lit("y").alias("node"), F.lit(0.5).alias("score"), F.lit(3).alias("text_tag"), F.lit("z").alias("kept"))


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
