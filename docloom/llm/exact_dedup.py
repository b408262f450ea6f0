"""Exact dedup by skew-safe combining.

Copies are combined in three steps, each with the full normalised text among
its grouping keys: map-side combining within an input partition, merging of the
salted digest groups, and combining of the salt winners over all salts. A group
of any size is spread over SALTS tasks and meets again as SALTS rows at most.
Rows find their group again by digest alone, without their texts, unless a
digest turns out to stand for several texts; those few go by full text. Rows of
very large groups are spread over all tasks there too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, spread_join, stage, table

SALTS = 48


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def _rows(docs: DataFrame, id_col: str, text: str, digest) -> DataFrame:
    norm = ascii_lower(F.coalesce(docs[text], F.lit("")))
    return docs.select(docs[id_col].alias("doc_id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept.

    Texts are equal when they are identical after lower-casing A-Z, whatever
    their digests. The row with the largest id stays. Null text counts as
    empty. A null id is below all others: it is kept only where all ids of its
    group are null. group_size counts rows. Rows that repeat both id and text
    are alike, so all or none of them are marked kept. An empty table gives an
    empty result; other columns are not read.
    """
    rows = _rows(docs, id_col, text, digest)
    n = F.count(F.lit(1))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    merged = rows.groupBy("digest", salt.alias("salt"), "norm").agg(F.max("doc_id").alias("best"), n.alias("n"))
    groups = merged.groupBy("digest", "norm").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))
    by_digest, _ = stage(groups.groupBy("digest").agg(n.alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "digest-groups")

    def judged(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))

    total = by_digest.agg(F.sum("group_size")).first()[0] or 0
    found = judged(spread_join(rows.select("doc_id", "digest"), by_digest.where("texts = 1").drop("texts"), ["digest"], "group_size", "doc_id", total).where("group_size IS NOT NULL"))
    clashes = by_digest.where("texts > 1").select("digest")
    if not clashes.isEmpty():
        clashing = rows.join(clashes, "digest", "left_semi")
        groups = clashing.groupBy("digest", salt.alias("salt"), "norm").agg(F.max("doc_id").alias("best"), n.alias("n")).groupBy("digest", "norm").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))
        found = found.union(judged(clashing.join(groups, ["digest", "norm"])))
    return found


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, one per group, with the columns of docs.

    Null text counts as empty. Of rows that repeat both id and text, one stays;
    a null id stays only where all ids of its group are null, and then one row
    does. Texts of any length are compared whole. Columns of docs are kept
    whatever their names; an empty table gives an empty result.
    """
    found = exact_dedup(docs, id_col, text).where("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    judged, _ = stage(found.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"), "n"), "kept")
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("own_id"), sha256(ascii_lower(F.coalesce(docs[text], F.lit("")))).alias("own_digest"))
    kept = own.join(judged, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_digest") == F.col("kept_digest")))
    if not judged.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["kept_id", "kept_digest"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """exact_dedup() over all documents; edge cases are exact_dedup()'s."""
    found = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = """
WITH normed AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
grouped AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM normed GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM normed JOIN grouped USING (t)
"""
