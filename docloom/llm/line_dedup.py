"""Line dedup, DataFrame functions only.

Lines are reduced to 128-bit digests of their keys. The digests are range
partitioned and sorted by digest, then by document (largest first) and
position, so that a window streams each digest's documents in order: the
first document keeps the line, all later ones lose it. What comes back is no
text but a compressed keep bitmap per document: the runs of kept lines.

Some digests may hold more rows than a task should get. They are found by a
frequency sketch of bounded size and are not ranged: their documents are counted
with map-side combining, and the results, MOST_HOT at most, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WHITE, ascii_lower, stage

#: Rows from which a digest is hot, and the share of all rows from which it is hot whatever their number.
HOT_ROWS, HOT_SHARE = 1 << 20, 1 / 512
#: Most digests that can be hot (their results are broadcast), and most that the sketch tracks.
MOST_HOT, TRACKED = 100_000, 1_000_000


def _text(docs: DataFrame, text: str):
    return F.coalesce(docs[text], F.lit(""))


def line_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """One row per line whose key has min_chars code points: doc_id, text_tag, pos, digest.

    text_tag tells apart rows that repeat a doc_id with another text.
    """
    lines = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(_text(docs, text)).alias("text_tag"), F.posexplode(F.split(_text(docs, text), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_tag", "pos", ascii_lower(F.btrim("line", F.lit(WHITE))).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("doc_id", "text_tag", "pos", F.unhex(F.md5("key")).alias("digest"))


def hot_digests(tagged: DataFrame, hot_rows: int = HOT_ROWS) -> list[int]:
    """The tags of digests that a task should not get whole.

    The sketch counts to within a fixed share of all rows, so with a number of
    rows that MOST_HOT * hot_rows does not cover, digests are hot from a larger
    number of rows on.
    """
    n = tagged.count()
    least = max(3, min(hot_rows, n * HOT_SHARE))
    most = min(MOST_HOT, int(n / least) + 1)
    top = tagged.agg(F.expr(f"approx_top_k(tag, {most}, {min(TRACKED, 64 * most)})").alias("top")).first()["top"]
    return [x["item"] for x in top or [] if x["count"] >= least]


def dropped_lines(digests: DataFrame, min_docs: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of digests that go: doc_id, text_tag, pos."""
    tagged = digests.withColumn("tag", F.xxhash64("digest"))
    hot = digests.sparkSession.createDataFrame([(x,) for x in hot_digests(tagged, hot_rows)], "tag long")
    some = F.broadcast(hot)  # MOST_HOT numbers at most

    cold = tagged.join(some, "tag", "left_anti")
    newest = Window.partitionBy("digest").orderBy(F.col("doc_id").desc_nulls_last())
    gone = (
        cold.drop("tag")
        .repartitionByRange("digest")
        .sortWithinPartitions("digest", F.col("doc_id").desc_nulls_last(), "pos")
        .withColumn("nth", F.dense_rank().over(newest))
        .withColumn("n_docs", F.max("nth").over(Window.partitionBy("digest")))
        .where((F.col("n_docs") >= min_docs) & (F.col("nth") > 1))
        .select("doc_id", "text_tag", "pos")
    )
    rows = tagged.join(some, "tag", "left_semi")
    found = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.max("doc_id").alias("newest"), F.count(F.lit(1)).alias("n_docs"))
    return gone.union(rows.join(F.broadcast(found), "digest").where((F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("newest"))).select("doc_id", "text_tag", "pos"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: doc_id, text_tag, dropped, keep_runs.

    A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z
    lower-cased. A key of min_chars code points or more that min_docs documents
    hold stays in the document with the largest id alone, there with all its
    lines. keep_runs is the bitmap as runs of kept lines: structs of start (from
    0) and length. dropped holds the positions in between, ascending.

    Null text is one empty line. Rows that repeat an id count as one document;
    if their texts are equal they share a bitmap, else text_tag tells them
    apart. A null id counts as one document, below all others. An empty table
    gives an empty result; other columns are not read.
    """
    digests, _ = stage(line_digests(docs, id_col, text, min_chars), "line-digests")
    held = dropped_lines(digests, min_docs).groupBy("doc_id", "text_tag").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    # Between two dropped positions, and before the first and after the last, lie runs of kept lines; the last is open.
    edge = F.concat(F.array(F.lit(-1)), "dropped", F.array(F.lit(2**31 - 1)))
    runs = F.transform(F.sequence(F.lit(1), F.size("dropped") + 1), lambda i: F.struct((F.element_at(edge, i) + 1).alias("start"), (F.element_at(edge, i + 1) - F.element_at(edge, i) - 1).alias("length")))
    return held.select("doc_id", "text_tag", "dropped", F.filter(runs, lambda r: r["length"] > 0).alias("keep_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with kept_text, n_lines and n_dropped instead of the text column.

    Null and empty text is one empty line, kept. Rows that repeat an id get the
    bitmap of their own text, null ids included. Texts of any length are cut
    whole. Columns of docs are kept whatever their names, unless they are called
    like one of the three; an empty table gives an empty result.
    """
    new = ["kept_text", "n_lines", "n_dropped"]
    rest = [c for c in docs.columns if c != text and c not in new]
    own = docs.select(F.struct(*[docs[c] for c in rest]).alias("row"), _text(docs, text).alias("own_text"), docs[id_col].alias("own_id"))
    own = own.withColumn("own_tag", F.xxhash64("own_text"))
    b = bitmaps.select(F.col("doc_id").alias("bitmap_id"), F.col("text_tag").alias("bitmap_tag"), "dropped", "keep_runs")
    both = own.join(b, F.col("own_id").eqNullSafe(F.col("bitmap_id")) & (F.col("own_tag") == F.col("bitmap_tag")), "left")
    lines = F.split("own_text", "\n")
    cut = F.array_join(F.flatten(F.transform("keep_runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    return both.select(*[F.col("row").getField(c).alias(c) for c in rest], F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("dropped").isNull(), F.col("own_text")).otherwise(cut).alias("kept_text"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup of all documents; edge cases are those of line_dedup() and apply_bitmaps()."""
    from docloom.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_bitmaps(docs, line_dedup(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS newest FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> newest AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
