"""Packing into optimal length buckets.

Texts are cut into pieces of at most MAX_TOKENS words; a piece carries its part
of the text, so a batch can be fed as it is. The global histogram of piece
lengths, at most MAX_TOKENS numbers, goes to the driver, where dynamic
programming finds the BUCKETS upper bounds with the least total padding. Within
a bucket all pieces are padded to its bound, and batches of as many pieces as
the token budget holds are cut from one global order. That order is made
without a global sort: pieces are dealt to SHARDS by hash, numbered within each
shard, and shifted by the sizes of the shards before.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stage, table
from docloom.ship import ship

MAX_TOKENS, BUCKETS, BUDGET, SHARDS = 2048, 16, 65_536, 256


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """At most `buckets` ascending upper bounds with the least padding in total.

    lengths are distinct and ascending. The last bound is the largest length.
    Of equally good choices, the one whose last bucket is widest, then the last
    but one and so on, is taken.
    """
    n = len(lengths)
    if not n:
        return []
    size, tokens = np.array(lengths, np.int64), np.array(counts, np.int64)
    c = np.concatenate([[0], np.cumsum(tokens)])
    w = np.concatenate([[0], np.cumsum(tokens * size)])
    # least[j]: least padding of the first j lengths in the buckets so far; frm[j]: where the last of these begins.
    least, froms = np.full(n + 1, np.iinfo(np.int64).max // 2), []
    least[0] = 0
    for _ in range(min(buckets, n)):
        new, frm = np.zeros_like(least), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = least[:j] + size[j - 1] * (c[j] - c[:j]) - (w[j] - w[:j])
            frm[j] = cost.argmin()
            new[j] = cost[frm[j]]
        least, froms = new, [*froms, frm]
    out, j = [], n
    for frm in reversed(froms):
        out.append(int(size[j - 1]))
        j = int(frm[j])
        if not j:
            break
    return out[::-1]


#: Characters of text that are handed on at once.
CHUNK = 1 << 20
PIECES = "doc_id long, piece int, n_tokens int, text string"


def _cut(max_tokens: int):
    """doc_id, piece, n_tokens and text of doc_id, n, text: the n words of a text in pieces of max_tokens, white space before a piece's words and after the last included."""
    some = re.compile(rf"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){{1,{max_tokens}}}")

    def cut(n: int, text: str):
        stops = [m.end() for m in some.finditer(text)][:-1] if n > max_tokens else []
        return [(min(n - k * max_tokens, max_tokens), text[a:b]) for k, (a, b) in enumerate(zip([0, *stops], [*stops, len(text)], strict=True))]

    def run(batches):
        ids, places, sizes, texts, held = [], [], [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "piece", "n_tokens", "text"])

        for given in batches:
            for i, n, text in zip(given.column(0), given.column(1), given.column(2), strict=True):
                for k, (size, own) in enumerate(cut(n.as_py(), text.as_py())):
                    ids.append(i.as_py()), places.append(k), sizes.append(size), texts.append(own)
                    held += len(own)
                if held >= CHUNK:
                    yield batch()
                    ids, places, sizes, texts, held = [], [], [], [], 0
        if ids:
            yield batch()

    return run


def _counted(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    own = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.regexp_count(own, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"), own.alias("text"))


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece (from 0), n_tokens, text: words are runs of other than [\\x20\\x09-\\x0D]. A text is its pieces' texts, joined."""
    ship(docs.sparkSession)
    return _counted(docs, id_col, text).mapInArrow(_cut(max_tokens), PIECES)


def histogram(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(length, number of pieces) by length, at most max_tokens + 1 rows, without cutting a text."""
    n = _counted(docs, id_col, text).select("n")
    rest = F.when((F.col("n") % max_tokens != 0) | (F.col("n") == 0), F.col("n") % max_tokens)
    each = n.select(F.explode(F.array(F.struct(F.lit(max_tokens).alias("n_tokens"), F.floor(F.col("n") / max_tokens).alias("k")), F.struct(rest.alias("n_tokens"), F.lit(1).cast("bigint").alias("k")))).alias("x")).select("x.*")
    return sorted((r["n_tokens"], r["n"]) for r in each.where("n_tokens IS NOT NULL AND k > 0").groupBy("n_tokens").agg(F.sum("k").alias("n")).collect())


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, shards: int = SHARDS) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bucket, bound, batch, slot, text.

    bucket counts from 0 by length, bound is the length that its pieces are
    padded to, batch counts from 0 within the bucket, slot within the batch. A
    batch holds max(1, budget // bound) pieces; only the last of a bucket may
    hold fewer. text is the piece's part of the text; joined in order of piece
    they are the whole. Null, empty and blank texts have one piece of no words. Longer
    texts than max_tokens words give several pieces; no word is lost. Repeated
    rows are packed each. An empty table gives an empty result; other columns
    are not read.
    """
    found = histogram(docs, id_col, text, max_tokens)
    bounds = optimal_bounds([x for x, _ in found], [n for _, n in found], buckets) or [0]
    cut, _ = stage(pieces(docs, id_col, text, max_tokens), "pieces")
    levels = F.array(*[F.lit(b) for b in bounds])
    bucket = F.size(F.filter(levels, lambda b: b < F.col("n_tokens")))
    dealt = cut.withColumn("bucket", bucket).withColumn("bound", F.element_at(levels, F.col("bucket") + 1)).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "text"), F.lit(shards)).cast("int"))
    sizes = dealt.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens", F.xxhash64("text"))) - 1
    # At most buckets * shards rows: a fixed bound.
    numbered = dealt.withColumn("own", own).join(F.broadcast(before), ["bucket", "shard"]).withColumn("at", F.col("own") + F.col("before"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bound"), F.lit(1))))
    return numbered.select("doc_id", "piece", "n_tokens", "bucket", "bound", F.floor(F.col("at") / fits).cast("long").alias("batch"), F.pmod(F.col("at"), fits).cast("int").alias("slot"), "text")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """pack() over all documents; edge cases are pack()'s."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
