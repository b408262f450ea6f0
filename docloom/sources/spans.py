"""Blocks from the text spans and tables of pages that a PDF library has read.

spans: doc_id, page_no, x0, y0, x1, y1, text, size, page_width. tables: doc_id,
page_no, table_no, rows (array of rows of cells). The parser itself is no part
of this library; whatever gives these two tables can be used.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import normalize_text, squish, strip
from docloom.ship import ship
from docloom.sources.files import block_kind, group_lines, label_pairs, reading_order, running_lines

LINES = "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double, text string, size double, page_width double"


def lines(spans: DataFrame) -> DataFrame:
    """The lines of each page. A page is one group, as its lines depend on the order of its spans."""
    ship(spans.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = group_lines(list(zip(*(pdf[c] for c in ("x0", "y0", "x1", "y1", "text", "size")), strict=True)))
        rows = [{"doc_id": pdf["doc_id"].iloc[0], "page_no": pdf["page_no"].iloc[0], "page_width": pdf["page_width"].iloc[0], **{k: n[k] for k in ("x0", "y0", "x1", "y1", "text", "size")}} for n in found]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])

    own = spans.select("doc_id", F.col("page_no").cast("int").alias("page_no"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "size", "page_width")], "text")
    return own.where("text IS NOT NULL").groupBy("doc_id", "page_no").applyInPandas(run, LINES)


def table_blocks(tables: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no, table, text: cells normalised, null cells empty, blank rows dropped; tables need two rows."""
    cells = F.transform("rows", lambda r: F.transform(r, lambda c: squish(F.coalesce(c, F.lit("")))))
    full = tables.withColumn("table", F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))).where(F.size("table") >= 2)
    return full.select("doc_id", "page_no", "table_no", "table", F.array_join(F.transform("table", lambda r: F.array_join(r, " | ")), "\n").alias("text"))


def blocks(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """doc_id, block_ord, block_id, page_no, kind, text, section, label, label_value, table, synthetic.

    Lines that recur on most pages go. Lines come in reading order, a page's
    tables after its text; headings name the section of what follows. Pages
    without text have no blocks but their tables.
    """
    found = lines(spans).withColumn("text", normalize_text(F.col("text"))).where("text <> ''")
    running = running_lines(found.select("doc_id", "page_no", F.col("text").alias("line")))
    kept = found.withColumn("line", strip(F.col("text"))).join(running, ["doc_id", "line"], "left_anti")
    ordered = reading_order(kept).withColumn("kind", block_kind(F.col("text"), F.col("size")))
    none = F.lit(None).cast("array<array<string>>")
    rows = ordered.select("doc_id", "page_no", F.lit(0).alias("part"), "line_ord", "kind", "text", none.alias("table"))
    if tables is not None:
        rows = rows.unionByName(table_blocks(tables).select("doc_id", "page_no", F.lit(1).alias("part"), F.col("table_no").cast("int").alias("line_ord"), F.lit("table").alias("kind"), "text", "table"))
    # A document's blocks are numbered page by page: the blocks before a page are a sum over its pages.
    own = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("part", "line_ord"))
    numbered = rows.withColumn("n", own)
    sizes = numbered.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("size"), F.max_by("text", F.when(F.col("kind") == "heading", F.col("n"))).alias("last_heading"))
    pages = Window.partitionBy("doc_id").orderBy("page_no")
    before = sizes.select("doc_id", "page_no", (F.sum("size").over(pages) - F.col("size")).alias("before"), F.last("last_heading", True).over(pages.rowsBetween(Window.unboundedPreceding, -1)).alias("inherited"))
    heading = F.last(F.when(F.col("kind") == "heading", F.col("text")), True).over(Window.partitionBy("doc_id", "page_no").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    placed = numbered.withColumn("heading", heading).join(before, ["doc_id", "page_no"])
    full = placed.select("doc_id", (F.col("before") + F.col("n") - 1).cast("int").alias("block_ord"), F.concat(F.lit("p"), "page_no", F.lit(".b"), "n").alias("block_id"), "page_no", "kind", "text", F.coalesce("heading", "inherited").alias("section"), "table")
    pairs = label_pairs(full.where("kind <> 'table'"))
    return full.join(pairs, ["doc_id", "block_id"], "left").withColumn("synthetic", F.lit(False))
