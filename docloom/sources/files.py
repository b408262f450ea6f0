"""Folders of documents as DataFrames: files, and their blocks in order.

Files are read as binary by Spark, so any file system will do. Parsers are
plain functions from bytes to rows; one that fails gives a row with an error
instead of stopping the job.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.ship import ship
from docloom.sources import docx, html

#: Parsers by file format. Add one by adding an entry; PDF needs a library and is read as parsed Parquet otherwise.
PARSERS: dict[str, Callable[[bytes], list[dict]]] = {"html": html.parse, "docx": docx.parse}
SUFFIXES = {"html": "html", "docx": "docx", "pdf": "pdf"}
BLOCK = "kind string, text string, section string, label string, label_value string, `table` array<array<string>>, synthetic boolean"
BLOCKS = f"doc_id string, block_ord int, block_id string, page_no int, {BLOCK}, error string"


def file_format(path: Column) -> Column:
    """By suffix; null for what no parser takes."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def doc_id(path: Column, digest: Column) -> Column:
    """A readable part of the file's name and the start of its digest."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    readable = F.btrim(F.regexp_replace(F.lower(stem), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    return F.concat(F.substring(readable, 1, 48), F.lit("-"), F.substring(digest, 1, 8))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per distinct file of a known format: path, file_name, folder, file_format, content_hash, doc_id, content.

    Of files with equal bytes the first path stays.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("file_format", file_format(F.col("path"))).where("file_format IS NOT NULL")
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    first = hashed.groupBy("content_hash").agg(F.min("path").alias("path"))
    own = hashed.join(first, ["content_hash", "path"], "left_semi")
    return own.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.element_at(F.split("path", "/"), -2).alias("folder"), "file_format", "content_hash", doc_id(F.col("path"), F.col("content_hash")).alias("doc_id"), "content")


def _parse(parsers):
    def run(batches):
        for batch in batches:
            for doc, kind, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    rows, error = parsers[kind](content), None
                except Exception as e:  # a broken file costs that file only
                    rows, error = [], f"{type(e).__name__}: {e}"[:500]
                if not rows:
                    rows = [{"kind": None, "text": None}]
                    error = error or "no blocks"
                names = ("kind", "text", "section", "label", "label_value", "table", "synthetic")
                cols = {n: [r.get(n) for r in rows] for n in names}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array([r.get("block_id", f"p1.b{i + 1}") for i, r in enumerate(rows)]), pa.array([r.get("page_no", 1) for r in rows], pa.int32())]
                    + [pa.array(cols[n], pa.string()) for n in names[:5]]
                    + [pa.array(cols["table"], pa.list_(pa.list_(pa.string()))), pa.array([bool(x) for x in cols["synthetic"]], pa.bool_()), pa.array([error] * len(rows), pa.string())],
                    names=["doc_id", "block_ord", "block_id", "page_no", *names, "error"],
                )

    return run


def parse(files: DataFrame, parsers: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """S3: (blocks, quarantine) of scanned files. Formats without a parser are quarantined too."""
    ship(files.sparkSession)
    own = parsers or PARSERS
    known = files.where(F.col("file_format").isin(list(own)))
    rows = known.select("doc_id", "file_format", "content").mapInArrow(_parse(own), BLOCKS)
    bad = rows.where("error IS NOT NULL").select("doc_id", "error").unionByName(files.where(~F.col("file_format").isin(list(own))).select("doc_id", F.concat(F.lit("no parser for "), F.col("file_format")).alias("error")))
    return rows.where("error IS NULL").drop("error"), bad


def unparsed(files: DataFrame, cached: DataFrame, version: str) -> DataFrame:
    """The files whose content this version of the parsers has not parsed yet."""
    return files.join(cached.where(F.col("version") == version).select("content_hash").distinct(), "content_hash", "left_anti")


def running_lines(lines: DataFrame, min_pages: int = 3, share: float = 0.6) -> DataFrame:
    """(doc_id, line) that stand on so many pages of a document; lines has doc_id, page_no, line."""
    own = lines.select("doc_id", "page_no", F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("line"))
    pages = own.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages")).where(F.col("pages") >= min_pages)
    counts = own.where("line <> ''").distinct().groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(min_pages), F.floor(F.col("pages") * share))).select("doc_id", "line")


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page_no, x0, y0, page_width) with column_no and line_ord.

    Six lines or more with a gap of 18 % of the page's width between their left
    edges are read in two columns, split in the middle of the first widest gap.
    """
    page = Window.partitionBy("doc_id", "page_no")
    gap = F.col("x0") - F.lag("x0").over(page.orderBy("x0"))
    w = lines.withColumn("gap", gap).withColumn("mid", F.col("x0") - gap / 2)
    best = F.max(F.struct(F.coalesce("gap", F.lit(0.0)).alias("gap"), (-F.col("mid")).alias("mid"))).over(page)
    two = (F.count(F.lit(1)).over(page) >= 6) & (best["gap"] >= 0.18 * F.col("page_width"))
    out = w.withColumn("column_no", F.when(two & (F.col("x0") >= -best["mid"]), 1).otherwise(0))
    return out.withColumn("line_ord", F.row_number().over(page.orderBy("column_no", F.round("y0", 1), "x0"))).drop("gap", "mid")


def group_lines(spans: list[tuple[float, float, float, float, str, float]]) -> list[dict]:
    """Lines of a page's spans (x0, y0, x1, y1, text, size).

    From top left on, a span joins the first line whose centre is within two
    points, or 0.6 of the larger height. Texts join without a blank; a line's
    size is its largest.
    """
    lines: list[dict] = []
    for x0, y0, x1, y1, text, size in sorted(spans, key=lambda s: (round(s[1], 1), s[0])):
        centre, height = (y0 + y1) / 2, y1 - y0
        line = next((n for n in lines if abs(n["centre"] - centre) <= max(2.0, 0.6 * max(n["height"], height))), None)
        if line is None:
            lines.append({"centre": centre, "height": height, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "size": size, "parts": [(x0, text)]})
        else:
            line["parts"].append((x0, text))
            line |= {"x0": min(line["x0"], x0), "y0": min(line["y0"], y0), "x1": max(line["x1"], x1), "y1": max(line["y1"], y1), "size": max(line["size"], size)}
    for n in lines:
        n["text"] = "".join(t for _, t in sorted(n.pop("parts"), key=lambda p: p[0]))
    return lines


def block_kind(text: Column, size: Column) -> Column:
    """S9."""
    small = F.char_length(text) < 120
    return F.when(small & ((size >= 13) | text.rlike(r"^\s*\d+(\.\d+)*\.?\s+[A-Z]")), "heading").when(text.rlike(r"^\s*(?:[•●▪*-]|\(?\d{1,3}[.)])\s+"), "list_item").otherwise("text")


def label_pairs(blocks: DataFrame) -> DataFrame:
    """doc_id, block_id, label, label_value: "Label: value" in one line, or a lone label and the first of the next two blocks that is none."""
    pattern, alone = r"^([A-Z][A-Za-z0-9 /#&()\-]{1,48}):[ \t]*(\S[^\n]*)$", r"^([A-Z][A-Za-z0-9 /#&()\-]{1,48}):\s*$"
    w = Window.partitionBy("doc_id", "page_no").orderBy("block_ord")
    own = blocks.withColumn("n1", F.lead("text", 1).over(w)).withColumn("n2", F.lead("text", 2).over(w))
    inline = F.nullif(F.regexp_extract("text", pattern, 2), F.lit(""))
    follow = F.when(~F.col("n1").rlike(alone), F.col("n1")).when(~F.col("n2").rlike(alone), F.col("n2"))
    value = F.when(inline.isNotNull() & ~inline.rlike(alone), inline).when(F.col("text").rlike(alone), follow)
    label = F.coalesce(F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")), F.regexp_extract("text", alone, 1))
    return own.select("doc_id", "block_id", label.alias("label"), value.alias("label_value")).where("label_value IS NOT NULL AND label <> ''")
