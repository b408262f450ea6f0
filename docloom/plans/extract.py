"""From a folder of documents to resolved records: the whole plan as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.dates import zone_votes
from docloom.operators import chunks, classify, merge, packages, retrieval, rules, specs
from docloom.sources import files
from docloom.stages import stage

DEFAULT_RULES = Path(__file__).resolve().parent.parent / "conf" / "fields.yaml"


@dataclass
class Result:
    documents: DataFrame
    blocks: DataFrame
    quarantine: DataFrame
    candidates: DataFrame
    resolved: DataFrame
    conflicts: DataFrame
    pricing: DataFrame
    per_document: DataFrame


def load_rules(path: str | Path | None = None) -> list[rules.Spec]:
    return rules.load(path or DEFAULT_RULES)


def document_table(scanned: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per document: file columns, whole text, page count, number of labels, type, number, precedence, order."""
    text = blocks.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.max("page_no").alias("page_count"), F.count_if(F.col("kind") == "label_value").alias("n_labels"),
    )
    docs = scanned.drop("content").join(text, "doc_id")
    typed = classify.annotate(docs)
    return typed.withColumn("precedence", classify.precedence(F.col("doc_type"), F.col("addendum_number"))).withColumn("doc_ord", F.row_number().over(Window.partitionBy("folder").orderBy("path")))


def package_table(docs: DataFrame) -> DataFrame:
    """docs with package_id, and with score and margin where an orphan was placed."""
    own = packages.bid_documents(docs).withColumn("keys", packages.strong_keys(F.col("file_name"), F.col("text")))
    own, _ = stage(own, "documents")
    members, _ = stage(packages.cluster(own), "clusters")
    terms = packages.doc_terms(own.withColumn("text", F.concat_ws(" ", "file_name", "text")))
    sizes = own.groupBy("folder").agg(F.count(F.lit(1)).alias("n_docs"))
    weights = packages.idf(terms, sizes)
    placed = packages.place_orphans(own, members, packages.contrastive(terms, members.where("cluster IS NOT NULL"), weights), terms, weights)
    both = members.join(placed.withColumnRenamed("cluster", "placed"), ["folder", "doc_id"], "left").withColumn("cluster", F.coalesce("cluster", "placed", F.lit(0))).drop("placed")
    joined = own.join(both, ["folder", "doc_id"])
    keys = packages.dominant_key(joined, ["folder", "cluster"])
    named = joined.join(keys, ["folder", "cluster"], "left")
    return named.withColumn("package_id", packages.package_name(F.col("key"), F.col("folder"), F.col("cluster")))


def run(spark: SparkSession, path: str, specs_: list[rules.Spec] | None = None, retrieve: bool = True, parsers: dict | None = None) -> Result:
    """Documents below path to one resolved value per package and field.

    retrieve narrows pattern and sentence rules to the blocks of the best
    chunks of each package and field. Times without a zone get the one that
    most of their package names; in the per-document view they are UTC.
    """
    own = specs_ or load_rules()
    scanned = files.scan(spark, path)
    # Each of these tables feeds many parts of the plan, so it is written once and read back.
    blocks, bad = files.parse(scanned, parsers)
    blocks, _ = stage(blocks, "blocks")
    docs, _ = stage(package_table(document_table(scanned, blocks)), "packages")
    spec_rows, rule_rows = rules.frames(spark, own)

    zones = zone_votes(docs).select("package_id", "iana")
    docs, _ = stage(docs.join(zones, "package_id", "left"), "zoned")
    hits = None
    if retrieve:
        cut = chunks.chunk(blocks).join(docs.select("doc_id", "package_id", "precedence", "doc_type"), "doc_id")
        queries = retrieval.field_queries(spec_rows, rule_rows)
        cut, _ = stage(cut, "chunks")
        found = retrieval.search(cut, _per_package(docs, queries), part=["package_id"])
        hits = found.join(cut.select("package_id", "chunk_id", "doc_id", "block_ids"), ["package_id", "chunk_id"]).select("doc_id", F.col("query_id").alias("field"), F.explode("block_ids").alias("block_id")).distinct()
        hits, _ = stage(hits, "hits")

    with_zone = blocks.join(docs.select("doc_id", "iana"), "doc_id", "left")
    mined, _ = stage(rules.mine(docs, with_zone, own, hits, F.col("iana")), "mined")
    spec_maps = specs.specifications(docs, blocks).join(docs.select("doc_id", "doc_ord", "doc_type", "precedence"), "doc_id")
    spec_rows_ = spec_maps.select("doc_id", "doc_type", "precedence", F.lit("product_specification").alias("field"), F.lit(None).cast("string").alias("norm_str"), F.lit(None).cast("array<string>").alias("norm_list"), "norm_map", F.lit("0.900").cast("decimal(4,3)").alias("confidence"), F.lit("spec").alias("signature"), (F.col("doc_ord") * 1_000_000).cast("bigint").alias("cand_ord"), F.lit(1).alias("page"), F.lit("product specification").alias("span"))
    plain = mined.join(spec_rows_.select("doc_id", "field"), ["doc_id", "field"], "left_anti").withColumn("norm_map", F.lit(None).cast("map<string,map<string,string>>"))
    cols = ["doc_id", "doc_type", "precedence", "field", "norm_str", "norm_list", "norm_map", "confidence", "signature", "cand_ord", "page", "span"]
    candidates = plain.select(*cols).unionByName(spec_rows_.select(*cols)).join(docs.select("doc_id", "package_id"), "doc_id")
    candidates, _ = stage(candidates, "candidates")

    resolved, conflicts = merge.merge(merge.with_scope_bonus(candidates, spec_rows), spec_rows)
    single, _ = merge.merge(candidates.withColumn("package_id", F.col("doc_id")), spec_rows)
    priced = specs.merge_pricing(specs.pricing(blocks), docs)
    return Result(docs, blocks, bad, candidates, resolved, conflicts, priced, single)


def _per_package(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Each package's queries: the fields are a fixed small list, so they are packed into one row."""
    packed = queries.agg(F.collect_list(F.struct("query_id", "text")).alias("qs"))
    return docs.select("package_id").distinct().join(F.broadcast(packed)).select("package_id", F.inline("qs"))
