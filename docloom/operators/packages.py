"""Documents grouped into packages: identity keys, greedy clusters, orphans, names, bid numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import identifiers, slug, tokenize
from docloom.ship import ship

#: Fixed value: numbers of which one occurrence identifies a solicitation.
DISTINCTIVE = r"\b(?:JA-\d{5,7}|BPM\d{6,9}|E\d{2}P\d{7})\b"
SIGNATURE_TERMS, SURE = 300, 10.0


def folder(path: Column) -> Column:
    """G1: the name of the folder that a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def strong_keys(file_name: Column, text: Column, labelled: Column | None = None, counted: Column | None = None) -> Column:
    """Distinctive numbers in order, values of identifying labels, and other numbers (map to counts) that occur three times."""
    parts = [F.regexp_extract_all(F.concat(file_name, F.lit("\n"), text), F.lit(f"({DISTINCTIVE})"), 1)]
    if labelled is not None:
        parts.append(F.transform(F.filter(labelled, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), lambda x: F.ltrim(F.trim(x), F.lit("#"))))
    if counted is not None:
        parts.append(F.map_keys(F.map_filter(counted, lambda k, n: (n >= 3) & ~k.rlike(f"^{DISTINCTIVE}$"))))
    return F.array_distinct(F.concat(*parts))


def greedy(rows: list[tuple[str, list[str]]]) -> dict[str, int]:
    """Cluster number of each document that has keys, in order.

    The first key that a cluster owns decides; then all keys of the document
    belong to that cluster. Clusters never merge. With one cluster or none, all
    documents stay together.
    """
    owner: dict[str, int] = {}
    out: dict[str, int] = {}
    n = 0
    for doc, keys in rows:
        if keys:
            own = next((owner[k] for k in keys if k in owner), None)
            if own is None:
                own, n = n, n + 1
            owner.update(dict.fromkeys(keys, own))
            out[doc] = own
    return out if n > 1 else {doc: 0 for doc, _ in rows}


def cluster(docs: DataFrame) -> DataFrame:
    """docs (folder, doc_id, doc_ord, keys) as folder, doc_id, cluster; cluster is null for orphans. Only keys go to Python."""
    ship(docs.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_ord")
        found = greedy([(d, list(k)) for d, k in zip(pdf["doc_id"], pdf["keys"], strict=True)])
        return pd.DataFrame({"folder": pdf["folder"], "doc_id": pdf["doc_id"], "cluster": pd.array([found.get(d) for d in pdf["doc_id"]], "Int32")})

    return docs.select("folder", "doc_id", "doc_ord", "keys").groupBy("folder").applyInPandas(run, "folder string, doc_id string, cluster int")


def doc_terms(docs: DataFrame, group: str = "folder", text: str = "text") -> DataFrame:
    """group, doc_id, term: the distinct tokens of each document."""
    return docs.select(group, "doc_id", F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term"))


def idf(terms: DataFrame, sizes: DataFrame, group: str = "folder") -> DataFrame:
    """Group, term, df, idf = ln(N / df) + 0.01."""
    return terms.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df")).join(sizes, group).select(group, "term", "df", (F.ln(F.col("n_docs") / F.col("df")) + 0.01).alias("idf"))


def contrastive(terms: DataFrame, members: DataFrame, weights: DataFrame, group: str = "folder", n: int = SIGNATURE_TERMS) -> DataFrame:
    """Group, cluster, term, idf: terms of half of a cluster's documents and of half of no other cluster's.

    The n terms with the largest idf; ties go by term.
    """
    sized = members.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(group, "cluster")))
    counts = terms.join(sized, [group, "doc_id"]).groupBy(group, "cluster", "size", "term").agg(F.count(F.lit(1)).alias("n"))
    common = counts.where(F.col("n") >= F.greatest(F.lit(1), F.ceil(F.col("size") / 2)))
    alone = common.groupBy(group, "term").agg(F.count(F.lit(1)).alias("clusters"), F.any_value("cluster").alias("cluster")).where("clusters = 1")
    ranked = alone.join(weights, [group, "term"]).withColumn("rank", F.row_number().over(Window.partitionBy(group, "cluster").orderBy(F.desc("idf"), "term")))
    return ranked.where(F.col("rank") <= n).select(group, "cluster", "term", "idf", "rank")


def place_orphans(docs: DataFrame, members: DataFrame, signatures: DataFrame, terms: DataFrame, weights: DataFrame, group: str = "folder") -> DataFrame:
    """Folder, doc_id, cluster, score, margin, sure for documents without keys.

    Shared identifiers decide: 10 and the most shared with one member. Else the
    idf of shared terms over the square roots of both sums. The best cluster
    takes the document, the lowest on ties; below SURE the placement is unsure.
    Members are those before any orphan is placed.
    """
    orphans = members.where("cluster IS NULL").select(group, "doc_id")
    ids = docs.select(group, "doc_id", F.explode(F.array_distinct(identifiers(F.col("text")))).alias("id"))
    held = ids.join(members.where("cluster IS NOT NULL"), [group, "doc_id"])
    shared = ids.join(orphans, [group, "doc_id"]).alias("o").join(held.alias("m"), [group, "id"]).groupBy(group, F.col("o.doc_id").alias("doc_id"), "m.cluster", F.col("m.doc_id").alias("other")).agg(F.count(F.lit(1)).alias("n")).groupBy(group, "doc_id", "cluster").agg((10.0 + F.max("n")).alias("by_id"))
    own = terms.join(orphans, [group, "doc_id"]).join(weights, [group, "term"])
    total = own.groupBy(group, "doc_id").agg(F.sum("idf").alias("doc_sum"))
    sums = signatures.groupBy(group, "cluster").agg(F.sum("idf").alias("sig_sum"))
    words = own.select(group, "doc_id", "term", "idf").join(signatures.select(group, "cluster", "term"), [group, "term"]).groupBy(group, "doc_id", "cluster").agg(F.sum("idf").alias("dot"))
    by_words = words.join(total, [group, "doc_id"]).join(sums, [group, "cluster"]).select(group, "doc_id", "cluster", (F.col("dot") / F.sqrt("doc_sum") / F.sqrt("sig_sum")).alias("by_words"))
    every = orphans.join(members.where("cluster IS NOT NULL").select(group, "cluster").distinct(), group)
    scored = every.join(shared, [group, "doc_id", "cluster"], "left").join(by_words, [group, "doc_id", "cluster"], "left").withColumn("score", F.coalesce("by_id", "by_words", F.lit(0.0)))
    w = Window.partitionBy(group, "doc_id").orderBy(F.desc("score"), "cluster")
    best = scored.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("rank = 1")
    return best.select(group, "doc_id", "cluster", F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"), (F.col("score") >= SURE).alias("sure"))


def dominant_key(docs: DataFrame, by: list[str]) -> DataFrame:
    """A10: the key that most documents of a group have; ties go to the one that sorts first."""
    tally = docs.select(*by, F.explode("keys").alias("key")).groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"))
    return tally.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "key")).alias("best")).select(*by, F.col("best.key").alias("key"))


def package_name(key: Column, group: Column, cluster_no: Column) -> Column:
    """G8."""
    return F.coalesce(F.when(key.isNotNull(), slug(key)), F.concat(group, F.lit("-"), (cluster_no + 1).cast("string")))


def bid_number(candidates: DataFrame, package: str = "package_id") -> DataFrame:
    """Of (package, doc_ord, value, count, weight), the value with the highest count in one document, then weight, then the first document."""
    order = F.struct("count", "weight", (-F.col("doc_ord")).alias("o"))
    return candidates.groupBy(package).agg(F.max_by("value", order).alias("bid_number"))


def without_master(docs: DataFrame, package: str = "package_id") -> DataFrame:
    """Packages that have no master document."""
    return docs.groupBy(package).agg(F.bool_or(F.col("doc_type") == "master_rfp").alias("has_master")).where("NOT has_master").select(package, F.lit("no master document").alias("warning"))


def bid_documents(docs: DataFrame, by: str = "folder") -> DataFrame:
    """without documents that are no part of a bid, unless a folder has no others; without technical folders."""
    own = ~F.col("doc_type").isin("assignment", "unknown")
    any_ = F.max(own.cast("int")).over(Window.partitionBy(by))
    return docs.where(~F.col(by).isin("_root", "raw", "data")).withColumn("_any", any_).where(own | (F.col("_any") == 0)).drop("_any")
