"""Results as JSON documents and as a Markdown report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short(c: Column, limit: int = 60) -> Column:
    """K6: at most `limit` characters, the last three dots if cut."""
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def md_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def fmt_list(items: Column, most: int = 6) -> Column:
    more = F.size(items) - most
    return F.when(F.size(items) <= 0, "_null_").otherwise(F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise("")))


def fmt_value(text: Column, items: Column, mapping: Column) -> Column:
    """K6: a value of any kind on one line; nothing is _null_."""
    keys = F.map_keys(mapping)
    return F.coalesce(F.nullif(text, F.lit("")), fmt_list(items), fmt_list(keys, 4), F.lit("_null_"))


def typed_json() -> Column:
    """The value of a resolved row as JSON."""
    return F.coalesce(F.to_json("norm_list"), F.to_json("norm_map"), F.to_json(F.array("norm_str")).substr(F.lit(2), F.greatest(F.char_length(F.to_json(F.array("norm_str"))) - 2, F.lit(0))), F.lit("null"))


def package_json(resolved: DataFrame, documents: DataFrame, conflicts: DataFrame, pricing: DataFrame) -> DataFrame:
    """K1: package_id and a JSON document with values, evidence, conflicts, documents, pricing and coverage."""
    values = resolved.groupBy("package_id").agg(
        F.collect_list(F.struct("field", "norm_str", "norm_list", "norm_map", "confidence", "present", "null_reason", "evidence", "strategy")).alias("fields"),
        F.round(F.count_if("present") / F.count(F.lit(1)), 4).alias("coverage"),
    )
    parts = [documents.groupBy("package_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "file_name", "doc_type", "precedence"))).alias("documents"))]
    parts.append(conflicts.groupBy("package_id").agg(F.collect_list(F.struct("field", "winner", "losers", "rationale")).alias("conflicts")))
    parts.append(pricing.groupBy("package_id").agg(F.sort_array(F.collect_list(F.struct("line", "item", "target_quantity", "unit"))).alias("pricing_schedule")))
    out = values
    for p in parts:
        out = out.join(p, "package_id", "left")
    return out.select("package_id", F.to_json(F.struct(*[c for c in out.columns])).alias("json"))


def pivot(resolved: DataFrame, fields: list[str]) -> DataFrame:
    """One row per package with a column per field; the fields are given, so no pass looks for them."""
    return resolved.groupBy("package_id").pivot("field", fields).agg(F.first(F.coalesce("norm_str", F.array_join("norm_list", ", "), F.to_json("norm_map"))))


def write_packages(json: DataFrame, path: str) -> None:
    """K1, K3: one folder per package."""
    json.write.partitionBy("package_id").mode("overwrite").text(path)


def markdown(resolved: DataFrame, documents: DataFrame, conflicts: DataFrame) -> DataFrame:
    """K5: package_id and its Markdown report: documents by precedence, fields, conflicts."""
    line = lambda *cols: F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |"))
    docs = documents.groupBy("package_id").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("precedence", line(md_escape(F.col("file_name")), F.col("doc_type"), F.col("precedence").cast("string")).alias("l"))))), lambda x: x["l"]), "\n").alias("docs"))
    value = md_escape(short(fmt_value(F.col("norm_str"), F.col("norm_list"), F.col("norm_map"))))
    fields = resolved.groupBy("package_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_ord", line(F.col("field"), value, F.coalesce(F.col("confidence").cast("string"), F.lit("")), F.coalesce("null_reason", F.lit(""))).alias("l")))), lambda x: x["l"]), "\n").alias("fields"))
    found = conflicts.groupBy("package_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("field"), F.lit(": "), F.col("rationale")))), "\n").alias("conflicts"))
    out = fields.join(docs, "package_id", "left").join(found, "package_id", "left")
    text = F.concat(F.lit("# "), F.col("package_id"), F.lit("\n\n| document | type | precedence |\n|-|-|-|\n"), F.coalesce("docs", F.lit("")), F.lit("\n\n| field | value | confidence | reason |\n|-|-|-|-|\n"), F.col("fields"), F.lit("\n\n"), F.coalesce("conflicts", F.lit("No conflicts.")), F.lit("\n"))
    return out.select("package_id", text.alias("markdown"))


def document_json(single: DataFrame, documents: DataFrame) -> DataFrame:
    """K3: doc_id and a JSON document of its own values; single is resolved by document, package_id being the doc_id."""
    fields = single.groupBy(F.col("package_id").alias("doc_id")).agg(
        F.count_if("present").alias("populated_fields"),
        F.collect_list(F.struct("field", "norm_str", "norm_list", "norm_map", "confidence", "present", "null_reason", "evidence")).alias("fields"),
    )
    wanted = [c for c in ("doc_id", "file_name", "path", "file_format", "doc_type", "precedence", "page_count", "addendum_number", "amendment_notes") if c in documents.columns]
    both = documents.select(*wanted).join(fields, "doc_id", "left")
    return both.select("doc_id", F.to_json(F.struct(*both.columns)).alias("json"))


def consolidated_json(packages: DataFrame) -> DataFrame:
    """K2: one line of JSON per package, ready to be written as one JSON-lines table; a single document would have to fit one task."""
    return packages.select(F.concat(F.lit('{"package_id":'), F.to_json(F.array("package_id")).substr(F.lit(2), F.char_length(F.to_json(F.array("package_id"))) - 2), F.lit(',"result":'), "json", F.lit("}")).alias("value"))


def evaluation_json(scores: DataFrame) -> DataFrame:
    """K4: a line of JSON per package, and one with package_id null for all: passed, total, accuracy and the failed checks."""
    failed = F.struct("field", "check", "expected", "actual")
    rows = scores.groupingSets([["package_id"], []], "package_id").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("accuracy"), F.sort_array(F.collect_list(F.when(~F.col("passed"), failed))).alias("failed"))
    return rows.select(F.to_json(F.struct("package_id", "passed", "total", "accuracy", "failed"), {"ignoreNullFields": "false"}).alias("value"))


def write(result, out: str) -> None:
    """K1 to K3 and K5 of a plan's result, below a folder."""
    packages = package_json(result.resolved, result.documents, result.conflicts, result.pricing)
    write_packages(packages, f"{out}/packages")
    consolidated_json(packages).write.mode("overwrite").text(f"{out}/all")
    document_json(result.per_document, result.documents).write.partitionBy("doc_id").mode("overwrite").text(f"{out}/per_document")
    markdown(result.resolved, result.documents, result.conflicts).write.partitionBy("package_id").mode("overwrite").text(f"{out}/report")
