"""Queries that hold the operators on documents of a solicitation against SQL.

The tables have no such documents, so each order becomes a notice whose parts
the order's columns give; the SQL states what the operators have to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.catalog import lines, query, table
from docloom.operators import classify, evaluate, merge, packages, report, rules
from docloom.sources import files

NOTICES_SQL = r"""n AS (SELECT o_orderkey AS doc_id, o_custkey::VARCHAR AS folder, (o_orderkey % 9 + 1)::INTEGER AS number,
    ['master_rfp', 'addendum', 'portal_notice', 'vendor_spec'][(o_orderkey % 4 + 1)::INTEGER] AS doc_type, strftime(o_orderdate, '%B %-d, %Y') AS day, o_orderpriority AS priority, o_orderstatus AS status FROM orders)"""


def notices(spark, sf_dir) -> DataFrame:
    """doc_id, folder, number, doc_type, day, priority, status, file_name, text: one notice per order."""
    o = table(spark, sf_dir, "orders")
    kinds = F.array(*map(F.lit, ("master_rfp", "addendum", "portal_notice", "vendor_spec")))
    own = o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_custkey").cast("string").alias("folder"),
        (F.col("o_orderkey") % 9 + 1).cast("int").alias("number"),
        F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("doc_type"),
        F.date_format("o_orderdate", "MMMM d, yyyy").alias("day"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
    name = F.when(F.col("doc_type") == "addendum", F.format_string("Addendum No. %d.pdf", "number")).otherwise(F.format_string("Notice %d.pdf", "doc_id"))
    text = F.format_string("The revised due date is %s. Priority %s applies to all lines. This notice hereby replaces order %d of the buyer.", "day", "priority", "doc_id")
    return own.withColumns({"file_name": name, "text": text})


def notice_blocks(spark, sf_dir) -> DataFrame:
    """Notices as documents of one block."""
    own = notices(spark, sf_dir)
    given = {"doc_ord": F.col("doc_id"), "precedence": F.lit(0), "block_ord": F.lit(0), "block_id": F.lit("p1.b1"), "page_no": F.lit(1), "kind": F.lit("text"), "section": F.lit(None).cast("string"), "synthetic": F.lit(False)}
    return own.withColumns(given)


# --- Classification --------------------------------------------------------


@query(
    f"""WITH {NOTICES_SQL} SELECT doc_id, CASE WHEN doc_type = 'addendum' THEN number END AS number, day AS new_due_date,
    CASE doc_type WHEN 'addendum' THEN 100 + 10 * number WHEN 'master_rfp' THEN 40 WHEN 'portal_notice' THEN 60 ELSE 25 END::INTEGER AS precedence FROM n"""
)
def notice_dates(spark, sf_dir):
    """C4, C7, G9."""
    number = classify.addendum_number(F.col("file_name"), F.col("text"))
    return notices(spark, sf_dir).select("doc_id", number.alias("number"), classify.new_due_date(F.col("text")).alias("new_due_date"), classify.precedence(F.col("doc_type"), number).alias("precedence"))


@query(
    f"""WITH {NOTICES_SQL} SELECT doc_id, 'The revised due date is ' || day || '.' AS first_note, 'This notice hereby replaces order ' || doc_id || ' of the buyer.' AS last_note, 2::INTEGER AS n_notes FROM n"""
)
def notice_amendments(spark, sf_dir):
    """C5."""
    notes = notices(spark, sf_dir).select("doc_id", classify.supersession_notes(F.col("text")).alias("notes"))
    return notes.select("doc_id", F.element_at("notes", 1).alias("first_note"), F.element_at("notes", -1).alias("last_note"), F.size("notes").alias("n_notes"))


@query(
    f"""WITH {NOTICES_SQL}, q AS (SELECT doc_id, 0 AS pos, 'Which priority does order ' || doc_id || ' have?' AS question, 'Answer: It has ' || priority AS answer FROM n
      UNION ALL SELECT doc_id, 1, 'Which state does order ' || doc_id || ' stand at?', 'Answer: It stands at ' || status FROM n)
    SELECT doc_id, pos::INTEGER AS pos, question, answer FROM q"""
)
def notice_answers(spark, sf_dir):
    """C6."""
    asked = F.format_string("1. Which priority does order %d have?\nAnswer: It has %s\n2) Which state does order %d stand at?\nAnswer:  It stands\nat %s", "doc_id", "priority", "doc_id", "status")
    return notices(spark, sf_dir).select("doc_id", F.posexplode(classify.qa_pairs(asked)).alias("pos", "pair")).select("doc_id", "pos", "pair.question", "pair.answer")


@query(
    f"""WITH {NOTICES_SQL}, w AS (SELECT doc_id, doc_id % 3 = 0 AS html, doc_id % 2 = 1 AS labelled, doc_id % 15 >= 10 AS pages, doc_type = 'addendum' AS addendum FROM n),
    s AS (SELECT *, 1.5 + CASE WHEN pages THEN 1 ELSE 0 END AS m, CASE WHEN addendum THEN 4.0 ELSE 0 END AS a, CASE WHEN html THEN 1.5 ELSE 0 END + CASE WHEN html AND labelled THEN 2.0 ELSE 0 END AS p FROM w),
    b AS (SELECT *, greatest(m, a, p) AS best, list_reverse_sort([m, a, p])[2] AS second FROM s)
    SELECT doc_id, CASE best WHEN m THEN 'master_rfp' WHEN a THEN 'addendum' ELSE 'portal_notice' END AS doc_type, round(least(1.0, 0.55 + 0.15 * (best - second) + 0.1 * best)::DOUBLE, 3) AS confidence,
    list_sort(list_filter([CASE WHEN html THEN 'html_source' END, CASE WHEN html AND labelled THEN 'label_value_grid' END, CASE WHEN addendum THEN 'addendum_marker' END, 'due_date_block', CASE WHEN pages THEN 'long_document' END], lambda x: x IS NOT NULL)) AS signals FROM b"""
)
def notice_types(spark, sf_dir):
    """C1 to C3, with the signals of the library."""
    own = notices(spark, sf_dir).drop("doc_type").withColumns({"file_format": F.when(F.col("doc_id") % 3 == 0, "html").otherwise("pdf"), "n_labels": F.col("doc_id") % 2, "page_count": F.col("doc_id") % 15})
    return classify.score(own, classify.signals()).select("doc_id", "doc_type", F.col("doc_type_confidence").alias("confidence"), F.array_sort(F.transform("signals", lambda s: s["name"])).alias("signals"))


# --- Packages --------------------------------------------------------------


@query(
    f"""WITH {NOTICES_SQL} SELECT doc_id, ['JA-' || (100000 + number), doc_id::VARCHAR] || CASE WHEN number >= 3 THEN ['C' || folder] ELSE [] END AS keys FROM n"""
)
def notice_keys(spark, sf_dir):
    """Numbers in the text, labelled ones, and those that occur three times."""
    text = F.concat("text", F.lit(" JA-"), (100000 + F.col("number")).cast("string"), F.lit(" JA-"), (100000 + F.col("number")).cast("string"))
    labelled, counted = F.array(F.concat(F.lit(" #"), F.col("doc_id").cast("string")), F.lit(" ")), F.create_map(F.concat(F.lit("C"), "folder"), F.col("number"))
    return notices(spark, sf_dir).select("doc_id", packages.strong_keys(F.col("file_name"), text, labelled, counted).alias("keys"))


@query(
    f"""WITH {NOTICES_SQL}, t AS (SELECT folder, 'JA-' || (100000 + doc_id % 3) AS key, count(*) AS n FROM n WHERE status <> 'P' GROUP BY 1, 2),
    r AS (SELECT folder, key, row_number() OVER (PARTITION BY folder ORDER BY n DESC, key) AS k FROM t), f AS (SELECT DISTINCT folder FROM n)
    SELECT folder, coalesce(lower(key), folder || '-1') AS name FROM f LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (folder)"""
)
def notice_names(spark, sf_dir):
    """A package is named after the key that most of its documents have, else after its folder."""
    key = F.concat(F.lit("JA-"), (100000 + F.col("doc_id") % 3).cast("string"))
    own = notices(spark, sf_dir).select("folder", F.when(F.col("status") != "P", F.array(key)).otherwise(F.array().cast("array<string>")).alias("keys"))
    named = own.select("folder").distinct().join(packages.dominant_key(own, ["folder"]), "folder", "left")
    return named.select("folder", packages.package_name(F.col("key"), F.col("folder"), F.lit(0)).alias("name"))


@query(f"WITH {NOTICES_SQL} SELECT folder, 'no master document' AS warning FROM n GROUP BY 1 HAVING count(*) FILTER (WHERE doc_type = 'master_rfp') = 0")
def notice_warnings(spark, sf_dir):
    """G11."""
    return packages.without_master(notices(spark, sf_dir), "folder")


@query(
    f"""WITH {NOTICES_SQL}, k AS (SELECT folder, doc_id, CASE status WHEN 'F' THEN 'assignment' WHEN 'P' THEN 'unknown' ELSE doc_type END AS doc_type FROM n),
    a AS (SELECT folder, bool_or(doc_type NOT IN ('assignment', 'unknown')) AS bids FROM k GROUP BY 1)
    SELECT folder, doc_id, doc_type FROM k JOIN a USING (folder) WHERE NOT bids OR doc_type NOT IN ('assignment', 'unknown')"""
)
def notice_bids(spark, sf_dir):
    """assignments and unknown documents go where a folder has others."""
    kind = F.when(F.col("status") == "F", "assignment").when(F.col("status") == "P", "unknown").otherwise(F.col("doc_type"))
    return packages.bid_documents(notices(spark, sf_dir).withColumn("doc_type", kind)).select("folder", "doc_id", "doc_type")


# --- Rules -----------------------------------------------------------------

LABELLED = [
    rules.Spec("status", "status", rules=(rules.Rule("status", "label", "status", 0.8, labels=("Order status", "State")),)),
    rules.Spec("priority", "priority", rules=(rules.Rule("priority", "label", "early", 0.6, labels=("Priority",)), rules.Rule("priority", "label", "late", 0.9, labels=("priority", "Rank"), doc_types=("addendum", "portal_notice")))),
]


@query(
    f"""WITH {NOTICES_SQL}, p AS (SELECT doc_id, doc_type, 'status' AS field, status AS raw, 'status' AS rule, 0.80 AS base FROM n
      UNION ALL SELECT doc_id, doc_type, 'priority', priority, 'late', 0.90 FROM n WHERE doc_type IN ('addendum', 'portal_notice'))
    SELECT doc_id, field, rule, raw, (base - 0.03 + 0.03 + 0.02 + CASE doc_type WHEN 'addendum' THEN 0.04 ELSE 0 END - CASE field WHEN 'status' THEN 0.15 ELSE 0 END)::DECIMAL(4,3) AS confidence FROM p"""
)
def notice_labels(spark, sf_dir):
    """Label rules over label blocks. Of two rules of a field with one label the later counts; placeholders are no values."""
    pair = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("label_value"))
    given = F.explode(F.array(pair("ORDER  STATUS:", F.col("status")), pair("Priority", F.col("priority")), pair("State", F.lit("n/a")), pair("Unknown", F.col("priority"))))
    pairs = notice_blocks(spark, sf_dir).withColumn("kind", F.lit("label_value")).withColumn("pair", given).select("*", "pair.*")
    return rules.finish(rules.from_labels(pairs, LABELLED, "pdf_label")).select("doc_id", "field", "rule", "raw", "confidence")


PATTERNS = [
    rules.Spec("due", "due", rules=(rules.Rule("due", "pattern", "due", 0.7, regex=r"due date is (?P<value>[A-Z][a-z]+ \d+, \d{4})", must_not_match="May"),)),
    rules.Spec("scope", "scope", rules=(rules.Rule("scope", "sentence", "scope", 0.5, regex=r"applies to (?:all|some)", doc_types=("master_rfp", "addendum")),)),
]


@query(
    f"""WITH {NOTICES_SQL}, p AS (SELECT doc_id, doc_type, 'due' AS field, 'regex' AS method, day AS raw, 0.70 AS base FROM n WHERE NOT contains(day, 'May')
      UNION ALL SELECT doc_id, doc_type, 'scope', 'section', 'Priority ' || priority || ' applies to all lines.', 0.50 FROM n WHERE doc_type IN ('master_rfp', 'addendum'))
    SELECT doc_id, field, method, raw, (base + 0.03 + CASE doc_type WHEN 'addendum' THEN 0.04 ELSE 0 END)::DECIMAL(4,3) AS confidence FROM p"""
)
def notice_patterns(spark, sf_dir):
    """Pattern and sentence rules over blocks."""
    blocks = notice_blocks(spark, sf_dir)
    found = rules.from_patterns(rules.pattern_hits(blocks, PATTERNS)).unionByName(rules.from_sentences(rules.sentence_hits(blocks, PATTERNS)))
    return rules.finish(found).select("doc_id", "field", "method", "raw", "confidence")


@query(
    """SELECT o_orderkey AS cand_ord, ((o_orderkey % 9) * 10 + CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 = 0 THEN 200 ELSE 0 END)::INTEGER AS precedence FROM orders"""
)
def vendor_bonus(spark, sf_dir):
    """J3."""
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(k.alias("cand_ord"), (k % 9 * 10).cast("int").alias("precedence"), F.when(k % 2 == 0, "spec").otherwise("other").alias("field"), F.when(k % 4 == 0, "vendor_spec").otherwise("master_rfp").alias("doc_type"))
    return merge.with_scope_bonus(own, spark.createDataFrame([("spec", "vendor"), ("other", "package")], "field string, scope string")).select("cand_ord", "precedence")


@query(
    """WITH g AS (SELECT o_orderkey AS doc_id, ['absent', 'equals', 'contains', 'min_items'][(o_orderkey % 4 + 1)::INTEGER] AS "check", CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS v FROM orders)
    SELECT doc_id, coalesce(CASE "check" WHEN 'absent' THEN v IS NULL WHEN 'equals' THEN v = '1-URGENT' WHEN 'contains' THEN contains(v, 'H') ELSE doc_id % 5 >= 3 END, false) AS passed FROM g"""
)
def gold_checks(spark, sf_dir):
    """The predicates of a gold set: absent, equals, contains, min_items."""
    k, i = F.col("o_orderkey"), (F.col("o_orderkey") % 4 + 1).cast("int")
    check = F.element_at(F.array(*map(F.lit, ("absent", "equals", "contains", "min_items"))), i)
    expected = F.element_at(F.array(*map(F.lit, ("", " 1-urgent ", "h", "3"))), i)
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), evaluate.passed(check, expected, value, k % 5).alias("passed"))


# --- Sources and sinks -----------------------------------------------------


@query(
    f"""WITH {NOTICES_SQL} SELECT doc_id, 'Order status' AS label, status AS label_value FROM n UNION ALL SELECT doc_id, 'Priority', priority FROM n"""
)
def label_lines(spark, sf_dir):
    """A label with its value in one block, and a lone label whose value stands after another lone label."""
    given = F.array(F.concat(F.lit("Order status: "), "status"), F.lit("Some text without a label"), F.lit("Priority:"), F.lit("Empty:"), F.col("priority"), F.lit("The end"), F.lit("Last:"))
    blocks = notices(spark, sf_dir).select("doc_id", F.lit(1).alias("page_no"), F.posexplode(given).alias("block_ord", "text")).withColumn("block_id", F.col("block_ord").cast("string"))
    return files.label_pairs(blocks).where("label <> 'Empty'").select("doc_id", "label", "label_value")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, doc_id % 20 AS size FROM documents),
    k AS (SELECT doc_id, CASE WHEN length(line) < 120 AND size >= 13 THEN 'heading' WHEN length(line) < 120 AND regexp_matches(line, '^\s*\d+(\.\d+)*\.?\s+[A-Z]') THEN 'heading'
      WHEN regexp_matches(line, '^\s*([•●▪*-]|\(?\d{1,3}[.)])\s+') THEN 'list_item' ELSE 'text' END AS kind FROM l)
    SELECT doc_id, kind, count(*) AS n FROM k GROUP BY ALL"""
)
def line_kinds(spark, sf_dir):
    """S9, with sizes by document."""
    return lines(spark, sf_dir).select("doc_id", files.block_kind(F.col("line"), F.col("doc_id") % 20).alias("kind")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH l AS (SELECT l_orderkey AS doc_id, 50.0 + 300 * (l_linenumber % 2) AS x0, l_partkey::DOUBLE AS y0 FROM lineitem),
    t AS (SELECT doc_id, count(*) >= 6 AND count(DISTINCT x0) = 2 AS two FROM l GROUP BY 1),
    c AS (SELECT l.*, CASE WHEN two AND x0 > 200 THEN 1 ELSE 0 END::INTEGER AS column_no FROM l JOIN t USING (doc_id))
    SELECT doc_id, x0::DOUBLE AS x0, y0, column_no, row_number() OVER (PARTITION BY doc_id ORDER BY column_no, y0, x0)::INTEGER AS line_ord FROM c"""
)
def two_columns(spark, sf_dir):
    """S8, with an order as page and its items as lines left and right."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (50.0 + 300 * (F.col("l_linenumber") % 2)).alias("x0"), F.col("l_partkey").cast("double").alias("y0"), F.lit(600.0).alias("page_width"))
    return files.reading_order(own).select("doc_id", "x0", "y0", "column_no", "line_ord")


@query(
    f"""WITH {NOTICES_SQL} SELECT folder AS package_id, round(avg(CASE WHEN status <> 'P' THEN 1.0 ELSE 0 END), 4)::DOUBLE AS coverage, min(doc_id) AS first_doc,
    arg_min(doc_type, doc_id) AS first_type, count(*) AS n_fields FROM n GROUP BY 1"""
)
def json_packages(spark, sf_dir):
    """K1: values read back out of each package's JSON."""
    own = notices(spark, sf_dir).withColumnRenamed("folder", "package_id")
    none = F.lit(None).cast("string")
    resolved = own.select("package_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("field"), F.col("priority").alias("norm_str"), F.array("priority").alias("norm_list"), F.create_map("priority", "status").alias("norm_map"), F.lit(0.5).alias("confidence"), (F.col("status") != "P").alias("present"), none.alias("null_reason"), none.alias("evidence"), F.lit("precedence").alias("strategy"))
    documents = own.select("package_id", "doc_id", "file_name", "doc_type", F.lit(10).alias("precedence"))
    conflicts = own.where("status = 'F'").select("package_id", F.lit("status").alias("field"), F.col("status").alias("winner"), F.array("priority").alias("losers"), none.alias("rationale"))
    pricing = own.select("package_id", F.col("number").alias("line"), F.col("priority").alias("item"), F.lit(1.0).alias("target_quantity"), none.alias("unit"))
    json = report.package_json(resolved, documents, conflicts, pricing)
    return json.select(
        "package_id",
        F.get_json_object("json", "$.coverage").cast("double").alias("coverage"),
        F.get_json_object("json", "$.documents[0].doc_id").cast("long").alias("first_doc"),
        F.get_json_object("json", "$.documents[0].doc_type").alias("first_type"),
        F.size(F.from_json(F.get_json_object("json", "$.fields"), "array<struct<field:string>>")).cast("long").alias("n_fields"),
    )
