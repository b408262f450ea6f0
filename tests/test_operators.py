import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunks, classify, evaluate, merge, packages, report, rules, specs
from docloom.plans import extract
from docloom.sources import docx, files, html

# --- Packages ---


def test_greedy_clusters_do_not_merge():
    rows = [("a", ["1"]), ("b", ["2"]), ("c", ["1", "2"]), ("d", ["2"]), ("e", [])]
    # c joins 1 and takes key 2 along, so d follows c, but b stays where it is.
    assert packages.greedy(rows) == {"a": 0, "b": 1, "c": 0, "d": 0}
    assert packages.greedy([("a", ["1"]), ("b", [])]) == {"a": 0, "b": 0}


def test_keys_orphans_and_names(spark):
    rows = [("f", "d1", 0, "a.pdf", "RFP JA-207652 dallas chromebook laptops CC7802"), ("f", "d2", 1, "b.pdf", "JA-207652 dallas chromebook terms"), ("f", "d3", 2, "c.pdf", "BPM044557 maryland laptop WD22TB4"), ("f", "d4", 3, "spec.pdf", "dock WD22TB4 data sheet"), ("f", "d5", 4, "form.pdf", "dallas chromebook form")]
    docs = spark.createDataFrame(rows, "folder string, doc_id string, doc_ord int, file_name string, text string").withColumn("keys", packages.strong_keys(F.col("file_name"), F.col("text")))
    members = packages.cluster(docs).cache()
    assert {r["doc_id"]: r["cluster"] for r in members.collect()} == {"d1": 0, "d2": 0, "d3": 1, "d4": None, "d5": None}
    terms = packages.doc_terms(docs)
    weights = packages.idf(terms, docs.groupBy("folder").agg(F.count(F.lit(1)).alias("n_docs")))
    placed = packages.place_orphans(docs, members, packages.contrastive(terms, members.where("cluster IS NOT NULL"), weights), terms, weights)
    got = {r["doc_id"]: r for r in placed.collect()}
    assert got["d4"]["cluster"] == 1 and got["d4"]["score"] == 11.0 and got["d4"]["sure"]
    assert got["d5"]["cluster"] == 0 and not got["d5"]["sure"] and got["d5"]["margin"] > 0


# --- Chunks ---


def test_chunks_keep_sections_budgets_and_overlap():
    blocks = [(f"b{i}", 1, "text", None, " ".join(["word"] * 200)) for i in range(7)]
    blocks.insert(3, ("h", 1, "heading", None, "Section Two"))
    found = chunks.pack(blocks, target=600, overlap=60)
    assert [c["section"] for c in found] == [None, None, *["Section Two"] * 4]
    assert [c["block_ids"] for c in found] == [["b0", "b1"], ["b1", "b2"], ["b2", "h", "b3"], ["b3", "b4"], ["b4", "b5"], ["b5", "b6"]]
    assert {b for c in found for b in c["block_ids"]} == {b[0] for b in blocks}
    assert all(c["tokens"] <= 600 for c in found)
    assert found[1]["block_ids"][0] == found[0]["block_ids"][-1]
    assert chunks.pack([("x", 1, "text", None, " ".join(["w"] * 900))])[0]["block_ids"] == ["x"]


# --- Classification and addenda ---


def test_document_types(spark):
    rows = [("Addendum 2.pdf", "ADDENDUM No. 2. The new due date for this RFP will be July 9, 2024 at 2:00 PM CST. All else stays.", "pdf", 0, 1), ("x.html", "closing date and more", "html", 3, 1), ("form.pdf", "This affidavit is made", "pdf", 0, 1), ("list.pdf", "SKU SKU part number", "pdf", 0, 1), ("y.pdf", "Request for Proposal, due date", "pdf", 0, 12), ("z.pdf", "nothing", "pdf", 0, 1)]
    docs = classify.annotate(spark.createDataFrame(rows, "file_name string, text string, file_format string, n_labels int, page_count int"))
    got = {r["file_name"]: r for r in docs.withColumn("precedence", classify.precedence(F.col("doc_type"), F.col("addendum_number"))).collect()}
    assert {k: v["doc_type"] for k, v in got.items()} == {"Addendum 2.pdf": "addendum", "x.html": "portal_notice", "form.pdf": "legal_affidavit", "list.pdf": "vendor_spec", "y.pdf": "master_rfp", "z.pdf": "unknown"}
    a = got["Addendum 2.pdf"]
    assert (a["addendum_number"], a["precedence"]) == (2, 120) and a["addendum_effective_date"].startswith("July 9, 2024")
    assert got["z.pdf"]["doc_type_confidence"] == 0 and got["x.html"]["doc_type_confidence"] == 1.0


def test_questions_and_answers(spark):
    text = "1. What is the delivery window for laptops?\nAnswer: Ten days.\n2) Short? Answer: no\n3. May vendors submit more than one proposal?\nAnswer: Yes,\nthey may.\nEND OF ADDENDUM"
    row = spark.createDataFrame([(text,)], "t string").select(classify.qa_pairs(F.col("t")).alias("p")).first()
    assert [(x["question"], x["answer"]) for x in row["p"]] == [("What is the delivery window for laptops?", "Answer: Ten days."), ("May vendors submit more than one proposal?", "Answer: Yes, they may.")]


# --- Specifications and prices ---


def test_what_chunks_carry_over():
    long, short = " ".join(["w"] * 900), " ".join(["w"] * 30)
    # A long block stands alone; what was held before it is carried over, and flushed again at the end.
    found = chunks.pack([("a", 1, "text", None, short), ("big", 1, "text", None, long), ("b", 2, "text", "S", " ")])
    assert [(c["block_ids"], c["tokens"]) for c in found] == [(["a"], 39), (["big"], 1170), (["a"], 39)]
    assert found[1]["text"] == long and chunks.pack([("x", 1, "text", None, long)], longest=80)[0]["text"] == long[:80]
    # Blocks are carried over until they make the overlap, be it all.
    assert [c["block_ids"] for c in chunks.pack([("a", 1, "text", None, short), ("b", 1, "text", None, short), ("h", 1, "heading", None, "H")], overlap=60)] == [["a", "b"], ["a", "b", "h"]]
    assert [c["block_ids"] for c in chunks.pack([("a", 1, "text", None, short), ("h", 1, "heading", None, "H")], overlap=0)] == [["a"], ["h"]]
    assert chunks.pack([]) == []


def price_rows(spark, *grids):
    blocks = spark.createDataFrame([("d", i, "table", g) for i, g in enumerate(grids)], "doc_id string, block_ord int, kind string, `table` array<array<string>>")
    found = specs.price_rows(blocks).orderBy("block_ord", "pos").collect()
    return [(r["line"], r["item"], r["target_quantity"], r["unit"]) for r in found]


def test_price_schedules(spark):
    grid = [["Schedule", None, None], ["Line", "Item", "Target Quantity", "Unit"], ["15.01 Small Student Laptop", "", "50,000", "Each"], ["16 LAPTOPS - FOR EVALUATION", "", "", ""], ["18.01", "Staff Laptop", "10,000", "", "ea"]]
    assert price_rows(spark, grid) == [("Line 15.01", "Small Student Laptop", "50,000", "Each"), ("Line 18.01", "Staff Laptop", "10,000", "ea")]
    assert price_rows(spark, [["Product Name", "Qty"], ["1. Laptop CC7802", "30"], ["2. Dock", "30"]]) == [("Line 1", "Laptop CC7802", "30", ""), ("Line 2", "Dock", "30", "")]
    assert price_rows(spark, [["the quantity of an order may change at any time", "x"]]) == []
    far = [["Line", "Item", "", "", "Quantity", "Unit"], ["7", "Dock", "12", "", "", "", "", "Each"], ["8", "Cable", "", "", "", "each"], ["", "Group", "", "", "", ""], ["9", None, "1"]]
    assert price_rows(spark, far) == [("Line 7", "Dock", "12", "Each"), ("Line 8", "Cable", "", "each")]
    assert price_rows(spark, [["a"], ["Qty", "Description"], ["1,200", "Bag", "x"]], [[None]]) == [("Line 1", "Bag", "1,200", "")]


def test_specifications(spark):
    rows = [("d", 0, "heading", "Tier 1 Small Chromebook Minimum Requirements", None), ("d", 1, "list_item", "• RAM: 8 GB\n• Touch screen", None), ("d", 2, "text", "Display Monitor", None), ("d", 3, "list_item", "• Size: 24 in\n• Stand: yes", None), ("d", 4, "text", "x" * 130, None), ("d", 5, "list_item", "• Stray: item", None), ("d", 6, "table", "t", [["Products", "x"], ["Product Name", "Model", "Qty"], ["1. Latitude Laptop", "5550", "30"], ["The vendor shall ship within ten days of any award made", "n", "1"]])]
    blocks = spark.createDataFrame(rows, "doc_id string, block_ord int, kind string, text string, `table` array<array<string>>")
    docs = spark.createDataFrame([("d", "master_rfp")], "doc_id string, doc_type string")
    got = specs.specifications(docs, blocks).first()["norm_map"]
    assert got == {"Tier 1 Small Chromebook": {"RAM": "8 GB", "requirement_2": "Touch screen"}, "Display Monitor": {"Size": "24 in", "Stand": "yes"}, "Latitude Laptop": {"product name": "1. Latitude Laptop", "model": "5550", "qty": "30"}}


# --- Sources ---

PAGE = b"""<html><head><title>Bid</title></head><body><nav><li>Home: x</li></nav><h2>Contact Information</h2>
<div class="mets-field"><span class="mets-field-label">Solicitation Number</span><div class="mets-field-body">BPM044557</div></div>
<div class="mets-field"><span class="mets-field-label"></span><div class="mets-field-body">Agency X</div></div>
<table><tr><th>Closing Date</th><td>07/09/2024 03:00 PM EDT</td></tr></table><ul><li>Title: Laptops</li></ul>
<p class="description">The agency is seeking laptops for its staff and students. Delivery within thirty days.</p></body></html>"""


def word_file() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    body = p("Scope", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + p("Due Date: July 9, 2024") + p("Plain words.") + f"<w:tbl>{row('Field', 'Value')}{row('Buyer', 'A. Person')}{row('Fax', '')}</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_html_and_word_blocks():
    rows = html.parse(PAGE)
    assert rows[0]["synthetic"] and "Contact Information: Agency X" in rows[0]["text"]
    assert [(r["label"], r["label_value"]) for r in rows if r["kind"] == "label_value"] == [("Solicitation Number", "BPM044557"), ("Contact Information", "Agency X"), ("Closing Date", "07/09/2024 03:00 PM EDT"), ("Title", "Laptops")]
    assert rows[-1]["text"].startswith("The agency is seeking")
    rows = docx.parse(word_file())
    assert [r["kind"] for r in rows] == ["heading", "label_value", "text", "table", "label_value", "label_value"]
    assert rows[-1]["label"] == "Fax" and rows[-1]["label_value"] == "" and rows[1]["section"] == "Scope"


def test_spans_lines_and_columns(spark):
    spans = [(0, 0, 10, 10, "Hel", 9.0), (10, 1, 20, 11, "lo", 14.0), (0, 30, 10, 40, "next", 9.0)]
    assert [(n["text"], n["size"]) for n in files.group_lines(spans)] == [("Hello", 14.0), ("next", 9.0)]
    rows = [("d", 1, x, y, 600.0) for y in (0.0, 10.0, 20.0) for x in (50.0, 350.0)]
    got = files.reading_order(spark.createDataFrame(rows, "doc_id string, page_no int, x0 double, y0 double, page_width double")).orderBy("line_ord").collect()
    assert [(r["column_no"], r["y0"]) for r in got] == [(0, 0.0), (0, 10.0), (0, 20.0), (1, 0.0), (1, 10.0), (1, 20.0)]


def test_label_pairs(spark):
    rows = [("d", 1, i, f"b{i}", t) for i, t in enumerate(["Due Date: June 1", "Buyer:", "Phone:", "555-1234", "no label"])]
    got = files.label_pairs(spark.createDataFrame(rows, "doc_id string, page_no int, block_ord int, block_id string, text string")).collect()
    assert sorted((r["label"], r["label_value"]) for r in got) == [("Buyer", "555-1234"), ("Due Date", "June 1"), ("Phone", "555-1234")]


# --- The whole plan ---


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("bids") / "bid2"
    home.mkdir()
    (home / "notice.html").write_bytes(PAGE)
    (home / "copy.html").write_bytes(PAGE)
    (home / "scope.docx").write_bytes(word_file())
    (home / "broken.docx").write_bytes(b"not a zip")
    (home / "notes.txt").write_bytes(b"skipped")
    return extract.run(spark, f"file://{home}")


def test_files_are_told_apart(result):
    assert sorted(r["file_name"] for r in result.documents.collect()) == ["copy.html", "scope.docx"]
    assert [r["doc_id"].rsplit("-", 1)[0] for r in result.quarantine.collect()] == ["broken"]


def test_every_field_is_resolved_or_explained(result):
    rows = {r["field"]: r for r in result.resolved.collect()}
    assert len(rows) == 20
    for r in rows.values():
        assert bool(r["evidence"]) == r["present"] and (r["null_reason"] is None) == r["present"]
    assert rows["bid_number"]["norm_str"] == "BPM044557"
    assert rows["title"]["norm_str"] == "Laptops"
    assert rows["due_date"]["norm_str"] == "2024-07-09T15:00:00-04:00"
    assert "seeking laptops" in rows["bid_summary"]["norm_str"]
    assert not rows["bid_bond_requirement"]["present"]


def test_override_is_recorded_and_reported(result, spark):
    found = {r["field"]: r for r in result.conflicts.collect()}
    assert found["due_date"]["winner"]["doc_id"].startswith("copy-") and found["due_date"]["losers"][0]["doc_id"].startswith("scope-")
    text = report.markdown(result.resolved, result.documents, result.conflicts).first()["markdown"]
    assert "| title | Laptops |" in text and "- due_date:" in text
    json = report.package_json(result.resolved, result.documents, result.conflicts, result.pricing).first()["json"]
    assert '"field":"bid_number"' in json
    gold = spark.createDataFrame([("other", "BPM044557", "title", "equals", "laptops"), ("other", "BPM044557", "due_date", "instant", "2024-07-09T19:00:00+00:00"), ("other", "BPM044557", "installation", "absent", ""), ("none", "X", "title", "equals", "y")], "package_id string, bid_number string, field string, check string, expected string")
    scores = evaluate.score(gold, result.resolved)
    assert [r["passed"] for r in scores.collect()] == [True, True, True]
    assert evaluate.accuracy(scores).where("package_id IS NULL").first()["accuracy"] == 1.0


# --- Rules and merging ---


def test_rule_guards_and_multiplicity(spark):
    own = [rules.Spec("part_no", "Part", kind="list", merge="union", rules=(rules.Rule("part_no", "pattern", "sku", 0.9, r"(?<![\d)-])(?P<value>\d{3}-[A-Z0-9]{4})(?![\d-])", multiplicity="all", must_not_match=r"^999"),)), rules.Spec("term", "Term", rules=(rules.Rule("term", "sentence", "t", 0.8, r"term of"),))]
    docs = spark.createDataFrame([("d", 0, "f", "master_rfp", 40)], "doc_id string, doc_ord int, file_name string, doc_type string, precedence int")
    texts = ["210-BLYZ and 379-BFNZ, not (972)925-4100 or 999-AAAA", "The term of this contract is", "three years", "Other."]
    blocks = spark.createDataFrame([("d", i, f"b{i}", 1, "text", None, t, None, None, False) for i, t in enumerate(texts)], "doc_id string, block_ord int, block_id string, page_no int, kind string, section string, text string, label string, label_value string, synthetic boolean")
    got = rules.mine(docs, blocks, own + [rules.Spec("x", "X", rules=(rules.Rule("x", "label", "l", 0.9, labels=("X",)),))]).collect()
    assert sorted(r["raw"] for r in got) == ["210-BLYZ", "379-BFNZ", "The term of this contract is three years"]
    assert {str(r["confidence"]) for r in got if r["field"] == "part_no"} == {"0.900"}


def test_shuffling_does_not_change_merged_values(spark):
    rng = random.Random(1)
    rows = [("p", "f", i, f"d{i % 4}", rng.choice([10, 20]), rng.choice(["0.500", "0.700"]), rng.choice(["aaaa", "bbbb", "aaaabb", "cccc"])) for i in range(40)]

    def merged():
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "package_id string, field string, cand_ord bigint, doc_id string, precedence int, confidence string, norm_str string").withColumn("confidence", F.col("confidence").cast("decimal(4,3)")).withColumns({"signature": F.col("norm_str"), "norm_list": F.array("norm_str"), "norm_map": F.lit(None).cast("map<string,map<string,string>>")}).repartition(rng.randint(1, 5))
        return [f(df).drop("evidence").collect() for f in (merge.merge_precedence, merge.merge_union, merge.merge_concat, merge.merge_longest)]

    assert merged() == merged()


def test_streamed_candidates_merge_again_only_what_they_touch(spark, tmp_path):
    from docloom.streaming import remerge

    kind = "package_id string, field string, cand_ord bigint, doc_id string, precedence int, confidence decimal(4,3), norm_str string, norm_list array<string>, norm_map map<string,map<string,string>>, signature string"
    given = spark.createDataFrame([(0, "f", "precedence", "none")], "field_ord int, field string, merge string, null_reason string")

    def land(rows):
        spark.createDataFrame(rows, "package_id string, cand_ord bigint, precedence int, norm_str string").selectExpr("package_id", "'f' field", "cand_ord", "'d' doc_id", "precedence", "cast(0.5 as decimal(4,3)) confidence", "norm_str", "cast(null as array<string>) norm_list", "cast(null as map<string,map<string,string>>) norm_map", "norm_str signature").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        schema = spark.createDataFrame([], kind).schema
        remerge.remerge(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/cp", given, schema).awaitTermination()
        return {r["package_id"]: r["norm_str"] for r in remerge.current(spark, f"{tmp_path}/out").collect()}

    assert land([("a", 1, 10, "old"), ("b", 2, 10, "same")]) == {"a": "old", "b": "same"}
    assert land([("a", 3, 20, "new")]) == {"a": "new", "b": "same"}
