"""Sinks, the command line, providers and blocks from parsed pages."""

import json

import pytest

from docloom import __main__ as command
from docloom.operators import providers, report
from docloom.sources import spans
from tests.test_operators import PAGE


class Fake:
    name, model = "fake", "gpt-4o"

    def available(self):
        return True

    def extract_field(self, text, field, description):
        if field == "broken":
            raise RuntimeError("no answer")
        yield {"value": text.upper(), "confidence": 0.8, "prompt_tokens": 1000, "completion_tokens": 200}


def test_providers_fill_gaps_and_failures_cost_a_field(spark):
    docs = spark.createDataFrame([("d1", "one"), ("d2", None)], "doc_id string, text string")
    specs = spark.createDataFrame([("title", "the title"), ("broken", None)], "field string, description string")
    gaps = docs.select("doc_id").crossJoin(specs.select("field"))
    found = providers.fill(gaps, docs, specs, Fake(), pause=0.0).cache()
    rows = {(r["doc_id"], r["field"]): r for r in found.collect()}
    assert rows["d1", "title"]["value"] == "ONE" and rows["d2", "title"]["value"] == "" and rows["d1", "broken"]["error"] == "RuntimeError: no answer"
    total = providers.usage(found, "gpt-4o").first()
    assert (total["calls"], total["failed"], total["tokens"], total["cost_usd"]) == (4, 2, 2400, 0.009)
    assert providers.fill(gaps, docs, specs, None).count() == 0
    assert providers.usage(providers.fill(gaps, docs, specs, None), "gpt-4o").first()["tokens"] == 0


def test_blocks_from_spans_and_tables(spark):
    def span(page, x, y, text, size=10.0):
        return ("d", page, x, y, x + 50, y + 10, text, size, 600.0)

    rows = [span(p, 10.0, 5.0, "Running head") for p in (1, 2, 3)]
    rows += [span(1, 10.0, 50.0, "Scope", 14.0), span(1, 10.0, 80.0, "Bid Num"), span(1, 61.0, 80.5, "ber: 77-1"), span(1, 10.0, 100.0, "- a bullet"), span(2, 10.0, 40.0, "Due Date:"), span(2, 10.0, 60.0, "July 9"), span(3, 10.0, 40.0, "the end")]
    tables = spark.createDataFrame([("d", 1, 1, [["Item", None], ["", " "], ["Dock  x", "3"]]), ("d", 2, 1, [["alone"]])], "doc_id string, page_no int, table_no int, rows array<array<string>>")
    given = spark.createDataFrame(rows, "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double, text string, size double, page_width double")
    got = [(r["block_ord"], r["block_id"], r["kind"], r["text"], r["section"], r["label"], r["label_value"]) for r in spans.blocks(given, tables).orderBy("block_ord").collect()]
    assert got == [
        (0, "p1.b1", "heading", "Scope", "Scope", None, None),
        (1, "p1.b2", "text", "Bid Number: 77-1", "Scope", "Bid Number", "77-1"),
        (2, "p1.b3", "list_item", "- a bullet", "Scope", None, None),
        (3, "p1.b4", "table", "Item | \nDock x | 3", "Scope", None, None),
        (4, "p2.b1", "text", "Due Date:", "Scope", "Due Date", "July 9"),
        (5, "p2.b2", "text", "July 9", "Scope", None, None),
        (6, "p3.b1", "text", "the end", "Scope", None, None),
    ]
    assert spans.blocks(given.limit(0), tables).count() == 1


def test_evaluation_and_consolidated_json(spark):
    scores = spark.createDataFrame([("p", "a", "equals", "1", "1", True), ("p", "b", "equals", "1", None, False), ("q", "a", "absent", None, None, True)], "package_id string, field string, check string, expected string, actual string, passed boolean")
    got = {x["package_id"]: x for x in (json.loads(r["value"]) for r in report.evaluation_json(scores).collect())}
    assert got["p"]["accuracy"] == 0.5 and got["p"]["failed"][0]["field"] == "b" and got[None]["passed"] == 2 and got["q"]["failed"] == []
    line = report.consolidated_json(spark.createDataFrame([('p "1"', '{"x":1}')], "package_id string, json string")).first()["value"]
    assert json.loads(line) == {"package_id": 'p "1"', "result": {"x": 1}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("bids")
    for i in (1, 2):
        (path / f"bid{i}").mkdir()
        (path / f"bid{i}" / "notice.html").write_bytes(PAGE.replace(b"BPM044557", b"BPM04455%d" % i))
    return path


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(command, "session", lambda: spark)
    gold = tmp_path / "gold.jsonl"
    gold.write_text(json.dumps({"package_id": "none", "bid_number": "none", "field": "x", "check": "absent", "expected": ""}))
    command.main(["run", f"file://{folder}", "--out", f"file://{tmp_path}/out", "--gold", f"file://{gold}"])
    assert len(list((tmp_path / "out/per_document").glob("doc_id=*"))) == 2
    packages = [json.loads(x) for p in (tmp_path / "out/all").glob("part-*") for x in p.read_text().splitlines()]
    assert {d["doc_type"] for p in packages for d in p["result"]["documents"]} and list((tmp_path / "out/evaluation").glob("part-*"))
    for p in (tmp_path / "out/per_document").rglob("part-*.txt"):
        assert "file_name" in json.loads(p.read_text())
    command.main(["probe", f"file://{folder}", "--labels", "--text"])
    assert "BPM044551" in capsys.readouterr().out
