from pathlib import Path

import docloom
from docloom.operators import rules

FIELDS = Path(docloom.__file__).parent / "conf" / "fields.yaml"


def test_fixed_rules_come_first_and_names_are_unique():
    specs = {s.field: s for s in rules.load(FIELDS)}
    assert [r.name for r in specs["product"].rules if r.kind == "pattern"] == ["computing_devices", "dell_laptops", "category_list", "devices"]
    for s in specs.values():
        names = [(r.kind, r.name) for r in s.rules]
        assert len(names) == len(set(names))
    assert sum(len(s.rules) for s in specs.values()) == 43 + 47


def test_fixed_patterns_find_their_wordings(spark):
    texts = ["Delivery within 30 days of Award.", "Dell Latitude 5540 and WD22TB4", "Solicitation Due 12-JAN-2024 10:00:00", "The offer uses white glove services for all sites."]
    rows = [(str(i), i, "f", "master_rfp", 40, 0, "p1.b1", 1, "text", None, t, False) for i, t in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "doc_id string, doc_ord int, file_name string, doc_type string, precedence int, block_ord int, block_id string, page_no int, kind string, section string, text string, synthetic boolean")
    specs = rules.load(FIELDS)
    found = rules.finish(rules.from_patterns(rules.pattern_hits(blocks, specs)).unionByName(rules.from_sentences(rules.sentence_hits(blocks, specs))))
    got = {(r["doc_id"], r["rule"]): r["raw"] for r in found.collect()}
    assert got["0", "delivery_within_days"] == "30 days of Award"
    assert got["1", "latitude_model"] == "Dell Latitude 5540" and got["1", "dock_model"] == "WD22TB4"
    assert got["2", "ariba_solicitation_due"] == "12-JAN-2024 10:00:00"
    assert got["3", "white_glove"] == "The offer uses white glove services for all sites."
