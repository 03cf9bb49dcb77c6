import json

import pytest

from tallyweave.sources import config

GOOD = {"fields": {"account": {"sources": ["Acc"], "criticality": "critical", "cleaner": "upper_clean"}}, "duplicate_key": ["account"], "thresholds": {"critical": 0.7}}


def test_every_fault_of_a_document_is_named():
    bad = {
        "fields": {"a": {"sources": []}, "b": "x", "c": {"sources": ["C"], "criticality": "high", "cleaner": "soap", "weight": 1}}, "line_items": {"fields": {}},
        "duplicate_key": ["zz"], "thresholds": {"critical": 2, "optional": True, "often": 0.1}, "colour": 1, "tail": "x",
    }
    with pytest.raises(config.ConfigError) as told:
        config.category(bad)
    for part in ("unknown key colour", "fields.a.sources", "fields.b: is no mapping", "criticality: high", "cleaner: soap", "unknown key weight", "line_items.table", "duplicate_key: zz", "thresholds.critical: 2", "thresholds.optional: True", "unknown key often", "tail: is no list"):
        assert part in str(told.value), part
    for content in ("- a", "[1]", "fields: [", "{"):
        with pytest.raises(config.ConfigError):
            config.category(config.parsed(content))
    with pytest.raises(config.ConfigError, match="fields: names no field"):
        config.category({})


def test_a_category_from_a_file_drives_the_flow(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(GOOD, indent=1))
    own = config.read_category(spark, f"{tmp_path}/c.json")
    assert own.thresholds.critical == 0.7 and own.thresholds.optional == config.Thresholds().optional
    docs = spark.createDataFrame([("d1", '{"fields":{"Acc":{"valueString":"x 1","confidence":0.5}}}'), ("d2", '{"fields":{"Acc":{"valueString":"X 1"}}}'), ("d3", "{}")], "source_file string, json string")
    rows = own.bronze(docs)
    assert rows.columns == ["source_file", "line_id", "account", "account_confidence"]
    got = {x.source_file: (x.account, x.duplicate_status) for x in own.marked(rows).collect()}
    assert got == {"d1": ("X 1", "PRIMARY"), "d2": ("X 1", "DUPLICATE"), "d3": (None, "PRIMARY")}
    waste = config.own_category("waste")
    assert waste.fields.table == "Items" and waste.duplicate_key == ("account", "total", "qty", "waste")
    with pytest.raises(config.ConfigError, match="no document"):
        (tmp_path / "none").mkdir()
        config.read_category(spark, f"{tmp_path}/none")
