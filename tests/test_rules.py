import os

import pytest
import yaml

from docsieve.rules import (
    RuleError, RuleStore, drop_layout_whitespace, load_rules, parse_category)
from docsieve.sources.rule_tables import category_table, keyword_table, mandatory_table, pattern_table

SLUGS = ["invoice", "purchase_order", "receipt", "contract", "bank_statement", "report", "resume"]

# Fixed values: (primary, secondary, exclusion, patterns, mandatory, optional, threshold, minimum).
INVENTORY = {
    "invoice": (18, 37, 9, 10, 3, 7, 0.60, 2), "purchase_order": (18, 32, 6, 9, 3, 6, 0.60, 2),
    "receipt": (18, 41, 9, 8, 3, 5, 0.65, 2), "contract": (19, 43, 7, 7, 3, 4, 0.55, 3),
    "bank_statement": (19, 37, 6, 9, 4, 5, 0.65, 3), "report": (20, 41, 7, 7, 2, 5, 0.50, 3),
    "resume": (18, 44, 10, 8, 1, 7, 0.60, 3)}


def test_bundled_inventory(rules):
    assert rules.slugs == SLUGS
    for c in rules:
        assert (len(c.primary), len(c.secondary), len(c.exclusion), len(c.patterns), len(c.mandatory),
                len(c.optional), c.threshold, c.min_primary) == INVENTORY[c.slug]
        assert c.min_primary <= len(c.primary)
        assert set(c.mandatory) | set(c.optional) == {p.field for p in c.patterns}
        assert all(k == k.lower() for k in c.all_keywords)
        assert len(c.all_keywords) == len(c.primary) + len(c.secondary)


def write(folder, name, **changes):
    raw = {"category": name, "display_name": name.title(), "confidence_threshold": 0.5,
           "primary_keywords": ["Alpha", "beta"], **changes}
    path = folder / f"{name}.yaml"
    path.write_text(yaml.safe_dump({k: v for k, v in raw.items() if v is not None}))
    stamp = path.stat().st_mtime + write.tick
    write.tick += 10
    os.utime(path, (stamp, stamp))


write.tick = 0


def index(folder, *entries):
    (folder / "categories.yaml").write_text(yaml.safe_dump({"categories": [
        {"category": e, "file": f"{e}.yaml"} if isinstance(e, str) else e for e in entries]}))


def test_defaults_and_normalisation(tmp_path):
    write(tmp_path, "one", secondary_keywords=[30, False, "MiXed"], regex_patterns={"f": "(x)", "g": {"pattern": "y", "group": 0}})
    index(tmp_path, "one")
    c = RuleStore(tmp_path).get("one")
    assert (c.primary_weight, c.secondary_weight, c.min_primary) == (2, 1, 2)
    assert c.primary == ("alpha", "beta") and c.secondary == ("30", "false", "mixed")
    assert [(p.field, p.group) for p in c.patterns] == [("f", 1), ("g", 0)]
    assert RuleStore(tmp_path).get("other") is None


def test_missing_index_and_missing_file(tmp_path):
    with pytest.raises(FileNotFoundError):
        RuleStore(tmp_path).load()
    write(tmp_path, "one")
    index(tmp_path, "one", "two")
    assert RuleStore(tmp_path).load().slugs == ["one"]


def test_a_deleted_file_is_skipped_even_if_cached(tmp_path):
    write(tmp_path, "one")
    write(tmp_path, "two")
    index(tmp_path, "one", "two")
    store = RuleStore(tmp_path)
    assert store.load().slugs == ["one", "two"]
    (tmp_path / "two.yaml").unlink()
    assert store.load().slugs == ["one"]


def test_disabled_entries_and_index_slug(tmp_path):
    write(tmp_path, "one")
    index(tmp_path, {"category": "renamed", "file": "one.yaml"},
          {"category": "off", "file": "one.yaml", "enabled": False})
    assert RuleStore(tmp_path).load().slugs == ["renamed"]


def test_two_slugs_may_share_a_file(tmp_path):
    write(tmp_path, "one")
    index(tmp_path, {"category": "a", "file": "one.yaml"}, {"category": "b", "file": "one.yaml"})
    assert RuleStore(tmp_path).load().slugs == ["a", "b"]


def test_hot_reload_and_broken_edit(tmp_path):
    write(tmp_path, "one")
    index(tmp_path, "one")
    store = RuleStore(tmp_path)
    assert store.get("one").threshold == 0.5
    write(tmp_path, "one", confidence_threshold=0.7)
    assert store.get("one").threshold == 0.7
    write(tmp_path, "one", confidence_threshold=7)
    assert store.get("one").threshold == 0.7
    assert store.reload().slugs == []
    write(tmp_path, "one", confidence_threshold=0.9)
    assert store.reload().get("one").threshold == 0.9


@pytest.mark.parametrize("change", [
    {"confidence_threshold": None}, {"confidence_threshold": -0.1}, {"display_name": None},
    {"regex_patterns": {"f": "("}}, {"regex_patterns": {"f": 5}}, {"mandatory_fields": "email"},
    {"scoring": {"primary_weight": "two"}}])
def test_unusable_categories(change):
    raw = {"category": "c", "display_name": "C", "confidence_threshold": 0.5, **change}
    with pytest.raises(RuleError):
        parse_category({k: v for k, v in raw.items() if v is not None})


def test_group_out_of_range_drops_the_field():
    c = parse_category({"category": "c", "display_name": "C", "confidence_threshold": 0.5,
                        "regex_patterns": {"good": "(a)", "bad": {"pattern": "(a)", "group": 2}}})
    assert [p.field for p in c.patterns] == ["good"]


def test_variants():
    standard, corrected = load_rules(), load_rules(variant="corrected")
    assert "po" in standard.get("invoice").secondary and "po #" in corrected.get("invoice").secondary
    assert sum("\n" in p.pattern for c in standard for p in c.patterns) == 10
    assert not any("\n" in p.pattern for c in corrected for p in c.patterns)
    assert drop_layout_whitespace("a [ x]\n  b\\ c") == "a [ x]\n  b\\ c".replace("a [", "a[").replace("\n  ", "")
    with pytest.raises(ValueError):
        RuleStore(variant="other")


def test_rule_tables(spark, rules):
    assert category_table(spark, rules).count() == 7
    assert keyword_table(spark, rules).count() == sum(sum(v[:3]) for v in INVENTORY.values())
    assert pattern_table(spark, rules).count() == 58
    assert mandatory_table(spark, rules).filter("category = 'bank_statement'").count() == 4
