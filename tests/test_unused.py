"""Each exclusion rule by a row that only it excludes; references under a name; mirrored properties."""

import pytest

from factloom.operators import mirrored, unused

COLUMNS = "symbol string, name string, kind string, container string, accessibility string, method_kind string, type_kind string, parameters string, is_static boolean, is_record boolean, is_override boolean, is_extension boolean"
PLAIN = {"kind": "method", "container": "T", "accessibility": "Private", "method_kind": "Ordinary", "type_kind": "Class", "is_static": False, "is_record": False, "is_override": False, "is_extension": False}


def symbols(spark, *rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple((PLAIN | {"symbol": s, "name": s} | more).get(c) for c in names) for s, more in rows], COLUMNS)


TYPE = {"kind": "type", "container": None, "method_kind": None, "accessibility": "Internal"}


@pytest.fixture
def facts(spark):
    s = symbols(
        spark,
        ("T", TYPE), ("AppTests", TYPE), ("App2", TYPE), ("inFixture", {"container": "App2"}), ("AModelSnapshot", TYPE), ("Deep", TYPE), ("Middle", TYPE), ("inDeep", {"container": "Deep"}),
        ("Ware", TYPE), ("Invoke", {"container": "Ware", "accessibility": "Public", "parameters": "HttpContext,int"}), ("Health", TYPE), ("Write", {"container": "Health", "accessibility": "Public", "parameters": "HttpContext,HealthReport"}),
        ("NoWare", TYPE), ("invoke", {"container": "NoWare", "parameters": "HttpContext"}), ("Tools", TYPE), ("migrated", {}), ("pub", {"accessibility": "Public"}), ("enum", {"kind": "field", "type_kind": "Enum"}), ("rec", {"kind": "property", "is_record": True}),
        ("ctor", {"method_kind": "Constructor"}), ("impl", {}), ("over", {"is_override": True}), ("Main", {"is_static": True}), ("notMain", {"is_static": True}), ("fact", {}), ("Host", TYPE | {"is_static": True}), ("ext", {"container": "Host", "is_extension": True}),
        ("plain", {}), ("nulls", {k: None for k in PLAIN} | {"name": None}),
    )
    attributes = spark.createDataFrame([("App2", "TestClassAttribute"), ("Tools", "McpServerToolTypeAttribute"), ("migrated", "MigrationAttribute"), ("fact", "FactAttribute"), ("plain", "Obsolete"), ("T", None)], "symbol string, attribute string")
    bases = spark.createDataFrame([("Deep", "Middle", "Middle"), ("Middle", None, "PageModel"), ("T", None, "Object"), ("NoWare", "T", "T")], "symbol string, base string, base_name string")
    return s, attributes, bases, spark.createDataFrame([("impl",)], "symbol string")


def test_each_rule_excludes_its_rows(facts):
    by_rule = {}
    for rule in unused.RULES:
        by_rule[rule] = {r["symbol"] for r in unused.exclusions(*facts, rules=(rule,)).collect()}
    assert by_rule == {
        "test-fixture": {"AppTests", "App2"},
        "convention-invoked": {"AppTests", "App2", "inFixture", "AModelSnapshot", "Deep", "Middle", "inDeep", "Ware", "Invoke", "Health", "Write", "Tools", "migrated"},
        "public": {"Invoke", "Write", "pub"},
        "enum-member": {"enum"},
        "record-property": {"rec"},
        "method-kind": {"ctor"},
        "interface-implementation": {"impl"},
        "override": {"over"},
        "entry-point": {"Main"},
        "framework-attribute": {"fact"},
        "in-test-fixture": {"inFixture"},
        "extension-host": {"Host"},
    }


def test_reasons_are_the_first_rules(facts):
    got = {r["symbol"]: r["reason"] for r in unused.exclusions(*facts, rules=unused.RULES).collect()}
    assert got["AppTests"] == "test-fixture" and got["inFixture"] == "convention-invoked" and got["Invoke"] == "convention-invoked" and got["pub"] == "public" and got["Host"] == "extension-host"
    assert not {"plain", "nulls", "notMain", "invoke", "NoWare"} & set(got)
    assert unused.exclusions(*facts, rules=()).count() == 0
    with pytest.raises(ValueError, match="no such rules"):
        unused.exclusions(*facts, rules=("other",))


def test_references_under_a_name_count_for_what_may_be_bound_elsewhere(spark):
    s = symbols(
        spark,
        ("used", {}), ("alone", {"name": "Run"}), ("over1", {"name": "Go", "parameters": "int"}), ("over2", {"name": "Go", "parameters": "string"}), ("ext", {"name": "Ext", "is_extension": True}),
        ("prop", {"kind": "property", "name": "P"}), ("iface", {"type_kind": "Interface"}), ("open", {"accessibility": "Public"}), ("json", {"kind": "property"}), ("gone", {}),
    )
    refs = spark.createDataFrame([("used",), ("used",), ("unknown",)], "target string")
    outside = spark.createDataFrame([("T", "Run", None), ("T", "Go", "string"), ("T", "Ext", None), ("T", "P", None), ("Other", "Go", "int")], "container string, name string, parameters string")
    attributes = spark.createDataFrame([("json", "JsonPropertyNameAttribute")], "symbol string, attribute string")
    excluded = spark.createDataFrame([("gone", "override")], "symbol string, reason string")
    got = {r["symbol"]: r["confidence"] for r in unused.unused(s, refs, outside, excluded, attributes).collect()}
    assert got == {"alone": "high", "over1": "high", "prop": "high", "iface": "low", "open": "medium", "json": "low"}


def test_mirrored_properties(spark):
    types = spark.createDataFrame([("D", "Order", False), ("C", "OrderDto", False), ("R", "Rec", True), ("N", "Other", False), ("M", "OrderMapper", False), ("H", "OrderHelper", False)], "type string, name string, is_record boolean")
    properties = spark.createDataFrame([("D", "Total", "total"), ("D", "Note", None), ("D", "Gone", None), ("C", "Total", None), ("C", "Note", None), ("R", "Sum", "total"), ("N", "Total", "total"), ("D", "Both", None), ("C", "Both", None)], "type string, property string, json_name string")
    starts = spark.createDataFrame([("D", p) for p in ("Total", "Note", "Gone", "Both")], "type string, property string")
    methods = [
        ("M", 1, "ToDto", "OrderDto ToDto(Order o)", "new OrderDto { Total = o.Total, Both = o.Both }"), ("M", 2, "ToRec", "Rec ToRec(Order o)", "Sum"), ("M", 3, "FromDto", "Order FromDto(OrderDto d)", "Note = d.Note; Both = d.Both"),
        ("H", 1, "FromAll", "Order F(OrderDto d)", "Total"), ("M", 4, "FromOld", "Order F(OrderDto d)", "Total Note"),
    ]
    m = spark.createDataFrame(methods, "type string, ord int, name string, signature string, body string")
    pairs = sorted(map(tuple, mirrored.siblings(starts, types, properties).collect()))
    assert pairs == [("D", "Both", "C", "Both"), ("D", "Note", "C", "Note"), ("D", "Total", "C", "Total"), ("D", "Total", "R", "Sum")]
    got = sorted(map(tuple, mirrored.one_sided(starts, types, properties, m).collect()))
    # The record's first To method is ToDto, which holds Total too; Order is part of OrderDto's name, as in any text.
    assert got == [("D", "Note", "C", "Note", "From", "To"), ("D", "Total", "C", "Total", "To", "From"), ("D", "Total", "R", "Sum", "To", "From")]
    assert mirrored.one_sided(starts, types, properties, m.filter("type = 'H'")).count() == 0
