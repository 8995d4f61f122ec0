import random

import pytest

from factloom.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_coupling_of_a_chain_and_a_loner(spark):
    nodes = spark.createDataFrame([(x,) for x in "ABCD"], "node string")
    got = {r["node"]: (r["ca"], r["ce"], r["instability"], r["classification"]) for r in graph.coupling(nodes, edges(spark, [("A", "B"), ("B", "C"), ("A", "B"), ("B", "B")])).collect()}
    assert got == {"A": (0, 1, 1.0, "unstable"), "B": (1, 1, 0.5, "balanced"), "C": (1, 0, 0.0, "stable"), "D": (0, 0, 0.0, "isolated")}
    top = graph.coupling(nodes, edges(spark, [("A", "B"), ("B", "C")]), limit=2).collect()
    assert [r["node"] for r in top] == ["A", "B"]


def plain_closure(pairs):
    seen = set(pairs)
    while True:
        more = {(a, d) for a, b in seen for c, d in pairs if b == c} - seen
        if not more:
            return seen
        seen |= more


@pytest.mark.parametrize("seed", range(3))
def test_closure_and_cycles_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(14)}
    want = plain_closure(pairs)
    assert set(map(tuple, graph.closure(edges(spark, list(pairs))).collect())) == want
    members = {a: min(b for b in {x for x, _ in want} if (a, b) in want and (b, a) in want) for a in {x for x, _ in want} if (a, a) in want}
    assert {r["node"]: r["component"] for r in graph.cycles(edges(spark, list(pairs))).collect()} == members
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(12)], "node string")
    assert all(0 <= r["instability"] <= 1 for r in graph.coupling(nodes, edges(spark, list(pairs))).collect())


def test_cycle_of_two(spark):
    got = graph.cycles(edges(spark, [("A", "B"), ("B", "A"), ("B", "C")])).collect()
    assert sorted((r["node"], r["component"], r["size"]) for r in got) == [("A", "A", 2), ("B", "A", 2)]


def test_dependencies_keep_ends_without_members(spark):
    uses = edges(spark, [("a", "b"), ("a", "b"), ("a", "a"), ("b", "c")])
    e = graph.dependency_edges(uses)
    assert sorted(map(tuple, e.collect())) == [("a", "b", 2), ("b", "c", 1)]
    members = spark.createDataFrame([("a",), ("a",), ("z",)], "node string")
    assert sorted(map(tuple, graph.dependency_nodes(members, e).collect())) == [("a", 2), ("b", 0), ("c", 0), ("z", 1)]


def test_lcom4(spark):
    rows = [("T", "m1", "f1"), ("T", "m2", "f1"), ("T", "m3", "f2"), ("U", "m1", "f1"), ("V", "m1", "f"), ("V", "m2", "g"), ("V", "m3", "f"), ("V", "m3", "g")]
    got = {r["scope"]: r["lcom4"] for r in graph.cohesion(spark.createDataFrame(rows, "scope string, item string, member string")).collect()}
    assert got == {"T": 2, "V": 1}


def test_components_against_plain_search(spark):
    """Random access, with nulls and repeats: least reachable items by going round until nothing changes."""
    rng = random.Random(5)
    rows = [(rng.choice("ST"), rng.randrange(30), rng.randrange(40)) for _ in range(45)]
    label = {(s, i): i for s, i, _ in rows}
    while True:
        low = {}
        for s, i, m in rows:
            low[s, m] = min(low.get((s, m), 99), label[s, i])
        new = {k: min([v] + [low[s, m] for s, i, m in rows if (s, i) == k]) for k, v in label.items()}
        if new == label:
            break
        label = new
    access = spark.createDataFrame(rows + rows[:5] + [(None, 1, 2), ("S", None, 2), ("S", 77, None)], "scope string, item int, member int")
    assert {(r["scope"], r["item"]): r["label"] for r in graph.shared_components(access).collect()} == label


def test_long_chain_is_one_component(spark):
    rows = [("T", f"m{k:02}", f"f{k + d}") for k in range(15) for d in (0, 1)]
    got = graph.cohesion(spark.createDataFrame(rows, "scope string, item string, member string")).collect()
    assert [r["lcom4"] for r in got] == [1]


def test_hierarchy(spark):
    e = spark.createDataFrame([("Circle", "Shape"), ("Rectangle", "Shape"), ("Square", "Rectangle")], "child string, parent string")
    assert sorted(map(tuple, graph.hierarchy(e, "Shape").collect())) == [("Circle", "Shape", 1), ("Rectangle", "Shape", 1), ("Square", "Rectangle", 2)]
    assert sorted(map(tuple, graph.ancestors(e, "Square").collect())) == [("Rectangle", 1), ("Shape", 2)]
    assert graph.hierarchy(e, "Shape", most_depth=1).count() == 2


def test_callers_keep_sites_and_callees_don_t(spark):
    calls = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("x", "b", 3), ("x", "b", 4)], "caller string, callee string, site int")
    assert sorted(map(tuple, graph.callers_callees(calls, "x").collect())) == [("callee", "b", 3), ("caller", "a", 1), ("caller", "a", 2)]


def test_chains_of_a_thousand(spark):
    """No walk ends early: hierarchy, closure from a start, and components over a chain of 1,000."""
    n = 1000
    chain = spark.range(n).selectExpr("format_string('n%04d', id + 1) as child", "format_string('n%04d', id) as parent")
    down = graph.hierarchy(chain, "n0000")
    assert down.count() == n and down.filter("int(substr(node, 2)) = depth").count() == n
    assert graph.hierarchy(chain, "n0000", most_depth=300).count() == 300
    e = chain.selectExpr("parent as src", "child as dst")
    starts = spark.createDataFrame([("n0010",)], "node string")
    assert graph.closure(e, starts).count() == n - 10
    access = spark.range(n).selectExpr("'T' as scope", "format_string('m%04d', id) as item", "explode(array(id, id + 1)) as member")
    assert [r["lcom4"] for r in graph.cohesion(access).collect()] == [1]


def test_closure_of_a_long_path_and_its_cycle(spark):
    e = spark.range(120).selectExpr("id as src", "id + 1 as dst")
    assert graph.closure(e).count() == 120 * 121 // 2
    around = spark.range(20).selectExpr("id as src", "(id + 1) % 20 as dst").union(spark.range(20, 28).selectExpr("id as src", "id + 1 as dst")).union(spark.createDataFrame([(3, 20), (27, 27), (30, 31), (31, 30)], "src long, dst long"))
    got = {r["node"]: (r["component"], r["size"]) for r in graph.cycles(around).collect()}
    assert got == {k: (0, 20) for k in range(20)} | {27: (27, 1), 30: (30, 2), 31: (30, 2)}


def test_hierarchy_with_several_ways_and_with_a_cycle(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("c", "b"), ("e", "d")], "child string, parent string")
    want = {("b", "a", 1), ("c", "a", 1), ("c", "b", 2), ("d", "b", 2), ("d", "c", 2), ("d", "c", 3), ("e", "d", 3), ("e", "d", 4)}
    assert {tuple(r) for r in graph.hierarchy(e, "a").collect()} == want
    with pytest.raises(ValueError):
        graph.hierarchy(spark.createDataFrame([("b", "a"), ("a", "b")], "child string, parent string"), "a")


def test_empty_graphs(spark):
    none = edges(spark, [])
    assert graph.closure(none).count() == graph.cycles(none).count() == 0
    assert graph.cohesion(spark.createDataFrame([], "scope string, item string, member string")).count() == 0
    assert graph.hierarchy(none.toDF("child", "parent"), "a").count() == 0
