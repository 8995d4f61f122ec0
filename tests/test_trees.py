"""Doubling over trees and chains, components in few rounds, cycle paths, overrides, clusters."""

import random
from collections import deque

import pytest

from factloom.functions import shared
from factloom.operators import dead, graph, metrics


@pytest.fixture
def rounds(monkeypatch):
    """How many tables of rounds were written."""
    made = []
    write = shared.Rounds.write
    monkeypatch.setattr(shared.Rounds, "write", lambda self, df: (made.append(self.path), write(self, df))[1])
    return made


def edges(spark, pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def test_sums_of_a_chain_of_a_thousand_take_about_ten_rounds(spark, rounds):
    chain = spark.range(1, 1001).selectExpr("id as node", "id - 1 as parent", "id % 2 as weight")
    got = {r["node"]: r["total"] for r in shared.sums_to_root(chain, "chain").collect()}
    assert got == {k: (k + 1) // 2 for k in range(1, 1001)} and len(rounds) <= 12
    with pytest.raises(ValueError, match="cycle"):
        shared.sums_to_root(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "node long, parent long, weight long"), "ring")
    assert shared.sums_to_root(chain.limit(0), "none").count() == 0


def reach(pairs):
    onward = {}
    for a, b in pairs:
        onward.setdefault(a, set()).add(b)
    out = {}
    for start in {x for p in pairs for x in p}:
        seen, todo = set(), deque([start])
        while todo:
            for b in onward.get(todo.popleft(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[start] = seen
    return out


def plain_components(pairs):
    r = reach(pairs)
    return {a: min(b for b in r[a] if a in r[b]) for a in r if a in r[a]}


GRAPHS = [
    [(1, 2), (2, 3), (3, 1)],  # a ring without any other edge
    [(1, 2), (2, 3), (3, 4), (4, 2), (4, 5), (5, 6), (6, 7), (7, 5), (9, 1)],
    [(5, 5), (5, 6), (6, 7), (7, 5), (8, 8)],
    [(1, 2), (2, 1), (1, 3), (3, 1), (3, 4)],
    [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)],
]


@pytest.mark.parametrize("on_driver", [0, 100_000])
def test_components_of_small_graphs_side_by_side(spark, monkeypatch, on_driver):
    monkeypatch.setattr(graph, "DRIVER_EDGES", on_driver)
    pairs = [(a + 20 * k, b + 20 * k) for k, g in enumerate(GRAPHS) for a, b in g]
    assert {r["node"]: r["component"] for r in graph.cycles(edges(spark, pairs)).collect()} == plain_components(pairs)
    assert graph.cycles(edges(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_graphs_without_the_driver(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "DRIVER_EDGES", 0)
    rng = random.Random(seed)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(40 + 16 * seed)}
    assert {r["node"]: r["component"] for r in graph.cycles(edges(spark, pairs)).collect()} == plain_components(pairs)


def test_a_chain_of_a_thousand_between_two_cycles_takes_few_rounds(spark, monkeypatch, rounds):
    monkeypatch.setattr(graph, "DRIVER_EDGES", 0)
    pairs = [(k, k + 1) for k in range(1000)] + [(2, 0), (1000, 998), (1500, 0)] + [(2000 + k, 2000 + (k + 1) % 500) for k in range(500)]
    got = {}
    for r in graph.cycles(edges(spark, pairs)).collect():
        got.setdefault(r["component"], set()).add(r["node"])
        assert r["size"] == {0: 3, 998: 3, 2000: 500}[r["component"]]
    assert got == {0: {0, 1, 2}, 998: {998, 999, 1000}, 2000: set(range(2000, 2500))}
    assert len(rounds) < 60


def plain_paths(pairs):
    """Breadth first from each component's least node; back by least predecessors."""
    comp, out = plain_components(pairs), {}
    for c in set(comp.values()):
        inner = [(a, b) for a, b in pairs if a != b and comp.get(a) == c == comp.get(b)]
        dist, front, d = {}, {c}, 0
        while front and c not in dist:
            d += 1
            front = {b for a, b in inner if a in front and b not in dist}
            dist |= dict.fromkeys(front, d)
        if c in dist:
            path, at = [c], c
            for d in range(dist[c], 1, -1):
                at = min(a for a, b in inner if b == at and dist.get(a) == d - 1)
                path.append(at)
            out[c] = (dist[c], " > ".join(map(str, [c, *reversed(path)])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cycle_paths(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(34)} if seed else {(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (5, 1), (7, 8), (8, 7), (9, 9), (3, 7)}
    got = {r["component"]: (r["length"], r["path"]) for r in graph.cycle_paths(edges(spark, pairs)).collect()}
    assert got == plain_paths(pairs)
    if not seed:
        assert got == {1: (3, "1 > 2 > 3 > 1"), 7: (2, "7 > 8 > 7")}


def test_overrides_of_a_diamond_and_a_chain_of_a_thousand(spark):
    pairs = [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("e", "i"), ("e", "a"), (None, "a"), ("x", None)]
    pairs += [(f"n{k + 1:04}", f"n{k:04}") for k in range(1000)]
    e = spark.createDataFrame(pairs, "member string, overridden string")
    roots, below = graph.overrides(e, spark.createDataFrame([("d",), ("e",), ("a",), ("n1000",), ("n0500",), ("alone",), (None,)], "member string"))
    assert sorted(map(tuple, roots.collect())) == [("a", "a"), ("alone", "alone"), ("d", "a"), ("e", "a"), ("e", "i"), ("n0500", "n0000"), ("n1000", "n0000")]
    found = {}
    for root, node in below.collect():
        found.setdefault(root, set()).add(node)
    assert found == {"a": {"b", "c", "d", "e"}, "i": {"e"}, "n0000": {f"n{k:04}" for k in range(1, 1001)}}


def test_clusters_by_fields_and_helpers(spark):
    items = [("T", m) for m in ("a", "b", "c", "d", "e")] + [("U", "one"), ("V", "p"), ("V", "q")]
    access = [("T", "a", "f2", "field"), ("T", "a", "f1", "field"), ("T", "b", "f1", "field"), ("T", "b", "help", "call"), ("T", "c", "help", "call"), ("T", "d", "f1", "call"), ("T", "zz", "f1", "field"), ("T", "e", None, "field")]
    got = graph.clusters(spark.createDataFrame(items, "scope string, item string"), spark.createDataFrame(access + access, "scope string, item string, member string, kind string"), spark.createDataFrame([("I", "x"), ("I", "y"), ("I", "x"), ("J", "x")], "scope string, item string"))
    rows = sorted((r["scope"], r["type_kind"], r["methods"], r["fields"], r["lcom4"], r["cluster"] or "", r["members"], r["shared_fields"]) for r in got.collect())
    assert rows == [
        ("I", "Interface", 2, 0, 2, "", "", ""),
        ("J", "Interface", 1, 0, 1, "", "", ""),
        ("T", "Class", 5, 2, 3, "a", "a,b,c", "f1,f2"),  # a field is no helper of the same name
        ("T", "Class", 5, 2, 3, "d", "d", ""),
        ("T", "Class", 5, 2, 3, "e", "e", ""),
        ("V", "Class", 2, 0, 2, "p", "p", ""),
        ("V", "Class", 2, 0, 2, "q", "q", ""),
    ]


def bodies(spark, texts):
    """Tokens of small bodies: words are names, digits literals, all else by itself."""
    rows = []
    for body, text in texts.items():
        for at, t in enumerate(text.split()):
            rows.append((body, at, "identifier" if t[0].isalpha() else "literal" if t[0].isdigit() else f"mark{t}", t))
    return spark.createDataFrame(rows, "body string, at int, kind string, text string")


def test_forms_of_bodies(spark):
    texts = {"p": "x = y + 1", "q": "b = a + 1", "r": "b = a + 2", "s": "b = b + 1", "t": "x = y - 1", "u": "y = x + 1 + x", "v": "a = c + 1 + c", "w": "a = c + 1 + a", "big": " ".join(["a"] * 12)}
    got = {r["body"]: (r["nodes"], r["form"]) for r in dead.canonical_bodies(bodies(spark, texts), most_nodes=11).collect()}
    assert got["big"] == (12, None) and len(got) == 9
    groups = {}
    for body, (_, form) in got.items():
        groups.setdefault(form, set()).add(body)
    assert sorted(map(sorted, groups.values())) == [["big"], ["p", "q"], ["r"], ["s"], ["t"], ["u", "v"], ["w"]]
    lines = spark.createDataFrame([(b, 5 if b in "pq" else 20) for b in texts], "body string, lines int")
    rows = dead.duplicate_bodies(bodies(spark, texts), lines, 10, 11).collect()
    assert [(r["members"], r["lines"], r["first"], r["left_out"]) for r in rows] == [(2, 20, "u", 1)] and len(rows[0]["hash"]) == 16
    assert [r["first"] for r in dead.duplicate_bodies(bodies(spark, texts), lines, 1, 11, limit=1).collect()] == ["u"]


def nested(kinds, member="m"):
    """Nodes of a chain of kinds, each below the last; a pair (kind, up) goes further up."""
    return [(member, k, k - 1 if k else None, kind) for k, kind in enumerate(kinds)]


def deepest(spark, rows):
    return max(r["depth"] for r in metrics.nesting(spark.createDataFrame(rows, "member string, node long, parent long, kind string")).collect())


def test_nesting(spark):
    block = "Block"
    six = [block, "IfStatement", block, "ForStatement", block, "WhileStatement", block, "SwitchStatement", "SwitchSection", "UsingStatement", block, "TryStatement", block, "ReturnStatement"]
    assert deepest(spark, nested(six)) == 5  # the using is the section's own statement, and counts with it
    assert deepest(spark, nested([block, "ReturnStatement", "ConditionalExpression", "CoalesceExpression", "IdentifierName"])) == 0
    assert deepest(spark, nested([block, "IfStatement", block, "LocalFunctionStatement", block, "IfStatement", block])) == 2
    assert deepest(spark, nested([block, "IfStatement", "ElseClause", "IfStatement", "ElseClause", "IfStatement", block])) == 2
    assert deepest(spark, nested([block, "IfStatement", "IfStatement", "IfStatement", "ExpressionStatement"])) == 2
    assert deepest(spark, nested([block, "TryStatement", "CatchClause", block, "ForEachStatement", "ExpressionStatement"])) == 2
    assert deepest(spark, nested([block, "SwitchExpression", "SwitchExpressionArm", "InvocationExpression"])) == 1
    assert deepest(spark, nested([block, "WhileStatement", "LogicalAndExpression"])) == 0
    assert deepest(spark, nested(["WhileStatement", block] * 500)) == 500


def test_method_metrics(spark):
    rows = nested(["Block", "IfStatement", "Block", "LogicalAndExpression"], "m") + nested(["Block"], "k")
    nodes = spark.createDataFrame(rows, "member string, node long, parent long, kind string")
    members = spark.createDataFrame([("m", 3, 12), ("k", 5, 5), ("none", 7, 8)], "member string, first_line int, last_line int")
    got = [(r["member"], r["complexity"], r["loc"], r["nesting"]) for r in metrics.method_metrics(members, nodes).collect()]
    assert got == [("m", 3, 10, 1), ("k", 1, 1, 0), ("none", 1, 2, 0)]
    assert [r["member"] for r in metrics.method_metrics(members, nodes, least=2).collect()] == ["m"]
    assert metrics.method_metrics(members, nodes, limit=2).count() == 2
