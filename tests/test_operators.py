import pytest
from pyspark.sql import functions as F

from factloom.functions.paging import page
from factloom.functions.text import canonical, html_decoded
from factloom.operators import changes, dead, deps, diagnostics, lookup, metrics, rewrites, search


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_paging(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "x int")
    got = page(df, [F.col("x")], 3, 3).collect()
    assert [(r["x"], r["total_count"], r["has_more"]) for r in got] == [(3, 5, False), (4, 5, False)]
    assert page(df, [F.col("x")], 9, 3).count() == 0
    assert [r["has_more"] for r in page(df, [F.col("x")], -4, 0).collect()] == [True]


def test_dead_fields(spark):
    fields = spark.createDataFrame([("init", True), ("read", False), ("none", False), ("both", False), ("ref", False)], "field string, initialised boolean")
    uses = spark.createDataFrame([("read", "read"), ("both", "read"), ("both", "write"), ("ref", "both")], "field string, kind string")
    assert rows(dead.dead_fields(fields, uses), "field", "usage") == [("init", "never-read"), ("none", "never-either"), ("read", "never-written")]


def test_dead_locals(spark):
    events = [("b", "x", "write", "local"), ("b", "y", "write", "local"), ("b", "y", "read", "local"), ("b", "o", "write", "out"), ("b", "_", "write", "local"), ("c", "y", "write", "local")]
    df = spark.createDataFrame(events, "body string, local string, event string, role string")
    assert rows(dead.dead_locals(df, ("out", "foreach", "using", "pattern")), "body", "local") == [("b", "x"), ("c", "y")]


def test_unused_symbols(spark):
    symbols = spark.createDataFrame([("a", "public"), ("b", "private"), ("t", "test")], "symbol string, kind string")
    refs = spark.createDataFrame([("a",)], "target string")
    got = dead.unused_symbols(symbols, refs, F.when(F.col("kind") == "public", "medium").otherwise("high"), F.col("kind") == "test")
    assert rows(got, "symbol", "confidence") == [("b", "high")]


def test_duplicates(spark):
    body = "\n".join(f"line {k}" for k in range(12))
    df = spark.createDataFrame([(1, body), (2, body.upper().replace("0", "7")), (3, body.replace("line 3", "other 3")), (4, "short"), (5, "short")], "id long, text string")
    got = dead.duplicates(df, canonical(F.col("text")), F.size(F.split("text", "\n")).cast("long"))
    assert rows(got, "members", "lines", "first") == [(2, 12, 1)]


def test_duplicate_helpers(spark):
    h = spark.createDataFrame([("x", "Ext.Do", 1), ("y", "Own.Do", 1), ("z", "Framework.Do", 1), ("w", "Ext.Do", 3)], "helper string, callee string, statements int")
    own = spark.createDataFrame([("Own.Do",)], "symbol string")
    assert rows(dead.duplicate_helpers(h, own, ("Framework.",)), "helper", "confidence") == [("w", "medium"), ("x", "high")]


def test_registrations(spark):
    data = [("A", 1, "add", "Singleton"), ("A", 2, "add", "Scoped"), ("B", 1, "try", "Singleton"), ("B", 2, "try", "Singleton"), ("C", 1, "add", "Scoped"), ("D", 1, "try", "Scoped"), ("D", 2, "add", "Scoped"), ("D", 3, "try", "Scoped")]
    df = spark.createDataFrame(data, "service string, ord int, kind string, lifetime string")
    assert rows(deps.registrations(df), "service", "ord", "status") == [("A", 1, "overridden"), ("A", 2, "winning"), ("B", 1, "winning"), ("B", 2, "shadowed"), ("D", 1, "overridden"), ("D", 2, "winning"), ("D", 3, "shadowed")]
    assert rows(deps.registration_chains(df), "service", "dead", "lifetimes_differ") == [("A", 1, True), ("B", 1, False), ("D", 2, False)]


@pytest.mark.parametrize("floor", ["Info", "Warning", "Error"])
def test_totals_do_not_follow_the_floor(spark, floor):
    df = spark.createDataFrame([("Error",), ("Warning",), ("Warning",), ("Info",), ("Hidden",)], "severity string")
    got = diagnostics.diagnostics(df, floor).collect()
    assert {(r["n_error"], r["n_warning"], r["n_info"]) for r in got} == {(1, 2, 1)}
    assert len(got) == {"Info": 4, "Warning": 3, "Error": 1}[floor]


def test_caught(spark):
    sites = spark.createDataFrame([(1, "Io"), (2, "Base"), (3, None), (4, "Other")], "id int, declared string")
    up = spark.createDataFrame([("Io", True), ("Base", False), ("Root", False)], "type string, exact boolean")
    assert rows(diagnostics.caught(sites, up, "Root"), "id", "catches_base") == [(1, False), (2, True), (3, True)]


def test_suppressed(spark):
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 12), (3, "g", 5), (4, "f", 10)], "point int, scope string, at int")
    spans = spark.createDataFrame([("f", 3, 10), ("f", 20, 30)], "scope string, lo int, hi int")
    assert rows(diagnostics.suppressed(points, spans), "point", "suppressed") == [(1, True), (2, False), (3, False), (4, True)]


def test_new_errors_are_a_set(spark):
    before, after = spark.createDataFrame([("a",)], "e string"), spark.createDataFrame([("a",), ("b",), ("b",)], "e string")
    assert rows(diagnostics.new_errors(before, after), "e") == [("b",)]


def test_enclosing_takes_the_innermost(spark):
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 50), (3, "g", 5), (4, "f", 999)], "point_id int, scope string, at int")
    spans = spark.createDataFrame([("outer", "f", 0, 100), ("inner", "f", 4, 6), ("tie", "f", 5, 7)], "span_id string, scope string, lo int, hi int")
    assert rows(lookup.enclosing(points, spans, 10), "point_id", "span_id") == [(1, "inner"), (2, "outer")]


def test_bulk_lookup(spark):
    refs = spark.createDataFrame([(1,), (1,), (2,)], "target long")
    known = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    assert rows(lookup.find_references_bulk(refs, [1, 3, 9], known), "key", "references", "error") == [(1, 2, None), (3, 0, None), (9, 0, "not found")]
    with pytest.raises(ValueError):
        lookup.find_references_bulk(refs, list(range(51)), known)


def test_symbol_search_passes(spark):
    df = spark.createDataFrame([(1, "Dog", "Zoo.Dog", "Class"), (2, "Run", "Dog.Run", "Method"), (3, "Cat", "Zoo.Cat", "Class"), (4, "Dog", "Zoo.Dog", "Class")], "id int, name string, fqn string, kind string")
    assert [(r["pass"], r["id"]) for r in lookup.symbol_search(df, "dog").collect()] == [(1, 1), (2, 2)]
    assert [r["id"] for r in lookup.symbol_search(df, "dog", kind="method").collect()] == [2]


def test_grep_scopes(spark):
    lines = spark.createDataFrame([(1, 1, "needle 12"), (1, 2, "no 123"), (2, 1, "x needle\r")], "id long, line long, text string")
    assert rows(search.grep(lines, "needle", "identifiers"), "id", "line") == [(1, 1), (2, 1)]
    assert rows(search.grep(lines, "^12$", "numbers"), "id", "line") == [(1, 1)]
    assert [r["id"] for r in search.grep(lines, ".", "ALL", limit=2).collect()] == [1, 1]
    with pytest.raises(ValueError):
        search.grep(lines, "(?=x)")


def test_semantic_search_tiers(spark):
    df = spark.createDataFrame([(1, "red box", "S", 5), (2, "blue box", "L", 50), (3, "ring", "S", 30)], "id int, name string, kind string, size int")
    words = {"small": F.col("kind") == "S"}
    assert rows(search.semantic_search(df, "all small with more than 20 size", words), "id", "match_kind") == [(3, "structured")]
    assert rows(search.semantic_search(df, "the blue box", words), "id", "match_kind") == [(2, "name-substring")]
    assert rows(search.semantic_search(df, "box &amp; ring", words), "id", "match_kind") == [(1, "token-or"), (2, "token-or"), (3, "token-or")]
    assert search.semantic_search(df, "the of", words).count() == 0


def test_complexity(spark):
    df = spark.createDataFrame([(1, "if a\nif b\nend"), (2, "")], "id int, text string")
    got = {r["id"]: (r["complexity"], r["loc"], r["maintainability"]) for r in metrics.complexity(df, "if").collect()}
    assert got[1][:2] == (3, 3) and got[2] == (1, 1, 99.87)
    nodes = spark.createDataFrame([("m", "if", 1), ("m", "for", 2), ("m", "block", 3)], "member string, kind string, depth int")
    assert tuple(metrics.node_complexity(nodes, ["if", "for"]).first()) == ("m", 3, 3)


def test_reference_map(spark):
    symbols, used = spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string"), spark.createDataFrame([("a",), ("a",)], "symbol string")
    m = metrics.reference_map(symbols, used)
    assert rows(m, "symbol", "covered") == [("a", True), ("b", False), ("c", False)]
    assert tuple(metrics.covered_share(m).first()) == (1, 2, 33.3)
    assert tuple(metrics.covered_share(m.limit(0)).first()) == (0, 0, 0.0)


def test_suggestions(spark):
    methods = spark.createDataFrame([("a", 20, 1), ("b", 12, 9)], "target string, complexity int, parameters int")
    types = spark.createDataFrame([("t", 3), ("u", 1)], "target string, lcom4 int")
    unused = spark.createDataFrame([("x", "high"), ("y", "low")], "target string, confidence string")
    got = [(r["severity"], r["kind"], r["target"]) for r in metrics.suggestions(methods, types, unused).collect()]
    assert got == [("high", "complexity", "a"), ("high", "cohesion", "t"), ("medium", "complexity", "b"), ("medium", "parameters", "b"), ("low", "unused", "x")]


def test_edits(spark):
    texts = spark.createDataFrame([(1, "hello world"), (2, "same")], "id int, text string")
    edits = spark.createDataFrame([(1, 0, 5, "bye"), (1, 11, 0, "!"), (1, 6, 5, "all")], "id int, start int, length int, insert string")
    assert rows(changes.apply_edits(texts, edits), "id", "text") == [(1, "bye all!"), (2, "same")]


def test_undo(spark):
    log = spark.createDataFrame([(1, "f"), (2, "g"), (3, "f")], "seq int, file string")
    assert rows(changes.revertible(log, 1), "seq", "file") == [(3, "f")]
    assert changes.revertible(log, 2).count() == 0
    assert rows(changes.last_change(log, "file"), "file", "seq") == [("f", 3), ("g", 2)]


def test_budget(spark):
    df = spark.createDataFrame([(1, k, 4) for k in range(5)], "p int, k int, n int")
    assert rows(changes.budgeted(df, ["p"], ["k"], F.col("n"), 12), "k", "total") == [(0, 4), (1, 8), (2, 12)]


def test_rewrites(spark):
    spans = spark.createDataFrame([("f", 1, 5), ("f", 9, 12)], "scope string, lo int, hi int")
    assert rows(rewrites.widened(spans, 4), "lo", "hi", "refused") == [(1, 9, True), (9, 16, False)]
    calls = spark.createDataFrame([("c", 0, "x"), ("c", 1, "y")], "call string, ord int, argument string")
    assert rows(rewrites.reordered(calls, [1, -1, 0], F.lit("0")), "arguments") == [("y,0,x",)]
    uses = spark.createDataFrame([("a", "Clone"), ("a", "With"), ("b", "With"), ("b", "Clone"), ("c", "Clone")], "field string, satellite string")
    assert rows(rewrites.satellites(uses), "satellites", "fields") == [("Clone,With", 2)]


def test_html_decoded(spark):
    df = spark.createDataFrame([("a &lt;b&gt; &amp;lt;",)], "t string")
    assert df.select(html_decoded(F.col("t"))).first()[0] == "a <b> &lt;"
