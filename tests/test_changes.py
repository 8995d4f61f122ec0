"""Staged changes, tests by terms, data flow, tokens: small cases with results worked out by hand."""

from pyspark.sql import functions as F

from factloom.operators import changes, dead, diagnostics, lookup, rewrites, search, testing
from factloom.sources import captured


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_difference_counts_repeats(spark):
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    after = spark.createDataFrame([("a", 1), (None, 2), ("n", 3)], "v string, k int")
    assert rows(changes.difference(before, after)) == [(1, "a", "-"), (3, "n", "+")]


def test_replaced_inserted_without(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, None)], "k int, v string")
    assert rows(changes.replaced(t, F.col("k") > 1, v="z")) == [(1, "a"), (2, "z"), (None, None)]
    assert rows(changes.inserted(t, ["k"], spark.createDataFrame([(2, "taken"), (3, "new")], "k int, v string"))) == [(1, "a"), (2, "b"), (3, "new"), (None, None)]
    assert rows(changes.without(t, ["k"], spark.createDataFrame([(1,), (1,)], "k int"))) == [(2, "b"), (None, None)]


def test_fold_is_all_or_none(spark):
    t = spark.createDataFrame([(1,), (5,)], "k int")
    steps = [lambda x: changes.replaced(x, F.col("k") == 1, k=2), lambda x: x.withColumn("k", F.col("k") + 1)]
    assert rows(changes.fold(t, steps)) == rows(changes.fold(t, steps, F.col("k") < 9)) == [(3,), (6,)]
    assert rows(changes.fold(t, steps, F.col("k") < 6)) == [(1,), (5,)]
    assert changes.fold(t.limit(0), steps, F.col("k") < 6).count() == 0


def test_file_checks_and_what_they_make(spark):
    files = spark.createDataFrame([("src/a.cs", "A"), ("src/b.cs", "B")], "path string, text string")
    asked = [
        ("create", "src/n.cs", None, "ok"), ("create", "src/a.cs", None, "exists"), ("create", "out/n.cs", None, "outside"), ("delete", "src/b.cs", None, "ok"), ("delete", "src/x.cs", None, "missing"),
        ("move", "src/a.cs", "src/c.cs", "ok"), ("move", "src/a.cs", "src/b.cs", "exists"), ("move", "src/a.cs", "src/a.cs", "same"), ("move", "src/x.cs", "src/y.cs", "missing"), ("move", "src/a.cs", "out/c.cs", "outside"), ("move", "src/a.cs", None, "outside"),
    ]
    df = spark.createDataFrame([r[:3] for r in asked], "op string, path string, target string")
    checked = changes.file_checks(files, df, "src/")
    assert rows(checked) == sorted(asked, key=str)
    assert rows(changes.files_after(files, checked)) == [("src/c.cs", "A"), ("src/n.cs", "")]


def test_data_flow_of_a_span(spark):
    events = [("m", "a", "write", 1), ("m", "a", "read", 5), ("m", "b", "write", 5), ("m", "b", "read", 9), ("m", "c", "write", 5), ("m", "c", "read", 6), ("m", "d", "write", 1), ("m", "d", "read", 9), ("m", "e", "write", 1), ("m", "e", "write", 5), ("m", "e", "read", 6)]
    got = dead.data_flow(spark.createDataFrame(events, "body string, local string, event string, at int"), 4, 7)
    assert rows(got) == [("m", "a", True, False, False), ("m", "b", False, True, False), ("m", "c", False, False, True), ("m", "e", False, False, False)]


def test_suppressions_go_around_their_line(spark):
    lines = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "id int, line long, text string")
    got = rewrites.suppressions(lines, spark.createDataFrame([(1, 2)], "id int, line long"), "CS7").orderBy("id", "ord").collect()
    assert [r["text"] for r in got] == ["x", "#pragma warning disable CS7", "y", "#pragma warning restore CS7"]


def test_imports_after_a_namespace_moves(spark):
    refs = spark.createDataFrame([("a", "Old", True), ("b", "Old", True), ("b", "Old", False), ("c", "Old", True), ("d", "Old", False), ("e", "Old", True), ("e", "Old", True)], "file string, namespace string, moving boolean")
    imports = spark.createDataFrame([("a", "Old"), ("b", "Old"), ("c", "New"), ("d", "Old")], "file string, namespace string")
    assert rows(rewrites.relocated(refs, imports, "Old", "New")) == [("a", 1, "swap"), ("b", 1, "add"), ("c", 1, "none"), ("e", 2, "add")]


def test_related_tests(spark):
    methods = spark.createDataFrame([("p", "f1", "Adds_Dog", True), ("p", "f1", "Helper", False), ("p", "f2", "Runs", True), ("q", "f3", "Walks", True)], "project string, file string, name string, test boolean")
    assert rows(testing.discovered(methods, F.col("test"))) == [("p", 2, 2, "Adds_Dog"), ("q", 1, 1, "Walks")]
    tests = methods.filter("test").select("file", "name")
    refs = spark.createDataFrame([("f2", "Dog"), ("f3", "Cat"), ("f1", "Dog")], "file string, symbol string")
    assert rows(testing.related(tests, refs, "dog", spark.createDataFrame([("Dog",)], "symbol string"))) == [("f1", "Adds_Dog", "name"), ("f2", "Runs", "reference")]


def test_terms_of_files_and_fallback(spark):
    files = spark.createDataFrame([("src/Dog.Tests.cs",), ("lib/cat",)], "path string")
    types = spark.createDataFrame([("src/Dog.Tests.cs", "Animal"), ("other.cs", "Nope")], "path string, type string")
    assert rows(testing.terms_of(files, types)) == [("lib/cat", "cat"), ("src/Dog.Tests.cs", "animal"), ("src/Dog.Tests.cs", "dog.tests")]
    tests = spark.createDataFrame([("f1", "AnimalTest"), ("cat.cs", "x"), ("f2", "y")], "file string, name string")
    instead = spark.createDataFrame([("f9", "z")], "file string, name string")
    assert rows(testing.related_files(tests, ["animal", "cat"], instead)) == [("cat.cs", "x", "cat"), ("f1", "AnimalTest", "animal")]
    assert rows(testing.related_files(tests, ["none"], instead)) == [("f9", "z", "")]


def test_token_scopes(spark):
    tokens = spark.createDataFrame([(1, 1, 1, "identifier", "Dog"), (1, 1, 5, "string", "a Dog"), (1, 2, 1, "comment", "// Dog\nhere"), (1, 3, 1, "keyword", "Dog")], "id int, line int, col int, kind string, text string")
    assert [search.grep_tokens(tokens, "Dog", s).count() for s in ("identifiers", "strings", "comments", "all", "ALL")] == [1, 1, 1, 3, 3]
    assert search.grep_tokens(tokens, "Dog", "comments").first()["snippet"] == "// Dog here"


def test_fixes_are_numbered(spark):
    found = spark.createDataFrame([(1, "R"), (2, "S")], "place int, rule string")
    fixes = spark.createDataFrame([("R", "wrap"), ("R", "drop")], "rule string, fix string")
    assert rows(diagnostics.fixes(found, fixes)) == [(1, "R", 0, "drop"), (1, "R", 1, "wrap")]
    assert rows(diagnostics.fix_at(found, fixes, 1, 1)) == [(1, "R", "wrap")] and diagnostics.fix_at(found, fixes, 2, 0).count() == 0


def test_build_places_with_an_end_and_repeats_of_a_place(spark):
    lines = ["a.cs(1,2,3,4): error CS1: first [p.csproj]", "a.cs(1,2): error CS1: again [q.csproj]", "a.cs(1,2): error CS2: other", "a.cs(1,2,3): error CS3: no place"]
    got = captured.build_diagnostics(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(got) == [("a.cs", 1, 2, "Error", "CS1", "again", "q.csproj"), ("a.cs", 1, 2, "Error", "CS2", "other", None)]


def test_dumps_of_properties_and_items(spark):
    got = captured.properties(spark.createDataFrame([("p|A=1=2",), ("noise",), ("p|B=",)], "value string"))
    assert rows(got) == [("p", "A", "1=2"), ("p", "B", "")]
    report = '[{"project":"p","item":"x","metadata":{"m":"1","n":"2"}},{"project":"p","item":"y","metadata":{}}]'
    assert rows(captured.items(spark.createDataFrame([(report,), ("broken",)], "json string"))) == [("p", "x", "m", "1"), ("p", "x", "n", "2")]


def test_enclosing_at_bounds(spark):
    spans = spark.createDataFrame([("outer", 0, 0, 100), ("inner", 0, 10, 20)], "span_id string, scope int, lo int, hi int")
    points = spark.createDataFrame([(1, 0, 10), (2, 0, 21), (3, 0, 101), (4, 1, 10)], "point_id int, scope int, at int")
    assert rows(lookup.enclosing(points, spans, bucket=16)) == [(1, "inner"), (2, "outer")]
