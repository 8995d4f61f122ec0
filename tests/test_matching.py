"""Substrings by q-grams, spans on levels, patterns with placeholders."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import patterns
from factloom.operators import changes, lookup, search, testing


@pytest.mark.parametrize("q", [1, 2, 3])
def test_holding_against_plain_contains(spark, q):
    rng = random.Random(q)
    texts = [(k, "".join(rng.choice("abcé日") for _ in range(rng.randint(0, 30)))) for k in range(60)] + [(60, None), (61, ""), (62, "ab" * 3000), (3, "other text of id 3"), (63, "a.c\n*")]
    terms = {"".join(rng.choice("abcé日") for _ in range(rng.randint(1, 6))) for _ in range(80)} | {"a.c", ".", "\n*", "ab" * 40, "zzzz"}
    want = {(i, t) for i, x in texts for t in terms if x and t in x}
    rows = [(t,) for t in terms] + [(None,), ("",), ("a",), ("a",)]
    got = [tuple(r) for r in search.holding(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(rows, "term string"), q).collect()]
    assert set(got) == want and len(got) == len(want)


def test_holding_a_hundred_thousand_terms_without_a_collect(spark, monkeypatch):
    """Terms that are in no text cost a look at the index each, and nothing comes to the driver."""
    terms = spark.range(100_000).selectExpr("concat('term', lpad(string(id), 6, '0')) as term").union(spark.createDataFrame([("q",), ("no",)], "term string"))
    texts = spark.createDataFrame([(1, "xterm000123y term099999"), (2, "a note"), (3, "term12")], "id int, text string")
    frame = type(terms)
    for name in ("collect", "toPandas", "first", "head", "take", "toLocalIterator"):
        monkeypatch.setattr(frame, name, lambda *_, **__: pytest.fail("collected"))
    found = search.holding(texts, terms)
    monkeypatch.undo()
    assert sorted(map(tuple, found.collect())) == [(1, "term000123"), (1, "term099999"), (2, "no")]


def test_related_by_terms(spark):
    tests = spark.createDataFrame([("A.cs", "ThingWorks"), ("B.cs", "Other"), (None, "thing"), ("A.cs", "ThingWorks"), ("thing.cs", None)], "file string, name string")
    fallback = spark.createDataFrame([("F.cs", "Near")], "file string, name string")
    terms = spark.createDataFrame([("thing",), ("ing",), ("b",)], "term string")
    got = sorted((r["file"] or "", r["name"] or "", r["terms"]) for r in testing.related_by_terms(tests, terms, fallback).collect())
    assert got == [("", "thing", "ing,thing"), ("A.cs", "ThingWorks", "ing,thing"), ("B.cs", "Other", "b"), ("thing.cs", "", "ing,thing")]
    assert [tuple(r) for r in testing.related_by_terms(tests, spark.createDataFrame([("none",)], "term string"), fallback).collect()] == [("F.cs", "Near", "")]


def test_related_by_terms_indexes_numbers_not_texts_and_broadcasts_neither(spark, monkeypatch):
    """Grams of each text beside the text itself were small as a file, and were broadcast from the driver at many times that."""
    made, keep = {}, search.written
    monkeypatch.setattr(search, "written", lambda df, label: made.setdefault(label, keep(df, label)))
    rng = random.Random(5)
    tests = spark.createDataFrame([("user", "".join(rng.choice("abcdefgh ") for _ in range(400)) + f" t{k}") for k in range(300)], "file string, name string")
    terms = spark.createDataFrame([("t7",), ("t29",), ("user",), ("t299",)], "term string")
    got = {r["name"].rpartition(" ")[2]: r["terms"] for r in testing.related_by_terms(tests, terms, tests.limit(0)).collect()}
    assert len(got) == 300 and got["t299"] == "t29,t299,user" and got["t7"] == "t7,user" and got["t8"] == "user"
    assert made["grams"].dtypes == [("gram", "string"), ("id", "bigint")]
    plan = search.holding(tests.select(F.xxhash64("name").alias("id"), F.col("name").alias("text")), terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 2


def test_enclosing_with_one_span_of_a_thousand_million(spark):
    rng = random.Random(6)
    spans = [(f"s{k}", k % 3, lo, lo + rng.choice([0, 1, 2, 3, 7, 8, 500])) for k, lo in ((k, rng.randrange(-300, 3000)) for k in range(150))]
    spans += [("long", 0, -5, 10**9), ("all", 1, -(10**12), 10**15), ("turned", 2, 9, 3), ("tie-b", 2, 5000, 5001), ("tie-a", 2, 5000, 5001)]
    points = [(k, k % 4, rng.randrange(-400, 3600)) for k in range(400)] + [(1000, 0, 10**9), (1001, 0, 10**9 + 1), (1002, 1, -(10**12)), (1003, 2, 5001), (1004, None, 7), (1005, 0, None)]
    want = {}
    for p, scope, at in points:
        held = [(hi - lo, s) for s, sc, lo, hi in spans if sc == scope and at is not None and lo <= at <= hi]
        if held:
            want[p] = min(held)[1]
    df = spark.createDataFrame(spans, "span_id string, scope int, lo long, hi long")
    got = lookup.enclosing(spark.createDataFrame(points, "point_id int, scope int, at long"), df)
    assert {r["point_id"]: r["span_id"] for r in got.collect()} == want and want[1003] == "tie-a"
    assert lookup.enclosing(spark.createDataFrame(points, "point_id int, scope int, at long"), df.limit(0)).count() == 0


def _most_rows_of_a_join(df):
    """Of the plan that ran, by its own metrics."""
    def walk(p):
        own = [p.metrics().get("numOutputRows").get().value()] if "Join" in p.nodeName() and p.metrics().contains("numOutputRows") else []
        below = p.children() if p.nodeName() not in ("AdaptiveSparkPlan",) else None
        nodes = [p.executedPlan()] if below is None else [below.apply(i) for i in range(below.size())]
        if p.nodeName().endswith("QueryStage"):
            nodes.append(p.plan())
        return own + [n for x in nodes for n in walk(x)]

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_enclosing_meets_a_span_of_each_level_at_most_and_the_ends_of_64_bits(spark):
    """A thousand spans around every point used to be met one by one."""
    top = 2**63 - 1
    spans = [(f"n{k:04}", 0, -k, 3000 + k) for k in range(1000)] + [("open", 1, 5, top), ("late", 1, top - 5, top), ("early", 1, -top - 1, -9)]
    points = [(k, 0, k) for k in range(3000)] + [(5000, 1, top), (5001, 1, top - 6), (5002, 1, -top - 1), (5003, 1, 4), (5004, 0, -500), (5004, 0, 1)]
    got = lookup.enclosing(spark.createDataFrame(points, "point_id int, scope int, at long"), spark.createDataFrame(spans, "span_id string, scope int, lo long, hi long"))
    want = {k: "n0000" for k in range(3000)} | {5000: "late", 5001: "open", 5002: "early", 5004: "n0000"}
    assert {r["point_id"]: r["span_id"] for r in got.collect()} == want
    assert _most_rows_of_a_join(got) <= 3100 * 40


CASES = [
    ("f(__a__, __b__)", "g(__b__, __a__)", "f(x, y)", "g(y, x)", 1),
    ("f(__a__, __b__)", "g(__b__, __a__)", "f(f(1, 2), [a, b])  f( q ,r)", "g([a, b], f(1, 2))  g(r, q)", 2),
    ("f(__a__, __b__)", "g", "o.f(x, y) f(x) f(x, y, z) ff(x, y) f(x, y", "o.f(x, y) f(x) f(x, y, z) ff(x, y) f(x, y", 0),
    ("f(__a__, __b__)", "g(__a__)", "f((a, b), 'x, )' + \"\\\", \")", "g((a, b))", 1),
    ("f(__a__)", "[__a__]", "f((]) f(a)", "f((]) [a]", 1),
    ("eq(__a__, __a__)", "same(__a__)", "eq(x + 1, x+1) eq(x, y) eq(f(1, 2), f(1,2))", "same(x + 1) eq(x, y) same(f(1, 2))", 2),
    ("__x__ = __x__ + 1;", "__x__++;", "a.b = a.b + 1; c = d + 1; i = i + 1;", "a.b++; c = d + 1; i++;", 2),
    ("if (__c__) return __v__;", "return __c__ ? __v__ : 0;", "if (a && (b || c)) return f(x); if (q) g();", "return a && (b || c) ? f(x) : 0; if (q) g();", 1),
    ("a __x__ c __y__ e", "__y__ __x__", "a b c c d e", "c d b", 1),
    ("__a__ + __b__", "(__b__)", "x + y, z + (w + v)", "(y), ((w + v))", 2),
    ("old(__é__)", "new", "old(__é__)", "new", 1),  # no placeholder: its letters are not of the kind
    ("del(__a__);", "", "x; del(f[1]); y;", "x;  y;", 1),
    ("f ( )", "g()", "f() f( ) f(1)", "g() g() f(1)", 2),
    ("f(__a__)", "__a__ __a__", "f(\\d)", "\\d \\d", 1),
]


@pytest.mark.parametrize(("pattern", "goal", "text", "want", "n"), CASES)
def test_patterns(pattern, goal, text, want, n):
    assert patterns.Pattern(pattern, goal).rewrite(text) == (want, n)


def test_patterns_that_are_errors():
    for pattern, goal in (("", "x"), ("  ", "x"), ("__a__", "x"), ("f(__a__)", "__b__"), ("f(x)", "__a__")):
        with pytest.raises(ValueError, match="placeholder"):
            patterns.Pattern(pattern, goal)


def test_long_texts_take_linear_time():
    text = "f(" * 3000 + "x" + ", 1)" * 3000 + " g(1, 2)" * 20_000
    got, n = patterns.Pattern("g(__a__, __b__)", "h(__b__)").rewrite(text)
    assert n == 20_000 and got.endswith("h(2)")
    assert patterns.Pattern("f(__a__, __b__)", "__a__").rewrite(text)[1] == 1


def test_restructured_rows(spark):
    rows = spark.createDataFrame([(1, "f(a, b)", 5), (2, None, 6), (3, "", 7), (4, "f(a)", 8), (5, "f(a, b) f(c, d)", 9)], "id int, text string, changes_before int")
    got = changes.restructured(rows, "f(__x__, __y__)", "__y__").orderBy("id").collect()
    assert [(r["id"], r["rewritten"], r["changes"], r["changes_before"]) for r in got] == [(1, "b", 1, 5), (5, "b d", 2, 9)]
