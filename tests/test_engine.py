import json

import pytest
from pyspark.sql import functions as F

from factloom import registry, schema
from factloom.session import MOST_STAGED, STAGED_SECONDS, Workspaces
from factloom.sources import captured, sinks
from factloom.streaming import changes


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, k int").write.parquet(str(tmp_path / "t.parquet"))
    return str(tmp_path)


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_sessions(spark, folder):
    w = Workspaces(spark)
    s = w.load(folder, ["t"])
    assert w.load(folder, ["t"]) is s
    assert [(r["name"], r["n"]) for r in w.status(s.id).collect()] == [("t", 9)]
    assert w.listed().count() == 1 and w.warm(s.id) == 9
    assert w.reload(s.id).version == 2
    assert w.close(s.id) and not w.close(s.id) and not w.sessions


def test_staged_changes_and_undo(spark, folder):
    clock = Clock()
    w = Workspaces(spark, clock=clock)
    s = w.load(folder, ["t"])
    first = w.preview(s.id, "t", s.tables["t"].filter("k > 0"), "drop k 0")
    second = w.preview(s.id, "t", s.tables["t"].filter("k > 1"), "drop k 1")
    third = w.preview(s.id, "t", s.tables["t"].limit(1), "keep one")
    assert w.apply(first) == 1 and s.tables["t"].count() == 6
    with pytest.raises(KeyError):
        w.apply(first)
    assert w.apply(second) == 2 and s.tables["t"].count() == 3
    with pytest.raises(RuntimeError):  # staged two versions ago
        w.apply(third)
    assert not w.revert(s.id, 1)  # a later change has the same table
    assert w.revert(s.id, 2) and s.tables["t"].count() == 6
    assert w.revert_last(s.id) == 1 and s.tables["t"].count() == 9
    assert w.revert_last(s.id) is None
    assert [r["seq"] for r in w.changes(s.id).collect()] == [1, 2]


def test_staged_changes_are_bounded(spark, folder):
    clock = Clock()
    w = Workspaces(spark, clock=clock)
    s = w.load(folder, ["t"])
    tokens = []
    for k in range(MOST_STAGED + 1):
        clock.now = k / 100
        tokens.append(w.preview(s.id, "t", s.tables["t"], str(k)))
    assert len(w.staged) == MOST_STAGED and tokens[0] not in w.staged
    clock.now += STAGED_SECONDS
    with pytest.raises(KeyError):
        w.apply(tokens[-1])


def test_catalogue(spark):
    assert len(registry.CATALOGUE) == 167 == len({c[1] for c in registry.CATALOGUE})
    assert registry.catalogue(spark, 160, 50).count() == 7
    assert sum(r["n"] for r in registry.counts(spark).collect()) == 167
    assert registry.heartbeat(spark).first()["alive"]
    from factloom import plans

    assert all(q is None or q in plans.QUERIES for *_, q in registry.CATALOGUE)


def test_schemas(spark):
    for s in schema.TABLES.values():
        assert spark.createDataFrame([], s).count() == 0


def test_build_log(spark):
    lines = ["  src/A.cs(10,5): error CS0103: The name 'x' does not exist [src/A.csproj]", "src/A.cs(10,5): error CS0103: The name 'x' does not exist [src/A.csproj]", "B.cs(1,2): warning CA1000: Do not", "Build succeeded."]
    got = captured.build_diagnostics(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("path").collect()
    assert [tuple(r) for r in got] == [("B.cs", 1, 2, "Warning", "CA1000", "Do not", None), ("src/A.cs", 10, 5, "Error", "CS0103", "The name 'x' does not exist", "src/A.csproj")]


def test_test_report(spark):
    xml = '<TestRun xmlns="http://x"><Results><UnitTestResult testName="a" outcome="Passed"/><UnitTestResult testName="b" outcome="Failed"/><UnitTestResult testName="c" outcome="NotExecuted"/></Results></TestRun>'
    results = captured.test_results(spark.createDataFrame([(xml,)], "xml string"))
    assert sorted(map(tuple, results.collect())) == [("a", "Passed"), ("b", "Failed"), ("c", "NotExecuted")]
    assert tuple(captured.test_summary(results).first()) == (3, 1, 1, 1)


def test_coverage_report(spark):
    xml = '<coverage><packages><package name="p"><classes><class name="A"><lines><line number="1" hits="3"/><line number="2" hits="0"/></lines></class><class name="B"><lines><line number="9" hits="1"/></lines></class></classes></package></packages></coverage>'
    got = captured.coverage_lines(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert sorted(map(tuple, got)) == [("A", 1, 3), ("A", 2, 0), ("B", 9, 1)]


def test_vulnerability_report(spark):
    report = {"projects": [{"path": "p", "frameworks": [{"framework": "f", "topLevelPackages": [{"id": "X", "resolvedVersion": "1", "vulnerabilities": [{"severity": "High", "advisoryurl": "u"}]}], "transitivePackages": [{"id": "Y", "resolvedVersion": "2", "vulnerabilities": [{"severity": "Low", "advisoryurl": "v"}]}]}]}]}
    got = captured.vulnerable_packages(spark.createDataFrame([(json.dumps(report),)], "json string")).collect()
    assert sorted(map(tuple, got)) == [("p", "X", "1", "High", "u", False), ("p", "Y", "2", "Low", "v", True)]


def test_listings(spark):
    status = spark.createDataFrame([(" M src/a.py",), ("?? new.txt",), ("R  old.py -> b.py",), ("",)], "value string")
    assert sorted(map(tuple, captured.changed_files(status).collect())) == [("??", "new.txt"), ("M", "src/a.py"), ("R", "b.py")]
    ini = spark.createDataFrame([("[*.cs]",), ("Indent_Size = 4",), ("# x = y",), ("",)], "value string")
    assert list(map(tuple, captured.ini_options(ini).collect())) == [("indent_size", "4")]


def test_texts_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert captured.whole_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "one\ntwo"
    assert [r[0] for r in captured.text_lines(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert sinks.as_json(df).first()["json"] == '{"a":1}'
    sinks.write_version(df, str(tmp_path / "out"), 3)
    with pytest.raises(Exception):
        sinks.write_version(df, str(tmp_path / "out"), 3)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 10) as ts, id, 'a' as k from range(20) union all select timestamp'2024-01-01 00:00:00', 3L, 'a'").coalesce(1).write.parquet(source)
    events = changes.read_changes(spark, source, spark.read.parquet(source).schema)

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{mode}{id(df)}")).start()
        q.awaitTermination(120)
        return spark.table("out").collect()

    counts = run(changes.tumbling_counts(events, "ts", ["k"], "1 minute"), "complete")
    assert sum(r["n"] for r in counts) == 21 and len(counts) == 4
    assert len(run(changes.once(events, "ts", ["id"]), "append")) == 20
    assert {r["n"] for r in run(changes.over_rate(events, "ts", "k", most=6, width="60 seconds", step="30 seconds"), "complete")} == {7}
    (one,) = run(changes.sessions(events, "ts", "k", gap="1 minute"), "complete")
    assert one["n"] == 21
    assert events.isStreaming and F is not None


def test_sorted_tables_let_lookups_skip(spark, tmp_path):
    """A key is within the bounds of one row group of all, and the filter goes to the scan."""
    import glob

    import pyarrow.parquet as pq

    path = sinks.write_sorted(spark.range(20_000).selectExpr("(id * 7919) % 20000 as k", "id as v"), str(tmp_path / "sorted"), "k", 8)
    groups = [(g.column(0).statistics.min, g.column(0).statistics.max) for f in glob.glob(f"{path}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert len(groups) == 8 and sum(low <= 12_345 <= high for low, high in groups) == 1
    found = spark.read.parquet(path).filter("k = 12345")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,12345)]" in plan
