"""Queries over captured output: logs, reports and listings, written from the driver's tables and read by the parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import deps, diagnostics, metrics, search, testing
from factloom.plans.base import query, table
from factloom.sources import captured

_BUILD = """(SELECT 'src/u' || user_id || '.cs' AS path, CAST(event_id % 20 + 1 AS INTEGER) AS line, CAST(event_id % 3 + 1 AS INTEGER) AS col, CASE event_type WHEN 'error' THEN 'Error' ELSE 'Warning' END AS severity,
 'CS' || (1000 + user_id % 9) AS id, 'about ' || event_type AS message, 'p' || (user_id % 5) || '.csproj' AS project FROM events WHERE event_type IN ('error', 'purchase'))"""
_BUILD_SQL = f"SELECT path, line, col, severity, id, message, project FROM (SELECT *, row_number() OVER (PARTITION BY id, path, line, col ORDER BY severity, message, project) AS rn FROM {_BUILD}) WHERE rn = 1"


def _build_log(spark: SparkSession, d: str) -> DataFrame:
    """A line of a build's output for each event: errors and purchases are diagnostics, those of even ids with an end of their place."""
    e, i, u = F.col("event_type"), F.col("event_id"), F.col("user_id")
    end = F.when(i % 2 == 0, F.format_string(",%d,%d", i % 20 + 1, i % 3 + 9)).otherwise("")
    line = F.format_string("  src/u%d.cs(%d,%d%s): %s CS%d: about %s [p%d.csproj]", u, i % 20 + 1, i % 3 + 1, end, F.when(e == "error", "error").otherwise("warning"), u % 9 + 1000, e, u % 5)
    return table(spark, d, "events").select(F.when(e.isin("error", "purchase"), line).otherwise(F.concat(F.lit("Restored "), e)).alias("value"))


@query("build_workspace", _BUILD_SQL)
def build_workspace(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics of a whole build's log."""
    return captured.build_diagnostics(_build_log(spark, d))


@query("build_project", f"SELECT severity, count(*) AS n, count(DISTINCT path) AS files FROM ({_BUILD_SQL}) WHERE project = 'p1.csproj' GROUP BY severity")
def build_project(spark: SparkSession, d: str) -> DataFrame:
    """Totals of one project in the log."""
    found = captured.build_diagnostics(_build_log(spark, d)).filter("project = 'p1.csproj'")
    return found.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


_OUTCOME = "CASE WHEN quality = 1 THEN 'Passed' WHEN quality = 0 THEN 'Failed' ELSE 'NotExecuted' END"


@query("test_run", f"SELECT count(*) AS total, count(*) FILTER (o = 'Passed') AS passed, count(*) FILTER (o = 'Failed') AS failed, count(*) FILTER (o = 'NotExecuted') AS skipped FROM (SELECT {_OUTCOME} AS o FROM labels)")
def test_run(spark: SparkSession, d: str) -> DataFrame:
    """Labels as test results, 50 to a report."""
    outcome = F.when(F.col("quality") == 1, "Passed").when(F.col("quality") == 0, "Failed").otherwise("NotExecuted")
    one = F.format_string('<UnitTestResult testName="d%d" outcome="%s"/>', F.col("doc_id"), outcome)
    reports = table(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 50)).agg(F.concat(F.lit('<TestRun xmlns="http://t"><Results>'), F.array_join(F.collect_list(one), ""), F.lit("</Results></TestRun>")).alias("xml"))
    return captured.test_summary(captured.test_results(reports))


def _coverage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Labels as lines of coverage: a class for each source and language, a report for each 50 documents of it."""
    both = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    line = F.format_string('<line number="%d" branch="False" hits="%d"/>', F.col("doc_id"), F.col("quality"))
    reports = both.groupBy("source", "lang", F.floor(F.col("doc_id") / 50)).agg(
        F.concat(F.lit('<coverage><class name="'), F.col("source"), F.lit("/"), F.col("lang"), F.lit('" line-rate="0"><lines>'), F.array_join(F.collect_list(line), ""), F.lit("</lines></class></coverage>")).alias("xml")
    )
    return captured.coverage_lines(reports)


_COVERED = "CAST(sum(CASE WHEN quality > 0 THEN 1 ELSE 0 END) AS BIGINT)"


@query("test_coverage", f"""SELECT source, lang, count(*) AS total, {_COVERED} AS covered, round_even(100.0::DOUBLE * {_COVERED} / count(*), 1) AS rate
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source, lang)""")
def test_coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = _coverage_lines(spark, d)
    parts = F.split("class", "/")
    return metrics.coverage(lines.select(parts[0].alias("source"), parts[1].alias("lang"), "hits"), ["source", "lang"])


@query("test_coverage_map", f"""SELECT source || '/' || lang AS class, count(*) AS total, {_COVERED} AS covered, round_even(100.0::DOUBLE * {_COVERED} / count(*), 1) AS rate
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source || '/' || lang)""")
def test_coverage_map(spark: SparkSession, d: str) -> DataFrame:
    """Classes, and all of them."""
    return metrics.coverage(_coverage_lines(spark, d), ["class"])


@query("vulnerability_scan", """WITH v AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id FROM events),
s AS (SELECT CASE WHEN k >= 90 THEN 'Critical' WHEN k >= 70 THEN 'High' WHEN k >= 40 THEN 'Moderate' ELSE 'Low' END AS severity, user_id AS package FROM v WHERE k IS NOT NULL)
SELECT severity, count(*) AS findings, count(DISTINCT package) AS packages FROM s GROUP BY severity""")
def vulnerability_scan(spark: SparkSession, d: str) -> DataFrame:
    """A package listing for each event, those of even ids as transitive; its key k sets the severity."""
    k = F.from_json("props", "k int").getField("k")
    severity = F.when(k >= 90, "Critical").when(k >= 70, "High").when(k >= 40, "Moderate").otherwise("Low")
    package = F.struct(F.format_string("u%d", F.col("user_id")).alias("id"), k.cast("string").alias("resolvedVersion"), F.array(F.struct(severity.alias("severity"), F.col("event_id").cast("string").alias("advisoryurl"))).alias("vulnerabilities"))
    even = F.col("event_id") % 2 == 0
    framework = F.struct(F.lit("net10").alias("framework"), F.when(~even, F.array(package)).alias("topLevelPackages"), F.when(even, F.array(package)).alias("transitivePackages"))
    reports = table(spark, d, "events").filter(k.isNotNull()).select(F.to_json(F.struct(F.array(F.struct(F.lit("p").alias("path"), F.array(framework).alias("frameworks"))).alias("projects"))).alias("json"))
    return deps.vulnerabilities(captured.vulnerable_packages(reports), ["Critical", "High", "Moderate", "Low"])


@query("validate_recent_changes", """WITH c AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'), e AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM c))
SELECT (SELECT count(*) FROM e) AS errors, (SELECT count(*) FROM c) AS failed_tests, CASE WHEN (SELECT count(*) FROM e) > 0 THEN 'compile-error' WHEN (SELECT count(*) FROM c) > 0 THEN 'test-failure' ELSE 'clean' END AS status""")
def validate_recent_changes(spark: SparkSession, d: str) -> DataFrame:
    """Errors (returned lines) in changed files (open orders, from a status listing) only."""
    key = F.col("o_orderkey")
    line = F.when(key % 3 == 0, F.format_string("R  old/%d -> orders/%d", key, key)).otherwise(F.format_string(" M orders/%d", key))
    listing = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(line.alias("value"))
    changed = captured.changed_files(listing).select(F.regexp_extract("path", r"^orders/(\d+)$", 1).cast("long").alias("l_orderkey"))
    bad = table(spark, d, "lineitem").filter("l_returnflag = 'R'").join(changed, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber").distinct()
    return diagnostics.status(bad, changed)


def _dump(spark: SparkSession, d: str) -> DataFrame:
    """A dump of properties: a line for each part, of its brand."""
    return captured.properties(table(spark, d, "part").select(F.concat(F.col("p_brand"), F.lit("|"), F.col("p_name"), F.lit("="), F.col("p_type")).alias("value")))


@query("evaluate_property", "SELECT DISTINCT p_brand AS project, p_name AS name, p_type AS value FROM part WHERE p_brand = 'Brand#3' AND p_name = (SELECT min(p_name) FROM part WHERE p_brand = 'Brand#3')")
def evaluate_property(spark: SparkSession, d: str) -> DataFrame:
    """The values of one property of one project."""
    of = _dump(spark, d).filter("project = 'Brand#3'")
    return of.join(F.broadcast(of.agg(F.min("name").alias("name"))), "name").select("project", "name", "value").distinct()


@query("project_properties", "SELECT DISTINCT p_brand AS project, p_name AS property, p_type AS value FROM part WHERE contains(lower(p_name), 'bolt')")
def project_properties(spark: SparkSession, d: str) -> DataFrame:
    """All properties whose name holds a text."""
    return _dump(spark, d).filter(F.lower("name").contains("bolt")).select("project", F.col("name").alias("property"), "value").distinct()


@query("project_items", "SELECT p_brand AS project, 'part' || p_partkey AS item, unnest(['Size', 'Type']) AS name, unnest([CAST(p_size AS VARCHAR), p_type]) AS value FROM part WHERE p_size > 40")
def project_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of one type with their metadata, a report for each part."""
    item = F.struct(F.col("p_brand").alias("project"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("item"), F.create_map(F.lit("Size"), F.col("p_size").cast("string"), F.lit("Type"), F.col("p_type")).alias("metadata"))
    return captured.items(table(spark, d, "part").filter("p_size > 40").select(F.to_json(F.array(item)).alias("json")))


#: Kinds of tokens of markup, as this query's tokenizer finds them: attribute values, comments, names of tags.
_TOKENS = {"string": '"([^"]*)"', "comment": "<!--([^>]*)-->", "identifier": "<([a-z]+)"}
_TOKENS_SQL = " UNION ALL ".join(
    f"SELECT id, line, CAST(generate_subscripts(t, 1) AS BIGINT) AS col, '{kind}' AS kind, unnest(t) AS text FROM (SELECT id, line, regexp_extract_all(text, '{pattern}', 1) AS t FROM l)" for kind, pattern in _TOKENS.items()
)
_HTML_LINES = "l AS (SELECT page_id AS id, generate_subscripts(string_split(html, chr(10)), 1) AS line, unnest(string_split(html, chr(10))) AS text FROM pages)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    lines = search.lines_of(table(spark, d, "pages"), "page_id", "html")
    each = [lines.select("id", "line", F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("pos", "text")) for kind, p in _TOKENS.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("id", "line", (F.col("pos") + 1).cast("long").alias("col"), "kind", "text")


def _grep_tokens(name: str, pattern: str, scope: str, kinds: str) -> None:
    @query(name, f"WITH {_HTML_LINES} SELECT id, line, col, kind, substr(regexp_replace(text, '[\\r\\n]', ' ', 'g'), 1, 200) AS snippet FROM ({_TOKENS_SQL}) WHERE kind IN ({kinds}) AND regexp_matches(text, '{pattern}') ORDER BY id, line, col LIMIT 500")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.grep_tokens(_tokens(spark, d), pattern, scope)


_grep_tokens("semantic_grep_strings", "^/th", "strings", "'string'")
_grep_tokens("semantic_grep_comments", "ad [0-9]", "comments", "'comment'")
_grep_tokens("semantic_grep_tags", "^(nav|article)$", "identifiers", "'identifier'")


@query("node_complexity", "SELECT conv_id AS member, 1 + count(*) FILTER (role = 'assistant') AS complexity, max(turn) AS nesting FROM conversations GROUP BY conv_id")
def node_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Turns as nodes: what the assistant says is a decision, and each turn is one level deeper."""
    return metrics.node_complexity(table(spark, d, "conversations").select(F.col("conv_id").alias("member"), F.col("role").alias("kind"), F.col("turn").alias("depth")), ["assistant"])


_METHODS = "(SELECT role AS project, 'c' || conv_id AS file, text AS name, turn FROM conversations)"


def _methods(spark: SparkSession, d: str) -> DataFrame:
    """Turns as methods: the role is the project, the conversation the file, the text the name; even turns are marked as tests."""
    return table(spark, d, "conversations").select(F.col("role").alias("project"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.col("text").alias("name"), "turn")


@query("test_discover", f"SELECT project, count(*) AS tests, count(DISTINCT file) AS files, min(name) AS first FROM {_METHODS} WHERE turn % 2 = 0 AND contains(lower(name), 'the') GROUP BY project")
def test_discover(spark: SparkSession, d: str) -> DataFrame:
    return testing.discovered(_methods(spark, d), F.col("turn") % 2 == 0, "The")


@query("test_related", f"""WITH t AS (SELECT * FROM {_METHODS} WHERE turn % 2 = 0), r AS (SELECT DISTINCT file FROM {_METHODS} WHERE turn % 2 = 1 AND turn IN (3, 5)),
x AS (SELECT file, name, 1 AS tier FROM t WHERE contains(lower(name), 'ention') UNION ALL SELECT file, name, 2 FROM t WHERE file IN (SELECT file FROM r))
SELECT file, name, CASE min(tier) WHEN 1 THEN 'name' ELSE 'reference' END AS how FROM x GROUP BY file, name""")
def test_related(spark: SparkSession, d: str) -> DataFrame:
    """By name, and by references (odd turns) to one of two symbols from the same file."""
    methods = _methods(spark, d)
    refs = methods.filter("turn % 2 = 1").select("file", F.col("turn").alias("symbol"))
    return testing.related(methods.filter("turn % 2 = 0"), refs, "ention", spark.createDataFrame([(3,), (5,)], "symbol long"))


_CHANGED = {"src/Thention.cs": ["erthe"], "lib/Anthe.py": [], "x/Lichkeit.Generated.cs": ["Ouelle"]}
_TERMS = sorted({"thention", "erthe", "anthe", "lichkeit.generated", "ouelle"})


@query("test_related_files", f"""SELECT file, name, array_to_string(list_filter({_TERMS}, lambda t: contains(lower(name || chr(10) || file), t)), ',') AS terms FROM {_METHODS} WHERE turn % 2 = 0 AND len(list_filter({_TERMS}, lambda t: contains(lower(name || chr(10) || file), t))) > 0""")
def test_related_files(spark: SparkSession, d: str) -> DataFrame:
    """Tests that hold a declared type or the stem of a changed file; at most 25 files, so their terms are a bounded list."""
    files = spark.createDataFrame([(p,) for p in _CHANGED], "path string").orderBy("path").limit(testing.MOST_FILES)
    types = spark.createDataFrame([(p, t) for p, ts in _CHANGED.items() for t in ts], "path string, type string")
    terms = sorted({r["term"] for r in testing.terms_of(files, types).collect()})
    methods = _methods(spark, d)
    return testing.related_files(methods.filter("turn % 2 = 0"), terms, methods.filter("turn = 1").select("file", "name"))
