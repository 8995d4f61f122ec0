"""Diagnostics, packages, registrations, tests, changes and texts over events, parts, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.paging import page
from factloom.operators import changes, dead, deps, diagnostics, graph, metrics, search
from factloom.plans.base import query, table

_DIAG = """(SELECT event_id, event_type AS rule, CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning' WHEN 'signup' THEN 'Hidden' ELSE 'Info' END AS severity, user_id AS place, value FROM events)"""


def _diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Events as diagnostics: the type is the rule and sets the severity, the user is the place."""
    kind = F.col("event_type")
    severity = F.when(kind == "error", "Error").when(kind == "purchase", "Warning").when(kind == "signup", "Hidden").otherwise("Info")
    return table(spark, d, "events").select("event_id", kind.alias("rule"), severity.alias("severity"), F.col("user_id").alias("place"), "value")


@query("diagnostics", f"""WITH x AS (SELECT * FROM {_DIAG} WHERE rule <> 'click' AND severity <> 'Hidden'),
t AS (SELECT count(*) FILTER (severity = 'Error') AS n_error, count(*) FILTER (severity = 'Warning') AS n_warning, count(*) FILTER (severity = 'Info') AS n_info FROM x)
SELECT x.event_id, x.rule, x.severity, x.place, t.* FROM x, t WHERE severity IN ('Warning', 'Error')""")
def diagnostics_(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.diagnostics(_diagnostics(spark, d), "Warning", F.col("rule") != "click").drop("value")


@query("diagnostics_page", f"""SELECT event_id, rule, severity, (SELECT count(*) FROM {_DIAG} WHERE severity = 'Error') AS total_count, (SELECT count(*) FROM {_DIAG} WHERE severity = 'Error') > 30 AS has_more
FROM {_DIAG} WHERE severity = 'Error' ORDER BY place, event_id LIMIT 20 OFFSET 10""")
def diagnostics_page(spark: SparkSession, d: str) -> DataFrame:
    rows = diagnostics.diagnostics(_diagnostics(spark, d), "Error")
    return page(rows, [F.col("place"), F.col("event_id")], 10, 20).select("event_id", "rule", "severity", "total_count", "has_more")


@query("diagnostics_summary", f"""SELECT rule, severity, count(*) AS n, min(place) AS first, CASE severity WHEN 'Error' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Info' THEN 2 ELSE 3 END::BIGINT AS severity_order FROM {_DIAG} GROUP BY rule, severity""")
def diagnostics_summary(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.summary(_diagnostics(spark, d))


_RULES = [("error", "Failure", "fix at once"), ("purchase", "Audit", None), ("view", "Usage", None)]
_RULES_SQL = "(VALUES ('error', 'Failure', 'fix at once'), ('purchase', 'Audit', NULL), ('view', 'Usage', NULL)) r(rule, category, hint)"


@query("diagnostic_details", f"SELECT x.event_id, x.rule, x.severity, r.category, r.hint FROM {_DIAG} x LEFT JOIN {_RULES_SQL} ON x.rule = r.rule WHERE x.place = 7 AND x.value > 50")
def diagnostic_details(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "rule string, category string, hint string")
    return diagnostics.details(_diagnostics(spark, d).filter("place = 7 and value > 50"), rules).select("event_id", "rule", "severity", "category", "hint")


_REGISTRY = [("error", "Injection", "Critical"), ("purchase", "Crypto", "Medium"), ("signup", "Auth", "High")]
_REGISTRY_SQL = "(VALUES ('error', 'Injection', 'Critical', 1), ('purchase', 'Crypto', 'Medium', 3), ('signup', 'Auth', 'High', 2)) r(rule, category, level, level_order)"


@query("security_diagnostics", f"SELECT x.event_id, x.rule, r.category, r.level, CAST(r.level_order AS BIGINT) AS level_order FROM {_DIAG} x JOIN {_REGISTRY_SQL} ON x.rule = r.rule")
def security_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame(_REGISTRY, "rule string, category string, level string")
    return diagnostics.security(_diagnostics(spark, d), registry).select("event_id", "rule", "category", "level", "level_order")


@query("security_counts", f"SELECT count(*) FILTER (level = 'Critical') AS n_critical, count(*) FILTER (level = 'High') AS n_high, count(*) FILTER (level = 'Medium') AS n_medium, count(*) FILTER (level = 'Low') AS n_low FROM {_DIAG} x JOIN {_REGISTRY_SQL} ON x.rule = r.rule")
def security_counts(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.security_counts(security_diagnostics(spark, d))


_WANTED = ["Brand#1", "Brand#2", "Other"]


@query("security_analyzer_status", " UNION ALL ".join(f"SELECT '{w}' AS wanted, coalesce(bool_or(starts_with(p_brand, '{w}')), false) AS present FROM part" for w in _WANTED))
def security_analyzer_status(spark: SparkSession, d: str) -> DataFrame:
    return deps.presence(table(spark, d, "part").select(F.col("p_brand").alias("name")), _WANTED)


@query("compile_check", f"""SELECT count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Error') = 0 AND count(*) > 0 AS success FROM {_DIAG} WHERE severity IN ('Warning', 'Error')""")
def compile_check(spark: SparkSession, d: str) -> DataFrame:
    rows = diagnostics.diagnostics(_diagnostics(spark, d), "Warning")
    return rows.agg(F.count_if(F.col("severity") == "Error").alias("errors"), F.count_if(F.col("severity") == "Warning").alias("warnings")).withColumn("success", (F.col("errors") == 0) & (F.col("errors") + F.col("warnings") > 0))


@query("validate_workspace", f"""WITH e AS (SELECT DISTINCT rule, place FROM {_DIAG} WHERE severity = 'Error'), t AS (SELECT * FROM labels WHERE quality = 0)
SELECT (SELECT count(*) FROM e) AS errors, (SELECT count(*) FROM t) AS failed_tests, CASE WHEN (SELECT count(*) FROM e) > 0 THEN 'compile-error' WHEN (SELECT count(*) FROM t) > 0 THEN 'test-failure' ELSE 'clean' END AS status""")
def validate_workspace(spark: SparkSession, d: str) -> DataFrame:
    rows = _diagnostics(spark, d).select("rule", "severity", "place", "value")
    errors = diagnostics.distinct_errors(rows.filter("value < 60"), rows.filter("value > 40 or value is null or value >= 60"))
    return diagnostics.status(errors, table(spark, d, "labels").filter("quality = 0"))


@query("apply_with_verify", """SELECT user_id AS place, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15'
EXCEPT SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-15'""")
def apply_with_verify(spark: SparkSession, d: str) -> DataFrame:
    """Errors after a change that there weren't before it."""
    errors = table(spark, d, "events").filter("event_type = 'error'").select("ts", F.col("user_id").alias("place"), F.from_json("props", "k int").getField("k").alias("k"))
    cut = F.lit("2024-01-15").cast("timestamp")
    return diagnostics.new_errors(errors.filter(F.col("ts") < cut).drop("ts"), errors.filter(F.col("ts") >= cut).drop("ts"))


@query("exception_flow", """WITH RECURSIVE h(child, parent) AS (VALUES ('error', 'purchase'), ('purchase', 'signup'), ('signup', 'root'), ('view', 'root')),
up(type, exact) AS (SELECT 'error', true UNION ALL SELECT h.parent, false FROM up JOIN h ON h.child = up.type)
SELECT event_id, coalesce(nullif(event_type, 'click'), 'root') AS declared, NOT exact AS catches_base, substr(trim(regexp_replace(props, '\\s+', ' ', 'g')), 1, 200) AS excerpt
FROM events JOIN up ON coalesce(nullif(event_type, 'click'), 'root') = up.type WHERE value > 80""")
def exception_flow(spark: SparkSession, d: str) -> DataFrame:
    """Events as catch sites, a click as one of no type; which are reached by an error, under a fixed hierarchy."""
    from factloom.functions.text import excerpt

    h = spark.createDataFrame([("error", "purchase"), ("purchase", "signup"), ("signup", "root"), ("view", "root")], "child string, parent string")
    up = graph.ancestors(h, "error").select("node", F.lit(False)).union(spark.createDataFrame([("error", True)], "node string, exact boolean"))
    sites = table(spark, d, "events").filter("value > 80").select("event_id", F.nullif("event_type", F.lit("click")).alias("declared"), excerpt(F.col("props")).alias("excerpt"))
    return diagnostics.caught(sites, up, "root")


_DI = "(SELECT user_id AS service, event_id AS ord, CASE event_type WHEN 'purchase' THEN 'add' ELSE 'try' END AS kind, CASE WHEN value > 66 THEN 'Singleton' WHEN value > 33 THEN 'Scoped' ELSE 'Transient' END AS lifetime FROM events WHERE event_type IN ('purchase', 'signup'))"
_DI_SQL = f"""WITH a AS (SELECT *, kind = 'add' OR row_number() OVER (PARTITION BY service ORDER BY ord) = 1 AS active, count(*) OVER (PARTITION BY service) AS n FROM {_DI}),
b AS (SELECT *, max(CASE WHEN active THEN ord END) OVER (PARTITION BY service) AS l FROM a)
SELECT service, ord, lifetime, CASE WHEN NOT active THEN 'shadowed' WHEN ord = l THEN 'winning' ELSE 'overridden' END AS status FROM b WHERE n >= 2"""


def _registrations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "add").otherwise("try")
    lifetime = F.when(F.col("value") > 66, "Singleton").when(F.col("value") > 33, "Scoped").otherwise("Transient")
    return table(spark, d, "events").filter(F.col("event_type").isin("purchase", "signup")).select(F.col("user_id").alias("service"), F.col("event_id").alias("ord"), kind.alias("kind"), lifetime.alias("lifetime"))


@query("di_registrations", f"SELECT service, lifetime, count(*) AS n FROM {_DI} WHERE kind = 'add' GROUP BY service, lifetime")
def di_registrations(spark: SparkSession, d: str) -> DataFrame:
    """The view without tries."""
    return _registrations(spark, d).filter("kind = 'add'").groupBy("service", "lifetime").agg(F.count("*").alias("n"))


@query("di_override_chains", _DI_SQL)
def di_override_chains(spark: SparkSession, d: str) -> DataFrame:
    return deps.registrations(_registrations(spark, d))


@query("di_chain_summary", f"SELECT service, count(*) AS registrations, count(*) FILTER (status <> 'winning') AS dead, count(DISTINCT lifetime) > 1 AS lifetimes_differ FROM ({_DI_SQL}) GROUP BY service")
def di_chain_summary(spark: SparkSession, d: str) -> DataFrame:
    return deps.registration_chains(_registrations(spark, d))


_PKG = "(SELECT s_nationkey AS project, p_brand AS package, p_type AS version FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"


def _packages(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    both = lines.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return both.select(F.col("s_nationkey").alias("project"), F.col("p_brand").alias("package"), F.col("p_type").alias("version"))


@query("nuget_dependencies", f"SELECT package, version, count(DISTINCT project) AS projects FROM {_PKG} GROUP BY package, version")
def nuget_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return deps.packages(_packages(spark, d))


@query("nuget_summary", f"SELECT lower(package) AS package, count(DISTINCT project) AS projects, count(DISTINCT lower(version)) AS versions, min(lower(version)) AS version FROM {_PKG} GROUP BY lower(package)")
def nuget_summary(spark: SparkSession, d: str) -> DataFrame:
    return deps.package_summary(_packages(spark, d))


_USES = "(SELECT c_custkey AS consumer, l_returnflag || l_linestatus AS kind, o_orderkey AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


def _uses(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("kind"))
    orders = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("consumer"), "kind", F.col("o_orderkey").alias("file"))


@query("consumers", f"SELECT consumer, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS uses FROM {_USES} WHERE consumer <> 5 GROUP BY consumer")
def consumers(spark: SparkSession, d: str) -> DataFrame:
    return deps.consumers(_uses(spark, d), own=5)


@query("type_consumers", f"SELECT file AS consumer, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS uses FROM {_USES} GROUP BY file ORDER BY uses DESC, consumer LIMIT 100")
def type_consumers(spark: SparkSession, d: str) -> DataFrame:
    """The report by file, the one with most uses first."""
    return deps.consumers(_uses(spark, d).select(F.col("file").alias("consumer"), "kind")).orderBy(F.desc("uses"), "consumer").limit(100)


@query("type_usages", """SELECT CASE WHEN l_returnflag = 'R' THEN 'Return' WHEN l_linestatus = 'O' AND l_quantity > 25 THEN 'Field' WHEN l_linestatus = 'O' THEN 'Parameter' ELSE 'Other' END AS classification, count(*) AS n FROM lineitem GROUP BY 1""")
def type_usages(spark: SparkSession, d: str) -> DataFrame:
    return deps.usages(table(spark, d, "lineitem"), [(F.col("l_returnflag") == "R", "Return"), ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 25), "Field"), (F.col("l_linestatus") == "O", "Parameter")])


@query("property_writes", """SELECT CASE WHEN l_returnflag = 'A' THEN 'Assignment' WHEN l_returnflag = 'R' THEN 'ObjectInitializer' END AS classification, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1""")
def property_writes(spark: SparkSession, d: str) -> DataFrame:
    return deps.usages(table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "R")), [(F.col("l_returnflag") == "A", "Assignment"), (F.col("l_returnflag") == "R", "ObjectInitializer")])


@query("type_mutations", """SELECT user_id AS member, CASE min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 3 END) WHEN 1 THEN 'purchase' WHEN 2 THEN 'error' ELSE 'click' END AS scope, count(*) AS writes FROM events WHERE event_type IN ('purchase', 'error', 'click') GROUP BY user_id""")
def type_mutations(spark: SparkSession, d: str) -> DataFrame:
    order = ["purchase", "error", "click"]
    return deps.mutations(table(spark, d, "events").filter(F.col("event_type").isin(order)).select(F.col("user_id").alias("member"), F.col("event_type").alias("scope")), order)


@query("record_field_addition", """SELECT 'construction' AS category, count(*) AS n FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'deconstruction', count(*) FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'with-expression', count(*) FROM lineitem WHERE l_tax = 0""")
def record_field_addition(spark: SparkSession, d: str) -> DataFrame:
    return deps.record_sites(table(spark, d, "lineitem"), {"construction": F.col("l_linenumber") == 1, "deconstruction": F.col("l_returnflag") == "R", "with-expression": F.col("l_tax") == 0})


_BRANCH = "the|und|le|que"


@query("complexity_metrics", f"""WITH m AS (SELECT doc_id AS id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS loc, 1 + len(regexp_extract_all(text, '{_BRANCH}')) AS complexity FROM documents)
SELECT id, loc, complexity, round_even(least(greatest((171 - 5.2::DOUBLE * ln(greatest(1.0::DOUBLE, loc * log2(1 + complexity))) - 0.23::DOUBLE * complexity - 16.2::DOUBLE * ln(loc)) * 100 / 171, 0), 100), 2) AS maintainability FROM m""")
def complexity_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.complexity(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _BRANCH).drop("text")


@query("test_reference_map", "SELECT doc_id AS symbol, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS covered FROM documents d")
def test_reference_map(spark: SparkSession, d: str) -> DataFrame:
    return metrics.reference_map(table(spark, d, "documents").select(F.col("doc_id").alias("symbol")), table(spark, d, "labels").select(F.col("doc_id").alias("symbol")))


@query("test_reference_share", "WITH m AS (SELECT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS c FROM documents d) SELECT count(*) FILTER (c) AS covered, count(*) FILTER (NOT c) AS uncovered, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE round_even(100.0::DOUBLE * count(*) FILTER (c) / count(*), 1) END AS percent FROM m")
def test_reference_share(spark: SparkSession, d: str) -> DataFrame:
    return metrics.covered_share(test_reference_map(spark, d))


@query("suggest_refactorings", f"""WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS target, 1 + len(regexp_extract_all(text, '{_BRANCH}')) AS c, n_chars // 2000 AS p FROM documents),
t AS (SELECT CAST(l_suppkey AS VARCHAR) AS target, count(DISTINCT l_returnflag) AS low FROM lineitem WHERE l_quantity >= 50 GROUP BY l_suppkey),
u AS (SELECT CAST(p_partkey AS VARCHAR) AS target FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)),
x AS (SELECT CASE WHEN c >= 15 THEN 'high' ELSE 'medium' END AS severity, 'complexity' AS kind, target FROM m WHERE c >= 10 UNION ALL SELECT 'medium', 'parameters', target FROM m WHERE p >= 7
  UNION ALL SELECT CASE WHEN low >= 3 THEN 'high' ELSE 'medium' END, 'cohesion', target FROM t WHERE low >= 2 UNION ALL SELECT 'low', 'unused', target FROM u)
SELECT * FROM x ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE kind WHEN 'complexity' THEN 0 ELSE 1 END, kind, target LIMIT 20""")
def suggest_refactorings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("target"), "text", "n_chars")
    methods = metrics.complexity(docs, _BRANCH).select("target", "complexity", F.floor(F.col("n_chars") / 2000).alias("parameters"))
    types = table(spark, d, "lineitem").filter("l_quantity >= 50").groupBy(F.col("l_suppkey").alias("target")).agg(F.countDistinct("l_returnflag").alias("lcom4"))
    refs = table(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("target"))
    unused = dead.unused_symbols(table(spark, d, "part").select(F.col("p_partkey").alias("symbol")), refs, F.lit("high"))
    return metrics.suggestions(methods, types, unused.select(F.col("symbol").alias("target"), "confidence"))


@query("get_source_text", "SELECT doc_id AS id, array_to_string(string_split(text, chr(10))[2:5], chr(10)) AS text FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def get_source_text(spark: SparkSession, d: str) -> DataFrame:
    return changes.text_slice(search.lines_of(table(spark, d, "documents"), "doc_id", "text"), 2, 5, 1 << 30)


@query("syntax_tree_budget", """SELECT conv_id, turn, total FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM conversations) WHERE total <= 1500""")
def syntax_tree_budget(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    return changes.budgeted(turns, ["conv_id"], ["turn", "role"], F.col("n"), 1500).select("conv_id", "turn", "total")


@query("restructure", """SELECT doc_id AS id, substr(sha256(regexp_replace(text, '([A-Za-z]+) of ([A-Za-z]+)', '\\2.\\1', 'g')), 1, 16) AS digest, CAST(len(regexp_extract_all(text, '([A-Za-z]+) of ([A-Za-z]+)')) AS BIGINT) AS changes FROM documents WHERE regexp_matches(text, '([A-Za-z]+) of ([A-Za-z]+)')""")
def restructure(spark: SparkSession, d: str) -> DataFrame:
    from factloom.functions.text import digest

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return changes.restructure(docs, "([A-Za-z]+) of ([A-Za-z]+)", "$2.$1").select("id", digest(F.col("rewritten")).alias("digest"), "changes")


@query("replace_literals", """WITH t AS (SELECT doc_id AS id, generate_subscripts(string_split(text, ' '), 1) AS ord, unnest(string_split(text, ' ')) AS token FROM documents),
r(literal, replacement) AS (VALUES ('the', 'THE'), ('und', '&'), ('avec', 'w/'))
SELECT id, CAST(ord AS INTEGER) AS ord, token, replacement FROM t JOIN r ON token = literal""")
def replace_literals(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", " ", -1)).alias("pos", "token"))
    return changes.replace_literals(tokens.select("id", (F.col("pos") + 1).alias("ord"), "token"), {"the": "THE", "und": "&", "avec": "w/"})


@query("apply_text_edit", """SELECT page_id AS id, CASE WHEN contains(url, '?') THEN '[' || substr(url, 1, 4) || 'S' || substr(url, 7) ELSE url END AS text FROM pages""")
def apply_text_edit(spark: SparkSession, d: str) -> DataFrame:
    """Two edits of each url with a query: a mark before it, and two characters replaced."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text"))
    some = pages.filter(F.col("text").contains("?"))
    edits = some.select("id", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("[").alias("insert")).unionByName(some.select("id", F.lit(4).alias("start"), F.lit(2).alias("length"), F.lit("S").alias("insert")))
    return changes.apply_edits(pages, edits)


@query("rename_preview", "SELECT l_orderkey AS file, count(*) AS sites, min(l_linenumber) AS first FROM lineitem WHERE l_partkey = 10 GROUP BY l_orderkey")
def rename_preview(spark: SparkSession, d: str) -> DataFrame:
    """Sites that renaming a part touches, by order."""
    sites = table(spark, d, "lineitem").filter("l_partkey = 10").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("place"))
    return changes.affected_files(sites)


@query("workspace_changes", "SELECT event_id AS seq, user_id AS file, event_type AS tool, ts AS applied_at FROM events WHERE event_type IN ('purchase', 'signup')")
def workspace_changes(spark: SparkSession, d: str) -> DataFrame:
    """The change log, whole."""
    log = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "signup"))
    return log.select(F.col("event_id").alias("seq"), F.col("user_id").alias("file"), F.col("event_type").alias("tool"), F.col("ts").alias("applied_at"))


@query("revert_by_sequence", "SELECT event_id AS seq, user_id AS file FROM events WHERE event_id > 100 AND user_id IN (SELECT user_id FROM events WHERE event_id = 100)")
def revert_by_sequence(spark: SparkSession, d: str) -> DataFrame:
    return changes.revertible(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("file")), 100)


@query("revert_last_apply", "SELECT user_id AS scope, max(event_id) AS seq FROM events GROUP BY user_id")
def revert_last_apply(spark: SparkSession, d: str) -> DataFrame:
    return changes.last_change(table(spark, d, "events").select(F.col("user_id").alias("scope"), F.col("event_id").alias("seq")), "scope")


@query("migrate_package", """SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 'Brand#99' ELSE p_brand END AS p_brand, p_size FROM part""")
def migrate_package(spark: SparkSession, d: str) -> DataFrame:
    """Package rows after one package is replaced by another."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return changes.upsert(parts, ["p_partkey"], parts.filter("p_brand = 'Brand#2'").withColumn("p_brand", F.lit("Brand#99")))


@query("move_conflicts", "SELECT p_partkey, p_name, p_type FROM part WHERE p_brand = 'Brand#3' AND (p_name, p_type) IN (SELECT (p_name, p_type) FROM part WHERE p_brand = 'Brand#4')")
def move_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Parts that can't move to another brand, since it has one of that name and type."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return changes.conflicts(parts.filter("p_brand = 'Brand#3'"), parts.filter("p_brand = 'Brand#4'"), ["p_name", "p_type"]).select("p_partkey", "p_name", "p_type")


@query("verify_suppression", """WITH s AS (SELECT user_id AS scope, event_id AS lo, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS hi, event_type FROM events WHERE event_type IN ('signup', 'error'))
SELECT e.event_id AS point, EXISTS (SELECT 1 FROM s WHERE s.event_type = 'signup' AND s.scope = e.user_id AND e.event_id BETWEEN s.lo AND coalesce(s.hi, 9223372036854775807)) AS suppressed FROM events e WHERE e.event_type = 'purchase'""")
def verify_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Purchases between a signup of the same user and what ends its span, the next signup or error."""
    from pyspark.sql.window import Window

    events = table(spark, d, "events")
    marks = events.filter(F.col("event_type").isin("signup", "error")).select(F.col("user_id").alias("scope"), F.col("event_id").alias("lo"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("hi"), "event_type")
    spans = marks.filter("event_type = 'signup'").select("scope", "lo", F.coalesce("hi", F.lit(2**63 - 1)).alias("hi"))
    points = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("point"), F.col("user_id").alias("scope"), F.col("event_id").alias("at"))
    return diagnostics.suppressed(points, spans)
