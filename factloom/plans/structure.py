"""Queries over structure: forms of bodies, nested nodes, linked methods, cycles with their paths, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators import changes, dead, diagnostics, graph, lookup, metrics, mirrored, testing, unused, usages
from factloom.plans.base import TRADE_SQL, query, table, trade
from factloom.plans.graphs import _TREE_SQL, _tree

_FORMS_SQL = """n AS (SELECT body, count(*) AS nodes FROM t GROUP BY body),
f AS (SELECT t.*, CASE WHEN kind = 'identifier' THEN min(pos) OVER (PARTITION BY body, kind, text) END AS first FROM t JOIN n USING (body) WHERE nodes <= {most}),
c AS (SELECT body, pos, concat_ws('.', kind, CASE kind WHEN 'identifier' THEN '$' || dense_rank() OVER (PARTITION BY body ORDER BY first NULLS LAST) WHEN 'literal' THEN length(text) || '=' || text ELSE '' END) AS code FROM f),
g AS (SELECT body, sha256(string_agg(code, '|' ORDER BY pos)) AS form FROM c GROUP BY body),
b AS ({bodies}), x AS (SELECT b.body, b.lines, form FROM b JOIN n ON n.body = b.body LEFT JOIN g ON g.body = b.body WHERE lines >= {least})
SELECT substr(form, 1, 16) AS hash, count(*) AS members, arg_min(lines, body) AS lines, min(body) AS first, (SELECT count(*) FROM x WHERE form IS NULL) AS left_out FROM x WHERE form IS NOT NULL GROUP BY form HAVING count(*) >= 2"""

#: Lines of an order as three tokens each: the part is a name, the flag a literal, the supplier a name.
_ORDER_TOKENS = """o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS rn FROM lineitem),
t AS (SELECT l_orderkey AS body, rn * 3 + k AS pos, CASE k WHEN 1 THEN 'literal' ELSE 'identifier' END AS kind,
  CASE k WHEN 0 THEN 'p' || l_partkey WHEN 1 THEN l_returnflag ELSE 's' || l_suppkey END AS text FROM o, (SELECT unnest([0, 1, 2]) AS k))"""


@query("duplicated_bodies", f"WITH {_ORDER_TOKENS}, {_FORMS_SQL.format(most=20, least=3, bodies='SELECT l_orderkey AS body, count(*) AS lines FROM lineitem GROUP BY l_orderkey')}")
def duplicated_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines are the same but for the names of parts and suppliers; over 20 tokens is too many."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))

    def token(k: int, kind: str, text):
        return F.struct((F.col("n") * 3 + k).alias("at"), F.lit(kind).alias("kind"), text.alias("text"))

    three = F.array(
        token(0, "identifier", F.concat(F.lit("p"), F.col("l_partkey").cast("string"))), token(1, "literal", F.col("l_returnflag")), token(2, "identifier", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    )
    tokens = lines.withColumn("n", at).select(F.col("l_orderkey").alias("body"), F.inline(three))
    sizes = lines.groupBy(F.col("l_orderkey").alias("body")).agg(F.count("*").alias("lines"))
    return dead.duplicate_bodies(tokens, sizes, 3, 20)


_TURN_TOKENS = r"""w AS (SELECT conv_id * 1000 + turn AS body, regexp_extract_all(text, '[^\s.,;:!?]+|[.,;:!?]') AS w FROM conversations),
t AS (SELECT body, k AS pos, w[k] AS text, CASE WHEN w[k] IN ('.', ',', ';', ':', '!', '?') THEN 'mark' WHEN regexp_full_match(w[k], '[0-9]+') THEN 'literal' ELSE 'identifier' END AS kind FROM (SELECT body, w, unnest(range(1, len(w) + 1)) AS k FROM w))"""


@query("duplicated_turns", f"WITH {_TURN_TOKENS}, {_FORMS_SQL.format(most=50_000, least=2, bodies='SELECT body, len(w) AS lines FROM w')}")
def duplicated_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations that say the same in other words: which words repeat where, and all marks, are equal."""
    words = F.regexp_extract_all("text", F.lit(r"([^\s.,;:!?]+|[.,;:!?])"), 1)
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("body"), words.alias("w"))
    tokens = turns.select("body", F.posexplode("w").alias("at", "text"))
    kind = F.when(F.col("text").isin(*".,;:!?"), "mark").when(F.col("text").rlike("^[0-9]+$"), "literal").otherwise("identifier")
    return dead.duplicate_bodies(tokens.withColumn("kind", kind), turns.select("body", F.size("w").cast("long").alias("lines")), 2)


#: Kinds of the nodes that events stand for, by type and whether their value is an even number.
_KINDS = {
    "click": ("Block", "ForEachStatement"), "view": ("IfStatement", "ElseClause"), "purchase": ("TryStatement", "CatchClause"), "signup": ("SwitchStatement", "SwitchSection"), "error": ("Block", "LocalFunctionStatement"),
}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN '{a}' ELSE '{b}' END" for t, (a, b) in _KINDS.items()) + " END"


def _in(kinds: list[str]) -> str:
    return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"


_STATEMENT = "(n.kind LIKE '%Statement' OR n.kind = 'Block')"
_BODY = f"""((p.kind IN {_in(metrics.ONE_BODY)} AND {_STATEMENT}) OR (p.kind = 'TryStatement' AND n.kind = 'Block') OR (p.kind IN ('ElseClause', 'SwitchSection') AND {_STATEMENT}) OR (p.kind = 'CatchClause' AND n.kind = 'Block'))
  AND NOT CASE WHEN p.kind IN {_in(metrics.BODY_HOLDERS)} THEN p.above ELSE p.direct END"""
_CONTROL = f"n.kind IN {_in(metrics.ONE_BODY + metrics.MORE_BODIES)}"


@query("method_metrics", f"""WITH RECURSIVE e AS (SELECT user_id AS member, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS node, {_KIND_SQL} AS kind, event_id FROM events),
nodes AS (SELECT member, node, kind, CASE WHEN node > 1 THEN node - 1 - CASE WHEN event_id % 5 = 0 AND node > 4 THEN 3 ELSE 0 END END AS parent FROM e),
p(member, node, kind, depth, direct, above) AS (
  SELECT member, node, kind, 0, false, false FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.member, n.node, n.kind, p.depth + CASE WHEN {_BODY} THEN 1 ELSE 0 END, ({_BODY}) AND {_CONTROL}, p.direct FROM p JOIN nodes n ON n.member = p.member AND n.parent = p.node),
m AS (SELECT member, 1 + count(*) FILTER (kind IN {_in(metrics.DECISIONS)}) AS complexity, count(*) AS loc, CAST(max(depth) AS BIGINT) AS nesting FROM p GROUP BY member)
SELECT *, round_even(least(greatest((171 - 5.2::DOUBLE * ln(greatest(1.0::DOUBLE, loc * log2(1 + complexity))) - 0.23::DOUBLE * complexity - 16.2::DOUBLE * ln(CAST(loc AS DOUBLE))) * 100 / 171, 0), 100), 2) AS maintainability FROM m WHERE complexity >= 3""")
def method_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Users as methods and their events as nodes: most lie below the one before, every fifth four further up."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    odd = F.floor("value").cast("long") % 2 != 0
    kind = F.coalesce(*(F.when(F.col("event_type") == t, F.when(odd, b).otherwise(a)) for t, (a, b) in _KINDS.items()))
    nodes = table(spark, d, "events").select(F.col("user_id").alias("member"), number.alias("node"), kind.alias("kind"), "event_id")
    back = F.when((F.col("event_id") % 5 == 0) & (F.col("node") > 4), 3).otherwise(0)
    nodes = nodes.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1 - back)).drop("event_id")
    members = nodes.groupBy("member").agg(F.lit(1).alias("first_line"), F.count("*").alias("last_line"))
    return metrics.method_metrics(members, nodes, least=3, limit=None)


@query("cohesion_clusters", """WITH RECURSIVE i AS (SELECT DISTINCT l_suppkey AS scope, l_orderkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal >= 0),
a AS (SELECT DISTINCT l_suppkey AS scope, l_orderkey AS item, 'p' || l_partkey AS member, 'field' AS kind FROM lineitem WHERE l_discount >= 0.08 UNION SELECT l_suppkey, l_orderkey, 'q' || CAST(l_quantity AS BIGINT), 'call' FROM lineitem WHERE l_tax = 0.08 AND l_discount = 0.0),
u AS (SELECT a.* FROM a JOIN i USING (scope, item)), e AS (SELECT DISTINCT x.scope, x.item AS i, y.item AS j FROM u x JOIN u y ON x.scope = y.scope AND x.member = y.member AND x.kind = y.kind),
r(scope, i, j) AS (SELECT scope, i, j FROM e UNION SELECT r.scope, r.i, e.j FROM r JOIN e ON r.scope = e.scope AND r.j = e.i),
l AS (SELECT i.scope, i.item, coalesce(min(j), i.item) AS cluster FROM i LEFT JOIN r ON r.scope = i.scope AND r.i = i.item GROUP BY i.scope, i.item),
c AS (SELECT scope, cluster, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS members FROM l GROUP BY scope, cluster),
f AS (SELECT scope, cluster, string_agg(member, ',' ORDER BY member) AS shared FROM (SELECT DISTINCT l.scope, cluster, member FROM l JOIN u USING (scope, item) WHERE kind = 'field') GROUP BY scope, cluster),
s AS (SELECT scope, count(*) AS methods, count(DISTINCT cluster) AS lcom4 FROM l GROUP BY scope), n AS (SELECT scope, count(DISTINCT member) AS fields FROM u WHERE kind = 'field' GROUP BY scope)
SELECT c.scope, 'Class' AS type_kind, methods, coalesce(fields, 0) AS fields, lcom4, c.cluster, members, coalesce(shared, '') AS shared_fields FROM c JOIN s USING (scope) LEFT JOIN n USING (scope) LEFT JOIN f ON f.scope = c.scope AND f.cluster = c.cluster WHERE methods >= 2
UNION ALL SELECT l_suppkey, 'Interface', count(DISTINCT l_orderkey), 0, count(DISTINCT l_orderkey), NULL, '', '' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0 GROUP BY l_suppkey""")
def cohesion_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as types, in debt as interfaces; orders as methods, parts at a high discount as fields, quantities at a high tax as helpers."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_quantity", "l_tax", "l_discount")
    types = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal"))
    methods = lines.join(types, "l_suppkey").select(F.col("l_suppkey").alias("scope"), F.col("l_orderkey").alias("item"), "s_acctbal")
    own = [F.col("l_suppkey").alias("scope"), F.col("l_orderkey").alias("item")]
    fields = lines.filter("l_discount >= 0.08").select(*own, F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("member"), F.lit("field").alias("kind"))
    calls = lines.filter("l_tax = 0.08 and l_discount = 0.0").select(*own, F.concat(F.lit("q"), F.col("l_quantity").cast("long").cast("string")).alias("member"), F.lit("call").alias("kind"))
    return graph.clusters(methods.filter("s_acctbal >= 0"), fields.unionByName(calls), methods.filter("s_acctbal < 0"))


#: Breadth first from the least node of each component; the way back takes least predecessors.
_PATHS_SQL = f"""{TRADE_SQL}, e AS (SELECT src, dst, count(*) AS weight FROM trade WHERE src <> dst GROUP BY src, dst),
r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
m AS (SELECT a.src AS node, min(a.dst) AS c FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
i AS (SELECT x.c, src, dst FROM e JOIN m x ON x.node = src JOIN m y ON y.node = dst AND y.c = x.c),
w(c, node, dist) AS (SELECT c, dst, 1 FROM i WHERE src = c UNION SELECT w.c, i.dst, dist + 1 FROM w JOIN i ON i.c = w.c AND i.src = w.node WHERE dist < 25 AND w.node <> w.c),
d AS (SELECT c, node, min(dist) AS dist FROM w GROUP BY c, node),
k AS (SELECT i.c, i.dst AS node, x.dist, min(i.src) AS came FROM i JOIN d x ON x.c = i.c AND x.node = i.dst JOIN d y ON y.c = i.c AND y.node = i.src AND y.dist = x.dist - 1 WHERE i.src <> i.c GROUP BY ALL),
b(c, node, dist, path) AS (SELECT c, c, dist, CAST(c AS VARCHAR) FROM d WHERE node = c UNION ALL SELECT b.c, came, b.dist - 1, came || ' > ' || path FROM b JOIN k ON k.c = b.c AND k.node = b.node AND k.dist = b.dist)
"""


@query("namespace_graph", f"""WITH RECURSIVE {_PATHS_SQL}, n AS (SELECT s_nationkey AS node, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1), ends AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT 'node' AS part, CAST(coalesce(ends.node, n.node) AS VARCHAR) AS a, NULL AS b, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(ends.node, n.node) IN (SELECT node FROM m) AS circular FROM ends FULL JOIN n ON ends.node = n.node
UNION ALL SELECT 'edge', CAST(e.src AS VARCHAR), CAST(e.dst AS VARCHAR), weight, EXISTS (SELECT 1 FROM i WHERE i.src = e.src AND i.dst = e.dst) FROM e
UNION ALL SELECT 'cycle', CAST(b.c AS VARCHAR), b.c || ' > ' || path, CAST(d.dist AS BIGINT), true FROM b JOIN d ON d.c = b.c AND d.node = b.c WHERE b.dist = 1""")
def namespace_graph(spark: SparkSession, d: str) -> DataFrame:
    """Trade between nations: nodes with their suppliers, edges with their lines, and a shortest path of each cycle."""
    members = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("node"))
    return graph.dependency_graph(members, trade(spark, d))


@query("namespace_circular_edges", f"WITH RECURSIVE {_PATHS_SQL} SELECT c AS component, src, dst FROM i")
def namespace_circular_edges(spark: SparkSession, d: str) -> DataFrame:
    """Only what is circular of the same graph."""
    edges = trade(spark, d).filter("src <> dst")
    return graph.circular_edges(edges, graph.cycles(edges))


@query("override_roots", f"""WITH RECURSIVE {_TREE_SQL}, up(start, node) AS (SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation UNION SELECT start, parent FROM up JOIN edges ON child = node WHERE parent <> 'world'),
roots AS (SELECT start, node AS root FROM up WHERE node NOT IN (SELECT child FROM edges WHERE parent <> 'world')),
down(root, node) AS (SELECT DISTINCT root, child FROM roots JOIN edges ON parent = root UNION SELECT root, child FROM down JOIN edges ON parent = node)
SELECT start, root, node FROM roots JOIN down USING (root)""")
def override_roots(spark: SparkSession, d: str) -> DataFrame:
    """All nations at once: the region each leads up to, and all that is below that."""
    tree = _tree(spark, d).filter("parent <> 'world'").toDF("member", "overridden")
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("member"))
    roots, below = graph.overrides(tree, nations)
    return roots.join(below, "root").select("start", "root", "node")


_TERMS_SQL = """t AS (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[^\\s.,;:!?]+')) AS w FROM benchmark)),
m AS (SELECT DISTINCT role AS file, text AS name FROM conversations WHERE turn % 2 = 0 AND text IS NOT NULL)"""


@query("related_tests_by_terms", f"WITH {_TERMS_SQL} SELECT file, name, string_agg(term, ',' ORDER BY term) AS terms FROM m JOIN t ON contains(lower(name || chr(10) || file), term) GROUP BY file, name")
def related_tests_by_terms(spark: SparkSession, d: str) -> DataFrame:
    """Even turns as tests that hold a word of the benchmark, of which some are one or two letters long; the words stay in Spark."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([^\s.,;:!?]+)"), 1)
    terms = table(spark, d, "benchmark").select(F.explode(words).alias("term"))
    turns = table(spark, d, "conversations").filter("text is not null").select(F.col("role").alias("file"), F.col("text").alias("name"), "turn")
    return testing.related_by_terms(turns.filter("turn % 2 = 0"), terms, turns.filter("turn = 1").select("file", "name"))


_LEVELS_SQL = """s AS (SELECT 'o' || o_orderkey AS span_id, o_custkey % 7 AS scope, epoch(o_orderdate) AS lo, epoch(o_orderdate) + CASE WHEN o_orderkey % 1000 = 0 THEN 1000000000 WHEN o_orderkey % 50 = 0 THEN 40000000 ELSE 86400 * (o_orderkey % 5) END AS hi FROM orders),
p AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, l_orderkey % 7 AS scope, epoch(l_shipdate) AS pos FROM lineitem)"""


@query("enclosing_long_spans", f"WITH {_LEVELS_SQL} SELECT point_id, arg_min(span_id, (hi - lo, span_id)) AS span_id FROM p JOIN s ON p.scope = s.scope AND pos BETWEEN lo AND hi GROUP BY point_id")
def enclosing_long_spans(spark: SparkSession, d: str) -> DataFrame:
    """The shortest order around the shipping of each line; some orders last days, some a year and some over thirty."""
    key, began = F.col("o_orderkey"), F.unix_timestamp("o_orderdate")
    length = F.when(key % 1000 == 0, 1_000_000_000).when(key % 50 == 0, 40_000_000).otherwise(86_400 * (key % 5))
    spans = table(spark, d, "orders").select(F.concat(F.lit("o"), key.cast("string")).alias("span_id"), (F.col("o_custkey") % 7).alias("scope"), began.alias("lo"), (began + length).alias("hi"))
    points = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), (F.col("l_orderkey") % 7).alias("scope"), F.unix_timestamp("l_shipdate").alias("at"))
    return lookup.enclosing(points, spans)


_NESTED_SQL = """o AS (SELECT l_orderkey AS id, list('p' || l_partkey || '[' || l_suppkey || ', 1]' ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem GROUP BY l_orderkey),
n AS (SELECT id, p[1] AS head, array_to_string(list_transform(p[2:], lambda x: 'f(' || x || ', '), '') || 'g(x)' || repeat(')', len(p) - 1) AS rest FROM o)"""


@query("restructure_nested", f"WITH {_NESTED_SQL} SELECT id, 'y = h(' || rest || ', ' || head || ') + h(''f(a, b)'', z); o.f(q, r)' AS rewritten, 2 AS changes FROM n")
def restructure_nested(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as calls in one another: the outer call's arguments change places, quoted ones and calls of a member stay."""
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("["), F.col("l_suppkey").cast("string"), F.lit(", 1]"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", part.alias("p")))).alias("l"))
    calls = F.array_join(F.transform("l", lambda x: F.concat(F.lit("f("), x["p"], F.lit(", "))), "")
    text = F.concat(F.lit("y = "), calls, F.lit("g(x)"), F.repeat(F.lit(")"), F.size("l")), F.lit(" + f( z,'f(a, b)' ); o.f(q, r)"))
    return changes.restructured(lines.select("id", text.alias("text")), "f(__a__, __b__)", "h(__b__, __a__)").select("id", "rewritten", "changes")


@query("restructure_repeated", """SELECT l_orderkey * 10 + l_linenumber AS id, 'if (same(k' || l_partkey % 10 || ' + 1)) { g(k' || l_suppkey % 10 || '); }' AS rewritten, 1 AS changes FROM lineitem WHERE l_partkey % 10 = l_suppkey % 10 GROUP BY ALL""")
def restructure_repeated(spark: SparkSession, d: str) -> DataFrame:
    """A placeholder that comes twice matches the same tokens, however they are spaced."""
    a, b = ((F.col(c) % 10).cast("string") for c in ("l_partkey", "l_suppkey"))
    text = F.concat(F.lit("if (eq(k"), a, F.lit(" + 1, k"), b, F.lit("+1)) { g(k"), b, F.lit("); }"))
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("text")).distinct()
    return changes.restructured(lines, "eq(__a__, __a__)", "same(__a__)").select("id", "rewritten", "changes")


#: Suppliers as types and parts as their members; names, kinds and attributes follow from keys and prices.
_SYMBOLS_SQL = """types AS (SELECT 't' || s_suppkey AS symbol, 'T' || s_suppkey || CASE s_suppkey % 9 WHEN 0 THEN 'Tests' WHEN 1 THEN 'ModelSnapshot' WHEN 2 THEN 'Test' ELSE '' END AS name, s_suppkey % 4 = 1 AS is_static, s_suppkey AS k,
  CASE s_suppkey % 6 WHEN 5 THEN 'Interface' WHEN 4 THEN 'Enum' ELSE 'Class' END AS type_kind, s_suppkey % 6 = 3 AS is_record, CASE WHEN s_acctbal > 5000 THEN 'Public' ELSE 'Internal' END AS accessibility FROM supplier),
n AS (SELECT count(*) AS n FROM supplier),
members AS (SELECT 'm' || p_partkey AS symbol, CASE WHEN p_size = 7 THEN 'Main' WHEN p_size = 8 THEN 'Invoke' ELSE replace(p_name, ' ', '_') END AS name, CASE p_type WHEN 'SMALL' THEN 'property' WHEN 'LARGE' THEN 'field' ELSE 'method' END AS kind, 't' || (p_partkey * 7 % n) AS container,
  CASE WHEN p_size % 3 = 0 THEN 'Public' ELSE 'Private' END AS accessibility, CASE WHEN p_size % 10 = 1 THEN 'Constructor' ELSE 'Ordinary' END AS method_kind, CASE WHEN p_size % 2 = 0 THEN 'HttpContext' ELSE 'int,' || p_brand END AS parameters,
  p_size % 2 = 1 AS is_static, p_size % 11 = 5 AS is_override, p_size % 13 = 4 AS is_extension, p_brand, p_partkey FROM part, n),
symbols AS (SELECT symbol, name, 'type' AS kind, CAST(NULL AS VARCHAR) AS container, accessibility, CAST(NULL AS VARCHAR) AS method_kind, type_kind, CAST(NULL AS VARCHAR) AS parameters, is_static, is_record, false AS is_override, false AS is_extension FROM types
  UNION ALL SELECT m.symbol, m.name, m.kind, m.container, m.accessibility, m.method_kind, t.type_kind, m.parameters, m.is_static, t.is_record, m.is_override, m.is_extension FROM members m JOIN types t ON t.symbol = m.container),
attributes AS (SELECT symbol, CASE p_brand WHEN 'Brand#1' THEN 'FactAttribute' WHEN 'Brand#2' THEN 'Route' WHEN 'Brand#3' THEN 'MigrationAttribute' WHEN 'Brand#4' THEN 'DataMemberAttribute' WHEN 'Brand#5' THEN 'JsonPropertyNameAttribute' ELSE 'Obsolete' END AS attribute FROM members WHERE p_partkey % 3 = 0
  UNION ALL SELECT symbol, CASE k % 17 WHEN 3 THEN 'TestClassAttribute' WHEN 4 THEN 'McpServerToolTypeAttribute' ELSE 'Serializable' END FROM types),
bases AS (SELECT symbol, 't' || (k // 2) AS base, CASE WHEN k % 23 = 5 THEN 'Hub' ELSE 'T' || (k // 2) END AS base_name FROM types WHERE k > 1),
refs AS (SELECT DISTINCT 'm' || l_partkey AS target FROM lineitem WHERE l_quantity >= 45),
outside AS (SELECT DISTINCT container, name, parameters FROM members JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity = 3)"""
_UNUSED_SQL = f"""WITH RECURSIVE {_SYMBOLS_SQL},
fixture AS (SELECT symbol FROM types WHERE name LIKE '%Tests' OR name LIKE '%Test' UNION SELECT symbol FROM attributes WHERE attribute = 'TestClassAttribute'),
inh(symbol) AS (SELECT symbol FROM bases WHERE base_name = 'Hub' UNION SELECT b.symbol FROM inh JOIN bases b ON b.base = inh.symbol),
conv AS (SELECT symbol FROM types WHERE name LIKE '%ModelSnapshot' UNION SELECT symbol FROM inh UNION SELECT container FROM symbols WHERE kind = 'method' AND accessibility = 'Public' AND name = 'Invoke' AND parameters = 'HttpContext'
  UNION SELECT symbol FROM attributes WHERE attribute = 'McpServerToolTypeAttribute' UNION SELECT symbol FROM fixture),
x AS (SELECT s.*, CASE
  WHEN symbol IN (SELECT symbol FROM conv) OR container IN (SELECT symbol FROM conv) OR symbol IN (SELECT symbol FROM attributes WHERE attribute = 'MigrationAttribute') THEN 'convention-invoked'
  WHEN accessibility = 'Public' AND NOT {{public}} THEN 'public' WHEN kind = 'method' AND method_kind = 'Constructor' THEN 'method-kind'
  WHEN symbol IN (SELECT symbol FROM members WHERE p_partkey % 19 = 0) THEN 'interface-implementation' WHEN kind IN ('method', 'property') AND is_override THEN 'override'
  WHEN kind = 'method' AND name = 'Main' AND is_static THEN 'entry-point' WHEN symbol IN (SELECT symbol FROM attributes WHERE attribute IN ('FactAttribute', 'Route', 'DataMemberAttribute')) THEN 'framework-attribute'
  WHEN kind = 'type' AND is_static AND symbol IN (SELECT container FROM symbols WHERE is_extension) THEN 'extension-host' END AS reason FROM symbols s)"""


def _symbols(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Symbols with their attributes, bases, implementations and references."""
    suppliers, parts = table(spark, d, "supplier"), table(spark, d, "part")
    k = F.col("s_suppkey")
    end = F.when(k % 9 == 0, "Tests").when(k % 9 == 1, "ModelSnapshot").when(k % 9 == 2, "Test").otherwise("")
    kind = F.when(k % 6 == 5, "Interface").when(k % 6 == 4, "Enum").otherwise("Class")
    types = suppliers.select(
        F.concat(F.lit("t"), k.cast("string")).alias("symbol"), F.concat(F.lit("T"), k.cast("string"), end).alias("name"), k.alias("k"), kind.alias("type_kind"), (k % 6 == 3).alias("is_record"),
        (k % 4 == 1).alias("is_static"), F.when(F.col("s_acctbal") > 5000, "Public").otherwise("Internal").alias("accessibility"),
    )
    n = suppliers.agg(F.count("*").alias("n"))  # one row
    p, size = F.col("p_partkey"), F.col("p_size")
    members = parts.crossJoin(F.broadcast(n)).select(
        F.concat(F.lit("m"), p.cast("string")).alias("symbol"), F.when(size == 7, "Main").when(size == 8, "Invoke").otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"),
        F.when(F.col("p_type") == "SMALL", "property").when(F.col("p_type") == "LARGE", "field").otherwise("method").alias("kind"), F.concat(F.lit("t"), (p * 7 % F.col("n")).cast("string")).alias("container"),
        F.when(size % 3 == 0, "Public").otherwise("Private").alias("accessibility"), F.when(size % 10 == 1, "Constructor").otherwise("Ordinary").alias("method_kind"),
        F.when(size % 2 == 0, "HttpContext").otherwise(F.concat(F.lit("int,"), F.col("p_brand"))).alias("parameters"), (size % 2 == 1).alias("is_static"), (size % 11 == 5).alias("is_override"),
        (size % 13 == 4).alias("is_extension"), "p_brand", "p_partkey",
    )
    own = types.select(F.col("symbol").alias("container"), "type_kind", "is_record")
    columns = ["symbol", "name", "kind", "container", "accessibility", "method_kind", "type_kind", "parameters", "is_static", "is_record", "is_override", "is_extension"]
    none = F.lit(None).cast("string")
    all_types = types.withColumns({"kind": F.lit("type"), "container": none, "method_kind": none, "parameters": none, "is_override": F.lit(False), "is_extension": F.lit(False)})
    names = {"Brand#1": "FactAttribute", "Brand#2": "Route", "Brand#3": "MigrationAttribute", "Brand#4": "DataMemberAttribute", "Brand#5": "JsonPropertyNameAttribute"}
    of_member = F.coalesce(*(F.when(F.col("p_brand") == b, a) for b, a in names.items()), F.lit("Obsolete"))
    of_type = F.when(k % 17 == 3, "TestClassAttribute").when(k % 17 == 4, "McpServerToolTypeAttribute").otherwise("Serializable")
    above = F.floor(F.col("k") / 2).cast("string")
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return {
        "symbols": all_types.select(columns).unionByName(members.join(own, "container").select(columns)),
        "attributes": members.filter("p_partkey % 3 = 0").select("symbol", of_member.alias("attribute")).union(types.withColumn("s_suppkey", F.col("k")).select("symbol", of_type)),
        "bases": types.filter("k > 1").select("symbol", F.concat(F.lit("t"), above).alias("base"), F.when(F.col("k") % 23 == 5, "Hub").otherwise(F.concat(F.lit("T"), above)).alias("base_name")),
        "implements": members.filter("p_partkey % 19 = 0").select("symbol"),
        "refs": lines.filter("l_quantity >= 45").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("target")).distinct(),
        "outside": members.join(lines.filter("l_quantity = 3"), "p_partkey", "left_semi").select("container", "name", "parameters"),
    }


@query("unused_by_rules", f"""{_UNUSED_SQL.format(public='true')},
o AS (SELECT container, name FROM symbols WHERE kind = 'method' AND method_kind = 'Ordinary' GROUP BY container, name HAVING count(*) > 1)
SELECT symbol, CASE WHEN (container IS NOT NULL AND type_kind = 'Interface') OR (kind = 'field' AND type_kind = 'Enum') OR (kind = 'property' AND (is_record OR symbol IN (SELECT symbol FROM attributes WHERE attribute IN ('JsonPropertyNameAttribute', 'DataMemberAttribute')))) THEN 'low'
  WHEN accessibility = 'Public' THEN 'medium' ELSE 'high' END AS confidence
FROM x WHERE reason IS NULL AND symbol NOT IN (SELECT target FROM refs)
  AND NOT (kind = 'method' AND (is_extension OR (container, name) IN (SELECT (container, name) FROM o)) AND EXISTS (SELECT 1 FROM outside z WHERE z.container = x.container AND z.name = x.name AND z.parameters = x.parameters))""")
def unused_by_rules(spark: SparkSession, d: str) -> DataFrame:
    """Members and types without references, public ones too, by all rules that hold by default."""
    s = _symbols(spark, d)
    rules = tuple(r for r in unused.DEFAULT_RULES if r != "public")
    excluded = unused.exclusions(s["symbols"], s["attributes"], s["bases"], s["implements"], rules)
    return unused.unused(s["symbols"], s["refs"], s["outside"], excluded, s["attributes"])


@query("unused_exclusions", f"{_UNUSED_SQL.format(public='false')} SELECT symbol, reason FROM x WHERE reason IS NOT NULL")
def unused_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Why symbols are never reported: the first rule that each falls under."""
    s = _symbols(spark, d)
    return unused.exclusions(s["symbols"], s["attributes"], s["bases"], s["implements"])


#: Brands as domain types with a carrier each and one mapper for two; parts give their properties, orders the methods' texts.
_MIRRORED_SQL = """b AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS k FROM part),
types AS (SELECT 'd' || k AS type, 'Item' || k || 'x' AS name, false AS is_record FROM b UNION ALL SELECT 'c' || k, 'Item' || k || CASE k % 3 WHEN 0 THEN 'Dto' WHEN 1 THEN 'Snapshot' ELSE 'Row' END, k % 4 = 2 FROM b UNION ALL SELECT 'm' || k, 'Item' || k || CASE WHEN k % 5 = 0 THEN 'Helper' ELSE 'Mapper' END, false FROM b),
props AS (SELECT DISTINCT 'd' || substr(p_brand, 7) AS type, replace(p_name, ' ', '') AS property, CASE WHEN p_size % 4 = 0 THEN 'j' || p_size END AS json_name FROM part WHERE p_size <= 16
  UNION SELECT 'c' || substr(p_brand, 7), CASE WHEN p_size % 4 = 0 THEN 'Other' || p_size ELSE replace(p_name, ' ', '') END, CASE WHEN p_size % 4 = 0 THEN 'j' || p_size END FROM part WHERE p_size >= 12),
methods AS (SELECT 'm' || k AS type, o AS ord, CASE o WHEN 1 THEN 'Map' WHEN 2 THEN 'ToCarrier' ELSE 'FromCarrier' END AS name, 'Item' || k || CASE k % 3 WHEN 0 THEN 'Dto' WHEN 1 THEN 'Snapshot' ELSE 'Row' END || ' F(Item' || k || 'x x)' AS signature,
  coalesce((SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT DISTINCT replace(p_name, ' ', '') AS x FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) = k AND p_size % 3 = o - 1)), '') AS body FROM b, (SELECT unnest([1, 2, 3]) AS o) WHERE NOT (k % 7 = 0 AND o = 3))"""


def _mirrored(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    parts = table(spark, d, "part").select(F.substring("p_brand", 7, 9).alias("b"), F.replace("p_name", F.lit(" "), F.lit("")).alias("name"), "p_size")
    k = F.col("k")
    brands = parts.select(F.col("b").cast("int").alias("k")).distinct()
    end = F.when(k % 3 == 0, "Dto").when(k % 3 == 1, "Snapshot").otherwise("Row")

    def named(letter: str, e, record):
        return brands.select(F.concat(F.lit(letter), k.cast("string")).alias("type"), F.concat(F.lit("Item"), k.cast("string"), e).alias("name"), record.alias("is_record"))

    types = named("d", F.lit("x"), F.lit(False)).union(named("c", end, k % 4 == 2)).union(named("m", F.when(k % 5 == 0, "Helper").otherwise("Mapper"), F.lit(False)))
    json = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("j"), F.col("p_size").cast("string")))
    own = parts.filter("p_size <= 16").select(F.concat(F.lit("d"), F.col("b")).alias("type"), F.col("name").alias("property"), json.alias("json_name"))
    other = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Other"), F.col("p_size").cast("string"))).otherwise(F.col("name"))
    theirs = parts.filter("p_size >= 12").select(F.concat(F.lit("c"), F.col("b")).alias("type"), other.alias("property"), json.alias("json_name"))
    texts = parts.groupBy(F.col("b").cast("int").alias("k"), (F.col("p_size") % 3 + 1).cast("int").alias("ord")).agg(F.array_join(F.array_sort(F.collect_set("name")), ";").alias("body"))
    three = brands.select("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("ord")).filter("not (k % 7 = 0 and ord = 3)").join(texts, ["k", "ord"], "left")
    signature = F.concat(F.lit("Item"), k.cast("string"), end, F.lit(" F(Item"), k.cast("string"), F.lit("x x)"))
    methods = three.select(
        F.concat(F.lit("m"), k.cast("string")).alias("type"), "ord", F.when(F.col("ord") == 1, "Map").when(F.col("ord") == 2, "ToCarrier").otherwise("FromCarrier").alias("name"), signature.alias("signature"),
        F.coalesce("body", F.lit("")).alias("body"),
    )
    return {"starts": own.select("type", "property"), "types": types, "properties": own.union(theirs).distinct(), "methods": methods}


@query("impact_one_sided", f"""WITH {_MIRRORED_SQL},
pairs AS (SELECT DISTINCT a.type AS domain, a.property, c.type AS carrier, c.property AS mirror FROM props a JOIN props c ON (a.property = c.property OR a.json_name = c.json_name) AND a.type <> c.type JOIN types t ON t.type = c.type
  WHERE a.type LIKE 'd%' AND (t.is_record OR t.name LIKE '%Dto' OR t.name LIKE '%Snapshot' OR t.name LIKE 'Snapshot%')),
maps AS (SELECT DISTINCT p.domain, p.carrier, m.type FROM (SELECT DISTINCT domain, carrier FROM pairs) p JOIN types d ON d.type = p.domain JOIN types c ON c.type = p.carrier JOIN methods m ON contains(m.signature, d.name) AND contains(m.signature, c.name) JOIN types t ON t.type = m.type WHERE t.name LIKE '%Mapper'),
w AS (SELECT maps.domain, maps.carrier, CASE WHEN m.name LIKE 'To%' THEN 'To' ELSE 'From' END AS way, arg_min(m.body, (m.type, m.ord)) AS body FROM maps JOIN methods m ON m.type = maps.type WHERE m.name LIKE 'To%' OR m.name LIKE 'From%' GROUP BY ALL),
s AS (SELECT DISTINCT p.*, w.way FROM pairs p JOIN w USING (domain, carrier) WHERE contains(w.body, p.property) OR contains(w.body, p.mirror)),
f AS (SELECT p.domain, p.property, p.carrier, p.mirror, coalesce(bool_or(way = 'To'), false) AS t, coalesce(bool_or(way = 'From'), false) AS f FROM pairs p LEFT JOIN s ON s.domain = p.domain AND s.property = p.property AND s.carrier = p.carrier AND s.mirror = p.mirror
  WHERE (p.domain, p.carrier) IN (SELECT (domain, carrier) FROM maps) GROUP BY ALL)
SELECT domain, property, carrier, mirror, concat_ws(',', CASE WHEN t THEN 'To' END, CASE WHEN f THEN 'From' END) AS present, concat_ws(',', CASE WHEN NOT t THEN 'To' END, CASE WHEN NOT f THEN 'From' END) AS missing FROM f WHERE NOT (t AND f)""")
def impact_one_sided(spark: SparkSession, d: str) -> DataFrame:
    """All properties of all brands at once: those that a mapper carries one way only, or not at all."""
    return mirrored.one_sided(**_mirrored(spark, d))


#: Events as nodes, each below the one before of its user; kinds and places in them by key.
_USAGE_KINDS = [
    "QualifiedName", "TypeArgumentList", "MethodDeclaration", "Parameter", "PropertyDeclaration", "VariableDeclaration", "FieldDeclaration", "SimpleBaseType", "CastExpression", "AsExpression", "IsPatternExpression",
    "ObjectCreationExpression", "SimpleMemberAccessExpression", "SimpleAssignmentExpression", "ObjectInitializerExpression", "Argument", "NullableType", "Block", "QualifiedName", "VariableDeclaration",
]
_SLOTS = ["Type", "ReturnType", "Left", "Right", "Expression", "Type"]
_NODES_SQL = f"""nodes AS (SELECT event_id AS node, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent, CASE WHEN event_id % 331 = 7 THEN 'TypeCref' ELSE {_USAGE_KINDS}[event_id * 7 % 20 + 1] END AS kind, {_SLOTS}[event_id % 6 + 1] AS slot,
  CASE WHEN event_id % 2 = 0 THEN 'out' END AS modifier FROM events),
a AS (SELECT n.node AS ref, n.slot, p.node AS p, p.kind AS p_kind, p.slot AS p_slot, p.modifier AS p_modifier, g.kind AS g_kind FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN nodes g ON g.node = p.parent)"""


def _usage_nodes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 331 == 7, "TypeCref").otherwise(F.get(F.array(*map(F.lit, _USAGE_KINDS)), (i * 7 % 20).cast("int")))
    parent = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    slot = F.get(F.array(*map(F.lit, _SLOTS)), (i % 6).cast("int"))
    return table(spark, d, "events").select(i.alias("node"), parent.alias("parent"), kind.alias("kind"), slot.alias("slot"), F.when(i % 2 == 0, "out").alias("modifier"))


def _class_sql() -> str:
    """The cases of the table, in its order."""
    each = []
    for name, kinds, slot in usages.TYPE_CLASSES:
        each.append(f"WHEN p_kind IN {_in(list(kinds) + [''])}" + (f" AND slot = '{slot}'" if slot else "") + f" THEN '{name}'")
    return " ".join(each)


@query("type_usage_classes", f"""WITH RECURSIVE {_NODES_SQL}, doc(node) AS (SELECT node FROM nodes WHERE kind = 'TypeCref' UNION SELECT n.node FROM doc JOIN nodes n ON n.parent = doc.node),
up(ref, pos) AS (SELECT node, node FROM nodes WHERE node % 4 = 1 UNION ALL SELECT up.ref, w.node FROM up JOIN nodes n ON n.node = up.pos JOIN nodes w ON w.node = n.parent AND w.kind IN ('QualifiedName', 'NullableType')),
top AS (SELECT up.ref, a.* EXCLUDE (ref) FROM up JOIN a ON a.ref = up.pos WHERE coalesce(a.p_kind, '') NOT IN ('QualifiedName', 'NullableType'))
SELECT ref, CASE WHEN ref IN (SELECT node FROM doc) THEN 'Documentation' WHEN ref % 3 = 0 AND p_kind = 'SimpleMemberAccessExpression' AND slot = 'Expression' THEN 'StaticMemberAccess'
  WHEN p_kind = 'VariableDeclaration' AND slot = 'Type' AND g_kind = 'FieldDeclaration' THEN 'FieldType' {_class_sql()} ELSE 'Other' END AS classification FROM top""")
def type_usage_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth node as a reference to a type."""
    nodes = _usage_nodes(spark, d)
    refs = nodes.filter("node % 4 = 1").select(F.col("node").alias("ref"), "node", (F.col("node") % 3 == 0).alias("is_static"))
    return usages.type_usages(refs, nodes)


@query("property_write_kinds", f"""WITH {_NODES_SQL} SELECT ref, CASE WHEN p_kind LIKE '%AssignmentExpression' AND slot = 'Left' THEN CASE WHEN g_kind LIKE '%InitializerExpression' THEN 'ObjectInitializer' ELSE 'Assignment' END
  WHEN p_kind = 'SimpleMemberAccessExpression' AND g_kind LIKE '%AssignmentExpression' AND p_slot = 'Left' THEN 'Assignment' WHEN p_kind = 'Argument' AND p_modifier = 'out' THEN 'OutRef' END AS classification FROM a WHERE classification IS NOT NULL""")
def property_write_kinds(spark: SparkSession, d: str) -> DataFrame:
    """All nodes as references to a property; those that write it."""
    nodes = _usage_nodes(spark, d)
    return usages.property_writes(nodes.select(F.col("node").alias("ref"), "node"), nodes)


_METHODS_OF = ["GetType", "CreateInstance", "Load", "Invoke", "GetValue", "GetMethods", "Other"]
_TYPES_OF = ["Type", "Activator", "Assembly", "PropertyInfo", "Own"]


@query("reflection_calls", f"""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS site, CASE l_suppkey % 3 WHEN 0 THEN 'System' WHEN 1 THEN 'System.Reflection' ELSE 'Own' END AS namespace, {_TYPES_OF}[l_partkey % 5 + 1] AS type, {_METHODS_OF}[CAST(l_quantity AS BIGINT) % 7 + 1] AS method, CASE WHEN l_tax > 0.05 THEN l_returnflag END AS argument FROM lineitem WHERE l_linestatus = 'O')
SELECT DISTINCT site, CASE WHEN namespace = 'System' AND type = 'Type' AND method = 'GetType' THEN 'Type.GetType' WHEN namespace = 'System' AND type = 'Activator' AND method = 'CreateInstance' THEN 'Activator.CreateInstance' WHEN namespace = 'System.Reflection' AND type = 'Assembly' AND method IN ('GetType', 'Load') THEN 'Assembly.' || method
  WHEN namespace = 'System.Reflection' AND method = 'Invoke' THEN 'Reflection.Invoke' WHEN namespace = 'System.Reflection' AND type = 'PropertyInfo' AND method = 'GetValue' THEN 'PropertyInfo.GetValue' WHEN type = 'Type' AND method = 'GetMethods' THEN 'Type.GetMethods' END AS kind, argument FROM c WHERE kind IS NOT NULL
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'typeof', l_returnflag FROM lineitem WHERE l_linestatus = 'F' AND l_discount = 0.1""")
def reflection_calls(spark: SparkSession, d: str) -> DataFrame:
    """Open lines as calls, of which some are known, and some others as ``typeof``."""
    lines = table(spark, d, "lineitem").withColumn("site", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    space = F.when(F.col("l_suppkey") % 3 == 0, "System").when(F.col("l_suppkey") % 3 == 1, "System.Reflection").otherwise("Own")
    owner = F.get(F.array(*map(F.lit, _TYPES_OF)), (F.col("l_partkey") % 5).cast("int"))
    method = F.get(F.array(*map(F.lit, _METHODS_OF)), (F.col("l_quantity").cast("long") % 7).cast("int"))
    calls = lines.filter("l_linestatus = 'O'").select("site", space.alias("namespace"), owner.alias("type"), method.alias("method"), F.when(F.col("l_tax") > 0.05, F.col("l_returnflag")).alias("argument"))
    return usages.reflection_calls(calls, lines.filter("l_linestatus = 'F' and l_discount = 0.1").select("site", F.col("l_returnflag").alias("argument")))


@query("impact_places", """WITH l AS (SELECT * FROM lineitem WHERE l_suppkey = 3), x AS (SELECT DISTINCT 'lines' AS kind, l_orderkey * 10 + l_linenumber AS id FROM l UNION SELECT 'orders', l_orderkey FROM l UNION SELECT 'customers', o_custkey FROM l JOIN orders ON l_orderkey = o_orderkey)
SELECT kind, CAST(id AS VARCHAR) AS id, total FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS total, row_number() OVER (PARTITION BY kind ORDER BY id) AS rn FROM x) WHERE rn BETWEEN 6 AND 25""")
def impact_places(spark: SparkSession, d: str) -> DataFrame:
    """The second page of what a supplier's change touches."""
    lines = table(spark, d, "lineitem").filter("l_suppkey = 3").select("l_orderkey", "l_linenumber")
    customers = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"))
    return graph.impact_rows({"lines": lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")), "orders": lines.select(F.col("l_orderkey").alias("id")), "customers": customers}, offset=5, limit=20)


@query("relationship_places", """WITH x AS (SELECT 'definition' AS kind, p_partkey AS id FROM part WHERE p_partkey = 9 UNION SELECT 'references', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_partkey = 9 UNION SELECT 'suppliers', l_suppkey FROM lineitem WHERE l_partkey = 9
  UNION SELECT 'siblings', p_partkey FROM part WHERE p_partkey <> 9 AND p_brand = (SELECT p_brand FROM part WHERE p_partkey = 9))
SELECT kind, CAST(id AS VARCHAR) AS id, total FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS total, row_number() OVER (PARTITION BY kind ORDER BY id) AS rn FROM x) WHERE rn <= 50""")
def relationship_places(spark: SparkSession, d: str) -> DataFrame:
    """The places that a part is related to, fifty of each kind."""
    parts, lines = table(spark, d, "part"), table(spark, d, "lineitem").filter("l_partkey = 9")
    own = parts.filter("p_partkey = 9")
    return graph.impact_rows({
        "definition": own.select(F.col("p_partkey").alias("id")), "references": lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")), "suppliers": lines.select(F.col("l_suppkey").alias("id")),
        "siblings": parts.filter("p_partkey <> 9").join(own.select("p_brand"), "p_brand", "left_semi").select(F.col("p_partkey").alias("id")),
    }, limit=50)


@query("operations_subtree", f"""WITH RECURSIVE {_TREE_SQL}, r(node, parent, depth) AS (SELECT 'r0', NULL::VARCHAR, 0 UNION ALL SELECT e.child, e.parent, depth + 1 FROM r JOIN edges e ON e.parent = r.node WHERE depth < 3)
SELECT node, parent, depth, CASE substr(node, 1, 1) WHEN 'n' THEN 'nation' WHEN 's' THEN 'supplier' END AS kind FROM r""")
def operations_subtree(spark: SparkSession, d: str) -> DataFrame:
    """A region's nations and suppliers as a tree of operations."""
    tree = _tree(spark, d)
    first = F.substring("child", 1, 1)
    return graph.subtree(tree, "r0", tree.select(F.col("child").alias("node"), F.when(first == "n", "nation").when(first == "s", "supplier").alias("kind")), 3)


_CAUGHT_SQL = """c AS (SELECT event_id AS site, event_type = 'error' AS exact FROM events WHERE event_type IN ('error', 'purchase', 'signup') AND value > 90)"""


@query("exception_flow_page", f"WITH {_CAUGHT_SQL} SELECT site, NOT exact AS catches_base, (SELECT count(*) >= 40 FROM c) AS truncated FROM c ORDER BY site LIMIT 40")
def exception_flow_page(spark: SparkSession, d: str) -> DataFrame:
    """The first forty sites that catch an error or what is above it, and whether there may be more."""
    sites = table(spark, d, "events").filter("value > 90").select(F.col("event_id").alias("site"), F.col("event_type").alias("declared"))
    up = spark.createDataFrame([("error", True), ("purchase", False), ("signup", False)], "type string, exact boolean")
    return diagnostics.caught_page(diagnostics.caught(sites, up, "root"), ["site"], 40).select("site", "catches_base", "truncated")


@query("control_flow_points", f"""WITH RECURSIVE {TRADE_SQL}, s AS (SELECT DISTINCT src, dst FROM trade), i AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey IN (0, 1, 2)),
r(node) AS (SELECT node FROM i WHERE node = 0 UNION SELECT dst FROM r JOIN s ON src = node WHERE dst IN (SELECT node FROM i))
SELECT DISTINCT 'entry' AS point, dst AS node FROM s WHERE dst IN (SELECT node FROM i) AND src NOT IN (SELECT node FROM i) UNION ALL SELECT DISTINCT 'exit', src FROM s WHERE src IN (SELECT node FROM i) AND dst NOT IN (SELECT node FROM i)
UNION ALL SELECT 'return', node FROM i WHERE node % 4 = 3 UNION ALL SELECT 'unreachable', node FROM i WHERE node NOT IN (SELECT node FROM r)""")
def control_flow_points(spark: SparkSession, d: str) -> DataFrame:
    """Trade as steps, the nations of three regions as the part that is looked at, from the first of them."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), "n_regionkey")
    kinds = nations.select("node", F.when(F.col("node") % 4 == 3, "return").otherwise("call").alias("kind"))
    return graph.control_flow(trade(spark, d), nations.filter(F.col("n_regionkey").isin(0, 1, 2)), kinds, 0)
