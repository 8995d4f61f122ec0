"""Graph queries over nations, suppliers, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators import graph
from factloom.plans.base import TRADE_SQL, query, table, trade

_COUPLING = f"""WITH {TRADE_SQL}, e AS (SELECT DISTINCT src, dst FROM trade WHERE src <> dst),
ce AS (SELECT src AS node, count(*) AS ce FROM e GROUP BY src), ca AS (SELECT dst AS node, count(*) AS ca FROM e GROUP BY dst),
b AS (SELECT n_nationkey AS node, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM nation LEFT JOIN ca ON n_nationkey = ca.node LEFT JOIN ce ON n_nationkey = ce.node),
i AS (SELECT *, CASE WHEN ca + ce = 0 THEN 0.0::DOUBLE ELSE ce / (ca + ce) END AS instability FROM b)
SELECT *, CASE WHEN ca + ce = 0 THEN 'isolated' WHEN instability < 0.3 THEN 'stable' WHEN instability > 0.7 THEN 'unstable' ELSE 'balanced' END AS classification FROM i"""


@query("coupling_metrics", _COUPLING)
def coupling_metrics(spark: SparkSession, d: str) -> DataFrame:
    return graph.coupling(table(spark, d, "nation").select(F.col("n_nationkey").alias("node")), trade(spark, d))


@query("coupling_top", f"SELECT * FROM ({_COUPLING}) ORDER BY instability DESC, ce DESC, node LIMIT 10")
def coupling_top(spark: SparkSession, d: str) -> DataFrame:
    """The report of the ten least stable nodes."""
    return graph.coupling(table(spark, d, "nation").select(F.col("n_nationkey").alias("node")), trade(spark, d), limit=10)


@query("namespace_dependencies", f"WITH {TRADE_SQL} SELECT src, dst, count(*) AS weight FROM trade WHERE src <> dst GROUP BY src, dst")
def namespace_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependency_edges(trade(spark, d))


@query("namespace_nodes", f"""WITH {TRADE_SQL}, ends AS (SELECT src AS node FROM trade WHERE src <> dst UNION SELECT dst FROM trade WHERE src <> dst),
m AS (SELECT s_nationkey AS node, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT coalesce(ends.node, m.node) AS node, CAST(coalesce(n, 0) AS BIGINT) AS members FROM ends FULL JOIN m ON ends.node = m.node""")
def namespace_nodes(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("node"))
    return graph.dependency_nodes(members, graph.dependency_edges(trade(spark, d)))


_CLOSURE = f"WITH RECURSIVE {TRADE_SQL}, e AS (SELECT DISTINCT src, dst FROM trade), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


@query("project_reachability", f"{_CLOSURE} SELECT src, dst FROM r")
def project_reachability(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(trade(spark, d))


@query("namespace_cycles", f"{_CLOSURE}, m AS (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) SELECT min(dst) AS component, src AS node, count(*) AS size FROM m GROUP BY src")
def namespace_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(trade(spark, d))


@query("project_graph", """SELECT n_regionkey AS node, string_agg(k, ',' ORDER BY k) AS targets, count(*) AS n FROM (SELECT DISTINCT n_regionkey, CAST(n_nationkey AS VARCHAR) AS k FROM nation) GROUP BY n_regionkey""")
def project_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(table(spark, d, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst")))


_TREE_SQL = """edges AS (
  SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region
)"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Edges (child, parent): suppliers below nations below regions below the world."""
    def name(letter: str, c: str):
        return F.concat(F.lit(letter), F.col(c).cast("string"))

    nations = table(spark, d, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    suppliers = table(spark, d, "supplier").select(name("s", "s_suppkey").alias("child"), name("n", "s_nationkey").alias("parent"))
    regions = table(spark, d, "region").select(name("r", "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    return nations.unionByName(suppliers).unionByName(regions)


@query("type_hierarchy", f"""WITH RECURSIVE {_TREE_SQL}, r(node, parent, depth) AS (SELECT child, parent, 1 FROM edges WHERE parent = 'r1' UNION ALL SELECT e.child, e.parent, depth + 1 FROM r JOIN edges e ON e.parent = r.node)
SELECT node, parent, depth FROM r""")
def type_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return graph.hierarchy(_tree(spark, d), "r1")


@query("base_members", f"""WITH RECURSIVE {_TREE_SQL}, r(node, depth) AS (SELECT parent, 1 FROM edges WHERE child = 's3' UNION ALL SELECT e.parent, depth + 1 FROM r JOIN edges e ON e.child = r.node)
SELECT node, depth FROM r""")
def base_members(spark: SparkSession, d: str) -> DataFrame:
    return graph.ancestors(_tree(spark, d), "s3")


@query("document_symbols", f"""WITH RECURSIVE {_TREE_SQL}, r(node, parent, depth) AS (SELECT child, parent, 1 FROM edges WHERE parent = 'world' UNION ALL SELECT e.child, e.parent, depth + 1 FROM r JOIN edges e ON e.parent = r.node WHERE depth < 2)
SELECT r.node, r.parent, r.depth, coalesce(k.n, 0) AS children FROM r LEFT JOIN (SELECT parent, count(*) AS n FROM edges GROUP BY parent) k ON r.node = k.parent""")
def document_symbols(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    below = tree.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n"))
    return graph.hierarchy(tree, "world", most_depth=2).join(below, F.col("node") == F.col("of"), "left").select("node", "parent", "depth", F.coalesce("n", F.lit(0)).cast("long").alias("children"))


_CALLS_SQL = "calls AS (SELECT event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee, event_id AS site FROM events)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Transitions between the event types of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("caller"), F.lead("event_type").over(w).alias("callee"), F.col("event_id").alias("site"))


@query("call_edges", f"WITH {_CALLS_SQL} SELECT caller AS src, callee AS dst, count(*) AS weight FROM calls WHERE callee IS NOT NULL AND caller <> callee GROUP BY 1, 2")
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependency_edges(_calls(spark, d).filter("callee is not null").select(F.col("caller").alias("src"), F.col("callee").alias("dst")))


@query("callers_callees", f"""WITH {_CALLS_SQL}
SELECT * FROM (SELECT 'caller' AS direction, caller AS other, site FROM calls WHERE callee = 'purchase' ORDER BY other, site LIMIT 100)
UNION ALL SELECT 'callee', callee, min(site) FROM calls WHERE caller = 'purchase' AND callee IS NOT NULL GROUP BY callee""")
def callers_callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers_callees(_calls(spark, d).filter("callee is not null"), "purchase")


@query("impact_analysis", """WITH l AS (SELECT * FROM lineitem WHERE l_suppkey = 3)
SELECT 'lines' AS kind, count(DISTINCT l_orderkey || ':' || l_linenumber) AS affected FROM l UNION ALL SELECT 'orders', count(DISTINCT l_orderkey) FROM l
UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM l JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'nations', count(DISTINCT c_nationkey) FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def impact_analysis(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_suppkey = 3").select("l_orderkey", "l_linenumber")
    orders = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "o_custkey")
    nations = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("id"))
    return graph.impact({
        "lines": lines.select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id")),
        "orders": lines.select(F.col("l_orderkey").alias("id")),
        "customers": orders.select(F.col("o_custkey").alias("id")),
        "nations": nations,
    })


def _access(spark: SparkSession, d: str) -> DataFrame:
    """Access of orders (methods of a supplier's type) to parts (members)."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("scope"), F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("member"))


@query("cohesion_lcom4", """WITH RECURSIVE a AS (SELECT DISTINCT l_suppkey AS scope, l_orderkey AS item, l_partkey AS member FROM lineitem),
e AS (SELECT DISTINCT x.scope, x.item AS i, y.item AS j FROM a x JOIN a y ON x.scope = y.scope AND x.member = y.member),
r(scope, i, j) AS (SELECT scope, i, j FROM e UNION SELECT r.scope, r.i, e.j FROM r JOIN e ON r.scope = e.scope AND r.j = e.i),
lab AS (SELECT scope, i, min(j) AS lab FROM r GROUP BY scope, i), g AS (SELECT scope, count(DISTINCT lab) AS lcom4 FROM lab GROUP BY scope)
SELECT s.scope, s.items, s.members, g.lcom4 FROM (SELECT scope, count(DISTINCT item) AS items, count(DISTINCT member) AS members FROM a GROUP BY scope) s JOIN g USING (scope) WHERE items >= 2""")
def cohesion_lcom4(spark: SparkSession, d: str) -> DataFrame:
    return graph.cohesion(_access(spark, d))


@query("shared_members", "SELECT l_partkey AS member, count(DISTINCT l_suppkey) AS users FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2")
def shared_members(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_members(_access(spark, d).select(F.col("scope").alias("item"), "member"))


@query("control_flow_reachability", f"""WITH RECURSIVE {_CALLS_SQL}, e AS (SELECT DISTINCT caller AS src, callee AS dst FROM calls WHERE callee IS NOT NULL),
r(src, dst) AS (SELECT src, dst FROM e WHERE src = 'signup' UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r""")
def control_flow_reachability(spark: SparkSession, d: str) -> DataFrame:
    edges = _calls(spark, d).filter("callee is not null").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return graph.closure(edges, spark.createDataFrame([("signup",)], "node string"))
