"""Queries behind rewrites, and lookups that combine others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import changes, diagnostics, graph, rewrites
from factloom.plans.base import query, table
from factloom.plans.graphs import _TREE_SQL, _tree


@query("find_overrides", f"""WITH RECURSIVE {_TREE_SQL}, r(node, parent, depth) AS (SELECT child, parent, 1 FROM edges WHERE parent = (SELECT parent FROM edges WHERE child = (SELECT parent FROM edges WHERE child = 's3')) UNION ALL SELECT e.child, e.parent, depth + 1 FROM r JOIN edges e ON e.parent = r.node)
SELECT DISTINCT node FROM r WHERE depth = 2""")
def find_overrides(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers of the region that one supplier leads up to."""
    tree = _tree(spark, d)
    root = graph.ancestors(tree, "s3").filter("depth = 2").first()
    return graph.hierarchy(tree, root["node"] if root else "").filter("depth = 2").select("node").distinct()


@query("member_hierarchy", f"""WITH RECURSIVE {_TREE_SQL}, up(node, depth) AS (SELECT parent, -1 FROM edges WHERE child = 'n5' UNION ALL SELECT e.parent, depth - 1 FROM up JOIN edges e ON e.child = up.node)
SELECT node, depth FROM up UNION ALL SELECT child, 1 FROM edges WHERE parent = 'n5'""")
def member_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """What is above a nation, at depths below 0, and what is directly below it."""
    tree = _tree(spark, d)
    up = graph.ancestors(tree, "n5").select("node", (-F.col("depth")).alias("depth"))
    return up.unionByName(graph.hierarchy(tree, "n5", most_depth=1).select("node", "depth"))


@query("operations_tree", f"""WITH RECURSIVE {_TREE_SQL}, r(node, parent, depth) AS (SELECT child, parent, 1 FROM edges WHERE parent = 'r0' UNION ALL SELECT e.child, e.parent, depth + 1 FROM r JOIN edges e ON e.parent = r.node WHERE depth < 3) SELECT depth, count(*) AS n FROM r GROUP BY depth""")
def operations_tree(spark: SparkSession, d: str) -> DataFrame:
    """Nodes at each depth of a subtree, to depth 3."""
    return graph.hierarchy(_tree(spark, d), "r0", most_depth=3).groupBy("depth").agg(F.count("*").alias("n"))


@query("organize_usings", """SELECT l_orderkey AS file, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS imports, count(*) - count(DISTINCT l_returnflag || l_linestatus) AS dropped FROM lineitem GROUP BY l_orderkey""")
def organize_usings(spark: SparkSession, d: str) -> DataFrame:
    return rewrites.organised(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.concat("l_returnflag", "l_linestatus").alias("name")))


@query("change_signature", """WITH c AS (SELECT conv_id AS call, role AS argument, turn AS ord FROM conversations WHERE turn < 3), g AS (SELECT call, max(argument) FILTER (ord = 0) AS a, max(argument) FILTER (ord = 1) AS b, max(argument) FILTER (ord = 2) AS c FROM c GROUP BY call)
SELECT call, concat_ws(',', c, 'new', a, b) AS arguments FROM g""")
def change_signature(spark: SparkSession, d: str) -> DataFrame:
    """The first three turns of a conversation as arguments, in a new order and with one more."""
    calls = table(spark, d, "conversations").filter("turn < 3").select(F.col("conv_id").alias("call"), F.col("turn").cast("int").alias("ord"), F.col("role").alias("argument"))
    return rewrites.reordered(calls, [2, -1, 0, 1], F.lit("new"))


@query("fix_all_preview", "SELECT user_id AS file, count(*) AS sites, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY user_id")
def fix_all_preview(spark: SparkSession, d: str) -> DataFrame:
    return changes.affected_files(table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("event_id").alias("place")))


@query("bulk_replace_type", "SELECT l_orderkey AS file, count(*) AS sites, min(l_linenumber) AS first FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#7' AND l_linestatus = 'O' GROUP BY l_orderkey")
def bulk_replace_type(spark: SparkSession, d: str) -> DataFrame:
    """Sites of one classification at which a brand is named, by order."""
    brand = table(spark, d, "part").filter("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("l_partkey"))
    refs = table(spark, d, "lineitem").filter("l_linestatus = 'O'").join(brand, "l_partkey", "left_semi")
    return changes.affected_files(refs.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("place")))


@query("pragma_scope_widen", """SELECT user_id AS scope, event_id AS lo, event_id + 60 AS hi, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= event_id + 60, false) AS refused FROM events WHERE event_type = 'signup'""")
def pragma_scope_widen(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("scope"), F.col("event_id").alias("lo"), (F.col("event_id") + 10).alias("hi"))
    return rewrites.widened(spans, 50)


@query("record_satellites", """WITH s AS (SELECT user_id AS field, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS satellites FROM events WHERE value > 95 GROUP BY user_id) SELECT satellites, count(*) AS fields FROM s GROUP BY satellites HAVING count(*) >= 2""")
def record_satellites(spark: SparkSession, d: str) -> DataFrame:
    return rewrites.satellites(table(spark, d, "events").filter("value > 95").select(F.col("user_id").alias("field"), F.col("event_type").alias("satellite")))


@query("split_service", """WITH m AS (SELECT p_partkey AS member, CASE p_type WHEN 'SMALL' THEN 'SmallParts' WHEN 'ECONOMY' THEN 'CheapParts' END AS part FROM part) SELECT coalesce(part, 'Parts') AS part, count(*) AS members, min(member) AS first FROM m GROUP BY 1""")
def split_service(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    names = parts.filter(F.col("p_type").isin("SMALL", "ECONOMY")).select(F.col("p_partkey").alias("member"), F.when(F.col("p_type") == "SMALL", "SmallParts").otherwise("CheapParts").alias("part"))
    return rewrites.partitioned(parts.select(F.col("p_partkey").alias("member")), names, "Parts")


_FRAMES = "(SELECT n_regionkey, n_name AS value FROM nation)"


@query("target_frameworks", f"""WITH v AS (SELECT n_regionkey, value FROM {_FRAMES} UNION SELECT r_regionkey, 'net10' FROM region) SELECT r_regionkey AS key, string_agg(value, ',' ORDER BY value) FILTER (value <> 'NATION_3') AS list FROM region JOIN v ON r_regionkey = n_regionkey GROUP BY r_regionkey""")
def target_frameworks(spark: SparkSession, d: str) -> DataFrame:
    """Lists of nations with one element added and one removed."""
    rows = table(spark, d, "region").select(F.col("r_regionkey").alias("key"))
    values = table(spark, d, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("value"))
    return rewrites.with_element(rows, "key", values, add="net10", remove="NATION_3")


@query("set_diagnostic_severity", "SELECT DISTINCT event_type AS rule, CASE event_type WHEN 'view' THEN 'Error' ELSE 'Info' END AS severity, event_type = 'view' AS overridden FROM events")
def set_diagnostic_severity(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "events").select(F.col("event_type").alias("rule"), F.lit("Info").alias("severity")).distinct()
    return rewrites.effective_severity(rules, spark.createDataFrame([("view", "Error")], "rule string, severity string"))


@query("remove_interface_member", """WITH i AS (SELECT DISTINCT p_brand AS member, l_suppkey AS impl FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'A'), c AS (SELECT DISTINCT p_brand AS callee, l_suppkey AS caller FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity = 7)
SELECT member, count(*) AS implementations, bool_or(EXISTS (SELECT 1 FROM c WHERE callee = member AND NOT EXISTS (SELECT 1 FROM i j WHERE j.member = callee AND j.impl = caller))) AS refused FROM i GROUP BY member""")
def remove_interface_member(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    impls = lines.filter("l_returnflag = 'A'").select(F.col("p_brand").alias("member"), F.col("l_suppkey").alias("impl")).distinct()
    calls = lines.filter("l_quantity = 7").select(F.col("p_brand").alias("callee"), F.col("l_suppkey").alias("caller")).distinct()
    return rewrites.removable_members(impls, calls)
