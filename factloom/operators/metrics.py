"""Measures of texts and members, coverage, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.shared import sums_to_root
from factloom.functions.text import line_count, occurrences


def maintainability(loc: Column, complexity: Column) -> Column:
    """Maintainability index from lines and cyclomatic complexity, 0 to 100 with two places."""
    volume = F.greatest(F.lit(1.0), loc * F.log2(1 + complexity))
    raw = (171 - 5.2 * F.log(volume) - 0.23 * complexity - 16.2 * F.log(loc.cast("double"))) * 100 / 171
    return F.bround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 2)


def complexity(members: DataFrame, branch: str, text_col: str = "text") -> DataFrame:
    """Complexity (1 + branches), lines and maintainability of each member's text, beside its columns."""
    out = members.withColumns({"loc": line_count(F.col(text_col)), "complexity": 1 + occurrences(F.col(text_col), branch)})
    return out.withColumn("maintainability", maintainability(F.col("loc"), F.col("complexity")))


def node_complexity(nodes: DataFrame, decisions: list[str]) -> DataFrame:
    """Complexity of each member from its syntax nodes (member, complexity, nesting); ``nodes``: member, kind, depth."""
    return nodes.groupBy("member").agg((1 + F.sum(F.col("kind").isin(decisions).cast("long"))).alias("complexity"), F.max("depth").alias("nesting"))


#: Kinds of nodes whose body is one level deeper, parts of such nodes that hold a body themselves, and nodes that are a decision.
ONE_BODY = ["IfStatement", "ForStatement", "ForEachStatement", "WhileStatement", "DoStatement", "LockStatement", "UsingStatement", "FixedStatement", "CheckedStatement", "UnsafeStatement"]
MORE_BODIES = ["TryStatement", "SwitchStatement", "SwitchExpression"]
BODY_HOLDERS = ["ElseClause", "SwitchSection", "CatchClause", "FinallyClause", "SwitchExpressionArm"]
DECISIONS = [
    "IfStatement", "CaseSwitchLabel", "CasePatternSwitchLabel", "SwitchExpressionArm", "ConditionalExpression", "WhileStatement", "ForStatement", "ForEachStatement", "DoStatement",
    "CatchClause", "LogicalAndExpression", "LogicalOrExpression", "CoalesceExpression",
]


def nesting(nodes: DataFrame) -> DataFrame:
    """How many control bodies each node lies in (member, node, depth), from its parents' kinds alone.

    ``nodes``: member, node, parent, kind, one row for each node of a member;
    a root's parent is null or no node.  An edge into a control body weighs 1,
    any other 0, local functions and else clauses too.  A statement that is
    itself the whole body of another, without a block, or a statement of a
    switch section, counts once with it: the bodies directly in it weigh 0,
    those one such step further 1 again.  Sums over ancestors by doubling.
    """
    up = nodes.select("member", F.col("node").alias("parent"), F.col("kind").alias("of"), F.col("parent").alias("above"))
    both = nodes.select("member", "node", "parent", "kind").join(up, ["member", "parent"], "left")
    statement = F.col("kind").endswith("Statement") | (F.col("kind") == "Block")
    body = (
        (F.col("of").isin(ONE_BODY) & statement)
        | ((F.col("of") == "TryStatement") & (F.col("kind") == "Block"))
        | (F.col("of").isin("ElseClause", "SwitchSection") & statement)
        | (F.col("of").isin("CatchClause", "FinallyClause") & (F.col("kind") == "Block"))
        | ((F.col("of") == "SwitchExpressionArm") & F.col("kind").endswith("Expression"))
    )
    owner = F.when(F.col("of").isin(BODY_HOLDERS), F.col("above")).otherwise(F.col("parent"))
    key = F.struct("member", "node").alias("node")
    both = both.select("member", key, F.struct("member", "parent").alias("parent"), F.struct("member", owner.alias("node")).alias("owner"), F.coalesce(body, F.lit(False)).alias("body"), F.col("kind").isin(ONE_BODY + MORE_BODIES).alias("control"))
    # Of control statements that are bodies of one another, every second one, from the outermost on, counts with its owner.
    runs = sums_to_root(both.filter("body and control").select("node", F.col("owner").alias("parent"), F.lit(1).alias("weight")), "nesting-runs")
    with_owner = runs.filter("total % 2 = 1").select(F.col("node").alias("owner"), F.lit(True).alias("counted"))
    weight = (F.col("body") & F.col("counted").isNull()).cast("long")
    depth = sums_to_root(both.join(with_owner, "owner", "left").select("node", "parent", weight.alias("weight")), "nesting")
    return depth.select("node.member", "node.node", F.col("total").alias("depth"))


def method_metrics(members: DataFrame, nodes: DataFrame, least: int | None = None, limit: int | None = 50) -> DataFrame:
    """Complexity, lines, deepest nesting and index of each member (member, complexity, loc, nesting, maintainability), most complex first.

    ``members``: member, first_line, last_line; ``nodes`` as of ``nesting``.
    Decisions are nodes of fixed kinds.  A member without nodes has complexity 1.
    """
    deepest = nesting(nodes).groupBy("member").agg(F.max("depth").alias("nesting"))
    decided = nodes.groupBy("member").agg(F.sum(F.col("kind").isin(DECISIONS).cast("long")).alias("n"))
    out = members.join(decided, "member", "left").join(deepest, "member", "left")
    out = out.select("member", (1 + F.coalesce("n", F.lit(0))).alias("complexity"), (F.col("last_line") - F.col("first_line") + 1).cast("long").alias("loc"), F.coalesce("nesting", F.lit(0)).cast("long").alias("nesting"))
    out = out.withColumn("maintainability", maintainability(F.greatest(F.col("loc"), F.lit(1)), F.col("complexity")))
    if least is not None:
        out = out.filter(F.col("complexity") >= least)
    return out.orderBy(F.desc("complexity"), "member").limit(limit) if limit else out


def coverage(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines, lines hit and rate of each group and of each of its upper levels; ``lines``: the keys and hits.

    A level left out is null in its column.
    """
    out = lines.rollup(*keys).agg(F.count("*").alias("total"), F.sum((F.col("hits") > 0).cast("long")).alias("covered"))
    return out.withColumn("rate", F.bround(100.0 * F.col("covered") / F.col("total"), 1))


def reference_map(symbols: DataFrame, used: DataFrame) -> DataFrame:
    """Each symbol with whether a test uses it (symbol, covered)."""
    mark = used.select(F.col("symbol").alias("used")).distinct()
    return symbols.join(mark, F.col("symbol") == F.col("used"), "left").select("symbol", F.col("used").isNotNull().alias("covered"))


def covered_share(mapped: DataFrame) -> DataFrame:
    """Totals and percentage of covered symbols; 0 of none."""
    yes = F.coalesce(F.sum(F.col("covered").cast("long")), F.lit(0))
    n = F.count("*")
    share = F.when(n == 0, 0.0).otherwise(F.bround(100.0 * yes / n, 1))
    return mapped.agg(yes.alias("covered"), (n - yes).alias("uncovered"), share.alias("percent"))


#: What is suggested from which complexity, parameters and cohesion on.
HIGH_COMPLEXITY, MEDIUM_COMPLEXITY, MANY_PARAMETERS, LOW_COHESION, VERY_LOW_COHESION = 15, 10, 7, 2, 3
SEVERITY = {"high": 0, "medium": 1, "low": 2}


def suggestions(methods: DataFrame, types: DataFrame, unused: DataFrame, limit: int = 20) -> DataFrame:
    """Ranked suggestions (severity, kind, target).

    ``methods``: target, complexity, parameters; ``types``: target, lcom4;
    ``unused``: target, confidence.
    """
    c, p, low = F.col("complexity"), F.col("parameters"), F.col("lcom4")

    def some(df: DataFrame, kind: str, severity: Column) -> DataFrame:
        return df.select(severity.alias("severity"), F.lit(kind).alias("kind"), F.col("target").cast("string").alias("target")).filter("severity is not null")

    found = (
        some(methods, "complexity", F.when(c >= HIGH_COMPLEXITY, "high").when(c >= MEDIUM_COMPLEXITY, "medium"))
        .unionByName(some(methods, "parameters", F.when(p >= MANY_PARAMETERS, "medium")))
        .unionByName(some(types, "cohesion", F.when(low >= VERY_LOW_COHESION, "high").when(low >= LOW_COHESION, "medium")))
        .unionByName(some(unused.filter("confidence = 'high'"), "unused", F.lit("low")))
    )
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return found.orderBy(rank, F.when(F.col("kind") == "complexity", 0).otherwise(1), "kind", "target").limit(limit)
