"""Diagnostics: floors, totals, summaries, security, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities from least to most (fixed values).
SEVERITIES = ("Hidden", "Info", "Warning", "Error")
SECURITY_RANK = ("Critical", "High", "Medium", "Low")


def rank(severity: Column) -> Column:
    """The place of a severity, from 0; null if it is none."""
    return F.nullif(F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity), F.lit(0)) - 1


def diagnostics(rows: DataFrame, floor: str = "Info", where: Column | None = None) -> DataFrame:
    """Rows of a severity of the floor or more, beside totals that don't depend on it.

    ``rows``: severity.  Totals (n_error, n_warning, n_info) respect
    ``where`` only.
    """
    held = rows if where is None else rows.filter(where)
    held = held.filter(F.col("severity") != "Hidden")
    total = held.agg(*(F.coalesce(F.sum((F.col("severity") == s).cast("long")), F.lit(0)).alias(f"n_{s.lower()}") for s in reversed(SEVERITIES[1:])))
    return held.filter(rank(F.col("severity")) >= SEVERITIES.index(floor)).crossJoin(F.broadcast(total))


def summary(rows: DataFrame, errors_first: bool = True) -> DataFrame:
    """Rows by rule and severity (rule, severity, n, first, severity_order)."""
    n = rows.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    order = F.lit(3) - rank(F.col("severity")) if errors_first else rank(F.col("severity")) - 1
    return n.withColumn("severity_order", order.cast("long"))


def details(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with what the catalogue of rules has on them; rows of unknown rules stay."""
    return rows.join(rules, "rule", "left")


def security(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of rules in a security registry, with its category and level and the order of levels."""
    level = F.array_position(F.array(*(F.lit(s) for s in SECURITY_RANK)), F.col("level"))
    return rows.join(registry, "rule").withColumn("level_order", level.cast("long"))


def security_counts(found: DataFrame) -> DataFrame:
    """Counts of each security level, in one row."""
    return found.agg(*(F.coalesce(F.sum((F.col("level") == s).cast("long")), F.lit(0)).alias(f"n_{s.lower()}") for s in SECURITY_RANK))


def distinct_errors(*sources: DataFrame) -> DataFrame:
    """Errors of several sources, once for each rule and place."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.filter("severity = 'Error'").dropDuplicates(["rule", "place"])


def new_errors(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fingerprints of the second run that the first doesn't have, each once."""
    return after.subtract(before)


def status(errors: DataFrame, failed_tests: DataFrame) -> DataFrame:
    """One row: errors, failed tests, and what they make together."""
    e, t = errors.agg(F.count("*").alias("errors")), failed_tests.agg(F.count("*").alias("failed_tests"))
    both = e.crossJoin(F.broadcast(t))
    return both.withColumn("status", F.when(F.col("errors") > 0, "compile-error").when(F.col("failed_tests") > 0, "test-failure").otherwise("clean"))


def caught(sites: DataFrame, ancestors: DataFrame, root: str) -> DataFrame:
    """Catch sites that a raised type reaches; a site of no type catches the root.

    ``sites``: declared; ``ancestors``: type (the raised one and all above),
    with exact set where it is the raised one.
    """
    typed = sites.withColumn("declared", F.coalesce("declared", F.lit(root)))
    return typed.join(ancestors.toDF("type", "exact"), F.col("declared") == F.col("type")).withColumn("catches_base", ~F.col("exact")).drop("type", "exact")


#: Catch sites of one answer unless asked for otherwise, and at most (fixed values).
SITES, MOST_SITES = 200, 2000


def caught_page(found: DataFrame, order: list[str], most: int | None = None) -> DataFrame:
    """The first catch sites in order, beside whether the cap was reached (``truncated``); ``found`` as ``caught`` gives it.

    No cap, and one of 0 or less, is 200; more than 2,000 is 2,000.  As many
    sites as the cap count as truncated, as nothing was looked for after them.
    """
    cap = SITES if most is None or most <= 0 else min(most, MOST_SITES)
    full = found.agg((F.count("*") >= cap).alias("truncated"))  # one row
    return found.orderBy(*order).limit(cap).crossJoin(F.broadcast(full))


def suppressed(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Whether a span of the same scope is around each point (point, suppressed).

    ``points``: point, scope, at; ``spans``: scope, lo, hi.  Of spans, the
    one that starts last before a point decides, as spans of a scope don't
    overlap; it is found by order, not by pairing all.
    """
    from pyspark.sql.window import Window

    marks = spans.select("scope", F.col("lo").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(points.schema["point"].dataType).alias("point"), "hi")
    asked = points.select("scope", "at", F.lit(1).alias("side"), "point", F.lit(None).cast(spans.schema["hi"].dataType).alias("hi"))
    last = F.last("hi", ignorenulls=True).over(Window.partitionBy("scope").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    return marks.unionByName(asked).withColumn("until", last).filter("side = 1").select("point", F.coalesce(F.col("at") <= F.col("until"), F.lit(False)).alias("suppressed"))


def fixes(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Fixes that a catalogue has for diagnostics, numbered in order for each (place, rule, action, fix); ``rows``: place, rule; ``catalogue``: rule, fix."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("place", "rule").orderBy("fix")) - 1
    return rows.join(catalogue, "rule").select("place", "rule", n.cast("int").alias("action"), "fix")


def fix_at(rows: DataFrame, catalogue: DataFrame, place, action: int) -> DataFrame:
    """The one fix of a place that is asked for (place, rule, fix)."""
    return fixes(rows.filter(F.col("place") == place), catalogue).filter(F.col("action") == action).select("place", "rule", "fix")
