"""Packages, registrations, consumers, usages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def packages(refs: DataFrame) -> DataFrame:
    """Users of each package and version (package, version, projects); ``refs``: project, package, version."""
    return refs.groupBy("package", "version").agg(F.countDistinct("project").alias("projects"))


def package_summary(refs: DataFrame) -> DataFrame:
    """Packages by name in any case (package, projects, versions, version): the least version stands for all."""
    low = F.lower("package").alias("package")
    return refs.groupBy(low).agg(F.countDistinct("project").alias("projects"), F.countDistinct(F.lower("version")).alias("versions"), F.min(F.lower("version")).alias("version"))


def registrations(rows: DataFrame) -> DataFrame:
    """Override chains (service, ord, lifetime, status) of services registered twice or more.

    ``rows``: service, ord, kind (add or try), lifetime.  The last add wins
    and earlier ones are overridden; a try wins only if nothing is active
    before it, and is shadowed else.
    """
    before = Window.partitionBy("service").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("service")
    first = F.count("*").over(before) == 0
    active = (F.col("kind") == "add") | first
    marked = rows.withColumn("active", active).withColumn("last_active", F.max(F.when(active, F.col("ord"))).over(whole)).withColumn("n", F.count("*").over(whole))
    status = F.when(~F.col("active"), "shadowed").when(F.col("ord") == F.col("last_active"), "winning").otherwise("overridden")
    return marked.filter("n >= 2").select("service", "ord", "lifetime", status.alias("status"))


def registration_chains(rows: DataFrame) -> DataFrame:
    """A row for each chain (service, registrations, dead, lifetimes_differ)."""
    return registrations(rows).groupBy("service").agg(
        F.count("*").alias("registrations"), F.sum((F.col("status") != "winning").cast("long")).alias("dead"), (F.countDistinct("lifetime") > 1).alias("lifetimes_differ")
    )


def consumers(uses: DataFrame, own=None) -> DataFrame:
    """Consumers with the kinds of their uses (consumer, kinds, uses); ``uses``: consumer, kind."""
    held = uses if own is None else uses.filter(F.col("consumer") != own)
    n = held.groupBy("consumer").agg(F.array_sort(F.collect_set("kind")).alias("k"), F.count("*").alias("uses"))
    return n.select("consumer", F.array_join("k", ",").alias("kinds"), "uses")


def usages(refs: DataFrame, classes: list[tuple[Column, str]], other: str = "Other") -> DataFrame:
    """References by class (classification, n): the first condition that holds gives the class."""
    kind = F.lit(other)
    for condition, name in reversed(classes):
        kind = F.when(condition, name).otherwise(kind)
    return refs.groupBy(kind.alias("classification")).agg(F.count("*").alias("n"))


def mutations(writes: DataFrame, order: list[str]) -> DataFrame:
    """The widest scope of each member's writes (member, scope, writes); ``order``: scopes, the widest first."""
    place = F.array_position(F.array(*(F.lit(s) for s in order)), F.col("scope"))
    return writes.groupBy("member").agg(F.min_by("scope", place).alias("scope"), F.count("*").alias("writes"))


def vulnerabilities(found: DataFrame, order: list[str]) -> DataFrame:
    """Findings by severity (severity, findings, packages); ``found``: severity, package."""
    return found.filter(F.col("severity").isin(order)).groupBy("severity").agg(F.count("*").alias("findings"), F.countDistinct("package").alias("packages"))


def presence(names: DataFrame, wanted: list[str]) -> DataFrame:
    """Whether any name starts with each of the wanted ones (wanted, present)."""
    one = names.agg(*(F.coalesce(F.bool_or(F.col("name").startswith(w)), F.lit(False)).alias(f"c{i}") for i, w in enumerate(wanted)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(w).alias("wanted"), F.col(f"c{i}").alias("present")) for i, w in enumerate(wanted)))))


def record_sites(sites: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Sites by the kinds they match (category, n); a site can be of several."""
    each = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())))
    return sites.select(F.explode(each).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
