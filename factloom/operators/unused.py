"""Unused symbols: what never is reported, by rule, and references that other projects hold under a symbol's name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.shared import fixpoint, written

#: Rules in the order in which they give a reason (fixed values), and those that hold unless switched off.
RULES = (
    "test-fixture", "convention-invoked", "public", "enum-member", "record-property", "method-kind", "interface-implementation", "override", "entry-point", "framework-attribute",
    "in-test-fixture", "extension-host",
)
DEFAULT_RULES = tuple(r for r in RULES if r not in ("test-fixture", "enum-member", "record-property", "in-test-fixture"))
#: Attributes and names by which each kind of type or member is known.
FIXTURE_ATTRIBUTES = ("TestFixtureAttribute", "TestClassAttribute", "CollectionAttribute")
FIXTURE_ENDS = ("Tests", "Test")
CONVENTION_BASES = ("AbstractValidator", "Hub", "PageModel", "Migration", "ModelSnapshot")
CONVENTION_END = "ModelSnapshot"
CONVENTION_TYPE_ATTRIBUTES = ("McpServerToolType", "McpServerPromptType", "McpServerResourceType", "CollectionDefinition")
CONVENTION_MEMBER_ATTRIBUTES = ("DbContextAttribute", "MigrationAttribute")
MIDDLEWARE_NAMES = ("InvokeAsync", "Invoke")
UNLISTED_METHODS = ("Constructor", "StaticConstructor", "Destructor", "UserDefinedOperator", "Conversion")
FRAMEWORK_ATTRIBUTES = (
    "Fact", "Theory", "Test", "TestMethod", "TestCase", "DataMember", "JsonProperty", "JsonRequired", "JsonInclude", "Required", "Key", "Column", "Table", "HttpGet", "HttpPost",
    "HttpPut", "HttpDelete", "HttpPatch", "Route", "ApiController", "Controller", "EventHandler", "MessageHandler", "Subscribe",
)
SERIALIZED_ATTRIBUTES = ("JsonPropertyNameAttribute", "JsonPropertyAttribute", "JsonIncludeAttribute", "DataMemberAttribute")


def _short(attribute: Column) -> Column:
    return F.regexp_replace(attribute, "Attribute$", "")


def marked_types(symbols: DataFrame, attributes: DataFrame, bases: DataFrame) -> DataFrame:
    """Types that a host calls by itself (symbol, mark): ``fixture`` of tests, or ``convention``, which fixtures are too.

    ``symbols`` and ``attributes`` as of ``exclusions``; ``bases``: symbol,
    base, base_name.  A convention's base counts however far up it is: types
    are gone down from those that name one, all at once.
    """
    types = symbols.filter("kind = 'type'").select("symbol", "name")
    of_type = attributes.join(types.select("symbol"), "symbol", "left_semi")
    name_ends = reduce(Column.__or__, (F.col("name").endswith(x) for x in FIXTURE_ENDS))
    fixture = types.filter(name_ends).select("symbol").union(of_type.filter(F.col("attribute").isin(*FIXTURE_ATTRIBUTES)).select("symbol")).distinct()
    down = bases.filter("base is not null").select("base", F.col("symbol").alias("derived")).distinct()
    direct = bases.filter(F.col("base_name").isin(*CONVENTION_BASES)).select("symbol")
    inherited = fixpoint(direct, lambda front, seen: front.join(down, F.col("symbol") == F.col("base")).select("derived"), "unused-bases")
    parameters = F.split(F.coalesce("parameters", F.lit("")), ",")
    shaped = symbols.filter("kind = 'method' and accessibility = 'Public'").filter(
        (F.col("name").isin(*MIDDLEWARE_NAMES) & (F.get(parameters, 0) == "HttpContext")) | ((F.size(parameters) == 2) & (F.get(parameters, 0) == "HttpContext") & (F.get(parameters, 1) == "HealthReport"))
    )
    convention = (
        types.filter(F.col("name").endswith(CONVENTION_END)).select("symbol")
        .union(inherited.select("symbol"))
        .union(shaped.select(F.col("container").alias("symbol")))
        .union(of_type.filter(_short(F.col("attribute")).isin(*CONVENTION_TYPE_ATTRIBUTES)).select("symbol"))
        .union(fixture)
        .distinct()
    )
    return fixture.select("symbol", F.lit("fixture").alias("mark")).union(convention.select("symbol", F.lit("convention")))


def exclusions(symbols: DataFrame, attributes: DataFrame, bases: DataFrame, implements: DataFrame, rules: tuple[str, ...] = DEFAULT_RULES) -> DataFrame:
    """Symbols that are never reported, and why (symbol, reason): the first rule, in the order of ``RULES``, that one falls under.

    ``symbols``: symbol, name, kind (type, method, property, field or event),
    container, accessibility, method_kind, type_kind (of a type, or of a
    member's container), parameters (simple names, joined by commas), is_static,
    is_record (of the container for a member), is_override, is_extension.
    ``attributes``: symbol, attribute.  ``bases``: as of ``marked_types``.
    ``implements``: symbol, members that implement one of an interface.  Nulls
    fall under no rule.
    """
    unknown = set(rules) - set(RULES)
    if unknown:
        raise ValueError(f"no such rules: {sorted(unknown)}")
    marks = written(marked_types(symbols, attributes, bases), "unused-marks")
    fixture, convention = marks.filter("mark = 'fixture'").select("symbol"), marks.filter("mark = 'convention'").select("symbol")
    members = symbols.filter("container is not null").select("symbol", "container")

    def inside(marked: DataFrame) -> DataFrame:
        return members.join(marked.select(F.col("symbol").alias("container")), "container", "left_semi").select("symbol")

    def having(names: tuple[str, ...], short: bool) -> DataFrame:
        c = F.col("attribute")
        return attributes.filter((_short(c) if short else c).isin(*names)).select("symbol")

    of_rule = {
        "test-fixture": lambda: fixture,
        "convention-invoked": lambda: convention.union(inside(convention)).union(having(CONVENTION_MEMBER_ATTRIBUTES, False)),
        "public": lambda: symbols.filter("accessibility = 'Public'").select("symbol"),
        "enum-member": lambda: symbols.filter("kind = 'field' and type_kind = 'Enum'").select("symbol"),
        "record-property": lambda: symbols.filter("kind = 'property' and is_record").select("symbol"),
        "method-kind": lambda: symbols.filter("kind = 'method'").filter(F.col("method_kind").isin(*UNLISTED_METHODS)).select("symbol"),
        "interface-implementation": lambda: implements.select("symbol"),
        "override": lambda: symbols.filter("kind in ('method', 'property') and is_override").select("symbol"),
        "entry-point": lambda: symbols.filter("kind = 'method' and name = 'Main' and is_static").select("symbol"),
        "framework-attribute": lambda: having(FRAMEWORK_ATTRIBUTES, True),
        "in-test-fixture": lambda: inside(fixture),
        "extension-host": lambda: symbols.filter("kind = 'type' and is_static").select("symbol").join(symbols.filter("is_extension").select(F.col("container").alias("symbol")), "symbol", "left_semi"),
    }
    parts = [of_rule[r]().select("symbol", F.lit(k).alias("rule")) for k, r in enumerate(RULES) if r in rules]
    if not parts:
        return symbols.limit(0).select("symbol", F.lit("").alias("reason"))
    first = reduce(DataFrame.union, parts).filter("symbol is not null").groupBy("symbol").agg(F.min("rule").alias("rule"))
    return first.select("symbol", F.get(F.array(*map(F.lit, RULES)), F.col("rule")).alias("reason"))


def unreferenced(symbols: DataFrame, refs: DataFrame, outside: DataFrame) -> DataFrame:
    """Symbols that nothing refers to, in their own project or, of some, under their name in another.

    ``refs``: target.  ``outside``: container, name, parameters of what other
    projects refer to.  Calls of extension methods and of overloaded ones may
    be bound to another symbol there, so those are looked up by name too.
    """
    left = symbols.join(refs.select(F.col("target").alias("symbol")), "symbol", "left_anti")
    ordinary = symbols.filter("kind = 'method' and method_kind = 'Ordinary' and container is not null")
    overloaded = ordinary.groupBy("container", "name").agg(F.count("*").alias("n")).filter("n > 1").drop("n").withColumn("more", F.lit(True))
    unsure = left.filter("kind = 'method'").join(overloaded, ["container", "name"], "left").filter("is_extension or more")
    called = outside.select("container", "name", F.coalesce("parameters", F.lit("")).alias("p")).distinct()
    used = unsure.withColumn("p", F.coalesce("parameters", F.lit(""))).join(called, ["container", "name", "p"], "left_semi")
    return left.join(used.select("symbol"), "symbol", "left_anti")


def unused(symbols: DataFrame, refs: DataFrame, outside: DataFrame, excluded: DataFrame, attributes: DataFrame) -> DataFrame:
    """Symbols without references that fall under no rule, with a confidence (symbol, confidence).

    Low for members of interfaces and enums, and for properties of records or
    with a serialiser's attribute; medium for public ones; high otherwise.
    """
    left = unreferenced(symbols, refs, outside).join(excluded.select("symbol"), "symbol", "left_anti")
    hinted = attributes.filter(F.col("attribute").isin(*SERIALIZED_ATTRIBUTES)).select("symbol", F.lit(True).alias("hinted")).distinct()
    member = F.col("container").isNotNull()
    low = (member & (F.col("type_kind") == "Interface")) | ((F.col("kind") == "field") & (F.col("type_kind") == "Enum")) | ((F.col("kind") == "property") & (F.col("is_record") | F.col("hinted")))
    confidence = F.when(low, "low").when(F.col("accessibility") == "Public", "medium").otherwise("high")
    return left.join(hinted, "symbol", "left").select("symbol", confidence.alias("confidence"))
