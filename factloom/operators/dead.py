"""Unused symbols, fields and locals; duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.text import digest


def unused_symbols(symbols: DataFrame, refs: DataFrame, confidence: Column, exclude: Column | None = None) -> DataFrame:
    """Symbols without any reference, with a confidence; ``refs``: target.  ``exclude`` names symbols that may look unused."""
    left = symbols if exclude is None else symbols.filter(~exclude)
    return left.join(refs.select("target"), F.col("symbol") == F.col("target"), "left_anti").withColumn("confidence", confidence)


def dead_fields(fields: DataFrame, uses: DataFrame) -> DataFrame:
    """Fields that are never read or never written (field, reads, writes, usage).

    ``fields``: field, initialised (an initialiser is a write); ``uses``:
    field, kind: read, write or both (compound assignments, references).
    """
    kind = F.col("kind")
    n = uses.groupBy(F.col("field").alias("used")).agg(
        F.sum(kind.isin("read", "both").cast("long")).alias("r"), F.sum(kind.isin("write", "both").cast("long")).alias("w")
    )
    both = fields.join(n, F.col("field") == F.col("used"), "left")
    reads, writes = F.coalesce("r", F.lit(0)), F.coalesce("w", F.lit(0)) + F.col("initialised").cast("long")
    usage = F.when((F.col("reads") == 0) & (F.col("writes") == 0), "never-either").when(F.col("reads") == 0, "never-read").when(F.col("writes") == 0, "never-written")
    return both.select("field", reads.cast("long").alias("reads"), writes.cast("long").alias("writes")).withColumn("usage", usage).filter("usage is not null")


def dead_locals(events: DataFrame, skip_roles: tuple[str, ...] = ()) -> DataFrame:
    """Locals written and not read in the same body (body, local, writes).

    ``events``: body, local, event (write, read and others) and role; locals
    of a skipped role, and the discard ``_``, are not looked at.
    """
    seen = events.filter((F.col("local").cast("string") != "_") & ~F.coalesce(F.col("role").isin(*skip_roles) if skip_roles else F.lit(False), F.lit(False)))
    n = seen.groupBy("body", "local").agg(F.sum((F.col("event") == "write").cast("long")).alias("writes"), F.sum((F.col("event") == "read").cast("long")).alias("reads"))
    return n.filter("writes > 0 and reads = 0").select("body", "local", "writes")


def duplicates(members: DataFrame, form: Column, lines: Column, least_lines: int = 10) -> DataFrame:
    """Groups of members of equal canonical form (hash, members, lines, first), two or more.

    ``members``: id.  Ranked by members, then lines, over all groups.
    """
    tagged = members.select("id", digest(form).alias("hash"), lines.alias("n")).filter(F.col("n") >= least_lines)
    return tagged.groupBy("hash").agg(F.count("*").alias("members"), F.max("n").alias("lines"), F.min("id").alias("first")).filter("members >= 2")


#: Bodies of more nodes than this have no canonical form (fixed value).
MOST_NODES = 50_000


def canonical_bodies(tokens: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """The digest of each body's form, in which names are numbered by first appearance (body, nodes, form).

    ``tokens``: body, at, kind, text, where ``kind`` is ``identifier``,
    ``literal`` or any other kind; ``at`` orders a body's tokens.  Bodies that
    differ in names only have one form, those that differ in a literal, a kind
    or in which places share a name don't; text of other kinds is not looked
    at.  A body of more than ``most_nodes`` tokens has a null form, so a window
    never holds more than those.  A null text is as an empty one.
    """
    sizes = tokens.groupBy("body").agg(F.count("*").alias("nodes"))
    named = tokens.join(sizes.filter(F.col("nodes") <= most_nodes).select("body"), "body").select("body", "at", "kind", F.coalesce("text", F.lit("")).alias("text"))
    is_name = F.col("kind") == "identifier"
    # A name's number is that of its first place among the first places of names.
    first = F.when(is_name, F.min("at").over(Window.partitionBy("body", "kind", "text")))
    number = F.dense_rank().over(Window.partitionBy("body").orderBy(F.col("first").asc_nulls_last()))
    numbered = named.withColumn("first", first).withColumn("number", number)
    own = F.when(is_name, F.concat(F.lit("$"), F.col("number").cast("string"))).when(F.col("kind") == "literal", F.concat(F.length("text").cast("string"), F.lit("="), F.col("text"))).otherwise("")
    coded = numbered.select("body", F.struct("at", F.concat_ws(".", F.coalesce("kind", F.lit("")), own).alias("code")).alias("t"))
    form = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["code"]), "|"), 256)
    forms = coded.groupBy("body").agg(form.alias("form")).withColumnRenamed("body", "of")
    return sizes.join(forms, F.col("body") == F.col("of"), "left").select("body", "nodes", "form")


def duplicate_bodies(tokens: DataFrame, bodies: DataFrame, least_lines: int = 10, most_nodes: int = MOST_NODES, limit: int | None = None) -> DataFrame:
    """Groups of bodies of equal form (hash, members, lines, first, left_out), two or more, most members first.

    ``bodies``: body, lines; those of fewer than ``least_lines`` don't count.
    Groups go by the whole digest and show its first 16 digits; ``lines`` are
    those of the least body.  ``left_out``: how many bodies of enough lines have
    too many nodes for a form.  Null bodies have none.
    """
    forms = canonical_bodies(tokens.filter("body is not null"), most_nodes).join(bodies.filter(F.col("lines") >= least_lines), "body")
    # The groups, and how many there are without a form, in one pass: theirs is the group of the null form.
    groups = forms.groupBy("form").agg(F.count("*").alias("members"), F.min(F.struct("body", "lines")).alias("first"))
    left = groups.filter("form is null").agg(F.coalesce(F.sum("members"), F.lit(0)).alias("left_out"))
    out = groups.filter("form is not null and members >= 2").crossJoin(left)  # of one row
    out = out.select(F.substring("form", 1, 16).alias("hash"), "members", F.col("first.lines").alias("lines"), F.col("first.body").alias("first"), "left_out")
    return out.orderBy(F.desc("members"), F.desc("lines"), "hash").limit(limit) if limit else out


def duplicate_helpers(helpers: DataFrame, own: DataFrame, frameworks: tuple[str, ...] = ()) -> DataFrame:
    """Members that only hand on to one symbol outside (helper, callee, confidence).

    ``helpers``: helper, callee, statements; ``own``: symbol.  Callees that
    start with the name of a framework are left out.
    """
    out = helpers.join(own, F.col("callee") == F.col("symbol"), "left_anti")
    for f in frameworks:
        out = out.filter(~F.col("callee").startswith(f))
    return out.select("helper", "callee", F.when(F.col("statements") <= 1, "high").otherwise("medium").alias("confidence"))


def removable(symbols: DataFrame, gone: DataFrame) -> DataFrame:
    """What removing symbols leaves in each file (path, removed, left); ``symbols``: symbol, path; ``gone``: symbol."""
    marked = symbols.join(gone.select(F.col("symbol").alias("g")).distinct(), F.col("symbol") == F.col("g"), "left")
    n = marked.groupBy("path").agg(F.count("g").alias("removed"), F.sum(F.col("g").isNull().cast("long")).alias("left"))
    return n.filter("removed > 0")


def data_flow(events: DataFrame, lo, hi) -> DataFrame:
    """Variables of each body by what flows through the span lo..hi (body, local, flows_in, flows_out, inside).

    ``events``: body, local, event (read or write), at.  In: written before
    the span and read in it before any write; out: written in it and read
    after; inside: all its events are in it.  Variables without an event in
    the span have no row.
    """
    at, read, write = F.col("at"), F.col("event") == "read", F.col("event") == "write"
    within = at.between(lo, hi)
    n = events.groupBy("body", "local").agg(
        F.bool_or(within).alias("seen"), F.bool_or(write & (at < lo)).alias("before"), F.min(F.when(within & read, at)).alias("r"), F.min(F.when(within & write, at)).alias("w"),
        F.bool_or(read & (at > hi)).alias("after"), F.bool_and(within).alias("inside"),
    )
    came = F.col("before") & F.col("r").isNotNull() & (F.col("w").isNull() | (F.col("r") <= F.col("w")))
    return n.filter("seen").select("body", "local", came.alias("flows_in"), (F.col("w").isNotNull() & F.col("after")).alias("flows_out"), "inside")
