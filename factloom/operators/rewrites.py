"""What rewrites would touch, and tables after staged changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def organised(imports: DataFrame) -> DataFrame:
    """Each file's imports, once each and in order, and how many went (file, imports, dropped); ``imports``: file, name."""
    n = imports.groupBy("file").agg(F.array_sort(F.collect_list("name")).alias("all"))
    once = F.array_distinct("all")
    return n.select("file", F.array_join(once, ",").alias("imports"), (F.size("all") - F.size(once)).cast("long").alias("dropped"))


def reordered(calls: DataFrame, order: list[int], fill: Column) -> DataFrame:
    """Arguments of each call in a new order (call, arguments); place -1 stands for a new argument, ``fill``.

    ``calls``: call, ord (from 0), argument.
    """
    each = calls.groupBy("call").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("ord", "argument")))).alias("m"))
    picked = F.transform(F.array(*(F.lit(k) for k in order)), lambda k: F.when(k < 0, fill).otherwise(F.try_element_at("m", k)))
    return each.select("call", F.array_join(F.array_compact(picked), ",").alias("arguments"))


def widened(spans: DataFrame, by: int) -> DataFrame:
    """Spans extended at their end, and whether they then meet the next of their scope (scope, lo, hi, refused)."""
    later = F.lead("lo").over(Window.partitionBy("scope").orderBy("lo", "hi"))
    wide = F.col("hi") + by
    return spans.select("scope", "lo", wide.alias("hi"), F.coalesce(later <= wide, F.lit(False)).alias("refused"))


def satellites(uses: DataFrame, least: int = 2) -> DataFrame:
    """Sets of satellites that several fields share exactly (satellites, fields); ``uses``: field, satellite."""
    sets = uses.groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("satellite")), ",").alias("satellites"))
    return sets.groupBy("satellites").agg(F.count("*").alias("fields")).filter(F.col("fields") >= least)


def partitioned(members: DataFrame, parts: DataFrame, rest: str) -> DataFrame:
    """Members dealt to new types (part, members, first); those that no part names stay in the rest."""
    dealt = members.join(parts, "member", "left").withColumn("part", F.coalesce("part", F.lit(rest)))
    return dealt.groupBy("part").agg(F.count("*").alias("members"), F.min("member").alias("first"))


def with_element(rows: DataFrame, key: str, values: DataFrame, add: str | None = None, remove: str | None = None) -> DataFrame:
    """Lists of each key with an element added or removed (key, list); ``values``: key, value."""
    each = values.groupBy(key).agg(F.array_sort(F.collect_set("value")).alias("l"))
    out = rows.join(each, key, "left").withColumn("l", F.coalesce("l", F.array().cast("array<string>")))
    new = F.col("l")
    if add is not None:
        new = F.array_sort(F.array_union(new, F.array(F.lit(add))))
    if remove is not None:
        new = F.array_remove(new, remove)
    return out.select(key, F.array_join(new, ",").alias("list"))


def effective_severity(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """The severity of each rule, of an override if there is one (rule, severity, overridden)."""
    o = overrides.select(F.col("rule").alias("r"), F.col("severity").alias("s"))
    return rules.join(o, F.col("rule") == F.col("r"), "left").select("rule", F.coalesce("s", "severity").alias("severity"), F.col("s").isNotNull().alias("overridden"))


def removable_members(impls: DataFrame, calls: DataFrame) -> DataFrame:
    """Members with their implementations, and whether a caller outside those forbids removal (member, implementations, refused).

    ``impls``: member, impl; ``calls``: callee, caller.
    """
    n = impls.groupBy("member").agg(F.count("*").alias("implementations"))
    inside = impls.select(F.col("member").alias("callee"), F.col("impl").alias("caller"))
    outside = calls.join(inside, ["callee", "caller"], "left_anti").select("callee").distinct().withColumn("refused", F.lit(True))
    return n.join(outside, F.col("member") == F.col("callee"), "left").select("member", "implementations", F.coalesce("refused", F.lit(False)).alias("refused"))


def shared_edits(sites: DataFrame, order: list[str]) -> DataFrame:
    """Sites of a signature change: the declaration and each call with its own edit (kind, site, edit), in no order.

    ``sites``: kind (declaration or call), site, names; ``order``: the new
    names, of which those not in ``names`` are added.
    """
    want = F.array(*(F.lit(x) for x in order))
    added = F.array_join(F.array_except(want, "names"), ",")
    dropped = F.array_join(F.array_except("names", want), ",")
    return sites.select("kind", "site", F.concat(F.lit("+"), added, F.lit(" -"), dropped).alias("edit"))


def relocated(refs: DataFrame, imports: DataFrame, source: str, target: str) -> DataFrame:
    """Files that use a type of a namespace that moves, and what its imports need (file, sites, edit).

    ``refs``: file, namespace, moving (whether it is of the type that moves);
    ``imports``: file, namespace.  A file that imports the old namespace and
    has no other use of it swaps the import, one with other uses or without
    that import adds the new one, and one that has it needs nothing.
    """
    of = refs.filter(F.col("namespace") == source).groupBy("file").agg(F.count_if("moving").alias("sites"), F.count_if(~F.col("moving")).alias("stays"))
    has = imports.groupBy("file").agg(F.bool_or(F.col("namespace") == source).alias("old"), F.bool_or(F.col("namespace") == target).alias("new"))
    both = of.filter("sites > 0").join(has, "file", "left").fillna(False, ["old", "new"])
    edit = F.when(F.col("new"), "none").when(F.col("old") & (F.col("stays") == 0), "swap").otherwise("add")
    return both.select("file", "sites", edit.alias("edit"))


def suppressions(lines: DataFrame, points: DataFrame, rule: str) -> DataFrame:
    """Lines with a disabling line before and a restoring one after each point's line (id, ord, text); ``points``: id, line."""
    marks = points.select("id", F.inline(F.array(F.struct((F.col("line") * 3 - 1).alias("ord"), F.lit(f"#pragma warning disable {rule}").alias("text")), F.struct((F.col("line") * 3 + 1).alias("ord"), F.lit(f"#pragma warning restore {rule}").alias("text")))))
    some = lines.join(points.select("id").distinct(), "id", "left_semi")
    return some.select("id", (F.col("line") * 3).alias("ord"), "text").unionByName(marks)


def inverted(refs: DataFrame, type_name, interface: str) -> DataFrame:
    """References to a type by what inverting its dependency makes of them (action, files, sites).

    ``refs``: target, file, kind.  Constructions stay with the type; where it
    is a parameter, a field or a base it becomes the interface.
    """
    hit = refs.filter(F.col("target") == type_name)
    action = F.when(F.col("kind") == "construction", "keep").otherwise(f"use {interface}")
    return hit.groupBy(action.alias("action")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("sites"))


def extracted_interface(members: DataFrame, uses: DataFrame) -> DataFrame:
    """Public members of each type, which its interface would have, and uses that could be of it (type, members, signatures, uses, rewritable).

    ``members``: type, member, kind, public; ``uses``: type, member.  A use
    of a member that isn't public can't be rewritten.
    """
    public = members.filter("public").groupBy("type").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "kind", "member"))), "; ").alias("signatures"))
    seen = uses.join(members.filter("public").select("type", "member").distinct().withColumn("p", F.lit(1)), ["type", "member"], "left")
    n = seen.groupBy("type").agg(F.count("*").alias("uses"), F.count("p").alias("rewritable"))
    return public.join(n, "type", "left").fillna(0, ["uses", "rewritable"])


def rewired(registrations: DataFrame, old: str, new: str) -> DataFrame:
    """Registrations with the implementations of one service put under its interface (service, ord, was); others stay."""
    hit = F.col("service") == old
    return registrations.select(F.when(hit, F.lit(new)).otherwise(F.col("service")).alias("service"), "ord", F.when(hit, F.col("service")).alias("was"))


def split(members: DataFrame, chosen: DataFrame, path: str) -> DataFrame:
    """Members of a class that go to a new partial file, and the others (path, members, chars); ``members``: member, path, chars; ``chosen``: member."""
    marked = members.join(chosen.select(F.col("member").alias("c")).distinct(), F.col("member") == F.col("c"), "left")
    where = F.when(F.col("c").isNotNull(), F.lit(path)).otherwise(F.col("path"))
    return marked.groupBy(where.alias("path")).agg(F.count("*").alias("members"), F.sum("chars").alias("chars"))
