"""Lookups: references, symbols, definitions, positions, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.paging import page

#: Most keys of a bulk lookup (fixed value).
MOST_KEYS = 50


def find_references(refs: DataFrame, target, order: list[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the references to a target, in the order of their places."""
    return page(refs.filter(F.col("target") == target), [F.col(c) for c in order], offset, limit)


def find_references_bulk(refs: DataFrame, keys: list, known: DataFrame) -> DataFrame:
    """Counts of references for each key (key, references, error); an unknown key has an error, not a failure.

    ``refs``: target; ``known``: key.
    """
    if len(keys) > MOST_KEYS:
        raise ValueError(f"at most {MOST_KEYS} keys")
    spark = refs.sparkSession
    asked = F.broadcast(spark.createDataFrame([(k,) for k in keys], f"key {known.schema['key'].dataType.simpleString()}"))
    n = refs.join(asked, F.col("target") == F.col("key"), "left_semi").groupBy("target").agg(F.count("*").alias("n"))
    found = known.join(asked, "key", "left_semi").withColumn("found", F.lit(True))
    out = asked.join(n, F.col("key") == F.col("target"), "left").join(found, "key", "left")
    return out.select("key", F.coalesce("n", F.lit(0)).cast("long").alias("references"), F.when(F.col("found").isNull(), "not found").alias("error"))


def symbol_search(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols whose name holds a text, then those whose full name does; each display once, the better pass first.

    ``symbols``: id, name, fqn, kind.
    """
    text = query.lower()
    hit = F.when(F.lower("name").contains(text), 1).when(F.lower("fqn").contains(text), 2)
    found = symbols.withColumn("pass", hit).filter("pass is not null")
    if kind:
        found = found.filter(F.lower("kind") == kind.lower())
    first = found.groupBy("fqn").agg(F.min(F.struct("pass", "id", "name", "kind")).alias("s"))
    return first.select("s.pass", "s.id", "s.name", "fqn", "s.kind").orderBy("pass", "fqn", "id").limit(limit)


def by_id(rows: DataFrame, column: str, value) -> DataFrame:
    """The rows of one key."""
    return rows.filter(F.col(column) == value)


def enclosing(points: DataFrame, spans: DataFrame, bucket: int | None = None) -> DataFrame:
    """The innermost span around each point (point_id, span_id); ties go to the least span_id.

    ``points``: point_id, scope, at; ``spans``: span_id, scope, lo, hi (both
    inside, whole numbers).  A span is cut into the blocks of powers of two that
    it covers wholly, two of a level at most, as in a segment tree; of each block
    only the shortest span stays.  A point looks up the one block of each level
    that it is in, so it meets a row of each level at most, however many spans
    hold it.  Spans of one place and points of one place are one there.
    ``bucket`` is not used any more.
    """
    low, high = F.col("lo").cast("long"), F.col("hi").cast("long")

    def cut(k: Column) -> Column:
        # The first and the last block that begin and end within; nothing here leaves 64 bits.
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1
        first = F.call_function("shiftright", low, k) + F.when(low.bitwiseAND(mask) != 0, 1).otherwise(0)
        last = F.call_function("shiftright", high, k) - F.when(high.bitwiseAND(mask) != mask, 1).otherwise(0)
        left = F.when((first <= last) & (first % 2 != 0), F.struct(k.alias("level"), first.alias("block")))
        right = F.when((first <= last) & (last % 2 == 0), F.struct(k.alias("level"), last.alias("block")))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.least(F.lit(62), F.length(F.bin(high - low))))
    whole = spans.filter("lo <= hi").groupBy("scope", "lo", "hi").agg(F.min("span_id").alias("id"))
    blocks = whole.select("scope", F.struct((high - low).alias("size"), "id").alias("s"), F.explode(F.filter(F.flatten(F.transform(levels, cut)), lambda x: x.isNotNull())).alias("b"))
    blocks = blocks.groupBy("scope", "b.level", "b.block").agg(F.min("s").alias("s"))
    used = blocks.agg(F.array_sort(F.collect_set("level")).alias("levels"))  # one row
    places = points.select("scope", "at").distinct()
    look = places.crossJoin(F.broadcast(used)).withColumn("level", F.explode("levels")).withColumn("block", F.expr("shiftright(cast(at as long), level)"))
    held = look.join(blocks, ["scope", "level", "block"]).groupBy("scope", "at").agg(F.min("s").alias("s"))
    return points.join(held, ["scope", "at"]).groupBy("point_id").agg(F.min("s").alias("s")).select("point_id", F.col("s.id").alias("span_id"))


def preferred(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in order: for parts of one declaration, the one a person wrote."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("rn = 1").drop("rn")


def effective_options(options: DataFrame) -> DataFrame:
    """The value that holds for each (target, option): that of the deepest level (target, option, value, level)."""
    best = options.groupBy("target", "option").agg(F.max(F.struct("level", "value")).alias("o"))
    return best.select("target", "option", "o.value", "o.level")


def completions(names: DataFrame, prefix: str, limit: int = 100) -> DataFrame:
    """Names that start with a text, by rank and name."""
    return names.filter(F.lower("name").startswith(prefix.lower())).orderBy("rank", "name", "id").limit(limit)


def signatures(members: DataFrame) -> DataFrame:
    """A call signature of each symbol, from parameters in order (symbol, signature).

    ``members``: symbol, ord, name, kind.
    """
    listed = members.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "name"))).alias("p"))
    return listed.select("symbol", F.concat(F.col("symbol").cast("string"), F.lit("("), F.array_join(F.transform("p", lambda x: F.concat_ws(" ", x["kind"], x["name"])), ", "), F.lit(")")).alias("signature"))
