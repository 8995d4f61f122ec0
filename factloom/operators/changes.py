"""Edits and change sets: text slices and edits, a change log, staging, undo."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import patterns

# Workers need not have this package: patterns go to them with their code.
cloudpickle.register_pickle_by_value(patterns)


def text_slice(lines: DataFrame, first: int, last: int, most_chars: int = 65536) -> DataFrame:
    """Lines first to last of each text as one string, cut to a number of characters (id, text)."""
    held = lines.filter(F.col("line").between(first, last)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return held.select("id", F.substring(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), 1, most_chars).alias("text"))


def budgeted(rows: DataFrame, partition: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows in order for as long as their sizes stay within a budget for each partition, with the running ``total``."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(size).over(w)).filter(F.col("total") <= budget)


def restructure(rows: DataFrame, pattern: str, goal: str, text_col: str = "text") -> DataFrame:
    """Rows in which a pattern is found, with the rewritten text as ``rewritten`` and the number of ``changes``."""
    text = F.col(text_col)
    return rows.filter(text.rlike(pattern)).withColumn("rewritten", F.regexp_replace(text, pattern, goal)).withColumn("changes", F.regexp_count(text, F.lit(pattern)).cast("long"))


def restructured(rows: DataFrame, pattern: str, goal: str, text_col: str = "text") -> DataFrame:
    """Rows in which a pattern with placeholders matches, with the rewritten text as ``rewritten`` and the number of ``changes``.

    ``functions.patterns.Pattern`` says what matches.  A goal that names a
    placeholder which the pattern has not is an error, before anything runs.
    Null texts match nothing.  Texts go to Python in Arrow batches, and only
    those that hold all fixed names of the pattern.
    """
    made = patterns.Pattern(pattern, goal)

    def rewrite(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            yield pd.DataFrame([made.rewrite(t) for t in some], columns=["rewritten", "changes"])

    may = rows.filter(F.col(text_col).isNotNull())
    for t, held in made.parts:
        if not held:
            may = may.filter(F.col(text_col).contains(t))
    done = F.pandas_udf(rewrite, "rewritten string, changes long")(F.col(text_col))
    out = may.withColumn("_done", done).select("*", "_done.rewritten", "_done.changes").drop("_done")
    return out.filter("changes > 0")


def replace_literals(tokens: DataFrame, replacements: dict[str, str]) -> DataFrame:
    """Tokens that a bounded map replaces (id, ord, token, replacement)."""
    pairs = tokens.sparkSession.createDataFrame(list(replacements.items()), "literal string, replacement string")
    return tokens.join(pairs, F.col("token") == F.col("literal")).select("id", "ord", "token", "replacement")


def apply_edits(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts after their edits (id, text); ``edits``: id, start (from 0), length, insert; edits of a text don't overlap.

    Edits go from the last to the first, so that earlier places stay valid.
    """
    each = edits.groupBy("id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "length", "insert")))).alias("e"))
    done = F.aggregate(
        F.col("e"), F.col("text"), lambda t, e: F.concat(t.substr(F.lit(1), e["start"]), e["insert"], t.substr(e["start"] + e["length"] + 1, F.length(t)))
    )
    return texts.join(each, "id", "left").select("id", F.when(F.col("e").isNull(), F.col("text")).otherwise(done).alias("text"))


def revertible(changes: DataFrame, sequence: int) -> DataFrame:
    """Changes after a sequence number that touch a file of that change (seq, file): any row forbids reverting it."""
    files = changes.filter(F.col("seq") == sequence).select("file").distinct()
    return changes.filter(F.col("seq") > sequence).join(files, "file", "left_semi").select("seq", "file")


def last_change(changes: DataFrame, scope: str) -> DataFrame:
    """The newest change of each scope, which is what undo takes back."""
    w = Window.partitionBy(scope).orderBy(F.desc("seq"))
    return changes.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def affected_files(sites: DataFrame) -> DataFrame:
    """Sites of a rewrite by file (file, sites, first); ``sites``: file, place."""
    return sites.groupBy("file").agg(F.count("*").alias("sites"), F.min("place").alias("first"))


def upsert(rows: DataFrame, keys: list[str], new: DataFrame) -> DataFrame:
    """Rows in which those of ``new`` replace the ones of equal keys."""
    return rows.join(new.select(*keys), keys, "left_anti").unionByName(new)


def conflicts(moved: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that can't be moved since their keys are taken."""
    return moved.join(present.select(*keys).distinct(), keys, "left_semi")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change makes of a table: rows that go (change ``-``) and rows that come (``+``), as often as they do."""
    after = after.select(*before.columns)
    gone, come = before.exceptAll(after), after.exceptAll(before)
    return gone.withColumn("change", F.lit("-")).unionByName(come.withColumn("change", F.lit("+")))


def replaced(rows: DataFrame, where: Column, **values) -> DataFrame:
    """Rows in which columns have new values (columns or constants) where a condition holds; null is not held."""
    new = {c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) for c, v in values.items()}
    return rows.select(*(new.get(c, F.col(c)) for c in rows.columns))


def without(rows: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """Rows whose keys are not among those of ``gone``."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def inserted(rows: DataFrame, keys: list[str], new: DataFrame) -> DataFrame:
    """Rows, and those of ``new`` whose keys are not taken."""
    return rows.unionByName(new.join(rows.select(*keys).distinct(), keys, "left_anti").select(*rows.columns))


def rewritten(rows: DataFrame, column: str, pattern: str, goal: str) -> DataFrame:
    """Rows in which a column's matches of a pattern are replaced; rows that have none stay as they are."""
    return rows.withColumn(column, F.regexp_replace(column, pattern, goal)).select(*rows.columns)


def fold(rows: DataFrame, steps: list, valid: Column | None = None) -> DataFrame:
    """Rows after steps in order, all or none: where any row of the end fails ``valid``, the rows as they were."""
    after = rows
    for step in steps:
        after = step(after).select(*rows.columns)
    if valid is None:
        return after
    wrong = after.agg(F.coalesce(F.bool_or(~valid), F.lit(False)).alias("wrong"))
    return after.crossJoin(F.broadcast(wrong)).filter("not wrong").drop("wrong").unionByName(rows.crossJoin(F.broadcast(wrong)).filter("wrong").drop("wrong"))


def file_checks(files: DataFrame, asked: DataFrame, root: str) -> DataFrame:
    """Whether files can be created, deleted or moved (op, path, target, verdict).

    ``files``: path; ``asked``: op (create, delete or move), path and, for a
    move, target.  Verdicts: ok, missing, exists, outside (of the root), same.
    """
    taken = files.select(F.col("path").alias("k")).distinct()
    old = asked.join(taken, F.col("path") == F.col("k"), "left").withColumn("old", F.col("k").isNotNull()).drop("k")
    both = old.join(taken, F.col("target") == F.col("k"), "left").withColumn("new", F.col("k").isNotNull()).drop("k")
    move, create = F.col("op") == "move", F.col("op") == "create"
    out = ~F.coalesce(F.when(move, F.col("target")).otherwise(F.col("path")).startswith(root), F.lit(False))
    verdict = (
        F.when((create | move) & out, "outside").when(create & F.col("old"), "exists").when(~create & ~F.col("old"), "missing")
        .when(move & (F.col("path") == F.col("target")), "same").when(move & F.col("new"), "exists").otherwise("ok")
    )
    return both.select("op", "path", "target", verdict.alias("verdict"))


def files_after(files: DataFrame, checked: DataFrame) -> DataFrame:
    """Files (path, text) after those of checked operations that are ok; a file that is moved keeps its text; created ones have ``text``."""
    ok = checked.filter("verdict = 'ok'")
    moved = ok.filter("op = 'move'").select(F.col("path").alias("k"), "target")
    left = files.join(ok.filter("op = 'delete'").select("path"), "path", "left_anti").join(moved, F.col("path") == F.col("k"), "left")
    made = ok.filter("op = 'create'").select("path", F.lit("").alias("text"))
    return left.select(F.coalesce("target", "path").alias("path"), "text").unionByName(made)
