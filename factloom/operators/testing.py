"""Tests: which there are, and which belong to symbols and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.shared import written
from factloom.operators.search import holding

#: Most files that related tests are looked for (fixed value).
MOST_FILES = 25


def discovered(methods: DataFrame, marked: Column, name_filter: str | None = None) -> DataFrame:
    """Tests by project (project, tests, files, first); ``methods``: project, file, name; ``marked``: whether one has a test's attribute."""
    found = methods.filter(marked)
    if name_filter:
        found = found.filter(F.lower("name").contains(name_filter.lower()))
    return found.groupBy("project").agg(F.count("*").alias("tests"), F.countDistinct("file").alias("files"), F.min("name").alias("first"))


def related(tests: DataFrame, refs: DataFrame, name: str, symbols: DataFrame) -> DataFrame:
    """Tests that name a symbol, and those that refer to it or to what overrides or implements it; each once, with how (file, name, how).

    ``tests``: file, name; ``refs``: file, symbol; ``symbols``: symbol.
    """
    by_name = tests.filter(F.lower("name").contains(name.lower())).select("file", "name", F.lit(1).alias("tier"))
    hit = refs.join(symbols, "symbol", "left_semi").select("file").distinct()
    through = tests.join(hit, "file", "left_semi").select("file", "name", F.lit(2).alias("tier"))
    both = by_name.unionByName(through).groupBy("file", "name").agg(F.min("tier").alias("tier"))
    return both.select("file", "name", F.when(F.col("tier") == 1, "name").otherwise("reference").alias("how"))


def terms_of(files: DataFrame, types: DataFrame) -> DataFrame:
    """Terms of changed files (path, term): the types they declare and the stem of their name; ``files``: path; ``types``: path, type."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return types.join(files, "path", "left_semi").select("path", F.lower("type").alias("term")).unionByName(files.select("path", F.lower(stem).alias("term"))).filter("term <> ''").distinct()


def related_files(tests: DataFrame, terms: list[str], fallback: DataFrame) -> DataFrame:
    """Tests whose name or file holds a term (file, name, terms); only where there are none at all, the fallback's.

    ``terms``: a bounded list, so that each test is looked at once for all;
    ``fallback``: file, name.
    """
    text = F.lower(F.concat_ws("\n", F.col("name"), F.col("file").cast("string")))
    held = F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: text.contains(t))
    found = tests.withColumn("terms", held).filter(F.size("terms") > 0).select("file", "name", F.array_join("terms", ",").alias("terms"))
    none = found.agg((F.count("*") == 0).alias("none"))
    instead = fallback.crossJoin(F.broadcast(none)).filter("none").select("file", "name", F.lit("").alias("terms"))
    return found.unionByName(instead)


def related_by_terms(tests: DataFrame, terms: DataFrame, fallback: DataFrame) -> DataFrame:
    """As ``related_files``, for a table of terms of any size (column ``term``, lower case), which stays in Spark (file, name, terms).

    Repeated tests are one; a null name or file is as an empty one there.  Tests
    are numbered, so that an index of their grams has a number in each row.
    """
    text = F.lower(F.concat_ws("\n", F.col("name"), F.col("file").cast("string")))
    each = written(tests.select("file", "name").distinct().select(F.monotonically_increasing_id().alias("id"), "file", "name"), "tests")
    found = holding(each.select("id", text.alias("text")), terms).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))
    found = written(each.hint("merge").join(found, "id").select("file", "name", "terms"), "related")
    none = found.agg((F.count("*") == 0).alias("none"))
    instead = fallback.crossJoin(F.broadcast(none)).filter("none").select("file", "name", F.lit("").alias("terms"))  # one row
    return found.unionByName(instead)
