"""Readers of captured tool output, given as text or lines in DataFrames.

Nothing is run here: logs, reports and listings are input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: path(line,column): severity CODE: message [project]; the place may have an end, too.
_BUILD_LINE = r"^\s*(.*?)\((\d+),(\d+)(?:,\d+,\d+)?\):\s+(error|warning|info)\s+([A-Za-z]+\d+):\s*(.*?)(?:\s+\[(.+?)\])?\s*$"


def build_diagnostics(lines: DataFrame, column: str = "value") -> DataFrame:
    """Diagnostics of a build log, once for each (id, path, line, col): the first message and project in order."""
    part = [F.regexp_extract(column, _BUILD_LINE, k) for k in range(1, 8)]
    found = lines.filter(F.col(column).rlike(_BUILD_LINE)).select(
        part[0].alias("path"), part[1].cast("int").alias("line"), part[2].cast("int").alias("col"), F.initcap(part[3]).alias("severity"), part[4].alias("id"), part[5].alias("message"), F.nullif(part[6], F.lit("")).alias("project")
    )
    one = found.groupBy("id", "path", "line", "col").agg(F.min(F.struct("severity", "message", "project")).alias("d"))
    return one.select("path", "line", "col", "d.severity", "id", "d.message", "d.project")


def test_results(reports: DataFrame, column: str = "xml") -> DataFrame:
    """Test results of XML reports (name, outcome)."""
    names = F.xpath(column, F.lit("//*[local-name()='UnitTestResult']/@testName"))
    outcomes = F.xpath(column, F.lit("//*[local-name()='UnitTestResult']/@outcome"))
    return reports.select(F.inline(F.arrays_zip(names.alias("name"), outcomes.alias("outcome")))).toDF("name", "outcome")


def test_summary(results: DataFrame) -> DataFrame:
    """Totals of test results (total, passed, failed, skipped)."""
    o = F.col("outcome")
    return results.agg(F.count("*").alias("total"), F.count_if(o == "Passed").alias("passed"), F.count_if(o == "Failed").alias("failed"), F.count_if(~o.isin("Passed", "Failed")).alias("skipped"))


def coverage_lines(reports: DataFrame, column: str = "xml") -> DataFrame:
    """Lines of coverage reports with their hits, each once (class, line, hits)."""
    part = reports.select(F.explode(F.slice(F.split(column, r"<class\s"), 2, 1 << 30)).alias("part"))

    def each(attribute: str) -> Column:
        return F.regexp_extract_all("part", F.lit(rf'<line\s[^>]*?\b{attribute}="(\d+)"'), F.lit(1))

    lines = part.select(F.regexp_extract("part", r'\bname="([^"]*)"', 1).alias("class"), F.inline(F.arrays_zip(each("number").alias("n"), each("hits").alias("h"))))
    return lines.toDF("class", "line", "hits").select("class", F.col("line").cast("int").alias("line"), F.col("hits").cast("long").alias("hits")).distinct()


_VULNERABLE = "projects array<struct<path:string,frameworks:array<struct<framework:string,topLevelPackages:array<struct<id:string,resolvedVersion:string,vulnerabilities:array<struct<severity:string,advisoryurl:string>>>>,transitivePackages:array<struct<id:string,resolvedVersion:string,vulnerabilities:array<struct<severity:string,advisoryurl:string>>>>>>>>"


def vulnerable_packages(reports: DataFrame, column: str = "json") -> DataFrame:
    """Findings of a package listing in JSON (project, package, version, severity, advisory, transitive)."""
    projects = reports.select(F.explode(F.from_json(column, _VULNERABLE).getField("projects")).alias("p")).select("p.path", F.explode("p.frameworks").alias("f"))
    top = projects.select("path", F.lit(False).alias("transitive"), F.explode("f.topLevelPackages").alias("k"))
    below = projects.select("path", F.lit(True).alias("transitive"), F.explode("f.transitivePackages").alias("k"))
    each = top.unionByName(below).select("path", "transitive", "k.id", "k.resolvedVersion", F.explode("k.vulnerabilities").alias("v"))
    return each.select(F.col("path").alias("project"), F.col("id").alias("package"), F.col("resolvedVersion").alias("version"), "v.severity", F.col("v.advisoryurl").alias("advisory"), "transitive").distinct()


def changed_files(lines: DataFrame, column: str = "value") -> DataFrame:
    """Files of a short status listing of version control (status, path); of a rename, the new path."""
    found = lines.filter(F.length(column) > 3)
    path = F.regexp_replace(F.substring(column, 4, 1 << 20), r"^.* -> ", "")
    return found.select(F.trim(F.substring(column, 1, 2)).alias("status"), F.trim(path).alias("path"))


def ini_options(lines: DataFrame, column: str = "value") -> DataFrame:
    """Options of lines ``key = value`` (option, value); comments and sections go."""
    pattern = r"^\s*([^#;\[\s=][^=]*?)\s*=\s*(.*?)\s*$"
    return lines.filter(F.col(column).rlike(pattern)).select(F.lower(F.regexp_extract(column, pattern, 1)).alias("option"), F.regexp_extract(column, pattern, 2).alias("value"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files."""
    return spark.read.text(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts of files, whole, with their paths."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def properties(lines: DataFrame, column: str = "value") -> DataFrame:
    """Properties of a captured dump, a line ``project|name=value`` each (project, name, value); other lines go."""
    pattern = r"^([^|]*)\|([^=]*)=(.*)$"
    part = [F.regexp_extract(column, pattern, k) for k in (1, 2, 3)]
    return lines.filter(F.col(column).rlike(pattern)).select(part[0].alias("project"), part[1].alias("name"), part[2].alias("value"))


def items(reports: DataFrame, column: str = "json") -> DataFrame:
    """Items of a captured JSON list with their metadata, a row for each (project, item, name, value)."""
    each = reports.select(F.explode(F.from_json(column, "array<struct<project:string,item:string,metadata:map<string,string>>>")).alias("i"))
    return each.select("i.project", "i.item", F.explode("i.metadata").alias("name", "value"))
