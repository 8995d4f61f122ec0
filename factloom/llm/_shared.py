"""Helpers shared by the corpus operators: tables, shared folder, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


#: Rows of a batch that goes to or from Python: some megabytes of usual documents, where Spark's default is ten times as many.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for a Spark context, and bound the batches that Python gets.

    The archive is made on the driver; Spark's own file server hands it out.
    A session that sets its own number of rows for a batch keeps it.
    """
    context, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if getattr(context, "_corpus_code_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := os.path.join(folder, "factloom_code.zip"), "w") as z:
        for name in ("factloom/__init__.py", *(f"factloom/llm/{x}" for x in sorted(os.listdir(os.path.dirname(os.path.abspath(__file__)))) if x.endswith(".py"))):
            z.write(os.path.join(root, name), name)
    context.addPyFile(path)
    context._corpus_code_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory, through Spark's own reader."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Taken from ``spark.checkpoint.dir``.  Only a session on one machine may
    leave that unset; it then gets a folder of its own under /tmp/checkpoints.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: a lost executor costs its running tasks, never a
    second run of what is already written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once nothing that is yet to run reads them."""
    for t in tables:
        if path := getattr(t, "_written", None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def local_components(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of 0..n-1 over the links (a, b), in one task."""
    p = np.arange(n) if parent is None else parent
    while True:
        pa, pb = p[a], p[b]
        apart = pa != pb
        if not apart.any():
            return p
        a, b = a[apart], b[apart]
        np.minimum.at(p, np.maximum(pa[apart], pb[apart]), np.minimum(pa[apart], pb[apart]))
        while not np.array_equal(q := p[p], p):
            p = q


def components(edges: DataFrame, label: str) -> DataFrame:
    """Rows (node, root) of each node's smallest reachable node.

    ``edges`` has two long columns.  Large-star and small-star rounds, each
    written to the shared folder, until a round changes nothing; the number
    of rounds grows with the logarithm of the longest chain.  A hub's rows
    are reduced by a partial minimum and its join is one that adaptive
    execution can split, so no task has to hold a node's neighbours.
    """
    spark = edges.sparkSession
    now = materialise(edges.toDF("u", "v").filter("u <> v").distinct(), label)

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def few(df: DataFrame) -> DataFrame:
        """Written in files of about 200,000 rows, however many tasks a shuffle has; never in less than eight tasks."""
        return materialise(df.filter("u <> v").distinct().coalesce(max(8, before[0] // 200_000)), label)

    before = mark(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).toDF("k", "m")
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(large)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).toDF("k", "m")
        small = down.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        last, now = now, few(small)
        forget(last, large)
        after = mark(now)
        if after == before:
            break
        before = after
    if not before[0]:
        return spark.createDataFrame([], "node long, root long")
    return now.groupBy(F.greatest("u", "v").alias("node")).agg(F.min(F.least("u", "v")).alias("root"))
