"""The folder that all executors share, and iterations over written rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or on a session of one machine a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Rounds:
    """Tables written to the shared folder, under one folder of their own.

    Each is read again as it was written, which cuts its lineage.  ``drop``
    deletes tables that no result needs any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.made = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> tuple[str, DataFrame]:
        """The path of a table that is now written, and the table."""
        path = f"{self.path}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[1]

    def drop(self, *paths: str) -> None:
        for path in paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """A table written to the shared folder and read again."""
    return Rounds(df.sparkSession, label).keep(df)


def fixpoint(start: DataFrame, grow: Callable[[DataFrame, DataFrame], DataFrame], label: str) -> DataFrame:
    """All rows reachable from ``start``: ``grow(frontier, seen)`` gives the next rows, of which those not seen go on, until there are none.

    Semi-naive: each round joins only what the last one added, and only that
    is written.  Whether a round added rows is all that comes to the driver.
    """
    rounds = Rounds(start.sparkSession, label)
    path, frontier = rounds.write(start.distinct())
    paths, names = [path], start.columns
    while True:
        seen = rounds.spark.read.schema(start.schema).parquet(*paths)
        fresh = grow(frontier, seen).toDF(*names).distinct()
        old = seen.toDF(*(f"old_{c}" for c in names))
        on = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in names]
        path, frontier = rounds.write(fresh.join(old, on, "left_anti"))
        if frontier.isEmpty():
            return seen
        paths.append(path)


class Chains:
    """Steps along chains of nodes with one edge out each, by powers of two.

    A frontier that walks a long chain node by node takes a round for each;
    with the 2^k-th successors of such nodes, which are no more rows than
    edges, it takes one for each k.  ``edges``: src, dst, without repeats.
    """

    def __init__(self, edges: DataFrame, rounds: Rounds):
        self.rounds = rounds
        only = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).filter("n = 1").select("src", "dst")
        self.powers = [rounds.keep(only)]

    def along(self, rows: DataFrame, depth: str | None = None) -> DataFrame:
        """Rows (.., node) and what chains lead to from there in steps up to twice those of the last time; ``depth`` counts them."""
        last = self.powers[-1]
        for k, p in enumerate(self.powers):
            step = rows.join(p, F.col("node") == F.col("src")).withColumn("node", F.col("dst"))
            if depth:
                step = step.withColumn(depth, F.col(depth) + (1 << k))
            rows = self.rounds.keep(rows.unionByName(step.select(*rows.columns)).distinct())
        self.powers.append(self.rounds.keep(last.toDF("src", "mid").join(last.toDF("mid", "dst"), "mid").select("src", "dst")))
        return rows


def stars(edges: DataFrame, label: str) -> DataFrame:
    """Rows (node, root): the least node that each can be linked to; ``edges``: two columns of one type that has an order.

    Rounds of large stars (a node's greater neighbours go to its least one)
    and small stars (its lesser ones do), until a round changes nothing; their
    number grows with the logarithm of the longest chain.  Both are grouped
    minima and a join, so no task holds a node's neighbours.
    """
    rounds = Rounds(edges.sparkSession, label)
    path, now = rounds.write(edges.toDF("a", "b").filter("a <> b").distinct())

    def to_least(pairs: DataFrame) -> DataFrame:
        """(other, least) of each pair (node, other), where least is the least of all others and the node."""
        least = pairs.groupBy("node").agg(F.min("other").alias("m")).select(F.col("node").alias("at"), F.least("node", "m").alias("least"))
        return pairs.join(least, F.col("node") == F.col("at"))

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = sign(now)
    while before[0]:
        both = now.toDF("node", "other").union(now.select("b", "a"))
        large = to_least(both).filter("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
        files = max(8, before[0] // 200_000)  # however many tasks a shuffle has
        middle, large = rounds.write(large.filter("a <> b").distinct().coalesce(files))
        down = to_least(large.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")))
        small = down.select(F.col("other").alias("a"), F.col("least").alias("b")).union(down.select("node", "least"))
        done, now = rounds.write(small.filter("a <> b").distinct().coalesce(files))
        rounds.drop(path, middle)
        path, after = done, sign(now)
        if after == before:
            break
        before = after
    roots = now.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
    alone = edges.toDF("a", "b").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return alone.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def sums_to_root(edges: DataFrame, label: str) -> DataFrame:
    """Rows (node, total): the weights of all edges from each node up to its root, by doubling pointers.

    ``edges``: node, parent, weight, one row for each node; a parent that has
    no row of its own is a root.  Each round doubles how far a node has looked,
    and only nodes that aren't at their root yet are joined, so a chain of a
    thousand takes about ten.  A cycle is an error.
    """
    rounds = Rounds(edges.sparkSession, label)
    path, now = rounds.write(edges.select("node", F.col("parent").alias("at"), F.col("weight").cast("long").alias("total")))
    most = now.count().bit_length() + 1
    for _ in range(most + 1):
        moving = now.filter("at is not null")
        if moving.isEmpty():
            return now.select("node", "total")
        far = now.select(F.col("node").alias("k"), F.col("at").alias("next"), F.col("total").alias("more"))
        moved = moving.join(far, F.col("at") == F.col("k"), "left").select("node", F.col("next").alias("at"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
        new_path, now = rounds.write(now.filter("at is null").unionByName(moved))
        rounds.drop(path)
        path = new_path
    raise ValueError("the edges have a cycle")
