"""Nearest neighbours by inner product with vantage-point trees.

Vectors get one more component, which brings all to the length of the
longest: among those, the nearest by distance are those with the largest
inner product, so the triangle inequality holds.  A tree over a bounded
sample cuts space into regions; every vector goes to its own, once, and each
region is a shard with a tree of its own (a region with more vectors than a
task holds is dealt to several).  A query is searched in its own region first.
The k-th best there bounds its search radius, and it goes on only to regions
that its ball can reach by the triangle inequality.  Within a shard a block of
queries walks the tree together, nearer child first; a child is left out if
no vector there can beat the k-th best so far.  ``factor`` divides the radius
in both tests: a factor of one is exact, a larger one prunes more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm._shared import materialise

LEAF = 128


def _lifted(points: np.ndarray, most: float) -> np.ndarray:
    """Points with a component more, all of squared length ``most``."""
    return np.column_stack([points, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", points, points), 0.0))])


class Regions:
    """A vantage-point tree whose leaves are regions, fitted on a sample."""

    def __init__(self, sample: np.ndarray, most: float, regions: int):
        self.most, self.count = most, 0
        self.nodes: list[tuple] = []  # (vantage point, radius, near, far), or (region,)
        self.root = self._build(_lifted(sample, most), regions)

    def _build(self, w: np.ndarray, regions: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if regions > 1 and len(w) > 1:
            pick = w[int(np.argmax(((w - w.mean(axis=0)) ** 2).sum(axis=1)))]
            d = np.sqrt(((w - pick) ** 2).sum(axis=1))
            radius = float(np.median(d))
            near = d <= radius
            if not near.all():
                self.nodes[at] = (pick, radius, self._build(w[near], regions // 2), self._build(w[~near], regions - regions // 2))
                return at
        self.nodes[at] = (self.count,)
        self.count += 1
        return at

    def _distance(self, points: np.ndarray, pick: np.ndarray, lift: bool) -> np.ndarray:
        w = _lifted(points, self.most) if lift else np.column_stack([points, np.zeros(len(points))])
        return np.sqrt(((w - pick) ** 2).sum(axis=1))

    def of(self, points: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        out, waiting = np.zeros(len(points), np.int32), [(self.root, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            if len(self.nodes[node]) == 1:
                out[rows] = self.nodes[node][0]
                continue
            pick, radius, near, far = self.nodes[node]
            inner = self._distance(points[rows], pick, True) <= radius
            waiting += [(near, rows[inner]), (far, rows[~inner])]
        return out

    def reached(self, queries: np.ndarray, worst: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """Each region, and the queries whose ball of the radius of their k-th best score so far, divided by the factor, can reach it."""
        scale = np.einsum("ij,ij->i", queries, queries) + self.most
        radius = np.sqrt(np.maximum(scale - 2 * worst, 0.0) + 1e-9 * scale) / factor
        waiting = [(self.root, np.arange(len(queries)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            if len(self.nodes[node]) == 1:
                yield self.nodes[node][0], rows
                continue
            pick, edge, near, far = self.nodes[node]
            d = self._distance(queries[rows], pick, False)
            waiting += [(near, rows[d - radius[rows] <= edge * (1 + 1e-9)]), (far, rows[d + radius[rows] >= edge * (1 - 1e-9)])]


class Tree:
    """A vantage-point tree over the rows of a matrix."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = points, ids
        norms = np.einsum("ij,ij->i", points, points)
        self.most = float(norms.max(initial=0.0))
        self.wide = _lifted(points, self.most)
        self.compared = 0
        self.nodes: list[tuple] = []  # (rows,) of a leaf, else (vantage row, radius, near, far)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        if len(rows) > LEAF:
            # The row farthest from the mean spreads distances well and is always the same.
            w = self.wide[rows]
            pick = int(np.argmax(((w - w.mean(axis=0)) ** 2).sum(axis=1)))
            d = np.sqrt(((w - w[pick]) ** 2).sum(axis=1))
            radius = float(np.median(d))
            near, far = rows[d <= radius], rows[d > radius]
            if len(near) and len(far):
                at = len(self.nodes)
                self.nodes.append(())
                self.nodes[at] = (rows[pick], radius, self._build(near), self._build(far))
                return at
        self.nodes.append((rows[np.argsort(self.ids[rows], kind="stable")],))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best ids and scores of each query, in order, of those not under its bar; -inf where there are fewer than k."""
        self.q, self.own, self.k, self.factor = queries, own, k, factor
        self.bar = np.full(len(queries), -np.inf) if bar is None else bar
        self.lengths = np.einsum("ij,ij->i", queries, queries)
        self.best = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(queries)))
        return self.found, self.best

    def _radius(self, at: np.ndarray) -> np.ndarray:
        worst = np.maximum(self.best[at, -1], self.bar[at])
        scale = self.lengths[at] + self.most
        return np.sqrt(np.maximum(scale - 2 * worst, 0.0) + 1e-9 * scale) / self.factor

    def _visit(self, node: int, at: np.ndarray) -> None:
        if not len(at):
            return
        if len(self.nodes[node]) == 1:
            self._compare(self.nodes[node][0], at)
            return
        row, radius, near, far = self.nodes[node]
        d = np.sqrt(np.maximum(self.lengths[at] + self.most - 2 * (self.q[at] @ self.points[row]), 0.0))
        inner = d <= radius
        self._visit(near, at[inner])
        self._visit(far, at[~inner])
        reach = d[inner] + self._radius(at[inner]) >= radius * (1 - 1e-9)
        self._visit(far, at[inner][reach])
        reach = d[~inner] - self._radius(at[~inner]) <= radius * (1 + 1e-9)
        self._visit(near, at[~inner][reach])

    def _compare(self, rows: np.ndarray, at: np.ndarray) -> None:
        for i in range(0, len(at), 1024):
            q = at[i : i + 1024]
            score = np.einsum("qd,pd->qp", self.q[q], self.points[rows])
            self.compared += score.size
            score[self.own[q][:, None] == self.ids[rows][None, :]] = -np.inf
            better = score.max(axis=1) >= np.maximum(self.best[q, -1], self.bar[q])
            q, score = q[better], score[better]
            if not len(q):
                continue
            ids = np.concatenate([self.found[q], np.broadcast_to(self.ids[rows], score.shape)], axis=1)
            score = np.concatenate([self.best[q], score], axis=1)
            order = np.lexsort((ids, -score), axis=-1)[:, : self.k]
            self.best[q] = np.take_along_axis(score, order, 1)
            self.found[q] = np.take_along_axis(ids, order, 1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_every: int = 20,
    k: int = 20,
    factor: float = 1.0,
    shard_values: int = 1 << 20,
    block_values: int = 1 << 19,
    most_regions: int = 4096,
    sample_values: int = 1 << 20,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the nearest found of each query, nearest first.

    Queries are the rows whose id is divisible by ``query_every``; candidates
    are all rows with another id, and those of a row with another number of
    components are never compared with it.  A row with a null id, or whose
    vector is null, empty, zero or holds a null or non-finite component,
    takes no part.  Ties go to the smaller id; fewer candidates than ``k``
    give them all.  Repeated rows are rows of their own.

    ``shard_values`` and ``block_values`` bound the numbers that a task holds
    of vectors and of queries.  Regions are for vectors of the commonest
    number of components: one for each shard's worth of them, at most
    ``most_regions``, fitted on a sample of about ``sample_values`` numbers, or
    eight vectors for each region if that is more;
    every vector is in one.  A vector is copied for each block of queries that
    reaches its region, a query for each shard that it reaches.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        "id is not null and v is not null and exists(v, x -> x <> 0) and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    )
    squared = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    by_dim = sorted(usable.groupBy(F.size(v).alias("dim")).agg(F.count("*").alias("n"), F.max(squared).alias("most")).collect(), key=lambda r: (-r["n"], r["dim"]))
    dim, n, most = (by_dim[0]["dim"], by_dim[0]["n"], by_dim[0]["most"]) if by_dim else (1, 0, 0.0)
    want = max(1, min(most_regions, -(-n * dim // shard_values)))
    regions = None
    if want > 1:
        rows = max(8 * want, sample_values // dim)
        share = -(-1_000_000 * min(n, rows) // n)
        sample = usable.filter((F.size(v) == dim) & (F.pmod(F.xxhash64("id", "v"), F.lit(1_000_000)) < share)).select("v").limit(2 * rows).toArrow()
        regions = Regions(_matrix(sample["v"]), most, want) if sample.num_rows else None
    shared = spark.sparkContext.broadcast(regions)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(3).to_numpy()
            out, main = np.zeros(len(size), np.int32), np.flatnonzero(size == dim)
            if shared.value is not None and len(main):
                out[main] = shared.value.of(_matrix(batch.column(2).take(pa.array(main))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["key", "id", "v", "dim", "region"])

    numbered = usable.select(F.monotonically_increasing_id().alias("key"), "id", "v", F.size(v).alias("dim"))
    # Each row is written with its key and region, so both are the same wherever it is read.
    dealt = materialise(numbered.mapInArrow(locate, "key long, id long, v array<double>, dim int, region int"), "ann-vectors")
    sizes = dealt.groupBy("dim", "region").agg(F.count("*").alias("n")).select("dim", "region", F.ceil(F.col("n") * F.col("dim") / shard_values).cast("int").alias("shards"))
    sizes = materialise(sizes, "ann-regions")  # a row for each region
    asked = dealt.filter(F.col("id") % query_every == 0)

    def run(cand: pa.Table, ask: pa.Table) -> pa.Table:
        if not cand.num_rows or not ask.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own, bar = ask["id"].to_numpy(), np.nan_to_num(ask["bar"].to_numpy(), nan=-np.inf, neginf=-np.inf)
        ids, best = Tree(_matrix(cand["v"]), cand["id"].to_numpy()).search(_matrix(ask["v"]), own, k, factor, bar)
        keep = best > -np.inf
        per = keep.sum(axis=1)
        return pa.table({
            "key": np.repeat(ask["key"].to_numpy(), per),
            "query_id": np.repeat(own, per),
            "vec_id": ids[keep],
            "score": best[keep],
        })

    cell = ["dim", "region", "shard", "block"]

    def searched(queries: DataFrame) -> DataFrame:
        """What queries (key, id, v, dim, region, bar) find in the regions they are sent to."""
        blocks = queries.groupBy("dim", "region").agg(F.ceil(F.count("*") * F.col("dim") / block_values).cast("int").alias("blocks"))
        of = F.broadcast(materialise(sizes.join(blocks, ["dim", "region"]), "ann-blocks"))  # a row for each region at most
        c = dealt.join(of, ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
        c = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        q = queries.join(of, ["dim", "region"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        c, q = (df.select(*(F.col(x).alias(x) for x in df.columns)) for df in (c, q))  # both come of one table
        return c.groupBy(*cell).cogroup(q.groupBy(*cell)).applyInArrow(run, "key long, query_id long, vec_id long, score double")

    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    found = searched(asked.withColumn("bar", F.lit(None).cast("double")))
    if regions is not None and regions.count > 1:
        found = materialise(found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "ann-home")
        bars = found.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("low")).filter(F.col("n") >= k).select("key", F.col("low").alias("bar"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                home, bar = batch.column(4).to_numpy(), np.nan_to_num(batch.column(5).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
                for region, at in shared.value.reached(_matrix(batch.column(2)), bar, factor):
                    at = at[home[at] != region]
                    if len(at):
                        part = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(np.full(len(at), region, np.int32)), part.column(5)], batch.schema.names)

        on = asked.filter(F.col("dim") == dim).join(bars, "key", "left").select("key", "id", "v", "dim", "region", "bar")
        sent = materialise(on.mapInArrow(route, "key long, id long, v array<double>, dim int, region int, bar double"), "ann-sent")
        found = found.unionByName(searched(sent))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
