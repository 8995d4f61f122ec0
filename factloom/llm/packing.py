"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost.  Documents longer
than the largest are cut into full pieces and a rest.  What remains is packed
best-fit decreasing: a piece goes to the open bin with the least room that
still takes it; where none does, a bin is opened.  Its size is chosen then,
bin by bin: every permitted size is filled, on trial, with the longest pieces
left over that fit, and the one that costs least for each token it would hold
is opened.  Plans that always prefer one size are made beside that, and the
cheapest of all is used.  At the end each bin is downsized to the cheapest
size that holds its contents.

Pieces of equal length are interchangeable, so a plan needs only how many
there are of each length: a table no longer than the largest sequence.  The
plan says which runs of ranks of a length go to which bins; documents look up
their own place by their rank among those of their length.  Ranks are
numbered within slices of a length, so a length that a third of all documents
have is spread over many tasks.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm._shared import materialise

SIZES = (512, 1024, 2048, 4096, 8192)


def sequence_cost(size: int) -> float:
    """Cost of a sequence: its tokens and a fixed part for each sequence."""
    return size + 64.0


class _Trial:
    """Fills bins on trial with what is left over of each length."""

    def __init__(self, counts: dict[int, int], sizes: tuple[int, ...], cost: Callable[[int], float]):
        self.free, self.sizes, self.cost = dict(counts), sizes, cost
        self.lengths = sorted(counts)

    def without(self, length: int, left: int) -> None:
        """Only so many of a length are left, and none of longer ones."""
        self._set(length, left)

    def _set(self, length: int, n: int) -> None:
        if n > 0:
            if length not in self.free:  # what a trial took went elsewhere
                insort(self.lengths, length)
            self.free[length] = n
        elif self.free.pop(length, None) is not None:
            self.lengths.pop(bisect_left(self.lengths, length))

    def filled(self, size: int, length: int) -> dict[int, int]:
        """What a bin of a size takes, the longest that fit first; its first piece is of the given length."""
        took, room, at = {length: 1}, size - length, length
        while room and self.lengths:
            at = bisect_right(self.lengths, min(at, room)) - 1
            if at < 0:
                break
            at = self.lengths[at]
            n = min(room // at, self.free[at] - took.get(at, 0))
            if n > 0:
                took[at] = took.get(at, 0) + n
                room -= n * at
            at -= 1
        return took

    def choose(self, length: int) -> tuple[int, int]:
        """The size that costs least for each token it would hold (of equal ones the largest), and how many such bins to open."""
        best = None
        for size in reversed(self.sizes[bisect_left(self.sizes, length) :]):
            took = self.filled(size, length)
            used = sum(n * k for n, k in took.items())
            rate = self.cost(self.sizes[bisect_left(self.sizes, used)]) / used
            if best is None or rate < best[0]:
                best = rate, size, took
        _, size, took = best
        many = max(1, min(self.free[n] // k for n, k in took.items()))
        for n, k in took.items():
            self._set(n, self.free[n] - many * k)
        return size, many


class Plan:
    """Best-fit decreasing over counts of lengths.

    ``prefer``: the size to open, or none to choose it for each bin.  Bins
    come in groups of equal contents.  ``runs`` has, for each run of pieces,
    (length, first rank, pieces, first bin, offset in the bin); the pieces of
    a run go to consecutive bins.  ``bins`` has (first bin, bins, used, size).
    Each step ends a length, a group of bins or what a trial took of a length,
    so a plan's size is bounded by the largest sequence, not by the pieces.
    """

    def __init__(self, counts: dict[int, int], sizes: tuple[int, ...] = SIZES, prefer: int | None = None, cost: Callable[[int], float] = sequence_cost):
        sizes = tuple(sorted(sizes))
        self.runs: list[tuple[int, int, int, int, int]] = []
        groups: dict[int, list[tuple[int, int, int]]] = {}  # room: (first bin, bins, used)
        rooms: list[int] = []
        made = 0
        closed: list[tuple[int, int, int]] = []
        trial = None if prefer else _Trial(counts, sizes, cost)

        def put(room: int, group: tuple[int, int, int]) -> None:
            if not room:
                closed.append(group)
            elif room in groups:
                heapq.heappush(groups[room], group)
            else:
                groups[room] = [group]
                insort(rooms, room)

        for length in sorted(counts, reverse=True):
            left, rank = counts[length], 0
            while left:
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, n, used = heapq.heappop(groups[room])
                    if not groups[room]:
                        del groups[room]
                        rooms.pop(at)
                else:
                    if trial:
                        trial.without(length, left)
                        room, n = trial.choose(length)
                        n = min(n, -(-left // (room // length)))
                    else:
                        room = prefer if length <= prefer else sizes[bisect_left(sizes, length)]
                        n = -(-left // (room // length))
                    first, used = made, 0
                    made += n
                # A bin that took one of these pieces is the best fit for the next as long as it takes another.
                each = room // length
                take, layers = (min(n, left // each), each) if left >= each else (1, left)
                for k in range(layers):
                    self.runs.append((length, rank, take, first, used + k * length))
                    rank += take
                left -= take * layers
                put(room - layers * length, (first, take, used + layers * length))
                if take < n:
                    put(room, (first + take, n - take, used))
            if trial:
                trial.without(length, 0)
        full = closed + [g for held in groups.values() for g in held]
        self.bins = sorted((first, n, used, sizes[bisect_left(sizes, used)]) for first, n, used in full if used)
        self.cost = sum(n * cost(size) for _, n, _, size in self.bins)


def best_plan(counts: dict[int, int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = sequence_cost) -> Plan:
    """The cheapest of the plan that chooses each bin's size and those that prefer one; ties go to the first, then to the largest."""
    return min((Plan(counts, sizes, s, cost) for s in (None, *sorted(sizes, reverse=True))), key=lambda p: p.cost)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    length_col: str = "n_tokens",
    sizes: tuple[int, ...] = SIZES,
    cost: Callable[[int], float] = sequence_cost,
    slice_rows: int | None = None,
) -> DataFrame:
    """Rows (bin_id, capacity, bin_offset, doc_id, piece, start, length): where each piece of each document lies.

    ``start`` counts tokens of the document.  A length is cut into slices of
    about ``slice_rows`` rows for ranking, at most 20,000 slices more than there are lengths.  A document of null or no length
    has no piece; neither does one with a null id get lost: it is packed like
    any other.  Rows that repeat are packed each.  An empty table gives no
    bins.
    """
    spark = docs.sparkSession
    largest = max(sizes)
    length = F.col(length_col).cast("long")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.alias("n")).filter("n > 0")
    # Full pieces fill a bin of the largest size alone; the rest is what has to be packed.
    cuts = src.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest)), lambda k: F.least(F.lit(largest), F.col("n") - k * largest))).alias("piece", "length"))
    pieces = materialise(cuts.select("doc_id", F.col("piece").cast("long"), F.col("length").cast("int")), "packing-pieces")
    sized = pieces.groupBy("length").count().toPandas()  # at most one row for each length
    counts = dict(zip(sized["length"].astype(int), sized["count"].astype(int)))
    plan = best_plan(counts, tuple(sizes), cost)

    # Ranks within a length: a slice's first rank, and the place within the slice.
    slice_rows = slice_rows or max(200, sum(counts.values()) // 20_000)
    slices = {n: -(-c // slice_rows) for n, c in counts.items()}
    many = max(slices.values(), default=1)
    spread = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(many)).cast("int")
    if many > 1:
        cut = spark.createDataFrame([(int(n), int(k)) for n, k in slices.items()], "length int, slices int")
        dealt = pieces.withColumn("spread", spread).join(F.broadcast(cut), "length").withColumn("slice", F.col("spread") % F.col("slices")).drop("spread", "slices")
        dealt = materialise(dealt, "packing-slices")
    else:
        dealt = pieces.withColumn("slice", F.lit(0))
    sizes_of = dealt.groupBy("length", "slice").count().toPandas().sort_values(["length", "slice"])  # rows / slice_rows + lengths
    sizes_of["base"] = sizes_of.groupby("length")["count"].cumsum() - sizes_of["count"]
    bases = {(int(a), int(b)): int(c) for a, b, c in zip(sizes_of["length"], sizes_of["slice"], sizes_of["base"])}

    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    bins = np.array(plan.bins, np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((bases, runs, bins))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, runs, bins = shared.value
        key = (runs[:, 0] << 44) | runs[:, 1]
        for batch in batches:
            doc, piece, length, part, row = batch.columns
            n = length.to_numpy().astype(np.int64)
            base = np.array([bases[k] for k in zip(n.tolist(), part.to_pylist())], np.int64)
            rank = base + row.to_numpy() - 1
            at = np.searchsorted(key, (n << 44) | rank, "right") - 1
            where = runs[at, 3] + rank - runs[at, 1]
            size = bins[np.searchsorted(bins[:, 0], where, "right") - 1, 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), pa.array(size), pa.array(runs[at, 4]), doc, piece, pa.array(piece.to_numpy() * largest), pa.array(n)],
                ["bin_id", "capacity", "bin_offset", "doc_id", "piece", "start", "length"],
            )

    row = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece"))
    numbered = dealt.select("doc_id", "piece", "length", "slice", row.cast("long").alias("row"))
    return numbered.mapInArrow(place, "bin_id long, capacity long, bin_offset long, doc_id long, piece long, start long, length long")
