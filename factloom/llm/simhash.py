"""SimHash near duplicates by a self-join of binary tries.

A fingerprint of 64 bits is computed for each whole text.  Fingerprints that
differ in at most ``budget`` bits are linked, and each document gets the
smallest doc_id that it can reach over links.

The join walks pairs of nodes of a binary trie together, adds up the bits in
which the two paths differ, and drops a pair once that exceeds the budget.
To run it in many tasks, the trie is kept once for each of budget + 1
rotations: of budget + 1 blocks of bits, one must agree, so a linked pair
shares the top node of at least one rotation.  Each such top node is a unit
of work.  A unit that holds too many fingerprints is replaced by the pairs of
its descendants eight bits further down that are still within the budget, so
a dense unit is spread over many tasks.  A unit reports a spanning forest of
its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import components, local_components, materialise

BITS = 64
#: Largest number of pairs that are compared directly instead of descending.
LEAF_PAIRS = 256
#: Pairs expanded at once in a task.
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one text; zero without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(norm, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(norm[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype=np.uint64).astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fp); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(x.as_py(), width, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


def trie_pairs(r: np.ndarray, units: list[tuple[int, int, int, int, int, int]], budget: int) -> np.ndarray:
    """Component labels of rows linked within their units.

    ``r``: rotated fingerprints (uint64), sorted within each unit.  A unit is
    (lo1, hi1, lo2, hi2, differing bits so far, depth): two ranges of rows,
    each all below one trie node of that depth.
    """
    parent = np.arange(len(r))
    waiting: dict[int, list[np.ndarray]] = {}
    for *unit, depth in units:
        waiting.setdefault(depth, []).append(unit)
    front = np.zeros((0, 5), np.int64)
    for depth in range(min(waiting, default=BITS), BITS + 1):
        if depth in waiting:
            front = np.concatenate([front, np.array(waiting[depth], np.int64).reshape(-1, 5)])
        if not len(front):
            continue
        n1, n2 = front[:, 1] - front[:, 0], front[:, 3] - front[:, 2]
        leaf = (n1 * n2 <= LEAF_PAIRS) | (depth == BITS)
        if leaf.any():
            parent = _compare(r, front[leaf], budget, parent)
            front = front[~leaf]
        if depth == BITS or not len(front):
            continue
        ones = np.concatenate([[0], np.cumsum((r >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int64)])
        lo1, hi1, lo2, hi2, err = front.T
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        own = (lo1 == lo2) & (hi1 == hi2)
        kids = np.concatenate([
            np.stack([lo1, mid1, lo2, mid2, err], 1),
            np.stack([mid1, hi1, mid2, hi2, err], 1),
            np.stack([lo1, mid1, mid2, hi2, err + 1], 1),
            np.stack([mid1, hi1, lo2, mid2, err + 1], 1)[~own],
        ])
        front = kids[(kids[:, 4] <= budget) & (kids[:, 1] > kids[:, 0]) & (kids[:, 3] > kids[:, 2])]
    return parent


def _compare(r: np.ndarray, pairs: np.ndarray, budget: int, parent: np.ndarray) -> np.ndarray:
    """Link the rows of small node pairs whose fingerprints are within the budget."""
    size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    cut = np.searchsorted(np.cumsum(size), np.arange(PAIRS_AT_ONCE, int(size.sum()) + PAIRS_AT_ONCE, PAIRS_AT_ONCE), "left") + 1
    begin = 0
    for end in np.unique(np.minimum(cut, len(pairs))):
        p, s = pairs[begin:end], size[begin:end]
        begin = end
        if not len(p):
            continue
        at = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        wide = np.repeat(p[:, 3] - p[:, 2], s)
        i, j = np.repeat(p[:, 0], s) + at // wide, np.repeat(p[:, 2], s) + at % wide
        near = (i != j) & (np.bitwise_count(r[i] ^ r[j]) <= budget)
        parent = local_components(len(r), i[near], j[near], parent)
    return parent


def _join_units(budget: int):
    """The task that joins whole units, sorted by rot, a, b, r."""

    def emit(rot, a, b, depth, r):
        cut = np.flatnonzero((np.diff(rot) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(depth) != 0)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(r)]])
        bits = r.view(np.uint64)
        units = []
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s < 2:
                continue
            d = int(depth[s])
            if a[s] == b[s]:
                units.append((s, e, s, e, 0, d))
            else:
                m = s + int(np.count_nonzero((bits[s:e] >> np.uint64(BITS - d)).astype(np.int64) == a[s]))
                units.append((s, m, m, e, int(a[s] ^ b[s]).bit_count(), d))
        label = trie_pairs(bits, units, budget)
        moved = np.flatnonzero(label != np.arange(len(label)))
        back = rot[moved].astype(np.uint64)

        def home(x):
            return np.where(back == 0, x, (x >> back) | (x << (np.uint64(BITS) - np.maximum(back, np.uint64(1)))))

        yield pa.RecordBatch.from_arrays(
            [pa.array(home(bits[moved]).view(np.int64)), pa.array(home(bits[label[moved]]).view(np.int64))], ["u", "v"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < 200_000:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]) | (cols[3] != cols[3][-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield from emit(*(c[:whole] for c in cols))
            held, rows = [[c[whole:] for c in cols]], rows - whole
        if rows:
            yield from emit(*(np.concatenate(x) for x in zip(*held)))

    return run


def linked(distinct: DataFrame, budget: int = 3, max_unit: int = 50_000) -> DataFrame:
    """Links (u, v) that connect all fingerprints within the budget.

    ``distinct``: one long column ``fp`` without repeats.  Fingerprints are
    connected by the result exactly if a chain of links within the budget
    connects them.
    """
    blocks = budget + 1
    if BITS % blocks:
        raise ValueError("budget + 1 must divide 64")
    width = BITS // blocks

    def rotated(k: int):
        turn = k * width
        whole = F.col("fp") if not turn else F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", BITS - turn))
        top = F.shiftrightunsigned(whole, BITS - width)
        return F.struct(F.lit(turn).alias("rot"), top.alias("a"), top.alias("b"), F.lit(width).alias("depth"), whole.alias("r"))

    units = distinct.select(F.inline(F.array(*(rotated(k) for k in range(blocks)))))
    done = None
    key = ["rot", "a", "b", "depth"]
    for depth in range(width, BITS - 8, 8):
        hot = units.groupBy(*key).count().filter(F.col("count") > max_unit).select(*key)
        if hot.isEmpty():
            break
        # Rows of hot units go to every pair of children that their own child can still be in.
        hot = materialise(hot, "simhash-hot")
        cool = units.join(hot, key, "left_anti")
        done = cool if done is None else done.unionByName(cool)
        masks = F.array(*(F.lit(m).cast("long") for m in sorted(range(256), key=int.bit_count) if m.bit_count() <= budget))
        own = F.shiftrightunsigned("r", BITS - depth)
        sib = F.when(own == F.col("a"), F.col("b")).otherwise(F.col("a"))
        child = F.shiftrightunsigned("r", BITS - depth - 8)
        other = F.shiftleft("sib", 8).bitwiseOR(F.col("child").bitwiseAND(255).bitwiseXOR(F.col("m")))
        split = (
            units.join(hot, key, "left_semi")
            .select("rot", "r", sib.alias("sib"), child.alias("child"), F.explode(masks).alias("m"))
            .select("rot", F.least("child", other).alias("a"), F.greatest("child", other).alias("b"), F.lit(depth + 8).alias("depth"), "r")
        )
        units = materialise(split.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= budget), "simhash-units")
    units = units if done is None else done.unionByName(units)
    packed = units.select("rot", "a", "b", "depth", "r").repartition("rot", "a", "b", "depth").sortWithinPartitions("rot", "a", "b", "depth", "r")
    return packed.mapInArrow(_join_units(budget), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, max_unit: int = 50_000) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    A null or wordless text has fingerprint zero and is linked like any other.
    Rows that repeat each get a row.  A null doc_id keeps its row; a component
    in which every doc_id is null has a null component_id.  An empty table
    gives an empty result.  Other columns are not looked at.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    # Copies meet here, as partial minima: the join sees each fingerprint once.
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = components(linked(distinct.select("fp"), budget, max_unit), "simhash-components")
    rooted = distinct.join(roots.toDF("fp", "root"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, max_unit: int = 50_000) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id, with all its columns.

    Rows that share an id stand or go together, and those that share id and
    text are one.  A document with a null id can't be named as another's copy
    and stays.
    """
    found = near_duplicates(docs, id_col, text_col, width, budget, max_unit)
    stays = F.bool_or(F.col("component_id") == F.col("doc_id"))
    gone = found.filter("doc_id is not null").groupBy("doc_id").agg(stays.alias("stays")).filter("not stays").select(F.col("doc_id").alias(id_col))
    # Ids only, and of what goes: Spark broadcasts them if their size, known since they are written, permits, and then no text is shuffled.
    out = docs.join(materialise(gone, "simhash-gone"), id_col, "left_anti").select(*docs.columns)
    again = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col)
    if not again.isEmpty():
        again = materialise(again, "simhash-again")
        out = out.join(again, id_col, "left_anti").unionByName(out.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col])).select(*docs.columns)
    return out
