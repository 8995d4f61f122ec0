import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import packing


def plain_bfd(lengths, sizes, prefer):
    """Best-fit decreasing one piece at a time; the multiset of bins' contents."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        if fit:
            b = min(fit, key=lambda b: b[0])
        else:
            b = [prefer if n <= prefer else min(s for s in sizes if s >= n), []]
            bins.append(b)
        b[0] -= n
        b[1].append(n)
    return Counter(tuple(sorted(b[1])) for b in bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60), st.sampled_from([4, 8, 16, 32]))
def test_plan_is_best_fit_decreasing(lengths, prefer):
    sizes = (4, 8, 16, 32)
    plan = packing.Plan(dict(Counter(lengths)), sizes, prefer)
    content = {}
    for length, rank, n, first, offset in plan.runs:
        for k in range(n):
            content.setdefault(first + k, []).append((offset, length))
    used = {}
    for b, parts in content.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at  # no gap, no overlap
            at += length
        used[b] = at
    ranks = Counter()
    for length, rank, n, _, _ in plan.runs:
        assert rank == ranks[length]
        ranks[length] += n
    assert ranks == Counter(lengths)
    for first, n, u, size in plan.bins:
        for b in range(first, first + n):
            assert used.pop(b) == u and size == min(s for s in sizes if s >= u)
    assert not used
    assert Counter(tuple(sorted(x for _, x in p)) for p in content.values()) == plain_bfd(lengths, sizes, prefer)


def cheapest(lengths, sizes, cost):
    """The least cost of any packing, by trying every partition."""
    best = [sum(cost(min(s for s in sizes if s >= n)) for n in lengths)]

    def go(at, bins):
        if at == len(lengths):
            best[0] = min(best[0], sum(cost(min(s for s in sizes if s >= b)) for b in bins))
            return
        for k, b in enumerate(bins):
            if b + lengths[at] <= max(sizes) and b not in bins[:k]:
                go(at + 1, [*bins[:k], b + lengths[at], *bins[k + 1 :]])
        go(at + 1, [*bins, lengths[at]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=7), st.sampled_from([0.0, 2.0, 8.0]))
def test_sizes_against_exhaustive_search(lengths, fixed):
    sizes = (4, 8, 16, 32)

    def cost(size):
        return size + fixed

    plans = {s: packing.Plan(dict(Counter(lengths)), sizes, s, cost) for s in (None, *sizes)}
    best, least = packing.best_plan(dict(Counter(lengths)), sizes, cost), cheapest(sorted(lengths, reverse=True), sizes, cost)
    assert best.cost == min(p.cost for p in plans.values())
    assert least <= best.cost <= 1.5 * least
    # The plan that chooses bin by bin places every piece once, and no bin is over its size.
    ranks, used = Counter(), Counter()
    for length, rank, n, first, offset in plans[None].runs:
        assert rank == ranks[length]
        ranks[length] += n
        for k in range(n):
            assert offset == used[first + k]
            used[first + k] += length
    assert ranks == Counter(lengths)
    assert all(used[b] == u <= size for first, n, u, size in plans[None].bins for b in range(first, first + n))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400), min_size=1, max_size=20))
def test_plan_of_many_pieces_places_each_once(counts):
    """Bins open in groups here, and what trials took for them may go elsewhere."""
    plan = packing.Plan(counts, (4, 8, 16, 32))
    ranks, used = Counter(), Counter()
    for length, rank, n, first, offset in plan.runs:
        assert rank == ranks[length]
        ranks[length] += n
        for k in range(first, first + n):
            assert offset == used[k]
            used[k] += length
    assert ranks == Counter(counts)
    assert {b: u for first, n, u, _ in plan.bins for b in range(first, first + n)} == dict(used)
    assert all(u <= size for _, _, u, size in plan.bins)


def test_choosing_sizes_bin_by_bin_can_beat_any_one_size():
    """Pieces that fill small bins best beside pieces that fill large ones best, where each bin has a fixed cost."""
    rng = random.Random(3)
    gains = 0
    for _ in range(40):
        counts = Counter(rng.choice([2050, 1030, 1000, 510, 300, 4100, 2000, 900]) for _ in range(rng.randint(20, 200)))
        plans = {s: packing.Plan(counts, packing.SIZES, s).cost for s in (None, *packing.SIZES)}
        gains += plans[None] < min(c for s, c in plans.items() if s)
        assert packing.best_plan(counts).cost == min(plans.values())
    assert gains


def _check(rows, got, sizes):
    largest = max(sizes)
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]
        assert {r["capacity"] for r in parts} == {min(s for s in sizes if s >= at)}
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got)
    want = Counter()
    for i, n in rows:
        for k in range(-(-n // largest) if n and n > 0 else 0):
            want[i, k, k * largest, min(largest, n - k * largest)] += 1
    assert pieces == want


def test_pack_round_trip(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([3, 3, 3, 17, 40, 64, 65, 200, 1, rng.randint(1, 300)])) for k in range(600)]
    rows += [(700, None), (701, 0), (None, 12), (5, rows[5][1]), (5, rows[5][1]), (702, 64 * 50 + 1)]
    df = spark.createDataFrame([(i, n, 1, 2) for i, n in rows], "doc_id long, n_tokens long, piece int, slice int").repartition(3)
    for part in (None, 7):
        _check(rows, packing.pack(df, sizes=(8, 16, 32, 64), slice_rows=part).collect(), (8, 16, 32, 64))


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
