import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import simhash
from factloom.llm._shared import components


def plain_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """Smallest reachable id over links of at most three bits, by looking at all pairs."""
    left, parent = list(range(len(prints))), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in left:
        for j in left[:i]:
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i in left:
        k = prints[i][0]
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [low.get(find(i)) for i in left]


@given(st.text(max_size=80))
def test_fingerprint(text):
    text = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.data())
def test_trie_pairs_finds_every_link(seeds, data):
    values = set(seeds)
    for s in seeds:
        for _ in range(8):
            bits = data.draw(st.lists(st.integers(0, 63), max_size=5))
            values.add(s ^ sum(1 << b for b in set(bits)))
    r = np.array(sorted(values), np.uint64)
    old = simhash.LEAF_PAIRS
    try:
        for leaf in (1, old):
            simhash.LEAF_PAIRS = leaf
            got = simhash.trie_pairs(r, [(0, len(r), 0, len(r), 0, 0)], 3)
            want = plain_components([(i, int(x)) for i, x in enumerate(r)])
            assert got.tolist() == want
    finally:
        simhash.LEAF_PAIRS = old


def test_near_duplicates(docs, texts):
    want = plain_components([(i, simhash.fingerprint(t)) for i, t in texts])
    expected = sorted(((i, f"{simhash.fingerprint(t):016x}", c) for (i, t), c in zip(texts, want)), key=str)
    for unit in (50_000, 2):  # 2: every unit is split into pairs of descendants
        got = simhash.near_duplicates(docs, max_unit=unit).collect()
        assert sorted(map(tuple, got), key=str) == expected


def test_drop_keeps_one_of_each(docs, texts):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = plain_components([(i, simhash.fingerprint(t)) for i, t in texts])
    ids = sorted({i for (i, _), c in zip(texts, want) if i is not None and i == c})
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == ids
    assert sum(x is None for x in got) == 2


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).columns == none.columns


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(60)]
    hub = [(1000, 1000 + k) for k in range(1, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long"), "test").collect()))
    assert got == {k: 0 for k in range(1, 61)} | {1000 + k: 1000 for k in range(1, 200)}
