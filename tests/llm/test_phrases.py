"""Collocations against plain counts of all phrases, and minimal perfect hashes against dicts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, h long, w0 long, phrase string, a long, n long, rank int"


def plain(rows, least, most, covered=80):
    """All phrases of up to four words of all pieces, and all cuts, by their definition."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if a >= least}
        scored = []
        for p, a in good.items():
            if len(p) < 2:
                continue
            longer = [b for q, b in good.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= covered * a for b in longer):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def some(seed: int, n: int):
    rng = random.Random(seed)
    words = ["a", "b", "É", "日本", "x-y", "c\x1cd", "é", "(f)", "1", "\xa0", "\x85", "g"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 25)):
            parts.append(rng.choices(words, [30, 20, 9, 8, 7, 6, 5, 4, 3, 2, 2, 1])[0] if rng.random() < 0.8 else "one two three four")
            parts.append(rng.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "\x0c", "!?"]))
        text = "".join(parts)
        rows.append((text.upper() if rng.random() < 0.2 else text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", None), (" \t.", "fr"), ("alone", "it"), ("lang of its own " * 12_000, "en"), ("z" * 200_000, "en")]
    return rows + rows[:4] * 3


def frame(spark, rows):
    """With columns whose names the operator uses itself."""
    return spark.createDataFrame([(k, t, lang, "s", 1, 2, "p", 3, 4, 5) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def result(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("least", "most", "per_round"), [(4, 2000, 1 << 20), (3, 7, 40)])
def test_against_plain_counts(spark, least, most, per_round):
    """In one round, and in rounds of 40 candidates each."""
    rows = some(1, 120)
    expected = plain(rows, least, most)
    assert {len(r[2].split(" ")) for r in expected} == {2, 3, 4}
    assert result(phrases.collocations(frame(spark, rows), least, most, per_round=per_round)) == expected


def test_small_pieces_few_buckets_and_a_tree_of_several_levels(spark, monkeypatch):
    """Full buckets let candidates through that are infrequent; the counts by slot decide."""
    monkeypatch.setattr(phrases, "BUCKETS", 6)
    monkeypatch.setattr(phrases, "PIECE", 16)
    monkeypatch.setattr(phrases, "HELD", 5)
    monkeypatch.setattr(phrases, "AT_ONCE", 300)
    monkeypatch.setattr(phrases, "FAN_IN", 2)
    rows = some(2, 60)
    assert result(phrases.collocations(frame(spark, rows).repartition(7), 3, 50)) == plain(rows, 3, 50)


def test_nothing_frequent_and_an_empty_table(spark, none):
    assert phrases.collocations(frame(spark, [("a b c", "x"), (None, None)]), 30).count() == 0
    assert phrases.collocations(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_has_a_slot_for_each_key_and_none_for_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(1, 2**63, (n, 4), dtype=np.uint64), axis=0)
    for k in range(1, 4):
        keys[k::4, k:] = 0
    h = phrases.PerfectHash(keys)
    size = (keys != 0).sum(1)
    got = np.concatenate([np.zeros(0, np.int64)] + [h.slots(list(keys[size == k, :k].T)) for k in range(1, 5)])
    assert sorted(got.tolist()) == list(range(n))
    other = rng.integers(1, 2**63, (3000, 2), dtype=np.uint64)
    assert (h.slots(list(other.T)) == -1).all()
    if n > 10:  # a key's own words in another order, and its beginning, aren't keys
        four = keys[size == 4]
        assert (h.slots([four[:, 1], four[:, 0], four[:, 2], four[:, 3]]) == -1).all() and (h.slots([four[:, 0], four[:, 1]]) == -1).all()


def test_no_infrequent_phrase_is_written_however_full_the_marks(spark, monkeypatch):
    """A corpus that fills all buckets used to make a candidate of every phrase; each range counts on its own instead."""
    wrote = {}
    monkeypatch.setattr(phrases, "BUCKETS", 6)
    monkeypatch.setattr(phrases, "materialise", lambda df, label, f=phrases.materialise: wrote.setdefault(label, []).append(out := f(df, label)) or out)
    monkeypatch.setattr(phrases, "forget", lambda *_: None)
    rng = random.Random(4)
    rows = [(" ".join(f"w{rng.randrange(40)}" for _ in range(200)) + ". one two three four", "en") for _ in range(40)]
    want = plain(rows, 20, 2000, covered=10**9)
    assert result(phrases.collocations(frame(spark, rows), 20, 2000, 10**9, per_round=500)) == want
    tables = [t for label, made in wrote.items() for t in made if label.startswith("phrases-c") and "w3" in t.columns]
    assert tables and max(t.filter("w1 <> 0").count() for t in tables) == len(want) < 100


def test_counts_of_a_range_against_plain_sums():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(1, 7, (3000, 3), dtype=np.uint32), rng.integers(1, 2**31, (3000, 1), dtype=np.uint32)], 1)
    rows = np.concatenate([rows, np.array([[2**31 - 2, 1, 2**31 - 3, 4_000_000_000]] * 3, np.uint32)])
    want = Counter()
    for *key, n in rows.tolist():
        want[tuple(key)] += n
    least = sorted(want.values())[len(want) // 2]
    keys, counts = phrases.range_counts(phrases._unpacked(phrases._packed(rows), 4), least)
    assert dict(zip(map(tuple, keys.tolist()), counts.tolist())) == {k: n for k, n in want.items() if n >= least}
    assert len(phrases.range_counts(rows[:0], least)[1]) == 0
