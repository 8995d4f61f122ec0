"""Distances of sources and their own terms, against a dense count in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from factloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, p long, term string, at int, rank int"


def plain(rows, least, most):
    """All shares of all kept terms in all groups, and all pairs of groups."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    df, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        df.update({(lang, t) for t in terms})
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    for lang, source, terms in docs:
        counts[lang, source].update(t for t in terms if t in set(kept[lang]))
    out = []
    for lang, sources in groups.items():
        v = len(kept[lang])
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v) for t in kept[lang]}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept[lang]), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept[lang] if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, end in (("pair", pairs, None), ("term", terms, most)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered[:end], 1)]
    return sorted(out)


def some(seed: int, n: int):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcÀßñ日") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = []
    for k in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "", None, "d", "é"])
        ws = rng.choices(words, [1 + (i + len(source or '')) % 7 for i in range(len(words))], k=rng.randint(0, 40))
        rows.append((rng.choice([" ", "-", "\x00", "\n", "3"]).join(w.upper() if rng.random() < 0.3 else w for w in ws), rng.choice(["x", "x", "y", None, ""]), source))
    rows += [(None, "x", "a"), ("", "x", "empty"), (None, None, None), ("alone", "single", "s"), ("a b c " * 20_000, "x", "long"), ("w" * 50_000, "x", "long")]
    return rows + rows[:5]


def frame(spark, rows):
    """With columns whose names the operator uses itself."""
    return spark.createDataFrame([(k, t, lang, s, 7, 7, "w", 3, 1) for k, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(3)


def result(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("shard_bytes", [1 << 20, 200])
def test_against_plain_counts(spark, shard_bytes):
    """In one pass, and in several passes of a few terms each."""
    rows = some(1, 200)
    assert result(divergence.audit(frame(spark, rows), 5, 10, shard_bytes)) == plain(rows, 5, 10)


def test_many_sources_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "CHUNK", 4)
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("abcdefghijklmnopq", k=12)), "x", f"s{rng.randint(0, 16)}") for _ in range(150)]
    assert result(divergence.audit(frame(spark, rows), 3, 5)) == plain(rows, 3, 5)


def test_held_rows_are_handed_on_whole(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(divergence, "AT_ONCE", 50)
    rows = some(2, 60)
    assert result(divergence.audit(frame(spark, rows), 5, 10)) == plain(rows, 5, 10)


def test_no_terms_kept_and_empty_tables(spark, none):
    rows = [("a b", "x", "s"), ("c d", "x", "t"), (None, "x", "u")]
    got = result(divergence.audit(frame(spark, rows), 30, 50))
    assert got == plain(rows, 30, 50) and {r[4] for r in got} == {0} and len(got) == 6
    assert divergence.audit(none).count() == 0


def test_no_source_is_sent_whole(spark):
    """A task adds up its own counts: many copies of one text of one source are a row for each term and task."""
    rows = [("a b c a", "x", "hot")] * 3000
    kept = spark.createDataFrame([("x", t) for t in "abc"], "lang string, term string")
    got = divergence.occurrences(frame(spark, rows), kept).collect()
    assert sorted((r["term"], r["n"]) for r in got) == [("a", 6000), ("b", 3000), ("c", 3000)]
