import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import lm

SMALL = lm.Shape(vocabulary=64, classes=6, hidden=12, window=8, streams=16, chunk_tokens=5000)


def test_gradients_by_differences():
    g = lm.Gru(np.array([0, 1, 4, 8, 12]), lm.Shape(vocabulary=12, classes=4, hidden=5))
    for x in g.NAMES:
        setattr(g, x, getattr(g, x).astype(np.float64))
    rng = np.random.default_rng(0)
    ids, y, fresh, h = rng.integers(0, 12, (6, 3)), rng.integers(0, 12, (6, 3)), rng.random((6, 3)) < 0.2, rng.standard_normal((3, 5)) * 0.3
    grads, _, _ = g.gradients(ids, y, fresh, h)
    for name in g.NAMES:
        a, d = getattr(g, name), grads[name]
        if isinstance(d, tuple):
            full = np.zeros_like(a)
            full[d[0]] = d[1]
            d = full
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in a.shape)
            old, loss = a[at], []
            for e in (1e-2, -1e-2):
                a[at] = old + e
                loss.append(g.gradients(ids, y, fresh, h)[2])
            a[at] = old
            assert d[at] == pytest.approx((loss[0] - loss[1]) / 2e-2, abs=2e-3)


def _scorer(texts):
    c = Counter(w for t in texts for w in lm.tokens(t))
    head = [(lm.END, len(texts)), *c.most_common(200)]
    return lm.Scorer(head, SMALL, sum(c.values()) - sum(k for _, k in head[1:]))


def test_state_goes_through_whole_texts_whatever_runs_beside_them():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(n)) for n in (0, 1, 5, 300, 40, 7, 1000)]
    s = _scorer(texts)
    ranks = [np.append(s.ranks(lm.tokens(t)), 0) for t in texts]
    together = s.score(ranks, [0.0] * len(texts))
    for r, got in zip(ranks, together):
        ids, h, want = s.ids(r), np.zeros((1, SMALL.hidden), np.float32), 0.0
        x = np.concatenate([[s.rank[lm.END] + 1], ids[:-1]])
        for a, b in zip(x, ids):  # one word at a time
            states, h = s.gru.steps(np.array([[a]]), np.zeros((1, 1), bool), h)
            want += float(s.gru.log_probability(states[0], np.array([b]))[0])
        assert got == pytest.approx(want / math.log(10), rel=1e-4, abs=1e-4)


def test_classes_share_out_probability():
    s = _scorer(["a b c d e f g h"] * 3)
    n = int(s.gru.cuts[-1])
    states = np.random.default_rng(0).standard_normal((1, SMALL.hidden)).astype(np.float32)
    p = np.exp(s.gru.log_probability(np.repeat(states, n, 0), np.arange(n)))
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_every_token_trains():
    """What columns leave over is trained too: a stream of any length changes the model by its last tokens."""
    s = _scorer(["a b c d e f g h i j k l"] * 3)
    for n in (300, 301, 317):
        ids = np.random.default_rng(n).integers(1, 12, n + 1)
        other = ids.copy()
        other[-1] = ids[-1] % 12 + 1
        flats = []
        for x in (ids, other):
            g = lm.Gru(s.gru.cuts, SMALL)
            g.train(x, np.zeros(n + 1, bool), {k: np.full(getattr(g, k).shape, 1e-4, np.float32) for k in g.NAMES})
            flats.append(g.flat())
        assert not np.array_equal(*flats)


def test_copies_are_averaged_by_their_tokens(spark):
    """The sum in levels is that of all copies: more partitions than are added up in one place."""
    rows = [(i, f"a b c d{i % 7} " * (1 + i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    old, flats = lm.FAN, []
    try:
        for lm.FAN in (2, 3, 64):
            s = _scorer([t for _, t in rows])
            lm._train(df.select("text"), s)
            flats.append(s.gru.flat())
    finally:
        lm.FAN = old
    assert np.allclose(flats[0], flats[2], atol=1e-6) and np.allclose(flats[1], flats[2], atol=1e-6)


def test_scores_do_not_depend_on_partitions(spark):
    """The same rows in 1, 4 and 40 partitions, in any order, train the same model; repeated and null rows among them."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 90)))) for i in range(150)] + [(None, "a b"), (3, None), (4, "a b c")] * 2
    every = []
    for n in (1, 4, 40):
        rng.shuffle(rows)
        got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), shape=SMALL).collect()
        every.append(sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 3)) for r in got))
    assert every[0] == every[1] == every[2]


def test_more_rounds_go_on_from_the_average(spark):
    rows = [(i, f"a b c d{i % 7} " * (1 + i % 5)) for i in range(300)]
    flats = []
    for rounds in (1, 3):
        shape = lm.Shape(vocabulary=64, classes=6, hidden=12, window=8, streams=16, chunk_tokens=5000, rounds=rounds, groups=2)
        c = Counter(w for _, t in rows for w in lm.tokens(t))
        s = lm.Scorer([(lm.END, len(rows)), *c.most_common()], shape, 0)
        lm._train(spark.createDataFrame(rows, "doc_id long, text string"), s)
        flats.append(s.gru)
    assert not np.array_equal(flats[0].flat(), flats[1].flat())
    assert all((g.squares[x] >= 1e-4 - 1e-9).all() and (g.squares[x] > 1e-4).any() for g in flats for x in g.NAMES)


def test_unknown_words_share_out_probability():
    """Words outside the vocabulary, new ones counted as one, have together what the unknown word has."""
    texts = [" ".join(f"w{(i * k) % 90}" for k in range(40)) for i in range(60)]
    c = Counter(w for t in texts for w in lm.tokens(t))
    head = [(lm.END, len(texts)), *c.most_common(70)]
    s = lm.Scorer(head, SMALL, sum(c.values()) - sum(k for _, k in head[1:]))
    inside = sum(math.exp(s.unknown(np.array([r]), 0)) for r in range(SMALL.vocabulary - 1, len(head)))
    beyond = sum(n * math.exp(s.log_new) for n in (k for w, k in c.items() if w not in s.rank))
    assert inside + beyond + math.exp(s.unknown(np.zeros(0, int), 1)) == pytest.approx(1)


def plain(rows):
    tok = [[w.decode() for w in lm.tokens(t)] + [" "] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for ws, h in zip(tok, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted([(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), h, ws in zip(rows, held, tok)], key=str)


def test_score_against_plain_counts(docs, texts):
    for head in (5, 100_000):  # most words beyond the head, and none
        got = lm.score(docs, shape=SMALL, head_words=head).collect()
        assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], key=str) == plain(texts)
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_words_beyond_the_head_are_scored_by_their_counts(spark):
    """The size of the head changes no score of a text whose words are all in the training documents."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(400)], k=80))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    small, whole = ({r["doc_id"]: r for r in lm.score(df, shape=SMALL, head_words=n).collect()} for n in (120, 100_000))
    of = [i for i, r in whole.items() if not r["held_out"]]
    assert len(of) > 80
    assert [small[i]["score"] for i in of] == pytest.approx([whole[i]["score"] for i in of], rel=1e-5)


def test_learns_what_counts_cannot(spark):
    """Held-out texts in which each word follows from the one before."""
    rng = random.Random(0)
    def text(n):
        out, k = [], rng.randrange(20)
        for _ in range(n):
            out.append(f"w{k}")
            k = (k * 7 + 3) % 20 if rng.random() < 0.95 else rng.randrange(20)
        return " ".join(out)

    rows = [(i, text(60)) for i in range(700)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), shape=SMALL).filter("held_out").collect()
    assert len(got) > 40
    assert sum(r["score"] for r in got) > 0.8 * sum(r["base_score"] for r in got)


def test_empty_and_nothing_to_train_on(spark, none):
    assert lm.score(none, shape=SMALL).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string"), shape=SMALL).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 3, 0, 0, 0.0)
