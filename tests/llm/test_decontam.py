import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import decontam


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(text, items, window):
    """Word positions hit and items found, by comparing every window at every place."""
    w = plain_words(text)
    hit, found = set(), set()
    for key, item in items:
        iw = plain_words(item)
        n = min(window, len(iw))
        if not n:
            continue
        for i in range(len(iw) - n + 1):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == iw[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(key)
    return len(w), hit, found


@given(st.text(max_size=60))
def test_words(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [w.decode() for w in decontam.words(text)] == plain_words(text)


letters = st.lists(st.sampled_from("abc"), max_size=12).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(letters, min_size=1, max_size=5), st.lists(letters, min_size=1, max_size=4), st.integers(1, 5))
def test_scan_against_all_windows(items, texts, window):
    items = [(str(k), x) for k, x in enumerate(items)]
    a = decontam.Automaton([(k, decontam.words(x)) for k, x in items], window)
    for text, (spans, found) in zip(texts, a.scan([decontam.words(t) for t in texts])):
        _, hit, want = plain(text, items, window)
        assert {p for x, y in spans for p in range(x, y)} == hit
        assert spans == decontam.merged(spans)
        assert found == want


def _items(spark):
    return spark.createDataFrame([(1, "The quick, brown fox jumps over the lazy dog and runs away"), (2, "short item"), (3, None), (4, "!!"), (None, "a b c"), (1, "The quick, brown fox jumps over the lazy dog and runs away")], "item_id long, text string")


LONG = "the quick brown fox jumps over the lazy dog and runs away"


def test_contamination(spark, docs, texts):
    items = _items(spark)
    more = [(900, f"before {LONG} after"), (901, "It's a SHORT item, this"), (902, LONG)]
    rows = texts + more
    src = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_hit int")
    plain_items = [(str(r["item_id"]), r["text"]) for r in items.collect() if r["item_id"] is not None and r["text"] is not None]
    for shard, most in ((1_000_000, 8_000_000), (3, 8_000_000), (1_000_000, 3)):  # one shard, several, several rounds
        got = decontam.contamination(src, items, shard_words=shard, max_words=most).collect()
        assert len(got) == len(rows)
        have = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got), key=str)
        want = []
        for i, t in rows:
            n, hit, found = plain(t, plain_items, 10) if t is None or len(t) < 2000 else (len(plain_words(t)), set(), set())
            want.append((i, n, len(hit), tuple(sorted(found))))
        assert have == sorted(want, key=str)


def test_no_items_and_no_documents(spark, docs, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, empty).filter("n_hit > 0").count() == 0
    assert decontam.contamination(none, _items(spark)).count() == 0
    assert decontam.decontaminate(none, empty).count() == 0


def test_decontaminate_cuts_and_drops(spark):
    rng = random.Random(3)
    clean = " ".join(f"w{rng.randint(0, 999)}" for _ in range(60))
    inner = LONG.split()
    # A passage within a passage: cutting the inner one brings the outer one's halves together.
    nested = f"{clean} {' '.join(inner[:6])} {LONG} {' '.join(inner[6:])} {clean}"
    rows = [(1, clean, 7, "x"), (2, f"{clean} {LONG} {clean}", 7, "x"), (3, LONG, 7, "x"), (4, None, 7, "x"), (5, "", 7, "x"), (6, nested, 7, "x")]
    src = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(src, _items(spark)).collect()}
    assert decontam.decontaminate(src, _items(spark), max_words=2).exceptAll(decontam.decontaminate(src, _items(spark))).count() == 0
    assert set(got) == {1, 2, 4, 5, 6}
    assert got[1]["text"] == clean and got[1]["n_chars"] == 7
    assert got[2]["text"] == f"{clean}\n{clean}" and got[2]["n_chars"] == len(got[2]["text"])
    assert got[4]["text"] is None and got[5]["text"] == ""
    assert "fox" not in got[6]["text"] and "dog" not in got[6]["text"]


def test_each_benchmark_has_its_own_automata(spark):
    """Many benchmarks in one session: Python workers live on between them."""
    rng = random.Random(9)
    passages = [" ".join(f"p{k}x{rng.randint(0, 99)}" for _ in range(12)) for k in range(20)]
    docs = spark.createDataFrame([(k, f"before {p} after") for k, p in enumerate(passages)], "doc_id long, text string").repartition(4).cache()
    for k, p in enumerate(passages):
        found = decontam.contamination(docs, spark.createDataFrame([(k, p)], "item_id long, text string")).filter("n_hit > 0").collect()
        assert [(r["doc_id"], r["items"]) for r in found] == [(k, [str(k)])]
        if k % 5 == 0:
            assert decontam.contamination(docs, spark.createDataFrame([], "item_id long, text string")).filter("n_hit > 0").count() == 0
