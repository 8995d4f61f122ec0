import random
import re

from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from factloom.llm import spans

END = re.compile(r"[.!?。！？]+[\s\"')\]]*|\n+\s*")


def pieces(text):
    """Character ranges of a text's sentences."""
    cut = spans.Cut([text or ""])
    return list(zip(cut.left.tolist(), cut.right.tolist()))


def by_marks(text):
    """Character ranges of sentences, by a regular expression; white space before the first word goes with it."""
    cuts = [m.end() for m in END.finditer(text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    out, begin = [], 0
    for end in cuts:
        if text[begin:end].strip():
            out.append((begin, end))
            begin = end
        elif out:
            out[-1] = (out[-1][0], end)
            begin = end
    return out


@given(st.text(alphabet="ab .!?\n\t'\")é。\x00İ", max_size=200))
def test_sentences_of_a_text(text):
    got = pieces(text)
    if text.strip():
        assert "".join(text[a:b] for a, b in got) == text
        if all(len(text[a:b].split()) < spans.WINDOW for a, b in by_marks(text)):
            assert [text[a:b].split() for a, b in got] == [text[a:b].split() for a, b in by_marks(text)]
    else:
        assert got == []


def runs(parts, least, words):
    """Pairs of first and last sentence, naively: all runs that reach so many words and have no shorter one from or to the same sentence."""
    out = set()
    for i in range(len(parts)):
        for j in range(i + least - 1, len(parts)):
            if sum(map(len, parts[i : j + 1])) >= words:
                out.add((i, j))
                break
    for j in range(len(parts)):
        for i in range(j - least + 1, -1, -1):
            if sum(map(len, parts[i : j + 1])) >= words:
                out.add((i, j))
                break
    return sorted(out)


def plain(rows, cut=pieces, least=2, words=20):
    """Texts left, by going through documents in order; rows are distinct, in the order of documents."""
    first, out = {}, {}
    for i, text in rows:
        ranges = cut(text) if text else []
        parts = [text[a:b].lower().split() for a, b in ranges]
        gone, mine = set(), []
        for a, b in runs(parts, least, words):
            key = tuple(w for p in parts[a : b + 1] for w in p)
            if key in first:
                gone.update(range(a, b + 1))
            else:
                first[key] = i
        out[i, text] = text if not gone else "".join(text[a:b] for k, (a, b) in enumerate(ranges) if k not in gone), len(gone)
    return out


PASSAGE = " ".join(f"Sentence number {k} of a passage that many have." for k in range(8))


def test_dedup(spark, docs, texts):
    rows = [(400, f"Own start one. {PASSAGE} Own end one."), (401, f"Another beginning here. {PASSAGE} And another end."), (402, PASSAGE), (403, "The same. Line. " * 30), (404, " ".join(f"w{k}" for k in range(500))), (405, "Prefix. " + " ".join(f"w{k}" for k in range(500)))]
    every = texts + rows
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in every], "doc_id long, text string, h1 int, first int").repartition(3)
    got = spans.dedup_spans(df).collect()
    assert len(got) == len(every)
    named = sorted({(i, t) for i, t in every if i is not None}, key=lambda r: r[0])
    want = plain(named)
    for r in got:
        if r["doc_id"] is not None:
            before = [t for i, t in every if i == r["doc_id"]][0]
            assert (r["text"], r["n_removed"]) == want[r["doc_id"], before]
    by = {r["doc_id"]: r for r in got}
    assert by[400]["n_removed"] == 0
    assert by[401]["text"] == "Another beginning here. And another end." and by[402]["text"] == ""
    assert len(by[405]["text"].split()) < 60  # a text without sentences is cut alike and found too
    assert by[300]["text"] is None and by[301]["text"] == "" and by[302]["text"] == " \t\n"
    # A copy of another document's text has no id: it comes last.
    assert len(next(r["text"] for r in got if r["doc_id"] is None and r["text"] != "nobody's text")) < len(texts[0][1])


def _short(rng, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))) + rng.choice([". ", "! ", "? ", ".\n", "。"])


def test_against_brute_force_without_shared_code(spark):
    """Short sentences from a small stock, so that runs repeat within and between texts; a filter that is full changes nothing."""
    rng = random.Random(8)
    stock = [_short(rng, ["one", "two", "three", "Four", "fünf", "日本"]) for _ in range(30)]
    rows = [(i, "".join(rng.choice(stock) for _ in range(rng.randint(1, 25)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least, words in ((2, 0), (2, 12), (3, 5)):
        want = plain(rows, by_marks, least, words)
        for bits in (1 << 20, 64):
            got = spans.dedup_spans(df, min_sentences=least, min_words=words, filter_bits=bits).collect()
            assert {(r["doc_id"]): (r["text"], r["n_removed"]) for r in got} == {i: want[i, t] for i, t in rows}


def test_rows_of_one_id_with_different_texts(spark):
    """What one row of an id repeats is not taken from another row of that id."""
    own = "Nothing like this elsewhere in the table. Here are words of its own only. And a third sentence that no other text has."
    rows = [(1, PASSAGE), (5, f"Before it. {PASSAGE}"), (5, own), (5, own)]
    got = spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, PASSAGE), (5, "Before it. "), (5, own), (5, own)])
    # A passage that two texts of one id share is kept once.
    got = spans.dedup_spans(spark.createDataFrame([(5, f"Alpha. {PASSAGE}"), (5, f"Beta. {PASSAGE}")], "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 8]


def test_passages_inside_long_sentences_are_found():
    """What two texts share for 51 words is mostly covered, wherever it begins and ends in their sentences."""
    rng = random.Random(2)

    def some(n, mark=""):
        return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) + (mark if rng.random() < 0.06 else "") for _ in range(n))

    for k in range(300):
        passage = some(51, "." if k % 2 else "")
        a, b = (f"{some(rng.randint(0, 70))} {passage} {some(rng.randint(0, 70))}." for _ in range(2))
        cut, p = spans.places([a, b], 2, 20)
        first = {(x, y) for x, y, t in zip(p["h1"], p["h2"], p["text"]) if t == 0}
        hit = {s for x, y, t, i, j in zip(p["h1"], p["h2"], p["text"], p["i"], p["j"]) if t == 1 and (x, y) in first for s in range(i, j + 1)}
        at = b.index(passage)
        covered = "".join(b[max(x, at) : max(min(y, at + len(passage)), at)] for n, (x, y) in enumerate(zip(cut.left, cut.right)) if n in hit)
        assert len(covered.split()) >= 51 - 2 * spans.WINDOW


def test_words_are_hashed_by_all_their_characters():
    rng = random.Random(4)
    long = "".join(rng.choices("abc", k=5000))
    other = long[:-2] + long[-1] + ("a" if long[-1] != "a" else "b")
    h = spans.Cut([f"{long} x", f"{other} x", f"  {long}\tx", "İx ix"]).hashes
    assert h[0] != h[2] and h[0] == h[4] and h[1] == h[3] and h[6] == h[7]


def test_a_document_in_a_hundred_thousand_rows(spark):
    """Rows that repeat a document, with an id or without, don't make its list of runs longer, and all have the same result."""
    rng = random.Random(12)
    own = " ".join(f"{' '.join(''.join(rng.choices('abcdefgh', k=4)) for _ in range(9))}." for _ in range(12))
    text = f"{own} {own}"  # each run comes again within it
    once = spark.createDataFrame([(7, text)], "doc_id long, text string")
    many = spark.range(100_000).selectExpr("if(id % 2 = 0, 7, null) as doc_id").withColumn("text", F.lit(text))
    sizes = [{r["n"] for r in spans.covered(df).selectExpr("size(spans) as n").collect()} for df in (once, many.filter("doc_id = 7"))]
    assert sizes[0] == sizes[1] and len(sizes[0]) == 1
    got = spans.dedup_spans(many).groupBy("doc_id", "text", "n_removed").count().collect()
    want = spans.dedup_spans(once).collect()[0]
    assert {(r["doc_id"], r["count"]) for r in got} == {(7, 50_000), (None, 50_000)}
    assert next((r["text"], r["n_removed"]) for r in got if r["doc_id"] == 7) == (want["text"], want["n_removed"]) and want["n_removed"] > 0


def test_empty(none):
    assert spans.dedup_spans(none).count() == 0
