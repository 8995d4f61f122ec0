"""Substring dedup by sliding spans of sentences.

A text is cut into sentences, and those of ``WINDOW`` words or more into
pieces, at places that neighbouring words pick; both count as sentences.
Every run of several consecutive sentences that just reaches ``min_words``
words, counted forwards from each sentence and backwards from each, is hashed
with 128 bits.  A hash that occurs more than once keeps its first place, the
one of the smallest document and position, and sentences covered by any other
of its places go.

Texts are read twice.  The first pass counts hashes; of those that occur more
than once a Bloom filter of bounded size is made.  The second pass sends on
the places that the filter lets through, and the join by whole hashes decides:
the filter only saves rows, so a full one costs time and changes nothing.
Hashes are counted by partial aggregation, so a passage in a third of all
documents is a few rows by the time they meet, and the join is one that
adaptive execution can split.  Later places within a document are known at
once.  A document is its id and its text, so rows that share an id only are
documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import forget, materialise

#: Of any so many words in a row within a sentence, the one with the smallest hash ends a piece.
WINDOW = 12
#: Marks that end a sentence, and what may follow them within it besides white space.
MARKS, CLOSERS = ".!?。！？", "\"')]"
_MARK, _CLOSER, _WHITE, _LINE = 1, 2, 3, 4
_KIND = np.zeros(1 << 16, np.uint8)
_KIND[[c for c in range(0xFFFF) if chr(c).isspace()]] = _WHITE
_KIND[ord("\n")] = _LINE
_KIND[[ord(c) for c in MARKS]] = _MARK
_KIND[[ord(c) for c in CLOSERS]] = _CLOSER

#: Characters of texts that are worked on together; a longer text is alone.
AT_ONCE = 1 << 18
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
#: Largest Bloom filter, in bits, and the words of 64 bits, as a power of two, that come to the driver in one piece.
FILTER_BITS, _CHUNK = 1 << 27, 13


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __call__(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << (n - 1).bit_length()
            for k, base in enumerate(self.bases):
                factors = np.full(size, base & _MASK, np.uint64)
                factors[0] = 1
                self.tables[k] = np.multiply.accumulate(factors)
        return [t[:n] for t in self.tables]


_CHARS, _FIRST, _SECOND = (_Powers(m) for m in _MULTIPLIERS)


def _mixed(h: np.ndarray, multiplier: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(multiplier)
    return h ^ (h >> np.uint64(29))


def _sentence_cuts(kind: np.ndarray) -> np.ndarray:
    """Places after marks and what follows them, and after line ends and white space; ``kind``: class of each character."""
    at = np.flatnonzero(kind)
    k, j = kind[at], np.arange(len(at))
    if not len(at):
        return at
    begin = np.ones(len(at), bool)
    begin[1:] = np.diff(at) != 1
    mark, line, white = k == _MARK, k == _LINE, k >= _WHITE
    # Odd: a mark, or a line end, came in this run of such characters (after the last closer, for line ends).
    after_mark = np.maximum.accumulate(np.where(mark, 2 * j + 1, np.where(begin, 2 * j, -1))) & 1 == 1
    after_line = np.maximum.accumulate(np.where(line, 2 * j + 1, np.where(begin | (k == _CLOSER), 2 * j, -1))) & 1 == 1
    inside = after_mark | (white & after_line)
    ends = inside.copy()
    ends[:-1] &= begin[1:] | ~inside[1:] | (mark[1:] & ~mark[:-1])
    return at[ends] + 1


def _piece_ends(h: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Words whose hash is the smallest of a window that lies within one sentence."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def over(x: np.ndarray, f) -> np.ndarray:
        two = f(x[:-1], x[1:])
        four = f(two[:-2], two[2:])
        eight = f(four[:-4], four[4:])
        return f(eight[: len(x) - WINDOW + 1], four[8 : 8 + len(x) - WINDOW + 1])

    low = over(h, np.minimum)
    low[sentence[:n] != sentence[WINDOW - 1 :]] = 0
    high = over(np.concatenate([np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)]), np.maximum)
    return np.flatnonzero((high == h) & (h > 0))


class Cut:
    """Texts cut into sentences: arrays over all their sentences, in order.

    ``text``: which text; ``begin`` and ``end``: its words (of all texts);
    ``left`` and ``right``: its characters in its text.  The sentences of a
    text with words are together the whole text.
    """

    def __init__(self, texts: list[str]):
        joined = "\0".join(x.replace("İ", "i") for x in texts).lower() + "\0"
        try:
            code = np.frombuffer(joined.encode("latin-1"), np.uint8)
            kind = _KIND[:256][code]
        except UnicodeEncodeError:
            code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            kind = _KIND[np.minimum(code, 0xFFFF)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        stop = np.cumsum(sizes + 1) - 1
        start = stop - sizes
        cuts = _sentence_cuts(kind)
        white = np.flatnonzero(kind >= _WHITE)
        solid = kind < _WHITE
        solid[stop] = False
        first = np.zeros(len(code) + 1, bool)
        first[white + 1] = first[start] = first[cuts] = True
        words = np.flatnonzero(first[:-1] & solid)
        power, inverse = _CHARS(len(code))
        v = (code.astype(np.uint64) + np.uint64(1)) * power
        v[white] = v[stop] = 0
        h = _mixed(np.add.reduceat(v, words) * inverse[words], _MULTIPLIERS[1]) if len(words) else np.zeros(0, np.uint64)
        self.hashes = h
        breaks = np.zeros(len(code) + 1, np.int64)
        breaks[cuts] = breaks[start] = 1
        sentence = np.cumsum(breaks)[words]
        opens = np.ones(len(words) + 1, bool)
        opens[1:-1] = sentence[1:] != sentence[:-1]
        opens[_piece_ends(h, sentence) + 1] = True
        self.begin = np.flatnonzero(opens[:-1])
        self.end = np.append(self.begin[1:], len(words)) if len(self.begin) else self.begin
        self.text = np.searchsorted(stop, words[self.begin], "right")
        self.first = np.searchsorted(self.text, np.arange(len(texts)))
        self.left = words[self.begin] - start[self.text]
        new = np.ones(len(self.text), bool)
        new[1:] = self.text[1:] != self.text[:-1]
        self.left[new] = 0
        self.right = np.append(self.left[1:], 0)[: len(self.left)]
        last = np.append(new[1:], True)[: len(new)]
        self.right[last] = sizes[self.text[last]]

    def runs(self, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last sentence of each run: the shortest ones from and to each sentence that are long enough, by their first."""
        n = len(self.begin)
        here = np.arange(n)
        to = np.maximum(here + min_sentences - 1, np.searchsorted(self.end, self.begin + min_words))
        ok = to < n
        ok[ok] = self.text[to[ok]] == self.text[ok]
        since = np.minimum(here - min_sentences + 1, np.searchsorted(self.begin, self.end - min_words, "right") - 1)
        back = since >= 0
        back[back] = self.text[since[back]] == self.text[back]
        back[back] = ~ok[since[back]] | (to[since[back]] != here[back])
        i, j = np.concatenate([here[ok], since[back]]), np.concatenate([to[ok], here[back]])
        order = np.argsort(i, kind="stable")
        return i[order], j[order]

    def digests(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the words of each run."""
        out = []
        for h, powers in ((self.hashes, _FIRST), (_mixed(self.hashes, _MULTIPLIERS[2]), _SECOND)):
            power, inverse = powers(len(h) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1], dtype=np.uint64)])
            a, b = self.begin[i], self.end[j]
            out.append(_mixed((total[b] - total[a]) * inverse[a], _MULTIPLIERS[0]))
        return out[0], out[1]


def places(texts: list[str], min_sentences: int, min_words: int) -> tuple[Cut, dict[str, np.ndarray]]:
    """All runs of texts: text, i, j, h1, h2, and ``again`` where the text has the run at an earlier place."""
    cut = Cut(texts)
    i, j = cut.runs(min_sentences, min_words)
    h1, h2 = cut.digests(i, j)
    text = cut.text[i]
    order = np.argsort(h1 ^ _mixed(text.astype(np.uint64) + np.uint64(1), _MULTIPLIERS[1]), kind="stable")
    a, b = order[:-1], order[1:]
    again = np.zeros(len(i), bool)
    again[b] = (text[a] == text[b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])
    return cut, {"text": text, "i": i, "j": j, "h1": h1, "h2": h2, "again": again}


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column some at once, and the row of the first; null is empty."""
    held, size, at = [], 0, 0
    for row, x in enumerate(column):
        text = x.as_py() or ""
        if held and size + len(text) > AT_ONCE:
            yield at, held
            held, size, at = [], 0, row
        held.append(text)
        size += len(text)
    if held:
        yield at, held


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a filter of so many bits (a power of two)."""
    return h & np.uint64(bits - 1), (h >> np.uint64(33)) & np.uint64(bits - 1)


def _filter(repeated: DataFrame, most_bits: int) -> np.ndarray:
    """A Bloom filter over the column h1, put together by tasks; what comes to the driver is no larger than the filter."""
    n = repeated.count()
    bits = min(most_bits, 1 << max(10, (8 * n - 1).bit_length() if n else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits >> 6, np.uint64)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(mine, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        slot = np.flatnonzero(mine)
        for k in range(0, len(slot), 1 << 16):
            s = slot[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(mine[s].view(np.int64))], ["slot", "bits"])

    def pack(key, t):
        out = np.zeros(1 << _CHUNK, np.int64)
        out[t["slot"].to_numpy() & ((1 << _CHUNK) - 1)] = t["bits"].to_numpy()
        return pa.table({"chunk": [key[0].as_py()], "bits": pa.array([out.tobytes()], pa.binary())})

    slots = repeated.select("h1").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(max(1 << _CHUNK, bits >> 6), np.uint64)
    for r in slots.groupBy(F.shiftright("slot", _CHUNK).alias("chunk")).applyInArrow(pack, "chunk long, bits binary").toLocalIterator():
        out[r["chunk"] << _CHUNK : (r["chunk"] + 1) << _CHUNK] = np.frombuffer(r["bits"], np.uint64)
    return out[: bits >> 6]


def _held(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets through."""
    out = np.ones(len(h), bool)
    for at in _bits(h, len(sieve) << 6):
        out &= (sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id (the largest long for none), part (a hash of the text), doc_id and text."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("part"), "doc_id", "text")


def covered(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 20, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Rows (id, part, spans): runs of sentences that have an earlier place; each a struct (i, j, a, b), of sentences and characters, ends exclusive."""
    src = _documents(docs, id_col, text_col).filter("text is not null").select("id", "part", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                _, p = places(texts, min_sentences, min_words)
                yield pa.RecordBatch.from_arrays([pa.array(p["h1"][~p["again"]].view(np.int64))], ["h1"])

    hashes = src.select("text").mapInArrow(count, "h1 long")
    repeated = materialise(hashes.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select("h1"), "spans-repeated")
    sieve = docs.sparkSession.sparkContext.broadcast(_filter(repeated, filter_bits))
    forget(repeated)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, texts in _slices(batch.column(2)):
                cut, p = places(texts, min_sentences, min_words)
                keep = np.flatnonzero(p["again"] | _held(sieve.value, p["h1"]))
                i, j, text = p["i"][keep], p["j"][keep], p["text"][keep]
                base = cut.first[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        *map(pa.array, (ids[at + text], parts[at + text])),
                        *(pa.array(x.astype(np.int32)) for x in (i - base, j + 1 - base, cut.left[i], cut.right[j])),
                        *map(pa.array, (p["h1"][keep].view(np.int64), p["h2"][keep].view(np.int64), p["again"][keep])),
                    ],
                    ["id", "part", "i", "j", "a", "b", "h1", "h2", "again"],
                )

    found = materialise(src.mapInArrow(find, "id long, part long, i int, j int, a int, b int, h1 long, h2 long, again boolean"), "spans-found")
    key = F.struct("id", "part")
    first = found.filter("not again").groupBy("h1", "h2").agg(F.min(key).alias("kept"), F.max(key).alias("other")).filter("kept <> other").select("h1", "h2", "kept")
    later = found.filter("not again").join(first, ["h1", "h2"]).filter(key != F.col("kept"))
    gone = later.select("id", "part", "i", "j", "a", "b").unionByName(found.filter("again").select("id", "part", "i", "j", "a", "b"))
    # Rows that repeat a document found each of its runs again; sets, of tasks and then of all, have each once.
    return gone.groupBy("id", "part").agg(F.collect_set(F.struct("i", "j", "a", "b")).alias("spans"))


def _merged(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each list put together where they meet: list, first and last character, and how many sentences; in order."""
    sizes = np.diff(spans.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    i, j, a, b = (c.to_numpy().astype(np.int64) for c in spans.flatten().flatten())
    order = np.lexsort((i, row))
    row, i, j, a, b = (x[order] for x in (row, i, j, a, b))
    wide = np.int64(1) << 32
    far, right = (np.maximum.accumulate(x + row * wide) - row * wide for x in (j, b))
    begin = np.ones(len(row), bool)
    begin[1:] = (row[1:] != row[:-1]) | (i[1:] > far[:-1])
    begin = np.flatnonzero(begin)
    last = np.append(begin[1:], len(row))[: len(begin)] - 1
    return row[begin], a[begin], right[last], far[last] - i[begin]


def dedup_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 20, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Rows (doc_id, text, n_removed), one for each row of ``docs``.

    ``text`` is without the sentences that a repeated span covers, of which
    there are ``n_removed``; what is left is as it was, character by
    character.  A span has ``min_sentences`` sentences or more, and as many
    as it takes to have ``min_words`` words; with 0 every run of
    ``min_sentences`` sentences is one.  Null, empty and wordless texts have
    no sentences and stay.  Rows of one id with different texts are documents
    of their own, in the order of a hash of the text; rows that repeat both
    are one document, none the other's copy.  A null id comes last in order.
    Other columns are not looked at.
    """
    gone = covered(docs, id_col=id_col, text_col=text_col, min_sentences=min_sentences, min_words=min_words, filter_bits=filter_bits)
    gone = gone.select(F.col("id").alias("gone_id"), F.col("part").alias("gone_part"), "spans")
    src = _documents(docs, id_col, text_col)
    both = src.join(gone.hint("shuffle_hash"), (F.col("id") == F.col("gone_id")) & (F.col("part") == F.col("gone_part")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text, spans = batch.columns
            mask = spans.is_valid()
            old = text.filter(mask).to_pylist()
            kept, at, count = [[] for _ in old], [0] * len(old), np.zeros(len(old), np.int64)
            row, left, right, sentences = _merged(spans.filter(mask))
            np.add.at(count, row, sentences)
            for k, a, b in zip(row.tolist(), left.tolist(), right.tolist()):
                kept[k].append(old[k][at[k] : a])
                at[k] = b
            new = ["".join([*parts, x[end:]]) for parts, x, end in zip(kept, old, at)]
            text = pc.replace_with_mask(text, mask, pa.array(new, text.type))
            n = pc.replace_with_mask(pa.array(np.zeros(len(doc), np.int64)), mask, pa.array(count))
            yield pa.RecordBatch.from_arrays([doc, text, n], ["doc_id", "text", "n_removed"])

    return both.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string, n_removed long")
