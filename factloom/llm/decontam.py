"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are put into one suffix automaton over word ids,
with a word of its own after each item, so that no factor spans two items.
Training texts are streamed through it word by word; the automaton tracks the
longest suffix read so far that occurs in an item.  A run that reaches
``window`` words (or a whole item that has fewer) marks its words as hit.

The items are the small side.  Their total size is measured first and they
are cut into shards of at most ``shard_words`` words, so that each automaton
has a bounded size; texts pass through each shard's automaton in turn inside
the same task, and nothing is shuffled.  Items of more than ``max_words``
words come in rounds of that size, whose results are merged text by text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._shared import materialise

#: Bytes of words: digits, letters in lower case, and all of a non-ASCII character.
_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text; none for null."""
    return text.encode("utf-8", "replace").translate(_KEEP).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the windows they hold.

    ``known[v]``: for state v, pairs (length, items) of the windows that end
    wherever v is reached with at least that length.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int, int]] = []  # state, words of the item so far, item
        self.items = [i for i, w in items if w]
        sizes = []
        last, mark = 0, 0
        for k, (_, seq) in enumerate((i, w) for i, w in items if w):
            for n, word in enumerate(seq, 1):
                last = self._extend(last, self.vocab.setdefault(word, len(self.vocab)))
                ends.append((last, n, k))
            sizes.append(len(seq))
            mark -= 1
            last = self._extend(last, mark)
        self.shortest = min([window, *sizes])
        held: dict[int, dict[int, set[int]]] = {}
        for state, n, k in ends:
            size = min(window, sizes[k])
            if n < size:
                continue
            while self.len[self.link[state]] >= size:
                state = self.link[state]
            held.setdefault(state, {}).setdefault(size, set()).add(k)
        # A state also has the windows of the states on its suffix path.
        self.known: list[list[tuple[int, frozenset[int]]]] = [[] for _ in self.len]
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.known[v] = self.known[self.link[v]] + sorted((n, frozenset(x)) for n, x in held.get(v, {}).items())
        # Pairs of neighbouring words in items: a longer match passes through them only.
        n = max(1, len(self.vocab))
        pairs = {self.vocab[a] * n + self.vocab[b] for _, w in items for a, b in zip(w, w[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.pairs & ((1 << 20) - 1)] = True

    def _extend(self, last: int, c: int) -> int:
        cur = self._state(self.len[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
            return cur
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            self.link[cur] = q
            return cur
        copy = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = self.link[cur] = copy
        return cur

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words in which a whole window can lie: all words and all neighbouring pairs are the items'."""
        if self.shortest > 1:
            codes = ids[:-1] * len(self.vocab) + ids[1:]
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            ok[ok] = self.bitmap[codes[ok] & ((1 << 20) - 1)]
            if ok.any():
                some = np.flatnonzero(ok)
                at = np.minimum(np.searchsorted(self.pairs, codes[some]), len(self.pairs) - 1)
                ok[some] = self.pairs[at] == codes[some]
        else:
            ok = ids >= 0
        step = np.diff(np.concatenate([[0], ok.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + (self.shortest > 1)
        long = ends - starts >= self.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def scan(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each text: word ranges covered by windows, merged, and the items that have those windows."""
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
        if not self.items:
            return out
        # One array for all texts; a gap, which is no item's word, ends each.
        first = np.cumsum([0, *(len(x) + 1 for x in texts)])
        flat = chain.from_iterable(chain(x, _GAP) for x in texts)
        ids = np.fromiter(map(self.vocab.get, flat, repeat(-1)), np.int64, int(first[-1]))
        runs = self._runs(ids)
        for (start, end), k in zip(runs, np.searchsorted(first, [a for a, _ in runs], "right") - 1):
            spans, found = out[k]
            state = length = 0
            for i, c in enumerate(ids[start:end].tolist(), start - int(first[k]) + 1):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.len[state]
                if c in self.next[state]:
                    state, length = self.next[state][c], length + 1
                widest = 0
                for n, which in self.known[state]:
                    if n <= length:
                        widest = n
                        found |= which
                if widest:
                    begin = i - widest
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i))
        return [(spans, {self.items[k] for k in found}) for spans, found in out]


_GAP = (None,)
#: Texts scanned together.
AT_ONCE = 512


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Automata of this Python worker, of the shards of one name.
_BUILT: dict[tuple[str, int], list[Automaton]] = {}


def _automata(shards: Broadcast, window: int) -> list[Automaton]:
    """The automata of broadcast shards.

    They are kept under the name that the driver gave to the shards: workers
    live longer than a query, and addresses of broadcasts come back.
    """
    name, items = shards.value
    if (name, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, window] = [Automaton(x, window) for x in items]
    return _BUILT[name, window]


def _items(benchmark: DataFrame, id_col: str, text_col: str, shard_words: int, max_words: int) -> Iterator[tuple[Broadcast, bool]]:
    """The normalised items in shards, one broadcast of at most about ``max_words`` words after the other, and whether it is the last.

    Their size is measured first; items beyond that bound are dealt to
    several rounds by a hash, and only those of one round come to the driver.
    """
    spark = benchmark.sparkSession
    src = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null").distinct()
    rounds = max(1, -(-(src.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // (8 * max_words)))
    for k in range(rounds):
        part = src if rounds == 1 else src.filter(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == k)
        shards, room = [[]], shard_words
        for i, t in sorted(map(tuple, part.collect())):
            seq = words(t)
            if len(seq) > room and shards[-1]:
                shards.append([])
                room = shard_words
            shards[-1].append((i, seq))
            room -= len(seq)
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, shards)), k == rounds - 1


def _scan(texts: list[list[bytes]], automata: list[Automaton]) -> list[tuple[list[tuple[int, int]], set[str]]]:
    each = [x.scan(texts) for x in automata]
    if len(each) == 1:
        return each[0]
    return [(merged([s for spans, _ in r for s in spans]), set().union(*(found for _, found in r))) for r in zip(*each)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shard_words: int = 1_000_000,
    max_words: int = 8_000_000,
) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, spans, items), one for each row of ``docs``.

    ``spans``: word ranges, end exclusive, covered by windows; ``items``: the
    items that have those windows, sorted as strings.  A null or empty text
    has no words and no hits.  Items with a null id or text are left out;
    repeated items count once; without items nothing is hit.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    none = [F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items")]
    found = src.select("doc_id", "text", *none)
    for shards, last in _items(benchmark, item_col, item_text_col, shard_words, max_words):
        found = _add(found, shards, window, keep_text=not last)
        found = found if last else materialise(found, "decontam-round")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "spans", "items")


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _add(rows: DataFrame, shards: Broadcast, window: int, id_type: T.DataType = T.LongType(), keep_text: bool = True) -> DataFrame:
    """Rows (doc_id, text, spans, items) with what one round of items adds, and n_words; the text goes if no more rounds need it."""
    names = ["doc_id", *(["text"] if keep_text else []), "spans", "items", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(shards, window)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n_words, spans, items = [], [], []
            for at in range(0, batch.num_rows, AT_ONCE):
                texts = [words(x) for x in batch.column(1).slice(at, AT_ONCE).to_pylist()]
                n_words += map(len, texts)
                before = zip(batch.column(2).slice(at, AT_ONCE).to_pylist(), batch.column(3).slice(at, AT_ONCE).to_pylist())
                for (more, found), (old, held) in zip(_scan(texts, automata), before):
                    spans.append([{"start": a, "end": b} for a, b in merged([*((s["start"], s["end"]) for s in old), *more])])
                    items.append(sorted({*held, *found}))
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + keep_text], pa.array(spans, kind), pa.array(items, pa.list_(pa.string())), pa.array(n_words, pa.int64())], names)

    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = {"doc_id": id_type, "text": T.StringType(), "spans": spans_type, "items": T.ArrayType(T.StringType()), "n_words": T.LongType()}
    return rows.select("doc_id", "text", "spans", "items").mapInArrow(run, T.StructType([T.StructField(x, kinds[x]) for x in names]))


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the characters of the given word ranges."""
    raw = text.encode("utf-8", "replace")
    flat = np.frombuffer(raw.translate(_KEEP), np.uint8) != 32
    step = np.diff(np.concatenate([[0], flat.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    out.append(raw[at:])
    return b"\n".join(x for x in (p.strip() for p in out) if x).decode("utf-8", "replace")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    chars_col: str | None = "n_chars",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    max_coverage: float = 0.5,
    shard_words: int = 1_000_000,
    max_words: int = 8_000_000,
) -> DataFrame:
    """``docs`` without what occurs in the items.

    Matched spans of ``window`` words or more (or whole shorter items) are cut
    from the text, again until none is left, since a cut can bring words
    together.  A document of which more than ``max_coverage`` is hit goes
    whole.  Items with a null id or text are left out, repeated ones count
    once.  Other documents, null and empty texts stay as they are, with all
    their columns; ``chars_col`` follows the new text where it exists.
    """
    names = docs.columns
    at_text, at_chars = names.index(text_col), names.index(chars_col) if chars_col in names else None
    all_shards = [x for x, _ in _items(benchmark, item_col, item_text_col, shard_words, max_words)]
    if len(all_shards) > 1:
        return _in_rounds(docs, all_shards, text_col=text_col, chars_col=chars_col if at_chars is not None else None, window=window, max_coverage=max_coverage)
    (shards,) = all_shards

    def clean(texts: list[str | None], automata: list[Automaton]) -> list[str | None]:
        new = list(texts)
        seqs = [words(x) for x in texts]
        for k, (spans, _) in enumerate(_scan(seqs, automata)):
            if sum(b - a for a, b in spans) > max_coverage * len(seqs[k]):
                new[k] = None
            while spans and new[k] is not None:
                new[k] = cut_text(new[k], spans)
                ((spans, _),) = _scan([words(new[k])], automata)
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(shards, window)
        for batch in batches:
            old = batch.column(at_text).to_pylist()
            new = [x for at in range(0, len(old), AT_ONCE) for x in clean(old[at : at + AT_ONCE], automata)]
            cols = list(batch.columns)
            changed = [a is not b for a, b in zip(old, new)]
            cols[at_text] = pa.array(new, cols[at_text].type)
            if at_chars is not None:
                was = cols[at_chars].to_pylist()
                cols[at_chars] = pa.array([len(t) if c and t is not None else n for t, c, n in zip(new, changed, was)], cols[at_chars].type)
            keep = pa.array([t is not None or o is None for t, o in zip(new, old)])
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(keep)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def _in_rounds(docs: DataFrame, all_shards: list[Broadcast], *, text_col: str, chars_col: str | None, window: int, max_coverage: float) -> DataFrame:
    """The same for items of several rounds: each text is scanned with all of them before it is cut, until none has a match."""
    now = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    first, done = True, None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ranges = [(s["start"], s["end"]) for s in spans]
                gone = first and sum(b - a for a, b in ranges) > max_coverage * n
                out.append(None if gone else cut_text(text, ranges))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc", "text"])

    while True:
        found = now.select(F.col("doc").alias("doc_id"), "text", F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
        for shards in all_shards:
            found = materialise(_add(found, shards, window, now.schema["doc"].dataType), "decontam-round")
        clean = found.filter(F.size("spans") == 0).select(F.col("doc_id").alias("doc"), "text")
        done = clean if done is None else done.unionByName(clean)
        hit = found.filter(F.size("spans") > 0)
        if hit.isEmpty():
            break
        now = hit.select(F.col("doc_id").alias("doc"), "text", "spans", "n_words").mapInArrow(cut, T.StructType([now.schema["doc"], T.StructField("text", T.StringType())]))
        now = materialise(now.filter("text is not null"), "decontam-cut")
        first = False
    old = F.col(f"doc.`{text_col}`")
    fields = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    fields[docs.columns.index(text_col)] = F.col("text").alias(text_col)
    if chars_col:
        kind = docs.schema[chars_col].dataType
        fields[docs.columns.index(chars_col)] = F.when(old.eqNullSafe(F.col("text")), F.col(f"doc.`{chars_col}`")).otherwise(F.length("text").cast(kind)).alias(chars_col)
    return done.select(*fields)
