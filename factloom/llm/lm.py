"""Scores of whole documents under a gated recurrent language model.

Counts come first: how often each word occurs in the training documents, all
of them, by a distributed aggregation.  The commonest words are the head, a
bounded table that every task has; a smaller part of it is the vocabulary of
the model, in classes of about equal (square-rooted) frequency.  Words beyond
the head are joined with their counts, so no word's count is left out.

The model is a gated recurrent unit.  Training documents are dealt by a hash to
a fixed number of groups, and within each to a fixed number of rounds.  In a
round each group trains a copy over its documents of that round, in the order
of their hash, by backpropagation truncated to a window; the copies are
averaged, weighted by their tokens, in levels of bounded fan-in, and the next
round starts from the average.  So a model doesn't depend on how its table is
partitioned, and more documents are more steps of each copy, not more copies.
Groups are what trains at once: a larger cluster can have more of them.  The output is a softmax over classes and one within
the word's class.  A word outside the vocabulary is the unknown word: by its
share of the counts if it is in the training documents, in the head or beyond
it.  All words new to training are one word with one count, as in the base
score.

A document is scored from its first word to its end: the state goes from
window to window, however long the text.  Documents run side by side in the
columns of a matrix, one after the other in each, the longest first.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import forget, materialise

#: What stands for the end of a text among words: no word has a space.
END = b" "
#: Copies of the model that are added up in one place.
FAN = 64
LN10 = float(np.log(10.0))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, with A-Z in lower case; the end is not among them."""
    return text.encode("utf-8", "replace").lower().split() if text else []


@dataclass(frozen=True)
class Shape:
    """Sizes of the model and of what a task works on at once."""

    vocabulary: int = 2048
    classes: int = 48
    hidden: int = 16
    window: int = 24
    streams: int = 256
    rate: float = 0.3
    chunk_tokens: int = 4_000_000
    seed: int = 11
    groups: int = 16
    rounds: int = 4


def classes_of(counts: np.ndarray, classes: int) -> np.ndarray:
    """First word of each class, and the end: words in order, classes of about equal root frequency."""
    share = np.cumsum(np.sqrt(np.maximum(counts, 1.0)))
    want = share[-1] * np.arange(1, classes) / classes
    cuts = np.searchsorted(share, want) + 1
    return np.unique(np.concatenate([[0], np.minimum(cuts, len(counts)), [len(counts)]]))


def _bounded(logits: np.ndarray) -> np.ndarray:
    """Logits in a range whose exponentials and their sums are finite in single precision."""
    return np.clip(logits, -60, 60, out=logits)


class Gru:
    """The model's arrays, its forward pass and its training."""

    NAMES = ("wx", "u", "b", "wc", "bc", "wo", "bo")

    def __init__(self, cuts: np.ndarray, shape: Shape):
        self.shape, self.cuts = shape, cuts
        n, h, c = int(cuts[-1]), shape.hidden, len(cuts) - 1
        rng = np.random.default_rng(shape.seed)

        def some(*size):
            return (rng.standard_normal(size) * (0.5 / np.sqrt(h))).astype(np.float32)

        self.wx, self.u, self.b = some(n, 3 * h), some(h, 3 * h), np.zeros(3 * h, np.float32)
        self.wc, self.bc, self.wo, self.bo = some(c, h), np.zeros(c, np.float32), some(n, h), np.zeros(n, np.float32)
        self.class_of = np.repeat(np.arange(c), np.diff(cuts))
        #: Sums of squared gradients, which the steps are scaled by.
        self.squares = {x: np.full(getattr(self, x).shape, 1e-4, np.float32) for x in self.NAMES}

    def learnt(self) -> np.ndarray:
        """The model and its sums of squares, which the next round goes on with."""
        return np.concatenate([self.flat(), *(self.squares[x].ravel() for x in self.NAMES)])

    def go_on(self, learnt: np.ndarray) -> None:
        size = len(self.flat())
        self.load(learnt[:size])
        for x in self.NAMES:
            a = self.squares[x]
            self.squares[x] = learnt[size : size + a.size].astype(np.float32).reshape(a.shape)
            size += a.size

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.NAMES:
            a = getattr(self, x)
            setattr(self, x, flat[at : at + a.size].astype(np.float32).reshape(a.shape))
            at += a.size

    def steps(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each row of ids, and the last; ``fresh`` marks where a text starts."""
        size = self.shape.hidden
        out = np.empty((*ids.shape, size), np.float32)
        given, restart = self.wx[ids] + self.b, fresh.any(axis=1).tolist()
        for t in range(len(ids)):
            if restart[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            x, g = given[t], h @ self.u
            zr = x[:, : 2 * size] + g[:, : 2 * size]
            np.exp(np.negative(zr, out=zr), out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :size], zr[:, size:]
            n = r * g[:, 2 * size :]
            n += x[:, 2 * size :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z, r, n, g[:, 2 * size :]))
            h = h - n
            h *= z
            h += n
            out[t] = h
        return out, h

    def log_probability(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Log-probabilities of targets; with ``grads`` also the sums of gradients and, under ``h``, those of the states."""
        logits = _bounded(states @ self.wc.T + self.bc)
        e = np.exp(logits)
        total = e @ np.ones(e.shape[1], e.dtype)
        cls = self.class_of[targets]
        row = np.arange(len(targets))
        out = logits[row, cls] - np.log(total)
        if grads is not None:
            d = e
            d /= total[:, None]
            d[row, cls] -= 1
            grads["wc"], grads["bc"], dh = d.T @ states, d.sum(axis=0), d @ self.wc
            grads["wo"], grads["bo"] = np.zeros_like(self.wo), np.zeros_like(self.bo)
        # Rows of a class side by side, so that each class works on slices.
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(len(self.cuts))).tolist()
        cuts, by_class, inside = self.cuts.tolist(), states[order], targets[order] - self.cuts[cls[order]]
        inner_logs, inner_dh = np.zeros(len(order), np.float64), None if grads is None else np.zeros_like(by_class)
        for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
            lo, hi = cuts[k], cuts[k + 1]
            if hi - lo < 2 or i == j:
                continue
            s, mine, at = by_class[i:j], row[: j - i], inside[i:j]
            e = _bounded(s @ self.wo[lo:hi].T + self.bo[lo:hi])
            picked = e[mine, at]
            np.exp(e, out=e)
            total = e @ np.ones(hi - lo, e.dtype)
            inner_logs[i:j] = picked - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[mine, at] -= 1
                grads["wo"][lo:hi], grads["bo"][lo:hi] = e.T @ s, np.ones(j - i, e.dtype) @ e
                inner_dh[i:j] = e @ self.wo[lo:hi]
        out[order] += inner_logs
        if grads is not None:
            dh[order] += inner_dh
            grads["h"] = dh
        return out

    def gradients(self, ids: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the loss over one window (truncated at its start), the last state and the loss."""
        size, kept = self.shape.hidden, []
        states, last = self.steps(ids, fresh, h, kept)
        g: dict = {}
        loss = -float(self.log_probability(states.reshape(-1, size), targets.ravel(), g).sum())
        dhs = g.pop("h").reshape(states.shape)
        before, z, r, n, gn = (np.stack(x) for x in zip(*kept))
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), gn * r * (1 - r)
        dx, dg = np.empty((*ids.shape, 3 * size), states.dtype), np.empty((*ids.shape, 3 * size), states.dtype)
        dh, back, restart = np.zeros_like(h), self.u.T.copy(), fresh.any(axis=1).tolist()
        for t in range(len(ids) - 1, -1, -1):
            dh += dhs[t]
            dn = dh * to_n[t]
            np.multiply(dh, to_z[t], out=dx[t, :, :size])
            np.multiply(dn, to_r[t], out=dx[t, :, size : 2 * size])
            dx[t, :, 2 * size :] = dn
            dg[t, :, : 2 * size] = dx[t, :, : 2 * size]
            np.multiply(dn, r[t], out=dg[t, :, 2 * size :])
            dh *= z[t]
            dh += dg[t] @ back
            if restart[t]:
                dh[fresh[t]] = 0
        du = before.reshape(-1, size).T @ dg.reshape(-1, 3 * size)
        flat_ids = ids.ravel()
        order = np.argsort(flat_ids, kind="stable")
        rows, first = np.unique(flat_ids[order], return_index=True)
        sums = np.add.reduceat(dx.reshape(-1, 3 * size)[order], first, axis=0)
        return g | {"u": du, "b": dx.sum(axis=(0, 1)), "wx": (rows, sums)}, last, loss

    def train(self, ids: np.ndarray, starts: np.ndarray, squares: dict) -> None:
        """One pass over a stream of tokens (a start symbol before each text), cut into columns; what is left over goes on from the last one."""
        n = len(ids) - 1
        columns = int(min(max(n // 2000, 8), self.shape.streams, max(n, 1)))
        length = n // columns
        if not length:
            return
        whole = length * columns
        x, y = ids[:whole].reshape(columns, length).T, ids[1 : whole + 1].reshape(columns, length).T
        h = self._learn(x, y, starts[:whole].reshape(columns, length).T, np.zeros((columns, self.shape.hidden), np.float32), columns, squares)
        if whole < n:
            self._learn(ids[whole:n, None], ids[whole + 1 : n + 1, None], starts[whole:n, None], h[-1:], columns, squares)

    def _learn(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, columns: int, squares: dict) -> np.ndarray:
        """Steps over the windows of columns of tokens; the last state."""
        scale = np.float32(1 / columns)
        for t in range(0, len(x), self.shape.window):
            w = slice(t, t + self.shape.window)
            g, h, _ = self.gradients(x[w], y[w], fresh[w], h)
            for name, d in g.items():
                at, d = d if isinstance(d, tuple) else (slice(None), d)
                d = np.clip(d * scale, -1, 1)
                squares[name][at] += d * d
                getattr(self, name)[at] -= self.shape.rate * d / np.sqrt(squares[name][at])
        return h


class Scorer:
    """What the tasks need: the head's ranks and counts, and the model."""

    def __init__(self, head: list[tuple[bytes, int]], shape: Shape, rest: int):
        """``rest``: tokens beyond the head."""
        self.shape = shape
        self.rank = {w: i for i, (w, _) in enumerate(head)}
        self.log_count = np.log10(np.array([c for _, c in head], np.float64) + 1)
        self.known = np.array([c > 0 for _, c in head])
        counts = np.array([c for _, c in head[: shape.vocabulary - 1]], np.float64)
        # The unknown word comes first: it has what the vocabulary leaves.
        self.gru = Gru(classes_of(np.concatenate([[rest + sum(c for _, c in head[shape.vocabulary - 1 :])], counts]), shape.classes), shape)
        # What an unknown word is: one of the training documents by its count, or a new one, by one.
        beyond = np.array([c for _, c in head], np.float64)
        self.unknown_count = float(beyond[shape.vocabulary - 1 :].sum() + rest + 1.0)
        self.log_share = np.log(np.maximum(beyond, 0.5) / self.unknown_count)
        self.log_share[: shape.vocabulary - 1] = 0.0
        self.log_new = -float(np.log(self.unknown_count))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, ranks: np.ndarray) -> np.ndarray:
        return np.where((ranks >= 0) & (ranks < self.shape.vocabulary - 1), ranks + 1, 0)

    def unknown(self, inside: np.ndarray, beyond: int) -> float:
        """Log-probability of a text's unknown words, given that they are unknown: ranks in the head, and so many beyond it as if new."""
        return float(self.log_share[inside].sum() + beyond * self.log_new)

    def score(self, texts: list[np.ndarray], unknown: list[float]) -> list[float]:
        """Log10-probability of each text, given its ranks (with the end) and what its unknown words have."""
        if not texts:
            return []
        lengths = [len(r) for r in texts]
        columns = max(1, min(self.shape.streams, -(-sum(lengths) // max(lengths, default=1))))
        heap = [(0, c) for c in range(columns)]
        plan: list[list[int]] = [[] for _ in range(columns)]
        for k in sorted(range(len(texts)), key=lambda k: (-lengths[k], k)):
            used, c = heapq.heappop(heap)
            plan[c].append(k)
            heapq.heappush(heap, (used + lengths[k], c))
        rows = max(used for used, _ in heap)
        x, y = np.zeros((rows, columns), np.int64), np.zeros((rows, columns), np.int64)
        fresh, owner = np.zeros((rows, columns), bool), np.full((rows, columns), -1)
        end = self.rank[END] + 1
        for c, ks in enumerate(plan):
            at = 0
            for k in ks:
                ids = self.ids(texts[k])
                n = len(ids)
                x[at, c], x[at + 1 : at + n, c], y[at : at + n, c] = end, ids[:-1], ids
                fresh[at, c] = True
                owner[at : at + n, c] = k
                at += n
        total = np.zeros(len(texts))
        h = np.zeros((columns, self.shape.hidden), np.float32)
        for t in range(0, rows, 4 * self.shape.window):  # nothing is kept to go back, so there is room for more at once
            w = slice(t, t + 4 * self.shape.window)
            live = np.flatnonzero(owner[t] >= 0)  # a column that is done stays so
            states, h_live = self.gru.steps(x[w][:, live], fresh[w][:, live], h[live])
            h[live] = h_live
            mine = owner[w][:, live]
            there = mine >= 0
            logs = self.gru.log_probability(states[there], y[w][:, live][there])
            total += np.bincount(mine[there], logs.astype(np.float64), len(texts))
        return ((total + np.array(unknown)) / LN10).tolist()


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is left out of training; one with a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def word_counts(texts: DataFrame, most_words: int = 400_000) -> DataFrame:
    """Rows (word, n) over a column of texts; each text's end counts as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(at, 256).to_pylist()
                found.update(chain.from_iterable(map(tokens, part)))
                found[END] += len(part)
                if len(found) >= most_words:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])
                    found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


BLOCK = 256


def _train(texts: DataFrame, scorer: Scorer) -> None:
    """Train the scorer's model over all rows of a table with a column ``text``; its other columns deal rows out too.

    Rows that are the same in all columns are of one group and round.
    """
    spark, shape = texts.sparkSession, scorer.shape
    kind = np.int16 if shape.vocabulary < 1 << 15 else np.int32
    first = spark.sparkContext.broadcast((scorer.rank[END], {w: r + 1 for w, r in scorer.rank.items() if r < shape.vocabulary - 1}))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, ranks = first.value
        place = ranks.get
        for batch in batches:
            words = map(tokens, (x.as_py() for x in batch.column(1)))
            ids = pa.array((np.fromiter(chain((end + 1,), map(place, w, repeat(0))), kind, len(w) + 1).tobytes() for w in words), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["h", "ids"])

    keyed = texts.select(F.xxhash64(*texts.columns).alias("h"), "text").mapInArrow(encode, "h long, ids binary")
    piece = F.pmod("h", F.lit(shape.groups * shape.rounds))
    dealt = materialise(keyed.select("h", "ids", (piece % shape.groups).cast("int").alias("part"), F.floor(piece / shape.groups).cast("int").alias("round")), "lm-encoded")
    for k in range(shape.rounds):
        _round(dealt.filter(F.col("round") == k).select("part", "h", "ids"), scorer, kind)
    forget(dealt)


def _round(dealt: DataFrame, scorer: Scorer, kind: type) -> None:
    """Train a copy for each group, all from the scorer's model, and put their average in its place."""
    shared = dealt.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        gru, part, seen, stream, size = None, None, 0, [], 0
        end = [s.rank[END] + 1]

        def learn() -> int:
            """One pass over texts, each a start symbol and its words; how many tokens those are."""
            starts = np.zeros(sum(map(len, stream)) + 1, bool)
            starts[np.cumsum([0, *map(len, stream)])] = True
            gru.train(np.concatenate([*stream, np.array(end)]).astype(np.int32), starts, gru.squares)
            return len(starts) - 1

        def copy(seen: int) -> pa.RecordBatch:
            values = gru.learnt().astype(np.float64) * seen
            values = np.pad(values, (0, -len(values) % BLOCK)).reshape(-1, BLOCK)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values))), pa.array(np.full(len(values), part, np.int64)), pa.array(np.full(len(values), seen)), pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), BLOCK).cast(pa.list_(pa.float64()))], ["block", "part", "seen", "v"]
            )

        for batch in batches:
            for group, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if group != part:
                    if part is not None:
                        yield copy(seen + (learn() if stream else 0))
                    gru, part, seen, stream, size = Gru(s.gru.cuts, s.shape), group, 0, [], 0
                    gru.go_on(s.gru.learnt())
                stream.append(np.frombuffer(ids.as_py(), kind))
                size += len(stream[-1])
                if size >= s.shape.chunk_tokens:
                    seen += learn()
                    stream, size = [], 0
        if part is not None:
            yield copy(seen + (learn() if stream else 0))

    def add(key, t):
        t = t.sort_by("part")
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, BLOCK).sum(axis=0)
        return pa.table({"block": [key[0].as_py()], "part": [key[1].as_py()], "seen": [sum(t["seen"].to_pylist())], "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    schema = "block long, part long, seen long, v array<double>"
    sorted_ = dealt.repartition(scorer.shape.groups, "part").sortWithinPartitions("part", "h").select("part", "ids")
    copies = materialise(sorted_.mapInArrow(run, schema), "lm-copies")
    written, last = copies, copies.agg(F.max("part")).first()[0]
    while last is not None:
        copies = copies.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("block", "part").applyInArrow(add, schema)
        last = last // FAN or None
    parts = copies.collect()  # as many numbers as the model has
    forget(written)
    shared.unpersist()
    if parts:
        parts.sort(key=lambda r: r["block"])
        scorer.gru.go_on(np.concatenate([np.array(r["v"]) for r in parts]) / parts[0]["seen"])


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape(), head_words: int = 131_072, head_bytes: int = 256) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    ``base_score`` is the log10-probability under counts with one added,
    ``score`` that under the model; in both all words new to training are one.  A null text is an empty one: its end
    alone.  Rows that repeat each train and each get a row; a null id trains.
    Without rows to train on the model is as it starts.  The head has at most
    ``head_words`` words of at most ``head_bytes`` bytes.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    training = src.filter("not held_out").select("doc_id", "text")
    counts = materialise(word_counts(training.select("text")), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The head: all words over a count that is chosen from a table of counts by powers, so that it has no more than its size.
    short = counts.filter((F.octet_length("word") <= head_bytes) & (F.col("word") != F.lit(END))).withColumn("power", F.floor(F.log2("n") * 8))
    cut, room = None, head_words - 1
    for r in sorted(short.groupBy("power").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        cut = r["power"]
    top = sorted(short.filter(F.col("power") >= cut).select("word", "n").collect(), key=lambda r: (-r["n"], bytes(r["word"]))) if cut is not None else []
    ends = counts.filter(F.col("word") == F.lit(END)).collect()
    head = [(END, ends[0]["n"] if ends else 0)] + [(bytes(r["word"]), r["n"]) for r in top]
    scorer = Scorer(head, shape, n - sum(c for _, c in head))
    _train(training, scorer)
    shared = spark.sparkContext.broadcast(scorer)

    kind = "key long, doc_id long, held_out boolean, n_tokens long, head_known long, head_logs double, score double, tail array<struct<word:binary,k:long>>"
    arrow = pa.schema([
        ("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_logs", pa.float64()),
        ("score", pa.float64()), ("tail", pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        end = np.array([s.rank[END]])
        rows, texts, unknown, size = [], [], [], 0

        def scored() -> Iterator[pa.RecordBatch]:
            done = s.score(texts, unknown)
            for at in range(0, len(rows), 4096):
                *cols, tails = zip(*rows[at : at + 4096])
                lists = pa.StructArray.from_arrays([pa.array(chain.from_iterable(tails), pa.binary()), pa.array(chain.from_iterable(t.values() for t in tails), pa.int64())], ["word", "k"])
                tail = pa.ListArray.from_arrays(np.cumsum([0, *map(len, tails)]).astype(np.int32), lists)
                flat = [pa.array(c, f.type) for c, f in zip((*cols, done[at : at + 4096]), arrow)]
                yield pa.RecordBatch.from_arrays([*flat, tail.cast(arrow[-1].type)], schema=arrow)

        for batch in batches:
            for key, doc, held, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                words = tokens(text.as_py())
                ranks = s.ranks(words)
                beyond = [words[i] for i in np.flatnonzero(ranks < 0).tolist()]
                tail = Counter(beyond)
                ranks = np.concatenate([ranks, end])
                inside = ranks[ranks >= 0]
                unknown.append(s.unknown(inside, len(beyond)))
                rows.append((key, doc, held, len(ranks), int(s.known[inside].sum()), float(s.log_count[inside].sum()), tail))
                texts.append(ranks.astype(np.int32))
                size += len(ranks)
                if size >= s.shape.chunk_tokens:
                    yield from scored()
                    rows, texts, unknown, size = [], [], [], 0
        yield from scored()

    keyed = src.select(F.monotonically_increasing_id().alias("key"), "doc_id", "held_out", "text")
    read = materialise(keyed.mapInArrow(run, kind), "lm-read")

    # Words beyond the head meet their counts here, and have those where a new word, which meets none, has one.
    tail = read.filter(F.size("tail") > 0).select("key", F.inline("tail"))
    beyond = counts if cut is None else counts.filter((F.octet_length("word") > head_bytes) | (F.floor(F.log2("n") * 8) < cut))
    met = tail.join(beyond, "word").groupBy("key").agg(
        F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("tail_logs"), F.sum(F.col("k") * F.log10("n")).alias("tail_counts")
    )
    whole = read.drop("tail").join(met, "key", "left")
    logs = F.col("head_logs") + F.coalesce("tail_logs", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("tail_counts", F.lit(0.0))).alias("score"),
    )
