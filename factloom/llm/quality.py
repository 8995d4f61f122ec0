"""Quality of texts by pairwise ranking: a Bradley-Terry model over features of style.

A text of label 1 is preferred to one of label 0.  Scores are linear in the
features of a text, and the weights are those under which preferences are
likeliest: logistic loss on differences of features of pairs.  Texts are cut
by a quantile of the scores, the one that tells all labelled texts apart best;
the score that is returned is a logistic function which is ``CUT`` there.

Features are of the text alone: shares of kinds of characters and of pairs of
neighbouring ones, sizes of words and lines, and how much is repeated.  The
model is fitted on a bounded sample of labelled documents, ``per_label`` of
each label; the quantile is taken over all labelled documents, and every text
is scored in whole, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import forget, materialise, ship

#: Documents of each label that a model is fitted on, about; the pairs that it sees, and those of one step.
PER_LABEL, PAIRS, STEP = 10_000, 600_000, 512
#: Score from which on a text counts as good (fixed value).
CUT = 0.3
#: Bytes of a text that are looked at together.
PIECE = 1 << 20
#: Steps of one score in the histogram that the quantile is taken from, and its range.
STEPS, RANGE = 64, 64
_KINDS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;", b"!?", b"\"'`", b"()[]{}<>", b"|\\", b"*#~^", b"$%&@+=",
    b":/", b"-_", bytes(range(128, 256)), bytes([*range(9), 11, 12, *range(14, 32), 127]),
]
_KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _k
_N = len(_KINDS)
WIDTH = _N + _N * _N + 11


def features(data: bytes) -> np.ndarray:
    """``WIDTH`` numbers that describe the style of a text; of an empty one all are zero."""
    out = np.zeros(WIDTH)
    if not data:
        return out
    pairs, last = np.zeros(_N * _N, np.int64), None
    for begin in range(0, len(data), PIECE):
        kinds = _KIND[np.frombuffer(data, np.uint8, min(PIECE, len(data) - begin), begin)].astype(np.int64)
        pairs += np.bincount(kinds[:-1] * _N + kinds[1:], minlength=_N * _N)
        if last is not None:
            pairs[last * _N + kinds[0]] += 1
        last = kinds[-1]
    single = pairs.reshape(_N, _N).sum(1)
    single[last] += 1
    share = single / len(data)
    out[:_N] = np.sqrt(share)
    out[_N : _N + _N * _N] = np.sqrt(pairs / max(len(data) - 1, 1))
    words, lines = data.lower().split(), [x for x in data.split(b"\n") if x]
    some = share[share > 0]
    more = [np.log1p(len(data)), np.log1p(len(words)), -(some * np.log(some)).sum()]
    if words:
        sizes, different = np.fromiter(map(len, words), np.int64, len(words)), len(set(words))
        more += [different / len(words), different / len(words) ** 0.5, sizes.mean(), np.log1p(sizes.std()), np.log1p(sizes.max())]
    else:
        more += [0] * 5
    if lines:
        more += [len(set(lines)) / len(lines), np.log1p(len(data) / len(lines)), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)]
    else:
        more += [0] * 3
    out[-11:] = more
    return out


@dataclass
class Ranking:
    """Weights of centred and scaled features, the raw score of the cut, and how steep scores are there."""

    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    cut: float = 0.0
    slope: float = 1.0
    level: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -5, 5) @ self.weights

    def score(self, raw: Column) -> Column:
        """0 to 1, and ``CUT`` at the cut."""
        return 1 / (1 + F.exp(-(F.lit(self.slope) * (raw - self.cut) + float(np.log(CUT / (1 - CUT))))))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Weights by logistic loss on differences of features, over random pairs of a good and a bad row."""
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - centre) / scale, -5, 5)
    better, worse, rng = np.flatnonzero(good), np.flatnonzero(~good), np.random.default_rng(seed)
    w, first, second = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(1, pairs // STEP + 1):
        difference = z[rng.choice(better, STEP)] - z[rng.choice(worse, STEP)]
        lost = 1 / (1 + np.exp(np.clip(difference @ w, -50, 50)))
        gradient = 1e-3 * w - lost @ difference / STEP
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w -= 0.01 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Ranking(w, centre, scale)


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Rows (id, good) of ids to learn from: those whose labels agree."""
    rows = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    return rows.agg(F.min(label_col).alias("a"), F.max(label_col).alias("b")).filter("a = b").select("id", (F.col("a") == 1).alias("good"))


def _described(docs: DataFrame) -> DataFrame:
    """Rows (id, good, h, x) of the features of labelled texts; ``docs``: id, good, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t.as_py()).astype(np.float32).tobytes() for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], x], ["id", "good", "h", "x"])

    return docs.select("id", "good", F.xxhash64("text").alias("h"), F.col("text").cast("binary")).mapInArrow(run, "id long, good boolean, h long, x binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Ranking | None:
    """A ranking of documents, from labelled ones; None unless there are some of both labels.

    ``per_label`` documents of each label, about, are drawn by a hash of their
    id; of rows that repeat an id one is taken.  Only their features come to
    the driver, 1.3 KB each.
    """
    known = materialise(_labels(labels, id_col, label_col), "quality-labels")
    n = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    of_label = F.when(F.col("good"), per_label / max(n.get(True, 0), 1)).otherwise(per_label / max(n.get(False, 0), 1))
    drawn = known.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < of_label * (1 << 30))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # At most about 2 * per_label ids of eight bytes.
    found = _described(texts.join(F.broadcast(drawn), "id")).groupBy("id").agg(F.min_by("x", "h").alias("x"), F.first("good").alias("good"))
    rows = sorted(((r["id"], r["good"], bytes(r["x"])) for r in found.toLocalIterator()), key=lambda r: r[0])
    forget(known)
    good = np.array([r[1] for r in rows], bool)
    if not good.any() or good.all():
        return None
    return fit(np.stack([np.frombuffer(r[2], np.float32) for r in rows]).astype(np.float64), good)


def raw_scores(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, raw) of all texts, a null one as an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.raw(x))], ["id", "raw"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "id long, raw double")


def cut_by_quantile(scores: DataFrame, labels: DataFrame, ranking: Ranking, id_col: str = "doc_id", label_col: str = "quality") -> Ranking:
    """The ranking with its cut at the quantile of all labelled rows' scores that makes the fewest errors, and its slope there.

    ``scores``: id, raw.  Scores are counted in steps of 1/64; a cut between
    two of them lies in the middle of what is free.
    """
    at = F.floor(F.least(F.greatest("raw", F.lit(-RANGE)), F.lit(RANGE)) * STEPS)
    # Rows of one id are few after this, however often it is repeated.
    counted = scores.groupBy("id", at.alias("at")).agg(F.count("*").alias("n")).join(_labels(labels, id_col, label_col), "id")
    rows = sorted((r["at"], r["good"], r["n"]) for r in counted.groupBy("at", "good").agg(F.sum("n").alias("n")).collect())
    if not rows:
        return ranking
    steps = np.array([r[0] for r in rows], np.float64) / STEPS
    good, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float64)
    places = np.unique(np.concatenate([steps, [steps[-1] + 1 / STEPS]]))
    lost, let = np.concatenate([[0], np.cumsum(n * good)]), (n * ~good).sum() - np.concatenate([[0], np.cumsum(n * ~good)])
    below = np.searchsorted(steps, places)
    errors = lost[below] + let[below]
    best = np.flatnonzero(errors == errors.min())
    first = best[0]
    last = first
    while last + 1 < len(places) and errors[last + 1] == errors[first]:
        last += 1
    # Up to the first place the rows below it are the same, so the cut may lie anywhere since the row before.
    before = places[first - 1] + 1 / STEPS if first else places[0]
    cut = float((before + places[last]) / 2)
    ranking.level = float(n[steps < cut].sum() / n.sum())
    ranking.cut, ranking.slope = cut, _slope(steps - cut, good, n)
    return ranking


def _slope(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> float:
    """The slope of the logistic function through ``CUT`` at 0 that fits labels best, with the usual allowance for separable ones."""
    ones, zeros = (n * good).sum(), (n * ~good).sum()
    target = np.where(good, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    most = 30 / max(np.abs(x).max(), 1e-9)
    slopes = most * np.geomspace(1e-3, 1, 200)
    z = np.clip(slopes[:, None] * x + np.log(CUT / (1 - CUT)), -500, 500)
    loss = (n * (np.logaddexp(0, z) - target * z)).sum(1)
    return float(slopes[loss.argmin()])


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> DataFrame:
    """Rows (doc_id, score, predicted) of all documents; ``labels`` are those to learn from, and no part of a score.

    Labels other than 0 and 1, null ids and ids whose labels differ teach
    nothing.  Null texts are as empty ones, which have a score like any other;
    repeated rows are scored each, equal texts alike; other columns are
    ignored; an empty table gives no rows.  Unless there are labelled
    documents of both labels every score is 0.5.
    """
    ship(docs.sparkSession)
    ranking = train(docs, labels, id_col, text_col, label_col, per_label)
    if ranking is None:
        out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0.5).alias("score"))
    else:
        raw = materialise(raw_scores(docs, ranking, id_col, text_col), "quality-scores")
        ranking = cut_by_quantile(raw, labels, ranking, id_col, label_col)
        out = raw.select(F.col("id").alias("doc_id"), ranking.score(F.col("raw")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
