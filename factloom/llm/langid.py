"""Language identification by fusing evidence as a Bayesian would.

Four sources are combined for each document: the text under byte-trigram
models, the declared language (markup or metadata), the suffix of its
address, and how the other documents of its host read.  Host priors are
smoothed in a hierarchy (all documents, suffix, host) whose counts come from
grouped aggregation, with partial sums before any exchange, so a host with a
third of all rows is a few rows by then.

Texts are scored once.  What is written is a short row for each document: its
key, its log-likelihoods and what else speaks for a language.  Counts are
aggregated from those rows, and only those rows meet the priors of their host,
in a join that adaptive execution can split; no text is ever shuffled by host.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import materialise

BUCKETS = 1 << 15
UNKNOWN = "und"

#: Languages that country suffixes speak for (fixed values).
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl"}

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of a text's letters; none without letters."""
    words = text.encode("utf-8", "replace").translate(_LETTERS).split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


class Model:
    """Trigram models of some languages, and a flat one for what is none of them."""

    def __init__(self, languages: list[str], counts: np.ndarray, cap: float = 60.0):
        self.languages = [*languages, UNKNOWN]
        share = (counts + 1e-9) / (counts + 1e-9).sum(axis=1, keepdims=True)
        flat = np.full((1, BUCKETS), 1.0 / BUCKETS)
        self.logs = np.ascontiguousarray(np.log(np.concatenate([0.9 * share + 0.1 * flat, flat])).T.astype(np.float32))
        self.cap = cap

    def score(self, text: str | None) -> np.ndarray | None:
        """Log-likelihoods of each language; neighbouring trigrams overlap, so long texts count as ``cap`` at most."""
        g = grams(text)
        if not len(g):
            return None
        total = np.zeros(len(self.languages))
        for i in range(0, len(g), 1 << 16):
            total += self.logs[g[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return total / len(g) * (len(g) * self.cap / (len(g) + self.cap))


def declared_code(declared: Column) -> Column:
    """The primary subtag of a declared language, in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(declared), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit(""))


def html_language(html: Column) -> Column:
    """The language that a page's html element declares."""
    return F.nullif(F.regexp_extract(html, r"""(?is)<html[^>]*?\slang\s*=\s*["']?([A-Za-z_-]+)""", 1), F.lit(""))


def train(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, train_rows: int = 4000, seed: int = 7) -> Model:
    """Trigram models of labelled rows, one for every language that any row declares.

    Of each language about ``train_rows`` rows are taken, by a hash of the id,
    with their whole texts; all rows of a language that has no more.  Rows
    without a text or without a declared language (of two or three letters)
    are left out, repeated ones count each; without any, no language is known.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), declared_code(F.col(lang_col)).alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}  # codes of two or three letters: a bounded number
    languages = sorted(sizes)
    shares = docs.sparkSession.createDataFrame([(x, -(-1_000_000_000 * train_rows // max(train_rows, n))) for x, n in sizes.items()], "lang string, share long")
    part = src.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000_000)) < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k, found = place[lang], np.bincount(grams(text), minlength=BUCKETS)
                counts[k] = counts[k] + found if k in counts else found
        for lang, mine in counts.items():
            gram = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang)), pa.array(gram), pa.array(mine[gram])], ["lang", "gram", "n"])

    table = np.zeros((len(languages), BUCKETS))
    found = part.select("text", "lang").mapInArrow(run, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for r in found.collect():  # at most languages times buckets
        table[r["lang"], r["gram"]] = r["n"]
    return Model(languages, table)


def _argmax(scores: np.ndarray) -> tuple[int, float, float]:
    """The best, its posterior, and that of any of the languages (all but the last)."""
    p = np.exp(scores - scores.max())
    p /= p.sum()
    return int(p.argmax()), float(p.max()), float(p[:-1].sum())


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    model: Model | None = None,
    train_lang_col: str = "lang",
    train_rows: int = 4000,
    host_weight: float = 20.0,
    suffix_weight: float = 50.0,
    min_posterior: float = 0.6,
    keep_columns: bool = False,
) -> DataFrame:
    """Rows (doc_id, lang, posterior, accepted), one for each row of ``docs``.

    ``declared``, ``host`` and ``suffix`` are columns of ``docs``; a missing or
    null one is no evidence.  ``lang`` is the language with the largest
    posterior, or ``und``: for a null or empty text, one without letters, and
    one that fits no language.  ``accepted``: the text is in some known
    language with a posterior of ``min_posterior`` or more, be it in which of
    them; a text in two languages is accepted.  Repeated rows each get a row.
    With ``keep_columns`` the result is instead the accepted rows of ``docs``,
    with their own columns only.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col, lang_col=train_lang_col, train_rows=train_rows)
    known = model.languages[:-1]
    none = F.lit(None).cast("string")
    code = declared_code(declared) if declared is not None else none
    said = F.when(code.isNull(), None).when(code.isin(*known), code).otherwise("other") if known else none
    marks = [said.alias("said"), (none if host is None else host.cast("string")).alias("host"), (none if suffix is None else F.lower(suffix)).alias("suffix")]
    # Rows that agree in all of this are judged alike, so it names a row well enough.
    part = F.xxhash64(F.col(text_col), *marks)
    scored = materialise(_scored(docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), *marks), model), "langid-scored")

    # Counts of what texts clearly are, by declared language, and by host and suffix.
    counted = materialise(scored.filter("best is not null").groupBy("host", "suffix", "said", "best").agg(F.count("*").alias("n")), "langid-counts")
    confusion = np.full((len(known), len(known) + 1), 0.5)
    column = {x: i for i, x in enumerate([*known, "other"])}
    for r in counted.filter("said is not null").groupBy("said", "best").agg(F.sum("n")).collect():  # languages squared at most
        confusion[r[1], column[r[0]]] += r[2]
    every = np.full(len(known), 1.0)
    for r in counted.groupBy("best").agg(F.sum("n")).collect():
        every[r[0]] += r[1]

    # Counts of each language, as pairs: a host has few of the languages.
    pairs = F.collect_list(F.array("best", "n"))
    by_suffix = counted.filter("suffix is not null").groupBy("suffix", F.col("best").cast("long").alias("best")).agg(F.sum("n").alias("n")).groupBy("suffix").agg(pairs.alias("suffix_n"))
    by_host = (
        counted.filter("host is not null").groupBy("host", F.col("best").cast("long").alias("best")).agg(F.max("suffix").alias("suffix"), F.sum("n").alias("n"))
        .groupBy("host").agg(F.max("suffix").alias("suffix"), pairs.alias("host_n"))
    )
    priors = by_host.join(by_suffix, "suffix", "left").select(F.col("host").alias("prior_host"), "host_n", "suffix_n")
    fusion = Fusion(known, confusion, every, host_weight, suffix_weight)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, part, *evidence = batch.columns
            found = [fusion.judge(*e) for e in zip(*(c.to_pylist() for c in evidence))]
            ok = pa.array([x != UNKNOWN and some >= min_posterior for x, _, some in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([doc, part, pa.array([x for x, _, _ in found], pa.string()), pa.array([round(p, 6) for _, p, _ in found], pa.float64()), ok], ["doc_id", "part", "lang", "posterior", "accepted"])

    rows = scored.join(priors, F.col("host") == F.col("prior_host"), "left").select("doc_id", "part", "logs", "said", "suffix", "host_n", "suffix_n")
    judged = rows.mapInArrow(judge, "doc_id long, part long, lang string, posterior double, accepted boolean")
    if not keep_columns:
        return judged.drop("part")
    # What is left out is the lesser part; Spark broadcasts it only if its size, known since it is written, permits.
    out = materialise(judged.filter("not accepted").select(F.col("doc_id").alias("the id left out"), F.col("part").alias("the part left out")).distinct(), "langid-rejected")
    return docs.join(out, F.col(id_col).cast("long").eqNullSafe(F.col("the id left out")) & (part == F.col("the part left out")), "left_anti")


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, part, said, host, suffix, best, logs): log-likelihoods of each text, and the language that it clearly is."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # buckets times languages: a bounded size
    unknown = len(model.languages) - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            best, logs = [], []
            for text in batch.column(0):
                s = m.score(text.as_py())
                k, p, _ = (unknown, 0.0, 0.0) if s is None else _argmax(s)
                best.append(k if k < unknown and p >= 0.9 else None)
                logs.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(best, pa.int32()), pa.array(logs, pa.list_(pa.float64()))], ["doc_id", "part", "said", "host", "suffix", "best", "logs"])

    return rows.mapInArrow(read, "doc_id long, part long, said string, host string, suffix string, best int, logs array<double>")


class Fusion:
    """Posteriors from log-likelihoods, declared languages and smoothed priors.

    ``confusion``: how often each declared language (a column, the last for
    all others) goes with each language that texts clearly are; ``every``: how
    often each is.
    """

    def __init__(self, known: list[str], confusion: np.ndarray, every: np.ndarray, host_weight: float, suffix_weight: float):
        self.known, self.every = known, every / max(every.sum(), 1.0)
        self.host_weight, self.suffix_weight = host_weight, suffix_weight
        self.column = {x: i for i, x in enumerate([*known, "other"])}
        if known:
            of_each = confusion / confusion.sum(axis=1, keepdims=True)
            of_all = confusion.sum(axis=0, keepdims=True) / confusion.sum()
            self.said_log = np.log(np.concatenate([of_each, of_all]))

    def prior(self, suffix: str | None, host_n: list | None, suffix_n: list | None) -> np.ndarray:
        """Share of each language at a host: all documents, then those of its suffix, then its own."""

        def dense(found: list | None) -> np.ndarray:
            out = np.zeros(len(self.known))
            for k, n in found or ():
                out[k] = n
            return out

        at = dense(suffix_n)
        if SUFFIX_LANGUAGE.get(suffix) in self.known:
            at[self.known.index(SUFFIX_LANGUAGE[suffix])] += self.suffix_weight / 2
        prior = (at + self.suffix_weight * self.every) / (at.sum() + self.suffix_weight)
        own = dense(host_n)
        return (own + self.host_weight * prior) / (own.sum() + self.host_weight)

    def judge(self, logs: list | None, said: str | None, suffix: str | None, host_n: list | None, suffix_n: list | None) -> tuple[str, float, float]:
        """The language of the largest posterior, its posterior, and that of all known languages together."""
        if logs is None:
            return UNKNOWN, 0.0, 0.0
        s = np.array(logs) + np.log(np.append(self.prior(suffix, host_n, suffix_n) * 0.99, 0.01 if self.known else 1.0))
        if said is not None:
            s = s + self.said_log[:, self.column[said]]
        k, p, some = _argmax(s)
        return [*self.known, UNKNOWN][k], p, some
