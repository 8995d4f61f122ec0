"""How far the vocabularies of sources lie apart, by a vocabulary automaton in two passes.

The first pass counts in how many documents of its language each term occurs,
exactly, and keeps the terms of ``least_docs`` documents or more.  The second
runs whole texts through automata of the kept terms, each between two blanks,
so a term never matches within another, and counts every occurrence by
(lang, source, term).  These counts are sparse postings; all that follows is
made of them.

A task adds its counts up before Spark does, so a source with a third of all
rows is a few rows by the time they meet.  The kept terms of one pass are at
most about ``SHARD_BYTES`` of text; more of them take more passes over the
texts, which gives the same counts.  Pairs of sources are compared in units
of some sources by some terms, so neither a language nor a source is ever in
one task.
"""

from __future__ import annotations

import uuid
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Callable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm._shared import forget, materialise, ship

#: Text of the kept terms that one pass holds, in bytes: about 400,000 terms.
SHARD_BYTES = 4 << 20
#: Rows that a task holds before it hands its counts on.
HELD = 300_000
#: Bytes of text that an automaton reads at once; a longer text is alone.
AT_ONCE = 1 << 20
#: Sources and terms of a unit of comparison.
TILE, CHUNK = 256, 512
#: Languages with kept terms whose sums are broadcast; those of more are joined like any table.
FEW_LANGS = 10_000
#: Added to each count, and what shares are multiplied by (fixed values).
PRIOR, SCALE = 5, 1_000_000_000
#: Bytes of terms as they are, A-Z as a-z, all others as blanks.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Automata of this worker, by the shard they were made for.
_BUILT: OrderedDict[str, dict] = OrderedDict()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """Rows (lang, term, docs): how many texts of a language hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, t, n) for lang, c in counts.items() for t, n in c.items()]
            counts.clear()
            langs, terms, ns = zip(*rows) if rows else ((), (), ())
            return _batch({"lang": (langs, pa.string()), "term": (terms, pa.binary()), "docs": (ns, pa.int64())})

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                counts[lang].update(set(text.as_py().translate(_TERMS).split()))
                if sum(map(len, counts.values())) > HELD:
                    yield out()
        yield out()

    found = _rows(docs).mapInArrow(run, "lang string, term binary, docs long")
    return found.groupBy("lang", F.col("term").cast("string").alias("term")).agg(F.sum("docs").alias("docs"))


def _automaton(name: str, terms: dict[str, list[str]], lang: str):
    """The automaton of a language's terms, made once in each worker; those of at most two shards are kept."""
    made = _BUILT.setdefault(name, {})
    while len(_BUILT) > 2:
        _BUILT.popitem(last=False)
    if lang not in made:
        a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, t in enumerate(terms[lang]):
            a.add_word(f" {t} ", k)
        a.make_automaton()
        made[lang] = a
    return made[lang]


def occurrences(docs: DataFrame, kept: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (lang, source, term, n) of each kept term in each source where it occurs; ``kept``: lang, term, written."""
    spark = docs.sparkSession
    total = kept.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    shards = -(-total // shard_bytes)
    parts = []
    for shard in range(shards):
        some = kept.filter(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)) == shard)
        terms: defaultdict[str, list[str]] = defaultdict(list)
        for r in some.select("lang", "term").toLocalIterator():
            terms[r[0]].append(r[1])
        held, name = spark.sparkContext.broadcast(dict(terms)), uuid.uuid4().hex
        parts.append(_rows(docs).mapInArrow(_counting(held, name), "lang string, source string, term string, n long"))
    if not parts:
        return spark.createDataFrame([], "lang string, source string, term string, n long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _counting(held, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = held.value
        counts: defaultdict[tuple, Counter] = defaultdict(Counter)
        waiting: defaultdict[tuple, list[bytes]] = defaultdict(list)
        sizes: Counter = Counter()

        def read(key: tuple) -> None:
            if texts := waiting.pop(key, None):
                text = b" ".join([b"", *texts, b""]).decode("utf-8", "surrogateescape")
                counts[key].update(map(itemgetter(1), _automaton(name, terms, key[0]).iter(text)))
                sizes[key] = 0

        def out() -> pa.RecordBatch:
            for key in list(waiting):
                read(key)
            rows = [(*key, terms[key[0]][k], n) for key, c in counts.items() for k, n in c.items()]
            counts.clear()
            langs, sources, names, ns = zip(*rows) if rows else ((), (), (), ())
            return _batch({"lang": (langs, pa.string()), "source": (sources, pa.string()), "term": (names, pa.string()), "n": (ns, pa.int64())})

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if lang in terms:
                    key = lang, source
                    waiting[key].append(text.as_py().translate(_TERMS))
                    sizes[key] += len(waiting[key][-1]) + 1
                    if sizes[key] >= AT_ONCE:
                        read(key)
            if sum(sizes.values()) >= 8 * AT_ONCE or sum(map(len, counts.values())) > HELD:
                yield out()
        yield out()

    return run


def _share(n: str, total: str, terms: str):
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), in decimals, which products of counts can't overflow."""
    return F.expr(
        f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {PRIOR} as decimal(20,0))) div cast({total} + {PRIOR} * {terms} as decimal(20,0))"
    )


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of each pair of sources of a language, and of each source's own terms.

    Part ``pair``: how far the smoothed shares of two sources lie apart, summed
    over the kept terms of the language, farthest first.  Part ``term``: the
    terms that a source has most beyond its language, ``most_terms`` at most.
    Null text, language and source are as empty ones, repeated rows count each,
    an empty table gives no rows, other columns are ignored.  A source without
    kept terms still has its pairs; a language with one source has none.  Ties
    go by the item's bytes.  Counts are exact integers throughout.
    """
    ship(docs.sparkSession)
    kept = materialise(document_frequencies(docs).filter(F.col("docs") >= least_docs).select("lang", "term"), "divergence-kept")
    posted = materialise(occurrences(docs, kept, shard_bytes), "divergence-postings")
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    near = F.broadcast if vocabulary.count() <= FEW_LANGS else lambda rows: rows
    sums = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    every = _rows(docs).select("lang", "source").distinct()
    groups = every.join(sums, ["lang", "source"], "left").join(near(vocabulary), "lang", "left").na.fill(0, ["total", "present", "v"])
    groups = groups.withColumn("none", F.when(F.col("v") > 0, _share("0", "total", "v")).otherwise(0))
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = materialise(groups, "divergence-groups")
    shares = posted.join(groups.select("lang", "source", "at", "total", "v"), ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
    out = _pairs(groups, shares, near).unionByName(_terms(posted, shares, most_terms, near))
    out = materialise(out, "divergence")
    forget(kept, posted, groups)
    return out


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value")).withColumn("rank", F.row_number().over(w))


def _terms(posted: DataFrame, shares: DataFrame, most: int, near: Callable) -> DataFrame:
    of_lang = posted.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    totals = posted.groupBy("lang").agg(F.sum("n").alias("total_lang"))
    q = of_lang.join(near(totals), "lang")
    both = shares.join(q, ["lang", "term"]).withColumn("q", _share("n_lang", "total_lang", "v")).filter("p > q")
    return _ranked(both.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "term").filter(F.col("rank") <= most)


def _pairs(groups: DataFrame, shares: DataFrame, near: Callable) -> DataFrame:
    """Pairs by units of two tiles of sources and a chunk of terms; terms that a unit doesn't have are all alike and added at the end."""
    ends = groups.groupBy("lang").agg((F.max("at") / TILE).cast("int").alias("last"), F.ceil(F.first("v") / CHUNK).cast("int").alias("chunks"))
    ends = near(ends.filter("chunks > 0"))
    own = (F.col("at") / TILE).cast("int")

    def in_units(rows: DataFrame) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
        spread = rows.select("*", own.alias("own"), other)
        return spread.withColumns({"ti": F.least("own", "other"), "tj": F.greatest("own", "other")}).drop("own", "other", "last")

    groups = groups.toDF(*groups.columns)  # columns of its own, as ``shares`` has those of the same table
    postings = in_units(shares.join(ends, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).select("lang", "term", "at", "p", "chunk", "last"))
    sources = in_units(groups.join(ends, "lang").select("lang", "at", "none", "last", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")))
    unit = ["lang", "ti", "tj", "chunk"]
    compared = postings.groupBy(*unit).cogroup(sources.groupBy(*unit)).applyInPandas(_comparing(TILE), "lang string, i int, j int, apart long, terms long")
    apart = compared.groupBy("lang", "i", "j").agg(F.sum("apart").alias("apart"), F.sum("terms").alias("terms"))
    both = apart.select("lang", F.col("i").alias("at"), F.col("j").alias("to"), "apart", "terms").unionByName(
        apart.select("lang", F.col("j").alias("at"), F.col("i").alias("to"), "apart", "terms")
    )
    left = groups.select("lang", "source", "at", "none", "v")
    right = groups.select(F.col("lang").alias("lang2"), F.col("source").alias("item"), F.col("at").alias("to"), F.col("none").alias("none2"))
    # One row for each pair of sources of a language: the result itself has them.
    wanted = left.join(right, (F.col("lang") == F.col("lang2")) & (F.col("at") != F.col("to"))).drop("lang2")
    rest = F.abs(F.col("none") - F.col("none2")) * (F.col("v") - F.coalesce("terms", F.lit(0)))
    full = wanted.join(both, ["lang", "at", "to"], "left").withColumn("value", F.coalesce("apart", F.lit(0)) + rest)
    return _ranked(full, "pair")


def _comparing(tile: int):
    """Sums of differences of each pair of a unit's sources over the terms that one of its sources has."""

    def compare(postings: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        i, j, apart, lang, terms = [], [], [], None, ()
        if len(postings):
            sources = sources.drop_duplicates("at").sort_values("at")
            lang, ti, tj = postings["lang"].iloc[0], postings["ti"].iloc[0], postings["tj"].iloc[0]
            column, terms = pd.factorize(postings["term"])
            at = sources["at"].to_numpy()
            shares = np.repeat(sources["none"].to_numpy(np.int64)[:, None], len(terms), 1)
            shares[np.searchsorted(at, postings["at"].to_numpy()), column] = postings["p"].to_numpy(np.int64)
            first, second = np.flatnonzero(at // tile == ti), np.flatnonzero(at // tile == tj)
            for k in first:
                others = second[second > k]
                i.append(np.repeat(at[k], len(others)))
                j.append(at[others])
                apart.append(np.abs(shares[others] - shares[k]).sum(1))
        none = [np.zeros(0, np.int64)]
        out = pd.DataFrame({"i": np.concatenate(none + i), "j": np.concatenate(none + j), "apart": np.concatenate(none + apart)})
        return out.assign(lang=lang, terms=len(terms))[["lang", "i", "j", "apart", "terms"]]

    return compare
