"""Collocations: phrases of two to four words, counted through minimal perfect hashes.

Texts are read three times, by tasks that hand on sums and keys, never texts.

1. Words are counted.  A word stands as a 64-bit hash of its language and its
   bytes until it has a number; that no two words of the corpus share one is
   checked, and another seed is taken where two do.  The frequent words get a
   minimal perfect hash with stored keys, and a word's slot is its number.
2. Pairs of frequent words are counted, then phrases of three and four words
   whose pairs are all frequent.  This is Apriori-safe: no frequent phrase is
   left out.  A task counts what it has in blocks of ``BLOCK`` words, and hands
   that on packed, in ranges of hashes of which there are as many as the corpus
   has ``ROUND`` words, so a range stays as small however large the corpus is.
3. In a range, phrases both of whose bucket counters reach the least count are
   candidates.  Those get a minimal perfect hash, whose slots hold the numbers
   of the words themselves; counts are added by ``bincount`` over its slots.
4. Counts of the parts of each cut come by joins, length by length: a phrase
   takes those of its beginnings from the phrase without its last word, and
   those of its ends from the phrase without its first.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm._shared import forget, materialise, ship

#: Longest phrase, in words.
LONGEST = 4
#: Most bits that mark the frequent pairs, as a power of two, and bytes in one piece of them.  Fewer than about eight for each
#: pair let more infrequent phrases through, which cost time and change nothing.
BUCKETS, PIECE = 27, 1 << 18
#: Words of the corpus for each range of phrases, whose task takes about 100 bytes for each, and words that a task counts at once.
ROUND, BLOCK = 1_000_000, 1_500_000
#: Partial arrays that one task adds up.
FAN_IN = 32
#: Bytes of text that are looked at together; a longer text is alone.
AT_ONCE = 1 << 20
#: Different words that a task holds before it hands them on.
HELD = 300_000
#: Bytes of texts as they are, A-Z as a-z, tabs as blanks, and all that ends a piece as a full stop (fixed values).
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TEXT = bytes(46 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
KEYS = [f"w{k}" for k in range(LONGEST)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def phrase_hash(keys: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """One hash for each phrase, from the hashes of its words in order."""
    h = _mixed(keys[0] + np.uint64(1 + salt))
    for k in keys[1:]:
        h = _mixed(h * np.uint64(_MIX[0]) + k)
    return h


class PerfectHash:
    """Slots 0..n-1 of n distinct hashes, with the words' hashes that each slot stores.

    Levels of bits: a hash that falls alone on a bit of a level owns it, the
    others go on to the next; its slot is the number of bits before its own.
    ``slots`` of what isn't a key is -1, which the stored keys decide.
    """

    def __init__(self, keys: np.ndarray, load: float = 2.0):
        """``keys``: rows of the hashes of up to four words, zero where there are fewer; rows are distinct."""
        self.levels, self.n, self.salt = [], len(keys), 0
        while len(np.unique(hashes := self.hashes(keys))) < len(keys):
            self.salt += 1
            if self.salt > 99:
                raise ValueError("rows of keys are not distinct")
        rest = hashes
        while len(rest):
            size = -(-max(64, int(load * len(rest))) // 64) * 64
            at = self._at(rest, len(self.levels), size)
            once = np.bincount(at, minlength=size) == 1
            before = np.concatenate([[0], np.cumsum(once.reshape(-1, 64).sum(1))[:-1]]) + sum(x[3] for x in self.levels)
            self.levels.append((size, np.packbits(once, bitorder="little").view(np.uint64), before.astype(np.int32), int(once.sum())))
            rest = rest[~once[at]]
        self.keys = np.zeros_like(keys)
        self.keys[self._slots(hashes)] = keys

    def hashes(self, keys: np.ndarray) -> np.ndarray:
        """Hashes of rows of keys, each by as many words as it has."""
        out = np.zeros(len(keys), np.uint64)
        size = (keys != 0).sum(1)
        for k in range(1, keys.shape[1] + 1):
            out[size == k] = phrase_hash(list(keys[size == k, :k].T), self.salt)
        return out

    @staticmethod
    def _at(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mixed(hashes + np.uint64((level * _MIX[0]) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        slots, rest = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (size, bits, before, _) in enumerate(self.levels):
            if not len(rest):
                break
            at = self._at(hashes[rest], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            own = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slots[rest[own]] = (before[at >> 6] + below)[own]
            rest = rest[~own]
        return slots

    def slots(self, keys: list[np.ndarray]) -> np.ndarray:
        """The slot of each phrase, or -1 of one that isn't a key."""
        if not self.n:
            return np.full(len(keys[0]), -1, np.int64)
        slots = self._slots(phrase_hash(keys, self.salt))
        same = slots >= 0
        for c in range(self.keys.shape[1]):
            stored = self.keys[slots, c]
            same &= stored == (keys[c] if c < len(keys) else 0)
        return np.where(same, slots, -1)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Words of some texts of a language at once; a full stop is where a piece ends."""
    waiting, sizes = defaultdict(list), Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_py().translate(_TEXT)
            waiting[lang].append(data)
            sizes[lang] += len(data) + 1
            if sizes[lang] >= AT_ONCE or sum(sizes.values()) >= 4 * AT_ONCE:
                most = max(sizes, key=sizes.get)
                yield most, _words(waiting.pop(most))
                del sizes[most]
    for lang, texts in waiting.items():
        yield lang, _words(texts)


def _words(texts: list[bytes]) -> list[bytes]:
    # Only blanks are left of what ``split`` takes for white space.
    return b".".join(texts).replace(b".", b" . ").split()


class _Hashes(dict):
    """Hashes of words of one language; a full stop is 0, and nothing else is."""

    def __init__(self, lang: str, seed: int):
        super().__init__({b".": 0})
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed) or 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > HELD:
            self.clear()
            self[b"."] = 0
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _hashed(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    made: dict[str, _Hashes] = {}
    for lang, words in _texts(batches):
        if lang not in made:
            made = {} if len(made) >= 32 else made
            made[lang] = _Hashes(lang, seed)
        yield lang, words, made[lang].of(words)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """Rows (h, lang, word, n) of all words; ``h`` is the hash that stands for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: defaultdict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            hs, langs, words, ns = [], [], [], []
            for lang, c in counts.items():
                c.pop(b".", None)
                hs.append(_Hashes(lang, seed).of(list(c)))
                langs += [lang] * len(c)
                words += c.keys()
                ns += c.values()
            counts.clear()
            h = np.concatenate([np.zeros(0, np.uint64), *hs]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(ns, pa.int64())], ["h", "lang", "word", "n"])

        for lang, words in _texts(batches):
            counts[lang].update(words)
            if sum(map(len, counts.values())) > HELD:
                yield out()
        yield out()

    # All rows of a hash meet once; both sums and the check for words that share one need no other shuffle.
    found = _rows(docs).mapInArrow(run, "h long, lang string, word binary, n long").repartition("h")
    return found.groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def _words_of(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """Frequent words, sums of all words of each language, the seed under which no two words share a hash, and all words as written."""
    for seed in range(1, 100):
        words = materialise(word_counts(docs, seed), "phrases-words")
        if words.groupBy("h").count().filter("count > 1").isEmpty():
            totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
            return words.filter(F.col("n") >= least), materialise(totals, "phrases-totals"), seed, words
        forget(words)
    raise ValueError("no seed keeps words apart")


def _numbered(words: DataFrame) -> tuple[PerfectHash, DataFrame]:
    """The minimal perfect hash of frequent words, on the driver, and their rows with numbers (id, lang, word, n) from 1."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().tobytes()], pa.binary())], ["data"])

    hashes = [np.frombuffer(bytes(r["data"]), np.uint64) for r in words.select("h").mapInArrow(pack, "data binary").collect()]
    table = PerfectHash(np.concatenate([np.zeros(0, np.uint64), *hashes])[:, None])
    held = words.sparkSession.sparkContext.broadcast(table)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = held.value.slots([batch.column(0).to_numpy().view(np.uint64)]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *batch.columns[1:]], ["id", "lang", "word", "n"])

    out = materialise(words.select("h", "lang", "word", "n").mapInArrow(number, "id int, lang string, word binary, n long"), "phrases-frequent")
    held.unpersist()
    return table, out


def _or_tree(arrays: DataFrame, parts: int, size: int) -> np.ndarray:
    """Packed pieces of bits of all parts, joined ``FAN_IN`` at most in one task at a time; the driver gets one array of a bounded size."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in rows["data"]])
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "part": rows["part"].iloc[:1] // FAN_IN, "data": [zlib.compress(bits.tobytes(), 1)]})

    while parts > 1:
        arrays = arrays.groupBy("piece", (F.col("part") / FAN_IN).cast("int")).applyInPandas(join, "piece int, part int, data binary")
        parts = -(-parts // FAN_IN)
    out = np.zeros(size, np.uint8)
    for r in arrays.toLocalIterator():
        some = np.frombuffer(zlib.decompress(bytes(r["data"])), np.uint8)
        out[r["piece"] * PIECE : r["piece"] * PIECE + len(some)] = some
    return out


def _two(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of each hash, one in each half; ``size`` is a power of two."""
    mask = np.uint64(size // 2 - 1)
    return (hashes & mask).astype(np.int64), size // 2 + ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _bits(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether both buckets of each hash are marked, of which there are eight in a byte."""
    first, second = _two(hashes, 8 * len(bits))
    return (bits[first >> 3] >> (first & 7).astype(np.uint8)) & (bits[second >> 3] >> (second & 7).astype(np.uint8)) & 1 == 1


def _hash_of(keys: np.ndarray) -> np.ndarray:
    """Hashes of rows of numbers of words."""
    return phrase_hash([c.astype(np.uint64) for c in keys.T])


def _marked(pairs: DataFrame) -> np.ndarray:
    """Bits of which each frequent pair marks two; others share both seldom, unless there are too many for 2^``BUCKETS``."""
    size = 1 << min(BUCKETS, max(12, (16 * pairs.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, part = np.zeros(size // 8, np.uint8), TaskContext.get().partitionId()
        for batch in batches:
            for at in _two(_hash_of(np.stack([c.to_numpy() for c in batch.columns], 1)), size):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for piece, begin in enumerate(range(0, len(bits), PIECE)):
            if (some := bits[begin : begin + PIECE]).any():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], ["piece", "part", "data"])

    written = materialise(pairs.select("w0", "w1").mapInArrow(mark, "piece int, part int, data binary"), "phrases-bits")
    bits = _or_tree(written, (written.agg(F.max("part")).first()[0] or 0) + 1, size // 8)
    forget(written)
    return bits


def _blocks(batches: Iterator[pa.RecordBatch], seed: int, table: PerfectHash, most: int) -> Iterator[np.ndarray]:
    """Numbers of words of about ``most`` words at once; 0 is an infrequent word and where a piece ends."""
    some, n = [], 0
    for _, _, h in _hashed(batches, seed):
        ids = np.zeros(len(h) + 1, np.int64)
        ids[:-1] = table.slots([h]) + 1
        some.append(ids)
        n += len(ids)
        if n >= most:
            yield np.concatenate(some)
            some, n = [], 0
    if some:
        yield np.concatenate(some)


def _pairs(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (w0, w1, count) of a block's pairs of frequent words."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    pairs, n = np.unique(ids[at] << 32 | ids[at + 1], return_counts=True)
    yield np.stack([pairs >> 32, pairs & 0xFFFFFFFF, n], 1).astype(np.uint32)


def _longer(ids: np.ndarray, marks: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (w0, w1, w2, count), then (w0, .., w3, count), of a block's phrases whose pairs are all marked."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    at = at[_bits(_hash_of(np.stack([ids[at], ids[at + 1]], 1)), marks)]
    pairs, number = np.unique(ids[at] << 32 | ids[at + 1], return_inverse=True)
    own = np.full(len(ids) + 2, -1, np.int64)  # the number of the pair that begins at a place, within this block
    own[at] = number
    at = at[own[at + 1] >= 0]
    three, n = np.unique(own[at] << 32 | ids[at + 2], return_counts=True)
    first = pairs[three >> 32]
    yield np.stack([first >> 32, first & 0xFFFFFFFF, three & 0xFFFFFFFF, n], 1).astype(np.uint32)
    at = at[own[at + 2] >= 0]
    four, n = np.unique(own[at] << 32 | own[at + 2], return_counts=True)
    first, second = pairs[four >> 32], pairs[four & 0xFFFFFFFF]
    yield np.stack([first >> 32, first & 0xFFFFFFFF, second >> 32, second & 0xFFFFFFFF, n], 1).astype(np.uint32)


def _packed(rows: np.ndarray) -> bytes:
    """Rows of 32-bit numbers byte by byte, so that high bytes, which are mostly zero, lie together."""
    return np.ascontiguousarray(rows).view(np.uint8).T.tobytes()


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4 * columns, -1).T).view(np.uint32)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array, and where each begins and ends."""
    begin = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
    return x[begin], begin, np.append(begin[1:], len(x)) if len(x) else begin


def range_counts(rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of one range that occur often enough, and how often, from rows of numbers of words with a count at the end.

    Two bucket counters choose candidates, and a minimal perfect hash with
    stored keys counts them.
    """
    keys, n = rows[:, :-1].astype(np.uint64), rows[:, -1]
    hashes, size = phrase_hash(list(keys.T)), 1 << max(6, (2 * len(rows)).bit_length())
    full = np.ones(len(rows), bool)
    for half in _two(hashes, size):
        full &= np.bincount(half, n, size)[half] >= least
    keys, n = keys[full], n[full]
    found = keys[np.lexsort(keys.T)]
    found = found[np.concatenate([np.ones(min(len(found), 1), bool), (found[1:] != found[:-1]).any(1)])]
    table = PerfectHash(found)
    if not table.n:
        return table.keys, np.zeros(0, np.int64)
    counts = np.bincount(table.slots(list(keys.T)), n, table.n).astype(np.int64)  # sums of doubles, exact below 2^53
    return table.keys[counts >= least], counts[counts >= least]


def phrase_counts(docs: DataFrame, seed: int, held, marks, least: int, ranges: int) -> DataFrame:
    """Rows (w0..w3, a) of frequent pairs, or with ``marks`` of frequent phrases of three and four words; numbers of words, 0 where there are fewer."""
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _blocks(batches, seed, held.value, block):
            for rows in _longer(ids, marks.value) if marks else _pairs(ids):
                piece = (_hash_of(rows[:, :-1]) >> np.uint64(20)) % np.uint64(ranges)
                order = np.argsort(piece, kind="stable")
                rows, (pieces, *ends) = rows[order], _runs(piece[order])
                data = pa.array([_packed(rows[b:e]) for b, e in zip(*(x.tolist() for x in ends))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(pieces.astype(np.int32)), pa.array(np.full(len(pieces), rows.shape[1] - 1, np.int32)), data], ["piece", "size", "data"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["size"].iloc[0])
        keys, counts = range_counts(np.concatenate([_unpacked(x, size + 1) for x in rows["data"]]), least)
        return pd.DataFrame({k: keys[:, i].astype(np.int32) if i < size else np.zeros(len(keys), np.int32) for i, k in enumerate(KEYS)} | {"a": counts})

    found = _rows(docs).mapInArrow(run, "piece int, size int, data binary")
    return materialise(found.groupBy("piece", "size").applyInPandas(add, ", ".join(f"{k} int" for k in KEYS) + ", a long"), "phrases-counts")


#: Columns of the counts of both parts of each cut.
_CUTS = [(f"l{k}", f"r{k}") for k in range(1, LONGEST)]


def with_parts(words: DataFrame, pairs: DataFrame, longer: DataFrame) -> DataFrame:
    """Phrases with the counts of both parts of each cut, 0 where a phrase is too short; parts of what is frequent are frequent, and so are there.

    ``first`` has the counts of a phrase's beginnings by length, up to itself,
    and ``last`` those of its ends.
    """
    shorter = words.select(F.col("id").alias("w0"), F.array("n").alias("first"), F.array("n").alias("last"))
    made = []
    for k, rows in ((2, pairs), (3, longer.filter("w3 = 0")), (4, longer.filter("w3 <> 0"))):
        ends = [shorter.select(*(F.col(KEYS[i]).alias(KEYS[i + at]) for i in range(k - 1)), F.col(part).alias(f"{part}_part")) for at, part in enumerate(("first", "last"))]
        rows = rows.join(ends[0], KEYS[: k - 1]).join(ends[1], KEYS[1:k])
        cuts = {left: F.element_at("first_part", c) if c < k else F.lit(0).cast("long") for c, (left, _) in enumerate(_CUTS, 1)}
        cuts |= {right: F.element_at("last_part", k - c) if c < k else F.lit(0).cast("long") for c, (_, right) in enumerate(_CUTS, 1)}
        whole = rows.select(*KEYS, "a", *(v.alias(c) for c, v in cuts.items()), *(F.concat(f"{x}_part", F.array("a")).alias(x) for x in ("first", "last")))
        made.append(whole if k == LONGEST else materialise(whole, "phrases-parts"))
        shorter = made[-1].select(*KEYS[:k], "first", "last")
    out = materialise(made[0].unionByName(made[1]).unionByName(made[2]).drop("first", "last"), "phrases-cuts")
    forget(*made)
    return out


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, covered: int = 80, per_round: int = ROUND) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score) of each language's ``most`` best phrases.

    ``a`` is how often a phrase occurs, ``l`` and ``r`` how often the parts of
    its lowest-scoring cut do, ``n`` how many words the language has.  Phrases
    inside a longer one that occurs ``covered`` percent as often or more are
    left out.  Null text is empty, null language ``und``; repeated rows count
    each; an empty table and texts without words give no rows; other columns
    are ignored.  Ties go by count, then by the phrase's bytes.  ``per_round``:
    words of the corpus for each range of phrases.
    """
    spark = docs.sparkSession
    ship(spark)
    words, totals, seed, all_words = _words_of(docs, least)
    ranges = 1 + int(totals.agg(F.sum("total")).first()[0] or 0) // per_round
    table, words = _numbered(words)
    forget(all_words)
    held = spark.sparkContext.broadcast(table)
    pairs = phrase_counts(docs, seed, held, None, least, ranges)
    marks = spark.sparkContext.broadcast(_marked(pairs))
    longer = phrase_counts(docs, seed, held, marks, least, ranges)
    held.unpersist()
    marks.unpersist()
    frequent = with_parts(words, pairs, longer)
    forget(pairs, longer)
    out = materialise(_best(_outside(frequent, covered), words, totals, most), "phrases")
    forget(frequent, totals, words)
    return out


def _outside(frequent: DataFrame, covered: int) -> DataFrame:
    """Phrases that no longer one holds which occurs nearly as often; the greatest count of those that hold it decides.

    That is one word longer: what holds a phrase and is longer yet has a part of
    that length which holds it too, and occurs no less often.
    """

    def part(k: int, begin: int):
        return F.struct(*(F.col(KEYS[begin + i]).alias(KEYS[i]) if i < k - 1 else F.lit(0).alias(KEYS[i]) for i in range(LONGEST)))

    inner = F.when(F.col("w3") != 0, F.array(part(4, 0), part(4, 1))).otherwise(F.array(part(3, 0), part(3, 1)))
    holders = frequent.filter(F.col("w2") != 0).select(F.explode(inner).alias("p"), "a").groupBy("p").agg(F.max("a").alias("longer"))
    holders = holders.select(*(F.col(f"p.{k}").alias(f"p{k}") for k in KEYS), "longer")
    on = [F.col(k) == F.col(f"p{k}") for k in KEYS]
    # Counts are far below 2^56, so a hundredfold is exact.
    return frequent.join(holders, on, "left").filter("longer is null or 100 * longer < %d * a" % covered)


def _best(rows: DataFrame, words: DataFrame, totals: DataFrame, most: int) -> DataFrame:
    """The lowest-scoring cut of each phrase, and the first of each language by score."""
    score = "cast(floor((cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div cast({l} + {r} as decimal(20,0))) as long)"
    cuts = [F.when(F.col(left) > 0, F.struct(F.expr(score.format(l=left, r=right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))) for k, (left, right) in enumerate(_CUTS, 1)]
    cut = rows.withColumn("c", F.least(*cuts)).join(words.select(F.col("id").alias("w0"), "lang", F.col("word").alias("word0")), "w0")
    place = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"))
    # Words are looked up only for phrases that can be among the first; those tied with the last of them too.
    first = cut.withColumn("place", F.rank().over(place)).filter(F.col("place") <= most)
    for k in range(1, LONGEST):
        first = first.join(words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    phrase = F.concat_ws(" ", *(F.col(f"word{k}").cast("string") for k in range(LONGEST)))
    out = first.join(totals, "lang").select("lang", phrase.alias("phrase"), "a", "c.l", "c.r", F.col("total").alias("n"), "c.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return out.withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
