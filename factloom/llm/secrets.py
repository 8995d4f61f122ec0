"""Secret scan: token efficiency beside three fixed patterns.

Random strings are spelt with many tokens of a byte-pair vocabulary, since
their parts were never merged.  Every run of key-like characters is encoded,
and one with few characters a token is reported, unless it is a known kind
of digest or identifier.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The patterns of base spans, and the least characters of a value (group 2), key and number.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: One of these is in every assignment, in lower case.
_NAMED = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Least characters of a run that the token test judges.
RANDOM_LEAST = 20
KINDS = ("assign", "access", "hex", "random")

#: The pattern that splits text before the merges of the rank files (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_SIZES = (32, 40, 56, 64, 96, 128)

#: Bytes of key-like characters; those of access keys and numbers are among them.
_KEY_LIKE = np.zeros(256, bool)
_KEY_LIKE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_DIGEST = re.compile(r"(?:%s)" % "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGEST_SIZES))
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words of letters, or numbers, joined by marks: names, paths and slugs.
_NAME = re.compile(r"(?:[A-Za-z][a-z]+|[A-Z]+|[0-9]+)(?:[-_/=+]+(?:[A-Za-z][a-z]+|[A-Z]+|[0-9]+))*[-_/=+]*")


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """A rank file of tiktoken's format, read on the driver and sent to all tasks; its size is that of a vocabulary."""
    with open(path, "rb") as f:
        data = f.read(64 << 20)
    if len(data) == 64 << 20:
        raise ValueError("not a vocabulary: 64 MB or more")
    return spark.sparkContext.broadcast(data)


_ENCODINGS: dict[int, object] = {}


def encoding(data: bytes):
    """The tiktoken encoding of a rank file's bytes, kept for the Python worker's life."""
    key = hash(data)
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def random_run(run: str, enc, max_ratio: float) -> bool:
    """Whether a run of key-like characters is spelt too inefficiently to be words, a digest or a name."""
    classes = sum(1 for p in ("[a-z]", "[A-Z]", "[0-9]") if re.search(p, run))
    if classes < 2 or _DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _NAME.fullmatch(run):
        return False
    return len(run) < max_ratio * len(enc.encode_ordinary(run))


def key_runs(text: str, least: int) -> list[tuple[int, int]]:
    """Code-point ranges of the longest runs of key-like characters, of ``least`` or more."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    edge = np.flatnonzero(np.diff(_KEY_LIKE[raw].view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if len(starts) and len(raw) != len(text):
        before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        starts, ends = before[starts], before[ends]
    return list(zip(starts.tolist(), ends.tolist()))


def spans_of(text: str | None, enc, max_ratio: float = 2.2) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind; null has none."""
    if not text:
        return []
    out = []
    low = text.encode("utf-8", "replace").lower()
    if any(x in low for x in _NAMED):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    # The other kinds lie within runs of key-like characters.
    for a, b in key_runs(text, min(HEX_LEAST, ACCESS_LEAST, RANDOM_LEAST)):
        run = text[a:b]
        out += [("access", a + m.start(), a + m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= ACCESS_LEAST]
        out += [("hex", a + m.start(), a + m.end()) for m in HEX.finditer(run) if m.end() - m.start() >= HEX_LEAST]
        if b - a >= RANDOM_LEAST and random_run(run, enc, max_ratio):
            out.append(("random", a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 2.2) -> DataFrame:
    """Rows (doc_id, spans), one for each row of ``docs``; spans are structs (kind, start, end).

    Null and empty texts have no spans.  Offsets count code points, ends are
    exclusive.  Repeated rows each get a row; no rows, no result.
    """
    vocab = vocabulary(docs.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocab.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(x.as_py(), enc, max_ratio)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """A text with each span, or each group of spans that overlap, replaced by a mark."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocab_path: str, *, text_col: str = "text", chars_col: str | None = "n_chars", max_ratio: float = 2.2) -> DataFrame:
    """``docs`` with secrets replaced by a mark; no document goes, and other columns stay as they are.

    ``chars_col``, where it exists, follows the new text.  Null and empty
    texts stay; repeated rows are each treated alike; an empty table gives an
    empty one.  Spans that overlap become one mark.
    """
    vocab = vocabulary(docs.sparkSession, vocab_path)
    names = docs.columns
    at_text, at_chars = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocab.value)
        for batch in batches:
            cols = list(batch.columns)
            old = cols[at_text].to_pylist()
            spans = [spans_of(x, enc, max_ratio) for x in old]
            new = [redacted(x, s) if s else x for x, s in zip(old, spans)]
            cols[at_text] = pa.array(new, cols[at_text].type)
            if at_chars is not None:
                was = cols[at_chars].to_pylist()
                cols[at_chars] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, was)], cols[at_chars].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
