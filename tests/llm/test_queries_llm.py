"""Registered queries: against their SQL, or against brute force that shares no code with the operators."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
import tiktoken

from factloom.llm import packing, queries
from llm_paths import VOCABULARY
from test_packing import _check
from test_queries import TABLES, from_duck, from_spark
from test_spans import plain as spans_left


@pytest.fixture(scope="module")
def rows(spark, small):
    return [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def enc():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    assert from_spark(queries.QUERIES[name](spark, small)) == from_duck(con, queries.SQL[name])


def test_op1_has_a_row_for_each_document(spark, small, rows):
    got = queries.op1_language_id(spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows)
    declared = {r["doc_id"]: r["lang"] for r in rows}
    assert sum(r["lang"] == declared[r["doc_id"]] for r in got) >= 0.97 * len(got)


def test_op2_against_a_check_of_every_bin(spark, small, rows, enc):
    got = queries.op2_packing(spark, small).collect()
    lengths = [(r["doc_id"], len(enc.encode_ordinary(r["text"])) + 1) for r in rows if r["text"]]
    _check(lengths, got, packing.SIZES)
    bins = {r["bin_id"]: r["capacity"] for r in got}
    room = sum(bins.values()) - sum(n for _, n in lengths)
    assert room <= 0.05 * sum(bins.values()) + 8192


def test_op4_against_plain_patterns(spark, small, rows):
    """Base spans by the contract's patterns alone; the rest of the spans are the method's."""
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    order = {"assign": 0, "access": 1, "hex": 2}
    got = {r["doc_id"]: r for r in queries.op4_secrets(spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text = r["text"] or ""
        found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[1]) >= 12]
        found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        found.sort(key=lambda s: (s[1], order[s[0]]))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        mine = got[r["doc_id"]]
        assert (mine["n_assign"], mine["n_access"], mine["n_hex"]) == tuple(sum(k == x for k, _, _ in found) for x in order)
        assert mine["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in mine["spans"].split(",") if s and not s.startswith("random")] == [s for s in joined.split(",") if s]


def test_op7_against_brute_force(spark, small, rows):
    want = spans_left(sorted((r["doc_id"], r["text"]) for r in rows))
    got = queries.op7_span_dedup(spark, small).collect()
    assert len(got) == len(rows)
    before = {r["doc_id"]: r["text"] for r in rows}
    assert all((r["text"], r["n_removed"]) == want[r["doc_id"], before[r["doc_id"]]] for r in got)
    assert sum(r["n_removed"] for r in got) > 0


def test_op8_against_plain_counts(spark, small, rows):
    words = [[w.lower() if w.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")] + [None] for r in rows]
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    count = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in queries.op8_lm_score(spark, small).collect()}
    assert len(got) == len(rows)
    for r, ws, h in zip(rows, words, held):
        mine = got[r["doc_id"]]
        assert (mine["held_out"], mine["n_tokens"], mine["n_known"], mine["train_tokens"]) == (h, len(ws), sum(count[w] > 0 for w in ws), n)
        assert mine["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert math.isfinite(mine["score"]) and mine["score"] < 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
