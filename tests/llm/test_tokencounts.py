import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import queries, tokencounts
from factloom.llm._shared import shared_dir
from factloom.llm.secrets import encoding
from llm_paths import VOCABULARY

ENC = encoding(open(VOCABULARY, "rb").read())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "don't", "é", "12", "3 4", ".", " a b", "日本"]), max_size=40).map("".join))
def test_long_texts_are_cut_where_no_token_crosses(text):
    old, tokencounts.CUT = tokencounts.CUT, 8
    try:
        assert tokencounts.count_tokens(text, ENC) == len(ENC.encode_ordinary(text))
    finally:
        tokencounts.CUT = old


def test_counts(docs, texts, none):
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in tokencounts.token_counts(docs, VOCABULARY, keep=["doc_id"]).collect()), key=str)
    assert got == sorted(((i, len(ENC.encode_ordinary(t or ""))) for i, t in texts), key=str)
    assert tokencounts.token_counts(none, VOCABULARY, keep=["doc_id", "text"]).columns == ["doc_id", "text", "n_tokens"]


@pytest.fixture
def store(spark, request):
    return tokencounts.Rollups(spark, f"{shared_dir(spark)}/rollups-{request.node.name}-{id(request)}")


SCHEMA = "kind string, doc_id long, source string, lang string, version string, n_tokens long, n_docs int"


def changes(spark, *rows):
    return spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)


def totals(store):
    return {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}


def test_inserts_deletes_revisions(spark, store):
    assert totals(store) == {}
    first = changes(spark, ("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 20), ("insert", 3, "b", None, "v1", 5), ("insert", 1, "a", "en", "v2", 11), ("insert", None, "a", "en", "v1", 1), ("insert", 2, "a", "en", "v1", 20))
    assert store.commit("one", first)
    assert totals(store) == {("a", "en", "v1"): (3, 31), ("b", None, "v1"): (1, 5), ("a", "en", "v2"): (1, 11)}
    # Sent again, and again with other rows: nothing changes.
    assert not store.commit("one", first)
    assert not store.commit("one", changes(spark, ("insert", 9, "a", "en", "v1", 99)))
    assert totals(store)["a", "en", "v1"] == (3, 31)
    # A revision moves a document; a delete takes back what it counted; of an unknown one, nothing.
    assert store.commit("two", changes(spark, ("revise", 2, "b", "en", "v1", 25), ("delete", 1, None, None, "v1", None), ("delete", 77, None, None, "v1", None), ("insert", 4, "b", "en", "v1", None)))
    assert totals(store) == {("a", "en", "v1"): (1, 1), ("b", None, "v1"): (1, 5), ("b", "en", "v1"): (2, 25), ("a", "en", "v2"): (1, 11)}
    assert store.commit("three", changes(spark, ("delete", 3, "x", "x", "v1", 3)))
    assert ("b", None, "v1") not in totals(store)


def test_a_batch_that_broke_off_is_not_there(spark, store):
    """Data without a commit count nowhere, and the batch can be sent again."""
    row = changes(spark, ("insert", 1, "a", "en", "v1", 10))
    store._write(row.select("doc_id", "source", "lang", "version", tokencounts.F.lit(1).cast("long").alias("n_docs"), "n_tokens"))
    assert totals(store) == {} and not store.committed("one")
    assert store.commit("one", row)
    assert totals(store) == {("a", "en", "v1"): (1, 10)}


def test_of_two_writers_one_wins(spark, store):
    """A batch that another writer committed after this one looked is left out."""
    other = tokencounts.Rollups(spark, store.path)
    assert other.commit("same", changes(spark, ("insert", 1, "a", "en", "v1", 10)))
    store.committed = lambda batch: False
    assert not store.commit("same", changes(spark, ("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", "en", "v1", 5)))
    assert totals(store) == {("a", "en", "v1"): (1, 10)}


def test_names_of_batches(spark, store):
    for k, name in enumerate(("a/b", "*", "..", "", "ü %41", "a%2Fb", "+fold-0")):
        assert store.commit(name, changes(spark, ("insert", k, "a", "en", "v1", 1)))
        assert store.committed(name) and not store.commit(name, changes(spark, ("insert", 99, "a", "en", "v1", 1)))
    assert totals(store) == {("a", "en", "v1"): (7, 7)}


def plain(batches):
    """What each document counts after all batches, one change after the other."""
    now, seen = {}, set()
    for name, rows in batches:
        if name in seen:
            continue
        seen.add(name)
        for kind, doc, source, lang, version, n in rows:
            now.pop((doc, version), None)
            if kind != "delete":
                now[doc, version] = source, lang, n
    out = {}
    for (_, version), (source, lang, n) in now.items():
        a, b = out.get((source, lang, version), (0, 0))
        out[source, lang, version] = a + 1, b + n
    return out


def test_any_batches_against_replay(spark, store):
    """Random inserts, revisions and deletes, some batches sent twice, with folding between them."""
    rng, batches = random.Random(6), []
    for k in range(9):
        ids = rng.sample(range(40), 12)
        rows = [(rng.choice(["insert", "revise", "delete"]), i, rng.choice("ab"), rng.choice(["en", "de"]), rng.choice(["v1", "v2"]), rng.randint(0, 50)) for i in ids]
        batches.append((f"batch {rng.choice([k, max(0, k - 2)])}", rows))
        new = batches[-1][0] not in {n for n, _ in batches[:-1]}
        assert store.commit(batches[-1][0], changes(spark, *rows)) is new
        if k in (3, 6):
            assert store.compact() and not store.compact()
        assert totals(store) == plain(batches)
    assert not store.commit("batch 0", changes(spark, ("insert", 500, "a", "en", "v1", 1)))
    assert {(r["doc_id"], r["version"]): r["n_tokens"] for r in store.ledger().collect() if r["n_docs"]} == {k: v for k, v in {(d, v): n for d, v, n in _last(batches)}.items()}


def _last(batches):
    now, seen = {}, set()
    for name, rows in batches:
        if name not in seen:
            seen.add(name)
            for kind, doc, _, _, version, n in rows:
                now.pop((doc, version), None)
                if kind != "delete":
                    now[doc, version] = n
    return [(d, v, n) for (d, v), n in now.items()]


def test_query_against_brute_force(spark, small):
    docs = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {}
    for r in docs:
        key = (r["source"], r["lang"], "byte_bpe_50k")
        a, b = want.get(key, (0, 0))
        want[key] = a + 1, b + len(ENC.encode_ordinary(r["text"] or ""))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in queries.op10_token_counts(spark, small).collect()} == want


def test_query_of_changes_against_brute_force(spark, small):
    docs = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    want = {}
    for r in docs:
        label = labels.get(r["doc_id"])
        if label is None or label["toxic"] != 1:
            text = r["text"] or ""
            text = re.sub(r"\s+", " ", text) if label is not None and label["quality"] == 0 else text
            key = (r["source"], r["lang"], "byte_bpe_50k")
            a, b = want.get(key, (0, 0))
            want[key] = a + 1, b + len(ENC.encode_ordinary(text))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in queries.token_count_changes(spark, small).collect()} == want


def test_clashing_names(docs):
    with pytest.raises(ValueError):
        tokencounts.token_counts(docs.withColumnRenamed("key", "n_tokens"), VOCABULARY, keep=["n_tokens"])


def test_empty_batch(spark, store):
    assert store.commit("none", changes(spark))
    assert totals(store) == {}
