"""Pairwise ranking: planted quality, the cut against brute force, and what never is an input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, raw double, id long, good boolean, x string, quality int"


def text(rng, good, n=40):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 8]) for i in range(0, n, 8)) + "." if good else " | ".join(w.upper() + "!!" for w in words)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    return [(k, text(rng, k % 3 > 0, rng.randint(5, 60)), k % 3 > 0) for k in range(300)]


def frame(spark, rows):
    """With columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, "en", "s", 1.0, 5, True, "x", 0) for i, t in rows], SCHEMA).repartition(3)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_planted_quality_is_found_on_rows_that_taught_nothing(spark, planted):
    labels = labels_of(spark, [(i, int(g), 0) for i, _, g in planted if i < 150])
    got = quality.rate(frame(spark, [(i, t) for i, t, _ in planted]), labels).collect()
    assert len(got) == 300
    wrong = [r for r in got if r["predicted"] != int(planted[r["doc_id"]][2])]
    assert wrong == [] and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_null_empty_long_and_repeated_rows_and_bad_labels(spark, planted):
    rng = random.Random(9)
    more = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "x"), (1004, text(rng, True, 60_000)), (1005, "\x00" * 50), (None, planted[1][1]), (1, planted[1][1]), (1, planted[0][1]), (1006, planted[1][1])]
    rows = [(i, t) for i, t, _ in planted] + more
    labels = [(i, int(g), 0) for i, _, g in planted] + [(5, 0, 1), (5, 1, 1), (None, 1, 0), (7, None, 0), (8, 9, 0), (9999, 1, 0)] + [(1, 1, 0)] * 50
    got = quality.rate(frame(spark, rows), labels_of(spark, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert by_id[1000] == by_id[1001] and len(by_id[1]) == 3 and len(by_id[None]) == 1
    assert by_id[1006][0] == by_id[None][0] and by_id[1006][0] in by_id[1]  # equal texts have equal scores
    assert by_id[1004][0] >= 0.3


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 0), (2, 0, 0)]])
def test_without_both_labels_nothing_is_learnt(spark, planted, labels):
    got = quality.rate(frame(spark, [(i, t) for i, t, _ in planted[:5]]), labels_of(spark, labels)).collect()
    assert {r["score"] for r in got} == {0.5} and len(got) == 5


def test_an_empty_table(spark, none):
    assert quality.rate(none, labels_of(spark, [(1, 1, 0), (2, 0, 0)])).count() == 0


def test_cut_makes_the_fewest_errors_over_all_labelled_rows(spark):
    rng = random.Random(2)
    rows = [(i, round(rng.gauss(1 if i % 4 else -0.5, 0.8), 3)) for i in range(400)] + [(3, 0.25)] * 40
    labels = [(i, int(i % 4 > 0), 0) for i in range(400)]
    made = quality.cut_by_quantile(spark.createDataFrame(rows, "id long, raw double"), labels_of(spark, labels), quality.Ranking(np.zeros(1), np.zeros(1), np.ones(1)))
    at = [(np.floor(raw * quality.STEPS) / quality.STEPS, i % 4 > 0) for i, raw in rows]

    def errors(cut):
        return sum((x >= cut) != g for x, g in at)

    assert errors(made.cut) == min(errors(x) for x, _ in [*at, (99, 0)])
    assert made.level == pytest.approx(sum(x < made.cut for x, _ in at) / len(at)) and made.slope > 0


def test_features_do_not_depend_on_the_pieces_they_are_counted_in(monkeypatch):
    data = "Ab, çd! 12\n\nxy | zz.".encode() * 50
    whole = quality.features(data)
    monkeypatch.setattr(quality, "PIECE", 7)
    assert np.allclose(whole, quality.features(data)) and len(whole) == quality.WIDTH


def test_fit_ranks_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    good = x[:, 0] - 0.5 * x[:, 1] + 0.1 * rng.normal(size=500) > 0
    r = quality.fit(x, good, pairs=100_000)
    raw = r.raw(x)
    assert (raw[good][:, None] > raw[~good][None]).mean() > 0.97
    assert abs(r.weights[2:]).max() < 0.3 * r.weights[0]


def test_op11_on_held_out_documents(spark, small):
    got = {r["doc_id"]: r for r in queries.op11_quality(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{small}/labels.parquet").filter(F.col("quality").isNotNull()).collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert len(held) > 5 and sum(a == b for a, b in held) >= 0.85 * len(held)
