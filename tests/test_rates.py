"""An exact rate limit over a stream of several files, against all spans of time by hand."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from factloom.streaming import rates

SCHEMA = "k string, id long, ts timestamp"
START = datetime(2024, 5, 1, tzinfo=UTC)


def run(spark, folder, batches, **kw):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/{n:02}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    found = rates.over_any(stream, "ts", "k", "id", **kw)
    with rates.lasting_state(spark):
        q = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r["k"] or "", r["id"], r["n"]) for r in spark.read.schema(found.schema).parquet(f"{folder}/out").collect())


def plain(rows, most, seconds, before):
    rows = [r for r in rows if r[2] is not None]
    n = [(k, i, t, sum(o[0] == k and t - timedelta(seconds=seconds) <= o[2] <= t for o in rows)) for k, i, t in rows]
    return sorted((k or "", i, c) for k, i, t, c in n if c > most and t < before)


@pytest.mark.parametrize("n_batches", [1, 4])
def test_any_span_counts_and_not_fixed_windows(spark, tmp_path, n_batches):
    """Rows come out of order, though none too late; ties, repeats, null keys and null times among them."""
    rng = random.Random(n_batches)
    rows = [(rng.choice(["a", "a", "b", None]), i, START + timedelta(seconds=rng.randrange(0, 1500))) for i in range(150)]
    rows += [("c", 900, START + timedelta(seconds=s)) for s in (59, 59, 119, 120)] + [("c", 901, None), ("d", 902, START + timedelta(seconds=1500))]
    order = sorted(rows, key=lambda r: (r[2] or START) + timedelta(seconds=r[1] % 60))
    batches = [order[b * 40 : (b + 1) * 40 if b < n_batches - 1 else None] for b in range(n_batches)]
    got = run(spark, tmp_path, batches, most=3, seconds=60.0, late="2 minutes")
    assert got == plain(rows, 3, 60, START + timedelta(seconds=1500 - 120)) and ("c", 900, 3) not in got


def test_late_rows_are_left_out_and_state_ends(spark, tmp_path):
    at = [START + timedelta(seconds=s) for s in (0, 1, 2, 4000, 5, 4001, 9000)]
    batches = [[("a", i, at[i])] for i in range(len(at))]
    got = run(spark, tmp_path, batches, most=1, seconds=10.0, late="1 minute")
    # Row 4 comes when the watermark is long past it: it is neither judged nor counted.
    assert got == [("a", 1, 2), ("a", 2, 3), ("a", 5, 2)]
