import corpus_pipeline
from factloom.llm import decontam, packing, secrets, simhash
from factloom.llm._shared import table
from test_packing import _check
from test_secrets import ENC
from test_simhash import plain_components


def test_stages_against_brute_force(spark, small):
    docs = table(spark, small, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"]
    step = dict(corpus_pipeline.STAGES)

    one = step["language_id"](spark, docs, small).cache()
    assert one.columns == docs.columns
    assert one.join(docs, docs.columns, "left_semi").count() == one.count() >= 0.98 * docs.count()

    two = step["near_duplicates"](spark, one, small).cache()
    rows = sorted((r["doc_id"], simhash.fingerprint(r["text"])) for r in one.collect())
    want = {i for (i, _), c in zip(rows, plain_components(rows)) if i == c}
    assert {r["doc_id"] for r in two.collect()} == want and two.columns == docs.columns

    three = step["decontamination"](spark, two, small).cache()
    a = decontam.Automaton([(str(r["item_id"]), decontam.words(r["text"])) for r in table(spark, small, "benchmark").collect()], 10)
    before = {r["doc_id"]: r for r in two.collect()}
    after = {r["doc_id"]: r for r in three.collect()}
    for i, r in before.items():
        ((spans, _),) = a.scan([decontam.words(r["text"])])
        if not spans:
            assert after[i] == r
        elif i in after:
            assert a.scan([decontam.words(after[i]["text"])])[0][0] == [] and after[i]["n_chars"] == len(after[i]["text"])

    four = step["secret_scan"](spark, three, small).cache()
    assert four.count() == three.count()
    for r in four.collect():
        old = after[r["doc_id"]]["text"]
        s = secrets.spans_of(old, ENC)
        assert r["text"] == (secrets.redacted(old, s) if s else old)

    five = step["best_fit_packing"](spark, four, small).collect()
    lengths = [(r["doc_id"], len(ENC.encode_ordinary(r["text"])) + 1) for r in four.collect() if r["text"]]
    _check(lengths, five, packing.SIZES)
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).select("doc_id", "piece", "length").collect())) == sorted((r["doc_id"], r["piece"], r["length"]) for r in five)


def test_stages_on_odd_documents(spark, docs, none, small):
    """Nulls, empty texts, repeats, clashing names and no rows go through every stage."""
    for src in (docs, none):
        now = src
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, small).cache()
            assert now.columns == src.columns, name
            now.count()
        placed = corpus_pipeline.STAGES[-1][1](spark, now, small)
        assert placed.select("doc_id").distinct().count() == now.filter("text <> ''").select("doc_id").distinct().count() and (src is none) == (now.count() == 0)
