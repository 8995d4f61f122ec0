import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import langid, queries

SYLLABLES = {"aa": ["ka", "lo", "mi", "nu"], "bb": ["stra", "thu", "gren", "poh"], "cc": ["ée", "çou", "ài", "ñe"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(spark):
    rng = random.Random(0)
    rows = []
    for i in range(400):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, text(rng, lang, rng.randint(5, 60)), lang if i % 10 else "aa", f"host{i % 3}", None, 1.0))
    rows += [(1000, None, "aa", "host0", None, 0.0), (1001, "", "aa", "host0", None, 0.0), (1002, "12 % 34 --", "aa", None, None, 0.0), (1003, text(rng, "bb", 20_000), None, None, "de", 0.0), (None, text(rng, "cc", 30), "cc-XX", "host2", None, 0.0), (3, rows[3][1], "aa", "host0", None, 0.0)]
    junk = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(300))
    rows.append((1004, junk, None, None, None, 0.0))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, suffix string, posterior double").repartition(3)


def test_identify(spark):
    rows, df = corpus(spark)
    got = langid.identify(df, declared=F.col("lang"), host=F.col("host"), suffix=F.col("suffix")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang"] == ("aa", "bb", "cc")[i % 3] and by[i]["accepted"] for i in range(400))
    assert all((by[i]["lang"], by[i]["accepted"]) == ("und", False) for i in (1000, 1001, 1002, 1004))
    assert by[1003]["lang"] == "bb" and by[None]["lang"] == "cc"
    kept = langid.identify(df, declared=F.col("lang"), host=F.col("host"), keep_columns=True)
    assert kept.columns == df.columns
    assert kept.count() == len(rows) - 4


def test_rare_languages_have_a_model(spark):
    """However few rows declare a language, and however many languages there are, each gets a model and its texts stay."""
    rng = random.Random(4)
    rows = [(i, text(rng, "aa", 30), "aa") for i in range(2000)]
    codes = [f"{a}{b}" for a in "pqrstuvwxy" for b in "pqrstuvw"]
    for k, code in enumerate(codes):  # each in a script of its own
        letters = [chr(0x4E00 + 200 * k + j) for j in range(40)]
        rows += [(5000 + 3 * k + j, " ".join("".join(rng.choices(letters, k=4)) for _ in range(40)), code) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in langid.identify(df, declared=F.col("lang"), train_rows=50).collect()}
    assert all(got[i]["accepted"] and got[i]["lang"] == lang for i, _, lang in rows)


def test_evidence_decides_where_the_text_cannot(spark):
    """A text as likely in two languages goes by what is declared, else by its host, else by its suffix."""
    flat = np.zeros((2, langid.BUCKETS))
    for k, lang in enumerate(("aa", "bb")):
        np.add.at(flat[k], langid.grams("same same same " + {"aa": "kala kala", "bb": "thug thug"}[lang] * 20), 1)
    model = langid.Model(["de", "fr"], flat)
    rows = [(i, "kala kala kala kala kala kala", "de", "h1", None) for i in range(60)] + [(100 + i, "thug thug thug thug thug thug", "fr", "h2", None) for i in range(60)]
    rows += [(900, "same", "fr", None, None), (901, "same", "de", None, None), (902, "same", None, "h1", None), (903, "same", None, "h2", None), (904, "same", None, None, "de"), (905, "same", None, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, suffix string")
    got = {r["doc_id"]: r["lang"] for r in langid.identify(df, declared=F.col("lang"), host=F.col("host"), suffix=F.col("suffix"), model=model).collect()}
    assert [got[k] for k in range(900, 906)] == ["fr", "de", "de", "fr", "de", "fr"]


def test_fusion_against_brute_force(spark):
    """Posteriors by Bayes' rule written out, from counts made row by row."""
    rows, df = corpus(spark)
    rows = [(i, t, lang, h, {"host0": "de", "host1": "fr", "host2": "com"}.get(h), 0.0) for i, t, lang, h, _, _ in rows]
    # Short texts, so that the other evidence counts; and a host that the rest says nothing of.
    rows = [(i, t and t[:12], lang, h, s, x) for i, t, lang, h, s, x in rows] + [(2000, "ka", "zz", "elsewhere", "de", 0.0), (2001, "thugren stra", "bb", "", "", 0.0)]
    df = spark.createDataFrame(rows, df.schema).repartition(3)
    model = langid.train(df, id_col="doc_id", text_col="text", lang_col="lang")
    known = model.languages[:-1]
    assert known == ["aa", "bb", "cc", "zz"]
    code = {"cc-XX": "cc", **{x: x for x in known}, None: None}

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    clear = []  # host, suffix, said, language
    for _, t, lang, h, s, _ in rows:
        logs = model.score(t)
        p = softmax(logs) if logs is not None else np.zeros(5)
        if p.argmax() < 4 and p.max() >= 0.9:
            clear.append((h, s, code[lang], int(p.argmax())))
    every = np.array([1.0 + sum(c[3] == k for c in clear) for k in range(4)])
    every /= every.sum()
    table = np.array([[0.5 + sum(c[3] == k and c[2] == x for c in clear) for x in known] + [0.5] for k in range(4)])
    said = np.vstack([table / table.sum(axis=1)[:, None], table.sum(axis=0)[None, :] / table.sum()])
    want = []
    for i, t, lang, h, s, _ in rows:
        logs = model.score(t)
        if logs is None:
            want.append((i, "und", 0.0))
            continue
        of_host = [c for c in clear if c[0] == h]
        of_suffix = [c for c in clear if of_host and c[1] == max(c[1] for c in of_host)]
        at = np.array([float(sum(c[3] == k for c in of_suffix)) for k in range(4)])
        prior = (at + 50 * every) / (at.sum() + 50)
        own = np.array([float(sum(c[3] == k for c in of_host)) for k in range(4)])
        prior = (own + 20 * prior) / (own.sum() + 20)
        p = softmax(logs + np.log(np.append(prior * 0.99, 0.01)) + (np.log(said[:, known.index(code[lang])]) if lang else 0))
        want.append((i, model.languages[int(p.argmax())], round(float(p.max()), 5)))
    got = langid.identify(df, declared=F.col("lang"), host=F.col("host"), suffix=F.col("suffix"), model=model).collect()
    assert sorted(((r["doc_id"], r["lang"], round(r["posterior"], 5)) for r in got), key=str) == sorted(want, key=str)
    kept = langid.identify(df, declared=F.col("lang"), host=F.col("host"), suffix=F.col("suffix"), model=model, keep_columns=True)
    assert kept.count() == sum(r["accepted"] for r in got)


def test_rows_of_one_id_are_judged_apart(spark):
    _, df = corpus(spark)
    both = spark.createDataFrame([(1, "ka lo mi nu kalomi", "aa", "host0", None, 0.0), (1, "###", "aa", "host0", None, 0.0)], df.schema)
    kept = langid.identify(df.filter("doc_id <> 1").unionByName(both), declared=F.col("lang"), host=F.col("host"), keep_columns=True)
    assert [r["text"] for r in kept.filter("doc_id = 1").collect()] == ["ka lo mi nu kalomi"]


def test_pages(spark, small):
    """Every page gets a row, in the language that its markup declares where it declares one."""
    got = queries.pages_language(spark, small)
    pages = spark.read.parquet(f"{small}/pages.parquet")
    both = got.join(pages, "page_id").withColumn("declared", langid.declared_code(langid.html_language(F.col("html")))).collect()
    assert len(both) == pages.count() == got.count()
    declared = [r for r in both if r["declared"] and r["lang"] != "und"]
    assert sum(r["lang"] == r["declared"] for r in declared) >= 0.9 * len(declared)


def test_html_language(spark):
    df = spark.createDataFrame([('<!DOCTYPE html><HTML class="x" lang="fr-CA"><p lang="de">',), ("<html><p lang='de'>",), (None,)], "html string")
    assert [r[0] for r in df.select(langid.declared_code(langid.html_language(F.col("html")))).collect()] == ["fr", None, None]


def test_empty(none):
    assert langid.identify(none, declared=F.col("lang"), host=F.col("source")).count() == 0
    assert langid.identify(none, keep_columns=True).columns == none.columns


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs.filter("doc_id % 2 = 0"), id_col="doc_id", text_col="text", lang_col="lang")
    got = langid.identify(docs.filter("doc_id % 2 = 1"), model=model).join(docs.select("doc_id", F.col("lang").alias("want")), "doc_id")
    assert got.filter("lang = want").count() >= 0.97 * got.count()
