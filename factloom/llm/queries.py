"""Queries that apply each corpus operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import ann, decontam, divergence, langid, lm, packing, phrases, quality, secrets, simhash, spans, tokencounts, urlrep
from factloom.llm._shared import ASCII_LOWER, ASCII_UPPER, shared_dir, table

#: Vocabularies of public tokenizers.
TOKENIZERS = "/opt/tokenizers"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: their declared language is ``lang``, and their host the ``source``."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, declared=F.col("lang"), host=F.col("source"))


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: language of the markup, host and suffix of the address; models of labelled documents."""
    model = langid.train(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", lang_col="lang")
    host = urlrep.host_of(F.col("url"))
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", plain.alias("text"), langid.html_language(F.col("html")).alias("declared"))
    found = langid.identify(pages, id_col="page_id", declared=F.col("declared"), host=host, suffix=urlrep.suffix_of(host), model=model)
    return found.withColumnRenamed("doc_id", "page_id")


def op2_packing(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Documents, by their tokens and one for each text's end."""
    counted = tokencounts.token_counts(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.tiktoken", keep=["doc_id"])
    # One more for the end of each text that has tokens.
    return packing.pack(counted.withColumn("n_tokens", F.when(F.col("n_tokens") > 0, F.col("n_tokens") + 1)))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against all items of the benchmark, in windows of 10 words."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op4_secrets(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Documents: base spans, and random strings by the token test, as one string and in numbers."""
    found = secrets.scan(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.tiktoken")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("random"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: fingerprints of 3-word shingles, linked within 3 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: (verdict, host, path) of the rules that come before reputation.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the documents made from the pages: bad is toxic or of low quality."""
    labels = table(spark, sf_dir, "labels")
    bad = ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")
    judged = F.col("toxic").isNotNull() | F.col("quality").isNotNull()
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when(judged, bad).alias("bad"))
    return urlrep.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, learning from those whose remainder is not 2."""
    return lm.score(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings: the 20 nearest of every 20th, exact."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without sentences of repeated spans of 20 words or more."""
    return spans.dedup_spans(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """All documents as one batch of inserts, sent twice as after a lost driver; the totals that the store then has."""
    version = "byte_bpe_50k"
    counted = tokencounts.token_counts(table(spark, sf_dir, "documents"), f"{tokenizers}/{version}.tiktoken", keep=["doc_id", "source", "lang"])
    changes = counted.withColumns({"kind": F.lit("insert"), "version": F.lit(version)})
    store = tokencounts.Rollups(spark, f"{shared_dir(spark)}/rollups-{uuid.uuid4().hex}")
    store.commit("load-documents", changes)
    store.commit("load-documents", changes)
    return store.totals()


def token_count_changes(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """All documents inserted, toxic ones then deleted, and those of low quality revised to their text with single blanks; totals after folding."""
    version = "byte_bpe_50k"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    store = tokencounts.Rollups(spark, f"{shared_dir(spark)}/rollups-{uuid.uuid4().hex}")

    def send(batch: str, kind: str, some: DataFrame) -> None:
        counted = tokencounts.token_counts(some, f"{tokenizers}/{version}.tiktoken", keep=["doc_id", "source", "lang"])
        store.commit(batch, counted.withColumns({"kind": F.lit(kind), "version": F.lit(version)}))

    send("load", "insert", docs)
    low = docs.join(labels.filter("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    send("blanks", "revise", low.withColumn("text", F.regexp_replace("text", r"(?U)\s+", " ")))
    gone = labels.filter("toxic = 1").select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("n_tokens"))
    store.commit("take down", gone.distinct().withColumns({"kind": F.lit("delete"), "version": F.lit(version)}))
    store.compact()
    return store.totals()


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by ``labels.quality``, learning from those whose remainder is not 0."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels")
    rated = quality.rate(table(spark, sf_dir, "documents"), labels.filter(~held_out))
    return rated.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: terms of 30 documents of a language or more; distances of sources, and the 50 terms that each has most beyond its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: each language's 2,000 best phrases of two to four words that occur 30 times or more."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_secrets": op4_secrets,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_span_dedup": op7_span_dedup,
    "op8_lm_score": op8_lm_score,
    "op9_nearest": op9_nearest,
    "op10_token_counts": op10_token_counts,
    "op11_quality": op11_quality,
    "op12_divergence": op12_divergence,
    "op13_phrases": op13_phrases,
    "pages_language": pages_language,
    "token_count_changes": token_count_changes,
}

_LOWER = f"translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}')"

SQL: dict[str, str] = {
    "op3_decontaminate": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0
), dw AS (
  SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k
), hit AS (
  SELECT r, dw.i, dw.k, item_id FROM dw JOIN bw USING (k, g)
), pos AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r
), it AS (
  SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
""",
    "op6_url_filter": rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ps AS (
  SELECT *, regexp_replace(host, '{urlrep.USER_OR_PORT}', '', 'g') AS site FROM p
), o AS (
  SELECT doc_id AS page_id, CASE WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END END AS bad FROM labels
), h0 AS (
  SELECT site AS host, count(bad) AS n, coalesce(sum(bad), 0) AS x FROM ps LEFT JOIN o USING (page_id) GROUP BY site
), h1 AS (
  SELECT *, list_reverse(string_split(host, '.')) AS l, (CASE WHEN len(string_split(host, '.')) > 1 THEN string_split(host, '.')[-2] || '.' ELSE '' END) || string_split(host, '.')[-1] AS two FROM h0
), h2 AS (
  SELECT host, CAST(n AS DOUBLE) AS n, CAST(x AS DOUBLE) AS x,
         CASE WHEN regexp_matches(host, '{urlrep.ADDRESS}') THEN host WHEN two IN {urlrep.TWO_LABELS} THEN array_to_string(list_reverse(l[1:3]), '.') ELSE two END AS domain,
         CASE WHEN regexp_matches(host, '{urlrep.ADDRESS}') THEN host WHEN two IN {urlrep.TWO_LABELS} THEN two ELSE l[1] END AS suffix
  FROM h1
), g AS (
  SELECT (coalesce(sum(x), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS m FROM h2
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT m FROM g) AS m FROM h2 GROUP BY suffix
), sk AS (
  SELECT 1::DOUBLE / least(greatest(CASE WHEN c = 0 OR c IS NULL THEN 0.5::DOUBLE ELSE (a - b) / c END, 0.001::DOUBLE), 0.5::DOUBLE) - 1 AS k FROM (
    SELECT CAST(sum(CAST((x - n * m) * (x - n * m) AS DECIMAL(28,9))) AS DOUBLE) AS a, CAST(sum(CAST(n * m * (1 - m) AS DECIMAL(28,9))) AS DOUBLE) AS b,
           CAST(sum(CAST(n * (n - 1) * m * (1 - m) AS DECIMAL(28,9))) AS DOUBLE) AS c FROM s0)
), s AS (
  SELECT suffix, (x + k * m) / (n + k) AS m FROM s0, sk
), d0 AS (
  SELECT domain, suffix, d.n, d.x, m FROM (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM h2 GROUP BY domain, suffix) d JOIN s USING (suffix)
), dk AS (
  SELECT 1::DOUBLE / least(greatest(CASE WHEN c = 0 OR c IS NULL THEN 0.5::DOUBLE ELSE (a - b) / c END, 0.001::DOUBLE), 0.5::DOUBLE) - 1 AS k FROM (
    SELECT CAST(sum(CAST((x - n * m) * (x - n * m) AS DECIMAL(28,9))) AS DOUBLE) AS a, CAST(sum(CAST(n * m * (1 - m) AS DECIMAL(28,9))) AS DOUBLE) AS b,
           CAST(sum(CAST(n * (n - 1) * m * (1 - m) AS DECIMAL(28,9))) AS DOUBLE) AS c FROM d0)
), d AS (
  SELECT domain, (x + k * m) / (n + k) AS m FROM d0, dk
), hh AS (
  SELECT host, h2.n, h2.x, m FROM h2 JOIN d USING (domain)
), hk AS (
  SELECT 1::DOUBLE / least(greatest(CASE WHEN c = 0 OR c IS NULL THEN 0.5::DOUBLE ELSE (a - b) / c END, 0.001::DOUBLE), 0.5::DOUBLE) - 1 AS k FROM (
    SELECT CAST(sum(CAST((x - n * m) * (x - n * m) AS DECIMAL(28,9))) AS DOUBLE) AS a, CAST(sum(CAST(n * m * (1 - m) AS DECIMAL(28,9))) AS DOUBLE) AS b,
           CAST(sum(CAST(n * (n - 1) * m * (1 - m) AS DECIMAL(28,9))) AS DOUBLE) AS c FROM hh)
), r AS (
  SELECT host, n, k * m + x AS a, k * (1 - m) + n - x AS b FROM hh, hk
), v AS (
  SELECT page_id, host, path, site,
         CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM ps
)
SELECT page_id, v.host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.35::DOUBLE THEN 'block' ELSE 'allow' END AS verdict,
       CAST(r.n AS BIGINT) AS n_labelled
FROM v JOIN r ON v.site = r.host
""",
    "op12_divergence": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), n AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source) USING (lang, source)
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM n JOIN v USING (lang) GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), f AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM f QUALIFY part = 'pair' OR rank <= 50
""",
    "op13_phrases": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, p, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, p HAVING count(*) >= 30
), c AS (
  SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) >= 2
), s AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:len(c.p)]
), low AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inside AS (
  SELECT lang, p[i:i + m - 1] AS p, max(f) AS f FROM (SELECT lang, p, f, m, unnest(range(1, len(p) - m + 2)) AS i FROM f, (SELECT unnest(range(2, 4)) AS m) WHERE len(p) > m) GROUP BY ALL
)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, array_to_string(low.p, ' ')) AS rank, array_to_string(low.p, ' ') AS phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM low JOIN n ON low.lang = n.lang LEFT JOIN inside i ON i.lang = low.lang AND i.p = low.p
WHERE i.f IS NULL OR 100 * i.f < 80 * a
QUALIFY rank <= 2000
""",
    "op9_nearest": """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
}
