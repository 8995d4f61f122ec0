"""Lookups, searches, dead code, duplicates over parts, lines, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.paging import page
from factloom.functions.text import canonical, line_count
from factloom.operators import dead, lookup, search
from factloom.plans.base import query, table


@query("find_references", """SELECT l_orderkey, l_linenumber, l_suppkey, (SELECT count(*) FROM lineitem WHERE l_partkey = 7) AS total_count, (SELECT count(*) FROM lineitem WHERE l_partkey = 7) > 15 AS has_more
FROM lineitem WHERE l_partkey = 7 ORDER BY l_orderkey, l_linenumber, l_suppkey LIMIT 10 OFFSET 5""")
def find_references(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), "l_orderkey", "l_linenumber", "l_suppkey")
    return lookup.find_references(refs, 7, ["l_orderkey", "l_linenumber", "l_suppkey"], 5, 10).drop("target")


_KEYS = [*range(0, 240, 5), -1, 10**9]


@query("find_references_bulk", f"""WITH k AS (SELECT CAST(unnest({_KEYS}) AS BIGINT) AS key), n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT key, coalesce(n, 0) AS "references", CASE WHEN p_partkey IS NULL THEN 'not found' END AS error FROM k LEFT JOIN n ON key = l_partkey LEFT JOIN part ON key = p_partkey""")
def find_references_bulk(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    return lookup.find_references_bulk(table(spark, d, "lineitem").select(F.col("l_partkey").alias("target")), _KEYS, known)


_PARTS = "(SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_type || '.' || p_name AS fqn, p_type AS kind, p_size, p_retailprice FROM part)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_type", "p_name").alias("fqn"), F.col("p_type").alias("kind"), "p_size", "p_retailprice")


@query("symbol_search", f"""SELECT pass, id, name, fqn, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY pass, id) AS rn FROM (SELECT *, CASE WHEN contains(lower(name), 'ring') THEN 1 WHEN contains(lower(fqn), 'ring') THEN 2 END AS pass FROM {_PARTS}) WHERE pass IS NOT NULL
) WHERE rn = 1 ORDER BY pass, fqn, id LIMIT 50""")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return lookup.symbol_search(_parts(spark, d), "ring")


@query("symbol_info", f"SELECT id, name, fqn, kind FROM {_PARTS} WHERE id = 42")
def symbol_info(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_id(_parts(spark, d), "id", 42).select("id", "name", "fqn", "kind")


@query("go_to_definition", "SELECT l_linenumber, p_partkey, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = 33")
def go_to_definition(spark: SparkSession, d: str) -> DataFrame:
    """From a reference (a line) to what it refers to (its part)."""
    at = lookup.by_id(table(spark, d, "lineitem"), "l_orderkey", 33)
    return at.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_linenumber", "p_partkey", "p_name", "p_brand")


@query("goto_type_definition", "SELECT l_linenumber, s_suppkey, n_nationkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_orderkey = 33")
def goto_type_definition(spark: SparkSession, d: str) -> DataFrame:
    at = lookup.by_id(table(spark, d, "lineitem"), "l_orderkey", 33)
    owner = at.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return owner.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("l_linenumber", "s_suppkey", "n_nationkey", "n_name")


@query("find_implementations", "SELECT p_brand, p_type, min(p_partkey) AS p_partkey, count(*) AS parts FROM part GROUP BY p_brand, p_type")
def find_implementations(spark: SparkSession, d: str) -> DataFrame:
    """One declaration for each implementation, the one preferred among its parts."""
    parts = table(spark, d, "part").select("p_brand", "p_type", "p_partkey")
    n = parts.groupBy("p_brand", "p_type").agg(F.count("*").alias("parts"))
    return lookup.preferred(parts, ["p_brand", "p_type"], [F.col("p_partkey")]).join(n, ["p_brand", "p_type"])


@query("enclosing_symbol", """WITH p AS (SELECT o_orderkey AS point_id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS pos FROM orders),
m AS (SELECT CAST(x AS INTEGER) AS x FROM range(0, 400) t(x)), s AS (SELECT 'q' || x AS span_id, x * 90 AS lo, x * 90 + 89 AS hi FROM m UNION ALL SELECT 'm' || x, x * 30, x * 30 + 24 FROM m)
SELECT point_id, span_id FROM (SELECT point_id, span_id, row_number() OVER (PARTITION BY point_id ORDER BY hi - lo, span_id) AS rn FROM p JOIN s ON pos BETWEEN lo AND hi) WHERE rn = 1""")
def enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    """The innermost of nested periods around each order's date; days between short periods are in the long ones only."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01"))
    points = table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), F.lit(0).alias("scope"), day.alias("at"))
    n = spark.range(400).select(F.col("id").cast("int").alias("x"))
    quarters = n.select(F.concat(F.lit("q"), F.col("x").cast("string")).alias("span_id"), F.lit(0).alias("scope"), (F.col("x") * 90).alias("lo"), (F.col("x") * 90 + 89).alias("hi"))
    months = n.select(F.concat(F.lit("m"), F.col("x").cast("string")).alias("span_id"), F.lit(0).alias("scope"), (F.col("x") * 30).alias("lo"), (F.col("x") * 30 + 24).alias("hi"))
    return lookup.enclosing(points, quarters.unionByName(months))


@query("completions", f"SELECT id, name, p_size AS rank FROM {_PARTS} WHERE starts_with(lower(name), 'red') ORDER BY rank, name, id LIMIT 100")
def completions(spark: SparkSession, d: str) -> DataFrame:
    return lookup.completions(_parts(spark, d).select("id", "name", F.col("p_size").alias("rank")), "Red")


@query("signature_help", """SELECT l_orderkey AS symbol, l_orderkey || '(' || string_agg(l_returnflag || ' ' || l_partkey, ', ' ORDER BY l_linenumber, l_returnflag, CAST(l_partkey AS VARCHAR)) || ')' AS signature FROM lineitem GROUP BY l_orderkey""")
def signature_help(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lookup.signatures(lines.select(F.col("l_orderkey").alias("symbol"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("kind")))


@query("effective_options", """WITH o AS (
  SELECT c_custkey AS target, 'limit' AS option, r_name AS value, 0 AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey, 'limit', n_name, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 2)
  UNION ALL SELECT c_custkey, 'limit', c_mktsegment, 2 FROM customer WHERE c_acctbal > 5000)
SELECT target, option, value, level FROM (SELECT *, row_number() OVER (PARTITION BY target, option ORDER BY level DESC, value DESC) AS rn FROM o) WHERE rn = 1""")
def effective_options(spark: SparkSession, d: str) -> DataFrame:
    """Defaults of a region, its nations and customers: the deepest one set holds."""
    who = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def level(value: str, n: int, where: str) -> DataFrame:
        return who.filter(where).select(F.col("c_custkey").alias("target"), F.lit("limit").alias("option"), F.col(value).alias("value"), F.lit(n).alias("level"))

    return lookup.effective_options(level("r_name", 0, "true").unionByName(level("n_name", 1, "n_regionkey in (0, 2)")).unionByName(level("c_mktsegment", 2, "c_acctbal > 5000")))


_LINES = "(SELECT doc_id AS id, source, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return search.lines_of(table(spark, d, "documents"), "doc_id", "text", "source")


@query("semantic_grep", f"""SELECT id, line, substr(regexp_replace(text, '[\\r\\n]', ' ', 'g'), 1, 200) AS snippet FROM {_LINES}
WHERE len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda t: regexp_matches(t, 'license|Copyright'))) > 0 ORDER BY id, line LIMIT 500""")
def semantic_grep(spark: SparkSession, d: str) -> DataFrame:
    return search.grep(_lines(spark, d), "license|Copyright", "identifiers")


@query("semantic_grep_numbers", f"""SELECT id, line, substr(regexp_replace(text, '[\\r\\n]', ' ', 'g'), 1, 200) AS snippet FROM {_LINES}
WHERE source = 'src3' AND len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda t: regexp_matches(t, '^4[0-9]{{8}}'))) > 0 ORDER BY id, line LIMIT 500""")
def semantic_grep_numbers(spark: SparkSession, d: str) -> DataFrame:
    return search.grep(_lines(spark, d).filter("source = 'src3'"), "^4[0-9]{8}", "numbers")


@query("semantic_grep_urls", """SELECT page_id AS id, 1::BIGINT AS line, substr(url, 1, 200) AS snippet FROM pages
WHERE len(list_filter(regexp_extract_all(url, 'https?://[^ ]+'), lambda t: regexp_matches(t, 'example.org/[a-z]+/[0-9]+$'))) > 0 ORDER BY id, line LIMIT 500""")
def semantic_grep_urls(spark: SparkSession, d: str) -> DataFrame:
    return search.grep(search.lines_of(table(spark, d, "pages"), "page_id", "url"), "example.org/[a-z]+/[0-9]+$", "urls")


def _semantic(name: str, text: str, where: str, kind: str) -> None:
    @query(name, f"SELECT id, name, '{kind}' AS match_kind FROM {_PARTS} WHERE {where} ORDER BY id LIMIT 50")
    def run(spark: SparkSession, d: str) -> DataFrame:
        words = {"economy": F.col("kind") == "ECONOMY", "small": F.col("kind") == "SMALL", "expensive": F.col("p_retailprice") > 1000}
        return search.semantic_search(_parts(spark, d), text, words)


_semantic("semantic_search_structured", "all economy parts with more than 20 p_size", "kind = 'ECONOMY' AND p_size > 20", "structured")
_semantic("semantic_search_name", "find the red widget", "contains(lower(name), 'red widget')", "name-substring")
_semantic("semantic_search_token", "find gear or ring, zzz", "contains(lower(name), 'gear') OR contains(lower(name), 'ring') OR contains(lower(name), 'zzz')", "token-or")

_TAGS = [("<script", "code"), ("<style", "style"), ("<table", "data"), ("<nav", "layout"), ("<!--", "comment")]
_TAG_SQL = " UNION ALL ".join(f"SELECT page_id AS id, '{c}' AS call, '{k}' AS kind, CAST((length(html) - length(replace(html, '{c}', ''))) // {len(c)} AS BIGINT) AS n FROM pages" for c, k in _TAGS)


@query("reflection_usages", f"SELECT * FROM ({_TAG_SQL}) WHERE n > 0")
def reflection_usages(spark: SparkSession, d: str) -> DataFrame:
    return search.known_calls(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), _TAGS)


@query("unused_symbols", """SELECT p_partkey AS symbol, p_type AS kind, CASE WHEN p_type = 'ECONOMY' THEN 'low' WHEN p_size > 25 THEN 'medium' ELSE 'high' END AS confidence
FROM part WHERE p_type <> 'PROMO' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)""")
def unused_symbols(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_type").alias("kind"), "p_size")
    refs = table(spark, d, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("target"))
    confidence = F.when(F.col("kind") == "ECONOMY", "low").when(F.col("p_size") > 25, "medium").otherwise("high")
    return dead.unused_symbols(parts, refs, confidence, F.col("kind") == "PROMO").drop("p_size")


@query("dead_fields", """WITH u AS (SELECT user_id AS field, count(*) FILTER (event_type = 'view' OR event_type = 'error') AS r, count(*) FILTER (event_type IN ('click', 'purchase') OR event_type = 'error') AS w FROM events WHERE value > 90 GROUP BY user_id),
f AS (SELECT c_custkey AS field, c_acctbal > 9000 AS i FROM customer), b AS (SELECT f.field, coalesce(r, 0) AS reads, coalesce(w, 0) + CAST(i AS BIGINT) AS writes FROM f LEFT JOIN u USING (field))
SELECT *, CASE WHEN reads = 0 AND writes = 0 THEN 'never-either' WHEN reads = 0 THEN 'never-read' ELSE 'never-written' END AS usage FROM b WHERE reads = 0 OR writes = 0""")
def dead_fields(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "customer").select(F.col("c_custkey").alias("field"), (F.col("c_acctbal") > 9000).alias("initialised"))
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type").isin("click", "purchase"), "write").when(F.col("event_type") == "error", "both")
    return dead.dead_fields(fields, table(spark, d, "events").filter("value > 90").select(F.col("user_id").alias("field"), kind.alias("kind")))


@query("dead_locals", """SELECT user_id AS body, CAST(event_id % 7 AS VARCHAR) AS local, count(*) FILTER (event_type = 'purchase') AS writes FROM events WHERE event_type <> 'signup'
GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type IN ('view', 'click')) = 0""")
def dead_locals(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type").isin("view", "click"), "read").otherwise("declare")
    return dead.dead_locals(table(spark, d, "events").select(F.col("user_id").alias("body"), (F.col("event_id") % 7).cast("string").alias("local"), kind.alias("event"), F.col("event_type").alias("role")), ("signup",))


_CANONICAL = "trim(regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query("duplicate_methods", f"""SELECT substr(sha256({_CANONICAL}), 1, 16) AS hash, count(*) AS members, max(n) AS lines, min(doc_id) AS first
FROM (SELECT *, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n FROM documents) WHERE n >= 3 GROUP BY 1 HAVING count(*) >= 2""")
def duplicate_methods(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return dead.duplicates(docs, canonical(F.col("text")), line_count(F.col("text")), least_lines=3)


@query("duplicate_helpers", """SELECT l_orderkey AS helper, 'part' || l_partkey AS callee, CASE WHEN l_quantity <= 1 THEN 'high' ELSE 'medium' END AS confidence
FROM lineitem WHERE l_quantity <= 2 AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 40) AND NOT starts_with('part' || l_partkey, 'part1')""")
def duplicate_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Orders of next to nothing, as wrappers of a part; large parts are the project's own, those named part1... a framework's."""
    name = F.concat(F.lit("part"), F.col("l_partkey").cast("string"))
    helpers = table(spark, d, "lineitem").filter("l_quantity <= 2").select(F.col("l_orderkey").alias("helper"), name.alias("callee"), F.col("l_quantity").alias("statements"))
    own = table(spark, d, "part").filter("p_size > 40").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("symbol"))
    return dead.duplicate_helpers(helpers, own, ("part1",))


@query("remove_dead_code", """SELECT l_orderkey AS path, count(*) FILTER (p_size > 45) AS removed, count(*) FILTER (p_size <= 45 OR p_size IS NULL) AS "left" FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(*) FILTER (p_size > 45) > 0""")
def remove_dead_code(spark: SparkSession, d: str) -> DataFrame:
    """What removing large parts would leave of each order."""
    symbols = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("path"))
    return dead.removable(symbols, table(spark, d, "part").filter("p_size > 45").select(F.col("p_partkey").alias("symbol")))


@query("list_analyzers", """SELECT p_brand, p_type, count(*) OVER () AS total_count, count(*) OVER () > 25 AS has_more FROM (SELECT DISTINCT p_brand, p_type FROM part) ORDER BY p_brand, p_type LIMIT 20 OFFSET 5""")
def list_analyzers(spark: SparkSession, d: str) -> DataFrame:
    """Distinct rules of each analyser, a page of them."""
    return page(table(spark, d, "part").select("p_brand", "p_type").distinct(), [F.col("p_brand"), F.col("p_type")], 5, 20)
