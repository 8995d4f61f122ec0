"""Staged changes over the driver's tables: what each would change, and the tables after it is applied through a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import registry
from factloom.functions.text import canonical, digest
from factloom.operators import changes, dead, diagnostics, graph, lookup, rewrites, search
from factloom.plans.base import query, table
from factloom.plans.graphs import _TREE_SQL, _tree
from factloom.session import Workspaces

#: Columns of tables that changes are shown and summed up by; all are whole numbers or strings.
_COLUMNS = {
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "events": ["event_id", "user_id", "event_type", "props"], "documents": ["doc_id", "text", "lang", "source"],
    "pages": ["page_id", "url"], "conversations": ["conv_id", "turn", "role", "text"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
}

Change = Callable[[DataFrame, SparkSession, str], DataFrame]


def _summary(rows: DataFrame) -> DataFrame:
    """One row on a table: how many rows, how many different, how long together, the least and the greatest."""
    one = rows.select(F.concat_ws("|", *(F.col(c).cast("string") for c in rows.columns)).alias("s"))
    return one.agg(F.count("*").alias("n"), F.countDistinct("s").alias("different"), F.sum(F.length("s")).alias("chars"), digest(F.min("s")).alias("first"), digest(F.max("s")).alias("last"))


def _summary_sql(columns: list[str], rows: str) -> str:
    return f"""SELECT count(*) AS n, count(DISTINCT s) AS different, CAST(sum(length(s)) AS BIGINT) AS chars, substr(sha256(min(s)), 1, 16) AS first, substr(sha256(max(s)), 1, 16) AS last
FROM (SELECT concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}) AS s FROM ({rows}))"""


def staged(of: str, after_sql: str, preview: str | None = None, apply: str | None = None) -> Callable[[Change], Change]:
    """Register a change of a table: ``preview`` shows its difference, ``apply`` stages it in a session, redeems it and sums the table up."""
    columns = _COLUMNS[of]
    named = ", ".join(columns)

    def add(change: Change) -> Change:
        if preview:
            shown = f"WITH a AS ({after_sql}), b AS (SELECT {named} FROM {of})"

            @query(preview, f"{shown} SELECT *, '-' AS change FROM (SELECT {named} FROM b EXCEPT ALL SELECT {named} FROM a) UNION ALL SELECT *, '+' FROM (SELECT {named} FROM a EXCEPT ALL SELECT {named} FROM b)")
            def show(spark: SparkSession, d: str) -> DataFrame:
                before = table(spark, d, of).select(*columns)
                return changes.difference(before, change(before, spark, d))

        if apply:

            @query(apply, f"SELECT s.*, CAST(1 AS BIGINT) AS sequence, CAST(2 AS BIGINT) AS version FROM ({_summary_sql(columns, after_sql)}) s")
            def redeem(spark: SparkSession, d: str) -> DataFrame:
                w = Workspaces(spark)
                s = w.load(d, [of])
                before = s.tables[of].select(*columns)
                sequence = w.apply(w.preview(s.id, of, change(before, spark, d), apply))
                return _summary(s.tables[of]).withColumns({"sequence": F.lit(sequence).cast("long"), "version": F.lit(s.version).cast("long")})

        return change

    return add


def _set(of: str, where: str, **values: str) -> str:
    """SQL of a table in which columns have new values where a condition holds."""
    return f"SELECT {', '.join(f'CASE WHEN {where} THEN {values[c]} ELSE {c} END AS {c}' if c in values else c for c in _COLUMNS[of])} FROM {of}"


def _plus(of: str, *rows: tuple) -> str:
    return f"SELECT {', '.join(_COLUMNS[of])} FROM {of} UNION ALL VALUES {', '.join(str(r).replace('None', 'NULL') if len(r) > 1 else str(r).replace(',', '') for r in rows)}"


def _rows(spark: SparkSession, like: DataFrame, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), like.schema)


# Refactorings.
staged("part", _set("part", "p_brand = 'Brand#7' AND p_size > 10", p_brand="'Brand#70'"), apply="bulk_replace_type_apply")(lambda t, s, d: changes.replaced(t, (F.col("p_brand") == "Brand#7") & (F.col("p_size") > 10), p_brand="Brand#70"))
staged("events", _set("events", "event_id BETWEEN 200 AND 260", user_id="-1"), apply="extract_method_apply")(lambda t, s, d: changes.replaced(t, F.col("event_id").between(200, 260), user_id=-1))
staged("events", _set("events", "event_type = 'error'", event_type="'fixed'"), apply="fix_all_apply")(lambda t, s, d: changes.replaced(t, F.col("event_type") == "error", event_type="fixed"))
staged("part", _set("part", "p_partkey = 10", p_name="'I' || p_name"), apply="rename_apply")(lambda t, s, d: changes.replaced(t, F.col("p_partkey") == 10, p_name=F.concat(F.lit("I"), "p_name")))
staged("lineitem", f"SELECT {', '.join(_COLUMNS['lineitem'])} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1", apply="organize_usings_apply")(
    lambda t, s, d: lookup.preferred(t, ["l_orderkey", "l_returnflag", "l_linestatus"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
)
staged("conversations", "SELECT conv_id, turn, role, regexp_replace(text, '  +', ' ', 'g') AS text FROM conversations", apply="format_document_apply")(lambda t, s, d: changes.rewritten(t, "text", "  +", " "))
staged("conversations", "SELECT conv_id, turn, role, CASE WHEN turn BETWEEN 2 AND 4 THEN regexp_replace(text, '[,;]', ' ', 'g') ELSE text END AS text FROM conversations", apply="format_range_apply")(
    lambda t, s, d: changes.rewritten(t.filter("turn between 2 and 4"), "text", "[,;]", " ").unionByName(t.filter("not turn between 2 and 4"))
)
_FIX = _set("events", "event_id = 7", event_type="'wrapped'")
staged("events", _FIX, preview="code_fix_preview", apply="code_fix_apply")(lambda t, s, d: changes.replaced(t, F.col("event_id") == 7, event_type="wrapped"))
staged("part", _set("part", "p_brand = 'Brand#4' AND p_type IN ('SMALL', 'PROMO')", p_brand="'Brand#4b'"), preview="extract_type_preview", apply="extract_type_apply")(
    lambda t, s, d: changes.replaced(t, (F.col("p_brand") == "Brand#4") & F.col("p_type").isin("SMALL", "PROMO"), p_brand="Brand#4b")
)
staged("customer", _set("customer", "c_custkey = 17", c_mktsegment="'moved'"), preview="move_type_to_file_preview", apply="move_type_to_file_apply")(lambda t, s, d: changes.replaced(t, F.col("c_custkey") == 17, c_mktsegment="moved"))
staged("part", _plus("part", (-1, "IPart", "Brand#1", "INTERFACE", 0)), apply="extract_interface_apply")(lambda t, s, d: changes.inserted(t, ["p_partkey"], _rows(s, t, (-1, "IPart", "Brand#1", "INTERFACE", 0))))
staged("part", f"SELECT {', '.join(_COLUMNS['part'])} FROM part WHERE NOT (p_size > 45 AND p_type = 'SMALL')", apply="remove_dead_code_apply")(lambda t, s, d: changes.without(t, ["p_partkey"], t.filter("p_size > 45 and p_type = 'SMALL'")))


def _renamed_and_edited(t: DataFrame) -> list:
    return [lambda x: changes.replaced(x, F.col("p_name").contains("bolt"), p_name=F.upper("p_name")), lambda x: changes.rewritten(x, "p_name", "BOLT", "screw"), lambda x: changes.replaced(x, F.col("p_size") > 48, p_size=48)]


staged("part", "SELECT p_partkey, CASE WHEN contains(p_name, 'bolt') THEN replace(upper(p_name), 'BOLT', 'screw') ELSE p_name END AS p_name, p_brand, p_type, least(p_size, 48) AS p_size FROM part", preview="symbol_refactor_preview")(
    lambda t, s, d: changes.fold(t, _renamed_and_edited(t), F.col("p_size") <= 48)
)
staged("part", f"SELECT {', '.join(_COLUMNS['part'])} FROM part", apply="symbol_refactor_refused")(lambda t, s, d: changes.fold(t, _renamed_and_edited(t), F.col("p_size") <= 47))

# Projects: parts as references to packages (brands), nations as edges to regions, customers as properties.
staged("part", _plus("part", (-5, "pkg", "Brand#99", "1.0", 1)), preview="add_package_reference")(lambda t, s, d: changes.inserted(t, ["p_partkey"], _rows(s, t, (-5, "pkg", "Brand#99", "1.0", 1), (1, "taken", "Brand#99", "1.0", 1))))
staged("part", f"SELECT {', '.join(_COLUMNS['part'])} FROM part WHERE p_brand <> 'Brand#5'", preview="remove_package_reference")(lambda t, s, d: changes.without(t, ["p_brand"], s.createDataFrame([("Brand#5",)], "p_brand string")))
staged("nation", _plus("nation", (7, "NATION_7", 4)), preview="add_project_reference")(lambda t, s, d: changes.inserted(t, ["n_nationkey", "n_regionkey"], t.filter("n_nationkey in (7, 4)").withColumn("n_regionkey", F.lit(4)).filter("n_nationkey = 7")))
staged("nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT (n_regionkey = 2 AND n_nationkey < 10)", preview="remove_project_reference")(
    lambda t, s, d: changes.without(t, ["n_nationkey", "n_regionkey"], t.filter("n_regionkey = 2 and n_nationkey < 10"))
)
staged("customer", _set("customer", "c_nationkey = 3", c_mktsegment="'Nullable'"), preview="set_project_property")(
    lambda t, s, d: changes.upsert(t, ["c_custkey"], t.filter("c_nationkey = 3").withColumn("c_mktsegment", F.lit("Nullable"))).select(*t.columns)
)
staged("customer", _set("customer", "c_nationkey < 6 AND c_mktsegment = 'BUILDING'", c_name="'Debug'"), preview="set_conditional_property")(
    lambda t, s, d: changes.upsert(t, ["c_custkey", "c_mktsegment"], t.filter("c_nationkey < 6 and c_mktsegment = 'BUILDING'").withColumn("c_name", F.lit("Debug"))).select(*t.columns)
)
staged("part", _set("part", "p_brand = 'Brand#6'", p_type="'2.0.0'"), preview="add_central_package_version")(lambda t, s, d: changes.upsert(t, ["p_partkey"], t.filter("p_brand = 'Brand#6'").withColumn("p_type", F.lit("2.0.0"))).select(*t.columns))
staged("part", f"SELECT {', '.join(_COLUMNS['part'])} FROM part WHERE p_type <> 'PROMO' OR p_brand <> 'Brand#6'", preview="remove_central_package_version")(
    lambda t, s, d: changes.without(t, ["p_brand", "p_type"], s.createDataFrame([("Brand#6", "PROMO")], "p_brand string, p_type string"))
)
staged("part", _set("part", "p_brand = 'Brand#8'", p_type="'net10'"), apply="apply_project_mutation")(lambda t, s, d: changes.replaced(t, F.col("p_brand") == "Brand#8", p_type="net10"))
staged("customer", _set("customer", "c_custkey IN (5, 9)", c_mktsegment="'error'"), preview="set_editorconfig_option")(
    lambda t, s, d: changes.upsert(t, ["c_custkey"], t.filter("c_custkey in (5, 9)").withColumn("c_mktsegment", F.lit("error"))).select(*t.columns)
)


@query("remove_target_framework", "SELECT r_regionkey AS key, string_agg(n_name, ',' ORDER BY n_name) FILTER (n_name <> 'NATION_7') AS list FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def remove_target_framework(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "region").select(F.col("r_regionkey").alias("key"))
    return rewrites.with_element(rows, "key", table(spark, d, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("value")), remove="NATION_7")


# Edits of texts.
def _edited(t: DataFrame, s: SparkSession, d: str) -> DataFrame:
    """A mark before each url with a query, and its scheme in capitals; other pages have no edit."""
    some = t.filter(F.col("url").contains("?"))
    edits = some.select(F.col("page_id").alias("id"), F.inline(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("<").alias("insert")), F.struct(F.lit(0).alias("start"), F.lit(4).alias("length"), F.lit("HTTP").alias("insert")))))
    return changes.apply_edits(t.select(F.col("page_id").alias("id"), F.col("url").alias("text")), edits).toDF("page_id", "url")


_EDITED = "SELECT page_id, CASE WHEN contains(url, '?') THEN '<HTTP' || substr(url, 5) ELSE url END AS url FROM pages"
staged("pages", _EDITED, preview="preview_multi_file_edit", apply="apply_multi_file_edit")(_edited)
staged("pages", _EDITED, apply="preview_multi_file_edit_apply")(_edited)

_SOME_LINES = "l AS (SELECT doc_id AS id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS text FROM documents), p AS (SELECT id, min(line) AS line FROM l WHERE contains(text, 'License') GROUP BY id)"


@query("add_pragma_suppression", f"""WITH {_SOME_LINES} SELECT id, line * 3 AS ord, text FROM l WHERE id IN (SELECT id FROM p)
UNION ALL SELECT id, line * 3 - 1, '#pragma warning disable CS1' FROM p UNION ALL SELECT id, line * 3 + 1, '#pragma warning restore CS1' FROM p""")
def add_pragma_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents whose first line on licenses gets a suppression around it."""
    lines = search.lines_of(table(spark, d, "documents"), "doc_id", "text")
    points = lines.filter(F.col("text").contains("License")).groupBy("id").agg(F.min("line").alias("line"))
    return rewrites.suppressions(lines, points, "CS1")


# Files: pages as files, by url.
_ASKED = [("create", "http://new.example/a", None), ("create", "ftp://outside/a", None), ("delete", "http://none.example/", None), ("move", "http://none.example/", "http://new.example/b")]
_TAKEN = "(SELECT min(url) FROM pages)"
_ASKED_SQL = f"asked(op, path, target) AS (VALUES {', '.join(str(r).replace('None', 'NULL') for r in _ASKED)} UNION ALL SELECT 'create', min(url), NULL FROM pages UNION ALL SELECT 'delete', max(url), NULL FROM pages UNION ALL SELECT 'move', min(url), 'http://new.example/c' FROM pages UNION ALL SELECT 'move', min(url), max(url) FROM pages UNION ALL SELECT 'move', min(url), min(url) FROM pages)"
_CHECKED_SQL = """checked AS (SELECT op, path, target, CASE WHEN op IN ('create', 'move') AND NOT starts_with(CASE op WHEN 'move' THEN target ELSE path END, 'http') THEN 'outside' WHEN op = 'create' AND path IN (SELECT url FROM pages) THEN 'exists'
 WHEN op <> 'create' AND path NOT IN (SELECT url FROM pages) THEN 'missing' WHEN op = 'move' AND path = target THEN 'same' WHEN op = 'move' AND target IN (SELECT url FROM pages) THEN 'exists' ELSE 'ok' END AS verdict FROM asked)"""


def _checked(spark: SparkSession, d: str, ops: tuple[str, ...] = ("create", "delete", "move")) -> DataFrame:
    files = table(spark, d, "pages").select(F.col("url").alias("path"))
    ends = files.agg(F.min("path").alias("a"), F.max("path").alias("b"))
    new = F.lit(None).cast("string")
    of = F.array(*(F.struct(F.lit(op).alias("op"), path.alias("path"), target.alias("target")) for op, path, target in (("create", F.col("a"), new), ("delete", F.col("b"), new), ("move", F.col("a"), F.lit("http://new.example/c")), ("move", F.col("a"), F.col("b")), ("move", F.col("a"), F.col("a")))))
    asked = spark.createDataFrame(_ASKED, "op string, path string, target string").unionByName(ends.select(F.inline(of)))
    return changes.file_checks(files, asked.filter(F.col("op").isin(*ops)), "http")


def _file_queries(op: str) -> None:
    @query(f"{op}_file_preview", f"WITH {_ASKED_SQL}, {_CHECKED_SQL} SELECT * FROM checked WHERE op = '{op}'")
    def preview(spark: SparkSession, d: str) -> DataFrame:
        """Whether files can be changed so, and why not."""
        return _checked(spark, d, (op,))

    moved = "CASE WHEN url = (SELECT min(url) FROM pages) THEN 'http://new.example/c' ELSE url END"
    after = {"create": "SELECT url AS path, host FROM f UNION ALL SELECT 'http://new.example/a', ''", "delete": "SELECT url AS path, host FROM f WHERE url <> (SELECT max(url) FROM pages)", "move": f"SELECT {moved} AS path, host FROM f"}[op]
    files = "WITH f AS (SELECT url, substr(url, 1, 12) AS host FROM pages)"

    @query(f"{op}_file_apply", f"SELECT s.*, CAST(1 AS BIGINT) AS sequence FROM ({_summary_sql(['path', 'text'], f'{files} SELECT path, host AS text FROM ({after})')}) s")
    def apply(spark: SparkSession, d: str) -> DataFrame:
        """The files after what is ok of it."""
        w = Workspaces(spark)
        s = w.load(d, ["pages"])
        now = s.tables["pages"].select(F.col("url").alias("path"), F.substring("url", 1, 12).alias("text"))
        sequence = w.apply(w.preview(s.id, "pages", changes.files_after(now, _checked(spark, d, (op,))), op))
        return _summary(s.tables["pages"]).withColumn("sequence", F.lit(sequence).cast("long"))


for _op in ("create", "delete", "move"):
    _file_queries(_op)

# What tools outside make from templates comes as rows.
for _name, _key in (("scaffold_type_apply", -11), ("scaffold_test_apply", -12)):
    staged("part", _plus("part", (_key, "Scaffold", "Brand#1", "NEW", 0)), apply=_name)(lambda t, s, d, k=_key: changes.inserted(t, ["p_partkey"], _rows(s, t, (k, "Scaffold", "Brand#1", "NEW", 0))))

staged("events", _set("events", "event_id = 11", event_type="'audited'"), preview="preview_code_action", apply="apply_code_action")(lambda t, s, d: changes.replaced(t, F.col("event_id") == 11, event_type="audited"))


@query("apply_composite", f"""WITH a AS ({_set("part", "p_brand = 'Brand#2'", p_brand="'Brand#99'")}), b AS (SELECT {', '.join(_COLUMNS['part'])} FROM a WHERE p_size < 40)
SELECT s.*, CAST(2 AS BIGINT) AS sequence, CAST(3 AS BIGINT) AS version FROM ({_summary_sql(_COLUMNS['part'], 'SELECT * FROM b')}) s""")
def apply_composite(spark: SparkSession, d: str) -> DataFrame:
    """Two staged changes of a table, one applied on top of the other."""
    w = Workspaces(spark)
    s = w.load(d, ["part"])
    first = s.tables["part"].select(*_COLUMNS["part"])
    w.apply(w.preview(s.id, "part", changes.replaced(first, F.col("p_brand") == "Brand#2", p_brand="Brand#99"), "replace"))
    sequence = w.apply(w.preview(s.id, "part", s.tables["part"].filter("p_size < 40"), "drop"))
    return _summary(s.tables["part"]).withColumns({"sequence": F.lit(sequence).cast("long"), "version": F.lit(s.version).cast("long")})


# Sessions.
_OPEN = ("nation", "part", "orders", "documents", "events")


def _session(spark: SparkSession, d: str) -> tuple[Workspaces, str]:
    w = Workspaces(spark)
    return w, w.load(d, list(_OPEN)).id


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _OPEN)


@query("workspace_status", _COUNTS)
def workspace_status(spark: SparkSession, d: str) -> DataFrame:
    w, s = _session(spark, d)
    return w.status(s)


@query("workspace_load", f"SELECT count(*) AS tables, CAST(sum(n) AS BIGINT) AS n, CAST(1 AS BIGINT) AS version FROM ({_COUNTS})")
def workspace_load(spark: SparkSession, d: str) -> DataFrame:
    """A session that is loaded twice is one."""
    w, s = _session(spark, d)
    w.load(d, list(_OPEN))
    return w.status(s).agg(F.count("*").alias("tables"), F.sum("n").alias("n")).crossJoin(w.listed().select(F.col("version").cast("long")))


@query("workspace_reload", "SELECT CAST(2 AS BIGINT) AS version, count(*) AS n FROM part")
def workspace_reload(spark: SparkSession, d: str) -> DataFrame:
    """Staged changes don't outlive a new version."""
    w, s = _session(spark, d)
    w.preview(s, "part", w.sessions[s].tables["part"].limit(1), "lost")
    version = w.reload(s).version
    return w.sessions[s].tables["part"].agg(F.count("*").alias("n")).withColumn("version", F.lit(version + len(w.staged)).cast("long"))


@query("workspace_list", "SELECT CAST(5 AS BIGINT) AS tables, CAST(1 AS BIGINT) AS version")
def workspace_list(spark: SparkSession, d: str) -> DataFrame:
    w, _ = _session(spark, d)
    return w.listed().select(F.col("tables").cast("long"), F.col("version").cast("long"))


@query("workspace_close", "SELECT CAST(0 AS BIGINT) AS sessions")
def workspace_close(spark: SparkSession, d: str) -> DataFrame:
    w, s = _session(spark, d)
    w.close(s)
    return w.listed().agg(F.count("*").alias("sessions"))


@query("workspace_warm", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM part) AS n")
def workspace_warm(spark: SparkSession, d: str) -> DataFrame:
    w, s = _session(spark, d)
    n = w.warm(s, ["nation", "part"])
    w.close(s)
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query("workspace_verbose", "SELECT * FROM (VALUES ('documents', 5), ('nation', 3), ('part', 6)) v(name, columns)")
def workspace_verbose(spark: SparkSession, d: str) -> DataFrame:
    """A session's tables with their columns."""
    w = Workspaces(spark)
    return w.described(w.load(d, ["documents", "nation", "part"]).id)


@query("workspace_log", "SELECT * FROM (VALUES (1::BIGINT, 'part', 'first', false), (2, 'part', 'second', true), (3, 'nation', 'third', false)) v(seq, \"table\", description, reverted)")
def workspace_log(spark: SparkSession, d: str) -> DataFrame:
    """A session's own log: three changes, of which the second was taken back by its number."""
    w, s = _session(spark, d)
    for name, text in (("part", "first"), ("part", "second"), ("nation", "third")):
        w.apply(w.preview(s, name, w.sessions[s].tables[name], text))
    w.revert(s, 1)  # refused: a later change has the same table
    w.revert(s, 2)
    kept = F.col("seq").isin(*(u[0] for u in w.sessions[s].undo))
    return w.changes(s).withColumn("reverted", ~kept)


_KINDS: dict[str, int] = {}
for _row in registry.CATALOGUE:
    _KINDS[_row[2]] = _KINDS.get(_row[2], 0) + 1


@query("server_info", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({n} AS BIGINT))" for k, n in _KINDS.items()) + ") v(kind, n)")
def server_info(spark: SparkSession, d: str) -> DataFrame:
    """How many capabilities of each kind there are."""
    return registry.counts(spark)


@query("server_heartbeat", "SELECT true AS alive")
def server_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    return registry.heartbeat(spark).select("alive")


@query("server_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}', '{k}')" for c, n, k, *_ in sorted(registry.CATALOGUE)[20:50]) + ") v(category, capability, kind)")
def server_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """A page of the catalogue."""
    return registry.catalogue(spark, 20, 30).select("category", "capability", "kind")


# Analyses behind refactorings.
_FLOW = """WITH v AS (SELECT user_id AS body, event_id % 11 AS local, event_id AS pos, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS event FROM events),
g AS (SELECT body, local, bool_or(pos BETWEEN 300 AND 700) AS seen, bool_or(event = 'write' AND pos < 300) AS before, min(pos) FILTER (event = 'read' AND pos BETWEEN 300 AND 700) AS r, min(pos) FILTER (event = 'write' AND pos BETWEEN 300 AND 700) AS w,
bool_or(event = 'read' AND pos > 700) AS after, bool_and(pos BETWEEN 300 AND 700) AS inside FROM v GROUP BY body, local)
SELECT body, local, before AND r IS NOT NULL AND (w IS NULL OR r <= w) AS flows_in, w IS NOT NULL AND after AS flows_out, inside FROM g WHERE seen"""


def _flow(spark: SparkSession, d: str) -> DataFrame:
    event = F.when(F.col("event_type") == "purchase", "write").otherwise("read")
    return dead.data_flow(table(spark, d, "events").select(F.col("user_id").alias("body"), (F.col("event_id") % 11).alias("local"), event.alias("event"), F.col("event_id").alias("at")), 300, 700)


@query("data_flow", _FLOW)
def data_flow(spark: SparkSession, d: str) -> DataFrame:
    """What flows through a span of events."""
    return _flow(spark, d)


@query("extract_method_preview", f"SELECT body, string_agg('v' || local, ',' ORDER BY local) FILTER (flows_in) AS parameters, string_agg('v' || local, ',' ORDER BY local) FILTER (flows_out) AS results, count(*) FILTER (inside) AS locals FROM ({_FLOW}) GROUP BY body")
def extract_method_preview(spark: SparkSession, d: str) -> DataFrame:
    """Parameters, results and own variables of the method that each body's span would become."""

    def named(which: str):
        return F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(which), F.col("local")))), lambda k: F.concat(F.lit("v"), k.cast("string"))), ","), F.lit(""))

    return _flow(spark, d).groupBy("body").agg(named("flows_in").alias("parameters"), named("flows_out").alias("results"), F.count_if("inside").alias("locals"))


@query("symbol_outline", f"""WITH RECURSIVE {_TREE_SQL}, r(node, depth) AS (SELECT child, 1 FROM edges WHERE parent = 'r2' UNION ALL SELECT e.child, depth + 1 FROM r JOIN edges e ON e.parent = r.node WHERE depth < 2)
SELECT depth, count(DISTINCT node) AS nodes, min(node) AS first, max(node) AS last FROM r GROUP BY depth""")
def symbol_outline(spark: SparkSession, d: str) -> DataFrame:
    """One region's nations and their suppliers, by depth."""
    return graph.outline(_tree(spark, d), "r2", 2)


_CANONICAL = "trim(regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query("duplicated_code", f"SELECT substr(sha256({_CANONICAL}), 1, 16) AS hash, count(*) AS members, CAST(max(length({_CANONICAL})) AS BIGINT) AS lines, min(doc_id) AS first FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE length({_CANONICAL}) >= 20 GROUP BY 1 HAVING count(*) >= 2")
def duplicated_code(spark: SparkSession, d: str) -> DataFrame:
    """Lines that differ in case, numbers and blanks only, of 20 characters or more, as fragments of code."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n", -1)).alias("text"))
    form = canonical(F.col("text"))
    return dead.duplicates(lines, form, F.length(form).cast("long"), least_lines=20)


@query("extract_shared_expression", """SELECT substr(sha256(s), 1, 16) AS hash, count(*) AS members, max(length(s))::BIGINT AS lines, min(doc_id) AS first FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS s FROM documents) WHERE length(s) >= 40 GROUP BY s HAVING count(*) >= 2""")
def extract_shared_expression(spark: SparkSession, d: str) -> DataFrame:
    """Equal lines of 40 characters or more that occur twice or more."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n", -1)).alias("s"))
    return dead.duplicates(lines, F.trim("s"), F.length(F.trim("s")).cast("long"), least_lines=40)


@query("change_signature_preview", """WITH s AS (SELECT conv_id, turn, CASE turn WHEN 0 THEN 'declaration' ELSE 'call' END AS kind, CASE WHEN turn % 2 = 0 THEN ['a', 'b'] ELSE ['b', 'd'] END AS names FROM conversations)
SELECT kind, conv_id || ':' || turn AS site, CASE WHEN list_contains(names, 'a') THEN '+c -b' ELSE '+c,a -b,d' END AS edit FROM s""")
def change_signature_preview(spark: SparkSession, d: str) -> DataFrame:
    """Each declaration's and call's own edit for a new list of parameters."""
    turn = F.col("turn")
    names = F.when(turn % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("d")))
    sites = table(spark, d, "conversations").select(F.when(turn == 0, "declaration").otherwise("call").alias("kind"), F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")).alias("site"), names.alias("names"))
    return rewrites.shared_edits(sites, ["c", "a"])


_MEMBERS = "(SELECT p_brand AS type, p_name AS member, p_type AS kind, p_size > 20 AS public FROM part)"
_INTERFACE = f"""WITH m AS {_MEMBERS}, p AS (SELECT type, count(*) AS members, string_agg(DISTINCT kind || ' ' || member, '; ' ORDER BY kind || ' ' || member) AS signatures FROM m WHERE public GROUP BY type),
u AS (SELECT p_brand AS type, p_name AS member FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49),
n AS (SELECT type, count(*) AS uses, count(*) FILTER (EXISTS (SELECT 1 FROM m WHERE m.public AND m.type = u.type AND m.member = u.member)) AS rewritable FROM u GROUP BY type)
SELECT p.type, members, signatures, coalesce(uses, 0) AS uses, coalesce(rewritable, 0) AS rewritable FROM p LEFT JOIN n ON p.type = n.type"""


@query("extract_interface_preview", _INTERFACE)
def extract_interface_preview(spark: SparkSession, d: str) -> DataFrame:
    """Brands as types, their parts as members, those over a size public; lines as uses."""
    parts = table(spark, d, "part")
    members = parts.select(F.col("p_brand").alias("type"), F.col("p_name").alias("member"), F.col("p_type").alias("kind"), (F.col("p_size") > 20).alias("public"))
    uses = table(spark, d, "lineitem").filter("l_quantity >= 49").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("type"), F.col("p_name").alias("member"))
    return rewrites.extracted_interface(members, uses)


@query("change_type_namespace", """WITH r AS (SELECT l_orderkey AS file, 'Brand' AS namespace, p_size > 20 AS moving FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#3'),
i AS (SELECT l_orderkey AS file, CASE l_returnflag WHEN 'R' THEN 'Brand' WHEN 'A' THEN 'New' ELSE 'Other' END AS namespace FROM lineitem),
o AS (SELECT file, count(*) FILTER (moving) AS sites, count(*) FILTER (NOT moving) AS stays FROM r GROUP BY file), h AS (SELECT file, bool_or(namespace = 'Brand') AS old, bool_or(namespace = 'New') AS new FROM i GROUP BY file)
SELECT file, sites, CASE WHEN coalesce(new, false) THEN 'none' WHEN coalesce(old, false) AND stays = 0 THEN 'swap' ELSE 'add' END AS edit FROM o LEFT JOIN h USING (file) WHERE sites > 0""")
def change_type_namespace(spark: SparkSession, d: str) -> DataFrame:
    """Large parts of a brand move to a new namespace; orders are the files that use them, return flags their imports."""
    parts = table(spark, d, "part").filter("p_brand = 'Brand#3'").select("p_partkey", "p_size")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    refs = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("file"), F.lit("Brand").alias("namespace"), (F.col("p_size") > 20).alias("moving"))
    flag = F.col("l_returnflag")
    imports = lines.select(F.col("l_orderkey").alias("file"), F.when(flag == "R", "Brand").when(flag == "A", "New").otherwise("Other").alias("namespace"))
    return rewrites.relocated(refs, imports, "Brand", "New")


@query("split_class_preview", "SELECT CASE WHEN p_size < 10 THEN 'Parts.Small.cs' ELSE p_brand END AS path, count(*) AS members, CAST(sum(length(p_name)) AS BIGINT) AS chars FROM part GROUP BY 1")
def split_class_preview(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    return rewrites.split(parts.select(F.col("p_partkey").alias("member"), F.col("p_brand").alias("path"), F.length("p_name").cast("long").alias("chars")), parts.filter("p_size < 10").select(F.col("p_partkey").alias("member")), "Parts.Small.cs")


@query("extract_interface_cross_project", "SELECT n_nationkey, n_regionkey, n_regionkey <> 1 AS needs_reference FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def extract_interface_cross_project(spark: SparkSession, d: str) -> DataFrame:
    """Nations whose suppliers use an interface that moves to region 1, and whether they need a reference to it."""
    users = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    present = table(spark, d, "nation").select("n_nationkey", "n_regionkey").join(users, "n_nationkey", "left_semi")
    has = changes.conflicts(present, spark.createDataFrame([(1,)], "n_regionkey int"), ["n_regionkey"]).select("n_nationkey", F.lit(True).alias("has"))
    return present.join(has, "n_nationkey", "left").select("n_nationkey", "n_regionkey", F.col("has").isNull().alias("needs_reference"))


@query("dependency_inversion", "SELECT CASE l_returnflag WHEN 'R' THEN 'keep' ELSE 'use IPart' END AS action, count(DISTINCT l_orderkey) AS files, count(*) AS sites FROM lineitem WHERE l_partkey = 5 GROUP BY 1")
def dependency_inversion(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "construction").otherwise("parameter")
    return rewrites.inverted(table(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("file"), kind.alias("kind")), 5, "IPart")


@query("extract_and_wire_interface", "SELECT CASE user_id WHEN 7 THEN 'I7' ELSE CAST(user_id AS VARCHAR) END AS service, event_id AS ord, CASE user_id WHEN 7 THEN '7' END AS was FROM events WHERE event_type = 'purchase'")
def extract_and_wire_interface(spark: SparkSession, d: str) -> DataFrame:
    """Registrations (purchases) of one service (user) put under its interface."""
    rows = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("service"), F.col("event_id").alias("ord"))
    return rewrites.rewired(rows, "7", "I7")


_FIXES = [("error", "wrap"), ("error", "rethrow"), ("purchase", "audit")]


@query("code_actions", """SELECT event_id AS place, event_type AS rule, action, fix FROM events JOIN (VALUES ('error', 0, 'rethrow'), ('error', 1, 'wrap'), ('purchase', 0, 'audit')) f(rule, action, fix) ON event_type = f.rule WHERE value > 90""")
def code_actions(spark: SparkSession, d: str) -> DataFrame:
    """Fixes that a catalogue has for diagnostics, numbered."""
    rows = table(spark, d, "events").filter("value > 90").select(F.col("event_id").alias("place"), F.col("event_type").alias("rule"))
    return diagnostics.fixes(rows, spark.createDataFrame(_FIXES, "rule string, fix string"))


@query("code_action_at", "SELECT event_id AS place, event_type AS rule, 'wrap' AS fix FROM events WHERE event_type = 'error' AND event_id = (SELECT min(event_id) FROM events WHERE event_type = 'error')")
def code_action_at(spark: SparkSession, d: str) -> DataFrame:
    """The second fix of the first error."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("place"), F.col("event_type").alias("rule"))
    place = rows.filter("rule = 'error'").agg(F.min("place")).first()[0]
    return diagnostics.fix_at(rows, spark.createDataFrame(_FIXES, "rule string, fix string"), place, 1)


@query("symbol_relationships", """SELECT 'definition' AS kind, count(*) AS affected FROM part WHERE p_partkey = 9 UNION ALL SELECT 'references', count(DISTINCT l_orderkey || ':' || l_linenumber) FROM lineitem WHERE l_partkey = 9
UNION ALL SELECT 'suppliers', count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = 9 UNION ALL SELECT 'siblings', count(*) FROM part WHERE p_partkey <> 9 AND p_brand = (SELECT p_brand FROM part WHERE p_partkey = 9)""")
def symbol_relationships(spark: SparkSession, d: str) -> DataFrame:
    parts, lines = table(spark, d, "part"), table(spark, d, "lineitem").filter("l_partkey = 9")
    own = parts.filter("p_partkey = 9")
    return graph.impact({
        "definition": own.select(F.col("p_partkey").alias("id")),
        "references": lines.select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id")),
        "suppliers": lines.select(F.col("l_suppkey").alias("id")),
        "siblings": parts.filter("p_partkey <> 9").join(own.select("p_brand"), "p_brand", "left_semi").select(F.col("p_partkey").alias("id")),
    })


_SPANS = "(SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT AS hi, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT - length(text) AS lo FROM conversations)"


@query("probe_position", f"SELECT conv_id AS point_id, turn || ':' || role AS span_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY hi - lo, turn || ':' || role) AS rn FROM {_SPANS} WHERE lo < 700 AND 700 < hi) WHERE rn = 1")
def probe_position(spark: SparkSession, d: str) -> DataFrame:
    """The turn strictly inside which character 700 of each conversation lies; at a bound, none."""
    from pyspark.sql.window import Window

    turns = table(spark, d, "conversations")
    hi = F.sum(F.length("text").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0))
    spans = turns.select(F.concat_ws(":", F.col("turn").cast("string"), "role").alias("span_id"), F.col("conv_id").alias("scope"), hi.alias("end"), (hi - F.length("text") + 1).alias("lo"))
    points = turns.select(F.col("conv_id").alias("point_id"), F.col("conv_id").alias("scope"), F.lit(700).cast("long").alias("at")).distinct()
    return lookup.enclosing(points, spans.select("span_id", "scope", "lo", (F.col("end") - 1).alias("hi")).filter("lo <= hi"))


@query("impact_sweep", """WITH x AS (SELECT 'reference' AS category, l_orderkey AS id FROM lineitem WHERE l_partkey = 11 UNION ALL SELECT 'callsite', o_orderkey FROM orders WHERE o_custkey = 11 UNION ALL SELECT 'mapper', p_partkey FROM part WHERE regexp_matches(p_name, '(ring|gear)$'))
SELECT category, id, n AS total FROM (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM x) WHERE rn <= 5""")
def impact_sweep(spark: SparkSession, d: str) -> DataFrame:
    """At most five of each category, beside totals from before that cut."""
    return graph.sweep({
        "reference": table(spark, d, "lineitem").filter("l_partkey = 11").select(F.col("l_orderkey").alias("id")),
        "callsite": table(spark, d, "orders").filter("o_custkey = 11").select(F.col("o_orderkey").alias("id")),
        "mapper": table(spark, d, "part").filter(F.col("p_name").rlike("(ring|gear)$")).select(F.col("p_partkey").alias("id")),
    }, 5)


@query("source_generated_documents", "SELECT min(page_id) AS page_id, url FROM pages WHERE contains(url, '?') GROUP BY url ORDER BY url LIMIT 500")
def source_generated_documents(spark: SparkSession, d: str) -> DataFrame:
    """Generated documents, once for each path, at most 500."""
    made = table(spark, d, "pages").filter(F.col("url").contains("?")).select("page_id", "url")
    return lookup.preferred(made, ["url"], [F.col("page_id")]).orderBy("url").limit(500)


@query("workspace_resources", "SELECT 'diagnostics' AS resource, count(*) AS n FROM (SELECT 1 FROM events WHERE event_type IN ('error', 'purchase') LIMIT 500) UNION ALL SELECT 'lines', count(*) FROM (SELECT len(string_split(text, chr(10))) AS n FROM documents) WHERE n >= 2 UNION ALL SELECT 'projects', count(DISTINCT n_regionkey) FROM nation")
def workspace_resources(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of what a session shows as resources: diagnostics from warnings up (500 at most), texts that have lines 2 to 5, projects."""
    severity = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "purchase", "Warning").otherwise("Info")
    found = diagnostics.diagnostics(table(spark, d, "events").select(severity.alias("severity")), "Warning").limit(500)
    slices = changes.text_slice(search.lines_of(table(spark, d, "documents"), "doc_id", "text"), 2, 5)
    projects = graph.neighbours(table(spark, d, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst")))
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("resource"), "n") for k, df in (("diagnostics", found), ("lines", slices), ("projects", projects))))
