"""Search over texts and symbols: patterns, predicates in words, known calls."""

from __future__ import annotations

import html
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.shared import written
from factloom.functions.text import snippet

#: Patterns of scopes of tokens (fixed values, in the subset that all dialects share).
SCOPES = {"identifiers": r"[A-Za-z]+", "numbers": r"[0-9]+", "urls": r"https?://[^ ]+"}
#: Words that a search in words passes over (fixed values).
STOP_WORDS = ("a", "all", "and", "are", "find", "for", "in", "is", "of", "or", "that", "the", "to", "which", "with")


def lines_of(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """Rows (id, line, text) of the lines of each text, numbered from 1."""
    cut = docs.select(F.col(id_col).alias("id"), *keep, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "text"))
    return cut.select("id", *keep, (F.col("pos") + 1).cast("long").alias("line"), "text")


def grep(lines: DataFrame, pattern: str, scope: str | None = None, limit: int = 500) -> DataFrame:
    """Lines with a token of the scope in which a pattern is found (id, line, snippet), in order of place.

    Without a scope, or with ``all``, the whole line is searched.
    """
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    text = F.col("text")
    if scope and scope.lower() != "all":
        found = F.exists(F.regexp_extract_all(text, F.lit(SCOPES[scope.lower()]), F.lit(0)), lambda t: t.rlike(pattern))
    else:
        found = text.rlike(pattern)
    return lines.filter(found).select("id", "line", snippet(text).alias("snippet")).orderBy("id", "line").limit(limit)


#: Kinds of tokens of the scopes of a search (fixed values).
TOKEN_SCOPES = {"identifiers": ("identifier",), "strings": ("string",), "comments": ("comment",), "all": ("identifier", "string", "comment")}


def grep_tokens(tokens: DataFrame, pattern: str, scope: str = "all", limit: int = 500) -> DataFrame:
    """Tokens of a scope in which a pattern is found (id, line, col, kind, snippet), in order of place, then limited.

    ``tokens``: id, line, col, kind (identifier, string, comment or other), text.
    """
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    hit = tokens.filter(F.col("kind").isin(*TOKEN_SCOPES[scope.lower()]) & F.col("text").rlike(pattern))
    return hit.select("id", "line", "col", "kind", snippet(F.col("text")).alias("snippet")).orderBy("id", "line", "col").limit(limit)


def parse_query(query: str, words: dict[str, Column]) -> tuple[list[Column], list[str]]:
    """Predicates that a query in words names, and what is left of it.

    ``words``: predicates by keyword.  ``more than N COLUMN`` is a predicate too.
    """
    text = html.unescape(query).lower()
    found: list[Column] = []
    for m in re.finditer(r"more than (\d+) (\w+)", text):
        found.append(F.col(m[2]) > int(m[1]))
    text = re.sub(r"more than \d+ \w+", " ", text)
    rest = []
    for token in re.findall(r"[a-z0-9_#]+", text):
        if token in words:
            found.append(words[token])
        elif token not in STOP_WORDS:
            rest.append(token)
    return found, rest


def semantic_search(symbols: DataFrame, query: str, words: dict[str, Column], limit: int = 50) -> DataFrame:
    """Symbols by predicates in words; else by name; else by any token (id, name, match_kind).

    The next way is used only where the one before finds nothing.
    """
    found, rest = parse_query(query, words)
    tiers: list[tuple[str, Column]] = []
    if found:
        tiers.append(("structured", reduce(lambda a, b: a & b, found)))
    if rest:
        tiers.append(("name-substring", F.lower("name").contains(" ".join(rest))))
        tiers.append(("token-or", reduce(lambda a, b: a | b, (F.lower("name").contains(t) for t in rest))))
    best = F.coalesce(*(F.when(p, F.lit(i)) for i, (_, p) in enumerate(tiers))) if tiers else F.lit(None).cast("int")
    ranked = symbols.withColumn("tier", best).filter("tier is not null")
    first = ranked.agg(F.min("tier").alias("first"))
    kind = reduce(lambda e, t: e.when(F.col("tier") == t[0], t[1][0]), enumerate(tiers), F.when(F.lit(False), ""))
    hits = ranked.join(F.broadcast(first), F.col("tier") == F.col("first"))
    return hits.select("id", "name", kind.alias("match_kind")).orderBy("id").limit(limit)


def known_calls(texts: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    """Occurrences of the calls of a table in texts (id, call, kind, n); ``table``: (call, kind), a bounded list."""
    counts = [F.struct(F.lit(c).alias("call"), F.lit(k).alias("kind"), F.floor((F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))) / len(c)).cast("long").alias("n")) for c, k in table]
    return texts.select("id", F.inline(F.array(*counts))).filter("n > 0")


def _grams(text: Column, sizes: list[int]) -> Column:
    """The different runs of so many characters of a text, from its characters and those some places on, in time that grows with its length."""
    chars = F.split(text, "")

    def of(n: int) -> Column:
        runs = chars
        for k in range(1, n):
            runs = F.zip_with(runs, F.slice(chars, k + 1, F.length(text)), lambda x, y: F.concat(x, y))
        return F.filter(runs, lambda x: F.length(x) == n)  # what begins too late is null

    return F.array_distinct(F.concat(*(of(n) for n in sizes)))


def holding(texts: DataFrame, terms: DataFrame, q: int = 3) -> DataFrame:
    """Which text holds which term as a substring (id, term), each pair once, for any number of terms.

    ``texts``: id, text; ``terms``: term.  An index of q-grams: each term is
    looked up by the one of its grams that fewest texts have, and what that
    finds is checked by ``contains``.  Terms shorter than a gram are runs of
    characters themselves and joined with those.  Null and empty terms are in
    no text; case counts.  The index has a row for each gram of each text, so
    ``id`` should be small.  It and the texts are merged, never broadcast: a
    file of them can be a hundredth of what they take in memory.
    """
    wanted = written(terms.select("term").filter("term <> ''").distinct(), "terms")
    long, short = wanted.filter(F.length("term") >= q), wanted.filter(F.length("term") < q)
    of_term = long.select("term", F.explode(_grams(F.col("term"), [q])).alias("gram"))
    rows = texts.select("id", "text").filter("text is not null")
    grams = rows.select("id", F.explode(_grams(F.col("text"), [q])).alias("gram"))
    index = written(grams.join(of_term.select("gram").distinct(), "gram", "left_semi"), "grams")
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    # A term with a gram that no text has is in none, and goes here.
    best = of_term.join(often, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b")).filter("b.n > 0")
    maybe = index.hint("merge").join(best.select("term", F.col("b.gram").alias("gram")), "gram").select("id", "term")
    found = rows.hint("merge").join(maybe, "id").filter(F.col("text").contains(F.col("term"))).select("id", "term")
    if q > 1:
        runs = rows.select("id", F.explode(_grams(F.col("text"), list(range(1, q)))).alias("term"))
        found = found.unionByName(runs.join(short, "term", "left_semi").select("id", "term"))
    # Dealt by text, which also serves what is then gathered for each text.
    return found.repartition("id").distinct()
