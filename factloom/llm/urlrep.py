"""URL filter: fixed rules first, then an empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted for each host, registered
domain and suffix.  Each level's bad rate is a beta-binomial posterior whose
prior is the level above: suffix under the global rate, domain under its
suffix, host under its domain.  The strength of each level's prior is fitted
by moments over all its members.  A host is blocked if the lower posterior
bound of its bad rate is over a limit, so a host with few labels is not
blocked on their account alone.

DataFrame functions only.  Counts are partial sums before any exchange, so a
host with a third of all pages is a few rows by then; the join that brings
reputations back to pages is a plain equi-join that adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import ASCII_LOWER, ASCII_UPPER, materialise

#: (verdict, host, path) of each rule.
Rule = tuple[str, str, str]

#: Suffixes of two labels under which domains are registered (fixed values).
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in")

#: Bounds of the correlation that gives a prior's strength: 1 to 999 pages.
RHO_LEAST, RHO_MOST = 0.001, 0.5


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (its text, host and path) that fits; null if none does.

    At most 1,000 rules: they are part of the expression.
    """
    if len(rules) > 1000:
        raise ValueError("at most 1,000 rules")
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p)) for _, h, p in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


#: A host without what comes before ``@`` and without its port, and a numeric address (both fixed values).
USER_OR_PORT, ADDRESS = r"^.*@|:[0-9]*$", r"^([0-9]+\.){3}[0-9]+$|^\["


def site_of(host: Column) -> Column:
    """The host that reputation is kept for: without user and port."""
    return F.regexp_replace(host, USER_OR_PORT, "")


def domain_of(site: Column) -> Column:
    """Registered domain: the last two labels, or three under a suffix of two; all of a numeric address."""
    last = F.substring_index(site, ".", -2)
    return F.when(site.rlike(ADDRESS), site).when(last.isin(*TWO_LABELS), F.substring_index(site, ".", -3)).otherwise(last)


def suffix_of(site: Column) -> Column:
    """Suffix: the last label, or two; all of a numeric address."""
    last = F.substring_index(site, ".", -2)
    return F.when(site.rlike(ADDRESS), site).when(last.isin(*TWO_LABELS), last).otherwise(F.substring_index(site, ".", -1))


def registered(sites: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """``sites`` (with a column host) and the domain and suffix of each.

    ``suffixes``: one column ``suffix`` of public suffix rules: plain ones,
    ``*.x`` for any label before x, and ``!y.x`` for an exception to that; a
    site that none fits has its last label.  Without it, suffixes of one label
    and those of ``TWO_LABELS`` are known.  Sites and rules meet in an
    equi-join of the sites' ends.
    """
    if suffixes is None:
        return sites.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    rules = suffixes.filter("suffix is not null").select(F.lower(F.trim("suffix")).alias("rule")).distinct()
    rules = rules.select("rule", F.regexp_replace("rule", r"^(\*\.|!)", "").alias("end"), F.when(F.col("rule").startswith("*."), 1).when(F.col("rule").startswith("!"), -1).otherwise(0).alias("more"))
    labels = F.split("host", r"\.")
    ends = sites.select("host", F.size(labels).alias("size"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("pos", "end"))
    # How many labels the suffix has: of an exception one less than its rule, else the most of any rule that fits.
    n = F.col("size") - F.col("pos")
    fits = ends.join(rules, "end").filter(n + F.col("more") <= F.col("size")).groupBy("host").agg(F.max(F.struct((F.col("more") == -1).alias("x"), (n + F.col("more")).alias("n"))).alias("best"))
    known = sites.join(fits, "host", "left")
    k = F.coalesce(F.col("best.n"), F.lit(1))

    def last(count: Column) -> Column:
        return F.when(F.col("host").rlike(ADDRESS), F.col("host")).otherwise(F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - count + 1), F.size(labels)), "."))

    return known.withColumns({"domain": last(k + 1), "suffix": last(k)}).drop("best")


def _strength(level: DataFrame) -> float:
    """Prior strength of a level with columns n, x and prior mean m."""
    n, x, m = F.col("n"), F.col("x"), F.col("m")
    exact = "decimal(28,9)"  # sums that don't depend on their order
    a, b, c = level.agg(
        F.sum(((x - n * m) * (x - n * m)).cast(exact)).cast("double"),
        F.sum((n * m * (1 - m)).cast(exact)).cast("double"),
        F.sum((n * (n - 1) * m * (1 - m)).cast(exact)).cast("double"),
    ).first()
    rho = (a - b) / c if c else RHO_MOST  # nothing to fit: a weak prior
    return 1 / min(max(rho, RHO_LEAST), RHO_MOST) - 1


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Rows (host, n, x, alpha, beta): labelled and bad pages and the posterior of each host.

    ``pages``: page_id and host (without user and port); ``outcomes``: page_id
    and bad (0, 1 or null for none); ``suffixes``: see ``registered``.  A page
    with a null id has no outcome; repeated rows of a page count each.
    """
    seen = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    hosts = materialise(registered(seen, suffixes), "url-hosts")
    total = hosts.agg(F.sum("n"), F.sum("x")).first()
    mean = ((total[1] or 0) + 0.5) / ((total[0] or 0) + 1.0)
    sums = (F.sum("n").alias("n"), F.sum("x").alias("x"))

    def posterior(level: DataFrame, k: float) -> Column:
        return (F.col("x") + k * F.col("m")) / (F.col("n") + k)

    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("m", F.lit(mean))
    suffixes = suffixes.select("suffix", posterior(suffixes, _strength(suffixes)).alias("m"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = domains.select("domain", posterior(domains, _strength(domains)).alias("m"))
    hosts = hosts.drop("suffix").join(domains, "domain")
    k = _strength(hosts)
    return hosts.select("host", "n", "x", (k * F.col("m") + F.col("x")).alias("alpha"), (k * (1 - F.col("m")) + F.col("n") - F.col("x")).alias("beta"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bad: float = 0.35,
    z: float = 1.645,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, n_labelled), one for each page.

    ``outcomes``: page_id and bad (1 if the page was judged bad, else 0; null
    if not judged).  A null url, or one without ``://``, has an empty host and
    path and is judged by the reputation of the empty host.  Repeated rows
    each get a row; without outcomes every host has the global prior.  User
    and port belong to the host that is returned and that rules fit, not to
    the one that reputation is kept for.
    """
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = reputations(split.select("page_id", site_of(F.col("host")).alias("host")), outcomes.select("page_id", "bad"), suffixes)
    a, b = F.col("alpha"), F.col("beta")
    low = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    by_host = known.select(F.col("host").alias("site"), F.col("n").alias("n_labelled"), F.when(low > max_bad, "block").otherwise("allow").alias("reputation"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    said = reduce(lambda e, r: e.when(F.col("rule") == r[1] + r[2], r[0]), rules, F.when(F.lit(False), "")).otherwise(F.col("reputation"))
    joined = split.withColumn("rule", rule).withColumn("site", site_of(F.col("host"))).join(by_host, "site", "left")
    return joined.select("page_id", "host", "path", "rule", said.alias("verdict"), "n_labelled")
