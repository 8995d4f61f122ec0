import pytest
from pyspark.sql import functions as F

from factloom.llm import urlrep
from factloom.llm.queries import URL_RULES


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        ("http://WWW.Example.org/en/12?x#y", "www.example.org", "/en/12", "example.org/en/1"),
        ("https://a.b.com/fr/1", "a.b.com", "/fr/1", "com/fr/"),
        ("https://com/de/", "com", "/de/", "com/de/"),
        ("https://example.org", "example.org", "", None),
        ("https://example.org?q=/es/", "example.org", "", None),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/"),
        ("https://example.org/es/x", "example.org", "/es/x", "example.org/es/"),
        ("//no-scheme/x", "", "", None),
        ("a://b://c/d", "b:", "//c/d", None),
        ("ÄHTTP://ÄB.ORG/x\ny", "Äb.org", "/x\ny", "org/"),
        ("", "", "", None),
        (None, "", "", None),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    h, p = urlrep.host_of(F.col("url")), urlrep.path_of(F.col("url"))
    assert tuple(df.select(h, p, urlrep.rule_of(h, p, URL_RULES)).first()) == (host, path, rule)


def plain_reputations(counts):
    """The hierarchy of beta-binomial posteriors in plain Python; counts: {host: (n, x)}."""
    def strength(rows):
        a = sum((x - n * m) ** 2 for n, x, m in rows)
        b = sum(n * m * (1 - m) for n, x, m in rows)
        c = sum(n * (n - 1) * m * (1 - m) for n, x, m in rows)
        return 1 / min(max((a - b) / c if c else 0.5, 0.001), 0.5) - 1

    def dom(h):
        return ".".join(h.split(".")[-2:])

    def suf(h):
        return h.split(".")[-1]

    def grouped(f):
        out = {}
        for h, (n, x) in counts.items():
            a, b = out.get(f(h), (0, 0))
            out[f(h)] = (a + n, b + x)
        return out

    n, x = map(sum, zip(*counts.values()))
    m0 = (x + 0.5) / (n + 1)
    s = grouped(suf)
    k = strength([(n, x, m0) for n, x in s.values()])
    ms = {h: (x + k * m0) / (n + k) for h, (n, x) in s.items()}
    d = grouped(dom)
    k = strength([(n, x, ms[suf(h)]) for h, (n, x) in d.items()])
    md = {h: (x + k * ms[suf(h)]) / (n + k) for h, (n, x) in d.items()}
    k = strength([(n, x, md[dom(h)]) for h, (n, x) in counts.items()])
    return {h: (k * md[dom(h)] + x, k * (1 - md[dom(h)]) + n - x) for h, (n, x) in counts.items()}


def test_reputation_blocks_bad_hosts_only(spark):
    pages, outcomes, counts, i = [], [], {}, 0
    for host, n, bad in (("bad.spam.net", 60, 54), ("good.fine.net", 400, 8), ("new.spam.net", 2, 1), ("tiny.other.info", 1, 1), ("unseen.other.info", 0, 0)):
        counts[host] = (n, bad)
        for k in range(n + 3):
            pages.append((i, f"http://{host}/{k}", "clash", 1.0))
            if k < n:
                outcomes.append((i, int(k < bad)))
            i += 1
    pages.append((None, None, "clash", 1.0))
    df = spark.createDataFrame(pages, "page_id long, url string, host string, alpha double")
    labels = spark.createDataFrame(outcomes + [(0, None)], "page_id long, bad int")
    got = urlrep.judge(df, labels, URL_RULES).collect()
    assert len(got) == len(pages)
    verdict = {r["host"]: r["verdict"] for r in got}
    assert verdict["bad.spam.net"] == "block" and verdict["good.fine.net"] == "allow" and verdict["tiny.other.info"] == "allow"
    split = df.select("page_id", urlrep.host_of(F.col("url")).alias("host"))
    rep = {r["host"]: (r["alpha"], r["beta"]) for r in urlrep.reputations(split, labels).collect()}
    want = plain_reputations(counts | {"": (0, 0)})
    for h, (a, b) in want.items():
        assert rep[h] == pytest.approx((a, b), rel=1e-6)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    assert urlrep.judge(pages, labels, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")] * 2, "page_id long, url string")
    assert [r["verdict"] for r in urlrep.judge(one, labels, []).collect()] == ["allow", "allow"]


def test_native(spark, small):
    from factloom.llm.queries import op6_url_filter

    plan = op6_url_filter(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_domains_of_a_suffix_table(spark):
    """Plain rules, wildcards and exceptions; addresses and hosts without dots are their own."""
    rules = spark.createDataFrame([("com",), ("gov.uk",), ("uk",), ("*.ck",), ("!www.ck",), ("CO.KR",), ("kr",), (None,)], "suffix string")
    want = {
        "www.tax.gov.uk": ("tax.gov.uk", "gov.uk"), "a.b.co.kr": ("b.co.kr", "co.kr"), "site.com": ("site.com", "com"), "com": ("com", "com"), "x.y.z.ck": ("y.z.ck", "z.ck"),
        "www.ck": ("www.ck", "ck"), "a.www.ck": ("www.ck", "ck"), "ck": ("ck", "ck"), "10.0.0.7": ("10.0.0.7", "10.0.0.7"), "[::1]": ("[::1]", "[::1]"), "": ("", ""), "a.b.unknown": ("b.unknown", "unknown"),
    }
    hosts = spark.createDataFrame([(h, 1) for h in want], "host string, rule int").drop("rule")
    assert {r["host"]: (r["domain"], r["suffix"]) for r in urlrep.registered(hosts, rules).collect()} == want
    plain = {r["host"]: (r["domain"], r["suffix"]) for r in urlrep.registered(hosts, None).collect()}
    assert plain["10.0.0.7"] == ("10.0.0.7", "10.0.0.7") and plain["site.com"] == ("site.com", "com")
    assert [r[0] for r in spark.createDataFrame([("u:p@a.b:80",), ("a.b",), ("a.b:",), ("10.0.0.7:8080",)], "h string").select(urlrep.site_of(F.col("h"))).collect()] == ["a.b", "a.b", "a.b", "10.0.0.7"]


def test_ports_and_users_share_a_reputation_and_planted_hosts_are_found(spark):
    """Of 60 hosts, those that are mostly bad and have labels enough are blocked on unlabelled pages too; none of the others is."""
    pages, outcomes, i = [], [], 0
    for h in range(60):
        bad = h % 6 == 0
        for k in range(80):
            host = f"h{h}.d{h % 10}.net" + (":8080" if k % 3 == 0 else "")
            pages.append((i, f"http://{'user@' if k % 5 == 0 else ''}{host}/{k}"))
            if k < 40:
                outcomes.append((i, int(k % 10 < (9 if bad else 1))))
            i += 1
    got = urlrep.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"), []).collect()
    blocked = {r["page_id"] for r in got if r["verdict"] == "block"}
    assert blocked == {p for p, _ in pages if (p // 80) % 6 == 0}
