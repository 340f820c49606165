import duckdb
import pytest
from pyspark.sql import functions as F

from rillwork.llm import hosts, sql
from rillwork.llm.queries import URL_RULES

URLS = [
    "http://A.Example.NET/en/x?y#z", "http://net/", "http://net", "https://xnet/", "http://b.net?q", "ftp://example.com/de/1", "http://EXAMPLE.com/fr/", "x://org/fr/", "x://a.b.org/fr",
    "http://u:p@h1.example.org:8080/", "http://10.0.0.1/x", "http://10.0.0.1:80/y", "http://[::1]:80/", "http://new.example.org/", "http://z.example.zz/", "no scheme", "", None, "a://b://c/d", "http:///path", "http://é.NET/ä", "line\nhttp://h.net/\n#x", "http://h.net:80/", "http://example.net/en", "http://sub.example.net/en/a",
]


@pytest.fixture
def tables(spark):
    pages = [(i, u, "html") for i, u in enumerate(URLS)] + [(3, "http://net/", None), (None, "http://b.org/", "x")]
    pages += [(100 + i, f"http://h{i % 4}.example.org/p{i}", "x") for i in range(80)]
    labels = [(100 + i, 0 if i % 4 == 1 or i % 9 == 0 else 1, 1 if i % 8 == 5 else 0) for i in range(80)] + [(100, None, None), (101, 0, None), (None, 0, 1), (3, 1, 1)]
    return (spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("bound", F.lit(1)),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def outcomes(labels):
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def test_as_the_sql(tables):
    pages, labels = tables
    got = hosts.judge_urls(pages, outcomes(labels), URL_RULES, unlabelled=True)
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    con.register("labels", labels.toArrow())
    want = con.execute(sql.HOST_REPUTATION).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {"allow", "block"} == {r.verdict for r in got.filter("rule IS NULL").collect()}


def test_empty_tables(tables):
    pages, labels = tables
    assert hosts.judge_urls(pages.limit(0), outcomes(labels), URL_RULES).count() == 0
    rows = hosts.judge_urls(pages, outcomes(labels.limit(0)), URL_RULES).collect()
    assert len(rows) == pages.count() and all(r.bound is None for r in rows)


def test_hosts_without_labels_lean_on_their_domain(spark):
    urls = [(i, f"http://h{i % 4}.bad.zz/p{i}") for i in range(400)] + [(400 + i, f"http://h{i % 4}.good.zz/p{i}") for i in range(400)]
    urls += [(800 + i, f"http://h{i % 4}.fine.yy/p{i}") for i in range(400)]
    new = [(2000, "http://new.bad.zz/"), (2001, "http://new.good.zz/"), (2002, "http://x.other.zz/"), (2003, "http://x.other.xx/"), (2004, "http://new.fine.yy/")]
    pages = spark.createDataFrame(urls + new, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 400)) for i, _ in urls], "page_id long, bad int")
    got = {r.page_id: r for r in hosts.judge_urls(pages, labels, [], unlabelled=True).collect()}
    kept = {r.page_id: r for r in hosts.judge_urls(pages, labels, []).collect()}
    assert all(got[i] == kept[i] for i, _ in urls) and all(kept[i].bound is None for i, _ in new)
    assert got[2000].verdict == "block" and got[2001].verdict == got[2004].verdict == "allow"
    # by hand: prior weights and means of the three levels
    clip = lambda rate, groups: max(1.0, min(10000.0, weight(rate, groups)))

    def weight(rate, groups):
        n, bad = sum(n for n, _ in groups), sum(b for _, b in groups)
        between = (sum(b * b / k for k, b in groups) - bad * bad / n - (len(groups) - 1) * rate * (1 - rate)) / (n - sum(k * k for k, _ in groups) / n)
        return rate * (1 - rate) / between - 1 if between > 0 else 10000.0

    rate = 400.5 / 1201
    w_suffix, w_domain = clip(rate, [(800, 400), (400, 0)]), clip(rate, [(400, 400), (400, 0), (400, 0)])
    w_host = clip(rate, [(100, 100)] * 4 + [(100, 0)] * 8)
    zz = (400 + w_suffix * rate) / (800 + w_suffix)
    for page, mean in ((2000, (400 + w_domain * zz) / (400 + w_domain)), (2002, zz), (2003, rate)):
        assert abs(got[page].bound - (mean - 1.64 * (mean * (1 - mean) / (w_host + 1)) ** 0.5)) < 2e-6


def test_no_labels_at_all_block_nothing(tables):
    pages, labels = tables
    rows = hosts.judge_urls(pages, outcomes(labels.limit(0)), [], unlabelled=True).collect()
    assert rows and all(r.verdict == "allow" and r.bound is None for r in rows)


def test_parts_of_hosts(spark):
    hosts_given = {"h.net:80": ("h.net", "net"), "u:p@a.b.org:8080": ("b.org", "org"), "10.0.0.1": ("10.0.0.1",) * 2, "10.0.0.1:80": ("10.0.0.1",) * 2,
                   "[::1]:80": ("[::1]",) * 2, "net": ("net", "net"), "": ("", ""), "1.2.3.org": ("3.org", "org")}
    df = spark.createDataFrame([(h,) for h in hosts_given], "host string")
    got = df.select("host", hosts.domain_of(F.col("host")), hosts.suffix_of(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == hosts_given
