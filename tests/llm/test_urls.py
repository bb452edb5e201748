import re

from pyspark.sql import functions as F

from rasterlake.llm import urls as U
from rasterlake.llm.queries import op4_urls

from .conftest import SF


# the rules of the query, spelled out here so that the module's own cannot vouch for themselves
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h) + len(p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_query_against_a_plain_loop(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op4_urls(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        host, path, (verdict, rule) = parts(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_rules_and_parts_of_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x", "a://b://c/en/", "http://com/en/x", "http://xcom/en/", "http://a.net", "http://a.net?/", "http://a.net/#/", "x://example.net/de/8", "x://éÀ.org/es/é?q#f", "x\n://a\n.net/\nb", "http://user@h.com:80/en/", "http://h.net:80/", "http://a.net/de/1", "http://example.net/de/9", "http://long.com/" + "a/" * 30000, "http://a.net/de/1"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = U.judge(df, U.labelled(df)).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, (verdict, rule) = parts(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow")
    assert U.judge(df.limit(0), U.labelled(df.limit(0))).count() == 0


def test_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    train, test = pages.filter("page_id % 2 = 0"), pages.filter("page_id % 2 = 1")
    rows = U.judge(test, U.labelled(train), rules=()).join(U.labelled(test).withColumn("host", U.host_of(F.col("url"))).select("host", "label").distinct(), "host").collect()
    bad = [r.verdict == "block" for r in rows if r.label]
    assert bad and sum(bad) / len(bad) > 0.95
    good = [r.verdict == "allow" for r in rows if not r.label]
    assert sum(good) / len(good) > 0.99


def test_one_url_with_most_rows_leaves_the_others_their_labels(spark):
    urls = [f"http://{'casino.deal' if i % 2 else 'www.site'}{i % 40}.info/p{i}" for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    often = df.orderBy(F.xxhash64("url", F.lit(4)), "url").first().url
    many = df.unionByName(spark.range(U.SAMPLE).select((F.col("id") + 1000).alias("page_id"), F.lit(often).alias("url")))
    got = U.judge(df, U.labelled(many), rules=()).collect()
    assert len(got) == 1000 and all((r.verdict == "block") == ("casino" in r.host) for r in got)
    # every row counts for its suffix
    hosts = [parts(r.url)[0] for r in many.collect()]
    count = {r.suffix: (r.of_suffix, r.bad_of_suffix) for r in U.fit(U.labelled(many))[1].collect()}
    assert count == {"info": (len(hosts), sum("casino" in h for h in hosts))}


def test_domains_that_were_never_labelled(spark):
    """Of each domain either no URL is learned from or none is judged."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").withColumn("even", F.pmod(F.xxhash64(F.regexp_extract(U.host_of(F.col("url")), r"([^.]+\.[^.]+\.[^.]+)$", 1)), F.lit(2)) == 0)
    rows = U.judge(pages.filter("even"), U.labelled(pages.filter("not even")), rules=()).select("host", "verdict").distinct().collect()
    bad = [r.verdict == "block" for r in rows if set(re.split("[.-]", r.host)) & set(U.BAD_WORDS)]
    good = [r.verdict == "allow" for r in rows if not set(re.split("[.-]", r.host)) & set(U.BAD_WORDS)]
    assert bad and sum(bad) / len(bad) > 0.9 and sum(good) / len(good) > 0.98
