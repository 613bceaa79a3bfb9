import numpy as np

from lattica.llm import urls


def judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
        if fits:
            return host, path, *max(fits)[1:]
    return host, path, None, urls.DEFAULT


def test_against_plain_rules(spark):
    import random

    r = random.Random(2)
    parts = ["net", "Example.NET", "a.example.net", "example.com", "www.example.com", "org", "x.org", "xnet", "", "examplé.net"]
    tails = ["", "/", "/en/", "/en/x", "/de/1?x#y", "?q=/en/", "#/fr/", "/fr/", "/fr", "//en/", "/EN/"]
    rows = [(k, r.choice(["http://", "https://", "://", "", "x://y://"]) + r.choice(parts) + r.choice(tails)) for k in range(400)] + [(900, None), (None, "http://net/"), (901, ""), (5, "http://a.net/"), (5, "http://a.net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("page_id", "url", "1 as host", "2 as rule")
    got = sorted(map(str, urls.filter_urls(df, urls.rule_table(spark)).collect()))
    from pyspark.sql import Row

    assert got == sorted(str(Row(page_id=i, host=x[0], path=x[1], rule=x[2], verdict=x[3])) for i, u in rows for x in [judge(u, urls.RULES)])


def test_long_list_and_empty_list(spark):
    many = tuple((f"h{k}.example/", "block") for k in range(3000)) + (("h7.example/", "allow"), ("bare", "block"))
    df = spark.createDataFrame([(k, f"http://w.h{k}.example/p") for k in range(0, 6000, 3)] + [(-1, "http://bare")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, urls.rule_table(spark, many)).collect()}
    assert got == {k: "block" if k < 3000 else "allow" for k in got}
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r["verdict"] for r in urls.filter_urls(df, none).collect()} == {"allow"}
    assert urls.filter_urls(df.limit(0), urls.rule_table(spark)).count() == 0


def test_filter_has_no_false_negatives(spark):
    hashes = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 20000)
    data = urls.bloom(spark.createDataFrame([(int(h),) for h in hashes[:10000]], "h long"))
    assert urls.may_hold(data, hashes[:10000]).all()
    assert urls.may_hold(data, hashes[10000:]).mean() < 0.01
