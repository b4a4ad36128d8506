import random

from tests.llm import hard
from textloom.llm import url_rules
from textloom.llm.queries import URL_RULES
from textloom.llm.url_rules import filter_urls


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None, key=lambda x: x[:2])
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


RULES = [("block", "a.com", ""), ("allow", "b.a.com", "/x"), ("block", "b.a.com", "/x/y"), ("allow", "com", "/x/y/long/path"), ("block", "org", "/"), ("allow", "a.org", "/"), ("block", "com.org", "/q"), ("allow", "c.b.a.com", "")]


def urls(n=3000, seed=1):
    r = random.Random(seed)
    host = lambda: ".".join(r.choices(["a", "b", "c", "B", "xa", "com", "org", ""], k=r.randint(1, 5)))
    path = lambda: "".join(r.choices(["/", "x", "y", "/x/y", "/long/path", "?q", "#f", "://", "é", "\n"], k=r.randint(0, 5)))
    return [(r.choice(["http://", "://", "x", "https://A@"]) + host() + path()) for _ in range(n)] + [None, "", "://", "http://"]


def test_against_plain(spark):
    rows = list(enumerate(urls())) + [(7, "http://a.com/x"), (7, "http://a.com/x"), (None, "http://b.a.com/x/y")]
    df = spark.createDataFrame([(i, u, "h", "k") for i, u in rows], "page_id long, url string, host string, `key` string").repartition(5)
    for rules in (RULES, URL_RULES, []):
        got = sorted((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in filter_urls(df, rules).collect())
        want = sorted(((i or -1), h, p, x or "", v) for i, u in rows for h, p, x, v in [plain(u, rules)])
        assert got == want
    assert filter_urls(df.limit(0), RULES).count() == 0


def test_rules_in_several_sweeps(spark, monkeypatch):
    r = random.Random(4)
    rules = [(r.choice(["allow", "block"]), ".".join(r.choices(["a", "b", "c", "com", "org"], k=r.randint(1, 3))), "".join(r.choices(["/", "x", "y"], k=r.randint(0, 4)))) for _ in range(300)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    df = spark.createDataFrame(list(enumerate(urls(seed=6))), "page_id long, url string").repartition(3)
    one = sorted(map(tuple, filter_urls(df, rules).collect()))
    assert one == sorted((i, *plain(u, rules)) for i, u in enumerate(urls(seed=6)))
    monkeypatch.setattr(url_rules, "MOST_RULES", 40)
    assert sorted(map(tuple, filter_urls(df, rules).collect())) == one


def test_hard_urls(spark):
    """Clashing column names, repeated and null rows, very long urls, an empty table."""
    rows = hard.frame(spark).selectExpr("doc_id AS page_id", "concat('http://a.com/x', text) AS url", "fp AS host", "h AS path", "key", "th AS rule", "`row` AS verdict", "doc_id AS reach")
    rows = rows.unionByName(spark.createDataFrame([(900, "http://" + "b." * 30_000 + "a.com/" + "x" * 300_000), (901, "http://b.a.com/x" + "/y" * 100_000)], "page_id long, url string"), allowMissingColumns=True)
    out = filter_urls(rows, RULES)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(r.page_id, *plain(r.url, RULES)) for r in rows.collect()]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert filter_urls(rows.limit(0), RULES).count() == 0


def test_a_hot_host_is_spread(spark):
    df = spark.range(20_000).selectExpr("id AS page_id", "if(id % 3 = 0, concat('http://hot.com/', id), concat('http://h', id, '.com/')) AS url")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is too small to be kept apart
    spread = filter_urls(df, RULES).selectExpr("spark_partition_id() AS p", "host").where("host = 'hot.com'").groupBy("p").count().collect()
    assert len(spread) >= 2
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
