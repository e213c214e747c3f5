import re

from pyspark.sql import functions as F

from tracemark.llm import url_templates

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def parts(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else None
    if rest is None:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for r in RULES:
        domain, _, rest = r.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest) and len(r) > len(best or ""):
            best = r
    return best


URLS = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net/", "http://net", "http://anet/", "https://x.example.net/en/1?q=/de/", "http://example.net/en", "http://Example.COM/de/7#f",
        "http://b.org/fr/", "http://borg/fr/", "http://u:p@h.org:80/fr/x", "a://b://c/d", "http://É.net/", "http://x.net?y", "http://x.net#y/", "http://host//a//b/", "http://h/\n/x", "://y.net/z"]


def test_parts_and_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS)], "page_id long, url string, good int, template string")
    got = {r["page_id"]: r for r in url_templates.judge(pages, RULES).collect()}
    for i, u in enumerate(URLS):
        host, path = parts(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule(host, path)), u
        assert got[i]["verdict"] == (RULES[rule(host, path)] if rule(host, path) else "allow")


def test_templates_generalise_merge_and_reject(spark):
    rows = []
    for i in range(120):
        rows += [(f"http://a.com/shop/item/{i}", 1), (f"http://a.com/spam/{i}/buy.html", 0), (f"http://a.com/news/{i}", 1 if i % 7 else 0), (f"http://a.com/blog/{i}", 1 if i % 6 else 0)]
    rows += [("http://a.com/rare/1", None), ("http://b.com/spam/1/buy.html", None)]
    pages = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(rows)], "page_id long, url string, good int")
    got = {rows[r["page_id"]][0]: r for r in url_templates.judge(pages, {}).collect()}
    assert got["http://a.com/shop/item/5"]["template"] == "/shop/item/*"
    assert got["http://a.com/spam/5/buy.html"]["template"] == "/spam/*/buy.html"
    assert got["http://a.com/news/5"]["template"] == got["http://a.com/blog/5"]["template"] == "/blog|news/*"
    assert got["http://a.com/rare/1"]["template"] == "/*/*"
    verdicts = {u: r["verdict"] for u, r in got.items()}
    assert verdicts["http://a.com/spam/5/buy.html"] == "block" and verdicts["http://a.com/shop/item/5"] == "allow" and verdicts["http://b.com/spam/1/buy.html"] == "allow"


def test_small_sections_of_a_large_host_stay_apart(spark):
    """25 sections of 4% each, one of them bad; and 2,000 pages of one segment each, with 10 pages of a bad one among them."""
    urls = [(f"http://a.com/s{k}/{i}", int(k != 7)) for k in range(25) for i in range(40)]
    urls += [(f"http://b.com/{i}/x", 1) for i in range(2000)] + [(f"http://b.com/bad/{i}", 0) for i in range(10)]
    pages = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(urls)], "page_id long, url string, good int")
    for r in url_templates.judge(pages, {}).collect():
        url, good = urls[r["page_id"]]
        assert r["verdict"] == ("allow" if good else "block"), url
        if "a.com" in url:
            assert r["template"] == "/" + url.split("/")[3] + "/*"


def test_large_sections_merge_beside_any_number_of_others(spark):
    """Two like sections hold a third of a host each; the rest is 3 or 30 small ones."""
    urls = []
    for host, small in (("a.com", 3), ("b.com", 30)):
        urls += [(f"http://{host}/{side}/{i}", int(i % 7 > 0)) for side in ("blog", "news") for i in range(10 * small)]
        urls += [(f"http://{host}/s{k}/{i}", 1) for k in range(small) for i in range(10)]
    urls += [(f"http://a.com/more/{i}", 0) for i in range(700)]
    pages = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(urls)], "page_id long, url string, good int")
    got = {urls[r["page_id"]][0]: r["template"] for r in url_templates.judge(pages, {}).collect()}
    assert got["http://b.com/blog/1"] == got["http://b.com/news/2"] == "/blog|news/*"
    assert {got[f"http://b.com/s{k}/1"] for k in range(30)} == {f"/s{k}/*" for k in range(30)}
    assert got["http://a.com/blog/1"] == "/blog/*" and got["http://a.com/news/1"] == "/news/*" and got["http://a.com/more/1"] == "/more/*"


def test_any_number_of_like_sections_is_judged_together(spark):
    """60 sections of a host, each too small to merge by its share: four to six of ten pages are good, so together most are; one section has none."""
    urls = [(f"http://a.com/s{k}/{i}", int(i < (4 if k < 3 else 5 + k % 2))) for k in range(59) for i in range(10)] + [(f"http://a.com/bad/{i}", 0) for i in range(10)]
    pages = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(urls)], "page_id long, url string, good int")
    got = {urls[r["page_id"]][0].split("/")[3]: r for r in url_templates.judge(pages, {}).collect()}
    assert {s: r["template"] for s, r in got.items()} == {s: f"/{s}/*" for s in got} and len(got) == 60
    assert {s for s, r in got.items() if r["verdict"] == "block"} == {"bad"}
    assert len({r["purity"] for s, r in got.items() if s != "bad"}) == 1


def test_like_sections_with_unlike_parts_are_judged_apart(spark):
    """Two like sections, each with a good and a bad part of the same names, swapped."""
    urls = [(f"http://a.com/s{k}/{part}/{i}", int(part == "xy"[k % 2])) for k in range(30) for part in "xy" for i in range(30)]
    pages = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(urls)], "page_id long, url string, good int")
    for r in url_templates.judge(pages, {}).collect():
        assert r["verdict"] == ("allow" if urls[r["page_id"]][1] else "block")


def test_levels_follow_the_pages(spark):
    deep = "http://h/" + "/".join("abcdefghij")
    urls = [(f"{deep}/{side}/{i}", int(side == "good")) for side in ("good", "bad") for i in range(30)]
    pages = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(urls)], "page_id long, url string, good int")
    got = {(r["template"], r["verdict"]) for r in url_templates.judge(pages, {}).collect()}
    assert got == {("/a/b/c/d/e/f/g/h/i/j/good/*", "allow"), ("/a/b/c/d/e/f/g/h/i/j/bad/*", "block")}


def test_deep_paths_repeats_and_nothing(spark):
    pages = spark.createDataFrame([(1, "http://h/" + "/".join("abcdefghijklm"), 1), (1, "http://h/" + "/".join("abcdefghijklm"), 1), (2, "http://h/", None)], "page_id long, url string, good int")
    got = url_templates.judge(pages, RULES).collect()
    assert len(got) == 3 and sorted(r["template"] for r in got)[-1].endswith("/**")
    assert url_templates.judge(pages.where("false"), RULES).count() == 0


def test_label_of_a_page(spark):
    good, bad = "<p>" + "plain words of a page " * 3 + "</p><script>$$$ %%%</script>", "<p>" + "WORDS!! THAT!! SHOUT!! " * 3
    rows = spark.createDataFrame([(good,), (bad,), ("<b>x</b>",), (None,)], "html string").select(url_templates.looks_good(F.col("html")).alias("g")).collect()
    assert [r["g"] for r in rows] == [1, 0, None, None]
