import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.llm import common, urls
from marginalia.llm.queries import RULES, op6_urls


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = []
    for says, rule in RULES:
        at, _, rest = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, says))
    return max(fits)[1:] if fits else (None, None)


def plain_verdicts(rows):
    """rows: (host, path, good or None). Template verdict and template by row, with dictionaries and loops."""
    segs = [re.sub("[0-9]+", "{n}", p[1:]).split("/") for _, p, _ in rows]
    w, hosts = urls.WEIGHT, defaultdict(lambda: [0, 0])
    for h, _, g in rows:
        if g is not None:
            hosts[h][0] += 1
            hosts[h][1] += g
    n = sum(x[0] for x in hosts.values())
    overall = sum(x[1] for x in hosts.values()) / n if n else 1.0
    prior = lambda h: (hosts[h][1] + w * overall) / (hosts[h][0] + w)
    share = lambda g, n, h: (g + prior(h) * w) / (n + w)
    count = lambda own: (sum(rows[i][2] is not None for i in own), sum(rows[i][2] or 0 for i in own))
    template = [None] * len(rows)

    def grow(h, node, own, level):
        if len(own) < urls.MIN_URLS:
            for i in own:
                template[i] = node + "/**"
            return
        kids = defaultdict(list)
        size = Counter(segs[i][level] for i in own)
        for i in own:
            kids[segs[i][level] if size[segs[i][level]] >= urls.MIN_URLS else "*"].append(i)
        bins = defaultdict(list)
        for name, members in kids.items():
            seen, good = count(members)
            bins[int(share(good, seen, h) * urls.BINS // 1)].append(name)
        groups = []
        for b in sorted(bins):
            seen, good = (sum(x) for x in zip(*(count(kids[k]) for k in bins[b]), strict=True))
            if groups:
                g_seen, g_good = groups[-1][1:]
                p, q, m, o = share(g_good, g_seen, h), share(good, seen, h), g_seen + w, seen + w
                mean = (p * m + q * o) / (m + o)
                if (q - p) / (max(mean * (1 - mean), 1e-9) * (1 / m + 1 / o)) ** 0.5 < urls.Z:
                    groups[-1] = (groups[-1][0] + bins[b], g_seen + seen, g_good + good)
                    continue
            groups.append((list(bins[b]), seen, good))
        for names, _, _ in groups:
            at, deeper = f"{node}/{min(names)}", []
            for k in names:
                for i in kids[k]:
                    if len(segs[i]) == level + 1:
                        template[i] = at
                    else:
                        deeper.append(i)
            if deeper:
                grow(h, at, deeper, level + 1)

    for h in {r[0] for r in rows}:
        grow(h, "", [i for i, r in enumerate(rows) if r[0] == h], 0)
    by_template = defaultdict(list)
    for i, t in enumerate(template):
        by_template[rows[i][0], t].append(i)
    verdict = {}
    for (h, t), own in by_template.items():
        seen, good = count(own)
        verdict[h, t] = "block" if share(good, seen, h) < urls.MIN_PURITY else "allow"
    return [verdict[rows[i][0], t] for i, t in enumerate(template)], template


URLS = [None, "", "no scheme", "http://", "HTTP://Ex.COM", "https://a.example.com/en/71?x#y", "http://EXAMPLE.com/en/8", "http://com/en/", "http://x.net/de/81", "http://example.net/de/81", "http://badexample.net/de/81", "http://a.org/es", "http://a.org/es/", "http://a.org?/es/", "http://b.com/x://c.com/en/", "http://h/a\nb/en", "http://Ä.com/en/é"]


def test_parts_and_rules(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.filter_urls(rows, RULES, ["page_id"]).collect()}
    for i, u in enumerate(URLS):
        host, path = plain_parts(u)
        rule, says = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (says or "allow")


def many(spark):
    rows = []
    for i in range(900):
        host = ["hot.example", "hot.example", "b.example", "c.example"][i % 4]
        path = ["/en/item/%d" % i, "/spam/%d.html" % i, "/u/name%s" % chr(97 + i % 26), "/deep/a/b/c/%d" % i, "/blog/tag-%d/" % (i % 3)][i % 5]
        rows.append((i, f"http://{host}{path}", None if i % 3 == 0 else int(i % 5 != 1 or i % 11 == 0)))
    return spark.createDataFrame(rows, "page_id long, url string, good int")


@pytest.mark.parametrize("broadcast", [True, False])
def test_templates_equal_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = many(spark)
    got = urls.filter_urls(rows, (), ["page_id"], good="good").orderBy("page_id").collect()
    plain = [(*plain_parts(r["url"]), r["good"]) for r in rows.orderBy("page_id").collect()]
    verdicts, templates = plain_verdicts(plain)
    assert [r["template"] for r in got] == templates
    assert [r["verdict"] for r in got] == verdicts
    assert {"block", "allow"} == set(verdicts)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in op6_urls(spark, d).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()
    rows = []
    for p in pages:
        host, path = plain_parts(p["url"])
        number = re.search(r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", path)
        rows.append((host, path, labels.get(int(number[1])) if number else None))
    verdicts, _ = plain_verdicts(rows)
    assert len(got) == len(pages)
    for p, (host, path, _), verdict in zip(pages, rows, verdicts, strict=True):
        rule, says = plain_rule(host, path)
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, says or verdict)


def test_host_path_and_rule_equal_sql(spark):
    d = "/root/testdata/sf0.01"
    fits = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda x: -len(x[1])))
    sql = f"""SELECT page_id, host, path, CASE {fits} END AS rule FROM (SELECT page_id,
      translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM '{d}/pages.parquet')"""
    got = op6_urls(spark, d).select("page_id", "host", "path", "rule").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(duckdb.sql(sql).fetchall(), key=repr)


def labelled(spark, rows):
    rows = spark.createDataFrame([(i, f"http://h.example{p}", g) for i, (p, g) in enumerate(rows)], "page_id long, url string, good int")
    return {(r["path"], r["verdict"]) for r in urls.filter_urls(rows, (), ["page_id"], good="good").collect()}


def test_sections_below_many_levels_are_told_apart(spark):
    got = labelled(spark, [(f"/a/b/c/{'spam' if i % 2 else 'clean'}/{i}", int(not i % 2)) for i in range(200)])
    assert all(v == ("block" if "spam" in p else "allow") for p, v in got)


def test_sections_below_a_variable_segment_are_told_apart(spark):
    got = labelled(spark, [(f"/u/{chr(97 + i % 26)}{chr(97 + i % 25)}x/{'spam' if i % 2 else 'clean'}", int(not i % 2)) for i in range(400)])
    assert all(v == ("block" if "spam" in p else "allow") for p, v in got)


def test_similar_neighbours_do_not_chain(spark):
    rows = [(f"/s{chr(97 + k)}/{i}", int(i < 3 + 27 * k // 6)) for k in range(7) for i in range(30)]
    got = labelled(spark, rows)
    assert {v for p, v in got if p.startswith("/sg/")} == {"allow"} and {v for p, v in got if p.startswith("/sa/")} == {"block"}


def test_many_small_sections_of_a_hot_host(spark):
    got = labelled(spark, [(f"/section{chr(97 + i % 20)}{chr(97 + i % 3)}/{i}", int(i % 60 != 7)) for i in range(3000)])
    assert {p.rpartition("/")[0] for p, v in got if v == "block"} == {"/sectionhb"}


def test_empty(spark):
    rows = spark.createDataFrame([], "page_id long, url string, good int, host string, path string")
    assert urls.filter_urls(rows, RULES, ["page_id"], good="good").count() == 0


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "http://a.com/x", 1, "h", "t")], "page_id long, url string, good int, host string, template string")
    assert [r["host"] for r in urls.filter_urls(rows.withColumn("rule", F.lit(1)), RULES, ["page_id"], good="good").collect()] == ["a.com"]
