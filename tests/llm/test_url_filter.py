"""URL filters: fixed rules by plain code, mined rules against all token combinations."""
import itertools
import random
import re

from pyspark.sql import functions as F

from recsmith.llm import url_filter as U
from recsmith.llm.common import read_table
from recsmith.llm.queries import QUERIES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    best = None
    for r in U.RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best)):
            best = r
    return best


ODD = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/en/x", "http://example.net", "http://net/", "http://xnet/", "a://b.NET?x=/en/",
       "http://a.example.com/de/", "http://a.example.com/de", "x://y://z.net/", "http://é.org/fr/É?#", "http://org/fr/#://net/", "://net/", "http://example.net/en/\nq"]


def test_fixed_rules(spark, sf):
    urls = ODD + [r.url for r in read_table(spark, sf, "pages").collect()]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    none = spark.createDataFrame([], "url string, blocked boolean")
    rows = {r.page_id: r for r in U.judge(pages, none).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        host, path = parts(u)
        r = rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (host, path, r, U.RULES.get(r, "allow")), u
    assert U.judge(pages.filter("page_id < 0"), none).collect() == []


def brute_mine(rows, need):
    """All token sets that meet the thresholds, without those that hold a shorter one as confident."""
    n, bad = len(rows), sum(b for _, b in rows)
    least = max(need.support * n, need.rows)
    at = {}
    for i, (t, _) in enumerate(rows):
        for x in t:
            at.setdefault(x, []).append(i)
    stand = {}
    for x, where in at.items():
        b = sum(rows[i][1] for i in where)
        if b >= least and b * n >= len(where) * bad:
            stand.setdefault(tuple(where), []).append((x.startswith("host="), x))
    useful = {min(xs)[1] for xs in stand.values()}
    have = {}
    for t, b in rows:
        for k in range(1, need.length + 1):
            for c in itertools.combinations(sorted(t & useful), k):
                x = have.setdefault(c, [0, 0])
                x[0] += 1
                x[1] += b
    ok = {c: x[1] / x[0] for c, x in have.items() if x[1] >= least and x[1] / x[0] >= max(need.confidence, need.lift * bad / n)}
    return {c for c, v in ok.items() if not any(len(d) < len(c) and set(d) <= set(c) and ok[d] >= v for d in ok)}


def planted(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        host = rng.choice(["www.good.org", f"{rng.choice('abcdefgh')}{i % 9}.casino-win.example.com", "blog.fine.com", "bets.fine.com"])
        path = rng.choice([f"/en/{i}", f"/win/{i}", f"/x/win/{i}", f"/news/big-sale/{i}", f"/a{i}/news"])
        url = f"{rng.choice(['http', 'https'])}://{host}{path}" + rng.choice(["", "?page=2", f"?x={i}&ad=1", "#top", ".html"])
        bad = ("casino" in host and rng.random() < 0.95 or (host.startswith("bets") and "/win/" in path and rng.random() < 0.9)
               or ("big-sale" in path and "&ad=" in url) or rng.random() < 0.03)
        rows.append((url, bool(bad)))
    return spark.createDataFrame(rows, "url string, blocked boolean")


def test_tokens(spark):
    url = "HTTPS://M.Casino-win.example.com/a/x_2/big-Sale.html?x=1&ad=&=3&b#top"
    got = spark.range(1).select(U.tokens(F.lit(url)).alias("t")).first().t
    assert sorted(got) == sorted([
        "scheme=https", "host=m.casino-win.example.com", "label=m", "label=casino-win", "label=example", "label=com", "hostword=m", "hostword=casino",
        "hostword=win", "hostword=example", "hostword=com", "segment=a", "segment=x_2", "segment=big-Sale.html", "pathword=a", "pathword=x",
        "pathword=big", "pathword=sale", "pathword=html", "ext=html", "query=x", "query=ad", "query=b", "fragment="])
    for u in ODD:
        t = spark.range(1).select(U.tokens(F.lit(u)).alias("t")).first().t
        assert t == [] if parts(u or "")[0] == "" else f"host={parts(u)[0]}" in t


def test_mined_rules(spark):
    marks = planted(spark).select(U.tokens(F.col("url")).alias("tokens"), "blocked")
    need = U.Pruning(support=0.02)
    got = {tuple(r.tokens) for r in U.mine(marks, need).collect()}
    assert got == brute_mine([(set(r.tokens), r.blocked) for r in marks.collect()], need)
    # a label in the middle, of hosts that are each too rare; a segment in the middle; a second query key
    assert ("hostword=casino",) in got
    assert any("=win" in "".join(r) and "bets" in "".join(r) for r in got) and any("query=ad" in r for r in got)


def test_mined_verdicts(spark):
    pages = spark.createDataFrame([(1, "http://new.casino-win.example.com/en/5"), (2, "https://bets.fine.com/win/7"), (3, "https://bets.fine.com/news/7"),
                                   (4, "http://www.good.org/win/1"), (5, None), (1, "http://new.casino-win.example.com/en/5")], "page_id bigint, url string")
    rows = sorted((r.page_id, r.verdict) for r in U.judge(pages, planted(spark)).collect())
    assert rows == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow")]


def test_query(spark, sf):
    rows = QUERIES["op7_url_filter"](spark, sf).collect()
    urls = {r.page_id: r.url for r in read_table(spark, sf, "pages").collect()}
    for r in rows:
        assert (r.host, r.path) == parts(urls[r.page_id]) and r.rule == rule(*parts(urls[r.page_id]))
        assert r.rule is None or r.verdict == U.RULES[r.rule]
    assert len(rows) == len(urls)
