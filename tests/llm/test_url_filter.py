import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tableguard.llm import queries, url_filter

from ..conftest import same_rows


def address(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(url, rules):
    host, path = address(url)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def brute(urls, rules=url_filter.RULES):
    """(rule, verdict, score) of each url, by plain loops."""
    held = lambda u: hashlib.sha256(u.encode()).hexdigest()[0] in "012"
    windows = lambda u: [("\x02" * 4 + u + "\x03")[i : i + 5] for i in range(len(u) + 1)]
    known = {u: rule_of(u, rules)[1] for u in urls if u}
    learn = [(u, v) for u, v in known.items() if v and not held(u)]
    counts = {v: defaultdict(Counter) for v in ("allow", "block")}
    for u, v in learn:
        for w in windows(u):
            for k in range(5):
                counts[v][w[4 - k : 4]][w[4]] += 1
    letters = len({w[4] for u in known for w in windows(u)})

    def chance(v, w):
        p = 1 / letters
        for k in range(5):
            c = counts[v][w[4 - k : 4]]
            if sum(c.values()) >= 2:
                p = (c[w[4]] + len(c) * p) / (sum(c.values()) + len(c))
        return p

    def score(u):
        ws = windows(u)
        return math.floor(sum(round((math.log(chance("allow", w)) - math.log(chance("block", w))) * 1e6) for w in ws) / (len(ws) * 1000))

    able, least = {v for _, v in learn} == {"allow", "block"}, 0
    trial = [(score(u), v) for u, v in known.items() if v and held(u)] if able else []
    if {v for _, v in trial} == {"allow", "block"}:
        share = lambda t, v: sum((s < t) == (v == "allow") for s, k in trial if k == v) / sum(k == v for _, k in trial)
        cuts = [(None, min(trial)[0]), *itertools.pairwise(sorted({t for t, _ in trial}))]
        near = [min(t, 0 if low is None else max(0, low + 1)) for low, t in cuts]
        least = min((share(t, "allow") + share(t, "block"), abs(t), t) for t in near)[2]
    out = []
    for u in urls:
        rule, verdict = rule_of(u, rules)
        s = score(u) if able and u and not rule else None
        out.append((*address(u), rule, verdict or ("allow" if s is None or s >= least else "block"), s))
    return out


def some_urls(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé-") for _ in range(rng.randint(1, 6)))
    top = lambda: rng.choice(["example.net", "example.com", "shop.example.com", "x.org", "NET", "notnet", "a.b.Net:80"])
    return [f"{rng.choice(['http', 'https', 'HTTP'])}://{word()}.{top()}{rng.choice(['/en/', '/de/', '/fr/', '/', '', '?q=/en/', '#'])}{word()}" for _ in range(n)]


ODD = [None, "", "no address", "://", "http://", "a://b://c.net/d", "http://net/", "http://net", "http://net?x", "http://example.net/en", "http://EXAMPLE.net/en/é\n?x", "http://𐀀.net/\x00"]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_equal_to_plain_loops(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", broadcast)
    urls = some_urls(120) + ODD
    urls += urls[:20] + [urls[3]] * 200
    df = spark.createDataFrame([(k % 100 if k % 7 else None, u, "h", k, "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule int, Verdict string").repartition(6)
    got = url_filter.judge(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    want = [(k % 100 if k % 7 else None, *w) for k, w in enumerate(brute(urls))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_longest_rule_wins_on_host_and_subdomains(spark):
    df = spark.createDataFrame([(u,) for u in ODD + some_urls(200, 2)], "url string")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    got = df.select("url", host.alias("h"), path.alias("p"), url_filter.matched(host, path, url_filter.RULES).alias("m")).collect()
    for r in got:
        assert (r.h, r.p) == address(r.url) and (tuple(r.m) if r.m else (None, None)) == rule_of(r.url, url_filter.RULES)


def test_without_labels_of_both_kinds_all_is_allowed(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/"), (3, None)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.score) for r in url_filter.judge(df).collect()}
    assert got == {1: ("block", None), 2: ("allow", None), 3: ("allow", None)}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_model_tells_kinds_of_urls_apart(spark):
    """Labels come from hosts; what has none is told by its characters."""
    rng = random.Random(5)
    good = lambda: "/".join(rng.choice(["guide", "docs", "reference", "article", "history"]) for _ in range(3))
    bad = lambda: "-".join(rng.choice(["casino", "pills", "winbig", "cheap", "bonus"]) for _ in range(3))
    rows = [(k, f"http://{'a.org/fr' if k % 4 == 0 else 'b.info'}/{good()}" if k % 2 == 0 else f"http://{'a.net' if k % 4 == 1 else 'b.info'}/{bad()}") for k in range(400)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).where("rule IS NULL").collect()
    right = sum((r.verdict == "allow") == (r.page_id % 2 == 0) for r in got)
    assert len(got) == 200 and right >= 0.97 * len(got)


def test_very_long_url(spark):
    rows = [(k, u) for k, u in enumerate(some_urls(40))] + [(99, "http://b.info/" + "xy" * 200_000)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 41 and got[99].verdict in ("allow", "block") and got[99].score is not None


def test_main_path_has_no_python(spark, data):
    plan = queries.queries()["op11_url_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_agrees_with_its_sql(spark, data, duck):
    same_rows(queries.queries()["op11_url_filter"](spark, data), duck.execute(queries.oracle_sql()["op11_url_filter"]))
