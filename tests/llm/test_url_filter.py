import random
import re

import pytest

from tempora.llm import url_filter as uf

URLS = [
    "http://a.example.com/en/1", "https://example.com/en/7?x=1", "http://EXAMPLE.com/en/77", "http://x.net/de/1", "http://example.net/de/8#t", "http://a.b.example.net/de/80/", "http://q.org/es/", "http://q.org/es",
    "http://notcom/en/1", "http://com/en/", "ftp://h?p=/en/", "no scheme", "://", "x://y://z/en/", "http://ÄB.COM/en/1", "", None, "http://a.com/EN/1", "http://b.com#/en/",
]


def judged(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def brute_ranks(edges, seed, hosts):
    """Personalised PageRank by power iteration; mass without a way out restarts at the seeds."""
    total = sum(seed.values())
    s = {h: seed.get(h, 0) / total if total else 0.0 for h in hosts}
    out, r = {}, dict(s)
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    for _ in range(400):
        lost = sum(r[h] for h in hosts if h not in out)
        new = {h: (0.15 + 0.85 * lost) * s[h] for h in hosts}
        for (a, b), n in edges.items():
            new[b] += 0.85 * r[a] * n / out[a]
        r = new
    return r


def brute(pages):
    """{page_id: (host, path, rule, verdict)} of rows (page_id, url, html), and the ranks."""
    own, edges, good, bad = {}, {}, {}, {}
    for i, url, html in pages:
        own[i] = judged(url)
        host = own[i][0]
        if host:
            good[host], bad[host] = good.get(host, 0) + (own[i][3] == "allow"), bad.get(host, 0) + (own[i][3] == "block")
        for link in re.findall(r"""href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]*)""", html or "", re.I):
            to = judged(("x:" if link.startswith("//") else "") + link)[0]
            if host and to and to != host:
                edges[host, to] = edges.get((host, to), 0) + 1
    hosts = {*good, *(h for e in edges for h in e)}
    trust, distrust = brute_ranks(edges, good, hosts), brute_ranks({(b, a): n for (a, b), n in edges.items()}, bad, hosts)
    blocked = {h for h in hosts if distrust[h] > trust[h] and distrust[h] >= 1 / len(hosts)}
    return {i: (h, p, rule, v or ("block" if h in blocked else "allow")) for i, (h, p, rule, v) in own.items()}, trust, distrust


def check(spark, pages):
    df = spark.createDataFrame([(*p, "r") for p in pages], "page_id bigint, url string, html string, rule string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(df).collect()}
    assert got == brute(pages)[0]
    return got


def test_rules_against_brute_force(spark):
    check(spark, [(k, u, None) for k, u in enumerate(URLS)])


def test_real_table(spark):
    d = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.op4_url_filter(spark, d).collect()}
    assert got == brute(pages)[0]
    assert {v for _, _, rule, v in got.values() if rule is None} == {"allow", "block"}  # both by propagation


def linked_pages(seed, hosts=25, n=300):
    r = random.Random(seed)
    names = [f"h{k}.{r.choice(['com', 'net', 'org', 'info'])}" for k in range(hosts)] + ["example.com", "x.example.net"]
    out = []
    for k in range(n):
        links = "".join(r.choice([f'<a href="http://{h}/x">', f"<A HREF='//{h}'>", f"<a href=https://{h}?q>", "<a href='/own'>"]) for h in r.choices(names, k=r.choice([0, 0, 1, 3])))
        out.append((k, f"http://{r.choice(names)}{r.choice(['/', '/en/1', '/en/7', '/de/2', '/de/80', '/es/', '/fr'])}", r.choice([links, links + "text", None])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_between_hosts_against_brute_force(spark, seed):
    got = check(spark, linked_pages(seed))
    assert {v for _, _, rule, v in got.values() if rule is None} == {"allow", "block"}


def test_ranks_converge(spark):
    edges = {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "d"): 1.0, ("c", "a"): 1.0, ("d", "x"): 1.0, ("y", "x"): 3.0, ("y", "a"): 1.0, ("q", "end"): 1.0}
    good, bad = {"a": 3.0, "z": 1.0, "q": 2.0}, {"x": 2.0, "end": 1.0}
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in {*good, *bad}], "host string, good double, bad double")
    got = {r.host: r for r in uf.propagate(spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, n double"), seeds).collect()}
    hosts = {*(h for e in edges for h in e), *good, *bad}
    trust, distrust = brute_ranks(edges, good, hosts), brute_ranks({(b, a): n for (a, b), n in edges.items()}, bad, hosts)
    assert got.keys() == hosts and abs(sum(r.trust for r in got.values()) - 1) < 1e-9 and abs(sum(r.distrust for r in got.values()) - 1) < 1e-9
    for h in hosts:
        assert abs(got[h].trust - trust[h]) < uf.TOLERANCE / len(hosts) * 7 and abs(got[h].distrust - distrust[h]) < uf.TOLERANCE / len(hosts) * 7
    with pytest.raises(ValueError, match="damping"):
        uf.propagate(spark.createDataFrame([], "src string, dst string, n double"), seeds, damping=1.0)


def test_distrust_reaches_hosts_far_away(spark):
    far = 15
    pages = [(0, "http://bad.com/en/1", "")] + [(k, f"http://h{k}.info/", f'<a href="//{f"h{k - 1}.info" if k > 1 else "bad.com"}/">') for k in range(1, far + 1)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert {r.verdict for r in uf.judge(df, lift=0.0).collect()} == {"block"}


def test_linking_to_blocked_hosts_blocks(spark):
    link = lambda h: f'<a href="http://{h}/">x</a><A HREF=\'//{h}/y?z\'>y</a><a href="/own">o</a>'
    pages = [(1, "http://bad.com/en/1", ""), (2, "http://spam.info/1", link("bad.com")), (3, "http://good.example.com/en/7", link("nice.info")), (4, "http://nice.info/", ""), (5, "http://alone.info/", None), (6, "http://bad.com/other", None)]
    assert {i: x[3] for i, x in check(spark, pages).items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}


def test_empty_table(spark):
    assert uf.judge(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
