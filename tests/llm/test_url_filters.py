import re
from collections import Counter, defaultdict

from lintlake.llm import url_filters as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain(pages):
    seen, n, seeds, links = [], Counter(), defaultdict(Counter), Counter()
    for url, html in pages:
        host, path = parts(url)
        fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.text)) if fit else None
        seen.append((host, path, rule))
        n[host] += 1
        if rule:
            seeds[rule.verdict][host] += 1
        for target in re.findall(r"""<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)""", html or "", re.I):
            dst = parts("http:" + target if target.startswith("//") else target)[0]
            if host and dst and host != dst:
                links[host, dst] += 1

    out = Counter()
    for (a, _), k in links.items():
        out[a] += k

    def flow(seed, edges):
        own = {h: seed[h] / n[h] * (1 - U.DAMPING) for h in n}
        rank = dict(own)
        for _ in range(U.TURNS if edges else 0):
            new = defaultdict(float, own)
            for (a, b), share in edges.items():
                new[b] += rank.get(a, 0) * share * U.DAMPING
            rank = new
        return rank

    shares = {(a, b): k / out[a] for (a, b), k in links.items()}
    trust, distrust = flow(seeds["allow"], shares), flow(seeds["block"], {(b, a): k for (a, b), k in shares.items()})
    return Counter((host, path, rule.text if rule else None, rule.verdict if rule else ("block" if distrust.get(host, 0) - trust.get(host, 0) >= U.MARGIN * (1 - U.DAMPING) else "allow")) for host, path, rule in seen)


PAGES = [
    ("http://a.example.net/x", "<a href='http://farm.test/'>x</a>"), ("https://A.EXAMPLE.net/en/1?q=/de/", ""), ("http://example.com/de/x", None), ("http://example.com/fr/", "<A HREF=//b.org/fr/>"),
    ("http://farm.test/1", '<a class="x" href="http://bad.net/1"></a><a href=http://worse.net></a>'), ("http://farm.test/2", "<a href='/rel'></a><a href='http://farm.test/'></a>"),
    ("http://bad.net/", ""), ("http://worse.net/", '<a href="https://far.test/">'), ("http://linker.test/", "<a href='http://farm.test'></a>"), ("http://b.org/fr/1", "<a href='http://farm.test'></a><a href='http://good.test/'></a>"),
    ("http://good.test/", ""), ("http://net", ""), ("http://net/", ""), ("http://planet/", ""), ("no scheme", "<a href='http://bad.net'>"), (None, None), ("://", ""), ("http://x.org?a=/fr/", ""), ("http://x.org/fr/#a", ""),
    ("http://bad.net/", ""), ("http://bad.net/", ""),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, u, h, 1.0, "s") for i, (u, h) in enumerate(PAGES)], "page_id bigint, url string, html string, trust double, src string").repartition(4)
    rows = U.judge(df).collect()
    assert len(rows) == len(PAGES) and Counter((r.host, r.path, r.rule, r.verdict) for r in rows) == plain(PAGES)
    verdict = {r.page_id: r.verdict for r in rows}
    assert verdict[8] == "allow" and verdict[10] == "allow"
    assert U.judge(df.limit(0)).collect() == []


def test_distrust_reaches_who_links_to_blocked_hosts(spark):
    farm = [(f"http://f{i}.test/", f"<a href='http://hub.test/'></a>") for i in range(3)] + [("http://hub.test/", "<a href='http://x.net/'>")] + [("http://x.net/", "")] * 3
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(farm)], "page_id bigint, url string, html string")
    got = {r.host: (r.verdict, r.distrust > 0) for r in U.judge(df).collect()}
    assert got["hub.test"] == ("block", True) and got["f0.test"][1]
    assert Counter((r.host, r.path, r.rule, r.verdict) for r in U.judge(df).collect()) == plain(farm)


def test_linked_hosts_without_pages_are_judged(spark):
    pages = [
        ("http://a.test/", "<a href='http://spam.net/x'>x</a>"),  # blocked, not crawled
        ("http://b.test/", "<a href='//nice.org/fr/x'>x</a>"), ("http://c.test/", "<a href='http://none.test/net/'>x</a>"),
        ("http://d.test/", "<a href='http://example.com/de/1'></a><a href='http://example.com/fr/1'></a><a href='http://example.com/'></a>"),  # a third of the linked urls
        ("http://e.test/", "<a href='http://far.net/'></a>"), ("http://far.net/", ""),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r.host: r for r in U.judge(df).collect()}
    assert len(got) == len(pages)
    assert {h for h, r in got.items() if r.verdict == "block"} == {"a.test", "e.test", "far.net"}
    assert abs(got["a.test"].distrust - 0.15 * 0.85) < 1e-9 and abs(got["d.test"].distrust - 0.15 * 0.85 / 3) < 1e-9
    assert got["b.test"].distrust == got["c.test"].distrust == 0


def test_every_linker_of_a_blocked_host_is_blocked(spark):
    # friend.test has as bad links as the linkers, and a trusted host links to it
    pages = [("http://good.org/fr/", "<a href='http://friend.test/'></a>"), ("http://friend.test/", "<a href='http://x1.net/'></a>")]
    for n in (1, 2, 50, 1000):
        pages += [(f"http://l{n}-{i}.test/", f"<a href='http://x{n}.net/'></a>") for i in range(n)]
    pages += [("http://mixed.test/", "<a href='http://x1.net/'></a><a href='http://a.test/'></a><a href='http://b.test/'></a>")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r.host: r.verdict for r in U.judge(df).collect()}
    assert {h for h, v in got.items() if v == "allow"} == {"good.org", "friend.test", "mixed.test"}


def test_sql_with_hosts_that_have_no_pages(spark):
    import duckdb

    from lintlake.llm.queries import SQL

    pages = [*PAGES, ("http://a.test/", "<a href='http://spam.net/x'>x</a>"), ("http://d.test/", "<a href='http://example.com/de/1'></a><a href='http://gone.example.com/de/'></a>"),
             ("http://e.test/", "<a href='//nice.org/fr/x'>x</a><a href='http://spam.net/'>"), ("http://f.test/", "<a <a href='http://spam.net/y'>")]
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = Counter(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({SQL['op2_url_filters']})").fetchall())
    got = U.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == want


def test_links_of_hard_pages_take_linear_time(spark):
    df = spark.createDataFrame([(1, "http://a.test/", "<a " * 300_000 + "<a href='http://b.net/'>")], "page_id bigint, url string, html string")
    assert [(r.dst, r.block) for r in U.host_links(df).collect()] == [("b.net", 1)]
