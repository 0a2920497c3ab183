"""URL filters against a plain restatement."""
import re

from replenish.llm import url_filter as U
from replenish.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate({i: i + 32 for i in range(65, 91)}), re.match(r"[^?#]*", rest[len(host):]).group()


def rule_of(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(rows):
    """Rows (page_id, url, targets)."""
    bare = lambda u: u.split("#")[0]
    links = {}
    for _, u, targets in rows:
        for t in targets:
            links.setdefault(bare(u), set()).add(bare(t))
            links.setdefault(bare(t), set()).add(bare(u))
    out = []
    for i, u, _ in rows:
        rule, verdict = rule_of(u)
        via = False
        if verdict is None:
            seen, todo = set(), [bare(u)] if u else []
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += links.get(x, ())
            said = {rule_of(x)[1] for x in seen}
            via = "block" in said and "allow" not in said
            verdict = "block" if via else "allow"
        out.append((i, *parts(u), rule, verdict, via))
    return sorted(out, key=str)


def test_rules_aliases_and_edge_cases(spark):
    canonical = lambda t: f'<LINK data-x="1" REL="nofollow canonical" href=\'{t}\'>'
    refresh = lambda t: f'<meta http-equiv="Refresh" content="0; URL={t}">'
    urls = [
        ("http://Example.ORG/es/1", []), ("http://a.example.org/en/12?x", []), ("http://a.example.org/en/2", []), ("http://notexample.org/es/", []),
        ("http://x.com/de/", []), ("http://x.com/fr/#a", []), ("http://x.com", []), ("http://org", []), ("http://org/", []), ("no url", []), (None, []), ("", []),
        ("http://q.net/a#frag", [canonical("http://x.com/de/9")]), ("http://q.net/b", [refresh("http://q.net/a")]),
        ("http://r.net/a", [canonical("http://x.com/de/1"), refresh("http://z.org/ok")]), ("http://s.net/dir/page?x=/1", [canonical("/de/../top"), refresh("other")]),
        ("http://s.net/dir/other", [canonical("//x.com/de/5")]), ("http://t.net/1", ["<link rel=canonical><meta http-equiv=refresh content=5><link rel=stylesheet href=http://x.com/de/>"]),
        ("http://u.net/1", [canonical("http://u.net/2")]), ("http://u.net/2", [canonical("http://u.net/3")]), ("http://u.net/3", [refresh("http://x.com/de/")]),
        ("http://x.com/fr/5", [canonical("http://v.net/")]), ("http://v.net/", [canonical("http://x.com/de/77")]), ("http://A.B.Com:80/de/x", []), ("x://y://z.com/de/", []),
    ]
    target = {"http://s.net/dir/page?x=/1": ["http://s.net/de/../top", "http://s.net/dir/other"], "http://s.net/dir/other": ["http://x.com/de/5"], "http://t.net/1": []}
    rows = [(i, u, "".join(h) if h else None) for i, (u, h) in enumerate([*urls, urls[1]])]
    found = lambda u, h: target.get(u, [m for x in h for m in re.findall(r"(?:href='|URL=)([^'\"]+)", x)])
    want = brute([(i, u, found(u, h)) for i, (u, h) in enumerate([*urls, urls[1]])])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS verdict", "'x' AS host", "2 AS node")
    assert sorted((tuple(r) for r in U.judge(df, URL_RULES).collect()), key=str) == want
    assert any(r[5] for r in want)


def test_empty_table(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).collect() == []
