"""URL filters against brute force and against the DuckDB SQL, on pages that are full of links."""

import random
from urllib.parse import urljoin

import duckdb
from ragloom.llm import common, urlfilter

HOSTS = ["a.org", "d.org", "e.org", "f.org", "g.org", "b.example.com", "x.net", "q.net", "Com.ORG", "c.co", "h.org"]
PATHS = ["/", "", "/en/", "/en/1", "/es/p", "/fr/p", "/en/../es/q", "/d/e/f", "/z?q=1", "/z?q=2"]


def made_pages(seed, n=140):
    rng = random.Random(seed)
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(HOSTS)}{rng.choice(PATHS)}"
    rows = []
    for i in range(n):
        links = ""
        for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 0, 1, 1, 2])):
            to = rng.choice([url(), url(), "http://x.net/es/p", "https://q.net/fr/p", "/en/9", "//q.net/fr/2", "../up", "./here", "down/../side", "?q=3", "#part", ".."])
            links += rng.choice(['<link rel="canonical" href="{}">', "<LINK REL='alternate CANONICAL' HREF='{}'>", '<meta http-equiv="refresh" content="3; URL={}">', "<link rel=canonical href={}>", '<link rel="stylesheet" href="{}">']).format(to)
        rows.append((i, rng.choice([url(), url(), url(), None, "nowhere"]) if i % 9 == 0 else url() + rng.choice(["", "#f"]), f"<html>{links}</html>" if i % 7 else None, "old", "old"))
    return rows


def brute(rows, rules):
    def parts(url):
        if not url or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("#")[0]
        path, mark, query = rest.partition("?")
        return host, path, host + path + mark + query

    def ruled(host, path):
        fitting = [(-len(r), r, v) for r, v in rules for h, slash, p in [r.partition("/")] if h and (host == h or host.endswith("." + h)) and path.startswith(slash + p)]
        return min(fitting)[1:] if fitting else (None, None)

    import re

    near = {}
    for _, url, html, *_ in rows:
        node = parts(url)[2]
        for tag in re.findall(r"(?is)<(?:link|meta)\b[^>]*>", html or ""):
            attribute = lambda name: (re.search(rf"(?is)\b{name}\s*=\s*(\"[^\">]*\"|'[^'>]*'|[^\s>]*)", tag) or [None, ""])[1].strip("\"'")  # noqa: E731, B023
            if tag.lower().startswith("<link"):
                to = attribute("href") if "canonical" in attribute("rel").lower().split() else ""
            else:
                to = attribute("content").split("=", 1)[-1] if attribute("http-equiv").lower() == "refresh" else ""
            if to and node is not None:
                target = parts(urljoin(url if "/" in url.split("://", 1)[1] else url + "/", to))[2] if not to.startswith(("http", "#", "//", "?")) else parts(to)[2] if to.startswith("http") else node if to.startswith("#") else parts("http:" + to)[2] if to.startswith("//") else parts(url)[0] + parts(url)[1] + to
                if to.startswith("http"):
                    host, path, whole = parts(to)
                    target = host + (parts(urljoin(to, path))[1] if "/." in path else path) + whole[len(host + path) :]
                if target != node:
                    near.setdefault(node, set()).add(target)
                    near.setdefault(target, set()).add(node)
    out = []
    for page_id, url, *_ in rows:
        host, path, node = parts(url)
        rule, verdict = ruled(host, path)
        group = {node} if node in near else set()
        while True:
            more = {y for x in group for y in near[x]} - group
            if not more:
                break
            group |= more
        found = {ruled(*parts("x://" + x)[:2])[1] for x in group}
        verdict = verdict or ("allow" if "allow" in found else "block" if "block" in found else "allow")
        out.append((page_id, host, path, rule, verdict, min(group, default=None)))
    return sorted(out)


def found(df):
    return sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["component"]) for r in df.collect())


def test_verdicts_match_brute_force_and_sql(spark, monkeypatch):
    for seed in (1, 2):
        rows = made_pages(seed)
        pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, component string")
        expected = brute(rows, urlfilter.RULES)
        assert found(urlfilter.url_verdicts(pages)) == expected
        assert len({r[5] for r in expected}) > 5 and {r[4] for r in expected if r[3] is None and r[5]} <= {"allow", "block"} and any(r[4] == "block" for r in expected if r[3] is None)
        with duckdb.connect() as duck:
            duck.register("pages", pages.toPandas())
            sql = duck.execute(f"select page_id, host, path, rule, verdict, component from ({urlfilter.oracle_sql()})").fetchall()
        assert sorted(sql) == expected
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HEAVY_SHARE", 3)
    assert found(urlfilter.url_verdicts(pages, urlfilter.rule_table(spark, urlfilter.RULES))) == expected


def test_a_rule_list_means_the_same_at_any_length(spark, monkeypatch):
    rules = [("com", "allow"), ("net/", "block"), ("q.net/fr/", "allow"), ("b.example.com/en/", "block"), ("example.com/en/1", "allow"), ("/es", "block"), ("", "block"), ("a.org", "block"), ("q.net/fr/", "block")]
    rows = made_pages(3)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, component string")
    expected = brute(rows, rules)
    assert found(urlfilter.url_verdicts(pages, rules)) == expected
    monkeypatch.setattr(urlfilter, "LITERAL_RULES", 0)
    assert found(urlfilter.url_verdicts(pages, rules)) == expected
    assert {r[3] for r in found(urlfilter.url_verdicts(pages, []))} == {None}
