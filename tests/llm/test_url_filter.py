"""Hosts, rules and the link graph against plain Python."""

import pytest

from meterlake.llm import url_filter as U

URLS = {
    None: ("", ""), "": ("", ""), "no scheme/x": ("", ""), "http://A.Com": ("a.com", ""), "HTTPS://Ex.org/A/b?q=/c#d": ("ex.org", "/A/b"),
    "x://h?://y/z": ("h", ""), "http://h#f": ("h", ""), "://only/p": ("only", "/p"), "http://É.com/": ("É.com", "/"), "a\nb://h/p\nq": ("h", "/p\nq"), "http:///p": ("", "/p"),
}
CASES = {
    "http://a.com/x": ("com/", "allow"), "http://com/": ("com/", "allow"), "http://com": (None, None), "http://xcom/": (None, None), "http://example.com/en/1": ("example.com/en/", "block"),
    "http://m.example.com/en/": ("example.com/en/", "block"), "http://www.example.com/en/1": ("www.example.com/en/", "allow"), "http://q.www.example.com/en/1": ("www.example.com/en/", "allow"),
    "http://example.com/EN/1": ("com/", "allow"), "http://b.net/es/1": ("net/es/", "block"), "http://b.net/fr": (None, None), "http://notexample.com/en/": ("com/", "allow"),
}


def test_hosts_and_rules(spark):
    urls = [*URLS, *CASES]
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    rows = {urls[r["page_id"]]: r for r in U.judge(pages).collect()}
    for u, (host, path) in URLS.items():
        assert (rows[u]["host"], rows[u]["path"]) == (host, path)
    for u, (rule, verdict) in CASES.items():
        assert rows[u]["rule"] == rule and (verdict is None or rows[u]["verdict"] == verdict)


def plain_scores(seeds, edges, damping, steps=60):
    out, back = {}, {}
    for a, b, n in edges:
        out[a] = out.get(a, 0) + n
        back[b] = back.get(b, 0) + n
    result = []
    for k in (0, 1):
        total, now = {}, {h: s[k] for h, s in seeds.items() if s[k]}
        for _ in range(steps):
            for h, m in now.items():
                total[h] = total.get(h, 0) + m
            step = {}
            for a, b, n in edges:
                src, to, share = (a, b, n / out[a]) if k == 0 else (b, a, n / back[b])
                if src in now:
                    step[to] = step.get(to, 0) + damping * now[src] * share
            now = step
        result.append(total)
    return result


def test_propagation_equals_plain_power_series(spark):
    edges = [("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 1), ("s", "x", 5), ("t", "x", 1), ("x", "s", 1), ("d", "a", 1)]
    seeds = {"a": (1.0, 0.0), "x": (0.0, 1.0), "c": (0.25, 0.5)}
    got = U.propagate(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(edges, "source string, target string, n long"), damping=0.3, tolerance=1e-6)
    trust, distrust = plain_scores(seeds, edges, 0.3)
    rows = got.collect()
    for r in rows:
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0), abs=1e-5) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0), abs=1e-5)
    assert {r["host"] for r in rows} == set(trust) | set(distrust)


PAGES = [
    (1, "http://bad.net/es/1", '<a href="http://farm.org/x">'), (2, "http://bad.net/fr/2", "<A HREF='//farm.org'>"), (3, "http://farm.org/1", '<a href="https://user@BAD.net:80/es/"><a href=http://bad.net/fr/9>'),
    (4, "http://farm.org/2", '<a href="/local">'), (5, "http://clean.org/1", '<a href="http://good.com/">'), (6, "http://good.com/1", '<a href="http://clean.org/1"> <a href="http://good.com/2">'), (7, None, '<a href="http://bad.net/">'), (8, "http://bad.net/en/", None),
]


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert sorted(map(tuple, U.host_edges(pages).collect())) == [("bad.net", "farm.org", 2), ("clean.org", "good.com", 1), ("farm.org", "bad.net", 2), ("good.com", "clean.org", 1)]
    verdicts = {r["page_id"]: r["verdict"] for r in U.judge(pages, iterations=8).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block"}
    assert U.judge(pages.filter("false")).count() == 0


def test_sql_says_the_same_with_links(spark):
    import duckdb

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    rel = c.sql(U.OP4_SQL)
    want = {r[0]: r for r in rel.select("page_id, host, path, rule, verdict").fetchall()}
    assert {r["page_id"]: (r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages, iterations=8).collect()} == want


@pytest.mark.parametrize("k", [1, 2, 7])
def test_distrust_by_source_does_not_shrink_with_the_number_of_linkers(spark, k):
    rows = [(0, "http://bad.net/es/1", "")] + [(i, f"http://farm{i}.org/", '<a href="http://bad.net/es/1">') for i in range(1, k + 1)]
    rows += [(50, "http://mixed.org/", '<a href="http://bad.net/">' + '<a href="http://other.org/">' * 3), (51, "http://other.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdicts = {r["page_id"]: r["verdict"] for r in U.judge(pages, iterations=8, by_source=True).collect()}
    assert verdicts == {0: "block", 50: "allow", 51: "allow", **{i: "block" for i in range(1, k + 1)}}


def linked_pages():
    """A chain, a cycle, a hub and a ring of trust; verdicts of hosts without a rule come from their links."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/p">' for h in hosts)
    rows = [("bad.net/es/1", link("bad2.net")), ("bad2.net/fr/1", ""), ("good.com/1", link("ring1.org"))]
    rows += [("chain1.org/", link("bad.net", "chain1.org")), ("chain2.org/", link("chain1.org")), ("chain3.org/", link("chain2.org")), ("chain4.org/", link("chain3.org")), ("chain5.org/", link("chain4.org"))]
    rows += [("cycle1.org/", link("cycle2.org", "bad.net", "bad2.net")), ("cycle2.org/", link("cycle1.org")), ("ring1.org/", link("ring2.org")), ("ring2.org/", link("ring1.org", "ring1.org", "bad.net"))]
    rows += [("hub.org/", link("bad.net", *(f"spoke{i}.org" for i in range(9))))] + [(f"spoke{i}.org/", link("hub.org")) for i in range(9)] + [(f"farm{i}.org/", link("bad2.net")) for i in range(12)]
    return [(i, f"http://{u}", h, "x", "y") for i, (u, h) in enumerate(rows)]


def test_verdicts_by_links_alone_equal_sql_and_plain_python(spark):
    import duckdb

    rows = linked_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r[:3] for r in rows])
    assert got == dict(c.sql(U.OP4_SQL).select("page_id, verdict").fetchall())
    by_host = {rows[i][1].split("/")[2]: v for i, v in got.items()}
    links = {(a, b): n for a, b, n in map(tuple, U.host_edges(pages).collect())}
    out = {a: sum(n for (x, _), n in links.items() if x == a) for a, _ in links}
    seed = {h: float(h in ("bad.net", "bad2.net")) for h in by_host}, {h: float(h == "good.com") for h in by_host}
    distrust, trust = map(dict, seed)
    for _ in range(U.ITERATIONS):
        distrust = {h: seed[0][h] + U.DAMPING * sum(distrust[b] * n / out[a] for (a, b), n in links.items() if a == h) for h in by_host}
        trust = {h: seed[1][h] + U.DAMPING * sum(trust[a] * n / out[a] for (a, b), n in links.items() if b == h) for h in by_host}
    assert {h for h in by_host if h.endswith(".org") and distrust[h] > max(0.5, trust[h])} == {h for h, v in by_host.items() if v == "block" and h.endswith(".org")}
    assert distrust["ring2.org"] > 0.5  # and more trust
    assert all(by_host[f"chain{i}.org"] == "block" for i in range(1, 5)) and by_host["chain5.org"] == "block" and by_host["ring2.org"] == by_host["hub.org"] == "allow"
    assert all(by_host[f"farm{i}.org"] == "block" for i in range(12)) and by_host["cycle1.org"] == by_host["cycle2.org"] == "block"
