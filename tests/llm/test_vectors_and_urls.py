import math
import random

import numpy as np
from llm_fixtures import messy
from pyspark.sql import functions as F

from ordinata.llm import nearvec, urlfilter
from ordinata.llm.queries import URL_RULES

VECS = "vec_id long, embedding array<float>, label int"


def brute_links(rows, cosine=0.93):
    good = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(float)
            good[i] = (label, u / np.linalg.norm(u))
    n, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(good)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            (l, u), (m, v) = good[i], good[j]
            if l == m and len(u) == len(v) and u @ v >= cosine:
                n[i] += 1
                n[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (n[i], find(i)) for i in n}


def test_near_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(5))
    rows = []
    for g in range(60):
        base = rng.standard_normal(32)
        for c in range(1 + g % 7):
            v = base + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.2, 0.5])
            rows.append((len(rows), [float(x) for x in v], g % 3))
    rows += [(len(rows) + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [float("nan")] * 32, 1), (904, [None] + [1.0] * 31, 1), (905, [1.0] * 32, None), (906, [1.0] * 31, 1), (907, [1.0] * 32, 1), (908, [2.0] * 32, 1), (909, [float("inf")] + [1.0] * 31, 1)]
    want = brute_links(rows)
    for most in (2000, 16):  # whole cells, and cells cut in chunks
        monkeypatch.setattr(nearvec, "MOST", most)
        got = {r["id"]: (r["n_links"], r["component"]) for r in nearvec.links(messy(spark, rows, VECS)).collect()}
        assert got.keys() == want.keys()
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
        assert np.mean([got[i] == want[i] for i in want]) > 0.97


def test_near_vectors_of_nothing(spark):
    assert nearvec.links(messy(spark, [], VECS)).count() == 0
    one = nearvec.links(messy(spark, [(None, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1)], VECS)).collect()
    assert sorted((r["id"] or 0, r["n_links"], r["component"] or 0) for r in one) == [(0, 0, 0), (3, 1, 3), (3, 1, 3)]


def test_sorted_windows_count_as_differences_do():
    p = np.random.Generator(np.random.PCG64(6)).standard_normal((70, 9))
    assert (nearvec.collisions(p, 0.5) == (np.abs(p[:, None] - p[None]) <= 0.5).sum(2)).all()


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_rank(edges, seeds, damping=0.85, rounds=16):
    out = {}
    for (s, _), n in edges.items():
        out[s] = out.get(s, 0) + n
    total = sum(seeds.values())
    start = {h: (1 - damping) * m / total for h, m in seeds.items()} if total else {}
    r = dict(start)
    for _ in range(rounds):
        new = dict(start)
        for (s, d), n in edges.items():
            if s in r:
                new[d] = new.get(d, 0) + damping * r[s] * n / out[s]
        r = new
    return r


def test_urls_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.example.org", "b.example.org", "x.example.com", "Y.Example.COM", "z.example.com", "one.example.net", "two.example.net", "lone.test", "org"]
    rows = []
    for i in range(300):
        h = rng.choice(hosts)
        links = "".join(f'<a href="https://{rng.choice(hosts)}/p?q">x</a> <img src=//no> <a href="/own">' for _ in range(rng.randrange(4)))
        rows.append((i, f"http{rng.choice(['', 's'])}://{h}{rng.choice(['/en/1', '/fr/2', '/de/3', '/es/', '', '?a=/fr/', '#x'])}", links))
    rows += [(900, None, None), (901, "no scheme", ""), (902, "a://b.org/://c", None), (903, "://", "<a href='http://a.example.org'>"), (903, "://", None)]
    got = urlfilter.judge(messy(spark, rows, "page_id long, url string, html string"), urlfilter.rule_table(spark, URL_RULES)).collect()
    assert len(got) == len(rows)
    edges, seeds, names = {}, {"allow": {}, "block": {}}, set()
    import re

    for _, url, html in rows:
        host, path = split_url(url)
        names.add(host)
        verdict = rule_of(host, path)[1]
        if verdict and host:
            seeds[verdict][host] = seeds[verdict].get(host, 0) + 1
        for to in re.findall(urlfilter.LINK, html or ""):
            if host and to.lower() != host:
                edges[host, to.lower()] = edges.get((host, to.lower()), 0) + 1
    for h in names:
        parent = h.split(".", 1)[1] if h.count(".") >= 2 else ""
        if parent:
            edges[h, parent] = edges.get((h, parent), 0) + 1
            edges[parent, h] = edges.get((parent, h), 0) + 1
    trust, distrust = brute_rank(edges, seeds["allow"]), brute_rank({(d, s): n for (s, d), n in edges.items()}, seeds["block"])
    by_url = {url: split_url(url) for _, url, _ in rows}
    urls = {r[0]: r[1] for r in rows}
    for r in got:
        host, path = by_url[urls[r["id"]]]
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert abs(r["trust"] - trust.get(host, 0)) < 1e-9 and abs(r["distrust"] - distrust.get(host, 0)) < 1e-9
        assert r["verdict"] == (verdict or ("block" if distrust.get(host, 0) > trust.get(host, 0) else "allow"))
    assert {r["verdict"] for r in got} == {"allow", "block"}


def test_urls_of_nothing(spark):
    rules = urlfilter.rule_table(spark, URL_RULES)
    assert urlfilter.judge(messy(spark, [], "page_id long, url string, html string"), rules).count() == 0
    none = rules.where(F.lit(False))
    assert {r["verdict"] for r in urlfilter.judge(messy(spark, [(1, "http://a.org/", None)], "page_id long, url string, html string"), none).collect()} == {"allow"}
