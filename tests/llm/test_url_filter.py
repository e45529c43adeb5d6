import re

import pytest

from tessera.llm import url_filter as U
from tessera.llm.common import load


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = host.translate(str.maketrans(U.UPPER, U.LOWER))
    return lower, re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fit = [r for r in U.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: len(r[1] + r[2]), default=None)


def ranks(edges, seeds, rounds=12, damping=0.85):
    rank = dict(seeds)
    for _ in range(rounds):
        new = {h: w * (1 - damping) for h, w in seeds.items()}
        for (a, b), share in edges.items():
            new[b] = new.get(b, 0) + damping * share * rank.get(a, 0)
        rank = new
    return rank


def shares(counts):
    total = {}
    for (a, _), n in counts.items():
        total[a] = total.get(a, 0) + n
    return {k: n / total[k[0]] for k, n in counts.items()}


def brute(rows):
    hosts = [split(u) for _, u, _ in rows]
    rules = [rule_of(*h) for h in hosts]
    counts, seeds = {}, {"allow": {}, "block": {}}
    for (h, _), r, (_, _, html) in zip(hosts, rules, rows, strict=True):
        if h and r:
            seeds[r[0]][h] = seeds[r[0]].get(h, 0) + 1
        if h:
            for d in {x.translate(str.maketrans(U.UPPER, U.LOWER)) for x in re.findall(U.LINK, html or "")} - {h, ""}:
                counts[h, d] = counts.get((h, d), 0) + 1
    share = shares(counts)
    back = shares({(b, a): w for (a, b), w in share.items()})
    part = lambda s: {h: n / sum(s.values()) for h, n in s.items()}
    trust, distrust = ranks(share, part(seeds["allow"])), ranks(back, part(seeds["block"]))
    out = []
    for (i, _, _), (h, p), r in zip(rows, hosts, rules, strict=True):
        t, d = trust.get(h, 0.0), distrust.get(h, 0.0)
        out.append((i, h, p, r and r[1] + r[2], r[0] if r else "block" if d - t > 1e-12 else "allow", t, d))
    return out


def same(got, want):
    key = lambda r: tuple(map(str, r[:5]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], abs=1e-9)


def test_equals_brute_force_with_links(spark):
    link = lambda *hosts: " ".join(f'<a HREF="http://{h}/x">y</a>' for h in hosts)
    rows = [
        (1, "http://bad.net/a", link("other.com", "Bad.NET")),
        (2, "http://spam.com/x?y=://z", link("bad.net")),
        (3, "http://spam.com", link("bad.net", "worse.com")),
        (4, "https://a.Example.net/en/1", link("good.com", "fine.com")),
        (5, "http://good.com?q", "<a href='//fine.com/1'>x</a> <a href=/local>x</a>"),
        (6, "http://fine.com#f", None),
        (7, "http://example.com/de/x", link("fine.com")),
        (8, "x.org/fr/", link("fine.com")),
        (9, "http://x.org/fr/1", link("fine.com")),
        (10, None, link("fine.com")),
        (None, "http://notnet/", ""),
        (11, "http://net", ""),
        (11, "http://net/", ""),
        (12, "http:///path", link("fine.com")),
    ]
    rows += rows[:2]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = U.judge(pages).collect()
    same(got, brute(rows))
    assert {r.page_id: r.verdict for r in got}[2] == "block"
    assert U.judge(pages.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in load(spark, sf, "pages").collect()]
    same(U.judge(load(spark, sf, "pages")).collect(), brute(rows))
    assert U.op10_url_filter(spark, sf).columns == ["page_id", "host", "path", "rule", "verdict"]


def test_ranks_along_long_chains_converge(spark):
    # h0 links to h1 and so on to a blocked host; the chain of g from an allowed host goes as far and ends in a loop
    link = lambda *hosts: " ".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(i, f"http://h{i}.com/", link(f"h{i + 1}.com" if i < 29 else "bad.net")) for i in range(30)]
    rows += [(100, "http://bad.net/", ""), (101, "http://x.org/fr/", link("g0.com"))]
    rows += [(200 + i, f"http://g{i}.com/", link(*([f"g{i + 1}.com"] if i < 29 else ["g28.com", "bad.net"]))) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in U.judge(pages).collect()}
    trust, back = {(f"g{i}.com", f"g{i + 1}.com"): 1.0 for i in range(29)}, {("bad.net", "h29.com"): 2 / 3, ("bad.net", "g29.com"): 1 / 3}
    trust |= {("x.org", "g0.com"): 1.0, ("g29.com", "g28.com"): 0.5, ("g29.com", "bad.net"): 0.5}
    back |= {(f"h{i + 1}.com", f"h{i}.com"): 1.0 for i in range(29)} | {(f"g{i + 1}.com", f"g{i}.com"): 1.0 for i in range(28) if i != 27}
    back |= {("g28.com", "g27.com"): 2 / 3, ("g28.com", "g29.com"): 1 / 3, ("g29.com", "g28.com"): 1.0, ("g0.com", "x.org"): 1.0}
    trust, distrust = ranks(trust, {"x.org": 1.0}, 400), ranks(back, {"bad.net": 1.0}, 400)
    for r in got.values():
        assert (r.trust, r.distrust) == pytest.approx((trust.get(r.host, 0.0), distrust.get(r.host, 0.0)), abs=1e-12)
        own = "block" if distrust.get(r.host, 0.0) - trust.get(r.host, 0.0) > 1e-12 else "allow"
        assert r.rule or r.verdict == own
    assert {got[i].verdict for i in range(30)} == {"block"} and {got[200 + i].verdict for i in range(30)} == {"allow", "block"}
