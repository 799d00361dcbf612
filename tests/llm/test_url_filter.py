import math
import random
import re
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import pytest

from docweir.llm import url_filter as u

URLS = [
    "http://A.Example.NET/en/1", "https://b.net", "x://b.net/a?q#f", "http://example.com/de/5", "http://example.com.evil.org/fr/x", "https://m.org/fr/#t",
    "no scheme", "", None, "http://ÄB.com/a/b/c/d/e/f/g", "a://b://c/d", "http://notnet/x", "http://net/", "http:///p?x",
]


def brute(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    rest = rest[k:]
    k = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return host, rest[:k]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(k, x, "c") for k, x in enumerate(URLS)] + [(0, URLS[0], "c")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1)], "page_id long, bad int")
    rows = u.judge_urls(pages, labels).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path) == brute(URLS[r.page_id])
        rule, verdict = brute_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert u.judge_urls(pages.limit(0), labels).count() == 0
    assert urlsplit(URLS[0]).path == brute(URLS[0])[1]


def test_templates_by_purity(spark):
    urls, bad = [], []
    for k in range(300):
        for section, share in (("news", 0.05), ("blog", 0.06), ("casino", 0.95)):
            urls.append((len(urls), f"http://site.com/{section}/{1000 + k}"))
            bad.append((len(bad), int((k % 100) < 100 * share)))
    urls += [(9000, "http://site.com/casino/77"), (9001, "http://site.com/news/abc"), (9002, "http://other.com/x/5")]
    found = {r.page_id: r for r in u.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")).collect()}
    assert found[9000].verdict == "block" and found[2].verdict == "block" and found[2].template == "/casino/*"
    assert found[0].verdict == found[1].verdict == "allow"
    assert found[9002].verdict == "allow"


def test_rare_segments_become_wildcards(spark):
    urls = [(k, f"http://s.com/user/name{chr(97 + k % 26)}{chr(97 + k // 26)}/home") for k in range(600)]
    urls += [(1000 + k, "http://s.com/user/admin/home") for k in range(300)]
    found = {r.page_id: r.template for r in u.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert found[5] == "/{*}/*/home" and found[1000] == "/{*}/admin/home"


def brute_verdicts(urls, bad):
    """{url: (template, verdict)} by the method as stated, a host and a level at a time."""
    look = re.compile(r"^[0-9][0-9_.-]*(\.[A-Za-z]{2,5})?$|^[0-9a-fA-F-]{16,}$|[0-9]{4,}")
    parts = {}
    for x in urls:
        host, path = brute(x)
        own = ["*" if look.search(p) else p for p in path.split("/") if p]
        parts[x] = host, tuple(own if len(own) <= u.DEPTH else [*own[: u.DEPTH], "/".join(own[u.DEPTH :])])
    n = Counter(urls)
    labelled = Counter(urls[k] for k in bad)
    wrong = Counter(urls[k] for k, b in bad.items() if b)
    rate = sum(wrong.values()) / sum(labelled.values()) if labelled else 0.0
    made = dict.fromkeys(n, ())
    for level in range(max(len(p) for _, p in parts.values())):
        branches = defaultdict(Counter)
        for x in n:
            if len(parts[x][1]) > level:
                branches[parts[x][0], made[x]][parts[x][1][level]] += n[x]
        for x in n:
            if len(parts[x][1]) > level:
                seen, segment = branches[parts[x][0], made[x]], parts[x][1][level]
                rare = len(seen) > u.CROWDED and seen[segment] < u.RARE * sum(seen.values())
                made[x] = (*made[x], "*" if rare else segment)
    nodes = defaultdict(lambda: [0, 0])
    for x in n:
        node = nodes[parts[x][0], made[x]]
        node[0] += labelled[x]
        node[1] += wrong[x]
    up = lambda t: next(((*t[:i], "{*}", *t[i + 1 :]) for i, s in enumerate(t) if s != "*"), t)
    family, group, merged = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), {}
    for (host, t), (a, b) in nodes.items():
        family[host, up(t)][0] += a
        family[host, up(t)][1] += b
    for (host, t), (a, b) in nodes.items():
        total, bads = family[host, up(t)]
        share = bads / total if total else 0.0
        spread = math.sqrt(a * share * (1 - share))
        merged[host, t] = up(t) if not a or not spread or abs(b - a * share) < u.SIMILAR_Z * spread else t
        group[host, merged[host, t]][0] += a
        group[host, merged[host, t]][1] += b
    out = {}
    for x in n:
        key = parts[x][0], merged[parts[x][0], made[x]]
        purity = (group[key][1] + u.PRIOR_ROWS * rate) / (group[key][0] + u.PRIOR_ROWS)
        out[x] = "/" + "/".join(key[1]), "block" if purity >= u.REJECT else "allow"
    return out


@pytest.mark.parametrize("seed", range(2))
def test_verdicts_by_brute_force(spark, seed):
    """A host with most pages and slugs that don't look variable, sections of their own purity, paths deeper than DEPTH."""
    rng = random.Random(seed)
    urls, bad = [], {}
    shares = {s: rng.choice((0.02, 0.05, 0.5, 0.9, 1.0)) for s in ("news", "shop", "play", "talk", "wiki", "x/y/z/q/r/s/t")}
    for k in range(1500):
        host = "big.com" if rng.random() < 0.6 else f"h{rng.randrange(9)}.com"
        section = rng.choice([*shares])
        slug = rng.choice((f"slug{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}", str(k), "index", "a/" * 20 + rng.choice("bc")))
        urls.append(f"http://{host}/{section}/{slug}")
        if rng.random() < 0.6:
            bad[k] = int(rng.random() < shares[section])
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    rows = u.judge_urls(pages, spark.createDataFrame([*bad.items()], "page_id long, bad int"), []).collect()
    want = brute_verdicts(urls, bad)
    assert {r.page_id: (r.template, r.verdict) for r in rows} == {k: want[x] for k, x in enumerate(urls)}
    verdicts = Counter(r.verdict for r in rows)
    assert len(rows) == len(urls) and min(verdicts["allow"], verdicts["block"]) > 100
