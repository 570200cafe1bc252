"""URL rules and the template tree against a plain version that walks the pages."""

import math
import random
import re
from collections import Counter, defaultdict

from keyloom.llm import url_filter as u

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), ("org/bad/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def form(segment):
    return next((f for p, f in u.FORMS if re.search(p, segment)), u.WORD)


def brute(urls, most_children=20, least=0.9, apart=2.0, pseudo=4.0, purity=0.9):
    out, rows = {}, []
    for i, url in urls:
        host, path = parts(url)
        fit = [(r, v) for r, v in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, None))
        segments = [s if form(s) == u.WORD else form(s) for s in path.split("/") if s]
        rows.append([i, host, segments, [], verdict and verdict == "block"])
        out[i] = [host, path, rule, verdict]
    for level in range(1, 1 + max(len(r[2]) for r in rows)):
        nodes = defaultdict(lambda: defaultdict(list))
        for r in rows:
            if len(r[2]) >= level:
                nodes[r[1], tuple(r[3])][r[2][level - 1]].append(r)
        for children in nodes.values():
            stat = {}
            for s, own in sorted(children.items()):
                kinds = Counter(u.END if len(r[2]) == level else r[2][level] if r[2][level] in u.KINDS else u.WORD for r in own)
                told = [r[4] for r in own if r[4] is not None]
                stat[s] = kinds, len(told), sum(told)
            to = {}
            for s, (k, t, b) in stat.items():
                for s2, (k2, t2, b2) in stat.items():
                    dot = sum(k[x] * k2[x] for x in k)
                    alike = dot >= least * math.sqrt(sum(x * x for x in k.values()) * sum(x * x for x in k2.values())) - 1e-9
                    if t and t2:
                        p = (b + b2) / (t + t2)
                        alike = alike and abs(b / t - b2 / t2) <= apart * (math.sqrt(p * (1 - p) * (1 / t + 1 / t2)) + 1e-9)
                    else:
                        alike = alike and t == t2
                    if alike:
                        to[s] = s2
                        break
            for s, own in children.items():
                for r in own:
                    r[3].append(to[s] if len(children) <= most_children else u.WILD)
    told = [r[4] for r in rows if r[4] is not None]
    share = sum(told) / max(1, len(told))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1], tuple(r[3])].append(r)
    for (_, template), own in groups.items():
        t = [r[4] for r in own if r[4] is not None]
        reject = (sum(t) + pseudo * share) / (len(t) + pseudo) >= purity
        for r in own:
            out[r[0]] = (*out[r[0]][:3], out[r[0]][3] or ("block" if reject else "allow"), "/" + "/".join(template))
    return out


def test_deep_paths_and_repeated_rows(spark):
    deep = "/".join(f"d{k}" for k in range(400))
    urls = [f"http://a.org/bad/{deep}/{x}" for x in ("1", "2", "x", "y/z")] + [f"http://a.org/good/{deep}/{x}/{deep}" for x in "pqr"] + ["http://a.org/bad/x"] * 3
    rows = [(i, u_) for i, u_ in enumerate(urls)]
    got = {r.page_id: r for r in u.url_filter(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    want = brute(rows)
    assert {i: (r.host, r.path, r.rule, r.verdict, r.template) for i, r in got.items()} == want


def test_same_as_walking_the_pages(spark):
    r = random.Random(5)
    urls = [None, "", "no scheme", "http://", "://x", "http://EXAMPLE.com/en/1", "http://wwwexample.com/en/1", "https://a.www.example.com/en/", "http://example.com", "http://example.com/en", "x://net/es/?a://b/c", "http://h.net//fr/1", "http://h.net?/fr/", "http://ÉX.net/fr/é#x"]
    for _ in range(600):
        host = r.choice(["a.example.com", "www.example.com", "b.net", "c.org", "C.ORG", "d.io"])
        section = r.choice(["en", "de", "fr", "es", "bad", "bad", "bad", "BAD", f"w{r.randrange(99)}x{'y' * r.randrange(9)}"])
        rest = r.choice(["{}", "{}.html", "x/{}", "2024-01-02/{}", "a{}"]).format(r.randrange(1000))
        urls.append(f"https://{host}/{section}/{rest}{r.choice(['', '/', '?q=1', '#t'])}")
    urls += [f"https://d.io/{chr(97 + i % 26)}{chr(97 + i // 26)}/q" for i in range(60)]
    pages = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(urls)], "page_id long, url string, host string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict, x.template) for x in u.url_filter(pages, RULES).collect()}
    want = brute(list(enumerate(urls)))
    assert {i: x for i, x in got.items() if x != want[i]} == {}
    assert len(got) == len(urls)
    assert any(x[2] is None and x[3] == "block" for x in got.values()), "some template is rejected"


def test_empty_and_no_rules(spark):
    assert u.url_filter(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    got = u.url_filter(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), []).collect()
    assert [(x.rule, x.verdict) for x in got] == [(None, "allow")]
