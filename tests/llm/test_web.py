"""URL globs against regular expressions, revisits against a plain loop."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from nightgrid.llm import urlfilter, warc, web_queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op4_url_filters", "op6_revisits"])
def test_queries_match_their_oracles(spark, name):
    rows, ok, why = compare(spark, duck(SF), web_queries.QUERIES[name], web_queries.ORACLES[name], SF)
    assert rows == 250 and ok, why


def as_regex(glob):
    out = ""
    for part in re.findall(r"\*\*|\*|\?|.", glob):
        out += {"**": "(?s:.)*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return re.compile(out.encode() + b"\\Z", re.DOTALL)


def test_automaton_equals_regular_expressions():
    rnd = random.Random(5)
    for _ in range(30):
        globs = ["".join(rnd.choice(["a", "b", "/", "*", "**", "?", "é"]) for _ in range(rnd.randint(0, 9))).replace("***", "**") for _ in range(rnd.randint(1, 25))]
        globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
        texts = ["", "x" * 300, *["".join(rnd.choice("ab/é\n") for _ in range(rnd.randint(0, 12))) for _ in range(200)]]
        got = urlfilter.Automaton(globs).matches(pa.array(texts))
        want = np.array([[bool(as_regex(g).match(t.encode())) for g in globs] for t in texts])
        plain = np.array(["?" not in g for g in globs])  # a ? is one byte
        assert (got[:, plain] == want[:, plain]).all()


def site_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for v, s in urlfilter.SITE_RULES:
        h, p = s.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(s) > len(best[1])):
            best = (v, s)
    return host, path, best and best[1], best and best[0]


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/EN/", "http://xexample.com/en/", "http://a.net/fr/é", "http://net/es/", "http://a.net?x/fr/", "http://evil.org/x.example.com/en/", "x://b.casino-win.org/", "http://com", "http://com/", "a://b://c.net/es/", "http://É.net/es/1", "http://q.org/" + "z" * 40000]


def test_site_rules_on_edge_urls(spark):
    pages = spark.createDataFrame([(i // 2, u, "r", "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string, verdict string")
    got = sorted((tuple(r) for r in urlfilter.judge(pages).collect()), key=str)
    assert len(got) == len(URLS) * 2
    want = {site_rule(u)[:3] for u in URLS}
    assert {r[1:4] for r in got} == want
    for _, host, path, rule, verdict in got:
        if rule:
            assert verdict == dict((s, v) for v, s in urlfilter.SITE_RULES)[rule]
        elif "casino" in host:
            assert verdict == "block"
        else:
            assert verdict == "allow"
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_host_globs_fit_hosts_without_a_path(spark):
    bad = ["http://best-casino.biz", "http://spam-x.org?q=1", "http://a.spam-x.org#f", "http://x.ads-1.net", "http://ADS-1.net", "http://my-adult-site.org"]
    good = ["http://robots.txt", "http://wp-admin", "http://goodspam-x.org", "http://q.org?u=casino", "http://"]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages).collect()}
    assert got == {i: "block" if i < len(bad) else "allow" for i in range(len(bad + good))}


def test_canonical_urls(spark):
    urls = {"https://www.A.com:443/x.html?utm_source=f&b=1#t": "a.com/x?b=1", "http://a.com/x/": "a.com/x", "http://a.com/?ref=z": "a.com", "none": None}
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "url string")
    got = {r.url: r.c for r in df.select("url", warc.canonical_url(df.url).alias("c")).collect()}
    assert got == {**urls, None: None}


def plain_resolve(rows):
    out = []
    for rid, url, at, rev, head, body in rows:
        base = [r for r in rows if not r[3] and url and "://" in url and r[1] == url and r[2] is not None and at is not None and r[2] < at]
        src = max(base, key=lambda r: (r[2], r[0] is not None, r[0] or 0)) if base else None
        h = head or {}
        if not rev:
            out.append((rid, "full", None, body, head))
        elif src is None:
            out.append((rid, "missing", None, body, head))
        elif not h.get("etag") and not h.get("last-modified"):
            out.append((rid, "unverified", None, body, head))
        else:
            k = "etag" if h.get("etag") else "last-modified"
            if h[k].removeprefix("W/") != ((src[4] or {}).get(k) or "").removeprefix("W/"):
                out.append((rid, "mismatch", None, body, head))
            else:
                new = {**(src[4] or {}), **{a: b for a, b in h.items() if a not in warc.NOT_MERGED}}
                out.append((rid, "resolved", src[0], src[5], new))
    return sorted(out, key=str)


def test_revisits_match_a_plain_loop(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(600):
        url = "http://hot.org/a" if i % 3 == 0 else rnd.choice([None, "bad", "http://b.org/1", f"http://c.org/{i % 50}"])
        tag = rnd.choice([None, '"a"', 'W/"a"', '"b"'])
        head = {k: v for k, v in (("etag", tag), ("last-modified", rnd.choice([None, "d1", "d2"])), ("content-length", str(i)), ("x", str(i))) if v}
        rows.append((i, url, rnd.choice([None, *range(200)]), rnd.random() < 0.5, head if i % 40 else None, f"b{i}"))
    rows += [(None, "http://b.org/1", 100, None, {}, None)] * 2 + [rows[3]] * 2
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "record_id long, url string, at long, revisit boolean, headers map<string,string>, body_id string, status string, latest int")
    fixed = [(a, b, c, bool(d), e, f) for a, b, c, d, e, f in rows]
    for moments in (20, 10_000):
        import nightgrid.llm.warc as w

        found, w.latest_before.__defaults__ = w.latest_before.__defaults__, (moments,)
        try:
            got = sorted(((r.record_id, r.status, r.source_id, r.body_id, r.headers) for r in w.resolve_revisits(df).collect()), key=str)
        finally:
            w.latest_before.__defaults__ = found
        assert sorted(map(str, [g[:4] for g in got])) == sorted(map(str, [p[:4] for p in plain_resolve(fixed)]))
        assert {g[0]: g[4] for g in got} == {p[0]: p[4] for p in plain_resolve(fixed)}
    assert warc.resolve_revisits(df.limit(0)).count() == 0
