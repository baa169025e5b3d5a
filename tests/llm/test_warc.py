import random

from panelith.llm.warc import PERMITTED, page_records, resolve_revisits, revisit_table

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, status string"


def canonical(url):
    from urllib.parse import urlsplit

    if url is None or "://" not in url:
        return None
    p = urlsplit(url)
    host = p.netloc.lower()
    host = host.removeprefix("www.")
    args = sorted(a for a in p.query.split("&") if a and not a.startswith(("utm_", "ref=")))
    return host + p.path.rstrip("/") + ("?" + "&".join(args) if args else "") if host else None


def brute(rows):
    out = []
    for i, url, ts, kind, headers, _ in rows:
        if kind != "revisit":
            continue
        c = canonical(url)
        full = [r for r in rows if r[3] == "response" and c is not None and canonical(r[1]) == c and ts is not None and r[2] is not None and r[2] < ts]
        if not full:
            out.append((i, c, None, "missing", None))
            continue
        base = max(full, key=lambda r: (r[2], r[0]))
        old, new = base[4] or {}, headers or {}
        tag = lambda h: h["etag"].removeprefix("W/") if h.get("etag") else None
        pair = next(((a, b) for a, b in ((tag(new), tag(old)), (new.get("last-modified"), old.get("last-modified"))) if a is not None and b is not None), None)
        status = "unverified" if pair is None else "resolved" if pair[0] == pair[1] else "mismatch"
        merged = {**old, **{k: v for k, v in new.items() if k in PERMITTED and v is not None}}
        out.append((i, c, base[0], status, merged if status != "mismatch" else None))
    return sorted(out, key=str)


def test_resolution_equals_brute_force(spark):
    r = random.Random(8)
    urls = ["http://www.A.example/x/", "https://a.example/x?utm_source=q", "https://a.example/x#f", "https://a.example/y?b=2&a=1", "http://a.example/y?a=1&b=2&ref=z", None, "no url"]
    rows = []
    for i in range(400):
        headers = {k: v for k, v in (("etag", r.choice(["v1", "v2", "W/v1", None])), ("last-modified", r.choice(["m1", "m2", None])), ("content-length", str(i)), ("cache-control", "c")) if r.random() < 0.8}
        url = urls[0] if r.random() < 0.4 else r.choice(urls)
        rows.append((i, url, r.choice([None, *range(0, 3000, 7)]) if r.random() < 0.9 else 700, r.choice(["response", "revisit", "request"]), headers, "s"))
    for width in (50, 100_000):
        got = resolve_revisits(spark.createDataFrame(rows, SCHEMA), width).collect()
        assert sorted(((x.record_id, x.canonical_url, x.response_id, x.status, x.headers) for x in got), key=str) == brute(rows)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x"), (5, "http://www.a.b/c/", "y"), (7, None, None), (7, None, None)], "page_id long, url string, html string")
    got = sorted((r.record_id, r.response_id, r.status) for r in revisit_table(pages, delay=3).collect() if r.response_id)
    assert got == [(1, 1, "resolved"), (5, 5, "resolved")]
    assert page_records(pages).count() == 8
    assert revisit_table(pages.limit(0)).count() == 0
