from collections import Counter

from texts import frame

from splatspark.llm import line_dedup


def plain(pages, max_ratio, min_pages):
    """pages: (site, lines or None)."""
    key = lambda x: " ".join(x.split())
    sites = Counter(s for s, _ in pages)
    on = Counter((s, k) for s, lines in pages for k in {key(x) for x in lines or [] if x.strip()})
    bad = {k for k, n in on.items() if n >= min_pages and n > max_ratio * sites[k[0]]}
    return [None if lines is None else [x for x in lines if not x.strip() or (s, key(x)) not in bad] for s, lines in pages]


def docs():
    out = []
    for i in range(60):
        site = ["a", "b", None, "a"][i % 4]
        text = "\n".join(["Home  | About", "", f"unique {i}", "rare" if i % 20 == 0 else "", "Home | About ", f"half {i % 2}", "é" * 5])
        out.append((i, text, "en", site, 1, "fp", "c", "r"))
    return out + [(60, None, None, "a", 5, None, None, None), (61, "", None, "z", 5, None, None, None), (None, "Home | About", None, None, None, None, None, None), out[3]]


def test_against_counting(spark, monkeypatch):
    data = docs()
    pages = [(d[3] or "", None if d[1] is None else d[1].split("\n")) for d in data]
    want = sorted((str(d[0]), None if x is None else "\n".join(x)) for d, x in zip(data, plain(pages, 0.2, 3)))
    for bound in (2_000_000, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", bound)
        got = line_dedup.deduplicated(frame(spark, data), max_ratio=0.2, min_pages=3)
        assert got.columns == frame(spark, data).columns
        rows = got.collect()
        assert sorted((str(r.doc_id), r.text) for r in rows) == want
        assert all(r.n_chars == (5 if r.text is None else len(r.text)) for r in rows if r.doc_id is not None)
    assert line_dedup.deduplicated(frame(spark, [])).count() == 0


def test_pages(spark):
    html = lambda i: f"<html><script>var t='<p>no</p>';</script><nav>Menu &amp; more</nav><p>Text {i}<br>x<b>y</b></p><!-- c --></html>"
    rows = [(i, f"HTTPS://u@Host{i % 2}.example:80/p?q={i}", html(i)) for i in range(8)] + [(8, None, None), (9, "nothing", "<p>Menu &amp; more")]
    got = {r.page_id: r for r in line_dedup.page_lines(spark.createDataFrame(rows, "page_id bigint, url string, html string"), 0.2, 3).collect()}
    assert (got[3].host, got[3].n_lines, got[3].n_dropped, got[3].text) == ("host1.example", 3, 2, "Text 3")
    assert (got[8].host, got[8].n_lines, got[8].text) == ("", 0, "") and got[9].text == "Menu & more"
