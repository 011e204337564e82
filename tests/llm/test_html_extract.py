import html
import re

import numpy as np

from quayside.llm import catalog, html_extract

SF_DIR = "/root/testdata/sf0.01"


def simple(page):
    """The article of a page of the given template: tags out, blocks by block tags."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)>", body)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(line for line in lines if line)


def test_query_matches_the_template(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = catalog.op3_html_extraction(spark, SF_DIR).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        assert r["text"] == simple(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])


def brute_covered(streams, owners, k):
    seen = {}
    for owner, stream in zip(owners, streams):
        for i in range(len(stream) - k + 1):
            seen.setdefault(tuple(stream[i : i + k]), set()).add(owner)
    out = []
    for stream in streams:
        marks = [False] * len(stream)
        for i in range(len(stream) - k + 1):
            if len(seen[tuple(stream[i : i + k])]) > 1:
                marks[i : i + k] = [True] * k
        out.append(marks)
    return out


def test_suffix_array_finds_what_a_window_index_finds():
    draw = np.random.default_rng(1)
    for trial in range(60):
        streams = [draw.integers(0, 3, int(draw.integers(0, 40))) for _ in range(int(draw.integers(1, 6)))]
        owners = [int(draw.integers(0, 4)) for _ in streams]
        got = html_extract.covered([np.array(s, dtype=np.int64) for s in streams], owners, 5)
        assert [g.tolist() for g in got] == brute_covered([s.tolist() for s in streams], owners, 5)


def test_pages_without_article_lose_what_the_host_repeats(spark):
    head = "Welcome to our site with all the news of the day and more"
    foot = "All rights reserved by the owner of this site since the year two thousand"
    rows = [(i, "http://h.example/x", f"<body><div>{head}</div><div>Story number {i} tells of thing{i} and place{i} at time{i}.</div><div>{foot}</div></body>") for i in range(5)]
    rows.append((9, "http://other.example/", f"<div>{head}</div>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == {**{i: f"Story number {i} tells of thing{i} and place{i} at time{i}." for i in range(5)}, 9: head}


def test_blocks_and_left_out_parts(spark):
    page = """<html><head><title>T</title></head><body><header>Site</header><nav>Menu</nav>
      <main><header><h1>Head &amp; line</h1></header><p>One&nbsp;  two <b>three</b><br>four<p class="ad-box">Buy</p>
      <aside>Side</aside><form>Name <input></form><script>if (a<b) x="</p>"</script><!-- no > --><ul><li>i<li>j</ul>
      <div id="comments"><p>First!</p></div><p>5 < 6 &lt;tag&gt; <span class="reads">ok</span></main>
      <div class="cookie-notice">Cookies</div><footer>Foot</footer></body></html>"""
    cases = [(1, None, None), (2, "", ""), (3, "http://[bad", page), (4, "u", "plain & text"), (5, "u", "<" * 5000 + "x" * 50), (6, "u", "<a '" * 3000 + ">z"), (7, "u", "<i>" * 20000 + "deep"), (3, "http://[bad", page)]
    pages = spark.createDataFrame([(*c, "t") for c in cases], "page_id bigint, url string, html string, text string")
    rows = html_extract.extract(pages).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == len(cases)
    assert got[1] == got[2] == "" and got[4] == "plain & text" and got[7] == "deep"
    assert got[3] == "Head & line\nOne two three\nfour\ni\nj\n5 < 6 <tag> ok"
    assert html_extract.extract(pages.filter("false")).count() == 0


def test_layout_names_keep_the_article():
    kinds = lambda page: {text: kind for kind, text in html_extract.blocks_of(page)}
    for name in ("content-sidebar-wrap", "layout has-sidebar", "elementor-element elementor-widget", "widget"):
        got = kinds(f'<div class="{name}"><article><h2 id="related-work">Head</h2><p>Text</p><p id="legal-analysis">More</p></article></div>')
        assert got == dict.fromkeys(("Head", "Text", "More"), html_extract.ARTICLE), name
    for name in ("cookie-banner", "related-posts", "ad-slot", "site-footer", "sidebar", "newsletter signup", "share_buttons"):
        assert kinds(f'<article><p>Text</p><div class="{name}">Other</div></article>')["Other"] == html_extract.NEVER, name
    for around in ("aside", "nav", "div hidden", 'div role="dialog"'):
        assert kinds(f"<{around}><article>Text</article></{around.split()[0]}>")["Text"] == html_extract.NEVER, around


def test_what_two_pages_of_a_large_host_share_is_found_wherever_they_lie(spark):
    # Scripts make the host large; each passage stands on two of its pages only.
    passage = lambda pair: " ".join(f"shared{pair}word{n}" for n in range(12))
    rows = [
        (i, "http://h.example/x", f"<script>{'x' * 250_000}</script><div>{passage(i // 2)}</div><p>Own{i} text of page{i} with its{i} words{i}.</p>")
        for i in range(16)
    ]
    rows.append((None, "http://h.example/y", f"<div>{passage(99)}</div>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = html_extract.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == {
        **{i: f"Own{i} text of page{i} with its{i} words{i}." for i in range(16)}, None: passage(99)
    }
    assert all(r["n_repeated"] == (0 if r["page_id"] is None else 12) for r in got)


def test_pages_with_an_article_are_compared_too(spark, monkeypatch):
    # Groups of a few pages, and one id with more rows than a group holds.
    monkeypatch.setattr(html_extract, "GROUP_BYTES", 4_000, raising=False)
    draw = np.random.default_rng(3)
    phrase = lambda n: " ".join(f"w{x}" for x in draw.integers(0, 40, n))
    shared = [phrase(int(n)) for n in draw.integers(6, 14, 12)]
    rows = []
    for i in range(90):
        text = [phrase(int(draw.integers(0, 9))) + f" own{i}", shared[i % 12], phrase(3) + " " + shared[(5 * i) % 12]]
        body = "".join(f"<p>{part}</p>" for part in text)
        kind = ("article", "article", "div", "main")[i % 4]
        page_id = None if 20 <= i < 40 else 7 if i == 50 else i
        rows.append((page_id, f"http://h{i % 3}.example/x", f"<nav>{shared[0]}</nav><{kind}>{body}</{kind}>"))
    rows += rows[:6] + [(200, None, None), (201, "u", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["url"] or "", r["text"], r["n_repeated"]) for r in html_extract.extract(pages).collect())

    kinds = [html_extract.blocks_of(page or "") for _, _, page in rows]
    words = [[(kind, text.split(" ")) for kind, text in page] for page in kinds]
    expected = []
    for host in {html_extract.host_of(url) for _, url, _ in rows}:
        at = [i for i, (_, url, _) in enumerate(rows) if html_extract.host_of(url) == host]
        marks = brute_covered([[w for _, part in words[i] for w in part] for i in at], [rows[i][0] for i in at], html_extract.MIN_RUN)
        for i, mark in zip(at, marks):
            page_id, url, _ = rows[i]
            text = "\n".join(t for k, t in kinds[i] if k == html_extract.ARTICLE) if any(k == html_extract.ARTICLE for k, _ in kinds[i]) else html_extract.main_text(words[i], np.array(mark, dtype=bool))
            expected.append((page_id is None, page_id or 0, url or "", text, sum(mark)))
    assert got == sorted(expected)
    assert sum(n for *_, n in got) > 1_000 and any(n == 0 for *_, n in got)
