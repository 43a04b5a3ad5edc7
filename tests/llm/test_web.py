import base64
import hashlib
import random
import time

import numpy as np
import pytest

from panelyard.llm import html_text, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav><!-- note --><div class="ad">Buy this.</div>
<article><h1>A  title &amp; more</h1><p>First   text
 here.<p>Second <b>bold</b> text &lt;ok&gt; goes on for some more words here.</p><ul><li>point one is said.</li></ul></article>
<div class="comments"><p>Nice post, thanks a lot.</p></div><footer>&copy; me</footer></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string, text string, sha1 string, time string")

    return make


ROWS = [(2, "http://b.example.org/x?q=1", PAGE, "t", "s", "z"), (1, "https://a.example.org", PAGE, "t", "s", "z"), (3, None, None, None, None, None), (4, "nonsense\n", "", "t", "s", "z"), (5, "http://a.example.org/", "<p>unclosed &am", "t", "s", "z"), (5, "http://a.example.org/", "<p>unclosed &am", "t", "s", "z"), (None, "http://c.org/", PAGE, "t", "s", "z"), (7, "http://c.org/", "<div>" * 300 + "deep" + "x \r\n\r\n" * 3000, "t", "s", "z")]


def test_blocks():
    out = [b.text for b in html_text.blocks(PAGE)]
    assert out == ["Home", "More", "Buy this.", "A title & more", "First text here.", "Second bold text <ok> goes on for some more words here.", "point one is said.", "Nice post, thanks a lot.", "\xa9 me"]
    assert html_text.blocks("") == [] and [b.text for b in html_text.blocks("a<br>b")] == ["a b"]


def test_elements_without_end_tags_keep_the_rest():
    own = lambda page: [b.text for b in html_text.blocks(page)]
    for head in ("<head><title>T</title>", "<head><meta charset=x><script>'</head><p>'</script>", "<head>"):
        assert own(f"<html>{head}<body><article><p>One.<p>Two.</article>") == ["One.", "Two."]
        assert own(f"<html>{head}<p>One.<p>Two.") == ["One.", "Two."]
    assert own("<head><title>T</title>Plain text.") == ["Plain text."]
    assert own("<head><title>T</title><style>p{}</style></head>Text.") == ["Text."]
    for tag in ("select", "svg", "object", "iframe", "noscript", "template", "math", "textarea"):
        assert own(f"<p>One.</p><{tag} a='b'><p>Two.</p>") == ["One.", "Two."]
        assert own(f"<p>One.</p><{tag}><p>Two.</p><{tag}>no</{tag}><p>Three.</p>") == ["One.", "Two.", "Three."]
        assert own(f"<p>One.</p><{tag}>no<{tag}>no</{tag}>no</{tag}><p>Two.</p>") == ["One.", "Two."]
    assert own("<p>One.</p><script>var a;<p>Two.</p>") == ["One."]


def test_broken_quotes_are_no_text():
    own = lambda page: [b.text for b in html_text.blocks(page)]
    assert own('<p>One <a href="x>two</a> three.</p><p>Four.</p>') == ["One two three.", "Four."]
    assert own("<p class='a>One.</p><p>Two.</p>") == ["One.", "Two."]
    assert own("<p>One.</p><p>Two <a href=") == ["One.", "Two"]
    assert own("<p>if a < b and b <c then") == ["if a < b and b"] and own("<p>a <b and c < d</p>") == ["a <b and c < d"]
    assert own("<p title='a > b'>One.</p>") == ["One."]


def test_deep_nesting_takes_time_in_proportion():
    import time

    def seconds(n, tag):
        began = time.perf_counter()
        cut = html_text.blocks(f"<p><{tag} class='x'>x y" * n)
        assert html_text.vectors(cut).shape[0] == len(cut) > 0
        return time.perf_counter() - began

    for tag in ("div", "b", "h1"):
        seconds(500, tag)
        assert seconds(16_000, tag) < 12 * max(seconds(4_000, tag), 0.02)


def test_long_pages_among_short_ones():
    net = html_text.trained()
    cut = [html_text.blocks(PAGE)] * 60 + [html_text.blocks("<article>" + "<p>A sentence of the text stands here.</p>" * 20_000 + "</article>"), []]
    told = net.labels([html_text.vectors(c) for c in cut])
    assert [len(t) for t in told] == [len(c) for c in cut]
    one = net.labels([html_text.vectors(cut[0])])[0]
    assert np.allclose(told[0], one, atol=1e-4) and told[60].mean() > 0.5


#: Pages as outside authors lay them out, with their main text marked by hand.
OUTSIDE = [
    ("<!doctype html><title>A</title><body><div id=top><a href=/>Home</a> | <a href=/n>News</a></div><div class='post-body entry-content'><h2>On rivers</h2>The river rose for three days.<br><br>Then it fell again, and the town was dry.</div><div id=comments><h4>2 comments</h4><p>Great post!</p></div><div class=footer>Copyright 2020</div>", "On rivers\nThe river rose for three days. Then it fell again, and the town was dry."),
    ("<html><head><meta charset=utf-8><body><header><h1>The Daily</h1><nav><a href=1>World</a><a href=2>Sport</a></nav></header><main><article><h1>Rain is late</h1><p>Farmers wait for rain this year.</p><figure><img src=x></figure><p>Wells are low.</p></article></main><aside><h3>Most read</h3><ul><li><a href=3>One</a></li></ul></aside><footer><p>Contact us</p></footer>", "Rain is late\nFarmers wait for rain this year.\nWells are low."),
    ("<html><body><form action=/s><input name=q><button>Search</button></form><div class='article-content'><p>First part of the text is here.</p><ul><li>One point of it.</li><li>Another point.</li></ul></div><div class='cookie-banner'><p>We use cookies.</p><button>OK</button></div></body></html>", "First part of the text is here.\nOne point of it.\nAnother point."),
]


def test_outside_layouts(pages):
    rows = [(i, "u", page, "t", "s", "z") for i, (page, _) in enumerate(OUTSIDE)]
    out = {r.page_id: r.text.split("\n") for r in html_text.main_text(pages(rows)).collect()}
    want = {i: text.split("\n") for i, (_, text) in enumerate(OUTSIDE)}
    right = sum(len(set(out[i]) & set(want[i])) for i in want)
    assert right / sum(map(len, want.values())) >= 0.8 and right / sum(map(len, out.values())) >= 0.8


def test_main_text(pages, spark):
    out = {r.page_id: r for r in html_text.main_text(pages(ROWS)).collect()}
    want = "A title & more\nFirst text here.\nSecond bold text <ok> goes on for some more words here.\npoint one is said."
    assert out[1].text == out[2].text == want and out[1].n_chars == len(want)
    assert out[3].text == "" and out[3].n_chars == 0 and out[4].text == ""
    assert html_text.main_text(pages([])).count() == 0


def test_labeller_on_unseen_layouts():
    words = "some words of many that a page may hold in its text today".split()
    net = html_text.trained()
    rng, right, total = random.Random(77), 0, 0
    for _ in range(120):
        page, mark = html_text.layout(rng, words)
        cut = html_text.blocks(page)
        truth = [b.text.startswith(mark) for b in cut]
        for b in cut:
            b.text = b.text.lstrip(mark) or " "
        told = net.labels([html_text.vectors(cut)])[0] >= 0.5
        right += sum(a == b for a, b in zip(told, truth))
        total += len(truth)
    assert right / total > 0.97


def test_archives_round_trip(pages):
    out = warc.archived(pages(ROWS)).collect()
    assert len(out) == len(ROWS)
    html = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in out:
        if r.page_id is not None:
            assert r.payload_bytes == len(html[r.page_id])
            assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in out}
    assert {(1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (7, "response", None)} == kinds
    assert warc.archived(pages([])).count() == 0


def test_small_payloads_are_not_deduplicated(pages):
    out = {(r.page_id, r.record_type) for r in warc.archived(pages(ROWS), min_payload=1).collect()}
    assert (4, "response") in out and (2, "revisit") in out


def test_histories_are_in_global_order(pages):
    rows = [(i, f"http://h{i % 7}.org/p{i % 3}", f"x{i}", "t", "s", "z") for i in range(400)]
    parts = warc.archived(pages(rows)).select("urlkey", "time", "page_id").rdd.glom().collect()
    keys = [tuple(r) for part in parts for r in part]
    assert keys == sorted(keys) and len(keys) == 400


def test_urls_are_escaped_before_they_are_sorted(pages):
    urls = ["http://a/b c", "http://a/b!c", "http://a/b$c", "http://a/b\x01", "http://a/b\x7fz", "http://a/é b", "http://a/", "", None, "no scheme"]
    rows = [(i if i % 5 else None, url, f"x{i}", "t", "s", "z") for i, url in enumerate(urls * 9)]
    parts = warc.archived(pages(rows)).select("urlkey", "time", "page_id").rdd.glom().collect()
    keys = [(r.urlkey, r.time, r.page_id is None, r.page_id or 0) for part in parts for r in part]
    assert keys == sorted(keys) and len(keys) == len(rows)
    assert not any(c in key for key, *_ in keys for c in " \x01\x7f") and any("b%20c" in key for key, *_ in keys)


def test_a_very_large_page_beside_large_ones(pages):
    rows = [(i, f"http://a/{i % 4}", f"{i} " + "é中 y" * 200_000, "t", "s", "z") for i in range(15)] + [(99, "http://a/0", "z" * (17 << 20) + "end", "t", "s", "z")]
    out = {r.page_id: r for r in warc.archived(pages(rows)).collect()}
    assert len(out) == 16
    for i, _, html, *_ in rows:
        assert out[i].payload_bytes == len(html.encode()) and out[i].payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


def test_quotes_of_any_length_and_open_elements():
    for n in (4_000, 80_000, 3_000_000):
        page = f'<p>one</p><img src="data:image/svg+xml,x<b>{"y" * n}"><p>two</p>'
        assert [b.text for b in html_text.blocks(page)] == ["one", "two"]

    def seconds(page):
        began = time.perf_counter()
        html_text.blocks(page)
        return time.perf_counter() - began

    for part in ("<noscript>", '<a title="x>', "<p 'q", "<!-- ", '<svg "', "<svg>", "<!", "<select><option "):
        assert seconds("<head>" + part * 32_000) < 12 * max(seconds("<head>" + part * 8_000), 0.02), part


def test_loser_tree():
    r = random.Random(0)
    for k in range(9):
        for _ in range(20):
            runs = [sorted((r.randint(0, 9),) for _ in range(r.randint(0, 6))) for _ in range(k)]
            assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_members_and_large_records(pages, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 2000)
    rows = [(i, f"http://h{i % 3}.org/{i}", "é" * (i * 97 % 5000), "t", "s", "z") for i in range(200)]
    out = {r.page_id: r for r in warc.archived(pages(rows)).collect()}
    assert len(out) == 200
    for i, _, html, *_ in rows:
        first = min(j for j, _, other, *_ in rows if other == html)
        assert out[i].payload_bytes == len(html.encode()) and out[i].refers_to == (None if first == i else first)


def test_a_member_for_each_record(monkeypatch):
    monkeypatch.setattr(warc, "PART", 100)
    head = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {}".format
    payloads = [b"a" * 7, b"\r\n\r\n" * 90, b"", bytes(range(256)) * 3]
    data = b"".join(warc.gzipped(head(len(p)).encode() + warc.BREAK + p + warc.BREAK) + b"\0" for p in payloads)
    assert [p for _, _, p in warc.records_of(data)] == payloads
    for at, _, payload in warc.records_of(data):  # a reader can begin at any record
        assert next(warc.records_of(data[at:]))[2] == payload
    plain = b"".join(head(len(p)).encode() + warc.BREAK + p + warc.BREAK for p in payloads)
    assert [p for _, _, p in warc.records_of(plain)] == payloads
    with pytest.raises(ValueError):
        list(warc.records_of(data[:-5]))
