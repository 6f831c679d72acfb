import base64
import hashlib
import json
import random
import re
import time
from html import unescape

from hearthline.llm import extraction, html, warc
from hearthline.llm.html import lines

ARTICLE = """<html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>Head &amp; tail</h1><p>First   <b>bold</b>&nbsp;line<br>goes on.<p>Second one.
<aside>Read also</aside><form><input><label>Mail</label></form><script>var x = "<p>no</p>";</script>
<ul><li>point one<li>point <a href="x">two</a></ul><p><a href=y>All of it a link</a></p>
<div id="comments"><article class="comment"><p>Nice read!</p></article></div></article></main>
<div class="ad">Buy now</div><footer>&copy; us</footer></body></html>"""
WANT = "Head & tail\nFirst bold line goes on.\nSecond one.\npoint one\npoint two\nAll of it a link"


def test_main_text_of_pages(spark, table):
    pages = table("pages")
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    for page in pages.collect():
        body = re.search(r"<article>(.*?)</article>", page.html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[page.page_id].text == "\n".join(b for b in blocks if b)
        assert got[page.page_id].n_chars == len(got[page.page_id].text)


def test_marked_and_unmarked_pages():
    assert extraction.main_text(ARTICLE) == WANT
    long = "A paragraph of the text that is long enough to be one. " * 3
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><p>Menu<div><p>{long}</p><p>Short.</p><p>{long}</p></div>"
    page += "<div><a href=3>Three</a></div>" * 4 + "<p>Stray note"
    text = extraction.main_text(page)
    assert text.count("A paragraph") == 6 and "Short." in text and "Three" not in text and "Stray" not in text


def test_stretches_equal_window_by_window():
    weights = [0, 0, 5, 0, 7, 0, 0, 0, 1, 0, 0, 0, 0, 40, 2, 0]
    assert extraction.stretches(weights, 0) == [(2, 5), (8, 9), (13, 15)]
    assert extraction.stretches(weights, 10) == [(2, 5), (13, 15)]
    assert extraction.stretches([], 0) == [] and extraction.stretches([0, 0], 0) == []


def test_extraction_edges(spark):
    rows = [
        (1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<nav>menu</nav>", "x"), (None, "u", "just text & more", "x"),
        (5, "u", "<p>" + "long words " * 100_000, "x"), (5, "u", "<p>unclosed <b", "x"), (6, "u", "<script>never ends", "x"), (7, "u", "<!-- open <p>x", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extraction.extract(pages)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    found = sorted(((r.page_id, r.n_chars) for r in got.collect()), key=str)
    assert found == sorted([(1, 0), (2, 0), (3, 0), (None, 16), (5, 1_099_999), (5, 8), (6, 0), (7, 0)], key=str)
    assert extraction.extract(pages.limit(0)).count() == 0


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def plain_lines(page):
    """Text of the given pages by hand: all that is no markup, a line for each block."""
    page = re.sub(r"<(script|style|title)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", page, flags=re.S)
    blocks = re.split(r"</?(?:html|head|body|nav|ul|li|div|article|p|h1|footer|main|section|aside|header)\b[^>]*>", page)
    text = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in blocks]
    return "\n".join(t for t in text if t)


def test_any_codec_and_coding(spark):
    import codecs
    import encodings.aliases
    import gzip
    import zlib

    import zstandard

    for name in sorted({*encodings.aliases.aliases.values(), "utf-7", "unicode_escape", "raw_unicode_escape", "nonsense", "idna", "undefined"}):
        for body in (b"caf\xe9 +2AA- \\ud800 \xed\xa0\x80", b"plain"):
            warc.decoded(body, name).encode()
    assert warc.decoded("日本".encode("shift_jis"), "Shift_JIS") == "日本" and codecs.lookup("latin-1").name in warc.ENCODINGS
    page = b"<p>One &amp; two</p>" * 50
    raw = zlib.compressobj(wbits=-15)
    chunks = b"5;x=y\r\n" + page[:5] + b"\r\n" + f"{len(page) - 5:X}".encode() + b"\r\n" + page[5:] + b"\r\n0\r\n\r\n"
    cases = [
        (b"Content-Encoding: gzip", gzip.compress(page)), (b"content-encoding: Deflate", zlib.compress(page)),
        (b"Content-Encoding: deflate", raw.compress(page) + raw.flush()), (b"Content-Encoding: zstd", zstandard.compress(page)),
        (b"Transfer-Encoding: chunked", chunks), (b"Content-Encoding: identity", page),
        (b"Content-Encoding: deflate, gzip", gzip.compress(zlib.compress(page))),
        (b"Content-Encoding: gzip", b"no gzip"), (b"Content-Encoding: br", page), (b"Transfer-Encoding: chunked", b"zz\r\n"),
        (b"Content-Encoding: zstd", b"no zstd"), (b"Transfer-Encoding: chunked", b"ff\r\nshort\r\n0\r\n\r\n"),
    ]
    rows = [(f"<{k}>", "u", "d", [("WARC-Block-Digest", f"md5:{k}")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + h + b"\r\n\r\n" + b) for k, (h, b) in enumerate(cases)]
    responses = spark.createDataFrame(rows, "record_id string, target_uri string, date string, warc_headers array<struct<name:string,value:string>>, block binary")
    got = warc.derivatives(responses).collect()
    text = {r.refers_to: r.block for r in got if r.warc_type == "conversion"}
    assert text == {f"<{k}>": "\n".join(["One & two"] * 50) for k in range(7)}
    meta = {r.refers_to: r for r in got if r.warc_type == "metadata"}
    assert len(meta) == len(cases)
    for k, (_, body) in enumerate(cases):
        r = meta[f"<{k}>"]
        assert (r.payload_digest, r.source_block_digest) == (digest(body), f"md5:{k}") and r.source_headers[0].value == f"md5:{k}"


def test_derivatives_of_pages(spark, table):
    pages = table("pages")
    sources = {r.record_id: r for r in warc.responses_of(pages).collect()}
    records = warc.derivatives(warc.responses_of(pages)).collect()
    assert len(sources) == pages.count() and len(records) == 2 * len(sources)
    assert len({r.record_id for r in records}) == len(records)
    for r in records:
        source = sources[r.refers_to]
        head, _, body = source.block.partition(b"\r\n\r\n")
        raw = r.block.encode()
        assert (r.target_uri, r.date) == (source.target_uri, source.date)
        assert (r.block_digest, r.content_length, r.payload_digest) == (digest(raw), len(raw), digest(body))
        assert [f"{h.name}: {h.value}" for h in r.headers] == head.decode().split("\r\n")[1:]
        assert [tuple(h) for h in r.source_headers] == [tuple(h) for h in source.warc_headers]
        if r.warc_type == "conversion":
            assert r.block == plain_lines(body.decode())
        else:
            meta = json.loads(r.block)
            http = meta["HTTP-Response-Metadata"]
            assert meta["WARC-Header-Metadata"]["WARC-Record-ID"] == r.refers_to and http["Status"] == 200
            assert [x["url"] for x in http["HTML-Metadata"]["Links"]] == re.findall(r'href="([^"]*)"', body.decode())
    again = {r.record_id for r in warc.derivatives(warc.responses_of(pages)).collect()}
    assert again == {r.record_id for r in records}


def test_derivative_edges(spark):
    rows = [
        ("<a>", "u", "d", b"HTTP/1.1 404 Not Found\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nContent-Type: text/plain; charset=latin-1\r\nbroken\r\n\r\ncaf\xe9\r\n\r\nx", 1),
        (None, None, None, None, 2), ("<b>", "u", None, b"", 3), ("<c>", "u", "d", b"GET\r\n\r\n<p>hi<a href=x>y</a>", 4), ("<c>", "u", "d", b"GET\r\n\r\n<p>hi<a href=x>y</a>", 4),
        ("<d>", "u", "d", b"HTTP/1.0 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\xff", 5), ("<e>", "u", "d", b"HTTP/1.0 200 OK\r\nno end", 6),
        ("<f>", "u", "d", b'HTTP/1.0 200\r\nContent-Type: text/html\r\n\r\n<meta charset="latin-1"><p>caf\xe9', 7),
    ]
    responses = spark.createDataFrame(rows, "record_id string, target_uri string, date string, block binary, warc_type int")
    got = warc.derivatives(responses).collect()
    text = sorted((r.refers_to, r.block) for r in got if r.warc_type == "conversion")
    assert text == [("<a>", "café\r\n\r\nx"), ("<c>", "hiy"), ("<c>", "hiy"), ("<f>", "café")]
    meta = {r.refers_to: r for r in got if r.warc_type == "metadata"}
    assert [tuple(h) for h in meta["<a>"].headers][:2] == [("Set-Cookie", "a=1"), ("set-cookie", "b=2")]
    assert json.loads(meta["<a>"].block)["HTTP-Response-Metadata"]["Status"] == 404
    assert meta["<d>"].payload_digest == digest(b"\x89PNG\xff") and meta["<e>"].payload_digest == digest(b"")
    assert sum(r.warc_type == "metadata" for r in got) == len(rows)
    record = warc.serialized(warc.derivatives(responses).filter("refers_to = '<a>' AND warc_type = 'conversion'")).first().record
    head, _, block = record.partition("\r\n\r\n")
    assert head.startswith("WARC/1.0\r\nWARC-Type: conversion") and "WARC-Refers-To: <a>" in head and block == "café\r\n\r\nx\r\n\r\n"
    assert warc.derivatives(responses.limit(0)).count() == 0


def test_marks_are_whole_words_and_not_on_the_main_text():
    kept = [
        '<div class="layout has-sidebar"><main><p>Text.</p></main></div>',
        '<div class="sidebar"><main><p>Text.</p></main></div>',
        '<div class="widget"><article><p>Text.</p></article></div>',
        '<form id="aspnetForm"><div id="main"><p>Text.</p></div></form>',
        '<article class="post category-social tag-search"><p>Text.</p></article>',
        '<article class="post social" id="search"><p>Text.</p></article>',
        '<main><p class="notice" aria-label="Search results">Text.</p></main>',
        '<div class="comments"><article class="comment"><p>Text.</p></article></div>',
    ]
    assert [extraction.main_text(p) for p in kept] == ["Text."] * len(kept)
    page = '<article><h2 id="related-work">Related work</h2><section id="search-and-replace"><h2 class="search">Search</h2>'
    page += '<p aria-label="Share">One.</p></section><div aria-label="Search results"><p>Two.</p></div></article>'
    assert extraction.main_text(page) == "Related work\nSearch\nOne.\nTwo."
    dropped = ["cookie-notice", "comment_list", "search", "post sidebar", "share-buttons"]
    dropped = "".join(f'<div class="{c}"><p>Drop.</p></div>' for c in dropped) + "<p hidden>Drop.</p><div role=search>Drop.</div>"
    assert extraction.main_text(f"<main><p>Text.</p>{dropped}</main>") == "Text."
    comments = '<section class="comments"><article class="comment"><p>Drop.</p></article></section>'
    assert extraction.main_text(f"<main><article><p>Text.</p></article>{comments}</main>") == "Text."
    teaser = '<div class="sidebar"><article><p>Drop.</p></article></div>'
    assert extraction.main_text(f"<main><p>Text.</p></main>{teaser}{comments}") == "Text."


def test_open_links_end():
    long = "A paragraph of the text that is long enough to be one. " * 3
    want = [long.strip()] * 2
    for anchor in ("<a name=top>", "<a href=#x>Top", "<a href=1>One<a href=2>Two</a>", "<a name=x><a href=y>Y</a>"):
        for page in (f"{anchor}<p>{long}<p>{long}", f"<div>{anchor}<p>{long}</p><p>{long}</p></div>"):
            text = extraction.main_text(f"<body>{page}")
            assert text.split("\n")[-2:] == want, (anchor, text)
    assert extraction.main_text(f"<p><a href=1>Home<p>{long}<p><a href=2>x</a>{long}").count("A paragraph") == 6
    # A link may hold blocks.
    assert [x.link_chars for x in lines("<a href=1><h3>One</h3><p>Two</p></a><p>Three")] == [3, 3, 0]
    assert [x.link_chars for x in lines("<ul><li><a href=1>One<li>Two<li><a name=y>Three</ul>")] == [3, 0, 0]


def test_short_stretches_of_a_kept_container():
    long = "A paragraph of the text that is long enough to be one. " * 3
    share = "<ul>" + "<li><a href=x>Share</a></li>" * 3 + "</ul>"
    advert = "<div class=ad><p>Buy</p><p>this</p><p>now</p></div>"
    body = "".join(f"<div><p>{long}</p></div>" for _ in range(3))
    page = f"<div><header></header></div><div><h1>Head</h1>{share}{body}{advert}<p>The end.</p></div>{share}<div><p>Stray</p></div>"
    got = extraction.main_text(f"<body>{page}").split("\n")
    assert got == ["Head", *[long.strip()] * 3, "The end."]
    # One paragraph with most of the weight, in a container of its own; flat pages.
    page = f"<div><div><h1>Head</h1></div>{share}<p>{long * 9}</p><p>{long}</p>{share}<p>Last words.</p></div>{share}<p>Stray"
    assert extraction.main_text(f"<body>{page}").split("\n") == ["Head", (long * 9).strip(), long.strip(), "Last words."]
    assert extraction.main_text(f"<h1>Head</h1>{share}<p>{long}</p>").split("\n") == ["Head", long.strip()]


def test_window_by_window():
    rng = random.Random(1)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, 1, 5, 40, 90]) for _ in range(rng.randrange(25))]
        least = rng.choice([0, 4, 50, 85])
        n, w = len(weights), extraction.WINDOW
        sums = {i: sum(weights[max(0, i) : i + w]) for i in range(-w + 1, n)}
        want, i = [], -w + 1
        while i < n:
            if sums[i] == 0:
                i += 1
                continue
            j = i
            while j < n and sums[j] > 0:
                j += 1
            inside = [k for k in range(max(0, i), min(n, j + w - 1)) if weights[k]]
            if max(sums[k] for k in range(i, j)) > least:
                want.append((inside[0], inside[-1] + 1))
            i = j
        assert extraction.stretches(weights, least) == want


def test_stray_quotes_formulas_and_unclosed_elements():
    assert extraction.main_text("<article><p class=x don't>One.</p><p title=\"a>b\" alt='c>'>Two.</p></article>") == "One.\nTwo."
    assert extraction.main_text("<article><p>We have <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here</p></article>") == "We have x=1 here"
    for name in ("svg", "object", "noscript", "canvas", "template"):
        for close in (f"</{name}>", ""):
            page = f"<article><div><p>One <{name} a=b><b>lost</b>{close}</p></div><p>Two.</p></article>"
            assert extraction.main_text(page) == "One\nTwo.", name
        assert extraction.main_text(f"<article><p>One <{name}><p>lost</p><div>lost</div></{name}> more</p></article>") == "One more"
        assert extraction.main_text(f"<article><p>One <{name} /> more</p></article>") == "One more"


def test_time_is_in_proportion_to_the_page():
    for part in ("<div><p>x", "<div>x</p></b></div></div>", "<div><h2>some words</h2><a href=x>y", "<a href=x><svg><p>z", "<main><article>t"):
        page = part * (1_000_000 // len(part))
        start = time.process_time()
        extraction.main_text(page)
        assert time.process_time() - start < 12, part


def test_containers_of_most_weight():
    long = "A paragraph of the text that is long enough to be one. " * 3
    deep = "<div>" * 300 + f"<p>{long}</p><p>{long}</p>" + "</div>" * 300
    assert extraction.main_text(f"<body><div><a href=x>Home</a></div>{deep}").split("\n") == [long.strip()] * 2


def test_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "u", "<p>hi", "a", "b", 5)], "page_id long, url string, html string, text_ string, `x.y` string, n_chars int")
    got = extraction.extract(pages)
    assert [tuple(r) for r in got.collect()] == [(1, "u", "<p>hi", "a", "b", "hi", 2)]


def test_spaces_and_addresses_of_any_kind():
    """White space as Python's regular expressions have it, and addresses whatever the case of their attribute."""
    spaces = "".join(c for c in map(chr, range(0x110000)) if re.fullmatch(r"\s", c))
    assert html.tidy([spaces, "a", spaces, "&nbsp;b", "​", spaces]) == "a b​"
    page = "<p data-x=1 class=hrefs>x</p><IMG SRC=' y ' ALT=z><a\nHRef=u>t t</a><form ACTION=f><object data=d><video poster=p><p title=q>"
    assert html.links(page) == [("IMG@/src", "y", "z"), ("A@/href", "u", "t t"), ("FORM@/action", "f", ""), ("OBJECT@/data", "d", ""), ("VIDEO@/poster", "p", "")]
