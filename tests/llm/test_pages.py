import html
import re
import time
from collections import defaultdict
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import htmltree, wrapper

PAGES = "/root/testdata/sf0.1/pages.parquet"
PAGE = '<html><head><title>T</title></head><body><div class="top">Site of things</div><nav><a href="/">home</a></nav><p>Subscribe now</p><p>{}</p><p>{}</p><div class="comments"><p>reader</p></div></body></html>'


def extracted(spark, rows, **how):
    return {r.page_id: r for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **how).collect()}


def test_wrappers(spark):
    rows = [(i, f"http://h/{i}", PAGE.format(f"one &amp; {i}", f"two\n <b>{i}</b>")) for i in range(20)]
    rows += [(90, "http://h/90", None), (91, None, "<p>alone<br>here<p>unclosed &lt;x"), (92, "odd", ""), (None, "http://h/9", "<div>" * 500 + "deep")]
    got = extracted(spark, rows)
    assert all(got[i].text == f"one & {i}\ntwo {i}" for i in range(20))
    assert (got[90].text, got[91].text, got[92].text, got[None].text) == ("", "alone here\nunclosed <x", "", "deep")
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_only_the_constant_text_goes(spark):
    """A page with another text at a constant node keeps it, and copies of one article don't make it template."""
    rows = [(i, f"http://h/{i}", f"<body><div>Our motto</div><article><p>Opening {i}</p><p>{'body ' * 30}{i}</p></article></body>") for i in range(30)]
    rows += [(50, "http://h/50", "<body><div>A real lead</div><article><p>Opening 50</p><p>text</p></article></body>")]
    rows += [(100 + i, f"http://k/{i}", "<body><article><p>Copied opening</p><p>copied body</p></article></body>") for i in range(40)]
    got = extracted(spark, rows)
    assert got[50].text == "A real lead\nOpening 50\ntext" and got[3].text == f"Opening 3\n{'body ' * 30}3"
    assert all(got[100 + i].text == "Copied opening\ncopied body" for i in range(40))


def test_long_pages_have_wrappers(spark):
    body = "".join(f"<p>paragraph {k} " + "word " * 20 + "</p>" for k in range(2500))
    rows = [(i, f"http://h/{i}", f"<body><div>Bare slogan</div>{body.replace('paragraph', f'part{i}')}<div>Bare footline</div></body>") for i in range(12)]
    for r in extracted(spark, rows).values():
        assert "Bare" not in r.text and r.text.count("\n") == 2499


def test_all_text_of_articles_stays(spark):
    rows = [
        (1, "http://a/1", '<p>Lead paragraph<article><h1>T</h1><p class="related">kept</p><div class="search widget">also</div><button>press</button><math>x+1</math><noscript>plain</noscript></article><p>more body text'),
        (2, "http://a/2", '<p><a href="/x">One link is a paragraph</a></p><p>Then text</p>'),
        (3, "http://a/3", '<article><header><h1>Title</h1></header><p>text</p><section class="comments"><p>reader</p></section><form><input><p>send</p></form><footer>foot</footer></article><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul>'),
    ]
    got = extracted(spark, rows)
    assert got[1].text == "Lead paragraph\nT\nkept\nalso\npress\nx+1plain\nmore body text"
    assert got[2].text == "One link is a paragraph\nThen text" and got[3].text == "Title\ntext"


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.read.parquet(PAGES).where("page_id % 2 = 0").cache()
    made = {(h, i): {r.page_id: r.text for r in wrapper.extract(pages, hints=h, induced=i).collect()} for h in (True, False) for i in (True, False)}
    return {r.page_id: r for r in pages.collect()}, made


def article(page):
    inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(p for p in parts if p)


def test_articles_are_whole(found):
    pages, made = found
    assert made[True, True] == {i: article(r.html) for i, r in pages.items()}


def test_the_wrapper_decides(found):
    """Without hints of markup the wrapper alone takes menus off most pages, all but the article off some, and loses no article."""
    pages, made = found
    alone, nothing = made[False, True], made[False, False]
    assert sum(len(alone[i]) < len(nothing[i]) for i in pages) > 0.7 * len(pages)
    assert all(set(article(r.html).split("\n")) <= set(alone[i].split("\n")) for i, r in pages.items())
    assert sum(alone[i] == article(r.html) for i, r in pages.items()) > 0.02 * len(pages)


def test_wrappers_by_brute_force(found):
    """Votes and decisions in plain Python, from the blocks of each page aligned with its host's reference."""
    pages, made = found
    hosts = defaultdict(list)
    for r in pages.values():
        hosts[re.sub("^https?://", "", r.url).split("/")[0].split(":")[0].split("?")[0].split("#")[0].lower()].append(r)
    matcher = htmltree.Matcher()
    for rows in hosts.values():
        sizes = sorted(len(r.html) for r in rows)
        quarter = sizes[max(0, -(-len(sizes) // 4) - 1)]
        reference = htmltree.parse(min(rows, key=lambda r: (abs(len(r.html) - quarter), r.page_id)).html)
        htmltree.numbered(reference)
        blocks = {r.page_id: wrapper.page_blocks(r.html, reference, matcher) for r in rows}
        votes = defaultdict(lambda: defaultdict(dict))
        for of in blocks.values():
            content = tuple(sorted((b[0] for b in of), key=lambda t: (-len(t), -crc32(t.encode())))[:3])
            for t, node, crc, linked, flags in of:
                votes[node][crc].setdefault(content, [0, 0, 0])
                votes[node][crc][content] = [max(x, y) for x, y in zip(votes[node][crc][content], (len(t), linked, flags & 4))]

        def template(node, crc, linked, size):
            if node < 0 or (total := sum(map(len, votes[node].values()))) < 10:
                return False
            each = [x for of in votes[node].values() for x in of.values()]
            chars, links, inside = sum(x[0] for x in each), sum(x[1] for x in each), any(x[2] for x in each)
            n, kinds = len(votes[node][crc]), len(votes[node])
            if n > 1 and (n >= max(10, 0.6 * total) or not inside and kinds <= 0.5 * total and n >= 0.005 * total):
                return True
            return not inside and links > 0.5 * chars and linked > 0.5 * size

        for i, of in blocks.items():
            want = "\n".join(t for t, node, crc, linked, _ in of if not template(node, crc, linked, len(t)))
            assert made[False, True][i] == want


def test_clashing_columns_ties_and_repeats(spark):
    rows = [(7, "http://h/1", f"<p>text {k % 3}</p>", "x", 1) for k in range(40)]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, blocks int")).collect()
    assert sorted(r.text for r in got) == sorted(f"text {k % 3}" for k in range(40))
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page", ["<a" * 200_000, '<a b="' + "<p>x</p>" * 40_000, "<a '\">" * 40_000, '<a ">' * 40_001, "<" * 300_000, "<!--" * 100_000, "<script>" * 40_000, "<p class=" * 50_000 + ">", "&" * 200_000, "<div>" * 40_000 + "x"], ids=lambda p: p[:9])
def test_odd_markup_takes_little_time(page):
    reference = htmltree.parse(page[: len(page) // 2])
    htmltree.numbered(reference)
    began = time.perf_counter()
    wrapper.page_blocks(page, reference, htmltree.Matcher())
    assert time.perf_counter() - began < 8


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/=\"' apdivul!-&;x", max_size=120))
def test_any_markup_parses(markup):
    wrapper.page_blocks(markup, None, htmltree.Matcher())
