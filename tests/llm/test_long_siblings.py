import random
import time

import pytest

from tidemark.llm import htmltree, wrapper


def tree(markup):
    root = htmltree.parse(markup)
    htmltree.numbered(root)
    return root


def listed(r, n, kinds):
    """n siblings of several structures and labels, in no order."""
    one = lambda k: f"<p>{'<b>x</b>' * (k % 5)}{'<i>y</i>' * (k % 3)}</p>" if k % 4 else f"<div class=k{k}><p>z</p></div>"
    return "<body>" + "".join(one(r.randrange(kinds)) for _ in range(n)) + "</body>"


@pytest.mark.parametrize("held", [1, 1 << 22])
def test_long_lists_match_as_short_ones_do(monkeypatch, held):
    """The result doesn't depend on which way is taken."""
    monkeypatch.setattr(htmltree, "HELD_WEIGHTS", held)
    r = random.Random(5)
    for _ in range(150):
        a, b = tree(listed(r, r.randrange(40), r.choice((2, 9, 40)))), tree(listed(r, r.randrange(40), r.choice((2, 9, 40))))
        both = []
        for limit in (0, 1 << 40):
            monkeypatch.setattr(htmltree, "SIBLING_PAIRS", limit)
            both.append(htmltree.Matcher().align(a, b))
        assert both[0] == both[1]


def test_inserted_siblings_shift_nothing():
    """A page of 800 blocks with 150 more after the first quarter, and other ones at its ends."""
    of = lambda ks: "".join(f"<p>{'<b>x</b>' * (k % 5)}{'<i>y</i>' * (k % 6)}{'<u>z</u>' * (k % 7)}</p>" for k in ks)
    plain = "<body><h1>t</h1>" + of(range(800)) + "<h2>e</h2></body>"
    more = "<body><h3>other</h3>" + of(range(200)) + "<div>more</div>" * 150 + of(range(200, 800)) + "<h4>other</h4></body>"
    a, b = tree(more), tree(plain)
    found = htmltree.Matcher().align(a, b)
    mine, theirs = a.children[0].children, b.children[0].children
    assert all(found[mine[1 + k + 150 * (k >= 200)].number] == theirs[1 + k].number for k in range(800))


def test_many_kinds_and_many_siblings_take_bounded_time():
    of = lambda n, d: "".join(f"<p>{'<b>x</b>' * (k % 7)}{'<i>y</i>' * (k % 11)}{'<u>z</u>' * (k % 13 % d)}</p>" for k in range(n))
    a, b = tree(f"<body><h1>t</h1>{of(600, 12)}<h2>e</h2></body>"), tree(f"<body>{of(600, 13)}<h3>e</h3></body>")
    c, d = tree("<body><h1>t</h1>" + "<p>x<p>y<b>z</b>" * 4000 + "<i>e</i></body>"), tree("<body>" + "<p>y<b>z</b><p>x" * 3000 + "</body>")
    for x, y in ((a, b), (c, d)):
        began = time.perf_counter()
        assert len(htmltree.Matcher().align(x, y)) > 600
        assert time.perf_counter() - began < 30


def test_the_reference_of_a_host_of_many_pages(spark):
    """The page at the lower quartile itself, however many pages a host has and however they are dealt out."""
    n = 120_000
    for parts in (1, 24):
        pages = spark.range(n).repartition(parts).selectExpr("id page_id", "'u' url", "'h' host", "repeat('x', cast(1 + id div 120 as int)) html")
        (found,) = wrapper.references(pages).collect()
        assert len(found.reference) == 1 + (n // 4 - 1) // 120
