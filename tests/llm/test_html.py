import random
import time

import pytest

from lodestone.llm import html_extract as H

P = "plain words of the article that go on for a while and say something "


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{P}<p>Of.<br></article><footer>(c)</footer>", f"Title\n{P.strip()}\nOf."),
        (f"<article><header><h1>T</h1></header><p>{P}</p><div class='ad'>buy</div><aside>more</aside><p>End &amp; out&nbsp;&#33;</p><section id=comments><p>{P}</p></section></article>", f"T\n{P.strip()}\nEnd & out !"),
        (f"<main><script>var t='</p>';</script><p>a <b>b</b>\n\tc</p><style>p{{}}</style><p>{P}</p><form><p>mail <input></p></form></main>", f"a b c\n{P.strip()}"),
        (f"<div class=menu><a>x</a></div><div><p>{P}</p><p>Short.</p><p>{P}</p></div><div id='cookie-notice'>{P}</div>", f"{P.strip()}\nShort.\n{P.strip()}"),
        ("<article><p>cut off in a ta", "cut off in a ta"),
        ("<article><p>1 < 2 and a&b</p><!-- <p>no</p> -->", "1 < 2 and a&b"),
    ],
)
def test_main_text(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(
    "gap", ["<aside><p>a</p><p>b</p><p>c</p></aside>", f"<div class='ad'>{'<p>' + P + '</p>'}<p>b</p><p>c</p><p>d</p></div>", "<ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul>"]
)
def test_unmarked_article_goes_on_after_a_gap(gap):
    page = f"<div class=nav><a>Home</a></div><div><p>{P * 4}</p>{gap}<p>Short.</p>{gap}<p>{P * 3}</p></div><div class=footer>(c)</div>"
    assert H.main_text(page) == f"{(P * 4).strip()}\nShort.\n{(P * 3).strip()}"


def test_short_unmarked_article():
    assert H.main_text("<div class=nav><a>Home</a></div><div><p>All there is.</p></div>") == "All there is."


def test_regions_surge_and_dive():
    w = [0, 30, 60, 0, 10, 0, 0, 0, 5, 0, 0, 0, 90]
    assert H.regions(w) == [(1, 5), (12, 13)]
    assert H.regions([0, 5, 0, 0, 0, 3]) == [(1, 2)]  # below SURGE everywhere: the page's largest window is the level


def brute_regions(w, surge):
    """Any two lines with weight belong together unless a window between them is empty."""
    sums = [sum(w[i : i + H.WINDOW]) for i in range(len(w))]
    heavy, groups = [i for i, x in enumerate(w) if x], []
    for i in heavy:
        if groups and all(sums[groups[-1][-1] : i]):
            groups[-1].append(i)
        else:
            groups.append([i])
    level = min(surge, max(sums, default=0))
    return [(g[0], g[-1] + 1) for g in groups if max(sums[g[0] : g[-1] + 1]) >= level]


def test_regions_against_brute_force():
    rng = random.Random(3)
    for _ in range(2000):
        w = [rng.choice([0, 0, 0, 0, 5, 30, 70]) for _ in range(rng.randrange(20))]
        assert H.regions(w, 80) == brute_regions(w, 80)
        assert H.windows(w) == [w[i] + (w[i + 1] if i + 1 < len(w) else 0) + (w[i + 2] if i + 2 < len(w) else 0) for i in range(len(w))]


LINKS = "<ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul>"


def test_a_marked_article_keeps_its_ends():
    page = f"<article><p>{P * 3}</p>{LINKS}<p>Filed by staff</p></article>"
    assert H.main_text(page) == (P * 3).strip() + "\nFiled by staff"
    assert H.main_text(f"<article><p>{P * 3}</p>{LINKS}<p>{P * 2}</p></article>") == (P * 3).strip() + "\n" + (P * 2).strip()
    # Without the mark, what shares the text's container stays and what does not goes.
    assert H.main_text(f"<div><p>{P * 3}</p>{LINKS}<p>The end.</p></div><div>{LINKS}<p>Copyright 2020</p></div>") == (P * 3).strip() + "\nThe end."


WHOLE = f"{(P * 4).strip()}\n{(P * 4).strip()}"
TWO = f"<p>{P * 4}</p><p>{P * 4}</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="content has-sidebar">{TWO}</div>',
        f'<div class="layout with-sidebar"><article>{TWO}</article></div>',
        f'<div class="post no-comments">{TWO}</div>',
        f'<div id="page-with-header">{TWO}</div>',
        f'<div class="sidebar-right"><div>{TWO}</div><div class="sidebar"><p>{P}</p></div></div>',
        f'<div class="menu"><article>{TWO}</article></div><div class="menu"><p>{P}</p></div>',
        f'<form id="aspnetForm"><div class="nav"><a>Home</a></div>{TWO}<div class="footer">{P}</div></form>',
        f'<div class="social history">{TWO}</div><p>Copyright 2020</p>',
        f'<div class="research notice-board notice">{TWO}</div><p>(c) us</p>',
        f'<div class="entry">{TWO}</div><section class="reply"><p>{P}</p><p>{P * 9}</p></section>',
        f'<div class="entry">{TWO}</div><div class="comments">{"<article class=comment-body><p>" + P * 3 + "</p></article>"}{"<article><p>" + P * 3 + "</p></article>"}</div>',
        f'<div class="entry">{TWO}</div><div id="commentList"><p>{P * 20}</p></div>',
        f'<div class="site-header"><p>{P}</p></div><div class="main-content">{TWO}</div><div class="site-footer"><p>{P * 3}</p></div>',
        f'<div class="content">{TWO}<div class="cookie-consent"><p>{P * 4}</p></div></div>',
    ],
)
def test_class_words_are_weighed(page):
    assert H.main_text(page) == WHOLE
    assert H.main_text(f"<html><body>{page}</body></html>") == WHOLE


def test_hints_by_plain_rules():
    """Random trees of hinted elements: which text goes, by looking at each element's whole content."""
    rng = random.Random(11)
    for _ in range(400):
        lines, hints = [], []

        def grow(parent, depth):
            for _ in range(rng.randrange(1, 4)):
                kind = rng.choice(["", "frame", "added", "comments"]) if depth < 4 else ""
                if not kind:
                    lines.append(H.Line("x", rng.choice([0, 5, 40, 90, 400]), False, False, False, False, parent))
                else:
                    hints.append(H.Hint(kind, parent, 0, rng.random() < 0.1))
                    grow(len(hints) - 1, depth + 1)

        grow(-1, 0)
        around = [[k for k in range(len(hints)) if k == h or h in under(hints, k)] for h in range(len(hints))]
        for h, own in zip(hints, range(len(hints))):
            h.text = sum(x.plain for x in lines if x.hint == own)
        content = [sum(x.plain for x in lines if x.hint in a) for a in around]
        marked = [any(hints[k].marked and all(hints[j].kind == "frame" for j in [k, *under(hints, k)][: [k, *under(hints, k)].index(h)]) for k in around[h]) for h in range(len(hints))]
        free = [x.plain for x in lines if x.hint < 0]
        surges = any(sum(free[i : i + 3]) >= H.SURGE for i in range(len(free)))
        every = sum(x.plain for x in lines)
        keep = []
        for h, x in enumerate(hints):
            most = content[h] * 2 > every
            wrapper = marked[h] or (most and (not surges or content[h] >= 4 * sum(free)))
            keep.append({"frame": wrapper, "added": most and not surges and content[h] > 4 * sum(free), "comments": False}[x.kind])
        want = [not all(keep[k] for k in [h, *under(hints, h)]) for h in range(len(hints))]
        assert H.dropped(hints, lines) == want


def under(hints, k):
    """The elements around one, from inner to outer."""
    out = []
    while hints[k].parent >= 0:
        k = hints[k].parent
        out.append(k)
    return out


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>ok</p><p>fine</p></article>", "ok\nfine"),
        ("<p>a <span class=ad><span>x</span>BUY NOW</span> b</p>", "a b"),
        ('<article class="story related"><p>Text.</p></article>', "Text."),
        ('<div class="social history"><p>Text.</p></div>', "Text."),
        (f'<div class="social history"><p>Share</p></div><div><p>{P}</p></div>', P.strip()),
        ('<article class="comment"><p>Text.</p></article>', ""),
        (f"<div><p>{P * 4}</p><div class=ad><p>{P}</p><p>{P}</p><p>{P}</p></div><p>{P * 3}</p><p>{P * 2}</p></div>", "\n".join((P * i).strip() for i in (4, 3, 2))),
        (f"<article><h1><a>Title</a></h1><p>By A</p><p>Today</p><p>{P}</p></article>", f"Title\nBy A\nToday\n{P.strip()}"),
        ('<p title="a > b">x</p><p title=\'it"s\'>y</p>', "x\ny"),
    ],
)
def test_hints_and_depth(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '", "<div><b>", "<b><i></b>", "<!-- ", "<script>", "<span class=ad>", "<div class=menu><p>x", "<div class=ads><article>y"])
def test_time_is_linear_in_the_page(piece):
    began = time.time()
    H.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 10


def test_table(spark):
    long = f"<article>{'<p>' + P + '</p>'}" * 1
    rows = [(1, "u", long, 5), (1, "u", long, 5), (None, None, None, None), (3, "u", "<p>" + "x " * 200_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    out = H.extract(df).collect()
    assert len(out) == 4 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert {r["text"] for r in out if r["page_id"] is None} == {""}
    assert H.extract(df.limit(0)).count() == 0
