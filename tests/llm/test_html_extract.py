import math
import random
import time

import pytest

from quillspan.llm import html_extract
from quillspan.llm.html_extract import extract, extract_pages, smooth, threshold

LONG = "This sentence is part of the article and long enough to count as running text for the ratio."

PAGES = {
    "article": (f"<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}</p><p>Short.</p></article><footer>f</footer></body></html>", f"T & U\n{LONG}\nShort."),
    "no article": (f"<body><div id='menu'><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><div class='content'><h1>T</h1><p>{LONG}<p>{LONG} <b>Bold</b>.<p>x</div><div class='sidebar'><p>{LONG}</p></div></body>", f"T\n{LONG}\n{LONG} Bold.\nx"),
    "comments": (f"<article><h1>T</h1><p>{LONG}</p><section class='comments'><article class='comment'><p>{LONG}</p></article></section><div class='ad'>Buy</div></article>", f"T\n{LONG}"),
    "forms": (f"<main><p>{LONG}</p><form><p>Name</p><input></form><script>if (a<b) x('<p>no</p>')</script><aside><p>{LONG}</p></aside></main>", LONG),
    "white space": (f"<article><p>  a\n\t b&nbsp;c  </p><ul><li>one</li><li>two</li></ul><p>{LONG}</p></article>", f"a b c\none\ntwo\n{LONG}"),
    "broken": (f"<article><h1>T</h1><p><b>{LONG}<br><p>next &copy &am</article><footer>f", f"T\n{LONG}\nnext © &am"),
    "empty": ("", ""),
    "no text": ("<html><body><nav>menu</nav></body></html>", ""),
    "plain": ("just text &lt;here&gt;", "just text <here>"),
    "named blocks": (f"<body><div class='site-header'><p>Site {LONG}</p></div><div id='usercomments'><p>{LONG}</p></div><div class='body'><h1>T</h1><div class='section-header'><p>{LONG}</p></div><p class='commentary'>{LONG}</p></div><div class='cookieBanner'>We use cookies</div></body>", f"T\n{LONG}"),
    "headers in an article": (f"<article><h1>T</h1><div class='section-header'><h2>S</h2></div><p class='commentary'>{LONG}</p></article>", f"T\nS\n{LONG}"),
    "header in article": (f"<header><p>site</p></header><article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T\n{LONG}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    assert extract(html) == want


BOILER = "".join(f"<div class='x{k}'><span>Item</span> <b>number</b> <i>{k}</i> of a <u>list</u> of <s>things</s></div>" for k in range(20))
BARE = f"<body><div class='top'>{BOILER}</div><div class='text'><p>{LONG}</p><p>Short.</p><p>{LONG} {LONG}</p></div><div class='more'>{BOILER}</div></body>"


def test_the_ratio_decides_the_region(monkeypatch):
    want = f"{LONG}\nShort.\n{LONG} {LONG}"
    assert extract(BARE) == want
    # An article of teasers beside the text: the text's element is the region, not the tag's.
    teasers = f"<body><article><h2>News</h2>{BOILER}</article><div class='text'><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert extract(teasers) == f"{LONG}\n{LONG}"
    with monkeypatch.context() as m:
        m.setattr(html_extract, "threshold", lambda values: -1.0)
        assert extract(BARE) != want and extract(teasers) != f"{LONG}\n{LONG}"
    with monkeypatch.context() as m:
        m.setattr(html_extract, "smooth", lambda values: [1.0] * len(values))
        assert extract(BARE) != want


MANY = [f"{k} {LONG}" for k in range(20)]
P = "".join
WHOLE = {
    "two sections": (P(["<body><div><section>", *(f"<p>{t}</p>" for t in MANY[:17]), "</section><section>", *(f"<p>{t}</p>" for t in MANY[17:]), "</section></div>"]), MANY),
    "uneven sections": (P(["<body><div><section>", *(f"<p>{t}</p>" for t in MANY[:9]), "</section><section>", *(f"<p>{t}</p>" for t in MANY[9:11]), "</section></div>"]), MANY[:11]),
    "lead": (P([f"<body><div class='lead'><p>{MANY[0]}</p></div><div class='body'>", *(f"<p>{t}</p>" for t in MANY[1:10]), "</div>"]), MANY[:10]),
    "quote": (P(["<body><div><blockquote>", *(f"<p>{t}</p>" for t in MANY[:9]), "</blockquote>", *(f"<p>{t}</p>" for t in MANY[9:11]), "</div>"]), MANY[:11]),
    "frame with a name": (P(["<body><div class='with-sidebar'><div>", *(f"<p>{t}</p>" for t in MANY), "</div></div>"]), MANY),
    "widget": (P(["<body><div id='widget'>", *(f"<p>{t}</p>" for t in MANY), "</div>"]), MANY),
    "words with other meanings": (P([f"<article><p>{MANY[0]}</p>", *(f"<div class='{c}'><p>{t}</p></div>" for c, t in zip(("share-price", "related-work", "copyright-law", "login-flow"), MANY[1:5])), "</article>"]), MANY[:5]),
    "the same words as furniture": (P([f"<article><p>{MANY[0]}</p><p>{MANY[1]}</p>", "<div class='share'>Share this</div><div class='related'><p><a href=x>", MANY[2], "</a></p></div><div class='copyright'>(c) all</div></article>"]), MANY[:2]),
    "comments longer than the text": (P([f"<body><div><p>{MANY[0]}</p><p>{MANY[1]}</p></div><div class='comments'>", *(f"<p>{t}</p>" for t in MANY[2:]), "</div>"]), MANY[:2]),
    "two articles": (P(["<main>", *(f"<article><p>{t}</p></article>" for t in MANY[:6]), "</main>"]), MANY[:6]),
}


@pytest.mark.parametrize("name", WHOLE)
def test_all_of_the_article_is_kept(name):
    html, want = WHOLE[name]
    assert extract(html).split("\n") == want


def plain_extract(html):
    """The method by its definition: every sum by walking, no shared passes."""
    parser = html_extract._Lines()
    parser.feed(html)
    parser.finish()
    elements, lines = parser.elements, parser.lines
    if not lines:
        return ""
    up = lambda e: [] if e < 0 else [e, *up(elements[e][0])]
    within = lambda i: [(len(t) - links, len(t), links) for e, t, _, links in lines if i in up(e)]
    holds = lambda i: any(i in up(e) and (t in ("main", "h1") or t == "article" and k not in (2, 4)) for e, (_, t, k) in enumerate(elements))
    running = lambda i: sum(size >= 60 and links <= 0.3 * size for _, size, links in within(i))
    plain = lambda i: sum(max(0, p) for p, _, _ in within(i))

    def is_out(e):
        for i in up(e):
            _, tag, kind = elements[i]
            inner = any(elements[x][1] in ("article", "main") for x in up(i)[1:])
            named = kind in (2, 4) or kind == 5 and not (inner and running(i)) or (kind == 3 or tag == "header") and not inner
            if kind == 1 or named and not holds(i) and not (kind != 4 and running(i) and plain(i) >= (0.5 if running(i) > 1 else 0.9) * plain(0)):
                return True
        return False

    ratio = [(0.1 if is_out(e) else 1) * max(0, len(t) - links) / max(1, tags) for e, t, tags, links in lines]
    weight = [[math.exp(-0.5 * (i - j) ** 2) if abs(i - j) <= 3 else 0 for j in range(len(lines))] for i in range(len(lines))]
    even = [sum(w * r for w, r in zip(row, ratio)) / sum(row) for row in weight]
    at = threshold(even)
    found = [(x, max(0, len(t) - links), r) for (x, t, _, links), r, v in zip(lines, ratio, even) if v >= at - 1e-9 and not is_out(x)]
    mass = lambda some: {e: sum(n for x, n, _ in some if e in up(x)) for e in range(len(elements))}
    deepest = lambda some: max(some, key=lambda e: (len(up(e)), e), default=0)
    block = [e for e, (_, t, _) in enumerate(elements) if t not in ("p", "span", "b", "i", "em", "strong", "li", "td")]
    first = mass(found)
    region = 0
    if first[0]:
        named = [e for e in first if elements[e][1] in ("article", "main") and not is_out(e) and first[e] >= 0.8 * first[0]]
        if named:
            outer = min(named, key=lambda e: len(up(e)))
            region = deepest([e for e in named if first[e] == first[outer]])
        else:
            core = deepest([e for e in block if first[e] >= 0.8 * first[0]])
            inside = sorted(v for x, _, v in found if core in up(x))
            rest = mass([(x, n, v) for x, n, v in found if core in up(x) or v >= 0.5 * inside[len(inside) // 2]])
            region = deepest([e for e in block if rest[e] == rest[0]])
            parent = elements[region][0]
            if parent > 0 and elements[parent][1] != "body" and any(p == parent and t == "h1" for p, t, _ in elements):
                region = parent
    return "\n".join(t for e, t, _, _ in lines if region in up(e) and not is_out(e))


def test_against_the_definition():
    rng = random.Random(5)

    def block(depth):
        if depth == 0 or rng.random() < 0.3:
            words = " ".join(rng.choice(["text", "and", "longer", "words", "here"]) for _ in range(rng.choice([1, 3, 12, 40])))
            return rng.choice(["<p>{}</p>", "<p><b>{}</b></p>", "<p><a href=x>{}</a></p>", "<h1>{}</h1>", "{}<br>", "<li>{}"]).format(words)
        tag = rng.choice(["div", "div", "section", "article", "nav", "aside", "main", "ul", "footer", "header", "menu", "form"])
        name = rng.choice(["", "", " class=comment", " class='hero'", " id=menu", " role=navigation", " class='share-price'", " class=sidebar"])
        return f"<{tag}{name}>{''.join(block(depth - 1) for _ in range(rng.randrange(1, 5)))}" + f"</{tag}>" * (rng.random() < 0.95)

    pages = ["<body>" + "".join(block(4) for _ in range(4)) for _ in range(150)]
    assert [extract(p) for p in pages] == [plain_extract(p) for p in pages] and len({extract(p) for p in pages}) > 100


def test_depth_is_linear_and_nothing_else_is_dropped():
    seconds = []
    for n in (5_000, 20_000):
        began = time.process_time()
        assert extract("<div>text" * n).count("text") == n
        assert extract("<article>" + "<div><p>text</x></p>" * n).count("text") == n
        seconds.append(time.process_time() - began)
    assert seconds[1] < 9 * seconds[0] + 0.5
    assert extract(f"<article><p>{LONG}</p><math>x</math><menu><li>one</menu><object>o</object><canvas>c</canvas></article>").split("\n")[1:] in (["x", "one", "oc"], ["x", "one", "o c"])


def test_smoothing_and_threshold():
    assert smooth([3.0, 3.0, 3.0]) == pytest.approx([3.0, 3.0, 3.0])
    assert smooth([5.0]) == [5.0]
    assert 2 < threshold([1, 1, 2, 90, 100, 80]) < 80


def test_table(spark):
    rows = [(1, "u", PAGES["article"][0], 5), (2, None, None, 5), (3, "u", "", 5), (3, "u", "", 5), (4, "u", "<p>" + "x " * 100_000, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = sorted(extract_pages(df).collect())
    assert [(r[0], r[1], r[3]) for r in got] == [(1, "u", len(PAGES["article"][1])), (2, None, 0), (3, "u", 0), (3, "u", 0), (4, "u", 199_999)]
    assert extract_pages(df.limit(0)).collect() == []
