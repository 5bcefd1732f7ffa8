import random
import time

import pytest

from windrow.llm import wrapper as wr

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><div class="cookie-notice">We use cookies</div><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
<main><article><header><h1>Head &amp; line</h1></header><p>One<br>two &nbsp;<i>thr</i>ee &lt;4&gt; &#233;&#x21; &unknown; <p><b>Open<br><p>Next
 <ul><li>x<li>y</ul><div class="ad">buy</div><form><p>name</p><input></form><table><tr><td>c1<td>c2</table>
<span class="share">share</span><!-- <p>hidden</p> --><section id="comments"><p>first!</p></section></article><aside>related</aside></main>
<footer>&copy; all</footer></body></html>"""


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, text string, host int")


def test_article_without_the_rest():
    assert wr.main_text(PAGE, {}) == "Head & line\n\nOne two three <4> é! &unknown;\n\nOpen\n\nNext\n\nx\n\ny\n\nc1\n\nc2"


@pytest.mark.parametrize("html", ["", "   ", "<", "<p", "</p></div>", "<!-- never closed", "<script>x", "plain <b>text", "<p>a<p", "a < b > c", "<td>x<li>y</ul>z"])
def test_broken_pages_do_not_fail(html):
    assert isinstance(wr.main_text(html, {}), str)


def test_plain_text_and_cut_pages():
    assert wr.main_text("plain <b>text</b>", {}) == "plain text"
    assert wr.main_text("<body><article><p>cut of", {}) == "cut of"
    assert wr.main_text("<html><head><title>x</title><p>no body tag", {}) == "no body tag"


def test_simple_tree_matching_aligns_equal_places():
    a = wr.tree(list(wr.blocks_of("<div class=a><p>1</p></div><div class=b><p>2</p></div>")))
    b = wr.tree(list(wr.blocks_of("<div class=b><p>3</p></div>")))
    size, pairs = wr.aligned(a, b)
    assert size == 3 and [(x.path, x.texts, y.texts) for x, y in pairs if x.texts] == [("/div.b/p", ["2"], ["3"])]


def test_constant_places_are_template(spark):
    """Without an article element, what is the same on unlike pages of the host goes."""
    html = lambda k: f"<body><div class=top>Our shop</div><div class=body><p>Story number {k} begins</p><p>and ends {k * 7}</p></div><div class=end>Call us</div>"
    rows = [(k, f"http://h.example/{k}", html(k)) for k in range(12)]
    got = wr.extracted(pages_of(spark, rows)).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Story number {k} begins\n\nand ends {k * 7}" for k in range(12)}


def test_copies_of_a_page_keep_their_article(spark):
    rows = [(k, f"http://h.example/{k}", "<article><h1>Same</h1><p>every time</p></article>") for k in range(20)]
    got = wr.extracted(pages_of(spark, rows)).collect()
    assert {r.text for r in got} == {"Same\n\nevery time"} and len(got) == 20


def test_messy_rows(spark):
    rows = [(1, None, None), (2, "not a url", ""), (None, "http://a/", PAGE), (3, "HTTP://A/x", PAGE), (3, "HTTP://A/x", PAGE), (4, "http://a/y", "<p>" + "long " * 50_000)]
    got = wr.extracted(pages_of(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in got) == sorted(
        [(1, 0, 0), (2, 0, 0), *[(k, len(wr.main_text(PAGE, {})),) * 1 + (len(wr.main_text(PAGE, {})),) for k in (0, 3, 3)], (4, 249_999, 249_999)]
    )
    assert wr.extracted(pages_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(
    "kept, gone",
    [
        ("<div id=content>{}</div>", "<div id=footer><p>All rights reserved</p></div>"),
        ("<div id=content>{}</div>", "<div role=navigation><p><a href=/>" + "Home and other long links " * 20 + "</a></p></div>"),
        ("<div>{}</div>", "<div hidden><p>Not shown</p></div>"),
        ("<article><section id=intro>{}</section>", "<section id=comments><p>first!</p></section></article>"),
        ("{}", "<span class=promo><p>buy this</p></span>"),
    ],
)
def test_parts_told_apart_by_id_or_role(spark, kept, gone):
    """A dropped part does not take others at the same path with it, wherever it stands."""
    text = lambda k: [f"Story number {k} begins", f"and ends {k * 7}"]
    html = lambda k: "<body>" + kept.format("".join(f"<p>{t}</p>" for t in text(k))) + gone
    got = wr.extracted(pages_of(spark, [(k, f"http://h.example/{k}", html(k)) for k in range(12)])).collect()
    assert {r.page_id: r.text for r in got} == {k: "\n\n".join(text(k)) for k in range(12)}


def test_every_layout_of_a_host_is_learned(spark):
    """Many layouts on one host, a few pages each: each layout's constant places go."""
    body = lambda k: f"Story number {k} begins\n\nand ends {k * 7}".split("\n\n")

    def html(k):
        name = "abcdefghijklmnopqrstuvwxyz"[k % 25]
        return f"<body><div class=top{name}>Shop {name}</div><div class=body{name}>{''.join(f'<p>{t}</p>' for t in body(k))}</div><div class=end{name}>Call {name}</div>"

    rows = [(k, f"http://h.example/{k}", html(k)) for k in range(500)]
    got = wr.extracted(pages_of(spark, rows)).collect()
    assert {r.page_id: r.text for r in got} == {k: "\n\n".join(body(k)) for k in range(500)}


def test_pages_are_aligned_with_unlike_pages_of_their_layout():
    a = [("/div.a/p", 1), ("/div.top", 9), ("/div.x", 5)]
    pages = [a, a, [("/div.a/p", 2), ("/div.top", 9), ("/div.x", 6)], [("/div.b", 3)], [("/div.a/p", 1), ("/div.top", 9), ("/div.x", 7)]]
    assert wr.counted(pages)["/div.top"] == [3, 0] and wr.counted(pages)["/div.a/p"] == [0, 3]


def page(body):
    return f"<html><body>{body}</body></html>"


STORY = "<p>" + "The harbour was quiet before the storm came in from the west. " * 3 + "</p>"


def test_an_article_among_comments_does_not_hide_the_story():
    text = wr.main_text(page(f'<div class="post">{STORY}</div><div id="comments"><article class="comment"><p>First!</p></article></div>'), {})
    assert text.startswith("The harbour") and "First" not in text


def test_articles_that_are_comments_are_left_out():
    text = wr.main_text(page(f'<article class="post">{STORY}</article><article class="comment"><p>Nice read.</p></article>'), {})
    assert text.startswith("The harbour") and "Nice" not in text


def test_teaser_articles_do_not_hide_a_longer_story():
    cards = "".join(f"<article><h2>Card {k}</h2></article>" for k in range(3))
    assert "The harbour" in wr.main_text(page(f"<div>{STORY}</div>{cards}"), {})


def test_words_of_a_subject_do_not_drop_a_section():
    inside = wr.main_text(page(f'<article><div class="social-history">{STORY}</div><div class="social-links">Follow us</div></article>'), {})
    assert inside.startswith("The harbour") and "Follow" not in inside


def brute_aligned(a, b):
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_aligned(x, y))
    return best[-1][-1] + 1


def random_tree(r, depth, path=""):
    node = wr.Node(path.rsplit("/", 1)[-1], path)
    for _ in range(r.randint(0, 4) if depth else 0):
        node.children.append(random_tree(r, depth - 1, f"{path}/{r.choice('ab')}"))
    node.size = 1 + sum(c.size for c in node.children)
    node.shape = hash((node.label, *(c.shape for c in node.children)))
    return node


def test_matching_equals_the_plain_recursion():
    r = random.Random(6)
    for _ in range(300):
        a, b = random_tree(r, 4), random_tree(r, 4)
        size, pairs = wr.aligned(a, b)
        assert size == brute_aligned(a, b) == len(pairs)
        assert all(x.path == y.path for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == size


def test_deep_and_long_pages_are_matched_quickly():
    deep = [wr.tree([("/div" * n, "x", 0, False, False)]) for n in (2000, 1990)]
    long = [wr.tree([(f"/body/{'h2' if k % 2 else 'p'}", str(k), 0, False, False) for k in range(n)]) for n in (5000, 4700)]
    mixed = [
        wr.tree([(f"/body/{'div/b' if (k * k) % m else 'div'}/i" if k % 3 else "/body/p", str(k), 0, False, False) for k in range(3000)])
        for m in (5, 7)
    ]
    t = time.perf_counter()
    assert wr.aligned(*deep)[0] == 1991 and wr.aligned(*long)[0] == 4702 and wr.aligned(*mixed)[0] > 1000
    assert time.perf_counter() - t < 3
    html = "<div>" * 2000 + "deep down" + "</div>" * 2000
    assert wr.main_text(page(html), {}) == "deep down"


def test_long_lists_are_matched_as_fully_as_short_ones():
    """Lists shifted against each other: the k-th child of a label does not match the other list's k-th."""
    for n in (20, 300):  # 300 children were more than a bound on the pairs that were all tried
        a, b = (
            wr.tree([(f"/body/{'p' if k % 2 else f'div/{name}{k // 2}'}", str(k), 0, False, False) for k in range(2 * n)][lo:] + [(f"/body/{end}", "", 0, False, False)])
            for lo, name, end in ((0, "a", "i"), (10, "a", "b"))
        )
        assert wr.aligned(a, b)[0] == brute_aligned(a, b)
