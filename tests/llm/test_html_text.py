import math
import random

import pytest

from papyra.llm import html_text as h
from papyra.llm.html_text import extract_pages, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">menu one</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies here</div><div class="ad">Buy now</div>
%s
<div id="comments"><p>Nice post, I liked every word of it very much indeed.</p></div>
<aside>Related: other things</aside><form><label>Mail</label><input></form><footer>&copy; site</footer></body></html>"""

WANT = "A title Hello bold world & more. Second part x < y. one two"


def test_article_without_the_rest():
    article = "<article><h1>A\n title</h1><p>Hello <b>bo</b>ld   world &amp; more.<p>Second part x &lt; y.<br><ul><li>one<li>two</ul></article>"
    assert main_text(PAGE % article) == WANT


def test_article_without_semantic_tags_is_found_by_density():
    text = "This is a long sentence of the article that says something about the matter. " * 6
    links = "<div class='x'>" + "".join(f"<a href='/{i}'>link number {i}</a> " for i in range(30)) + "</div>"
    got = main_text(PAGE % f"{links}<div><div class='entry'><p>{text}</p><p>{text}</p></div></div>")
    assert got == " ".join([text.strip()] * 2)


def test_spaces_and_references():
    assert main_text("<article><p>a&nbsp;b\t\nc</p>&eacute;&#233;</article>") == "a b c éé"
    assert main_text("<article><p>one</p><div hidden>no</div><p>two</p></article>") == "one two"
    assert main_text("plain text only") == "plain text only"


def test_awkward_pages():
    for page in (None, "", " ", "<", "<p", "<!-- open", "<script>never closed", "</p></div>", "<a href='x>y'>", "<p>" * 3000 + "deep"):
        assert isinstance(main_text(page), str)
    assert main_text("<body><div>" * 2000 + "deep" + "</div>" * 2000) == "deep"
    long = "<article>" + "<p>" + "word " * 300_000 + "</p></article>"
    assert len(main_text(long)) == 5 * 300_000 - 1


def test_table(spark):
    rows = [(1, "u", PAGE % "<article>x y</article>", "extra"), (2, None, None, "extra"), (3, "v", "", None), (1, "u", PAGE % "<article>x y</article>", "extra")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in extract_pages(df).collect())
    assert got == [(1, "u", "x y", 3), (1, "u", "x y", 3), (2, "", "", 0), (3, "v", "", 0)]
    assert extract_pages(df.limit(0)).count() == 0


def _plain(n):
    """Characters, tags, both in links of a subtree, by their definitions."""
    kids = [k for k in n.kids if isinstance(k, h.Node)]
    own = sum(len("".join(k.split())) for k in n.kids if isinstance(k, str))
    below = [_plain(k) for k in kids]
    chars, tags = own + sum(b[0] for b in below), sum(b[1] + 1 for b in below)
    if n.tag == "a":
        return chars, tags, chars, tags + 1
    return chars, tags, sum(b[2] for b in below), sum(b[3] for b in below)


def _plain_density(n, body):
    c, t, lc, lt = _plain(n)
    if not c:
        return 0.0
    t, ratio = max(t, 1), body[2] / max(body[0], 1)
    base = math.log(c * lc / max(c - lc, 1) + ratio * c + math.e)
    top = c * t / (max(lc, 1) * max(lt, 1))
    return c / t * max(math.log(top) if base == 1 else math.log(top) / math.log(base), 0.0)


def _blocks(n):
    return [b for k in n.kids if isinstance(k, h.Node) for b in ([k] if k.tag not in h.INLINE else _blocks(k))]


def test_densities_and_choice_against_plain_definitions():
    rng = random.Random(1)

    def made(depth):
        tag = rng.choice(["div", "section", "p", "a", "b", "span", "ul", "li"])
        inner = "".join(made(depth - 1) if depth and rng.random() < 0.6 else " text" * rng.randrange(1, 30) for _ in range(rng.randrange(1, 4)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        root = h.parse("".join(made(4) for _ in range(3)))
        h.measure(root)
        body, every, stack = _plain(root), [], [root]
        while stack:
            n = stack.pop(0)
            every.append(n)
            stack += _blocks(n)
        for n in every:
            assert math.isclose(n.density, _plain_density(n, body), rel_tol=1e-9)
            assert math.isclose(n.sum, sum(_plain_density(k, body) for k in _blocks(n)) if _blocks(n) else n.density, rel_tol=1e-9, abs_tol=1e-12)
        best = h._best(root)
        assert best.sum == max(n.sum for n in every)
        chosen = h.select(root)
        assert best in chosen and len({id(c) for c in chosen}) == len(chosen)


def test_two_articles_and_a_densest_part():
    text = "Words of an article that goes on for a while and says things. " * 5
    got = main_text(PAGE % f"<article><p><b>{text}</b></p><p>short end</p></article><article><h2>Second</h2><p>{text}</p></article>")
    assert got == " ".join([text.strip(), "short end", "Second", text.strip()])


BODY = "Words of a sentence that the page is about, one after the other. " * 8


@pytest.mark.parametrize("page", [
    '<div class="content with-sidebar"><p>%s</p></div><a href="/x">a</a>', '<div class="post no-comments"><p>%s</p></div><a href="/x">a</a>', '<section class="section has-banner"><p>%s</p></section>',
    '<div id="skip-target"><p>%s</p></div>', '<form id="aspnetForm"><input><div><p>%s</p></div><label>Mail</label><button>Go</button></form>', '<div class="post comments-open"><p>%s</p></div><div id="comments"><p>Nice.</p></div>',
    '<div class="sidebar-layout"><div class="sidebar"><p>About me and more.</p></div><div><p>%s</p></div></div>', '<div class="page--no-sidebar header"><p>%s</p></div><div class="header"><p>Site</p></div>',
])
def test_no_article_goes_for_a_word_in_a_class(page):
    assert main_text(f"<html><body>{page % BODY}</body></html>").removesuffix(" a") == BODY.strip()


def test_what_classes_and_forms_say_of_small_parts_counts():
    for part in ('<div class="newsletter-signup"><p>Give us your address now.</p></div>', "<form><p>Search this site</p><input></form>", '<div id="respond"><p>Leave a reply</p></div>', f'<div class="comment-list"><p>{BODY}</p><p>{BODY}</p></div>'):
        assert main_text(f"<body><div><p>{BODY}</p></div>{part}</body>") == BODY.strip()


def test_headline_and_closing_line_beside_the_article():
    page = f'<body><nav><a href="/">Home</a></nav><h1>Head</h1><div><p>{BODY}</p><p>{BODY}</p></div><div><p>Short end.</p></div><div><a href="/n">Next page</a></div></body>'
    assert main_text(page) == " ".join(["Head", BODY.strip(), BODY.strip(), "Short end."])
