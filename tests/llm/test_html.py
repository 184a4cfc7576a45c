import random
import time
from html import escape

from lectern.llm import html_text

JUNK = [
    "<nav><ul><li><a href=/x>Home</a><li>More</ul></nav>", '<div class="ad">Buy now</div>', '<div class="site-footer">Foot</div>', "<aside>Beside</aside>", "<!-- gone > still gone -->", "<script>var x = '</p>';</script>",
    "<style>p{}</style>", '<form action="/s"><input name="q"><label>Find</label></form>', '<section id="comments"><div class="comment"><p>First!</p></div></section>', '<p class="cookie-notice">We use cookies</p>', '<div class="sidebar widget"><p>Also</p></div>', "<footer>End</footer>", '<div role="navigation">Go</div>',
]
KEPT = ["legal-note", "share-price", "search-theory", "headline", "adage", "social-history", "toc-entry", "notice-board", "commentary", "post-12"]


def block(rng, words):
    """A block's markup and its text."""
    said = [rng.choice(words) for _ in range(rng.randint(3, 25))]
    inner = [escape(w) if rng.random() < 0.7 else f"<{t}{rng.choice(['', ' title=\"a > b\"', ' data-x=y'])}>{escape(w)}</{t}>" for w in said for t in [rng.choice(["b", "i", "span", "a", "em"])]]
    gap = lambda: rng.choice([" ", "\n", "  ", "<br>", " \t", "&#32;"])
    tag = rng.choice(["p", "p", "h2", "blockquote", "li", "div"])
    attrs = f' class="{rng.choice(KEPT)}"' if rng.random() < 0.5 else ""
    body = "".join(w + gap() for w in inner)
    end = "" if tag == "p" and rng.random() < 0.5 else f"</{tag}>"
    markup = f"<{tag}{attrs}>{body}{end}"
    return (f"<ul>{markup}</ul>" if tag == "li" else markup), " ".join(said)


def test_pages_built_from_known_articles():
    rng = random.Random(8)
    words = "the über AT&T x<y \"said\" 5>4 naïve it's & word and another longer expression 漢字".split()
    for _ in range(300):
        made = [block(rng, words) for _ in range(rng.randint(2, 9))]
        inside = []
        for markup, _ in made:
            inside.append(markup)
            if rng.random() < 0.4:
                inside.append(rng.choice(JUNK))
        wrap = rng.choice(["{}", "<div class='page'>{}</div>", "<main>{}</main>"])
        around = lambda: "".join(rng.sample(JUNK, rng.randint(0, 3)))
        page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + around() + wrap.format(f"<article>{''.join(inside)}</article>") + around()
        path = "html>body>" + {"{}": "", "<main>{}</main>": "main>"}.get(wrap, "div.page>") + "article"
        assert html_text.extract(page, path) == "\n".join(t for _, t in made), page


def test_broken_markup():
    x = lambda h: html_text.extract(h, None)
    assert x('<p>see <a href="foo>link</a> and more') == "see link and more"
    assert x("<p>see <a href='foo>link</a> <b id=\"x\">and</b> more") == "see link and more"
    assert x("<p>a < b and 3 <4 </ p>c<p") == "a < b and 3 <4 c"
    assert x("<p>one<!-- never closed <p>two") == "one"
    assert x("<p>one<![CDATA[ <b> & ]]> two") == "one <b> & two"
    assert x("<p title=\"a>b\" x='\"'>in</p>") == "in"
    assert x("<p it's>in</p>") == "in"
    assert x("<div>" * 5000 + "<nav>MENU</nav><p>deep</p>") == "deep"
    assert x("") == "" and x("<p>") == "" and x("<script>x") == ""


def test_time_grows_with_length():
    began = time.time()
    for page in ("<b x" * 250_000, "<a b='" * 180_000, "<a b='x>" * 120_000, "<!-" * 300_000, "<" * 1_000_000, "<div>" * 100_000 + "</x>" * 100_000, "<p>" * 200_000, "<b>" * 200_000 + "</i>" * 200_000, "<!--" * 200_000, "</" * 300_000, "<a =" * 200_000 + '"'):
        html_text.extract(page, "html>body")
        html_text._vote(page[:200_000])
    assert time.time() - began < 60
