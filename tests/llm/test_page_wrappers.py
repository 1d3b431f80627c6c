"""Pages whose article lies in an element with a word of boilerplate, or in a form."""

import random
import re
import time

import pytest

from kinetra.llm.html_extract import LEVELS, _measure, _prune, main_text, parse

TEXT = "This is a sentence of the article, and it goes on for a while. " * 3
BODY = f"<p>{TEXT}</p><p>{TEXT}</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='page no-sidebar'>{BODY}</div>",
        f"<div class='has-sidebar'><article>{BODY}</article><div class='sidebar'><p>Aside.</p></div></div>",
        *(f"<article><div class='{c}'>{BODY}</div></article>" for c in ("content has-sidebar", "page no-ads", "post comments-open", "text related-topic")),
        f"<div id='widget-area'><main>{BODY}</main></div>",
        f"<form action='/'><div class='search-results'>{BODY}</div></form>",
        f"<div class='has-comments'><article>{BODY}</article><div id='comments'><p>First.</p></div></div>",
    ],
)
def test_wrapper_does_not_cut_the_text(page):
    assert main_text(f"<html><body>{page}</body></html>") == "\n\n".join([TEXT.strip()] * 2)


def test_marked_parts_still_go():
    page = f"<article>{BODY}</article><div class='comments'>{BODY * 4}</div><form><p>Your mail</p></form><div class='related'><p>More</p></div>"
    assert main_text(page) == "\n\n".join([TEXT.strip()] * 2)


def test_link_list_of_the_article_stays():
    page = f"<article>{BODY}<ul><li><a href='x'>Source one</a></li></ul><ul class='nav'><li><a href='y'>Home</a></li></ul></article>"
    assert main_text(page).endswith("Source one") and "Home" not in main_text(page)


@pytest.mark.parametrize(
    "part",
    [
        f"<section id='related-work'><p>{TEXT}</p></section>", f"<div class='search-methods'><p>{TEXT}</p></div>", f"<div class='social-science'>{TEXT}</div>",
        f"<section class='feedback'><p>{TEXT}</p></section>", "<h2 id='feedback-loops'>Loops</h2>", "<h2 class='alert-levels'>Levels</h2>", "<h3 id='tags'>Tags</h3>",
        "<p class='notice'>Take note.</p>", "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "<blockquote class='social'>Said.</blockquote>",
    ],
)
@pytest.mark.parametrize("around", ["article", "main"])
def test_parts_of_articles_stay(part, around):
    page = f"<{around}><p>{TEXT}</p>{part}<p>{TEXT}</p></{around}><div class='cookie-notice'>Cookies.</div>"
    want = " ".join(re.sub(r"<[^>]*>", "", part).split())
    assert main_text(page).split("\n\n") == [TEXT.strip(), want, TEXT.strip()]


@pytest.mark.parametrize("page", [f"<div class='page no-sidebar'>{TEXT}<br>{TEXT}</div>", f"<form><div>{TEXT}<br>{TEXT}</div></form>", f"<div id='widget-area'><div>{TEXT}<br>{TEXT}</div></div>"])
def test_text_without_paragraphs(page):
    assert main_text(f"<body><nav>Menu</nav>{page}<div class='ad'>Buy</div></body>") == f"{TEXT}{TEXT}".strip()


@pytest.mark.parametrize("name", ["sidebar", "comments", "comment-list", "ad", "ad-slot", "cookie-notice", "newsletter-signup", "related-posts", "share-buttons", "footer-links", "nav"])
def test_named_parts_go_wherever_they_are(name):
    for kind in ("class", "id"):
        part = f"<div {kind}='{name}'><p>Gone, gone, gone.</p></div>"
        assert main_text(f"<article>{BODY}{part}</article>{part}") == "\n\n".join([TEXT.strip()] * 2)


def test_random_pages_against_what_they_were_made_of():
    """Articles of any nesting with boilerplate words on innocent parts, between parts that are boilerplate."""
    r = random.Random(8)
    topics = ["search-methods", "ad-hoc-rules", "social-contract", "cookie-recipes", "menu-planning", "no-comments-yet", "banner-of-war", "promotion-chances", "related-work"]
    junk = ["<nav><a href='/'>Home</a> here</nav>", "<div class='sidebar'><p>Side, side, side.</p></div>", "<aside>Aside</aside>", "<footer>Foot</footer>", "<div id='comments'><p>Nice, one.</p></div>",
            "<div class='ad'>Buy, buy.</div>", "<form><p>Your mail</p></form>", "<div class='cookie-banner'>Cookies</div>", "<script>var a = '<p>';</script>", "<style>p {}</style>"]
    for _ in range(150):
        words = []

        def part(depth, words=words):
            if depth == 0 or r.random() < 0.4:
                words.append(" ".join(r.choice(["one", "two,", "three", "four."]) for _ in range(r.randint(12, 60))))
                name = f" {r.choice(['class', 'id'])}='{r.choice(topics)}'" if r.random() < 0.5 else ""
                return f"<p{name}>{words[-1]}</p>"
            name = f" {r.choice(['class', 'id'])}='{r.choice(topics)}'" if r.random() < 0.7 else ""
            inner = [part(depth - 1) for _ in range(r.randint(1, 4))]
            return f"<{r.choice(['div', 'section'])}{name}>" + "".join(x + (r.choice(junk) if r.random() < 0.2 else "") for x in inner) + "</div>"

        body = part(3) + part(2)
        around = r.choice(["article", "main"])
        page = "".join(r.choices(junk, k=3)) + f"<{around}>{body}</{around}>" + "".join(r.choices(junk, k=3))
        page = r.choice(["{}", "<div class='has-sidebar'>{}</div>", "<div id='page-wrapper'>{}</div>", "<form>{}</form>"]).format(page)
        assert main_text(re.sub(r"<section([^>]*)>", r"<div\1>", f"<body>{page}</body>")).split("\n\n") == words


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<div>" * 100_000 + "</span>" * 100_000, "<div><p>a, b</p>" * 50_000, "<span>" * 100_000 + "<p>x"])
def test_deep_pages_take_seconds(page):
    began = time.monotonic()
    main_text(page)
    assert time.monotonic() - began < 20


def test_scores_against_plain_sums():
    """Points of every paragraph, summed for each ancestor from above."""
    r = random.Random(4)

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return f"<p>{'word, ' * r.randint(0, 4)}{'text ' * r.randint(1, 90)}</p>"
        return "<div>" + "".join(tree(depth - 1) for _ in range(r.randint(1, 3))) + "</div>"

    for _ in range(20):
        root = parse("<body>" + "".join(tree(6) for _ in range(3)) + "</body>")
        order = _prune(root)
        _measure(order)
        want = {}
        for node in order:
            if node.tag == "p":
                text = " ".join("".join(c for c in node.children if isinstance(c, str)).split())
                up, level = node.parent, 0
                while up is not None and up.tag != "#root" and level <= LEVELS:
                    share = [1, 1 / 2][level] if level < 2 else 1 / (3 * level)
                    want[id(up)] = want.get(id(up), 0) + share * (1 + text.count(",") + min(len(text) / 100, 3))
                    up, level = up.parent, level + 1
        assert all(n.score == pytest.approx(want.get(id(n), 0)) for n in order)
