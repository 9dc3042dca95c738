"""Main text of pages made of known parts."""

import random
import time

import pytest

from sievelake.llm.html_text import extracted, main_text

WORDS = "the of and to in a is that for it house river stone letter window garden morning paper road king".split()


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def page(rng, style):
    blocks = [sentence(rng, rng.choice([1, 3, 8, 30, 60])) for _ in range(rng.randint(1, 8))]
    title = sentence(rng, 4)
    body = "".join(f"<p>{b}</p>\n" for b in blocks)
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS[:7])
    junk = {
        "menu": f"<nav><ul>{links}</ul></nav>", "menu2": f'<div class="main-menu"><ul>{links}</ul></div>',
        "header": f"<header><a href='/'>Site</a> {sentence(rng, 12)}</header>", "advert": f'<div class="ad">{sentence(rng, 9)}</div>',
        "cookies": f'<div id="cookie-notice"><p>{sentence(rng, 40)}</p><button>ok</button></div>',
        "form": f"<form><label>{sentence(rng, 5)}</label><textarea>{sentence(rng, 30)}</textarea></form>",
        "script": 'x<script>var a = "</p><p>the of and";</script><style>p{}</style><!-- the <p>of -->'[1:],
    }
    after = {
        "sidebar": f"<aside><p>{sentence(rng, 50)}</p></aside>", "comments": f'<section class="comments"><article><p>{sentence(rng, 60)}</p></article></section>',
        "footer": f"<footer>&copy; {sentence(rng, 20)}</footer>",
    }
    holder = {"article": "<article>%s</article>", "main": "<main>%s</main>", "open": "<article>%s", "div": '<div class="content">%s</div>'}[style]
    top = rng.sample(sorted(junk.values()), 5)
    html = f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(top)}{holder % (f'<h1>{title}</h1>' + body)}"
    if style != "open":
        html += "".join(after.values()) + "</body></html>"
    return html, "\n\n".join([title, *blocks]), blocks


@pytest.mark.parametrize("style", ["article", "main", "open"])
def test_pages_with_an_article_element(style):
    rng = random.Random(style)
    for _ in range(60):
        html, want, _ = page(rng, style)
        assert main_text(html) == want


def test_pages_without_one():
    rng = random.Random(9)
    for _ in range(60):
        html, want, blocks = page(rng, "div")
        if any(len(b.split()) >= 30 for b in blocks):
            assert main_text(html) == want


def test_inside_a_block():
    text = "<article><p>Tom &amp; J&eacute;r&ocirc;me &#x1F600; &lt;b&gt;\n\t <b>bo</b>ld&nbsp; x<br>y</p><P class='x>y'>2<td>3</article>"
    assert main_text(text) == "Tom & Jérôme 😀 <b> bold x y\n\n2\n\n3"
    assert main_text("<article><p>a</p><div class='share'>tweet the of and</div><p>b</p></article>") == "a\n\nb"
    assert main_text("<article><p>open <b>tag<p>next") == "open tag\n\nnext"
    assert main_text("<article>5 < 6 and 7 > 3 <3</article>") == "5 < 6 and 7 > 3 <3"
    assert main_text("<article>x<script>if (a</article>") == "x"


def test_links_inside_an_article():
    long = "The house of the river is a letter to the king and it is in the garden that we see."
    head = '<article><h1><a href="/t">Title</a></h1>'
    assert main_text(f"{head}<p>{long}</p><p><a href='/s'>See also the garden</a></p><ul><li><a>One</a></li><li><a>Two</a></li></ul><p>{long}</p></article>") == (
        f"Title\n\n{long}\n\nSee also the garden\n\nOne\n\nTwo\n\n{long}")
    assert main_text(f"{head}<p>{long}</p><ul><li><a>Next page</a></li></ul></article><p><a>{long}</a></p>") == f"Title\n\n{long}"
    assert main_text(f"{head}</article>") == "Title"


def test_names_of_topics_and_layouts_around_an_article():
    long = "The house of the river is a letter to the king and it is in the garden that we see."
    other = f"<p>{long} Other.</p>"
    for names in ("post category-legal", "tag-search", "comments-open", "sidebar-right"):
        assert main_text(f'<article class="{names}"><p>{long}</p></article>{other}') == long
        assert main_text(f'<div class="{names}"><article><p>{long}</p></article></div>{other}') == long
        assert main_text(f'<main><h1>A</h1><div class="{names}"><article><p>{long}</p></article></div></main>{other}') == f"A\n\n{long}"
    twice = f'<div class="tag-search"><article><p>{long}</p></article></div>'
    assert main_text(f"{twice}<article><p>{long}</p></article>") == f"{long}\n\n{long}"
    for away in ('div class="comments"', 'div id="comments-area"', 'section class="related-posts"', "aside"):
        end = away.split()[0]
        aside = f"<{away}><article>{other}</article></{end}>"
        assert main_text(f"<article><p>{long}</p></article>{aside}") == main_text(f"<article><p>{long}</p>{aside}</article>") == long
        assert main_text(f"<main><p>{long}</p>{aside}</main>") == long
    assert main_text(f'<article class="teaser">{other}</article><article><p>{long}</p></article>') == long


def test_a_form_around_an_article():
    long = "The house of the river is a letter to the king and it is in the garden that we see."
    for form in ("<form>", '<form id="aspnetForm" role="form">', '<form id="form1" class="form">'):
        assert main_text(f"{form}<p>{long} Form.</p><div><main><p>{long}</p><form><p>{long} Reply.</p></form></main></div></form>") == long
        assert main_text(f"<article><p>{long}</p>{form}<article><p>{long}</p></article></form></article>") == long
        assert main_text(f"<p>{long}</p>{form}<p>{long} Form.</p></form>") == long


def test_rows(spark):
    html, want, _ = page(random.Random(1), "article")
    long = "<article>" + "<p>the end of it</p>" * 20000 + "</article>"
    rows = [(1, html, "old"), (2, None, "old"), (3, "", "old"), (4, long, "old"), (1, html, "old"), (5, "<" * 3000 + "\"'" * 3000, "old")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in extracted(frame).collect()}
    assert got[1] == want and got[2] == got[3] == "" and got[4].count("\n\n") == 19999
    assert extracted(frame).count() == 6 and extracted(frame.limit(0)).collect() == []


def test_signs_are_read_from_whole_attributes():
    text = "The quick brown fox jumps over the lazy dog and then it runs away from the house of the old man in the town."
    for attrs in ('title="the hidden truth"', 'data-hidden="false"', 'data-role="dialog"', 'aria-label="role=dialog"', "data-x='class=sidebar'"):
        assert main_text(f"<body><article {attrs}><p>{text}</p></article></body>") == text, attrs
    for attrs in ("hidden", 'hidden=""', 'role="dialog"', "ROLE=dialog", "class=sidebar", 'x="1"hidden'):
        assert main_text(f"<body><article><p>{text}</p><div {attrs}><p>{text} Aside.</p></div></article></body>") == text, attrs


def test_unfinished_and_broken_markup():
    assert main_text("<article><p>The text of it.</p>An unfinished <b") == "The text of it.\n\nAn unfinished"
    assert main_text("<article><p>The text.</p>An end </") == "The text.\n\nAn end"
    assert main_text("<article><p>The text<!--> and<!---> of it</p></article>") == "The text and of it"
    assert main_text('<article><p title="a>b">It is a > b.</p><p class="x>Don\'t</p></article>') == "It is a > b.\n\nDon't"
    # Quotes that hide every later tag end bound nothing.
    assert main_text('<article><p title="a>The text.</p></article>"') == "The text."


def test_formulas_are_text():
    page = "<article><p>Let <math><semantics><mrow><mi>x</mi><mo>&lt;</mo><mn>2</mn></mrow><annotation>x < 2</annotation></semantics></math> be large.</p></article>"
    assert main_text(page) == "Let x<2 be large."


@pytest.mark.parametrize("piece", ["<a ", "<!", "</p", "<a", "<!--", "<a '>", '<a ">"', "<p a= ", "</section>", "<"])
def test_a_megabyte_of_unfinished_markup_takes_linear_time(piece):
    page = "<article><p>The text.</p>" + "<div>" * 20_000 + piece * (1_000_000 // len(piece))
    begin = time.process_time()
    main_text(page)
    assert time.process_time() - begin < 5
