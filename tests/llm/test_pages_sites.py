"""Sites built of known parts: the text that comes out is the text that went in, on hosts of 1, 3 and 12 pages."""

import random

import pytest

from marlstone.llm import wrappers as w

from .test_pages_whole import host

SIZES = (1, 3, 12)


def words(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnoprstu", k=r.randint(2, 9))) for _ in range(n))


def para(r):
    return words(r, r.randint(25, 60)).capitalize() + "."


@pytest.mark.parametrize("n", SIZES)
def test_heading_in_the_header_of_main(n):
    r = random.Random(n)
    texts = [para(r) for _ in range(n)]
    make = lambda i: f"<html><body><header><h1>Site</h1></header><main><header><nav><a href=/>Home</a></nav><h1>Head {i}</h1></header><p>{texts[i]}</p></main></body></html>"
    rules = host(map(make, range(n)))
    assert [w.extract(make(i), rules) for i in range(n)] == [f"Head {i}\n\n{texts[i]}" for i in range(n)]


def test_a_site_name_in_the_header_of_main_is_template():
    texts = [para(random.Random(i)) for i in range(12)]
    make = lambda i: f"<html><body><main><header><h1>The Site</h1></header><p>{texts[i]}</p></main></body></html>"
    rules = host(map(make, range(12)))
    assert [w.extract(make(i), rules) for i in range(12)] == texts


@pytest.mark.parametrize("n", SIZES)
@pytest.mark.parametrize("part", ['<p class="notice">{}</p>', '<div class="health-related"><p>{}</p></div>', '<section id="work-related">{}</section>', '<blockquote class="feedback">{}</blockquote>'])
def test_names_about_the_subject_stay_in_the_text(n, part):
    r = random.Random(n)
    texts = [(para(r), para(r)) for _ in range(n)]
    for outer in ("article", "main", "div class=content"):
        make = lambda i: f"<html><body><{outer}><h1>Head {i}</h1><p>{texts[i][0]}</p>{part.format(texts[i][1])}</{outer.split()[0]}></body></html>"  # noqa: B023, E731
        rules = host(map(make, range(n)))
        assert [w.extract(make(i), rules) for i in range(n)] == [f"Head {i}\n\n{texts[i][0]}\n\n{texts[i][1]}" for i in range(n)]


def test_what_is_furniture_in_the_text_goes():
    for part in ('<div class="entry-related"><p>More</p></div>', '<div class="notice">We use cookies</div>', '<p class="ad">Buy</p>', '<p class="related">See <a href=/1>this other long page</a></p>', '<div class="site-related"><a href=/1>One</a> <a href=/2>Two</a></div>', '<p class="comment">I agree</p>'):
        page = f"<html><body><article><p>{para(random.Random(1))}</p>{part}</article></body></html>"
        assert w.extract(page, host([page])) == para(random.Random(1)), part
    same = lambda i: f"<html><body><article><p>{para(random.Random(i))}</p><p class=notice>All rights are kept.</p></article></body></html>"
    assert w.extract(same(3), host(map(same, range(12)))) == para(random.Random(3))


def test_formulas_in_a_sentence_stay():
    page = "<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='application/x-tex'>x=2</annotation></math> holds, stop.</p></article>"
    assert w.extract(page, host([page])) == "Where x=2 holds, stop."


BESIDE = [
    "<nav><ul><li><a href=/a>{0}</a></li><li><a href=/b>Home</a></li></ul></nav>", '<div class="ad">{0}</div>', "<aside><p>{0}</p></aside>", "<form><label>{0}</label><input name=q></form>", "<script>var t = '<p>{0}</p>';</script>",
    "<style>p {{ margin: 0 }}</style>", '<div id="cookie-notice">{0}</div>', "<!-- {0} <p>no</p> -->", '<section class="comments"><p>{0}</p><p>So do I</p></section>', '<div class="newsletter">{0}</div>', "<noscript>{0}</noscript>",
]


def block(r):
    """A block's html and text."""
    kind, text = r.randrange(7), para(r)
    if kind == 0:
        items = [words(r, 4) for _ in range(r.randint(2, 4))]
        return "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>", items
    if kind == 1:
        return f"<h2>{text}</h2>", [text]
    if kind == 2:
        return f"<blockquote><p>{text}</p></blockquote>", [text]
    if kind == 3:
        a, b = words(r, 5), words(r, 5)
        return f"<p>{a} <b>&amp; &eacute;</b>\n\t {b} <a href='/x?a=1'>{a}</a></p>", [f"{a} & é {b} {a}"]
    if kind == 4:
        a, b = words(r, 3), words(r, 3)
        return f"<table><tr><td>{a}<td>{b}</table>", [a, b]
    if kind == 5:
        return f"<p>{text}", [text]
    return f"<div><p>{text}</p></div>", [text]


@pytest.mark.parametrize("seed", range(40))
def test_random_sites(seed):
    r = random.Random(seed)
    n = r.choice(SIZES)
    outer = r.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class=wrap><article class=post>{}</article></div>"])
    before, after, inside = r.sample(BESIDE, 2), r.sample(BESIDE, 3), r.sample(BESIDE, 1)
    pages, want = [], []
    for _ in range(n):
        blocks = [block(r) for _ in range(r.randint(3, 9))]
        title = words(r, 6)
        beside = lambda parts: "".join(x.format(words(r, 5)) for x in parts)
        body = f"<h1>{title}</h1>" + "".join(x for x, _ in blocks) + beside(inside)
        pages.append(f"<!DOCTYPE html><html><head><title>{title}</title></head><body><header><h1>Site</h1></header>{beside(before)}{outer.format(body)}{beside(after)}<footer><p>{words(r, 6)}</p></footer></body></html>")
        want.append("\n\n".join([title, *(t for _, texts in blocks for t in texts)]))
    rules = host(pages)
    assert [w.extract(p, rules) for p in pages] == want
