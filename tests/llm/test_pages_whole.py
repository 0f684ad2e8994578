"""Main text of pages: nothing outside furniture and template is lost."""

import random
from itertools import combinations

import pytest

from marlstone.llm import wrappers as w

from .test_pages import place


def host(pages):
    one = None
    for x in map(w.wrapper_of, pages):
        one = x if one is None else w.merge(one, x)
    return w.rule(one)


def test_heading_and_lead_beside_the_body_container():
    make = lambda i: f"<html><body><div id=menu><a href=/>Home</a></div><div class=content><h1>Title {i}</h1><p>Lead {i}</p><div class=body><p>{f'long text {i} ' * 30}</p></div></div><div id=footer>end</div></body></html>"
    want = lambda i: f"Title {i}\n\nLead {i}\n\n" + (f"long text {i} " * 30).strip()
    for n in (1, 3, 20):
        rules = host(map(make, range(n)))
        assert rules["main"] == place("html/body/div.content")
        assert all(w.extract(make(i), rules) == want(i) for i in range(n))


def test_linked_heading_beside_the_body_container():
    make = lambda i: f"<html><body><div class=content><h1><a href=/{i}>Title {i}</a></h1><div class=body><p>{f'long text {i} ' * 30}</p></div></div></body></html>"
    assert w.extract(make(2), host(map(make, range(12)))).startswith("Title 2\n\nlong text 2")


def test_an_article_is_still_found_beside_other_text():
    make = lambda i: f"<html><body><div class=top>Line {i}</div><div class=wrap><article><p>{f'long text {i} ' * 30}</p></article></div></body></html>"
    assert host(map(make, range(12)))["main"] == place("html/body/div.wrap/article")


def test_furniture_is_told_by_any_of_many_names():
    for names in ("box col-md-4 d-none grid sidebar", "a b c d e f widget"):
        html = f"<html><body><article><p>Own text.</p><div class='{names}'>Other</div></article></body></html>"
        assert w.extract(html, host([html])) == w.extract(html, None) == "Own text."


def test_template_text_goes_though_some_pages_are_empty_or_odd():
    make = lambda i: f"<html><body><article><p>Own text of page {i}.</p><div><span>Follow us everywhere</span></div></article></body></html>"
    odd = ["", "<html><body><p>odd</p></body></html>", make(90).replace("Follow us everywhere", "Another notice")]
    for n in (12, 300):
        for more in (odd[:1], odd[1:2], odd):
            for pages in ([*map(make, range(n)), *more], [*more, *map(make, range(n))]):
                rules = host(pages)
                assert w.extract(make(3), rules) == "Own text of page 3."
                assert w.extract(odd[2], rules).endswith("Another notice")


def test_a_text_that_some_pages_share_stays():
    make = lambda i: f"<html><body><article><p>Own text of page {i}.</p><h2>{'References' if i % 3 else f'Notes {i}'}</h2></article></body></html>"
    some = lambda i: make(i) if i % 3 else f"<html><body><article><p>Own text of page {i}.</p></article></body></html>"
    for page in (make, some):
        assert w.extract(page(4), host(map(page, range(60)))).endswith("References")


def test_few_pages_have_no_template():
    make = lambda i: f"<html><body><article><p>Own text of page {i}.</p><div><span>Follow us everywhere</span></div></article></body></html>"
    assert w.extract(make(3), host(map(make, range(2)))).endswith("Follow us everywhere")


BODY = "<p>{0}</p>".format("Some long words of the text stand here, one after another. " * 5)
TEXT = ("Some long words of the text stand here, one after another. " * 5).strip()


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<html><body class="right-sidebar"><div class="sidebar"><p>Other.</p></div><h1>Head</h1>{BODY}</body></html>', "Head\n\n" + TEXT),
        (f'<html><body><article class="post-related-to-x"><h1>Head</h1>{BODY}</article></body></html>', "Head\n\n" + TEXT),
        (f'<html><body><article><div class="entry-header"><h1>Head</h1></div>{BODY}<div class="entry-related"><p>More</p></div></article></body></html>', "Head\n\n" + TEXT),
        (f'<html><body><article><svg width="1"/><h1>Head</h1><iframe src="x"/>{BODY}</article></body></html>', "Head\n\n" + TEXT),
        (f"<html><head><title>T</head><body><article>{BODY}</article></body></html>", TEXT),
        (f'<html><body><div class="promo"><div class="comments">{BODY}</div></div></body></html>', ""),
        (f'<html><body><article>{BODY}</article><div class="comments">{BODY * 9}</div></body></html>', TEXT),
        (f'<html><body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div id=c>{BODY}<ul><li>First</li><li>Last</li></ul></div></body></html>', TEXT + "\n\nFirst\n\nLast"),
    ],
)
def test_text_that_names_or_odd_markup_would_hide(html, want):
    for pages in ([html], [html, "", html.replace("Some", "Any")]):
        assert w.extract(html, host(pages)) == want


def test_the_wrapper_outvotes_names_for_all_pages_of_the_host():
    make = lambda i, n: f'<html><body><div class="widget-area"><h1>Title {i}</h1><p>{f"words of {i} " * n}</p></div><div class="notice">Cookies {i}</div></body></html>'
    pages = [make(i, 40 + i) for i in range(6)]
    assert w.extract(make(9, 1), host(pages)) == "Title 9\n\nwords of 9"


def test_deep_pages():
    for tag in ("div", "b"):
        html = f"<html><body>{f'<{tag}>' * 100_000}deep text{f'</{tag}>' * 100_000}</body></html>"
        one = w.wrapper_of(html)
        again = w.unpacked(w.packed(w.merge(one, w.wrapper_of(html.replace("deep", "other")))))
        assert w.extract(html, w.rule(again)) == "deep text"


def test_many_places_called_furniture():
    html = "<html><body><p>Own text.</p>" + "".join(f"<div class='widget k{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}'>Other</div>" for k in range(15_000)) + "</body></html>"
    assert w.extract(html, w.rule(w.wrapper_of(html))) == "Own text."


def test_wide_unlike_pages_align_in_bounded_time():
    rng = random.Random(1)
    tags = [f"<p class=k{chr(97 + k)}>x</p>" for k in range(26)]
    one, two = ("<html><body>" + "".join(rng.choice(tags) for _ in range(20_000)) + "</body></html>" for _ in range(2))
    merged = w.merge(w.wrapper_of(one), w.wrapper_of(two))
    assert w.extract(one, w.rule(merged)).count("x") == 20_000


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    def longest(a, b):
        for k in range(min(len(a), len(b)), 0, -1):
            if {tuple(a[i] for i in c) for c in combinations(range(len(a)), k)} & {tuple(b[i] for i in c) for c in combinations(range(len(b)), k)}:
                return k
        return 0

    rng = random.Random(3)
    for bits in (1 << 28, 6):  # whole, and by halves
        monkeypatch.setattr(w, "ALIGN_BITS", bits)
        for _ in range(150):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 9))] for _ in range(2))
            found = w._lcs(a, b)
            assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
            assert len(found) == longest(a, b), (a, b)


def test_numbers_in_names_make_no_new_places():
    make = lambda i: f'<html><body><div id="post-{i}" class="entry p{i}"><p>Text {i} of many words.</p></div></body></html>'
    one = w.wrapper_of(make(0))
    size = len(w.packed(w.merge(one, w.wrapper_of(make(1)))))
    for i in range(1, 60):
        one = w.merge(one, w.wrapper_of(make(i)))
    assert len(w.packed(one)) < size + 40 and w.extract(make(7), w.rule(one)) == "Text 7 of many words."


def test_extraction_recall_and_precision_on_the_given_pages(spark):
    """The article's blocks, read off the markup of the given pages: all of them, and nothing else."""
    import html as markup
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in w.main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    right = wanted = found = 0
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        blocks = [" ".join(markup.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<br\s*/?>", " ", body[1] if body else ""))]
        blocks, out = [x for x in blocks if x], [x for x in got[r.page_id].split("\n\n") if x]
        wanted, found = wanted + len(blocks), found + len(out)
        right += sum(x in out for x in blocks)
    assert right >= 0.999 * wanted and right >= 0.999 * found
