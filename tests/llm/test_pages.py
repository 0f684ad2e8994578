"""Main text of pages by wrappers."""

from marlstone.llm import wrappers as w


def place(path):
    at = 0
    for label in path.split("/"):
        at = w.step(at, label)
    return str(at)


def page(i, extra="", tail="</article><footer>&copy; host</footer></body></html>"):
    return f"""<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Part {i}</a></li></ul></nav><!-- ad --><div class="ad">Buy {i}</div>
<article><h1>Title &amp; {i}</h1><p><b>Bold {i}.<br><p>First   paragraph
 of {i} &lt;x&gt;.</p>{extra}<p>Second of {i}.</p>{tail}"""


def want(i, extra=""):
    return f"Title & {i}\n\nBold {i}.\n\nFirst paragraph of {i} <x>.\n\n{extra}Second of {i}."


def test_pages_of_one_host(spark):
    side = '<div class="comments"><p>I like it</p></div><aside>More</aside><form><input><button>Go</button></form>'
    rows = [(i, "http://h.example.org/x", page(i, side if i % 3 == 0 else "")) for i in range(30)]
    rows += [(100, "http://h.example.org/y", None), (101, None, ""), (102, "odd", page(102)), (103, "http://h.example.org/z", page(103, tail="")), (103, "http://h.example.org/z", page(103, tail=""))]
    out = w.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.text == ("" if r.page_id in (100, 101) else want(r.page_id)), r.page_id
        assert r.n_chars == len(r.text)
    assert w.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_has_slots_optionals_and_repeats():
    found = [w.wrapper_of(page(i, "<h2>Sub</h2>" if i % 2 else "")) for i in range(6)]
    one = found[0]
    for x in found[1:]:
        one = w.merge(one, x)
    text = w.expression(one)
    assert "(<p>" in text and ")+" in text and "#text" in text and "?" in text
    assert w.rule(one)["main"] == place("html/body/article")
    assert w.expression(w.unpacked(w.packed(one))) == text


def test_template_text_inside_the_article_goes():
    make = lambda i: f"<html><body><article><p>Own text of page {i}.</p><div><span>Follow us everywhere</span></div></article></body></html>"
    one = None
    for i in range(12):
        x = w.wrapper_of(make(i))
        one = x if one is None else w.merge(one, x)
    assert w.extract(make(3), w.rule(one)) == "Own text of page 3."
    assert w.extract(make(3), None) == "Own text of page 3.\n\nFollow us everywhere"


def test_copies_of_one_page_keep_their_text():
    one = None
    for _ in range(20):
        x = w.wrapper_of(page(1))
        one = x if one is None else w.merge(one, x)
    assert w.extract(page(1), w.rule(one)) == want(1)


def test_no_article_element():
    html = "<html><body><div id=menu><a href=/>Home</a></div><div class='content'><h1>Head</h1><p>Some body text that is long enough.</p></div><div id='footer'>end</div></body></html>"
    assert w.extract(html, w.rule(w.wrapper_of(html))) == "Head\n\nSome body text that is long enough."
