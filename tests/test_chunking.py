"""Code chunks against a recursive splitter and all ways of joining, sentence groups against a loop."""

import itertools
import random
import re

import pytest

from marlstone import registry
from marlstone.operators import chunking as ck
from marlstone.plans.ingest import code_texts

SF = "/root/testdata/sf0.001"
PYTHON = '''"""Module with def inside: class No."""
import os

@wrap
@other(1)
class Outer(Base, Mixin):
    """doc {[("""

    def first(self, x=(1,
            2)):
        if x:
            return helper(x)
        return self.second(x)

    # def commented(self):
    async def second(self):
        s = "def fake(): {"
        return [
            first(i)
        for i in s]

def helper(x):
    def inner():
        return os.path.join(x)
    return inner()
'''
SCRIPT = """import x from 'y';
export class Widget {
  render(a) {
    const s = `class Fake {`;
    return helper(a);
  }
  static of(x) { return new Widget(x); }
}

/* function gone() { */
export function helper(a) {
  if (a) {
    go("}");
  } else {
    stop();
  }
}
const short = (x) => {
  return x;
};
"""


def spans(text, found):
    return [text[x["start"] : x["end"]] for x in found]


@pytest.mark.parametrize(("text", "lang"), [(PYTHON, "python"), (SCRIPT, "javascript"), ("", "python"), ("\n\n", "rust"), ("}}}\n)", "javascript"), ('"""open\ndef f(): pass', "python"), ("x" * 500, "python")])
@pytest.mark.parametrize("most", [20, 45, 80, 160, 4000])
@pytest.mark.parametrize("least", [True, False])
def test_gapless_and_bounded(text, lang, most, least):
    found = ck.chunked(text, lang, most, least)
    assert "".join(spans(text, found)) == text
    assert all(0 < x["end"] - x["start"] <= most for x in found)


def nested(node, text, most, depth=0):
    """The pieces of a node by recursion."""
    if node.end - node.start <= most:
        return [(node.start, node.end)]
    if not node.children:
        return [(i, min(i + most, node.end)) for i in range(node.start, node.end, most)]
    out, cursor = [], node.start
    for c in [*node.children, None]:
        stop = c.start if c else node.end
        out += [(i, min(i + most, stop)) for i in range(cursor, stop, most)]
        if c:
            out += nested(c, text, most)
            cursor = c.end
    return out


def code(rng, depth=0):
    lines = []
    for _ in range(rng.randint(1, 4)):
        pad = "    " * depth
        if depth < 4 and rng.random() < 0.45:
            lines += [f"{pad}@deco"] * (rng.random() < 0.3) + [pad + rng.choice([f"def f{rng.randint(0, 9)}(a):", f"class C{rng.randint(0, 9)}(B):", "if x:"])] + code(rng, depth + 1)
        else:
            lines.append(pad + rng.choice(["call(1)", "x = [1,\n2]", "", "# note", "s = 'é{'", "y" * rng.randint(1, 90)]))
    return lines


def test_pieces_equal_recursion():
    rng = random.Random(2)
    for _ in range(150):
        text = "\n".join(code(rng))
        most = rng.choice([15, 40, 100])
        root, _, _ = ck.outline(text, "python")
        assert [x[:2] for x in ck.pieces(text, root, most)] == nested(root, text, most) if text else True


def test_joined_costs_least_of_all_ways():
    rng = random.Random(4)
    for _ in range(200):
        at, found = 0, []
        for _ in range(rng.randint(1, 9)):
            n = rng.randint(1, 10)
            found.append((at, at + n, False, None, rng.choice([1, 2, 3, 1000])))
            at += n
        ways = []
        for cuts in itertools.product([False, True], repeat=len(found) - 1):
            ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(found)]
            if all(found[b - 1][1] - found[a][0] <= 12 for a, b in itertools.pairwise(ends)):
                ways.append(sum(found[i][4] for i in ends[1:-1]))
        got = ck.joined(found, 12)
        assert sum(found[a][4] for a, _ in got[1:]) == min(ways)
        assert [a for a, _ in got] == [0, *(b for _, b in got[:-1])] and got[-1][1] == len(found)


def test_python_symbols():
    root, defs, refs = ck.outline(PYTHON, "python")
    assert [x for x, _ in defs] == ["Outer", "first", "second", "helper", "inner"]
    assert [x for x, _ in refs] == ["other", "Base", "Mixin", "helper", "second", "first", "join", "inner"]
    outer = next(x for x in root.children if x.name == "Outer")
    assert PYTHON[outer.start :].startswith("@wrap") and PYTHON[: outer.end].rstrip().endswith("for i in s]")
    assert [x.name for x in outer.children if x.name] == ["first", "second"]
    found = ck.chunked(PYTHON, "python", 230)
    assert [x["symbol"] for x in found] == ["first", "second"] and found[0]["defs"] == ["Outer", "first"]


def test_script_symbols():
    root, defs, _ = ck.outline(SCRIPT, "javascript")
    assert [x for x, _ in defs] == ["Widget", "render", "of", "helper", "short"]
    widget = next(x for x in root.children if x.name == "Widget")
    assert SCRIPT[: widget.end].endswith("}\n}\n") and [x.name for x in widget.children] == ["render", "of"]


@pytest.mark.parametrize(("lang", "text", "names"), [
    ("rust", "pub fn go() {\n}\nimpl<T> Thing {\n  fn new() -> Self {\n  }\n}\nstruct S { a: u8 }\n", ["go", "Thing", "new", "S"]), ("go", "func (s *T) Run(a int) {\n}\ntype T struct {\n}\n", ["Run", "T"]),
    ("java", "public class A {\n  private int run(int x) {\n    return f(x);\n  }\n}\n", ["A", "run"]), ("c", "static int main(void) {\n  return 0;\n}\nstruct p {\n};\n", ["main", "p"]), ("typescript", "interface I {\n}\nexport type T = string;\n", ["I", "T"]),
    ("ruby", "module M\n  def self.go\n  end\nend\n", ["M", "go"]), ("lua", "local function f(x)\nend\n", ["f"]),
])
def test_definitions_of_languages(lang, text, names):
    assert [x for x, _ in ck.outline(text, lang)[1]] == names


def test_unknown_language_cuts_before_definitions():
    text = "intro\ndef one\n" + "a" * 30 + "\nclass Two\n  def inner\nexport x\n"
    assert spans(text, ck.chunked(text, None, 45, False)) == ["intro\ndef one\n" + "a" * 30 + "\n", "class Two\n  def inner\nexport x\n"]
    assert ck.language("/a/b.PY") == "python" and ck.language("x.unknown") is ck.language(None) is ck.language("py") is None


def test_deep_nesting_needs_no_recursion():
    text = "\n".join(" " * i + "if x:" for i in range(3000))
    assert "".join(spans(text, ck.chunked(text, "python", 2000))) == text


def test_chunks_and_links_of_a_table(spark):
    docs = spark.createDataFrame([(1, "a.py", PYTHON), (2, "b.js", SCRIPT), (3, "c.py", None), (4, None, "def x\n" * 3), (5, "d.py", "")], "doc_id long, path string, content string")
    found = ck.code_chunks(docs, 120).orderBy("doc_id", "chunk").collect()
    for i, text in ((1, PYTHON), (2, SCRIPT), (4, "def x\n" * 3)):
        own = [r for r in found if r.doc_id == i]
        assert "".join(r.content for r in own) == text and [r.chunk for r in own] == list(range(len(own)))
        assert all(text[r.start : r.end] == r.content for r in own)
    assert {r.doc_id for r in found} == {1, 2, 4}
    own = [r for r in found if r.doc_id == 1]
    want = {(a.chunk, b.chunk, len(set(a.refs) & set(b.defs))) for a in own for b in own if a.chunk != b.chunk and set(a.refs) & set(b.defs)}
    assert {(r.a, r.b, r.symbols) for r in ck.symbol_links(ck.code_chunks(docs, 120)).where("doc_id = 1").collect()} == want and want


@pytest.mark.parametrize(("size", "overlap"), [(3, 0), (3, 1), (2, 5), (1, 0)])
def test_sentence_groups(spark, size, overlap):
    texts = ["One. Two! Three? Four.  Five", "", None, " . ", "a.b c", "X.\n\nY! " * 4]
    step, want = size - min(overlap, size - 1), {}
    for i, t in enumerate(texts):
        found = [s.strip() for s in re.split(r"(?<=[.!?])\s+", (t or "").strip()) if s.strip()]
        k = 0
        while k < len(found):
            want[i, len([x for x in want if x[0] == i])] = " ".join(found[k : k + size])
            if overlap and k + size >= len(found):
                break
            k += step
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    assert {(r.doc_id, r.position): r.text for r in ck.sentence_groups(docs, size, overlap).collect()} == want


def test_query_code_chunks(spark):
    found = registry.QUERIES["code_chunks"](spark, SF).collect()
    texts = {r.doc_id: r.content for r in code_texts(spark, SF).collect() if r.content}
    for i, text in texts.items():
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.start)
        assert own[0].start == 0 and own[-1].end == len(text) and all(a.end == b.start for a, b in itertools.pairwise(own))
    assert any(r.symbol for r in found) and not any(r.is_fragment for r in found)
