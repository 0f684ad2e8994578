"""Chunks of code along its structure, and of prose by sentences.

A document's lines are folded once over a stack: each line is a node below the nearest line of a lower
level before it. The level is the indentation, or in languages with braces the depth of brackets; lines
inside an open bracket or string belong to the statement they continue. A node that is too large is cut
between its children, and so on down; the pieces are then joined into chunks so that the cuts cost
least: a cut costs more the deeper it lies in the nesting. Documents are independent of one another,
so all of this happens where Spark has put them; symbols are joined across chunks by Spark afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk at most, and sentences of a group.
MOST_CHARS, GROUP = 4000, 3
#: What a cut costs at each depth (1 + depth), and one inside a line.
INSIDE = 1000

#: Languages by file extension (fixed values).
EXTENSIONS = {
    "py": "python", "pyw": "python", "rs": "rust", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx",
    "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby", "lua": "lua",
}
_SCRIPT = r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?P<function>function\b\*?|class\b|interface\b|type\b|enum\b|const\b(?=\s+\w+\s*=\s*(?:async\s*)?\(?[\w\s,]*\)?\s*=>))\s*(?P<name>\w+)"
#: What starts a definition, by language: the group ``function`` holds the keyword, ``name`` the symbol.
DEFINITIONS = {
    "python": r"(?:async\s+)?(?P<function>def|class)\s+(?P<name>\w+)",
    "javascript": _SCRIPT, "typescript": _SCRIPT, "tsx": _SCRIPT,
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+|async\s+|const\s+)*(?P<function>fn|struct|enum|trait|mod|impl)\b(?:<[^>]*>)?\s*(?P<name>\w+)",
    "go": r"(?P<function>func|type)\s+(?:\([^)]*\)\s*)?(?P<name>\w+)",
    "java": r"(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+)*(?:(?P<function>class|interface|enum)\s+(?P<name>\w+)|(?:[\w<>\[\]]+\s+)(?P<name2>\w+)\s*\([^;]*\)\s*\{)",
    "c": r"(?:typedef\s+)?(?:(?P<function>struct|enum|union)\s+(?P<name>\w+)\s*\{|(?:[\w*]+\s+)+\*?(?P<name2>\w+)\s*\([^;]*\)\s*\{)",
    "cpp": r"(?:(?P<function>class|struct|namespace|enum)\s+(?P<name>\w+)|(?:[\w:<>*&]+\s+)+\*?(?P<name2>[\w:]+)\s*\([^;]*\)\s*(?:const\s*)?\{)",
    "ruby": r"(?P<function>def|class|module)\s+(?:self\.)?(?P<name>\w+)",
    "lua": r"(?:local\s+)?(?P<function>function)\s+(?P<name>[\w.:]+)",
}
_PATTERNS = {k: re.compile(v) for k, v in DEFINITIONS.items()}
_METHOD = re.compile(r"(?:static\s+|async\s+|get\s+|set\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)\w+)\s*\([^;{}]*\)\s*\{")
BRACED = frozenset(DEFINITIONS) - {"python", "ruby", "lua"}
#: Where code of an unknown language may be cut: before these words at the start of a line (fixed values).
BOUNDARIES = re.compile(r"^(?=(?:def |class |async def |struct |interface |type |export ))", re.MULTILINE)
#: Strings and comments by family; what they hold is no structure.
_MARKS = {
    True: re.compile(r"""(?P<open>/\*|`)|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|//.*"""),
    False: re.compile(r"""(?P<open>\"{3}|'{3})|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\#.*"""),
}
_CLOSERS = {"/*": "*/", "`": "`", '"""': '"""', "'''": "'''"}
_QUOTED, _BRACKETS = re.compile(r"[\"'#/`]"), re.compile(r"[()\[\]{}]")
_LINES = re.compile(r"[^\n]*\n|[^\n]+")
_CALL = re.compile(r"(\w+)\s*\(")
_BASES = re.compile(r"class\s+\w+\s*\(([^)]*)\)")
_KEYWORDS = frozenset("if elif while for in and or not return yield with assert print lambda def class del raise except import from await switch catch function".split())


@dataclass(slots=True)
class Node:
    """A line and what is nested below it: ``text[start:end]``."""

    level: int
    start: int
    end: int
    name: str | None = None
    kind: str | None = None
    waits: bool = False  # a decorator whose definition is to come
    children: list[Node] = field(default_factory=list)


def language(path: str | None) -> str | None:
    return EXTENSIONS.get((path or "").lower().rpartition(".")[2]) if "." in (path or "") else None


def _bare(line: str, inside: str | None, braced: bool) -> tuple[str, str | None]:
    """The line without what stands in strings and comments, and the string or comment it leaves open."""
    out, at = [], 0
    while True:
        if inside:
            end = line.find(_CLOSERS[inside], at)
            if end < 0:
                return "".join(out), inside
            at, inside = end + len(_CLOSERS[inside]), None
        m = _MARKS[braced].search(line, at)
        if m is None:
            return "".join([*out, line[at:]]), None
        out.append(line[at : m.start()] + '""')
        at, inside = m.end(), m["open"]


def outline(text: str, lang: str) -> tuple[Node, list[tuple[str, int]], list[tuple[str, int]]]:
    """(root, definitions, references) of a text, each symbol with the place of its line."""
    braced, pattern = lang in BRACED, _PATTERNS[lang]
    root = Node(-1, 0, len(text))
    stack, defined, used = [root], [], []
    depth, inside, at = 0, None, 0
    for line in _LINES.findall(text):
        start, at = at, at + len(line)
        goes_on = inside is not None or (not braced and depth > 0)
        bare, inside = _bare(line, inside, braced) if inside or _QUOTED.search(line) else (line, None)
        code = bare.strip()
        if not code and not goes_on:
            continue
        closing = len(code) - len(code.lstrip(")]}"))
        level = depth - closing if braced else _indent(bare)
        if found := _BRACKETS.findall(code):
            depth = max(0, depth + sum(map("([{".count, found)) - sum(map(")]}".count, found)))
        m = pattern.match(code) if not goes_on else None
        name = (m["name"] or m.groupdict().get("name2")) if m else None
        kind = ((m["function"] or "function").rstrip("*") if m else None) if name else None
        if name is None and lang in ("javascript", "typescript", "tsx") and len(stack) > 1 and (m := _METHOD.match(code)):
            name, kind = m["name"], "method"
        if lang == "python" and "(" in code:
            used += [(x, start) for x in _references(code, name)]
        if name:
            defined.append((name, start))
        if goes_on or (closing and len(stack) > 1):
            while closing and not goes_on and len(stack) > 2 and stack[-1].level > level:
                _pop(stack)
            stack[-1].end = at
            continue
        while len(stack) > 1 and stack[-1].level >= level and not (stack[-1].waits and stack[-1].level == level):
            _pop(stack)
        if stack[-1].waits and stack[-1].level == level:
            node = stack[-1]
            node.end, node.name, node.kind = at, name, kind
            node.waits = code.startswith("@")
            continue
        node = Node(level, start, at, name, kind, lang == "python" and code.startswith("@"))
        stack[-1].children.append(node)
        stack.append(node)
    while len(stack) > 1:
        _pop(stack)
    root.end = len(text)
    return root, defined, used


def _indent(line: str) -> int:
    if "\t" in line:
        line = line.expandtabs(8)
    return len(line) - len(line.lstrip())


def _pop(stack: list[Node]) -> None:
    node = stack.pop()
    stack[-1].end = max(stack[-1].end, node.end)


def _references(code: str, name: str | None) -> list[str]:
    """Names that a line calls, and the plain base classes of one it defines."""
    bases = _BASES.match(code) if code.startswith("class") else None
    if bases:
        return [x.strip() for x in bases[1].split(",") if re.fullmatch(r"\s*[A-Za-z_]\w*\s*", x)]
    return [x for x in _CALL.findall(code) if x != name and x not in _KEYWORDS and not x[0].isdigit()]


Piece = tuple[int, int, bool, "Node | None", int]


def pieces(text: str, root: Node, most: int) -> list[Piece]:
    """(start, end, cut inside, definition, cost of the cut before) without a gap, none larger than ``most``."""
    out: list[Piece] = []

    def plain(start: int, end: int, cost: int) -> None:
        inside = False
        while end - start > most:
            out.append((start, start + most, True, None, INSIDE if inside else cost))
            start, inside = start + most, True
        if end > start:
            out.append((start, end, False, None, INSIDE if inside else cost))

    todo: list[tuple[int, int, Node | None, int]] = [(0, len(text), root, 0)] if text else []
    while todo:
        start, end, node, depth = todo.pop()
        if node is None or (end - start > most and not node.children):
            plain(start, end, depth + 1)
        elif end - start <= most:
            out.append((start, end, False, node if node.name else None, depth + 1))
        else:
            parts, cursor = [], start
            for child in node.children:
                if child.start > cursor:
                    parts.append((cursor, child.start, None, depth))
                parts.append((child.start, child.end, child, depth + (node.level >= 0)))
                cursor = child.end
            if end > cursor:
                parts.append((cursor, end, None, depth))
            todo += reversed(parts)
    return out


def joined(found: list[Piece], most: int) -> list[tuple[int, int]]:
    """Ranges of pieces, at least cost: the sum of the costs of the cuts between them; of equal ones those with the fullest last chunks."""
    best, back = [0] + [1 << 60] * len(found), [0] * (len(found) + 1)
    for k in range(1, len(found) + 1):
        i = k - 1
        while i >= 0 and found[k - 1][1] - found[i][0] <= most:
            cost = best[i] + (found[i][4] if i else 0)
            if cost <= best[k]:
                best[k], back[k] = cost, i
            i -= 1
    out, k = [], len(found)
    while k:
        out.append((back[k], k))
        k = back[k]
    return out[::-1]


def filled(found: list[Piece], most: int) -> list[tuple[int, int]]:
    """Ranges of pieces, each as full as the order allows."""
    out: list[tuple[int, int]] = []
    for k, x in enumerate(found):
        if out and x[1] - found[out[-1][0]][0] <= most:
            out[-1] = (out[-1][0], k + 1)
        else:
            out.append((k, k + 1))
    return out


def chunked(text: str, lang: str | None, most: int = MOST_CHARS, least_cost: bool = True) -> list[dict]:
    """The chunks of a text, gapless: start, end, is_fragment, the first definition that lies whole in it, symbols defined and used."""
    if lang is None:
        starts = sorted({0, *(m.start() for m in BOUNDARIES.finditer(text))})
        root = Node(-1, 0, len(text), children=[Node(0, a, b) for a, b in zip(starts, [*starts[1:], len(text)], strict=True) if b > a])
        defined = used = []
    else:
        root, defined, used = outline(text, lang)
    found = pieces(text, root, most)
    out = []
    for i, k in (joined if least_cost else filled)(found, most):
        start, end = found[i][0], found[k - 1][1]
        first = next((x[3] for x in found[i:k] if x[3]), None)
        out.append({"start": start, "end": end, "is_fragment": any(x[2] for x in found[i:k]), "symbol": first and first.name, "kind": first and first.kind})
    for column, symbols in (("defs", defined), ("refs", used)):
        at = 0
        sets: list[set[str]] = [set() for _ in out]
        for name, place in symbols:
            while place >= out[at]["end"]:
                at += 1
            sets[at].add(name)
        for x, names in zip(out, sets, strict=True):
            x[column] = sorted(names)
    return out


CHUNKS = "chunk int, start long, end long, is_fragment boolean, symbol string, kind string, defs array<string>, refs array<string>, content string"


def code_chunks(docs: DataFrame, most: int = MOST_CHARS, least_cost: bool = True) -> DataFrame:
    """Chunks of ``docs(doc_id, path, content)``: place in the document, span, symbols and text; ``content[start:end]`` is gapless.

    The language follows from the path's extension; of an unknown one, texts are cut before lines that
    start a definition by their first word. ``least_cost`` joins pieces so that cuts lie as far out in
    the nesting as can be; otherwise each chunk is filled as far as it goes. Null and empty texts have no chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        for batch in batches:
            for row in range(len(batch)):  # a batch for each document: a long one's chunks are as large as it is
                text = batch.column("content")[row].as_py() or ""
                found = chunked(text, language(batch.column("path")[row].as_py()), most, least_cost)
                if found:
                    ids = batch.column("doc_id")
                    columns = [pa.array([ids[row].as_py()] * len(found), ids.type), pa.array(range(len(found)), pa.int32())]
                    for name, kind in (("start", pa.int64()), ("end", pa.int64()), ("is_fragment", pa.bool_()), ("symbol", pa.string()), ("kind", pa.string()), ("defs", strings), ("refs", strings)):
                        columns.append(pa.array([x[name] for x in found], kind))
                    columns.append(pa.array([text[x["start"] : x["end"]] for x in found], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "chunk", "start", "end", "is_fragment", "symbol", "kind", "defs", "refs", "content"])

    return docs.select("doc_id", F.col("path").cast("string").alias("path"), "content").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {CHUNKS}")


def symbol_sites(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions, references): ``(doc_id, symbol, chunk)`` of chunks that define or use a symbol."""
    return tuple(chunks.select("doc_id", F.explode(c).alias("symbol"), "chunk") for c in ("defs", "refs"))


def symbol_links(chunks: DataFrame) -> DataFrame:
    """(doc_id, a, b, symbols): chunk ``a`` uses so many symbols that chunk ``b`` of the same document defines."""
    defs, refs = symbol_sites(chunks)
    pairs = refs.withColumnRenamed("chunk", "a").join(defs.withColumnRenamed("chunk", "b"), ["doc_id", "symbol"]).where("a <> b")
    return pairs.groupBy("doc_id", "a", "b").agg(F.count("*").alias("symbols"))


def sentences(text: Column) -> Column:
    """Texts between white space that follows a full stop, exclamation or question mark; trimmed, none empty."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def sentence_groups(docs: DataFrame, size: int = GROUP, overlap: int = 0) -> DataFrame:
    """(doc_id, position, n, text): every ``size`` sentences of ``docs(doc_id, content)``, each group repeating the last ``overlap`` of the one before."""
    step = size - min(overlap, size - 1)
    found = docs.select("doc_id", sentences(F.col("content")).alias("found")).where(F.size("found") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("found") - size) / F.lit(step))) if overlap else F.floor((F.size("found") - 1) / F.lit(step))
    groups = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.slice("found", i * step + 1, F.lit(size)))
    return found.select("doc_id", F.posexplode(groups).alias("position", "group")).select("doc_id", "position", F.size("group").alias("n"), F.array_join("group", " ").alias("text"))
