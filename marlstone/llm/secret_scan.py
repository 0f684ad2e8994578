"""Secret scan: plain patterns, and structures that are decoded and parsed before they are reported.

The patterns (assignments, access ids, long hex) stand as they are found. Beside them base64 and hex
runs are candidates for keys, and dotted runs for signed tokens. A candidate counts only if its
decoded bytes parse: a private key's encoding, whose nested lengths must fill one another to the last
byte; or a token whose header names a known algorithm, whose claims are an object and whose signature
has that algorithm's length. Texts are scanned whole, each on its own, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "key", "token")
#: Fixed patterns and least lengths of the base kinds (of group 2 for ``assign``, else of the match).
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Bytes of a key's encoding, and characters of a token's header, beyond which a candidate is none.
MOST_KEY, MOST_HEADER = 1 << 14, 1 << 12
#: How often an encoded text may be encoded again (base64 of an armoured key, say).
MOST_DEPTH = 3

_ALPHABET = "A-Za-z0-9+/_-"
#: Starts of encoded keys: a DER sequence in base64 or in hex (pairs may stand apart by a colon), an OpenSSH key in base64.
_DER64 = re.compile(rf"M[A-I][{_ALPHABET}]{{10}}")
_DER16 = re.compile(r"30:?(?:[0-7][0-9a-f]|8[123])(?=:?[0-9a-f]{2})", re.ASCII | re.IGNORECASE)
_SSH64 = re.compile("b3BlbnNzaC1rZXktdjEA")
_SSH_MAGIC = b"openssh-key-v1\0"
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(?:\r?\n|\\n)")
_LOCKED = re.compile(r"Proc-Type: 4,ENCRYPTED\r?\nDEK-Info: ([A-Z0-9-]+),([0-9A-Fa-f]+)\r?\n\r?\n")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{6,}+\.")
_REST = re.compile(r"[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*)*")
_BASE64 = re.compile(rf"[{_ALPHABET}]{{24,}}={{0,2}}")
#: Bytes of a signature by algorithm; a pair is a range. An encrypted token has five parts and names ``enc``.
SIGNATURES = {
    "HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114),
    "RS256": (128, 2048), "RS384": (128, 2048), "RS512": (128, 2048), "PS256": (128, 2048), "PS384": (128, 2048), "PS512": (128, 2048),
}
#: Bytes of a cipher's block in locked keys.
BLOCKS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def head(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER value at ``at``, by its length in shortest form; None if there is none."""
    if at + 2 > len(data):
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n >= 0x80:
        more = n & 0x7F
        if not 1 <= more <= 3 or at + more > len(data):
            return None
        n = int.from_bytes(data[at : at + more], "big")
        if n < 0x80 or n >> (8 * (more - 1)) == 0:
            return None
        at += more
    return tag, at, at + n


def parts(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill ``data[start:end]`` to the last byte; None if they don't."""
    out = []
    while start < end:
        found = head(data, start)
        if found is None or found[2] > end:
            return None
        out.append(found)
        start = found[2]
    return out


def _number(data: bytes, part: tuple[int, int, int]) -> int | None:
    tag, a, b = part
    return int.from_bytes(data[a:b], "big", signed=True) if tag == INTEGER and a < b else None


def private_key(data: bytes) -> str | None:
    """The encoding of the private key that ``data`` is, to the last byte: pkcs1, dsa, sec1, pkcs8, pkcs8-encrypted or openssh."""
    if data.startswith(_SSH_MAGIC):
        return "openssh" if _openssh(data) else None
    whole = head(data)
    if whole is None or whole[0] != SEQUENCE or whole[2] != len(data):
        return None
    found = parts(data, whole[1], whole[2])
    if not found or len(found) < 2:
        return None
    tags = [x[0] for x in found]
    version = _number(data, found[0])
    if version == 0 and len(found) == 9 and set(tags) == {INTEGER}:
        n, e, d, p, q = (_number(data, x) for x in found[1:6])
        return "pkcs1" if p * q == n and p > 1 and q > 1 and e > 1 and d > 1 else None
    if version == 0 and len(found) == 6 and set(tags) == {INTEGER}:
        p, q, g = (_number(data, x) for x in found[1:4])
        return "dsa" if q > 1 and (p - 1) % q == 0 and 1 < g < p else None
    if version == 1 and tags[1] == OCTETS and set(tags[2:]) <= {0xA0, 0xA1}:
        return "sec1" if 16 <= found[1][2] - found[1][1] <= 66 and all(parts(data, a, b) for _, a, b in found[2:]) else None
    if version in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
        return "pkcs8" if _algorithm(data, found[1]) and found[2][2] - found[2][1] >= 16 and _inner(data[found[2][1] : found[2][2]]) else None
    if tags == [SEQUENCE, OCTETS] and _algorithm(data, found[0]):
        size = found[1][2] - found[1][1]
        return "pkcs8-encrypted" if size >= 16 and size % 8 == 0 else None
    return None


def _algorithm(data: bytes, part: tuple[int, int, int]) -> bool:
    found = parts(data, part[1], part[2])
    return bool(found) and found[0][0] == OID and found[0][2] > found[0][1] and len(found) <= 2


def _inner(data: bytes) -> bool:
    """Whether the key inside a PKCS #8 value is a value of its own, to the last byte."""
    whole = head(data)
    return whole is not None and whole[0] in (SEQUENCE, OCTETS, INTEGER) and whole[2] == len(data) and (whole[0] != SEQUENCE or bool(parts(data, whole[1], whole[2])))


def _openssh(data: bytes) -> bool:
    """Cipher, its key derivation, as many public keys as counted, and the private part, each by its length, to the last byte."""
    at = len(_SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data)
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, kdf, options = string(), string(), string()
    if not cipher or not kdf or options is None or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys):
        public = string()
        if not public or len(public) < 8 or int.from_bytes(public[:4], "big") > len(public) - 4:
            return False
    private = string()
    if not private or at != len(data) or len(private) % 8:
        return False
    return cipher != b"none" or private[:4] == private[4:8]


def _gather(text: str, start: int, need: int) -> tuple[str, int] | None:
    """``need`` base64 characters from ``start`` and where they end, over line ends (real or written ``\\n``) and their indent."""
    taken, at = [], start
    while need:
        m = _RUN.match(text, at, at + need)
        if m:
            taken.append(m[0])
            need -= len(m[0])
            at = m.end()
            if not need:
                break
        m = _BREAK.match(text, at)
        if m is None:
            return None
        at = m.end()
    return "".join(taken), at


_RUN = re.compile(rf"[{_ALPHABET}]+")
_BREAK = re.compile(r"(?:\r?\n|\\n)[ \t]{0,64}(?=[A-Za-z0-9+/_-])")
_PAIRS = re.compile(r"(?:[0-9A-Fa-f]{2}[:\n]?)*", re.ASCII)
_URL = str.maketrans("-_", "+/")


def _decode(chars: str) -> bytes | None:
    try:
        return base64.b64decode(chars.translate(_URL) + "=" * (-len(chars) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _promising(data: bytes | None) -> int:
    """Bytes of the sequence that starts with ``data`` if a version or a sequence comes first in it, as in a private key, else 0."""
    found = head(data) if data else None
    if found is None or found[0] != SEQUENCE or not 16 < found[2] <= MOST_KEY:
        return 0
    first = data[found[1] : found[1] + 3]
    return found[2] if first in (b"\x02\x01\x00", b"\x02\x01\x01") or first[:1] == b"\x30" else 0


def _key64(text: str, start: int) -> tuple[int, str] | None:
    """(end, encoding) of the private key whose base64 starts at ``start``; its own length tells how many characters it has."""
    size = _promising(_decode(text[start : start + 12]))
    got = _gather(text, start, (size * 4 + 2) // 3) if size else None
    data = _decode(got[0]) if got else None
    kind = private_key(data) if data and len(data) == size else None
    return (_padded(text, got[1], len(got[0])), kind) if kind else None


def _padded(text: str, at: int, n: int) -> int:
    pad = "=" * (-n % 4)
    return at + len(pad) if text.startswith(pad, at) else at


def _ssh64(text: str, start: int) -> tuple[int, str] | None:
    taken, at = [], start
    size = 0
    while size * 3 <= MOST_KEY * 4:
        m = _RUN.match(text, at)
        if m is None:
            break
        taken.append(m[0])
        size, at = size + len(m[0]), m.end()
        m = _BREAK.match(text, at)
        if m is None:
            break
        at = m.end()
    chars = "".join(taken)
    data = _decode(chars)
    return (_padded(text, at, len(chars)), "openssh") if data and private_key(data) else None


def _key16(text: str, start: int) -> tuple[int, str] | None:
    """(end, encoding) of the private key whose hex pairs start at ``start``."""
    first = re.sub("[:\n]", "", _PAIRS.match(text, start, start + 24)[0])
    size = _promising(bytes.fromhex(first[: len(first) // 2 * 2]))
    digits = re.sub("[:\n]", "", _PAIRS.match(text, start, start + 3 * size)[0])[: 2 * size]
    kind = private_key(bytes.fromhex(digits)) if size and len(digits) == 2 * size else None
    if kind is None:
        return None
    end, left = start, 2 * size
    while left:  # separators between the pairs belong to the span, one behind the last doesn't
        left -= text[end] not in ":\n"
        end += 1
    return end, kind


def _json(chars: str) -> dict | None:
    data = _decode(chars) if len(chars) % 4 != 1 else None
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _token(text: str, start: int, dot: int) -> tuple[int, str] | None:
    """(end, algorithm) of the signed or encrypted token whose header is ``text[start:dot]``."""
    if dot - start > MOST_HEADER or not re.match(rb'\{\s*["}]', _decode(text[start : start + (8 if dot - start >= 8 else 4)]) or b""):
        return None
    header = _json(text[start:dot])
    alg = header.get("alg") if header else None
    if not isinstance(alg, str):
        return None
    rest = _REST.match(text, dot + 1)
    found = rest[0].split(".")
    if "enc" in header:
        if len(found) < 4 or not all(found[1:4]):
            return None
        return dot + 1 + sum(map(len, found[:4])) + 3, alg
    if alg not in SIGNATURES or len(found) < 2 or _json(found[0]) is None:
        return None
    signature = _decode(found[1]) if len(found[1]) % 4 != 1 else None
    low, high = SIGNATURES[alg]
    return (dot + 2 + len(found[0]) + len(found[1]), alg) if signature and low <= len(signature) <= high else None


def _locked(text: str, m: re.Match) -> tuple[int, str] | None:
    """A locked armoured key: cipher and vector are named, and the body is whole blocks of that cipher."""
    lock = _LOCKED.match(text, m.end())
    if lock is None or lock[1] not in BLOCKS or len(lock[2]) != 2 * BLOCKS[lock[1]]:
        return None
    end = text.find("-----END", lock.end(), lock.end() + 2 * MOST_KEY)
    data = _decode("".join(text[lock.end() : end].split()).rstrip("=")) if end > 0 else None
    return (end, "locked") if data and len(data) % BLOCKS[lock[1]] == 0 else None


def structures(text: str, depth: int = 0) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, detail) of the keys and tokens in ``text``: leftmost, none inside another."""
    found: list[tuple[int, int, str, str]] = []

    def scan(pattern: re.Pattern, kind: str, confirm) -> None:
        at = 0
        while m := pattern.search(text, at):
            hit = confirm(m)
            at = hit[0] if hit else m.start() + 1
            if hit:
                found.append((m.start(), hit[0], kind, hit[1]))

    scan(_DER64, "key", lambda m: _key64(text, m.start()))
    scan(_DER16, "key", lambda m: _key16(text, m.start()))
    scan(_SSH64, "key", lambda m: _ssh64(text, m.start()))
    scan(_ARMOUR, "key", lambda m: _locked(text, m))
    at = 0
    while m := _TOKEN.search(text, at):
        hit = next(((s, *h) for s in _starts(m) if (h := _token(text, s, m.end() - 1))), None)
        at = hit[1] if hit else m.end()
        if hit:
            found.append((hit[0], hit[1], "token", hit[2]))
    if depth < MOST_DEPTH:
        taken = sorted(x[:2] for x in found)
        for m in _BASE64.finditer(text):
            near = bisect_left(taken, (m.end(),)) - 1
            if near < 0 or taken[near][1] <= m.start():
                inner = _inner_text(m[0])
                kinds = structures(inner, depth + 1) if inner else []
                if kinds:
                    found.append((m.start(), m.end(), kinds[0][2], "encoded " + kinds[0][3]))
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(_armoured(text, f) for f in found):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _starts(m: re.Match) -> Iterator[int]:
    """Places in a dotted run's first part where a header may start; a header is no longer than ``MOST_HEADER``."""
    low = max(m.start(), m.end() - 1 - MOST_HEADER)
    return (low + x.start() for x in re.finditer("e[wy]", m.string[low : m.end()]))


def _inner_text(chars: str) -> str | None:
    """The ASCII text that a base64 or hex run encodes, or None."""
    if len(chars) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", chars, re.ASCII):
        data = bytes.fromhex(chars)
        return data.decode() if data.isascii() else None
    chars = chars.rstrip("=")
    start = _decode(chars[:24])
    if start is None or not start.isascii() or not start.decode().replace("\n", " ").replace("\r", " ").isprintable():
        return None
    data = _decode(chars[: len(chars) - (len(chars) % 4 == 1)])
    return data.decode() if data and data.isascii() else None


def _armoured(text: str, x: tuple[int, int, str, str]) -> tuple[int, int, str, str]:
    """The span of a key with its BEGIN and END lines, where both stand around it."""
    start, end, kind, detail = x
    if kind != "key":
        return x
    begin = text.rfind("-----BEGIN ", max(0, start - 200), start + 11)
    m = _ARMOUR.match(text, begin) if begin >= 0 else None
    if m is None or (m.end() != start and begin != start):
        return x
    tail = re.compile(rf"(?:\r?\n|\\n)?-----END {m[1]}-----").match(text, end)
    return (begin, tail.end(), kind, detail) if tail else x


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Leftmost matches of each base kind that don't overlap, those too short left out."""
    out = [(m.start(), m.end(), "assign", m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        out += [(m.start(), m.end(), kind, "") for m in pattern.finditer(text) if len(m[0]) >= LEAST[kind]]
    return out


def scan(text: str | None) -> list[tuple[int, int, str, str]]:
    """All spans of a text by start, then kind: (start, end, kind, detail), in code points, the end exclusive."""
    return sorted(base_spans(text or "") + structures(text or ""), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = "array<struct<kind:string,start:long,end:long,detail:string>>"


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, detail) of each row, by start, then in the order of ``KINDS``.

    A null text is empty and has no spans, as has an empty one. Each row is scanned on its own and whole,
    so repeated rows and ties need no rule; an empty table gives an empty result. Other columns are
    dropped, so no name can clash. ``detail`` tells a key's encoding, a token's algorithm or an
    assignment's word. Limits of what is a key or a token: ``MOST_KEY``, ``MOST_HEADER``, ``MOST_DEPTH``.
    """
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "detail": d} for a, b, k, d in scan(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kinds)], names=["doc_id", "spans"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, f"doc_id {id_type}, spans {SPANS}")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text, from ``spans``."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*LEAST))
    return found.select("doc_id", *map(of, LEAST), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
