"""Cached encoding of texts piece by piece, cut where no tokenizer here looks across.

A text is cut before every space. For the split patterns of the vocabularies a token ends before a
space unless white space stands on both sides of the cut; so a text with a piece that is empty or
starts with white space (but for its first) is encoded as a whole instead. Pieces repeat, so each
worker keeps a bounded dictionary of encoded pieces, filled for a block of texts at a time; it is
emptied when full, which changes nothing but speed.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import pyarrow as pa

#: Bytes of a worker's dictionary of pieces, about, and of an entry besides its piece and value.
CACHE_BYTES, ENTRY_BYTES = 64_000_000, 200
#: A longer piece is encoded with its text, not kept.
MAX_PIECE = 200
#: Bytes of text in a block.
BLOCK_BYTES = 1 << 20


class Pieces(dict):
    """piece -> encoded piece; ``encode_many`` maps a list of pieces to the list of their values."""

    def __init__(self, encode_many: Callable[[list[str]], list], limit: int = CACHE_BYTES):
        super().__init__()
        self.encode_many, self.limit, self.held = encode_many, limit, 0

    def fill(self, wanted: set[str]) -> None:
        missing = [x for x in wanted if x not in self]
        if self.held > self.limit:
            self.clear()
            self.held = 0
            missing = list(wanted)
        values = self.encode_many(missing)
        self.update(zip(missing, values, strict=True))
        self.held += sum(map(len, missing)) + len(missing) * ENTRY_BYTES + (sum(map(len, values)) if values and isinstance(values[0], bytes) else 0)


def apart(piece: str) -> bool:
    """Whether a piece that follows a space may be encoded apart from what stands before it."""
    return 0 < len(piece) <= MAX_PIECE and not piece[0].isspace()


def blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """The texts of a batch in order, null as empty, in blocks of about ``most`` bytes; a text alone may hold more."""
    out, size = [], 0
    for x in batch.column(column):
        text = x.as_py() or ""
        out.append(text)
        size += x.as_buffer().size if x.is_valid else 0
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def by_size(items: Iterable[str], most: int) -> Iterator[list[str]]:
    """Lists of items of about ``most`` characters together; an item alone may hold more."""
    out, size = [], 0
    for x in items:
        out.append(x)
        size += len(x) + 8
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_block(texts: list[str], pieces: Pieces, whole: Callable[[str], bytes]) -> Iterator[bytes]:
    """The packed ids of each text; ``pieces`` encodes " " + piece, ``whole`` a text or its first piece."""
    cut = [x.split(" ") for x in texts]
    wanted: set[str] = set()
    for x in cut:
        wanted.update(x[1:])
    pieces.fill({x for x in wanted if apart(x)})
    for text, (head, *rest) in zip(texts, cut, strict=True):
        try:
            yield b"".join((whole(head), *map(pieces.__getitem__, rest)))
        except KeyError:  # a piece that isn't apart
            yield whole(text)


#: Split pattern of the byte-level pre-tokenizer (a fixed value of that format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters below this one are classed alike by every Unicode version in use.
PLAIN = chr(0x250)


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class LibraryIds:
    """Packed ids as the tokenizers library gives them for a .json file, without added special tokens.

    For a plain byte-level BPE file whose merges are in id order, the ids of a piece follow from the
    ranks alone, and the rank-based library gives them at a third of the cost. It gets pieces of
    Latin characters without special strings; the tokenizers library gets all others, and all of any
    other kind of file.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.plain = self._by_rank(json.load(f))

    @cached_property
    def library(self):
        """The tokenizers library's object, made when a text first needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    @staticmethod
    def _by_rank(spec: dict) -> Callable[[str], list[int]] | None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in odd) or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        special = {x["content"] for x in spec.get("added_tokens", ())}
        byte = _byte_alphabet()
        tokens = {t: i for t, i in model["vocab"].items() if t not in special}
        if made != sorted(set(made)) or len(tokens) != len(made) + 256 or any(c not in byte for t in tokens for c in t):
            return None
        import tiktoken

        ranks = {bytes(byte[c] for c in t): i for t, i in tokens.items()}
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def many(self, texts: list[str]) -> list[bytes]:
        if self.plain is None:
            return self._library(texts)
        simple = [(x.isascii() or max(x) < PLAIN) and "<" not in x for x in texts]
        rest = iter(self._library([x for x, ok in zip(texts, simple, strict=True) if not ok]))
        return [array("I", self.plain(x)).tobytes() if ok else next(rest) for x, ok in zip(texts, simple, strict=True)]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [] if not texts else [array("I", x.ids).tobytes() for part in by_size(texts, 1 << 20) for x in self.library.encode_batch_fast(part, add_special_tokens=False)]
