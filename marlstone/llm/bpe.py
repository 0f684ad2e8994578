"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Tokens are a linked list of positions. Each merge rank has a bucket of the positions whose pair
merges at that rank; three levels of 64-bit words say which buckets hold anything. Find-first-set on
each level gives the lowest waiting rank; entries of its bucket whose pair has changed since are
stale and skipped. The pre-tokens of a block share one list (no pair crosses an end), so that a
bucket is taken as one array and a few thousand array steps merge hundreds of thousands of
pre-tokens. A single very long pre-token is such a list too. A merge adds at most two entries.

Within a bucket merges go from left to right, as one at a time would. Only if two merges of one
pre-token in one step made a pair of a lower rank could the order matter; such a pre-token is then
encoded by the one-at-a-time form, :meth:`ByteBpe.merge`.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tokenise import Pieces, blocks, encode_block

_NONE = np.int64(1 << 40)


class RankQueue:
    """Buckets by rank under three levels of bitmaps."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((len(self.low) >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, marked as holding something."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            word = rank >> 6
            self.low[word] |= 1 << (rank & 63)
            self.mid[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        return found

    def lowest(self) -> int:
        k = (self.top & -self.top).bit_length() - 1
        mid = self.mid[k]
        word = (k << 6) + (mid & -mid).bit_length() - 1
        low = self.low[word]
        return (word << 6) + (low & -low).bit_length() - 1

    def remove(self, rank: int) -> list:
        """Takes the bucket of a rank out."""
        word = rank >> 6
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.mid[word >> 6] &= ~(1 << (word & 63))
            if not self.mid[word >> 6]:
                self.top &= ~(1 << (word >> 6))
        return self.buckets.pop(rank)


class ByteBpe:
    """Encoder and decoder of a rank file (one ``base64 rank`` a line) with its split pattern."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(i) for i in range(self.size)]
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        #: left * size + right -> the token that both make, whose number is its rank.
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.made = np.array([self.pairs[int(k)] for k in self.keys], np.int64)
        self.find = regex.compile(pattern).findall
        self.words = Pieces(self.encode_words)
        self.pieces = Pieces(lambda found: self._packed([" " + x for x in found]))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where there is none or a side is negative."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], _NONE)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each match of the pattern."""
        raw = [x.encode() for x in words]
        whole = [self.ranks.get(x) for x in raw]
        long = [x for x, w in zip(raw, whole, strict=True) if w is None]
        merged = iter(self.merge_all(long)) if long else iter(())
        return [array("I", [w]).tobytes() if w is not None else next(merged) for w in whole]

    def merge_all(self, raw: list[bytes]) -> list[bytes]:
        """Packed ids of each byte string, all merged side by side."""
        sizes = np.array([len(x) for x in raw])
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        ids = np.empty(n + 1, np.int64)
        ids[:n] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        ids[n] = -1
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends - sizes] = n
        rank_at = np.full(n + 1, _NONE)
        rank_at[:n] = self._rank(ids[:n], ids[after[:n]])
        queue = RankQueue(self.size)
        odd: set[int] = set()

        def push(at: np.ndarray) -> None:
            ranks = rank_at[at]
            at = at[ranks < _NONE]
            if len(at):
                ranks = rank_at[at]
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                for part in np.split(at, cuts) if len(cuts) else (at,):
                    queue.bucket(int(rank_at[part[0]])).append(part)

        push(np.arange(n))
        while queue.top:
            rank = queue.lowest()
            parts = queue.remove(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[rank_at[at] == rank]  # the rest is stale
            if len(at) > 1:
                at = np.unique(at)
                joined = after[at[:-1]] == at[1:]
                if joined.any():  # of pairs that share a token every second one, from the left
                    start = np.maximum.accumulate(np.where(np.r_[True, ~joined], np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            right = after[at]
            end = after[right]
            ids[at], ids[right] = rank, -1
            rank_at[right] = _NONE
            after[at], before[end] = end, at
            left = before[at]
            rank_at[at] = self._rank(ids[at], ids[end])
            rank_at[left] = self._rank(ids[left], ids[at])
            rank_at[n] = _NONE
            touched = np.concatenate((at, left))
            if (rank_at[touched] < rank).any():
                word = np.searchsorted(ends, at, side="right")
                low = np.searchsorted(ends, touched[rank_at[touched] < rank], side="right")
                odd.update(set(low.tolist()) & set(word[1:][word[1:] == word[:-1]].tolist()))
            push(touched)
        live = ids[:n] >= 0
        packed = ids[:n][live].astype(np.uint32).tobytes()
        upto = (np.cumsum(live)[ends - 1] * 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]
        for k in odd:
            out[k] = array("I", self.merge(self.bytes[np.frombuffer(raw[k], np.uint8)].tolist())).tobytes()
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """The merges of one pre-token, one at a time."""
        pairs, size, queue, n = self.pairs.get, self.size, RankQueue(self.size), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def push(left: int, right: int) -> None:
            if left >= 0 and right < n and (rank := pairs(ids[left] * size + ids[right])) is not None:
                heappush(queue.bucket(rank), left)

        for at in range(n - 1):
            push(at, at + 1)
        while queue.top:
            rank = queue.lowest()
            bucket = queue.buckets[rank]
            at = heappop(bucket)
            if not bucket:
                queue.remove(rank)
            right = after[at]
            if ids[at] < 0 or right >= n or pairs(ids[at] * size + ids[right]) != rank:
                continue  # stale
            ids[at], ids[right] = rank, -1
            after[at] = end = after[right]
            before[end] = at
            push(at, end)
            push(before[at], at)
        return [x for x in ids if x >= 0]

    def _packed(self, texts: list[str]) -> list[bytes]:
        found = [self.find(x) for x in texts]
        self.words.fill({w for words in found for w in words})
        return [b"".join(map(self.words.__getitem__, words)) for words in found]

    def encode_texts(self, texts: list[str]) -> Iterator[array]:
        """Ids of each whole text."""
        for packed in encode_block(texts, self.pieces, lambda x: self._packed([x])[0]):
            yield array("I", packed)

    def encode(self, text: str) -> array:
        return next(self.encode_texts([text]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def codec(rank_file: str, pattern: str) -> ByteBpe:
    """The worker's codec for a rank file; built once a process."""
    if (rank_file, pattern) not in _CODECS:
        _CODECS[rank_file, pattern] = ByteBpe(rank_file, pattern)
    return _CODECS[rank_file, pattern]


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", doc_id: str = "doc_id", digests: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens`` and, of each whole text, its ``ids`` and ``decoded`` bytes, or their sha-256 with ``digests``.

    A null text counts as empty: no tokens. A text of any length is encoded whole, and one pre-token
    of any length in time n log n. Each row is encoded on its own, so repeated rows, ties and empty
    tables need no rule; other columns are dropped, whatever their names. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            counts, ids_out, decoded_out = [], [], []
            for texts in blocks(batch, 1):
                for ids in c.encode_texts(texts):
                    decoded = c.decode(ids)
                    counts.append(len(ids))
                    if digests:
                        ids_out.append(sha256(" ".join(map(c.decimals.__getitem__, ids)).encode()).hexdigest())
                        decoded_out.append(sha256(decoded).hexdigest())
                    else:
                        ids_out.append(ids.tolist())
                        decoded_out.append(decoded)
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_out, kinds[0]), pa.array(decoded_out, kinds[1])], names=names)

    names = [doc_id, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    id_type = docs.schema[doc_id].dataType.simpleString()
    kinds = ("string", "string") if digests else ("array<int>", "binary")
    schema = f"`{doc_id}` {id_type}, n_tokens long, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}"
    return docs.select(doc_id, text).mapInArrow(run, schema)
