"""Token counts of whole texts by a public library, lengths only, in Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenise import MAX_PIECE, Pieces, apart, blocks, by_size

#: Characters that one call of the library gets.
CALL_CHARS = 1 << 20


class Counter:
    """Counts of a vocabulary file: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            found = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in found.encode(texts, num_threads=1)]
            self.count_block: Callable[[list[str]], list[int]] = lambda texts: list(chain.from_iterable(map(self.lengths, by_size(texts, CALL_CHARS))))
            return
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        self.lengths = lambda texts: [len(x) for x in found.encode_batch_fast(texts, add_special_tokens=False)]
        if not self.lengths([" \n "])[0]:  # white space makes no token, so any space is a safe boundary
            self.pieces = Pieces(self._many)
            self.count_block = self._spaceless
        else:
            self.pieces = Pieces(lambda found: self._many([" " + x for x in found]))
            self.count_block = self._spaced

    def _many(self, texts: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.lengths, by_size(texts, CALL_CHARS))))

    def _spaceless(self, texts: list[str]) -> list[int]:
        cut = [x.replace("\n", " ").split(" ") for x in texts]
        wanted = set().union(*cut)
        long = [x for x in wanted if len(x) > MAX_PIECE]
        self.pieces.fill(wanted.difference(long))
        if not long:
            return [sum(map(self.pieces.__getitem__, x)) for x in cut]
        lengths = dict(zip(long, self._many(long), strict=True))
        return [sum(lengths[p] if p in lengths else self.pieces[p] for p in x) for x in cut]

    def _spaced(self, texts: list[str]) -> list[int]:
        cut = [x.split(" ") for x in texts]
        wanted = set().union(*(x[1:] for x in cut))
        self.pieces.fill({x for x in wanted if apart(x)})
        heads, out = self._many([x[0] for x in cut]), []
        for text, head, (_, *rest) in zip(texts, heads, cut, strict=True):
            try:
                out.append(head + sum(map(self.pieces.__getitem__, rest)))
            except KeyError:
                out.append(self.lengths([text])[0])
        return out


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit) of each row.

    No begin, end or added special tokens, no truncation, no padding; special strings inside a text
    as the library handles them by default. Null texts count as empty: zero tokens. Texts are cut at
    boundaries where the vocabulary's pattern lets no token cross; each row is counted on its own,
    so repeated rows and empty tables need no rule. Other columns are dropped. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = Counter(vocabulary)
        counter = _COUNTERS[vocabulary]
        for batch in batches:
            counts = list(chain.from_iterable(map(counter.count_block, blocks(batch, 2))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[doc_id, "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = docs.schema[doc_id].dataType.simpleString()
    kept = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id), F.octet_length(kept).cast("long").alias("n_bytes"), kept.alias("_text")).mapInArrow(run, f"`{doc_id}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
