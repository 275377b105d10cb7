"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

One pass counts the words of all documents (combined per task, then summed), the
most frequent ``LEXICON_WORDS`` are compiled with their ids into the transducer of
:mod:`.lexicon`, and a second pass encodes every text: a word is looked up once a
task, first in the transducer, else merged exactly; null and empty texts have no
ids.  The lexicon's size is bounded by its parameter, whatever the corpus.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import mounted_path, scratch_path
from . import lexicon

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SETTING = "spark.frameweave.vocabulary"  # where the vocabulary file lies on every machine, if elsewhere
LEXICON_WORDS = 50_000
# Fixed value: how the vocabulary's makers split texts into words before merging.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_WORD = 256  # words of more characters aren't counted or remembered, only merged
_REMEMBER = 400_000


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def _split():
    import regex

    return regex.compile(WORD_PATTERN).findall


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging of one word, lowest rank first, leftmost first; n log n in its length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # end of the piece that starts at i
    prev, alive = list(range(-1, n - 1)), [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop or not alive[j]:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            r = ranks.get(word[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = prev[i]
        if p >= 0:
            r = ranks.get(word[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Words(dict):
    """Ids of the words met so far in a task; a new word is looked up, else merged."""

    def __init__(self, lex: lexicon.Lexicon, ranks: dict[bytes, int]) -> None:
        self.lex, self.ranks = lex, ranks

    def __missing__(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        if len(word) > _LONG_WORD:
            return merge(raw, self.ranks)
        ids = self.lex.lookup(raw)
        if ids is None:
            ids = merge(raw, self.ranks)
        if len(self) >= _REMEMBER:
            self.clear()
        self[word] = ids
        return ids


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all texts (words of up to 256 characters)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _split(), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(split(t))
            if len(seen) > _REMEMBER:
                yield flush()
        yield flush()

    counted = texts.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(count, "word string, n bigint")
    return counted.where(F.length("word") <= _LONG_WORD).groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(spark: SparkSession) -> str:
    """The path of the vocabulary that the session names, else ``VOCABULARY``."""
    return spark.conf.get(SETTING, VOCABULARY)


def build_lexicon(spark: SparkSession, texts: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS):
    """The lexicon of a corpus as something tasks can open: a path in the shared folder, or its bytes.

    The ``words`` most frequent words come to the driver: a bounded number of
    words of bounded length.
    """
    ranks = _ranks(vocabulary)
    top = word_counts(texts, text).orderBy(F.desc("n"), "word").limit(words).collect()
    data = lexicon.build({w: merge(w, ranks) for w in (r["word"].encode() for r in top)})
    path = mounted_path(spark, scratch_path(spark, "lexicon"))
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
        return path
    return spark.sparkContext.broadcast(data)  # a few MB, bounded by ``words``


@lru_cache(maxsize=2)
def _opened(path: str) -> lexicon.Lexicon:
    return lexicon.Lexicon.open(path)


def _tokens(batches: Iterator[pa.RecordBatch], lex, vocabulary: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch (key columns, then the text) with its texts' ids, end to end, and where each text's begin."""
    opened = _opened(lex) if isinstance(lex, str) else lexicon.Lexicon(lex.value)
    words, split = _Words(opened, _ranks(vocabulary)), _split()
    for batch in batches:
        flat, offsets = [], [0]
        for t in batch.column(batch.num_columns - 1).to_pylist():
            if t:
                flat.extend(chain.from_iterable(map(words.__getitem__, split(t))))
            offsets.append(len(flat))
        yield batch, np.array(flat, dtype=np.int32), np.array(offsets, dtype=np.int32)


def encode(texts: DataFrame, keys: list[str], text: str, lex, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``ids``; the empty list for an empty or null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, offsets in _tokens(batches, lex, vocabulary):
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*keys, "ids"])

    slim = texts.select(*keys, F.col(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{schema}, ids array<int>")


def count_tokens(texts: DataFrame, keys: list[str], text: str, lex, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` and ``n_tokens``; 0 for an empty or null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, offsets in _tokens(batches, lex, vocabulary):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets).astype("int64"))], [*keys, "n_tokens"])

    slim = texts.select(*keys, F.col(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{schema}, n_tokens bigint")
