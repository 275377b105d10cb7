"""Reading level of documents: a linear pairwise ranker, calibrated to bands by isotonic regression.

Features of a document are its words' shares (vocabulary of the labelled sample)
and measures of syntax and word form: words a sentence, clause marks, word
lengths, long words.  The ranker is fitted on pairs of labelled documents with
different bands, drawn anew from all of them at every step.  There is one ranker a
fold; their scores on the documents left out are calibrated together, and a
document's level is the mean of the levels that its scores by all rankers have.

Only the classifier is fitted on a bounded sample of labelled documents
(``MOST_LABELLED``); every document is scored by its whole text.  Texts are read as
tokens; what a token adds to the features is worked out once a task, and a batch of
documents is summed up by array operations.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_LABELLED, FOLDS, STEPS, DRAWN = 8_000, 5, 250, 6
PENALTY_WORDS, PENALTY_FORM, SEED = 3e-5, 3e-3, 11
LEAST_SHARE, LEAST_WORDS, LONG_RUN = 0.34, 3, 8
_REMEMBER = 100_000  # tokens a task keeps

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_TOKEN = re.compile(r"\n\s*\n|\S+")
_PLAIN = re.compile(r"[\"'“”«»(\[*_¡¿>•#-]*[^\W\d_]+(?:['’\-][^\W\d_]+)*[\"'“”»)\]*_]*[.,;:!?…]*")
_END = re.compile(r"[.!?…]$")
_HEX = re.compile(r"[0-9a-fA-F]{2}")
FORMS = ("per_sentence", "clause_marks", "word_length", "long_words", "very_long", "short_words", "spread")
_SAID, _PLAINLY, _WORDS, _LETTERS, _SQUARES, _LONG, _VERY_LONG, _SHORT, _MARKS, _ENDS, _KNOWN = range(11)


class Reader(dict):
    """Tokens by number, each with its row of measures and the numbers of its known words."""

    def __init__(self, words: dict[str, int], weights: np.ndarray) -> None:
        self.words, self.weights = words, weights
        self.rows: list[tuple] = []
        self.known: list[tuple[int, ...]] = []
        self._table = np.zeros((0, _KNOWN + 1 + weights.shape[1]))

    def __missing__(self, token: str) -> int:
        words = [w.lower() for w in _WORD.findall(token)]
        lengths = [len(w) for w in words]
        known = tuple(k for k in map(self.words.get, words) if k is not None)
        said = any(c.isalnum() for c in token)
        plain = bool(said and _PLAIN.fullmatch(token) and not _HEX.fullmatch(token))
        marks = token.count(",") + token.count(";") + token.count(":")
        self.rows.append((
            said, plain, len(words), sum(lengths), sum(x * x for x in lengths), sum(x >= 7 for x in lengths), sum(x >= 10 for x in lengths), sum(x <= 3 for x in lengths),
            marks, not token.strip() or bool(_END.search(token)), len(known), *(self.weights[list(known)].sum(0) if known else np.zeros(self.weights.shape[1])),
        ))
        self.known.append(known)
        self[token] = len(self.rows) - 1
        return len(self.rows) - 1

    def table(self) -> np.ndarray:
        if len(self._table) < len(self.rows):
            new = np.array(self.rows[len(self._table) :], dtype=float)
            self._table = np.concatenate([self._table, new])
        return self._table

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``tokens, ends, prose``: the tokens' numbers end to end, where each text's end, which of them are its prose.

        A text has prose if at least ``LEAST_WORDS`` of its tokens, and a third of
        all of them, are plain words in runs of two or more; bytes in hex are no
        words.  Then all of it counts.  Of a text with less, only runs of
        ``LONG_RUN`` plain words or more are prose.
        """
        if len(self) > _REMEMBER:
            self.clear()
            self.__init__(self.words, self.weights)
        tokens, ends = [], []
        for t in texts:
            if t:
                t = t if t.isascii() else unicodedata.normalize("NFC", t)
                tokens.extend(map(self.__getitem__, _TOKEN.findall(t)))
            ends.append(len(tokens))
        at, ends = np.array(tokens, dtype=np.int64), np.array(ends, dtype=np.int64)
        table = self.table()
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        said = np.nonzero(table[at, _SAID])[0] if len(at) else np.zeros(0, dtype=np.int64)
        plain, of = table[at[said], _PLAINLY] > 0, doc[said]
        begins = np.ones(len(said), dtype=bool)
        begins[1:] = (of[1:] != of[:-1]) | (plain[1:] != plain[:-1])
        run = np.cumsum(begins) - 1
        length = np.bincount(run)[run] * plain if len(run) else run
        count = lambda mask: np.bincount(of[mask], minlength=len(ends))
        kept = count(length > 1)
        whole = (kept >= LEAST_WORDS) & (kept >= LEAST_SHARE * count(length >= 0))
        prose = whole[doc]
        prose[said[(length >= LONG_RUN) & ~whole[of]]] = True
        return at, ends, prose

    def measures(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its number of prose words, its forms (each of the order of 1), the mean weights of its known words times 10."""
        at, ends, prose = self.read(texts)
        table, n_docs = self.table(), len(ends)
        doc = np.repeat(np.arange(n_docs), np.diff(ends, prepend=0))[prose]
        rows = table[at[prose]]
        total = np.stack([np.bincount(doc, rows[:, c], n_docs) for c in range(table.shape[1])], axis=1)
        words = total[:, _WORDS]
        # A sentence is a stretch between ends that holds a word.
        stretch = np.cumsum(rows[:, _ENDS]) - rows[:, _ENDS]
        worded = rows[:, _WORDS] > 0
        d, s = doc[worded], stretch[worded]
        fresh = np.ones(len(d), dtype=bool)
        fresh[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        sentences = np.maximum(np.bincount(d[fresh], minlength=n_docs), 1)
        n = np.maximum(words, 1)
        mean = total[:, _LETTERS] / n
        forms = np.stack([
            np.log(n / sentences), 10 * total[:, _MARKS] / n, mean / 5, 3 * total[:, _LONG] / n, 5 * total[:, _VERY_LONG] / n, 2 * total[:, _SHORT] / n,
            np.sqrt(np.maximum(total[:, _SQUARES] / n - mean**2, 0)) / 3,
        ], axis=1)
        return words, forms, 10 * total[:, _KNOWN + 1 :] / np.maximum(total[:, _KNOWN : _KNOWN + 1], 1)


def prose_of(texts: list[str | None]) -> list[list[str]]:
    """The words of each text's prose, lower case and composed; empty where there is none."""
    reader = Reader({}, np.zeros((0, 0)))
    at, ends, prose = reader.read(texts)
    words = [[w.lower() for w in _WORD.findall(t)] for t in reader]
    return [[w for t in at[a:b][prose[a:b]].tolist() for w in words[t]] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]


def prose_words(text: str | None) -> list[str]:
    """The words of one text's prose."""
    return prose_of([text])[0]


@dataclass
class Model:
    """The rankers' word weights (a column each), form weights (with their centre and scale), and the scores and levels of the calibration."""

    words: dict[str, int]
    weights: np.ndarray
    form: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    scores: np.ndarray
    levels: np.ndarray

    def reader(self) -> Reader:
        return Reader(self.words, self.weights)

    def rate(self, texts: list[str | None], reader: Reader) -> np.ndarray:
        """The level of each text, not a number where there is no prose."""
        words, forms, said = reader.measures(texts)
        score = said + ((forms - self.centre) / self.scale) @ self.form
        return np.where(words > 0, np.interp(score, self.scores, self.levels).mean(axis=1), np.nan)

    def score(self, text: str | None) -> float | None:
        level = float(self.rate([text], self.reader())[0])
        return None if np.isnan(level) else level

    @staticmethod
    def band(level):
        """The band that a level (1 to 4) is nearest to, the higher one half way."""
        return np.clip(np.floor(np.asarray(level) + 0.5), 1, 4).astype(int)


def _fit_ranker(rows, cols, vals, n_words: int, form: np.ndarray, bands: np.ndarray, seed: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss on the score differences of document pairs with different bands; Adam, with ``DRAWN`` new partners for each document at every step."""
    rnd = np.random.default_rng(seed)
    w = np.zeros(n_words + form.shape[1])
    n = len(bands)
    if n == 0 or bands.min() == bands.max():
        return w[:n_words], w[n_words:]
    by_word = np.argsort(cols, kind="stable")
    word_rows, word_vals = rows[by_word], vals[by_word]
    starts = np.searchsorted(cols[by_word], np.arange(n_words))
    row_starts = np.searchsorted(rows, np.arange(n))
    sums = lambda x, at: np.add.reduceat(np.append(x, 0.0), at)
    empty_row = np.bincount(rows, minlength=n) == 0
    penalty = np.concatenate([np.full(n_words, PENALTY_WORDS), np.full(form.shape[1], PENALTY_FORM)])
    m, v = np.zeros_like(w), np.zeros_like(w)
    one = np.tile(np.arange(n), DRAWN)
    for step in range(1, steps + 1):
        two = rnd.integers(0, n, len(one))
        ok = bands[one] != bands[two]
        i, j = one[ok], two[ok]
        up = bands[i] > bands[j]
        i, j = np.where(up, i, j), np.where(up, j, i)
        s = np.where(empty_row, 0.0, sums(vals * w[cols], row_starts)) + form @ w[n_words:]
        g = -1 / (1 + np.exp(np.clip(s[i] - s[j], -30, 30))) * np.minimum(bands[i] - bands[j], 2.0)
        c = (np.bincount(i, g, n) - np.bincount(j, g, n)) / max(len(i), 1)
        grad = np.concatenate([sums(word_vals * c[word_rows], starts), form.T @ c]) + penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        rate = 0.08 * (1 - step / (steps + 1)) ** 0.5
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:n_words], w[n_words:]


def isotonic(score: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators and equal scores: the block starts (scores) and the increasing block means."""
    order = np.lexsort((level, score))
    blocks: list[list[float]] = []
    for s, y in zip(score[order], level[order]):
        blocks.append([s, y, 1.0])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][0] == blocks[-1][0]):
            _, y2, n2 = blocks.pop()
            b = blocks[-1]
            b[1], b[2] = (b[1] * b[2] + y2 * n2) / (b[2] + n2), b[2] + n2
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def fit(texts: list[str], bands: list[float], seed: int = SEED) -> Model:
    """A model from labelled texts; texts without prose are left out.  Without labels every text is band 2."""
    plain = Reader({}, np.zeros((0, 0)))
    words = plain.measures(texts)[0] if texts else np.zeros(0)
    kept = np.nonzero(words > 0)[0]
    if not len(kept):
        n = len(FORMS)
        return Model({}, np.zeros((0, 1)), np.zeros((n, 1)), np.zeros(n), np.ones(n), np.zeros(1), np.full(1, 2.0))
    texts, y = [texts[i] for i in kept], np.array(bands, dtype=float)[kept]
    counted = [Counter(ws) for ws in prose_of(texts)]
    seen = Counter(w for c in counted for w in c)
    vocab = {w: k for k, w in enumerate(sorted(w for w, c in seen.items() if c > 1))}
    rows, cols, vals = [], [], []
    for r, c in enumerate(counted):
        at = [(vocab[w], k) for w, k in c.items() if w in vocab]
        n = max(1, sum(k for _, k in at))
        rows += [r] * len(at)
        cols += [w for w, _ in at]
        vals += [10 * k / n for _, k in at]
    rows, cols, vals = np.array(rows, dtype=int), np.array(cols, dtype=int), np.array(vals, dtype=float)
    _, raw, _ = plain.measures(texts)
    centre, scale = raw.mean(0), np.maximum(raw.std(0), 0.05)
    form = (raw - centre) / scale
    # Copies of a text stay in one fold.
    fold = np.array([zlib.crc32(" ".join(list(c)[:40]).encode()) % FOLDS for c in counted])
    out, ws, fs = np.zeros(len(y)), [], []
    for k in range(FOLDS):
        train = fold != k
        at = np.cumsum(train) - 1
        mine = train[rows]
        w, f = _fit_ranker(at[rows[mine]], cols[mine], vals[mine], len(vocab), form[train], y[train], seed + k)
        s = np.bincount(rows, vals * w[cols], len(y)) + form @ f
        out[~train] = s[~train]
        ws.append(w)
        fs.append(f)
    starts, level = isotonic(out, y)
    block = np.searchsorted(starts, out, side="right") - 1
    centres = np.bincount(block, out) / np.bincount(block)
    return Model(vocab, np.stack(ws, axis=1), np.stack(fs, axis=1), centre, scale, centres, level)


def fit_from_tables(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fit on the labelled documents, at most ``most`` of them (those with the smallest hash of their id).

    Several ratings of a document count as their mean.
    """
    rated = labels.where("doc_id is not null and reading_band is not null").groupBy("doc_id").agg(F.avg("reading_band").alias("band"))
    few = rated.orderBy(F.xxhash64("doc_id")).limit(most)
    got = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").orderBy("doc_id").toPandas()  # bounded by ``most``
    return fit(got["text"].tolist(), got["band"].tolist())


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, reading_band`` of every document with prose; the score is its level, from 1 to 4."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = m.reader()
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            level = m.rate(texts, reader)
            has = ~np.isnan(level)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(has)), pa.array(level[has]), pa.array(m.band(level[has]).astype(np.int32))], ["doc_id", "score", "reading_band"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, reading_band int")
