"""Benchmark decontamination: n-gram seeds, verified by Smith-Waterman alignment.

The benchmark is a stated query set: its words are indexed in blocks of bounded size that travel to
the scan of the documents, so no document text is ever shuffled. Every benchmark n-gram that a document
holds is a seed, however many documents hold it. The window of words round the diagonals of the seeds
is aligned with the item, unless an upper bound of the score, by the words alone, is below the threshold
already: runs of stop words end there, and no copy does. The score is the local alignment score over that
of a perfect copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

N, THRESHOLD = 3, 0.5
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Benchmark words indexed at once; keys of three words then fit 63 bits.
BLOCK_WORDS = 1_000_000

HITS = "array<struct<item_id:bigint,score:double,start_word:int,end_word:int,seeds:int>>"
#: Letters of scripts without spaces (CJK, Kana, Thai, Lao, Khmer, Myanmar) are words of their own.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"(?=[^\W_])[{_ALONE}]|[^\W_{_ALONE}]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Index:
    """Word ids of a block of items, and where each n-gram of the items stands."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int = N):
        self.n, self.ids, self.items = n, {}, []
        for item, ws in items:
            self.items.append((item, np.array([self.ids.setdefault(w, len(self.ids)) for w in ws], dtype=np.int64)))
        self.short: dict[tuple[int, ...], list[int]] = {}  # items of fewer words than an n-gram match as a whole
        for item, x in self.items:
            if len(x) < n:
                self.short.setdefault(tuple(x.tolist()), []).append(item)
        grams, of, at = [], [], []
        for i, (_, x) in enumerate(self.items):
            g = self.keys(x)
            grams.append(g)
            of.append(np.full(len(g), i))
            at.append(np.arange(len(g)))
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        grams, self.of, self.at = cat(grams), cat(of), cat(at)
        order = np.argsort(grams, kind="stable")
        self.grams, self.of, self.at = grams[order], self.of[order], self.at[order]
        self.distinct, self.first = np.unique(self.grams, return_index=True)
        self.mark = np.zeros(len(self.ids) + 1, dtype=np.int64)  # the last is for words not of the benchmark

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Key of each n-gram of word ids; -1 where a word is not of the benchmark."""
        if len(x) < self.n:
            return np.zeros(0, dtype=np.int64)
        key, ok = np.zeros(len(x) - self.n + 1, dtype=np.int64), np.ones(len(x) - self.n + 1, dtype=bool)
        for j in range(self.n):
            part = x[j : len(x) - self.n + 1 + j]
            key, ok = key * np.int64(len(self.ids) + 1) + part, ok & (part >= 0)
        return np.where(ok, key, -1)

    def encode(self, text: str | None) -> np.ndarray:
        get = self.ids.get
        return np.array([get(w, -1) for w in words(text)], dtype=np.int64)

    def found(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x, positions in ``distinct``) of the benchmark n-grams of a text."""
        key = self.keys(x)
        at = np.flatnonzero(key >= 0)
        if not len(at) or not len(self.distinct):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        d = np.searchsorted(self.distinct, key[at])
        hit = (d < len(self.distinct)) & (self.distinct[np.minimum(d, len(self.distinct) - 1)] == key[at])
        return at[hit], d[hit]

    def most(self, item: np.ndarray, text: np.ndarray) -> int:
        """Upper bound of the score of ``align``: a word of a span is a match if the item has it, else an error."""
        self.mark[item] = 1
        sums = np.concatenate(([0], np.cumsum(np.where(self.mark[text] > 0, MATCH, max(MISMATCH, GAP)))))
        self.mark[item] = 0
        return int((sums - np.minimum.accumulate(sums)).max())


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman of two id arrays: (best score, start, end) of the best span of ``text``."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        prev, ramp = np.zeros(len(b) + 1, dtype=np.int64), -GAP * np.arange(len(b) + 1)
        top, end = 0, 0
        for x in a:
            row = np.maximum(prev + GAP, 0)
            row[1:] = np.maximum(row[1:], prev[:-1] + np.where(b == x, MATCH, MISMATCH))
            row = np.maximum.accumulate(row + ramp) - ramp
            j = int(row.argmax())
            if row[j] > top:
                top, end = int(row[j]), j
            prev = row
        return top, end

    score, end = best(item, text)
    if not score:
        return 0, 0, 0
    _, back = best(item[::-1], text[:end][::-1])
    return score, end - back, end


def search(index: Index, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, float, int, int, int]]:
    """(item, score, start word, end word, seeds) of each item that a text copies, its best span."""
    x = index.encode(text)
    out: dict[int, tuple[int, float, int, int, int]] = {}
    for size in {len(k) for k in index.short}:
        for i, got in enumerate(zip(*[x[j:].tolist() for j in range(size)])):
            for item in index.short.get(got, ()):
                out.setdefault(item, (item, 1.0, i, i + size, 1))
    at, d = index.found(x)
    if not len(at):
        return sorted(out.values())
    last = np.append(index.first[1:], len(index.grams))
    count = last[d] - index.first[d]
    post = np.repeat(index.first[d], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    of, diag = index.of[post], np.repeat(at, count) - index.at[post]
    order = np.lexsort((diag, of))
    of, diag = of[order], diag[order]
    first = 0
    for k in range(1, len(of) + 1):
        item, y = index.items[of[first]]
        slack = len(y) // 3 + 2
        if k < len(of) and of[k] == of[first] and diag[k] - diag[k - 1] <= slack and diag[k] - diag[first] <= 4 * len(y):
            continue
        lo, hi = max(0, int(diag[first]) - slack), min(len(x), int(diag[k - 1]) + len(y) + slack)
        if index.most(y, x[lo:hi]) / (MATCH * len(y)) >= threshold:
            score, a, b = align(y, x[lo:hi])
            share = score / (MATCH * len(y))
            if share >= threshold and share > out.get(item, (0, 0.0))[1]:
                out[item] = (item, share, lo + a, lo + b, k - first)
        first = k
    return sorted(out.values())


def blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Distinct (item, words) in blocks of bounded size."""
    rows = pick(benchmark, [(id_col, "long", "item_id"), (text_col, "string", "text")]).where("item_id is not null").distinct().orderBy("item_id", "text")
    part, size = [], 0
    for r in rows.toLocalIterator():
        ws = words(r["text"])
        if ws:
            part.append((r["item_id"], ws))
            size += len(ws)
        if size >= block_words:
            yield part
            part, size = [], 0
    if part:
        yield part


def indexes(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", n: int = N, block_words: int = BLOCK_WORDS) -> list[Index]:
    return [Index(items, n) for items in blocks(benchmark, item_col, item_text, n, block_words)]


def _searcher(found: Iterable[Index], threshold: float):
    found = list(found)

    @F.pandas_udf(HITS)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "score", "start_word", "end_word", "seeds")
        for s in batches:
            yield pd.Series([[dict(zip(names, h)) for index in found for h in search(index, t, threshold)] for t in s])

    return udf


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, seeds) for each document and benchmark item it copies.

    Words are runs of letters and digits of the lower-cased text, counted from 0; the span is half open.
    Letters of scripts without spaces are words of their own. Items of fewer words than a seed match only as
    a whole, word for word. Null and empty texts copy nothing; long texts are read whole; of equal scores the
    first span counts. Repeated documents are reported once each, items of one id and
    several texts once for each text. Extra columns are not read; empty tables give no rows.
    """
    find = _searcher(indexes(benchmark, **how), threshold)
    rows = pick(docs, [(id_col, "long", "doc_id"), (text_col, "string", "text")])
    return rows.select("doc_id", F.explode(find("text")).alias("h")).select("doc_id", "h.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """``docs`` without the rows that copy a benchmark item; the columns are kept as they are."""
    find = _searcher(indexes(benchmark, **how), threshold)
    return docs.where(F.size(find(docs[text_col])) == 0)
