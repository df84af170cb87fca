"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods.

Each language has a smoothed distribution over hashed letter trigrams. A document is a mixture of
languages; EM estimates its proportions, and the set of languages is the one with the highest
log-likelihood less half a log(n) for each further language. The prediction is the largest proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

BITS = 14
#: At most about so many rows of a language, chosen by a hash, train its distribution.
TRAIN_ROWS = 4000
#: Characters that one pass of the vectorised code takes at once (a longer text is a pass of its own).
PASS_CHARS = 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams, first trigram of each text and the end) of texts; all but letters is white space."""
    low = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
    code = np.where(_letters()[code], code, 32).astype(np.uint32)
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    if len(code) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(low) + 1, dtype=np.int64)
    h = code[:-2] * np.uint32(0x9E3779B1) ^ (code[1:-1] * np.uint32(0x85EBCA77)) ^ (code[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h = ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int64)
    inside = doc[:-2] == doc[2:]
    return h[inside], np.searchsorted(doc[:-2][inside], np.arange(len(low) + 1))


def _passes(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    at, part, chars = [], [], 0
    for i, t in enumerate(texts):
        if t:
            at.append(i)
            part.append(t)
            chars += len(t)
        if chars >= PASS_CHARS:
            yield at, part
            at, part, chars = [], [], 0
    if part:
        yield at, part


def counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, distinct trigrams, how often) for the texts that have a letter."""
    for at, part in _passes(texts):
        h, first = _grams(part)
        for i, a, b in zip(at, first[:-1], first[1:]):
            if b > a:
                n = np.bincount(h[a:b], minlength=1 << BITS)
                grams = np.flatnonzero(n)
                yield i, grams, n[grams].astype(float)


def mixture(p: np.ndarray, n: np.ndarray, steps: int = 40, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """EM proportions of the columns of ``p`` (grams x languages), and the log-likelihood of counts ``n``."""
    w, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
    for _ in range(steps):
        new = w * ((n / (p @ w)) @ p) / total
        done = np.abs(new - w).max() < tol
        w = new
        if done:
            break
    return w, float(n @ np.log(p @ w))


def infer(p: np.ndarray, n: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Proportions of all languages, zero outside the selected set."""
    w, _ = mixture(p, n)
    order = np.argsort(-w, kind="stable")
    best, out = -np.inf, np.zeros(len(w))
    for k in range(1, len(w) + 1):
        at = order[:k]
        part, fit = mixture(p[:, at], n) if k > 1 else (np.ones(1), float(n @ np.log(p[:, at[0]])))
        fit -= 0.5 * penalty * (k - 1) * np.log(n.sum())
        if fit <= best:
            break
        best, out = fit, np.zeros(len(w))
        out[at] = part
    return out


def is_held_out(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text leaves no remainder; a null id is held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their distributions (2**BITS x languages) from rows of (doc_id, text, lang).

    A language trains on about ``train_rows`` whole texts chosen by a hash of the id, or on all its texts
    if it has fewer. Counting is distributed; the driver gets at most 2**BITS sums a language.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1 << BITS, 0))
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, train_rows / n) * (1 << 20)))]), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].tolist()
            for i, grams, n in counts(batch["text"].tolist()):
                sums.setdefault(langs[i], np.zeros(1 << BITS))[grams] += n
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "gram": at.astype(np.int32), "n": n[at].astype(np.int64)})

    got = sample.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.full((1 << BITS, len(langs)), 0.5)
    at = {x: i for i, x in enumerate(langs)}
    n[got["gram"].to_numpy(), [at[x] for x in got["lang"].to_pylist()]] += got["n"].to_numpy()
    return langs, n / n.sum(axis=0)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, penalty: float = 1.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture (language:share, by falling share) for every row.

    Trained on the rows that are not held out and have a language; predicted from the whole text alone.
    ``und`` with score 0 for a null text, one without a letter, or when there is nothing to learn from.
    Ties go to the language first in alphabetical order. Repeated rows and null ids are rows like any
    other; extra columns are not read; no rows give no rows.
    """
    rows = pick(docs, [(id_col, "long", "doc_id"), (text_col, "string", "text"), (lang_col, "string", "lang")])
    rows = rows.withColumn("held_out", is_held_out(F.col("doc_id")))
    langs, p = train(rows.where(~F.col("held_out")), train_rows)

    @F.pandas_udf("lang_pred string, score double, mixture string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = [("und", 0.0, "")] * len(s)
            for i, grams, n in counts(s.tolist()) if langs else ():
                w = infer(p[grams], n, penalty)
                order = [int(j) for j in np.argsort(-w, kind="stable") if w[j] > 0]
                out[i] = (langs[order[0]], float(min(1.0, w[order[0]])), " ".join(f"{langs[j]}:{w[j]:.3f}" for j in order))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "mixture"])

    return rows.select("doc_id", "held_out", predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.mixture")
