"""Packing documents into fixed-length token sequences by cutting-stock column generation.

Every document is its token ids followed by id 0, cut into full pieces and one remainder. Only the
histogram of piece lengths (at most ``capacity`` / ``unit`` classes, whatever the corpus size) comes to
the driver. There a linear program over patterns of lengths that fit a sequence is solved by column
generation: a knapsack dynamic program prices new patterns until none improves, the pattern counts are
rounded down, and the few pieces left over are packed by best fit. Pieces are ranked within their class
in bounded, salted windows, and the rank alone tells each piece its sequence.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import cut, pick

TOKENIZER = "byte_bpe_50k"
END_OF_TEXT = "<|endoftext|>"
#: Rows that one ranking window holds on average, and the most windows of a class.
RANK_ROWS, MAX_SALTS = 2000, 4096


@lru_cache(maxsize=4)
def _encoder(name: str, folder: str | None):
    """text -> ids of the tokenizer file ``name``.json; its rank file, when there, gives the same ids faster."""
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = (lambda f: os.path.join(folder, f)) if folder else public_tokenizers.path
    with open(path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def encode(text: str) -> list[int]:
        if END_OF_TEXT not in text:
            return fast.encode_ordinary(text)
        if not slow:
            slow.append(Tokenizer.from_file(path(f"{name}.json")))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str = TOKENIZER, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: full pieces of ``capacity`` ids, then the remainder.

    A null text counts as empty and gives the one id 0. ``with_ids`` adds the ids as an int array.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer, folder)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] * with_ids))}
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*(encode(text) if text else ()), 0], dtype="<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    out["doc_id"].append(doc)
                    out["start"].append(at)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    out["doc_tokens"].append(len(ids))
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    rows = pick(docs, [(id_col, "long", "doc_id"), (text_col, "string", "text")])
    return rows.mapInPandas(run, PIECES + (", ids array<int>" if with_ids else ""))


def price(value: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """Best unbounded knapsack of ``size`` units; value[s] is the worth of an item of s units."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    for c in range(1, size + 1):
        gain = value[1 : c + 1] + best[c - 1 :: -1]
        s = int(gain.argmax())
        best[c], took[c] = (gain[s], s + 1) if gain[s] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern: dict[int, int] = {}
    c = size
    while c > 0:
        if took[c]:
            pattern[int(took[c])] = pattern.get(int(took[c]), 0) + 1
        c -= int(took[c]) or 1
    return float(best[size]), pattern


def cutting_stock(demand: dict[int, int], size: int, gap: float = 1e-4, max_columns: int = 6000) -> list[tuple[dict[int, int], int]]:
    """[(pattern, how often)] that use exactly the ``demand`` of items of 1..size units.

    The linear program is solved by the revised simplex method to within ``gap`` of its bound (value of
    the duals over the best pattern's worth), or as far as ``max_columns`` go.
    """
    items = sorted(s for s, n in demand.items() if n > 0)
    if not items:
        return []
    m, row = len(items), {s: i for i, s in enumerate(items)}
    need = np.array([demand[s] for s in items], dtype=float)
    columns = [{s: size // s} for s in items]
    inverse = np.diag([1.0 / (size // s) for s in items])
    x = inverse @ need
    for _ in range(max_columns):
        duals = inverse.sum(axis=0)
        value = np.full(size + 1, -1.0)
        value[items] = duals
        worth, pattern = price(value, size)
        if worth <= 1 + gap:
            break
        a = np.zeros(m)
        for s, n in pattern.items():
            a[row[s]] = n
        step = inverse @ a
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / step[up]
        out = int(ratio.argmin())
        t = ratio[out]
        x -= t * step
        x[out] = t
        np.maximum(x, 0, out=x)
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        columns[out] = pattern
    plan: dict[tuple, int] = {}
    left = dict(zip(items, need.astype(np.int64).tolist()))
    for pattern, n in sorted(zip(columns, np.floor(x + 1e-7).astype(np.int64).tolist()), key=lambda p: -p[1]):
        n = min([n, *(left[s] // k for s, k in pattern.items())])
        if n > 0:
            key = tuple(sorted(pattern.items()))
            plan[key] = plan.get(key, 0) + n
            for s, k in pattern.items():
                left[s] -= n * k
    open_bins: list[list] = []  # of the rest, best fit in falling size
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            fit = min((b for b in open_bins if b[0] >= s), key=lambda b: b[0], default=None)
            if fit is None:
                open_bins.append(fit := [size, {}])
            fit[0] -= s
            fit[1][s] = fit[1].get(s, 0) + 1
    for _, pattern in open_bins:
        key = tuple(sorted(pattern.items()))
        plan[key] = plan.get(key, 0) + 1
    return [(dict(k), n) for k, n in plan.items()]


def _ranges(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """class -> (first rank, items a sequence, first sequence) of the runs of ranks that patterns take."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, n in plan:
        for s, k in pattern.items():
            runs.setdefault(s, []).append((taken.get(s, 0), k, base))
            taken[s] = taken.get(s, 0) + n * k
        base += n
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for s, r in runs.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, unit: int = 4, tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """Pieces of all documents with the sequence and the place in it: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    Sequence ids run from 0 without gaps; offsets fill each sequence from 0 without gaps. Every id of a
    document, its closing 0 included, lies in one piece. Lengths are counted in steps of ``unit`` ids when
    patterns are made, so a pattern wastes at most unit - 1 ids a piece. Repeated rows and null ids are
    documents of their own; extra columns are not read; no rows give no rows.
    """
    classes = capacity // unit
    rows = cut(pieces(docs, id_col, text_col, capacity, tokenizer, folder).withColumn("class", F.ceil(F.col("length") / unit).cast("int")))
    demand = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}
    ranges = _ranges(cutting_stock(demand, classes))
    salts = max(1, min(MAX_SALTS, -(-sum(demand.values()) // RANK_ROWS)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy("class", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("class").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
        .select("class", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    local = F.row_number().over(W.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(before, ["class", "salt"]).withColumn("rank", F.col("before") + F.col("local"))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())]))
    def place(cls: pd.Series, rank: pd.Series) -> pd.DataFrame:
        c, r = cls.to_numpy(np.int64), rank.to_numpy(np.int64)
        seq, slot = np.zeros(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        for s in np.unique(c):
            at = c == s
            first, each, base = ranges[int(s)]
            p = np.searchsorted(first, r[at], side="right") - 1
            i = r[at] - first[p]
            seq[at], slot[at] = base[p] + i // each[p], i % each[p]
        return pd.DataFrame({"sequence_id": seq, "slot": slot})

    placed = ranked.withColumn("at", place("class", "rank")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "at.sequence_id", "at.slot")
    before = W.partitionBy("sequence_id").orderBy(F.desc("class"), "slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("class", "slot")
