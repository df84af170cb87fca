"""SimHash near-duplicate groups with pigeonring candidate pruning.

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Two
fingerprints are linked if they differ in at most ``max_diff`` bits; groups are the connected
components. Copies share a fingerprint, so all work after the scan is on distinct fingerprints.

Candidates. The 64 bits form a ring of ``segments`` equal segments. If a pair differs in at most t
bits, some segment starts a chain in which, for every length l, the first l segments differ in at
most l*t/segments bits. With 16 segments and t = 4 the first three segments of that chain are equal
and the next four differ in at most one bit, so one half of those four is equal too: 20 equal bits
at one of 16 starts and 2 halves are the join key. The remaining budgets of the chain are tested
inside the join, before the full Hamming check, so only linked pairs leave it.

Dense buckets. A key held by more than ``dense`` fingerprints is not joined with itself. Its
fingerprints are dealt into blocks of bounded size and each pair of blocks yields a spanning forest of
its links: connectivity is kept in full, while at most one edge a fingerprint is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PRE, cut, join_groups, pick, release
from .components import connected_components

SHINGLE_WORDS, MAX_DIFF, SEGMENTS = 4, 4, 16
#: Keys with more fingerprints than DENSE go through blocks of at most about BLOCK fingerprints.
DENSE, BLOCK = 64, 4096


def fingerprint(text: str | None, k: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text; 0 for a text without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words)
    if n <= k:
        hashes = np.array([h(joined, seed)], dtype=np.uint64)
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        end = np.cumsum(size + 1) - 1
        a, b = (end - size)[: n - k + 1].tolist(), end[k - 1 :].tolist()
        hashes = np.fromiter((h(joined[i:j], seed) for i, j in zip(a, b)), dtype=np.uint64, count=n - k + 1)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduce(bits, axis=0, dtype=np.int32) * 2 > len(hashes)
    return int.from_bytes(np.packbits(ones).tobytes(), "big")


def _fingerprints(k: int, seed: int):
    @F.pandas_udf("long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t, k, seed) for t in s], dtype=np.uint64).view(np.int64))

    return udf


def _ring(fp: Column, start: int, width: int) -> Column:
    """``fp`` turned so that segment ``start`` holds the highest bits."""
    s = start * width
    return fp if s == 0 else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, 64 - s))


def _top(bits: int) -> int:
    """Mask of the highest bits, as a signed long."""
    v = ((1 << bits) - 1) << (64 - bits)
    return v - (1 << 64) if v >= 1 << 63 else v


def chain_plan(max_diff: int, segments: int) -> tuple[int, list[int]]:
    """Segments that must be equal at the head of a chain, and the masks of the key variants.

    The head is followed by the longest run whose budget is below two differences; one of its halves is
    free of differences.
    """
    if 64 % segments:
        raise ValueError("segments must divide 64")
    width = 64 // segments
    head = max([n for n in range(1, segments + 1) if n * max_diff // segments == 0], default=0)
    run = max([n for n in range(1, segments + 1) if n * max_diff // segments <= 1], default=0)
    if head == 0:
        raise ValueError("more segments than max_diff are needed")
    if run - head < 2:
        return head, [_top(head * width)]
    mid = head + (run - head) // 2
    unsigned = lambda a, b: _top(b * width) & ~_top(a * width)
    return head, [_top(mid * width), _top(head * width) | unsigned(mid, run)]


def _keyed(fps: DataFrame, max_diff: int, segments: int) -> DataFrame:
    """(key, fp, turned): one row for each start and key variant of a distinct fingerprint."""
    width, (_, masks) = 64 // segments, chain_plan(max_diff, segments)
    rows = [
        F.struct(F.xxhash64(_ring(F.col("fp"), i, width).bitwiseAND(F.lit(m)), F.lit(i * len(masks) + j)).alias("key"), _ring(F.col("fp"), i, width).alias("turned"))
        for i in range(segments)
        for j, m in enumerate(masks)
    ]
    return fps.select("fp", F.explode(F.array(*rows)).alias("e")).select("e.key", "fp", "e.turned")


def _within(a: Column, b: Column, max_diff: int, segments: int) -> Column:
    """Chain budgets for every length, the last being the full Hamming check."""
    width, x = 64 // segments, a.bitwiseXOR(b)
    lengths = {n * max_diff // segments: n for n in range(1, segments + 1)}  # the longest chain of each budget
    ok = F.lit(True)
    for budget, n in sorted(lengths.items()):
        ok = ok & (F.bit_count(x.bitwiseAND(F.lit(_top(n * width)))) <= budget)
    return ok


def forest(fps: np.ndarray, max_diff: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``fps`` (int64), by breadth-first search."""
    left, out = np.unique(fps).view(np.uint64), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_diff
            if near.any():
                found = left[near]
                left = left[~near]
                out += [(int(x.view(np.int64)), int(y)) for y in found.view(np.int64)]
                queue += list(found)
    return out


def _dense_edges(keyed: DataFrame, hot: DataFrame, max_diff: int, block: int) -> DataFrame:
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(pdf["fp"].to_numpy(np.int64), max_diff), columns=["src", "dst"], dtype="int64")

    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    dealt = (
        keyed.hint("merge").join(hot, "key")
        .select("key", "fp", blocks.alias("blocks"))
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    return dealt.groupBy("key", "i", "j").applyInPandas(links, "src long, dst long")


def fingerprint_groups(fps: DataFrame, max_diff: int = MAX_DIFF, segments: int = SEGMENTS, dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """(fp, component) for all linked fingerprints of the distinct ``fps``; component is the smallest of them.

    Joins of the keyed rows are never broadcast: Spark takes an exploded table for as small as the table before, so
    from some size on it would build one of 32 rows a fingerprint in the driver's memory.
    """
    keyed = _keyed(fps, max_diff, segments)
    hot = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > dense))
    cool = keyed.join(hot.select("key"), "key", "left_anti")
    a, b = cool.select("key", F.col("fp").alias("src"), F.col("turned").alias("x")), cool.select("key", F.col("fp").alias("dst"), F.col("turned").alias("y"))
    pairs = a.join(b.hint("merge"), (a["key"] == b["key"]) & (a["src"] < b["dst"]) & _within(a["x"], b["y"], max_diff, segments)).select("src", "dst")
    edges = pairs.unionByName(_dense_edges(keyed, hot, max_diff, block))
    return connected_components(edges).withColumnRenamed("node", "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, max_diff: int = MAX_DIFF, segments: int = SEGMENTS, seed: int = 42, dense: int = DENSE, block: int = BLOCK, text_key: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; with ``text_key`` also the hash of its text.

    Fingerprints are 16 lower-case hexadecimal digits; component_id is the smallest id reachable.
    A null or blank text has fingerprint zero and is linked like any other. Repeated rows are returned
    as often as they occur. A null id takes part in its group but never names it (a group of null ids
    has a null component_id). Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    rows = pick(docs, [(id_col, "long", "doc_id"), (text_col, "string", "text")])
    key = ["text_key"] if text_key else []
    rows = cut(rows.select("doc_id", _fingerprints(k, seed)("text").alias("fp"), *[F.xxhash64("text").alias(c) for c in key]))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    groups = fingerprint_groups(least.select("fp"), max_diff, segments, dense, block)
    named = least.join(groups, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component"), "least")
    named = cut(named)
    release(docs.sparkSession)
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.select("fp", "n", "component").join(names, "component").select("fp", "n", "component_id")
    return join_groups(rows, final, "fp", "n", ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *key)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose group has a row of a smaller id.

    All columns are kept as they are. Rows with a null id stay (no order among them is defined), and
    so do repeated rows of the smallest id.
    """
    groups = simhash_groups(docs, id_col, text_col, text_key=True, **how)
    gone = groups.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(f"{PRE}id"), F.col("text_key").alias(f"{PRE}key")).distinct()
    same_text = F.xxhash64(docs[text_col].cast("string")) == gone[f"{PRE}key"]  # equal texts have one fingerprint
    return docs.join(gone, (docs[id_col].cast("long") == gone[f"{PRE}id"]) & same_text, "left_anti")
