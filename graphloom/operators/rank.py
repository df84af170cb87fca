"""Vector top-k, rank fusion and the union of vector and text hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import similarity as S

#: Constant of rank fusion, and the score of a text hit (fixed values).
RRF_K, TEXT_SCORE = 60, 0.5


def cosine_top(items: DataFrame, query: list[float], k: int = 10, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the ``k`` items nearest to the query; vectors of no length or another dimension are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = items.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), F.round(S.cosine(F.col(vector_col), q), 4).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def substring_hits(items: DataFrame, query: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, content) of the items whose text holds the query in any case."""
    return items.where(F.lower(text_col).contains(query.lower())).select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))


def fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, score): reciprocal rank fusion of (id, rank) lists, ranks from 0."""
    out = None
    for one in lists:
        part = one.select("id", (F.lit(1.0) / (F.lit(k) + F.col("rank") + 1)).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.round(F.sum("s"), 9).alias("score"))


def ranks(hits: DataFrame, *order) -> DataFrame:
    """(id, rank): ``hits`` (a bounded top-k report) numbered from 0."""
    return hits.select("id", (F.row_number().over(W.orderBy(*order)) - 1).cast("long").alias("rank"))


def semantic_union(vector: DataFrame, text: DataFrame, k: int = 10) -> DataFrame:
    """(id, content, score): vector hits, and text hits of contents not among them at 0.5, the best ``k``."""
    late = text.join(vector.select("content").distinct(), "content", "left_anti").select("id", "content", F.lit(TEXT_SCORE).alias("score"))
    return vector.select("id", "content", "score").unionByName(late).orderBy(F.desc("score"), "id").limit(k)
