"""Quality rules: document statistics and a learned decision list.

The statistics are Column expressions over one row. The list is learned by sequential covering: each
rule is a conjunction of thresholds, grown on two thirds of a labelled sample by information gain and
pruned on the other third; rules are kept while they are precise. The result is one ordered chain of
Spark conditions, so scoring never leaves the JVM.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PRE, WORD, let, union_of_spans, window_hashes, words_of

WINDOW = 8
#: About so many labelled rows, chosen by a hash of the id, train the list.
TRAIN_ROWS = 6000
#: Thresholds tried for a statistic (quantiles), conditions of a rule, rules of a list.
CUTS, CONDITIONS, RULES = 24, 4, 12
#: Least share of rejected rows among those a rule covers, when grown and when pruned.
PRECISION = 0.9

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(hashes: Column, k: int) -> Column:
    """Words in windows that occur twice or more: the union of the k-word spans of equal hashes.

    Equal hashes stand together after a sort, so the cost is n log n for any text.
    """

    def spans(by_hash: Column) -> Column:
        last = F.size(by_hash) - 1
        twice = lambda s, j: (
            ((j > 0) & (F.get(by_hash, F.greatest(j - 1, F.lit(0)))["h"] == s["h"])) | ((j < last) & (F.get(by_hash, F.least(j + 1, last))["h"] == s["h"]))
        )
        return union_of_spans(F.sort_array(F.transform(F.filter(by_hash, twice), lambda s: s["i"])), k)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, spans))


def _stats(text: Column) -> Column:
    def lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            let(window_hashes(words, WINDOW), lambda h: _repeated(h, WINDOW)).cast("long").alias("n_repeat_words"),
        )

    return F.struct(
        let(words_of(text), of).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_shouts"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lines).alias("l"),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base statistics, n_lines and n_shouts of every whole text (null: none).

    Columns named in ``keep`` follow as they are.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), _stats(F.coalesce(docs[text_col], F.lit(""))).alias("s"), *[docs[c] for c in keep])
    return rows.select("doc_id", "s.w.n_words", "s.w.word_chars", "s.n_symbols", "s.l.n_dup_lines", "s.w.n_repeat_words", "s.l.n_lines", "s.n_shouts", *keep)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: What thresholds are learned on: ratios, so that a rule means the same for short and long texts.
FEATURES: dict[str, tuple[str, str]] = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "symbol_word_ratio": ("n_symbols", "n_words"),
    "shout_ratio": ("n_shouts", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


Condition = tuple[str, str, float]  # feature, "<=" or ">=", threshold


def _holds(row: dict, c: Condition) -> bool:
    return row[c[0]] <= c[2] if c[1] == "<=" else row[c[0]] >= c[2]


def _covers(row: dict, rule: list[Condition]) -> bool:
    return all(_holds(row, c) for c in rule)


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _grow(rows: list[dict], cuts: dict[str, list[float]]) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < CONDITIONS:
        p0 = sum(r["bad"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, chosen = 1e-9, None
        for name, values in cuts.items():
            for v in values:
                for op in ("<=", ">="):
                    inside = [r["bad"] for r in rows if _holds(r, (name, op, v))]
                    p = sum(inside)
                    if (g := _gain(p0, n0, p, len(inside) - p)) > best:
                        best, chosen = g, (name, op, v)
        if chosen is None:
            break
        rule.append(chosen)
        rows = [r for r in rows if _holds(r, chosen)]
    return rule


def _worth(rule: list[Condition], rows: list[dict]) -> float:
    inside = [r["bad"] for r in rows if _covers(r, rule)]
    return (2 * sum(inside) - len(inside)) / len(inside) if inside else -1.0


def learn(rows: list[dict]) -> list[list[Condition]]:
    """Ordered rules that reject, from rows of the features and ``bad`` (bool). Deterministic in the rows' order."""
    cuts: dict[str, list[float]] = {name: [] for name in FEATURES}
    for part in (rows, [r for r in rows if r["bad"]]):  # the second, as rejected rows may all lie in one tail
        for name, found in cuts.items():
            v = sorted(r[name] for r in part)
            found += {v[i * len(v) // CUTS] for i in range(CUTS)} if v else ()
    cuts = {name: sorted(set(found)) for name, found in cuts.items()}
    grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    rules: list[list[Condition]] = []
    while len(rules) < RULES and any(r["bad"] for r in grow):
        rule = _grow(grow, cuts)
        if not rule:
            break
        rule = max((rule[:n] for n in range(len(rule), 0, -1)), key=lambda r: _worth(r, prune))
        seen = [r["bad"] for r in [*grow, *prune] if _covers(r, rule)]
        if not seen or sum(seen) < PRECISION * len(seen) or sum(seen) < 3:
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not _covers(r, rule)] for part in (grow, prune))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one chain of conditions: true keeps."""
    out = None
    for rule in rules:
        c = reduce(lambda a, b: a & b, [(feature(f) <= v) if op == "<=" else (feature(f) >= v) for f, op, v in rule])
        out = F.when(c, False) if out is None else out.when(c, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> list[list[Condition]]:
    """Decision list from the labelled documents (quality 0 is rejected).

    About ``train_rows`` labels, chosen by a hash of the id, are joined to their documents by broadcast
    (the sample has that bound); only their statistics come to the driver. Labels that are null,
    contradict each other, or name no document are not used.
    """
    marks = labels.select(labels[id_col].cast("long").alias(f"{PRE}id"), labels["quality"].cast("int").alias("q")).where(f"{PRE}id is not null and q in (0, 1)")
    marks = marks.groupBy(f"{PRE}id").agg(F.min("q").alias("q"), F.max("q").alias("top")).where("q = top").drop("top")
    n = marks.count()
    rate = int(min(1.0, train_rows / max(n, 1)) * (1 << 20))
    sample = marks.where(F.pmod(F.xxhash64(f"{PRE}id"), F.lit(1 << 20)) < rate)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.join(F.broadcast(sample), rows["doc_id"] == sample[f"{PRE}id"]).select("doc_id", "text", "q")
    stats = statistics(rows, keep=("q",))
    # the base rules are applied to the sample here: as a filter they would be pushed below the join, to all documents
    got = stats.select("doc_id", (F.col("q") == 0).alias("bad"), base_failed().alias("failed"), *[feature(f).alias(f) for f in FEATURES]).collect()
    return learn(sorted((r.asDict() for r in got if not r["failed"]), key=lambda r: (hash(r["doc_id"]) * 2654435761 % (1 << 32), *(r[f] for f in FEATURES))))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, the four base statistics, base_failed and kept for every row of ``docs``.

    A null or empty text has no words and fails the base rules. Without usable labels the list is empty
    and only the base rules reject. Repeated rows and null ids are rows like any other; an empty table
    gives no rows; of extra columns only those named in ``keep`` are read.
    """
    rules = learn_rules(docs, labels, id_col, text_col, train_rows)
    rows = statistics(docs, id_col, text_col, keep).withColumn("base_failed", base_failed())
    return rows.select("doc_id", *STATS, "base_failed", F.when(F.col("base_failed"), False).otherwise(verdict(rules)).alias("kept"), *keep)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they are."""
    names = docs.columns
    rules = learn_rules(docs, labels, id_col, text_col, train_rows)
    packed = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.struct(*[docs[c] for c in names]).alias(f"{PRE}row"))
    rows = statistics(packed, keep=(f"{PRE}row",)).where(~base_failed() & verdict(rules))
    return rows.select(f"{PRE}row.*")
