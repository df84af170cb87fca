"""URL filters: domain rules, and a logistic regression on hashed character n-grams for the rest.

The model is trained on a small labelled URL table; its weights have a fixed size, so they travel with
the function.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

BITS, GRAMS = 14, (3, 4, 5)

#: (verdict, host and path prefix) of the rules (fixed values).
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]

#: Host terms of the small labelled table: unwanted and harmless sites.
UNWANTED = "adult xxx porn sex-cams xvideos escort casino poker pokerstars slots betting free-bets jackpot lottery cheap-pills pills viagra cialis tramadol pharma-deal replica payday loans-now crack warez torrent keygen malware phish get-rich miracle-diet ads-server ads-track tracker click-farm spam spam-mail adult-x nude webcam-girls hookup roulette blackjack cheap-meds xanax fake-watches".split()
HARMLESS = "news journal museum library school university garden recipes weather science travel history music sports cinema poetry health city-council energy bakery football archive wiki docs forum photo market railway letters hospital theatre chess cycling biology physics chemistry opera parish village mountain harbour kitchen furniture carpenter pottery painting translation dictionary grammar teacher student nursery farmer orchard vineyard fishing sailing swimming climbing hiking camping festival concert orchestra gallery bookshop publisher newspaper magazine podcast radio television".split()
#: Syllables of made-up harmless names, so that an unknown word alone is no sign of an unwanted site.
ONSETS = ["", *"bcdfghjklmnprstvwyz", "bl", "br", "ch", "cl", "cr", "dr", "fl", "fr", "gl", "gr", "ph", "pl", "pr", "qu", "sc", "sh", "sl", "sp", "st", "str", "sw", "th", "tr", "wh"]
VOWELS = ["a", "e", "i", "o", "u", "ai", "ea", "ee", "ie", "io", "ou"]
CODAS = ["", "", "b", "ck", "d", "l", "ll", "m", "n", "n", "nd", "ng", "nt", "p", "r", "r", "rd", "rs", "s", "ss", "st", "t", "th", "x"]
NAMES = 4000


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: (url, 1 for unwanted), each term in customary places."""
    pick_one = lambda kind, i, k: kind[zlib.crc32(f"{i} {k}".encode()) % len(kind)]
    names = ["".join(pick_one(kind, i, 3 * k + j) for k in range(2 + i % 2) for j, kind in enumerate((ONSETS, VOWELS, CODAS))) for i in range(NAMES)]
    forms = ["https://{}.com/", "http://{}.example.com/", "https://www.{}.example.org/en/12", "https://m.{}.example.net/a.html", "http://blog.{}.example.com/de/7/", "https://site.example.org/{}/3"]
    bait = UNWANTED + [f.format(t) for t in UNWANTED for f in ("{}-win", "{}-online", "{}-hd", "best-{}", "buy-{}")]
    table = [(f.format(t), y) for terms, y in ((bait, 1), (HARMLESS, 0)) for t in terms for f in forms]
    short = [f"http://{c}.{end}" for c in "abcdefghijklmnopqrstuvwxyz" for end in ("com", "net", "org", "net/en/1", "org/fr")] + [""] * 40
    return table + [(forms[i % len(forms)].format(name), 0) for i, name in enumerate(names)] + [(u, 0) for u in short]


def _grams(host: str, path: str) -> np.ndarray:
    out = []
    for kind, text in ((b"h", f"^{host}$"), (b"p", f"^{path}$" if path else "")):
        raw = text.encode("utf-8", "surrogatepass")
        out += [zlib.crc32(kind + raw[i : i + n]) & ((1 << BITS) - 1) for n in GRAMS for i in range(len(raw) - n + 1)]
    return np.unique(np.array(out, dtype=np.int64))


def split_url(url: str) -> tuple[str, str]:
    """(host, path) of a URL, as the Column expressions below give them."""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    cut = rest.find("/")
    host_end = end if cut < 0 or cut > end else cut
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:host_end]), rest[host_end:end]


def train(table: list[tuple[str, int]], steps: int = 300, rate: float = 2.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent; every example has a feature vector of length one.

    Both classes weigh the same, however many examples they have.
    """
    rows = [_grams(*split_url(u)) for u, _ in table]
    y = np.array([v for _, v in table], dtype=float)
    at, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(rows))))
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        z = np.bincount(of, w[at], minlength=len(rows)) * scale + b
        err = (1 / (1 + np.exp(-z)) - y) * weight
        w -= rate * (10 * np.bincount(at, (err * scale)[of], minlength=1 << BITS) + l2 * w)
        b -= rate * err.sum()
    return w, b


def score(host: str, path: str, w: np.ndarray, b: float) -> float:
    g = _grams(host, path)
    z = (w[g].sum() / np.sqrt(len(g)) if len(g) else 0.0) + b
    return float(1 / (1 + np.exp(-z)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; a tie goes to the first given."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # later conditions wrap earlier ones
        domain, prefix = text.split("/", 1)
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None, table: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and model_score for every row of ``pages``.

    Rules go before the model. A URL that is null or has no ``://`` has an empty host and path; no rule
    fits it and the model's bias decides. Repeated rows and null ids are rows like any other; extra
    columns are not read; an empty table gives no rows.
    """
    w, b = train(labelled_urls() if table is None else table)

    @F.pandas_udf("double")
    def model(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([score(h, p, w, b) for h, p in zip(hosts, paths)], dtype=float)

    rows = pick(pages, [(id_col, "long", "page_id"), (url_col, "string", "url")])
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"), model("host", "path").alias("model_score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("model_score") >= threshold, "block").otherwise("allow")).alias("verdict"), "model_score")
