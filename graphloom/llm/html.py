"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores what a logistic regression learned, from labelled
pages, about the elements round it; a tag costs a learned amount for its kind. One linear scan finds the
contiguous run of the highest sum. Inside the run, blocks in elements that score as boilerplate are left
out, references are decoded and the blocks are joined.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_PART = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold a sentence or a block of an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
#: Kinds of features: elements, and name parts of class, id and role, round a word.
ELEMENTS = frozenset("nav aside header footer form button label menu dialog figure article main section table ul ol a p h1 h2 h3 li blockquote div address".split())


#: A feature that scores less than this decides alone. Its words are left out in any case, so they cost a run
#: little: an advert inside an article must not cut the article off.
VETO, VETOED = -1.5, -0.3


class Weights:
    """Learned scores: ``bias`` and ``of`` a word's context features, ``tag`` for each tag."""

    def __init__(self, bias: float, of: dict[str, float], tag: float):
        self.bias, self.of, self.tag = bias, of, tag

    def word(self, features: frozenset[str]) -> float:
        """Score of a word. One clear sign of boilerplate outweighs all that speaks for main text round it."""
        known = [self.of[f] for f in features if f in self.of]
        low = min(known, default=0.0)
        return VETOED if low < VETO else max(-1.0, min(1.0, self.bias + sum(known)))


def _element(tag: str, attrs: str) -> tuple[frozenset[str], bool]:
    """(features, hidden) that an element gives the words in it."""
    out, hidden = {f"<{tag}>"} if tag in ELEMENTS else set(), False
    if attrs.strip(" /"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                for whole in value.split():
                    parts = _PART.findall(whole)
                    plain = len(parts) == 1 or all(p in _PAGE_PARTS for p in parts)
                    out.update(f"{'.' if plain else '~'}{p}" for p in parts)  # a topical word in a name: no sign of a page part
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    return frozenset(out), hidden


def parse(page: str) -> list[tuple[str | None, frozenset[str], int]]:
    """Tokens in page order: (text, features, block) for text, (None, features, block) for a tag.

    Elements close as browsers close them: an end tag closes up to its element, a block closes an open
    paragraph. Text of one block number belongs to one block. Hidden elements give nothing.
    """
    out: list[tuple[str | None, frozenset[str], int]] = []
    stack: list[tuple[str, frozenset[str], bool]] = [("", frozenset(), False)]
    is_open: Counter[str] = Counter()  # tags on the stack, so that it is searched for those only
    block = 0

    def close(i: int) -> None:
        for name, _, _ in stack[i:]:
            is_open[name] -= 1
        del stack[i:]

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                if not stack[-1][2]:
                    out.append((raw, stack[-1][1], block))
            continue
        tag = tag.lower()
        if tag in BLOCK:
            block += 1
        if m[2]:
            for i in range(len(stack) - 1, 0, -1) if is_open[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
        else:
            if tag in BLOCK and is_open["p"]:
                open_p = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"), 0)
                if open_p and not any(s[0] in ("table", "button", "object") for s in stack[open_p:]):
                    close(open_p)
            if is_open[tag]:
                for same, stop in (("li", ("ul", "ol", "menu")), ("dd", ("dl",)), ("dt", ("dl",)), ("tr", ("table",)), ("td", ("tr", "table")), ("th", ("tr", "table")), ("option", ("select",))):
                    if tag == same:
                        for i in range(len(stack) - 1, 0, -1):
                            if stack[i][0] == same:
                                close(i)
                                break
                            if stack[i][0] in stop:
                                break
            if tag not in VOID:
                own, hidden = _element(tag, m[4] or "")
                _, above, dark = stack[-1]
                stack.append((tag, above | own if own else above, dark or hidden))
                is_open[tag] += 1
            elif tag == "br" and not stack[-1][2]:
                out.append((" ", stack[-1][1], block))
        out.append((None, stack[-1][1], block))
    return out


def extract(page: str | None, weights: Weights) -> str:
    """Main text of one page; empty for a null page or one without text that scores above zero."""
    if not page:
        return ""
    tokens = parse(page)
    memo: dict[frozenset[str], float] = {}
    total, start, best, span = 0.0, 0, 0.0, (0, 0)
    for i, (text, features, _) in enumerate(tokens):  # the scan: a run starts anew where its sum falls to zero
        if text is None:
            total -= weights.tag
        else:
            if features not in memo:
                memo[features] = weights.word(features)
            total += memo[features] * len(text.split())
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    blocks: dict[int, list[str]] = {}
    for text, features, block in tokens[span[0] : span[1]]:
        if text is not None and memo[features] > 0:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


#: Elements and names of customary page parts (fixed values): those of the labelled pages.
CONTENT_NAMES = "content main article post entry story body text page wrapper container".split()
BOILER_NAMES = (
    "ad ads advert advertisement adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget related recommended trending footer header masthead topbar toolbar "
    "comment comments reply replies disqus respond share sharing social follow subscribe newsletter signup login search form copyright legal tags meta byline "
    "contentinfo complementary"
).split()


#: Words that say where a page part stands or what it holds, not what it is about (fixed values).
PLACES = "site page main top bottom left right global inner outer wrap wrapper container box bar list item items link links area section block content col column row slot unit zone panel module group primary secondary mobile desktop sticky fixed new latest all bar title heading text btn button icon".split()
_PAGE_PARTS = frozenset(BOILER_NAMES + CONTENT_NAMES + PLACES)


def labelled_pages() -> list[list[tuple[str, bool]]]:
    """Labelled pages: (markup, is main text) parts of pages built from customary parts."""
    prose = "The city opened a new bridge over the river on Monday after years of work and long debate about its cost."
    pages = []
    shells = [("", ""), ("<div>", "</div>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<section>", "</section>")] + [(f'<div class="{c}">', "</div>") for c in CONTENT_NAMES] + [(f'<div id="{c}">', "</div>") for c in CONTENT_NAMES]
    parts = [("<nav><ul>", "<li><a href='/x'>Home</a></li><li><a href='/y'>World</a></li>", "</ul></nav>"), ("<header>", "<h1><a href='/'>The Daily Paper</a></h1><p>All the news</p>", "</header>"), ("<footer>", "<p>Copyright the publisher, all rights reserved</p>", "</footer>"), ("<aside>", "<h3>Most read</h3><ul><li><a href='/z'>Ten things to see in town this week</a></li></ul>", "</aside>"), ("<form>", "<p>Your name</p><button>Send</button>", "</form>"), ("<menu>", "<li>Open</li>", "</menu>"), ("<dialog>", "<p>We use cookies on this site</p>", "</dialog>"), ("<button>", "Read more", "</button>"), ("<label>", "Your address", "</label>"), ("<form>", "<label>Your name and your address</label><p>We answer all letters that we get from readers</p>", "</form>")] * 4
    for name in BOILER_NAMES:
        for kind in ("div", "section", "ul", "p"):
            inner = "<li>Some words here for readers</li>" if kind == "ul" else "Buy our goods now, offers end soon, or read on elsewhere in these pages." if kind == "p" else "<p>Some words here for readers of all kinds</p>"
            parts.append((f'<{kind} class="{name}">', inner, f"</{kind}>"))
    for i in range(0, len(parts), 2):
        a, b = parts[i], parts[(i + 7) % len(parts)]
        shell = shells[i // 2 % len(shells)]
        body = f"<h1>A new bridge</h1><p>{prose}</p><p>It is <a href='/w'>the third</a> of its kind.</p><h2>Costs</h2><p>{prose} {prose}</p><ul><li>{prose}</li><li>{prose}</li></ul><h3>Reactions to it</h3><p>{prose}</p><h4>What comes next</h4><blockquote>{prose}</blockquote>"
        inner = parts[(i + 3) % len(parts)]
        pages.append([("<html><body>" + "".join(a), False), (shell[0] + body, True), ("".join(inner), False), (f"<p>{prose}</p><table><tr><td>{prose}</td></tr></table>" + shell[1], True), ("".join(b) + "</body></html>", False)])
    return pages


def train(pages: list[list[tuple[str, bool]]], steps: int = 800, rate: float = 1.0, l2: float = 1e-3) -> Weights:
    """Logistic regression of "is main text" on a word's context; the tag cost is the mean score of a word
    over the tags that stand between main words, so that main text pays for its own markup."""
    rows: list[tuple[frozenset[str], float, bool]] = []
    tags = words = 0
    for page in pages:
        marked = "".join(f"\x02{text}\x03" if main else text for text, main in page)
        inside = False
        for text, features, _ in parse(marked):
            if text is None:
                tags += inside
                continue
            for bit in re.split("([\x02\x03])", text):
                if bit in ("\x02", "\x03"):
                    inside = bit == "\x02"
                elif n := len(bit.split()):
                    rows.append((features, float(n), inside))
                    words += n * inside
    names = sorted({f for fs, _, _ in rows for f in fs})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (fs, _, _) in enumerate(rows):
        x[i, [at[f] for f in fs]] = 1
    y, n = np.array([r[2] for r in rows], dtype=float), np.array([r[1] for r in rows])
    n = n / np.where(y > 0, 2 * n[y > 0].sum(), 2 * n[y == 0].sum())
    w, b = np.zeros(len(names)), 0.0
    for _ in range(steps):
        err = (1 / (1 + np.exp(-(x @ w + b))) - y) * n
        w -= rate * 20 * (x.T @ err + l2 / 20 * w)
        b -= rate * err.sum()
    weights = Weights(b, dict(zip(names, w.tolist())), 0.0)
    weights.tag = min(0.2, 0.2 * words / max(1, tags) * max(0.05, weights.word(frozenset({"<p>"}))))
    return weights


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[list[tuple[str, bool]]] | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``.

    text is empty for a null, empty or textless page; of runs of equal sums the first counts; long pages are read
    whole. Repeated rows and null ids are rows like any
    other; extra columns are not read; an empty table gives no rows.
    """
    weights = train(labelled_pages() if labelled is None else labelled)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([extract(h, weights) for h in s], dtype=object)

    rows = pick(pages, [(id_col, "long", "page_id"), (url_col, "string", "url"), (html_col, "string", "html")])
    rows = rows.select("page_id", "url", run("html").alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
