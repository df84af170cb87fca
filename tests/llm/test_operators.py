"""The other training-data operators against brute force, exact round trips and held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import decontaminate, html, language, licenses, packing, quality, sharding, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __gl_x string, shard string"
EDGE_TEXTS = [None, "", " \n\t ", "One", "!!!", "x " * 3000, "caf\u00e9 \u4e2d\u6587 \U0001f600", "a\nb\na\n\n \na"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", "s") for i, t in rows], SCHEMA)


def edge_rows():
    return [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(3, "One"), (None, "Two words"), (None, None)]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


# language


def test_language_of_held_out_documents(documents):
    got = language.identify(documents).toPandas().merge(documents.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert set(got.doc_id[got.held_out]) == {d for d in got.doc_id if zlib.crc32(str(d).encode()) % 5 == 0}


def test_language_edges(spark):
    got = language.identify(docs(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows())
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (0, 1, 2, 4))
    assert language.identify(docs(spark, [])).count() == 0
    nothing = language.identify(docs(spark, [(1, "words")]).drop("lang")).first()
    assert nothing.lang_pred == "und"


def test_every_language_is_learned(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(70):
        letters = rnd.sample("abcdefghijklmnopqrstuvwxyz", 6)
        for i in range(12):
            rows.append((100 * k + i, " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(60)), f"l{k:02d}"))
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {d: x for d, _, x in rows}
    assert {r.lang_pred for r in got if r.lang_pred == lang[r.doc_id]} == {f"l{k:02d}" for k in range(70)}


def test_mixture_finds_both_parts():
    p = np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]])
    w = language.infer(p, np.array([40.0, 20.0, 40.0]))
    assert abs(w[0] - 0.5) < 0.05 and abs(w.sum() - 1) < 1e-6
    assert language.infer(p, np.array([70.0, 20.0, 10.0])).tolist() == [1.0, 0.0]


# html


def text_of(page):
    return html.extract(page, html.train(html.labelled_pages()))


def test_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    import html as entities

    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = html.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("<nav><a>Home</a></nav>", ""), ("<p>One &amp; two&nbsp;three.", "One & two three."),
        ("<body><div id='cookie-notice'>We use cookies <button>OK</button></div><header><h1>Site</h1></header><div class='sidebar'><ul><li><a>Other story one two</a></li></ul></div>"
         "<div class='content'><h1>Title</h1><p>First <b>bo</b>ld words in here to read.</p><div class='ad'>Buy now</div><p>Second   para<br>line goes on.</p><form><label>Mail</label></form></div>"
         "<div class='comments'><p>Nice article, I liked it very much</p></div><script>var t='</p>';</script><style>p{}</style><footer>&copy; rights</footer>", "Title\nFirst bold words in here to read.\nSecond para line goes on."),
        ("<main><ul><li>one item<li>two items</ul><table><tr><td>c1<td>c2</table><p hidden>no</p></main>", "one item\ntwo items\nc1\nc2"),
        ("<article><p>a < b and c > d</article>", "a < b and c > d"), ("<p>cut in a tag <a href='x", "cut in a tag < a href='x"[:12]),
    ],
)
def test_extract(page, want):
    got = text_of(page)
    assert got == want or (want == "cut in a tag" and got.startswith(want))


def test_extract_is_linear_in_bad_markup():
    import time

    began = time.time()
    for page in ("<a " * 60000, "<<<<" * 60000, '<a "' * 60000, "<!--" * 60000, "<script>" * 20000, "<p>word " * 30000, "<div>" * 20000 + "x", "<ul><li>" * 9000):
        text_of(page)
    assert time.time() - began < 20


# packing


def test_pack_round_trip(spark, documents, texts):
    got = packing.pack(documents).toPandas()
    encode = packing._encoder(packing.TOKENIZER, None)
    for doc, part in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*encode(texts[doc] or ""), 0], dtype="<u4")
        assert part.doc_tokens.eq(len(ids)).all() and part.length.sum() == len(ids)
        at = 0
        for r in part.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    seq = got.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.cumsum() - seq.length == seq.offset).all()
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 1024 and used.sum() / (1024 * len(used)) > 0.93 and set(used.index) == set(range(len(used)))


def test_fast_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing._encoder(packing.TOKENIZER, None)
    for text in [x for x in EDGE_TEXTS if x] + ["it's 12,5 %% don't", "a <|endoftext|> b", "tab\tnew\r\nline   end  "]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_pack_edges(spark):
    rows = edge_rows()
    got = packing.pack(docs(spark, rows)).toPandas()
    assert got.start.eq(0).sum() == len(rows) and got[got.doc_id.eq(0)].length.tolist() == [1]
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_cutting_stock_uses_each_item_once_and_packs_well(seed):
    rnd = random.Random(seed)
    demand = Counter(rnd.choice([rnd.randint(1, 64), rnd.randint(1, 64), 33]) for _ in range(rnd.choice((1, 30, 2000))))
    plan = packing.cutting_stock(demand, 64)
    used = Counter()
    for pattern, n in plan:
        assert sum(s * k for s, k in pattern.items()) <= 64
        for s, k in pattern.items():
            used[s] += k * n
    assert used == +demand
    large = sum(n for s, n in demand.items() if s > 32)
    bound = max(-(-sum(s * n for s, n in demand.items()) // 64), large)
    assert sum(n for _, n in plan) <= 1.06 * bound + 3


def test_price_is_the_best_knapsack():
    import itertools

    value = np.array([-1, 0.11, 0.0, 0.36, 0.55, -1, 0.8, 0.0, 0.0])
    best, pattern = packing.price(value, 8)
    brute = max(sum(value[s] for s in c) for n in range(9) for c in itertools.combinations_with_replacement(range(1, 7), n) if sum(c) <= 8)
    assert abs(best - brute) < 1e-9 and abs(sum(value[s] * k for s, k in pattern.items()) - best) < 1e-9


# licenses


def slow_license(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_base_columns(spark, documents, texts):
    rows = [(10**6 + i, t) for i, t in enumerate(EDGE_TEXTS + ["MIT License mit license MIT-LICENSE", "cc", "cc by cc by", "submit license"])]
    both = documents.select("doc_id", "text").union(docs(spark, rows).select("doc_id", "text"))
    want = {d: slow_license(t) for d, t in [*texts.items(), *rows]}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(both).collect()}
    assert got == want


def test_license_diagonals(spark):
    notice = licenses.NOTICES[7][1]
    ws = notice.split()
    edited = " ".join(["intro"] * 7 + ws[:5] + ["inserted"] + ws[5:] + ["end"])
    got = {r.doc_id: r for r in licenses.spans(docs(spark, [(1, edited), (2, " ".join(ws[:6])), (3, None), (4, notice), (4, notice)])).collect()}
    assert set(got) == {1, 4} and got[1].label == "bsd-notice" and got[1].start_word == 7 and got[4].score == 1.0
    scan = licenses.scan(docs(spark, edge_rows() + [(50, notice), (50, notice)])).collect()
    assert len(scan) == len(edge_rows()) + 2 and [r.labels for r in scan if r.doc_id == 50] == ["bsd-notice"] * 2
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_scan_reads_each_text_once(spark, monkeypatch):
    read, words = [], licenses._words
    monkeypatch.setattr(licenses, "_words", lambda text: read.append(text) or words(text))
    notice = licenses.NOTICES[7][1]
    got = licenses.scan(docs(spark, [(1, f"see the mit license here {notice}"), (2, "a b"), (None, None)])).collect()
    assert len(read) == 2  # the notices and the texts
    assert {r.doc_id: (r.n_base, r.first_word, r.labels) for r in got} == {1: (1, 2, f"{licenses.NOTICES[7][0]},mit"), 2: (0, None, ""), None: (0, None, "")}


# sharding


def test_hilbert_curve_visits_neighbours(spark):
    for dims, bits in ((2, 4), (3, 3)):
        cells = [r.cell for r in sharding.curve(spark, dims, bits).orderBy("hilbert").collect()]
        at = np.array([[c >> bits * (dims - 1 - i) & (1 << bits) - 1 for i in range(dims)] for c in cells])
        assert sorted(cells) == list(range(1 << dims * bits)) and (np.abs(np.diff(at, axis=0)).sum(1) == 1).all()


def test_shards(spark, documents, texts):
    got = sharding.assign(documents).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(texts) and len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got[["doc_id", "size", "text_crc32"]].itertuples() for r in [r])
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()


def test_shards_edges(spark):
    got = sharding.assign(docs(spark, edge_rows()), shards=3).toPandas()
    assert len(got) == len(edge_rows()) and got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    assert sharding.assign(docs(spark, [])).count() == 0
    assert sharding.assign(docs(spark, [(i, "same") for i in range(50)]).drop("source", "lang"), shards=4).groupBy("shard").count().count() == 4


# urls


@pytest.mark.parametrize("url", [None, "", "no scheme", "http://A.Example.NET/en/1?x=/y", "https://x.org", "https://x.org?q=http://y.net/", "http://x.net#f/y", "a://b://c/d", "http:///p"])
def test_url_parts(spark, url):
    df = spark.createDataFrame([(url,)], "u string")
    assert tuple(df.select(urls.host_of(df.u), urls.path_of(df.u)).first()) == urls.split_url(url or "")


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        ("http://a.example.net/en/x", "example.net/en/", "allow"), ("http://example.net/de/x", "net/", "block"), ("http://net/x", "net/", "block"), ("http://x.net", None, "allow"), ("http://notexample.com/de/", None, "allow"),
        ("http://m.example.com/de/1", "example.com/de/", "block"), ("http://q.org/fr/", "org/fr/", "allow"), ("http://q.org/fr", None, "allow"), ("http://www.cheap-pills.example.com/en/1", None, "block"), (None, None, "allow"),
    ],
)
def test_url_verdicts(spark, url, rule, verdict):
    r = urls.judge(spark.createDataFrame([(1, url, "x")], "page_id long, url string, rule string")).first()
    assert (r["rule"], r.verdict) == (rule, verdict)


def test_url_model():
    w, b = urls.train(urls.labelled_urls())
    right = [(urls.score(*urls.split_url(u), w, b) >= 0.5) == bool(y) for u, y in urls.labelled_urls()]
    assert np.mean(right) > 0.98


def test_url_model_held_out():
    table = urls.labelled_urls()
    far = [zlib.crc32(u.encode()) % 5 == 0 for u, _ in table]
    w, b = urls.train([r for r, f in zip(table, far) if not f])
    got = {y: [(urls.score(*urls.split_url(u), w, b) >= 0.5) == bool(y) for (u, v), f in zip(table, far) if f and v == y] for y in (0, 1)}
    assert np.mean(got[0]) > 0.95 and np.mean(got[1]) > 0.9, {y: np.mean(v) for y, v in got.items()}
    whole = urls.train(table)
    assert all(urls.score(h, "/", *whole) >= 0.5 for h in ("pokerstars.com", "xvideos-hd.com", "buy-cheap-tramadol.com"))


# quality


def slow_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    m = set()
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            m.update(range(i, i + 8))
    found = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(found) - len(set(found)), len(m)


def test_quality_statistics(spark, documents, texts):
    rnd = random.Random(3)
    odd = EDGE_TEXTS + [" ".join(rnd.choice("ab") for _ in range(60)), "a b c d e f g h a b c d e f g h i", "# * a|b <c>\n# * a|b <c>"]
    rows = [(10**6 + i, t) for i, t in enumerate(odd)]
    both = documents.select("doc_id", "text").union(docs(spark, rows).select("doc_id", "text"))
    want = {d: slow_stats(t) for d, t in [*texts.items(), *rows]}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(both, labels).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept != r.base_failed for r in got)


def test_quality_list_agrees_with_the_labels(spark, sf_dir):
    docs_, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.judge(docs_, labels).join(labels, "doc_id").toPandas()
    free = got[~got.base_failed]
    assert (free[free.quality == 1].kept).mean() > 0.97 and (~free[free.quality == 0].kept).mean() > 0.6
    kept = quality.keep_good(docs_, labels)
    assert kept.columns == docs_.columns and kept.count() == quality.judge(docs_, labels).where("kept").count()


def test_decision_list_matches_its_column(spark):
    rnd = random.Random(8)
    rows = [{**{f: rnd.random() for f in quality.FEATURES}} for _ in range(900)]
    for r in rows:
        r["bad"] = r["symbol_ratio"] > 0.8 or (r["repeat_ratio"] > 0.7 and r["word_length"] < 0.3)
    rules = quality.learn(rows)
    said = [any(quality._covers(r, rule) for rule in rules) for r in rows]
    assert rules and np.mean([s == r["bad"] for s, r in zip(said, rows)]) > 0.97
    assert quality.learn([]) == [] and quality.learn([{**rows[0], "bad": False}]) == []


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs(spark, edge_rows()), labels).count() == len(edge_rows())
    assert quality.judge(docs(spark, []), labels).count() == 0


# decontamination


def test_alignment_is_smith_waterman():
    rnd = random.Random(6)
    for _ in range(40):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(1, 12))] for _ in range(2))
        h, top = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                top = max(top, h[i][j])
        score, start, end = decontaminate.align(np.array(a), np.array(b))
        assert score == top and 0 <= start <= end <= len(b)


def test_contaminations(spark, texts):
    rnd = random.Random(12)
    vocab = [f"w{rnd.randrange(4000)}" for _ in range(4000)]
    items = [(i, " ".join(rnd.sample(vocab, rnd.randint(14, 50)))) for i in range(30)] + [(40, None), (41, ""), (42, "two words"), (None, "a b c d e")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], {}
    for i in range(120):
        ws = [rnd.choice(vocab) for _ in range(rnd.randint(0, 200))]
        if i % 4 == 0:
            item, text = rnd.choice(items[:30])
            copy = text.upper().split()
            for _ in range(len(copy) // 8):
                copy[rnd.randrange(len(copy))] = "EDITED"
            at = rnd.randint(0, len(ws))
            ws[at:at] = copy
            want[i] = item
        rows.append((i, " ".join(ws)))
    rows += [(1000 + i, items[0][1]) for i in range(200)]  # a leak into most of the corpus
    want |= {1000 + i: 0 for i in range(200)}
    rows += [(i + 5000, t) for i, t in enumerate(EDGE_TEXTS)]
    got = decontaminate.contaminations(docs(spark, rows), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == set(want.items())
    split = decontaminate.contaminations(docs(spark, rows), bench, block_words=100)
    assert {(r.doc_id, r.item_id) for r in split.collect()} == set(want.items())
    left = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert left.columns == docs(spark, rows).columns and {r.doc_id for r in left.collect()} == {i for i, _ in rows} - set(want)
    assert decontaminate.contaminations(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminations(docs(spark, []), bench).count() == 0


def test_hot_copies_with_many_edits(spark):
    rnd = random.Random(3)
    item = [f"i{k}" for k in range(40)]
    copy = [w if k % 5 < 3 else "EDITED" if k % 5 == 3 else w for k, w in enumerate(item)]
    copy[4] = copy[10] = copy[20] = "EDITED"
    left = {tuple(item[k : k + 3]) for k in range(38)} & {tuple(copy[k : k + 3]) for k in range(38)}
    assert 0 < len(left) < 19  # under half of the item's 3-grams
    noise = lambda: [f"n{rnd.randrange(10**6)}" for _ in range(60)]
    chance = [(2000 + i, " ".join(noise() + item[i : i + 3] + noise())) for i in range(38)]  # each 3-gram once, by chance
    for repeats in (8, 9, 60):
        rows = [(i, " ".join(noise() + copy + noise())) for i in range(repeats)] + chance
        got = decontaminate.contaminations(docs(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
        assert {r.doc_id for r in got.collect()} == set(range(repeats))


def test_bound_of_alignment():
    rnd = random.Random(8)
    for _ in range(200):
        item, text = ([rnd.randrange(12) for _ in range(rnd.randint(3, 20))] for _ in range(2))
        index = decontaminate.Index([(1, [str(x) for x in item])])
        x = index.encode(" ".join(map(str, text)))
        assert index.most(index.items[0][1], x) >= decontaminate.align(index.items[0][1], x)[0]


def test_leaks_of_the_table(spark, sf_dir, texts):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    flat = lambda t: " ".join(decontaminate.words(t))
    items = {r.item_id: f" {flat(r.text)} " for r in bench.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in f" {flat(t)} "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), bench).collect()}
    assert want and want <= got


@pytest.mark.parametrize(
    "markup",
    [
        '<div class="news-header-story"><p>{}</p></div>',
        '<main><p>{}</p><p class="share-price">{}</p></main>',
        '<main><p>{}</p><p class="legal-analysis">{}</p></main>',
        '<article><p>{}</p><table class="social-stats"><tr><td>{}</td></tr></table></article>',
        '<article><p>{}</p><p>so <math><mi>x</mi> is small</math> here</p></article>',
    ],
)
def test_topical_names_are_no_page_parts(spark, markup):
    prose = "The council met on Tuesday to hear what the engineers had found under the old bridge."
    page = f"<html><body><nav><a href='/'>Home</a></nav>{markup.replace('{}', prose)}<footer>Copyright</footer></body></html>"
    text = html.extract(page, html.train(html.labelled_pages()))
    assert text.count(prose) == markup.count("{}") and "Home" not in text and "Copyright" not in text
    assert ("is small" in text) == ("is small" in markup)


def test_empty_and_repeated_pages_and_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.org/fr/x", "<p>One two</p>", "x"), (1, "http://a.org/fr/x", "<p>One two</p>", "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    assert html.main_text(pages.limit(0)).count() == 0 and urls.judge(pages.limit(0)).count() == 0
    got = html.main_text(pages).collect()
    assert len(got) == 3 and got[0].text == got[1].text and [r.n_chars for r in got if r.page_id is None] == [0]
    assert [(r.host, r["rule"], r.verdict) for r in urls.judge(pages).where("page_id = 1").collect()] == [("a.org", "org/fr/", "allow")] * 2


def test_like_prefixes_are_different_places(spark):
    rows = [(i, f"text {i}", "en", s) for i, s in enumerate(["common", "common_crawl_2019", "common_crawl_2024"] * 40)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=3).collect()
    at = {}
    for r in got:
        at.setdefault(rows[r.doc_id][3], set()).add(r.hilbert)
    sets = list(at.values())
    assert not sets[0] & sets[1] and not sets[1] & sets[2] and not sets[0] & sets[2]


def test_short_and_unspaced_items(spark):
    bench = spark.createDataFrame([(1, "secret answer"), (2, "\u4eca\u65e5\u306e\u5929\u6c17\u306f\u3069\u3046\u3067\u3059\u304b")], "item_id long, text string")
    rows = [(1, "the Secret, answer is"), (2, "secret of the answer"), (3, "\u300c\u4eca\u65e5\u306e\u5929\u6c17\u306f\u3069\u3046\u3067\u3059\u304b\u300d\u3068\u805e\u3044\u305f"), (4, None)]
    got = sorted((r.doc_id, r.item_id, r.score) for r in decontaminate.contaminations(docs(spark, rows), bench).collect())
    assert got == [(1, 1, 1.0), (3, 2, 1.0)]
