"""The operators against plain brute-force versions, and on nulls, empty tables, repeated rows and clashing columns."""

import collections
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartograph.llm import common, html_text, linededup, mixing, nearcopies, packing, pii, quality, sharding, simhash, topk, toxicity
from cartograph.llm.queries import QUERIES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, texts, sources=None, ids=None):
    ids = ids or range(len(texts))
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in zip(ids, texts, sources)], DOCS)


def vocabulary(seed=1, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)]


def prose(r, n, vocab):
    return " ".join(r.choice(vocab) for _ in range(n)) + "."


ODD = [None, "", " \n\t ", "a", "a b", "one two three four", "x" * 5000, "Ünïcode Ωmega x é\n\nline", "a b c a b c a b c", "<|endoftext|> it's 12,345 don't."]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


# ---- 1

def test_topk_against_brute_force(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pdf = vectors.toPandas()
    x = np.array([np.floor(64 * np.asarray(v, dtype=np.float64)).astype(np.int64) for v in pdf.embedding])
    ids = pdf.vec_id.to_numpy()
    want = {}
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        best = [j for j in np.lexsort((ids, -s)) if j != k][:20]
        want[int(ids[k])] = [(int(ids[j]), int(s[j])) for j in best]
    got = collections.defaultdict(list)
    for r in topk.exact_top_k(vectors, block_rows=150, block_queries=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == want


def test_topk_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0, 0.5]), (6, [1.0, 0.5]), (20, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.1]), (5, [1.0, 0.5])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rid", F.lit("clash")).withColumn("v", F.lit("clash"))
    got = topk.exact_top_k(vectors).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id == 0] == [(0, 1, None, 6144), (0, 2, 5, 5120), (0, 3, 5, 5120), (0, 4, 6, 5120), (0, 5, 20, 0), (0, 6, 7, -64 * 64 + 32 * 6)]
    assert [r.vec_id for r in got if r.query_id == 20] == [0, 5, 5, 6, 7, None]
    assert topk.exact_top_k(vectors.limit(0)).count() == 0 and topk.exact_top_k(vectors.where("vec_id = 20")).count() == 0
    twice = topk.exact_top_k(vectors.where("vec_id = 20").union(vectors.where("vec_id = 20"))).collect()
    assert [tuple(r) for r in twice] == [(20, 1, 20, 0)] * 2


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9, 1e17])
def test_topk_of_large_components(spark, scale):
    r = random.Random(17)
    data = [(k, [round(r.gauss(0, 1), 3) * scale for _ in range(r.choice([4, 6]))]) for k in range(300)]
    hold = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    x = {k: [hold(int(np.floor(64 * y))) for y in v] for k, v in data}
    got = collections.defaultdict(list)
    for row in topk.exact_top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), block_rows=200).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    for q in range(0, 300, 20):
        scores = sorted((-hold(sum(a * b for a, b in zip(x[q], x[k]))), k) for k in x if k != q)
        assert got[q] == [(k, -s) for s, k in scores[:20]]


def test_topk_takes_postings_for_a_batch():
    """Postings are taken for many queries at once: that changes no result, and a query costs less than half of one alone."""
    r = np.random.default_rng(5)
    for n, spread in ((6000, 8), (1000, 300), (1000, 1 << 20), (700, 1 << 27)):  # long segments, short ones; accumulators of 16, 32 and 64 bits
        x = np.floor(r.normal(size=(n, 48)) * spread).astype(np.int64)
        x[300:600] = x[:300]  # copies: ties
        x[5] = 0
        own = [*range(0, 240, 2)]
        ids = np.arange(n)[::-1].copy()
        index, alone = topk.ImpactIndex(ids, x), []
        began = time.process_time()
        for row in own:
            alone += index.search(x[row][None], 20, [row])
        single, began = time.process_time() - began, time.process_time()
        found = index.search(x[own], 20, own)
        batch = time.process_time() - began
        for row, (rows, scores), (rows_alone, scores_alone) in zip(own, found, alone):
            s = x @ x[row]
            want = [k for k in np.lexsort((ids, -s)).tolist() if k != row][:20]
            assert rows.tolist() == rows_alone.tolist() == want
            assert scores.tolist() == scores_alone.tolist() == s[want].tolist()
        assert n < 6000 or batch < single / 2


def test_topk_of_queries_beyond_the_vectors(spark):
    """Queries much larger than the vectors of a block: sums are not held in numbers that only fit those."""
    r = random.Random(3)
    data = [(k, [float(r.randint(-50, 50)) * (1e5 if k in (20, 60) else 1) for _ in range(8)]) for k in range(1200)]
    x = {k: np.array([int(64 * y) for y in v]) for k, v in data}
    got = collections.defaultdict(list)
    for row in topk.exact_top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), block_rows=300).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    for q in range(0, 1200, 20):
        assert got[q] == [(k, -s) for s, k in sorted((-int(x[q] @ x[k]), k) for k in x if k != q)[:20]]


def test_topk_of_empty_vectors(spark):
    assert [tuple(r) for r in topk.exact_top_k(spark.createDataFrame([(20, []), (21, [])], "vec_id long, embedding array<float>")).collect()] == [(20, 1, 21, 0)]


# ---- 2

def test_main_text_drops_what_is_around_the_article():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
    <div class="ad">Buy now</div><article><h1>Head&shy;line</h1><p><b>Some &lt;text&gt;   with\nspace<br><p>Second.</p><form>Enter mail</form><aside>Aside</aside><!-- note --><ul><li>One</li><li>Two</li></ul></article>
    <section id="comments"><p>First comment!</p></section><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "Head­line\n\nSome <text> with space\n\nSecond.\n\nOne\n\nTwo"
    bare = "<body><div class='menu'><a href=1>Home</a><a href=2>News</a></div><div><p>" + "Long story. " * 20 + "</p><p>Short.</p></div><div class=footer>Imprint</div>"
    assert html_text.main_text(bare) == ("Long story. " * 20).strip() + "\n\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""


def test_main_text_beside_articles_that_are_not_the_text():
    story = "Long story. " * 20
    comments = "".join(f"<article class='comment'>Reader {k} says so.</article>" for k in range(3))
    assert html_text.main_text(f"<body><div><p>{story}</p></div>{comments}") == story.strip()
    teasers = "".join(f"<article><a href=/{k}>Teaser number {k} leads to another long story of ours, number {k}</a></article>" for k in range(9))
    assert story.strip() in html_text.main_text(f"<body><div><p>{story}</p></div>{teasers}")
    assert html_text.main_text(f"<body><p>Some words around.</p><article><p>{story}</p></article>") == story.strip()


def test_windows_decide_on_a_page():
    story = [f"Sentence number {k} of the story is long enough. " * 2 for k in range(6)]
    page = "<nav>" + "".join(f"<li><a href=/{k}>Item {k} of menu</a></li>" for k in range(9)) + "</nav><h4>Short</h4>" + "".join(f"<p>{x}</p>" for x in story) + "".join(f"<a href=/{k}>Read the other story number {k}</a><br>" for k in range(9)) + "<p>Stray end.</p><footer>Imprint and so on</footer>"
    lines = html_text.lines_of(page)
    assert html_text.main_lines(lines) == ["Short", *(x.strip() for x in story)]
    assert "Short" not in html_text.main_lines(lines, window=1)  # it is there for what follows
    heavy = [line for (line, *_), w in zip(lines, html_text.weights(lines)) if w >= html_text.LIGHT]
    assert "Stray end." in heavy  # and what is as heavy but alone is not


def test_windows_decide_on_the_given_pages(sf_dir):
    import pyarrow.parquet as pq

    pages = [html_text.lines_of(x or "") for x in pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist()]
    differ = sum(html_text.main_lines(lines) != html_text.main_lines(lines, window=1) for lines in pages)
    assert differ > 0.05 * len(pages)


def test_stretches_against_a_plain_walk():
    r = np.random.default_rng(6)
    for _ in range(200):
        w = np.where(r.random(30) < 0.5, r.random(30) * 20, r.random(30) * 120) * (r.random(30) < 0.8)
        window = int(r.integers(1, 6))
        sums = [sum(w[k : k + window]) for k in range(30)]
        want, k = set(), 0
        while k < 30:
            if sums[k] < min(80, max(sums)) - 1e-9:
                k += 1
                continue
            while k < 30 and sums[k] >= 15:
                want |= {k} if w[k] >= 15 else set()
                k += 1
        assert set(np.flatnonzero(html_text.between(w, window)).tolist()) == want


def test_markup_weighs_and_settles_nothing():
    """A very long part that a class name bars, or that stands outside of the article, is still heavier than the surge."""
    long = "Some words of a very long text. " * 400
    assert long.strip() in html_text.main_text(f"<div class=comment><p>{long}</p></div>")
    story = "The story itself. " * 30
    assert html_text.main_text(f"<div class=comment><p>{long[:600]}</p></div><p>{story}</p>") == story.strip()
    assert html_text.main_text("<article><h1>Title</h1><p>Short text.</p></article><div class=comments>" + "<article class=comment>I think so too.</article>" * 9 + "</div>") == "Title\n\nShort text."
    assert html_text.main_text("<article><p>One</p><svg><path><p>Two and more words</p></article>") == "One\n\nTwo and more words"


def test_broken_markup():
    text = html_text.main_text
    assert text("<article><p>First</p><svg/><p>Second</p><iframe src=x /><p>Third</p></article>") == "First\n\nSecond\n\nThird"
    assert text("<article><svg><text>no</text></svg><p>First</p></article>") == "First"
    assert text('<article><p title="x>One two</p><p>Three</p></article>') == "One two\n\nThree"
    assert text("<article><p>One <b>two</p></i><p>3 < 4 & 5 &gt; 2 &#x41;&nbsp;b</p>") == "One two\n\n3 < 4 & 5 > 2 A b"
    assert text("</div></p>plain words only") == "plain words only" and text("<") == "<" and text("<!-- open") == ""
    deep = "<div>" * 30_000 + "<p>" + "Long story. " * 20 + "</p>" + "</div>" * 30_000
    assert text(deep) == ("Long story. " * 20).strip()
    many = "<article>" + "<p>Some more words of it.</p>" * 40_000 + "</article>"
    assert text(many).count("Some more") == 40_000


def test_extract_text_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<article>a &#x41;</article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = sorted(map(tuple, html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "a A", 3)], key=str)
    assert html_text.extract_text(pages.limit(0)).count() == 0


# ---- 3

def test_word_coder_equals_the_tokenizer(rows):
    coder = packing.WordCoder(tokenizer_path())
    texts = [r.text for r in rows.select("text").collect()] + [t for t in ODD if t is not None] + ["a.b,c's 'tis é.x (don't)!.. \x1c x y", "ſ ſt Σας."]
    for t in texts:
        want = coder.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == want, t[:80]


def best_fit_by_document(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in bins if b >= n), default=None)
        if fit is None:
            bins.append(capacity - n)
        else:
            bins[bins.index(fit)] -= n
    return sorted(bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_document_by_document_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 97])
    lengths = [r.randint(1, r.choice([capacity, 5, capacity // 2])) for _ in range(r.randint(0, 300))]
    used = collections.Counter()
    counts = collections.Counter(lengths)
    plan = packing.best_fit_plan(dict(counts), capacity)
    offsets = collections.defaultdict(set)
    for k, (n, rank, per, first, offset) in enumerate(plan):
        last = min((x[1] for x in plan if x[0] == n and x[1] > rank), default=counts[n])
        for i in range(last - rank):
            s, at = first + i // per, offset + i % per * n
            assert not offsets[s] & set(range(at, at + n))
            offsets[s] |= set(range(at, at + n))
            used[s] += n
    assert all(offsets[s] == set(range(used[s])) and used[s] <= capacity for s in used)
    assert sorted(capacity - u for u in used.values()) == best_fit_by_document(lengths, capacity)


def test_packing_is_gapless_and_complete(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    r, vocab = random.Random(2), vocabulary()
    docs = documents(spark, ODD + [prose(r, r.randint(1, 60), vocab) for _ in range(60)] + ["a b"] * 9).withColumn("length", F.lit("clash"))
    docs = docs.union(docs.limit(3))
    got = packing.best_fit_packing(docs, tokenizer_path(), 32).toPandas()
    tok = packing.coder(tokenizer_path()).tokenizer
    want = collections.Counter()
    for d, t in docs.select("doc_id", "text").collect():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 32):
            want[(d, k // 32, k, len(ids[k : k + 32]), zlib.crc32(ids[k : k + 32].tobytes()))] += 1
    assert collections.Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum().to_numpy()[:-1]]).all() and g.length.sum() <= 32
    assert got.sequence_id.nunique() == len(best_fit_by_document(got.length.tolist(), 32))
    assert packing.best_fit_packing(docs.limit(0), tokenizer_path()).count() == 0


# ---- 4

def base_measures(text):
    words = WORDS.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_measures(spark, rows):
    docs = rows.select(*rows.columns).union(documents(spark, ODD, ids=list(range(10**6, 10**6 + len(ODD)))))
    got = {r.doc_id: r for r in quality.line_quality(docs).collect()}
    for d, t in docs.select("doc_id", "text").collect():
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(t), d
        assert not (r.base_failed and r.kept)
    assert quality.line_quality(docs.limit(0)).count() == 0


def test_quality_keeps_prose_and_rejects_menus(spark):
    r, vocab = random.Random(3), vocabulary()
    good = "\n".join(prose(r, 12, vocab) for _ in range(8))
    menu = " | ".join(r.choice(vocab) for _ in range(80))
    symbols = " ".join(w + "%%%" for w in good.split())
    legal = "\n".join(f"All rights reserved {r.choice(vocab)} {prose(r, 9, vocab)}" for _ in range(9))
    kept = {x.doc_id: x.kept for x in quality.line_quality(documents(spark, [good, menu, symbols, legal, good + "\nHome\n"])).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False, 4: True}


@pytest.mark.parametrize("least_bits", [1, 58, 62])
def test_repeated_windows_with_keys_that_collide(spark, least_bits):
    r, vocab = random.Random(18), vocabulary(n=40)
    texts = [prose(r, r.randint(0, 400), vocab) for _ in range(40)] + [" ".join(vocab * 3), "a b c a b c", "a a a a a"]
    got = quality.measured(documents(spark, texts), least_bits)
    assert not {c for c in got.columns if c.startswith("__")} - {"__text", "__parts", "__lines"}
    assert {x.doc_id: x.n_repeat_words for x in got.collect()} == {k: base_measures(t)[4] for k, t in enumerate(texts)}


def test_quality_replaces_clashing_columns_and_judges_repeated_rows(spark):
    r, vocab = random.Random(3), vocabulary()
    good = "\n".join(prose(r, 12, vocab) for _ in range(8))
    docs = documents(spark, [good, good, None]).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = quality.line_quality(docs.union(docs)).collect()
    assert sorted((x.doc_id, x.n_words, x.kept) for x in got) == sorted([(0, 96, True), (1, 96, True), (2, 0, False)] * 2)


def plain_kept(text):
    words = len(WORDS.findall(text or ""))
    stay = 0
    fold = lambda pattern: re.compile(pattern.replace("\\z", "\\Z"), re.I)
    for line in (text or "").split("\n"):
        w = WORDS.findall(line)
        if not w:
            continue
        bad = len(w) < 30 and (not re.search(quality.CLOSED.replace("\\z", "\\Z"), line) or fold(quality.MENU).search(line) or fold(quality.BOILERPLATE).search(line))
        if len(w) >= 30:
            spare = re.sub(f"(?<![{quality.LETTER}])(?:{quality.PHRASES})(?![{quality.LETTER}])", "", line.lower())
            bad = len(re.findall(f"[{quality.LETTER}]+", line.lower())) - len(re.findall(f"[{quality.LETTER}]+", spare)) > 0.2 * len(w)
        heavy = sum(bool(set(x) & set("#*$%&|<>{}")) for x in w) > 0.2 * len(w) or sum(not set(x) - set(quality.SEPARATORS) for x in w) > 0.2 * len(w)
        stay += 0 if bad or heavy else len(w)
    return stay, not base_measures(text)[5] and words - stay <= 0.3 * words


def test_long_lines_of_menus_and_notices_go(spark):
    vocab = vocabulary()
    story = prose(random.Random(1), 60, vocab)
    texts = [" ".join(["Home Login Register"] * 25), "All rights reserved privacy policy cookie settings accept cookies " + story, "All rights reserved. Privacy policy, cookie settings. " * 8 + story]
    got = {x.doc_id: x.kept_words for x in quality.line_quality(documents(spark, texts)).collect()}
    assert got == {0: 0, 1: len(texts[1].split()), 2: 0}


def test_quality_verdict_against_brute_force(spark, rows):
    r, vocab = random.Random(19), vocabulary()
    menu = " ".join(["Home", "Login", "Register", "Mehr lesen", "Plan du site", "homes"] * 12)
    parts = [menu, "All rights reserved, privacy policy; cookie settings (accept cookies) " + prose(r, 40, vocab), prose(r, 20, vocab) + " Alle Rechte vorbehalten. Log in | sign up" * 2 + " " + prose(r, 10, vocab), "Home", "MENÜ", "« Zurück »", "À propos", "Leer más", "Alle Rechte vorbehalten.", "a | b | c | d.", "x% y% z w.", "(All rights reserved.)", prose(r, 60, vocab) + " and no end"]
    made = ["\n".join(r.choice([prose(r, r.randint(3, 25), vocab), r.choice(parts), r.choice(vocab)]) for _ in range(r.randint(4, 20))) for _ in range(200)]
    docs = rows.select(*rows.columns).union(documents(spark, made + ODD, ids=list(range(10**6, 10**6 + len(made + ODD)))))
    got = {x.doc_id: (x.kept_words, x.kept) for x in quality.line_quality(docs).select("doc_id", "kept_words", "kept").collect()}
    assert got == {x.doc_id: plain_kept(x.text) for x in docs.select("doc_id", "text").collect()}
    assert 20 < sum(k for _, k in got.values()) < len(got) - 20


# ---- 5

def test_trie_walk_is_bounded_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            step = [i + 1]
            for j, y in enumerate(b):
                step.append(min(step[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = step
        return row[-1]

    r = random.Random(4)
    terms = {"".join(r.choice("abc") for _ in range(r.randint(4, 10))): 1.0 for _ in range(30)}
    trie = toxicity.Trie(terms, {})
    for _ in range(2000):
        t = "".join(r.choice("abc") for _ in range(r.randint(3, 11)))
        want = [d for x in terms if (d := distance(t, x)) <= toxicity.edits_allowed(x)]
        got = trie.walk(t) if trie.may_match(t) else None
        assert (got is None) == (not want), t
        assert not want or got[0] == 0.5 ** min(want)


def test_toxicity_learns_and_catches_misspelling(spark):
    r, vocab = random.Random(5), vocabulary()
    texts, toxic = [], []
    for k in range(600):
        words = prose(r, 60, vocab).split()
        bad = k % 6 == 0
        for _ in range(3 * bad):
            words.insert(r.randrange(len(words)), r.choice(["worthless", "horrible", "despicable"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    extra = [None, "", prose(r, 50, vocab), " ".join(vocab[:20]) + " worthles despicabel horribble " + " ".join(vocab[20:40])]
    docs = documents(spark, texts + extra).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, x) for k, x in enumerate(toxic)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 604 and all(0 <= x.score <= 1 for x in got.values())
    assert all(x.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and x.predicted == (x.score >= 0.7) for d, x in got.items())
    assert sum(got[k].predicted == toxic[k] for k in range(600)) >= 594
    assert [got[600 + k].predicted for k in range(4)] == [0, 0, 0, 1]
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    none = toxicity.toxicity(docs, labels.limit(0)).agg(F.sum("predicted")).first()[0]
    assert none == 0 and toxicity.toxicity(docs.limit(0), labels).count() == 0


# ---- 6

def test_histogram_shards(spark, rows):
    r, vocab = random.Random(6), vocabulary()
    texts = ODD + [prose(r, r.randint(1, 80), vocab) for _ in range(500)] + ["copy of one text"] * 400
    docs = documents(spark, texts).withColumn("shard", F.lit("clash"))
    for slice_rows in (4_000_000, 5):
        got = sharding.histogram_shards(docs, slice_rows=slice_rows).toPandas()
        assert len(got) == len(texts) and set(got["shard"]) <= set(range(24))
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        by = got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
        assert (by - by.sum() / 24).abs().max() <= 5008
        assert {int(d): (int(s), int(c)) for d, s, c in got[["doc_id", "size", "text_crc32"]].itertuples(index=False)} == {k: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in enumerate(texts)}
    assert sharding.histogram_shards(docs.limit(0)).count() == 0
    assert sharding.histogram_shards(docs.limit(2)).count() == 2
    repeated = sharding.histogram_shards(docs.limit(1).union(docs.limit(1)).withColumn("doc_id", F.lit(None).cast("long"))).toPandas()
    assert len(repeated) == 2 and sorted(zip(repeated.shard, repeated.slot))[0][1] == 0


def test_shards_of_rows_without_id(spark):
    """Rows of one text and no id, or one id, are split like others."""
    docs = documents(spark, ["same text of some length"] * 300 + [f"other {k}" for k in range(20)], ids=[None] * 200 + [7] * 100 + list(range(20)))
    got = sharding.histogram_shards(docs, tolerance=0.02).collect()
    total = collections.Counter()
    for x in got:
        total[x.shard] += x.size
    each, largest = sum(total.values()) / 24, max(x.size for x in got)
    assert len(got) == 320 and len(total) == 24 and all(abs(b - each) <= 2 * (largest + 0.02 * each) for b in total.values())
    for k in range(24):
        slots = sorted(x.slot for x in got if x.shard == k)
        assert slots == list(range(len(slots)))


# ---- 7

def plain_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(t)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    n, label = len(fps), list(range(len(fps)))
    change = True
    while change:
        change = False
        for i in range(n):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    change = True
    return label


def test_simhash_against_brute_force(spark, rows):
    texts = [r.text for r in rows.orderBy("doc_id").limit(150).collect()] + ODD
    r, vocab = random.Random(7), vocabulary()
    base = prose(r, 300, vocab).split()
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    fps = list(map(plain_fingerprint, texts))
    want = plain_components(fps)
    docs = documents(spark, texts).withColumn("fingerprint", F.lit("clash"))
    got = {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f, c) for k, (f, c) in enumerate(zip(fps, want))}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows,told", [(10**6, 10_000), (40, 10_000), (40, 0)])
def test_links_connect_crowded_cells(spark, monkeypatch, cell_rows, told):
    monkeypatch.setattr(simhash, "MOST_BROADCAST", told)
    r = random.Random(8)
    centre = r.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(150)} | {r.getrandbits(64) for _ in range(100)})
    nodes = spark.createDataFrame([(k, int(np.uint64(f).astype(np.int64))) for k, f in enumerate(fps)], "node long, fp long")
    found = {x.node: x.component for x in simhash.components(simhash.links(nodes, cell_rows=cell_rows)).collect()}
    want = plain_components(fps)
    assert {k: found.get(k, k) for k in range(len(fps))} == dict(enumerate(want))


# ---- 8

def test_pii_base_equals_the_plain_patterns(rows):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(9)
    made = ["".join(r.choice("ab.@1- +()25") for _ in range(r.randint(5, 60))) for _ in range(4000)]
    card = "4111 1111-1111 1111"
    for t in [x.text for x in rows.select("text").collect()] + made + [f"é {card}, x@y.z.@a.b 300.1.1.1 001.02.3.255 +1 (555) 010-9999 1.2.3.4.5"]:
        want = [(m.start(), "email", m.end()) for m in email.finditer(t)]
        want += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        base, all_ = pii.spans_of(t)
        assert [tuple(s) for s in base] == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[1])))
        assert set(base) <= set(all_)


def test_pii_adds_confirmed_spans(spark):
    apart = " and so it went on for a good long while "
    t = apart.join(["Account GB82 WEST 1234 5698 7654 32", "call (555) 123-4567", "part 555-123-4567", "SSN: 123-45-6789."])
    assert [s.kind for s in pii.spans_of(t)[1]] == ["iban", "national_phone", "ssn"]
    assert not pii.spans_of(t.replace("7654 32", "7654 33"))[1][0].kind == "iban"
    assert pii.masked("mail a@b.co now") == "mail <email> now" and pii.masked(None) is None
    got = pii.personal_data(documents(spark, [None, "", "a@b.co"]).withColumn("spans", F.lit("clash"))).orderBy("doc_id").collect()
    assert [(r.n_email, r.spans) for r in got] == [(0, ""), (0, ""), (1, "email:0:6")]
    assert pii.personal_data(documents(spark, [])).count() == 0


def test_pii_is_linear_in_the_text():
    began = time.perf_counter()
    for t in ("1" * 1_000_000, "1." * 200_000, "+1" + "(" * 1_000_000, "4111 1111 1111 1111 " * 10_000, "a.b1" * 200_000 + "@", "AB12 " * 200_000):
        pii.spans_of(t)
    assert time.perf_counter() - began < 20
    assert pii.spans_of("1" * 6000 + ".2.3.4 " + "0" * 6000 + "1.2.3.4")[0] == [(6007, "ip", 12014)]


def test_pii_finds_tokens_by_context(spark):
    t = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y'
    assert pii.spans_of(t)[1] == [(11, "secret", 51)] and not pii.spans_of(t.replace("token", "commit"))[1]
    assert not pii.spans_of("token " + "internationalization_of_things")[1]
    docs = documents(spark, [t, t, "1" * 100_000], ids=[1, 1, None])
    assert sorted(map(str, (x.spans for x in pii.personal_data(docs).collect()))) == ["", "secret:11:51", "secret:11:51"]


def test_numbers_beside_numbers_and_words_of_addresses():
    of = lambda text: [(s.kind, text[s.start : s.end]) for s in pii.spans_of(text)[1]]
    assert ("international_phone", "+1 (826) 555-4081") in of("call +1 (826) 555-4081 190.137.22 now")
    assert of("+1 (826) 555-4081") == [("phone", "+1 (826) 555-4081")]
    token = "aB3dE6gH9jK2mN5pQ8sT"
    assert ("secret", token) in of(f"me@mail.example.com token = {token}")
    assert ("secret", token) not in of(f"an example of a token = {token}")


def test_added_spans_on_the_given_documents(rows):
    """Every access token that a document assigns by name is found, and every base span stays."""
    found = asked = 0
    for x in rows.select("text").collect():
        text = x.text or ""
        base, all_ = pii.spans_of(text)
        assert set(base) <= set(all_)
        for m in re.finditer(r'token = "([A-Za-z0-9_-]{20,})"', text):
            asked += 1
            found += any(s.start <= m.start(1) and s.end >= m.end(1) for s in all_)
    assert found == asked


# ---- 9

def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("block", [7, 64])
def test_mix_meets_targets(spark, block):
    r, vocab = random.Random(10), vocabulary()
    texts = ODD + [prose(r, r.randint(0, 90), vocab) for _ in range(300)]
    sources = [r.choice(["a", "a", "a", "b", "c", "é", "Z", None, "tiny"]) if k > 20 else "empty" if not WORDS.search(t or "") else "a" for k, t in enumerate(texts)]
    docs = documents(spark, texts, sources).withColumn("target", F.lit("clash"))
    docs = docs.union(docs.limit(3))
    rows = mixing.mix(docs, block_words=block).collect()
    again = mixing.mix(docs, block_words=block).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == docs.count()
    assert all(0 <= x.taken <= 2 * x.size for x in rows)
    source = dict(docs.select("doc_id", "source").collect())
    sizes, taken = collections.Counter(), collections.Counter()
    for x in rows:
        sizes[source[x.doc_id]] += x.size
        taken[source[x.doc_id]] += x.taken
    want = plain_targets(sizes)
    for x in rows:
        assert x.target == pytest.approx(want[source[x.doc_id]]) and x.source_size == sizes[source[x.doc_id]]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    mixed = mixing.mixed_documents(docs, block_words=block)
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for x in mixed.collect():
        words[x.source] += len(WORDS.findall(x.text))
    assert words == +taken
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_shuffled_is_a_permutation(spark):
    for n in (1, 2, 13, 100):
        got = [r[0] for r in spark.range(n).select(mixing.shuffled(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(got) == list(range(n)) and (n < 13 or got != list(range(n)))


def test_draws_reach_the_mix(spark):
    """Other draws and other sizes of shards give other places, while what each document gives holds to its target."""
    r, vocab = random.Random(8), vocabulary()
    n = 240
    docs = documents(spark, [prose(r, r.randint(5, 60), vocab) for _ in range(n)], sources=[r.choice("aab") for _ in range(n)], ids=[None] * 150 + [3] * 20 + list(range(n - 170)))
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.size, x.taken, x.n_parts, x.shard is None, x.shard or 0, x.slot or 0)
    one, again, other = (sorted(mixing.mix(docs, block_words=7, seed=s).collect(), key=key) for s in (1, 1, 2))
    assert one == again and [(x.shard, x.slot) for x in one] != [(x.shard, x.slot) for x in other]
    for rows in (one, other):
        assert len(rows) == n and all((x.shard is None) == (x.taken == 0) == (x.n_parts == 0) and x.taken <= 2 * x.size for x in rows)
        for size in {x.source_size for x in rows}:
            mine = [x for x in rows if x.source_size == size]
            assert abs(sum(x.taken for x in mine) - mine[0].target) <= 1


def test_counting_off_in_steps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 4)
    rows = spark.createDataFrame([(1, 0, 9), (2, 5, 4), (3, 7, 0), (4, 2, 1)], "k int, a long, n long")
    got = mixing.counted_off(rows, "x", F.col("a"), F.col("n")).collect()
    assert sorted((x.k, x.x) for x in got) == [(k, a + i) for k, a, n in ((1, 0, 9), (2, 5, 4), (4, 2, 1)) for i in range(n)]


# ---- 10

def plain_windows(lines):
    """Every line run of 50 words or more, as the shortest from its first line."""
    out = {}
    for i in range(len(lines)):
        n, j = 0, i
        while j < len(lines) and n < 50:
            n += len(WORDS.findall(lines[j]))
            j += 1
        if n >= 50:
            out.setdefault(tuple(lines[i:j]), []).append(i)
    return out


def with_words(text):
    return [x for x in (text or "").split("\n") if WORDS.search(x)]


def test_line_dedup_removes_every_long_repeat(spark):
    r, vocab = random.Random(11), vocabulary(n=3000)
    passage = [[prose(r, r.choice([4, 9, 20, 60]), vocab) for _ in range(r.randint(4, 12))] for _ in range(6)]
    texts = list(ODD)
    for _ in range(60):
        own = [[prose(r, r.randint(1, 30), vocab)] for _ in range(6)]
        for p in r.sample(passage, 2):
            own.insert(r.randrange(6), p)
        if r.random() < 0.2:
            own += own[:3]
        texts.append("\n".join(x for part in own for x in part))
    texts += [texts[20], texts[20], "All rights reserved.\n" + texts[21]]
    docs = documents(spark, texts).withColumn("runs", F.lit("clash"))
    got = {x.doc_id: x for x in linededup.line_dedup(docs).collect()}
    assert len(got) == len(texts) and got[0].text is None
    before, after = {}, {}
    for k, t in enumerate(texts):
        kept = with_words(got[k].text)
        lines = with_words(t)
        assert got[k].n_lines == len(lines) and got[k].n_removed == len(lines) - len(kept)
        if not got[k].n_removed:
            assert got[k].text == t
        it = iter(lines)
        assert all(x in it for x in kept)  # in order
        for w in plain_windows(lines):
            before.setdefault(w, []).append(k)
        for w, at in plain_windows(kept).items():
            after.setdefault(w, []).extend([k] * len(at))
    assert all(len(v) == 1 for w, v in after.items() if w in before)
    assert {x for t in texts for x in with_words(t)} == {x for g in got.values() for x in with_words(g.text)}  # one copy stays
    assert got[len(texts) - 3].text == ""
    short = documents(spark, ["a b c.\nd e f."] * 3)
    assert [x.n_removed for x in linededup.line_dedup(short).collect()] == [0, 0, 0]
    assert linededup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_removes_repeats_whole_where_a_line_came_first_elsewhere(spark):
    r, vocab = random.Random(13), vocabulary(n=3000)
    q, p, long, tail = (prose(r, n, vocab) for n in (30, 40, 60, 8))
    docs = documents(spark, [q, f"{q}\n{p}", f"{q}\n{p}", f"{long}", f"{long}\n{tail}", f"{tail}\nx\n{long}\n{tail}\ny"])
    got = {x.doc_id: x.text for x in linededup.line_dedup(docs).collect()}
    assert got == {0: q, 1: f"{q}\n{p}", 2: "", 3: long, 4: tail, 5: f"{tail}\nx\ny"}


def plain_dedup(texts, ids):
    """Every line in a run of 50 words or more that has an equal run at an earlier place goes."""
    out, seen = {}, set()
    order = sorted(range(len(texts)), key=lambda k: (ids[k] is None, ids[k] or 0, k))
    for k in order:
        lines = with_words(texts[k])
        words = [len(WORDS.findall(x)) for x in lines]
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(words[i:j]) >= 50:
                    run = tuple(lines[i:j])
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
        out[k] = texts[k] if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("seed", [14, 20])
def test_line_dedup_equals_brute_force(spark, seed):
    r, vocab = random.Random(seed), vocabulary(n=3000)
    lines = [prose(r, r.choice([1, 5, 12, 30, 60]), vocab) for _ in range(12)]
    texts = ["\n".join(r.choice(lines + ["", " "]) for _ in range(r.randint(1, 9))) for _ in range(80)] + ODD
    texts += [texts[3], texts[3], "\n".join([lines[1]] * 60)]
    ids = [r.choice([None, 1, 2, *range(3, 50)]) for _ in texts]
    rows = [(d, t, k) for k, (d, t) in enumerate(zip(ids, texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").coalesce(1).withColumn("n_lines", F.lit("clash")).withColumn("lines", F.lit("clash"))
    got = linededup.line_dedup(docs).collect()
    assert {x.k: x.text for x in got} == plain_dedup(texts, ids)
    assert all(x.n_lines == len(with_words(texts[x.k])) and x.n_removed == x.n_lines - len(with_words(x.text)) for x in got)


@pytest.mark.parametrize("least,most", [(0, 1), (3, 10_000)])
def test_line_dedup_with_common_and_rare_runs(spark, monkeypatch, least, most):
    """A join that tells common hashes to every task and one that meets rare ones by hash give the same."""
    monkeypatch.setattr(linededup, "COMMON_ROWS", least)
    monkeypatch.setattr(linededup, "MOST_COMMON", most)
    r, vocab = random.Random(31), vocabulary()
    common, rare = ("\n".join(prose(r, 14, vocab) for _ in range(5)) for _ in range(2))
    docs = documents(spark, [f"{prose(r, 9, vocab)}\n{common}\n{rare if k in (3, 9) else prose(r, 9, vocab)}" for k in range(20)])
    got = {x.doc_id: x.n_removed for x in linededup.line_dedup(docs).collect()}
    assert got == {k: 0 if k == 0 else 10 if k == 9 else 5 for k in range(20)}


def test_line_dedup_is_linear_in_a_document(spark):
    docs = documents(spark, ["\n".join(["one and the same line of ten words in all."] * 20_000), "a b.\n" * 30_000])
    began = time.perf_counter()
    got = {x.doc_id: x for x in linededup.line_dedup(docs).collect()}
    assert time.perf_counter() - began < 60
    assert got[0].n_removed == 19_999 and got[1].n_removed == 29_999


def test_rows_keep_their_numbers_when_scans_are_split_anew(spark, tmp_path):
    r, vocab = random.Random(12), vocabulary(n=3000)
    texts = [prose(r, 60, vocab) + "\n" + prose(r, 60, vocab) for _ in range(12)]
    texts += [x.split("\n")[0] + "\n" + prose(r, 60, vocab) for x in texts]
    documents(spark, texts).repartition(8, "doc_id").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    held = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[1], "0")
        spark.conf.set(names[0], "1g")
        deduped, mixed = linededup.line_dedup(docs), mixing.mixed_documents(docs, block_words=7)
        spark.conf.set(names[0], "1k")
        got = {x.doc_id: x.text for x in deduped.collect()}
        assert got == {k: t if k < 12 else t.split("\n")[1] for k, t in enumerate(texts)}
        words = sum(len(x.text.split()) for x in mixed.collect())
        assert abs(words - sum(x.taken for x in mixing.mix(docs, block_words=7).collect())) == 0
    finally:
        for n, v in zip(names, held):
            spark.conf.set(n, v)


# ---- pipeline

def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf_dir)
        assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.collect(), docs.schema)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert seen.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(got) and labels.count() and (got.groupby("sequence_id").length.sum() <= 4096).all()


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r, vocab = random.Random(21), vocabulary(n=3000)
    t = [prose(r, n, vocab) for n in (80, 80, 60, 55, 30_000)]
    texts = [t[0], t[0], None, None, "", " \n ", t[1], t[1] + "\n" + t[2], t[2] + "\n" + t[3], t[4], "x", "x"]
    ids = [None, None, None, 1, 2, 2, 5, 6, 7, 8, 9, 9]
    sources = ["a", None, "a", None, "b", "b", "a", "a", None, "b", None, "a"]
    schema = DOCS + ", uid string, size string, runs string, kept string, rank string, block string, target string, lines string"
    docs = spark.createDataFrame([(d, x, "en", s, None if x is None else len(x), *["clash"] * 8) for d, x, s in zip(ids, texts, sources)], schema).coalesce(1)
    seen, out = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, seen, sf_dir)
        assert made.columns == docs.columns and stage(spark, docs.limit(0), sf_dir).count() == 0, name
        out[name] = made.collect()
        seen = spark.createDataFrame(out[name], docs.schema)
    assert len(out["toxicity"]) == len(docs.collect())
    deduped = sorted(((x.doc_id, x.text) for x in out["line_dedup"]), key=str)
    want = [(None, t[0]), (None, None), (1, None), (2, ""), (2, " \n "), (5, t[1]), (6, t[2]), (7, t[3]), (8, t[4]), (9, "x"), (9, "x")]  # a copy that is nothing but repeats goes
    assert deduped == sorted(want, key=str)
    near = sorted(((x.doc_id, x.text) for x in out["simhash_near_dedup"]), key=str)
    assert near == sorted([(None, t[0]), (1, None), (5, t[1]), (6, t[2]), (7, t[3]), (8, t[4]), (9, "x")], key=str)
    assert {x.doc_id for x in out["mixing"]} <= {None, 5, 6, 7, 8, 9} and all(x.kept == "clash" for x in out["mixing"])
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 4096).all() and packed.length.sum() > 30_000


def test_shared_folder_and_cut_tables(spark, monkeypatch):
    made = []
    monkeypatch.setattr(common.uuid, "uuid4", lambda old=common.uuid.uuid4: made.append(old()) or made[-1])
    there = lambda k: os.path.exists(f"{common.shared_dir(spark)}/cut-{made[k].hex}")
    with common.scoped(spark):
        with common.scoped(spark):
            common.cut(spark.range(3))
            kept = common.cut(spark.range(4), keep=True)
        assert not there(0) and there(1) and kept.count() == 4
    assert not there(1)
    assert common.cut(spark.range(2)).count() == 2 and there(2)


def test_near_dedup_keeps_different_texts_of_null_and_repeated_ids(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r, vocab = random.Random(15), vocabulary(n=3000)
    t = [prose(r, 80, vocab) for _ in range(6)]
    docs = documents(spark, [t[0], t[1], t[1], t[2], t[3], t[4], t[4], t[5], t[0]], ids=[None, None, None, 7, 7, 8, 8, 9, 3])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([(3, t[0]), (None, t[1]), (7, t[2]), (7, t[3]), (8, t[4]), (9, t[5])], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), sf_dir).count() == 0


def plain_set(text):
    words = WORDS.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("shingles", [nearcopies.CELL_SHINGLES, 2000])
def test_near_dedup_decides_by_exact_similarity(spark, sf_dir, shingles, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    search = nearcopies.links
    monkeypatch.setattr(nearcopies, "links", lambda members, rows: search(members, rows, shingles))
    r, vocab = random.Random(16), vocabulary(n=3000)
    texts = [t for t in ODD if t != "Ünïcode Ωmega x é\n\nline"]
    for _ in range(12):
        base = prose(r, r.randint(30, 300), vocab).split()
        texts.append(" ".join(base))
        for _ in range(5):
            w = list(base)
            for _ in range(r.randint(1, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
    sets = list(map(plain_set, texts))
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, a in enumerate(sets):
            label[i] = min([label[i], *(label[j] for j, b in enumerate(sets) if alike(a, b))])
    assert 12 < len(set(label)) < len(texts) - 12
    got = corpus_pipeline.drop_near_duplicates(spark, documents(spark, texts), sf_dir).collect()
    assert {x.doc_id for x in got} == set(label) and len(got) == len(set(label))
    far = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and alike(sets[i], sets[j]) and (plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[j])).bit_count() > 4]
    assert far  # operator 7 alone doesn't link these


def test_simhash_links_rows_without_id(spark):
    r, vocab = random.Random(7), vocabulary()
    while True:  # a chain: the ends are linked by the middle only
        a = prose(r, 300, vocab)
        chain = [a, a.replace(a.split()[10], "x", 1), a.replace(a.split()[10], "x", 1).replace(a.split()[200], "y", 1)]
        f = list(map(plain_fingerprint, chain))
        if (f[0] ^ f[1]).bit_count() <= 4 and 0 < (f[1] ^ f[2]).bit_count() <= 4 < (f[0] ^ f[2]).bit_count():
            break
    docs = documents(spark, chain, ids=[5, None, 6])
    assert {(x.doc_id, x.component_id) for x in simhash.near_duplicates(docs).collect()} == {(5, 5), (None, 5), (6, 5)}


def test_registered():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES] == list(range(1, 11))
