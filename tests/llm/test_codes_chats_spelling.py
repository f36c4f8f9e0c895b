"""Operators 11 to 13 against brute-force versions, and on nulls, empty tables, repeated rows, long values and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartograph.llm import chat, spelling, yinyang

VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


# ---- 11


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error, digest) of every kept row, with whole numbers of any size."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max([1, *(-(-len(v) // parts) for _, v, _ in kept)]) * parts
    kept = [(i, v + [0] * (dims - len(v)), label) for i, v, label in kept]
    first = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    size = dims // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), f in zip(kept, found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    totals = collections.Counter()
    for (_, _, label), f in zip(kept, found):
        totals[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{e:02x}" for _, e in f), min(sum(d for d, _ in f), (1 << 63) - 1), min(totals[label], (1 << 63) - 1), digest) for (i, _, label), f in zip(kept, found))


def codes(spark, rows, schema=VECTORS):
    return collections.Counter(map(tuple, yinyang.compressed(spark.createDataFrame(rows, schema)).collect()))


def random_vectors(r, n, dims=16, scale=1.0):
    return [[float(np.float32(r.gauss(k % 5, 0.4) * scale)) for _ in range(dims)] for k in range(n)]


def test_codes_against_plain_lloyd(spark):
    r = random.Random(3)
    rows = [(k, v, None if k % 11 == 0 else k % 3) for k, v in enumerate(random_vectors(r, 150))]
    rows += [(3, rows[5][1], 1), (None, rows[6][1], 2), (900, None, 1), (901, [1.0, None], 0), (902, [float("nan")] * 16, 0), (903, [float("inf")] * 16, 0), (904, [0.5] * 3, 0), (905, [], None)]
    r.shuffle(rows)
    assert codes(spark, rows) == lloyd(rows)


def test_codes_of_ties_and_repeated_rows(spark):
    grid = [(k, [float(x) for x in np.unravel_index(k % 81, (3, 3, 3, 3))] * 4, 0) for k in range(243)]
    assert codes(spark, grid) == lloyd(grid)
    same = [(k, [0.25] * 8, None) for k in range(40)]
    assert codes(spark, same) == lloyd(same)


def test_codes_of_huge_components_and_few_rows(spark):
    huge = [(k, [float(np.float32((-1.0) ** k * 10.0 ** (k % 15)))] * 8, 1) for k in range(30)]
    assert codes(spark, huge) == lloyd(huge)
    few = [(7, [1.0] * 8, 1), (5, [2.0] * 8, 1)]
    assert codes(spark, few) == lloyd(few)
    assert codes(spark, []) == collections.Counter()
    assert codes(spark, [(1, None, 1)]) == collections.Counter()


def test_codes_ignore_other_columns(spark):
    rows = [(k, v, k % 2) for k, v in enumerate(random_vectors(random.Random(5), 20, 8))]
    more = spark.createDataFrame(rows, VECTORS).select("*", *(F.lit("x").alias(c) for c in ("v", "code", "low", "error", "sums", "named", "label_error")))
    assert collections.Counter(map(tuple, yinyang.compressed(more).collect())) == lloyd(rows)


def test_bounds_hold_and_spare_scans():
    r = np.random.default_rng(2)
    x = (r.normal(size=(3000, 32)) + 3 * r.integers(0, 6, (3000, 1))).astype(int) * 50 + r.integers(0, 50, (3000, 32))
    books, codes_, low, made = yinyang.Codebooks([[list(map(int, v[p * 4 : p * 4 + 4])) for v in x[:16]] for p in range(8)]), None, None, []
    for _ in range(6):
        codes_, error, low, n = yinyang.assigned(x, books, codes_, low)
        made.append(n)
        for p in range(8):
            d = ((x[:, None, p * 4 : p * 4 + 4] - books.entries[p].astype(int)) ** 2).sum(axis=2)
            assert (d.argmin(axis=1) == codes_[:, p]).all()
            for g in range(yinyang.GROUPS):
                members = np.flatnonzero(books.groups[p] == g)
                if len(members):
                    others = np.where(members == codes_[:, p, None], np.inf, d[:, members]).min(axis=1)
                    assert (low[:, p, g] <= np.sqrt(others)).all()
        books = books.updated(yinyang._sums(x, codes_, 16))
    assert made[0] >= 3000 * 8 * 16 and made[-1] < 0.6 * made[0]


def test_heavy_labels(spark, monkeypatch):
    monkeypatch.setattr(yinyang, "HEAVY", 3)
    rows = spark.createDataFrame([(k, "a" if k % 2 else (None if k % 4 else str(k)), k) for k in range(60)], "vec_id long, label string, error long")
    want = collections.Counter()
    for r in rows.collect():
        want[r.label] += r.error
    assert {r.vec_id: r.label_error for r in yinyang.with_label_errors(rows).collect()} == {r.vec_id: want[r.label] for r in rows.collect()}


# ---- 12


def said(rows):
    """Digests of a conversation's (turn, role, text) rows."""
    rows = sorted((t is None, t or 0, r or "", x or "") for t, r, x in rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    learnt = "".join(x for _, _, r, x in rows if r == "assistant")
    return len(rows), sha("".join(f"{r}\n{x}\n" for _, _, r, x in rows)), len(learnt), sha(learnt)


MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[NEXT]", "[TURN]"]


def test_escaping_is_reversible_and_leaves_no_mark(spark):
    r = random.Random(1)
    texts = ["".join(r.choice([*MARKS, "\\", "\\\\", "[", "]", "<", "s>", "INST]", "[\\INST]", "<\\\\/s>", "é", "$1", "\n"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).withColumn("u", chat.unescaped(F.col("e"))).collect()
    assert all(x.t == x.u for x in rows)
    assert not any(m in x.e for x in rows for m in MARKS)


def test_chats_read_back(spark):
    r = random.Random(2)
    pieces = [*MARKS, "\\", "[", "<", "hello ", "naïve 漢字 ", "\n", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "a[TURN]b", "", None]), r.choice([None, "".join(r.choice(pieces) for _ in range(r.randint(0, 8)))])) for c in range(40) for t in range(r.randint(1, 12))]
    rows += [(50, None, "user", "late"), (50, 1, "user", "x"), (50, 1, "user", "x"), (50, 1, "assistant", "x")]  # ties and repeated rows
    rows += [(60, k, ("user", "assistant")[k // 7 % 2], f"turn {k} [/INST]") for k in range(3000)]  # more turns than a chunk of sums
    rows += [(70, 0, "user", "word " * 200_000), (70, 1, "assistant", "</s>" * 50_000)]
    found = chat.formatted(spark.createDataFrame(rows, TURNS)).cache()
    by = collections.defaultdict(list)
    for c, *turn in rows:
        by[c].append(turn)
    got = {x.conv_id: tuple(x)[1:5] for x in chat.digests(found).collect()}
    assert got == {c: said(x) for c, x in by.items()}
    for x in chat.read_back(found.where("conv_id < 50")).collect():
        want = sorted((t is None, t or 0, r or "", y or "") for t, r, y in by[x.conv_id])
        assert [(t.role, t.text) for t in x.turns] == [w[2:] for w in want]
        assert x.loss == [w[3] for w in want if w[2] == "assistant"]
        assert x.n_blocks == sum(k == 0 or a[2] != want[k - 1][2] for k, a in enumerate(want))


def test_chats_without_conversation_and_marks_inside(spark):
    rows = spark.createDataFrame([(None, 1, "user", "a"), (None, 2, "user", "b")], TURNS)
    assert sorted(x.text for x in chat.formatted(rows).collect()) == ["<s>[INST]a[/INST]", "<s>[INST]b[/INST]"]
    assert chat.formatted(spark.createDataFrame([], TURNS)).count() == 0
    planted = chat.with_marks_inside(spark.createDataFrame([], TURNS))
    x = chat.digests(chat.formatted(planted)).first()
    assert (x.conv_id, *tuple(x)[1:5]) == (-7, *said([(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]))
    more = planted.select("*", *(F.lit(1).alias(c) for c in ("turns", "blocks", "starts", "ends", "parts", "t", "loss_spans", "n_turns")))
    assert chat.digests(chat.formatted(more)).first() == x


def test_chats_run_no_python(spark, sf_dir):
    df = chat.digests(chat.formatted(chat.with_marks_inside(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", df._jdf.queryExecution().executedPlan().toString())


# ---- 13

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def vocabulary(docs):
    seen = collections.Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                seen[word] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(docs):
    n = vocabulary(docs)
    by = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in by.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(by[w]), n.get(form.get(w))) for w in n}


def found(spark, docs, **more):
    rows = spelling.spelling_variants(spark.createDataFrame(docs, DOCS), **more).collect()
    assert len(set(map(tuple, rows))) == len(rows)
    return {tuple(r) for r in rows}


def edited(r, w):
    k, c = r.randrange(len(w) + 1), r.choice("abéÿ")
    return r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])


@pytest.mark.parametrize("block_rows", [7, 60, 100_000])
def test_variants_against_all_pairs(spark, block_rows):
    r = random.Random(block_rows)
    base = ["".join(r.choice("abé") for _ in range(r.randint(6, 12))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaaaa", "Großvater", "straßen", "Ñandúes"]
    words = base + [edited(r, w) for w in base for _ in range(5)]
    docs = [(k, " ".join(r.choice(words) for _ in range(80))) for k in range(12)] + [(99, "Aaaaaaaa1AAAAAAAA-éÉéÉéÉé " * 15)]
    docs += [(None, "straßen straßen Straßen"), (3, None), (4, ""), (5, " .,;1234 "), (6, "short words only"), (7, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5001)]
    docs += docs[:2]  # repeated rows
    assert found(spark, docs, block_rows=block_rows) == variants(docs)


def test_chains_of_forms_lead_to_the_last(spark):
    # slips depend on the document's number: one that leaves all of these words alone
    chain = ["abcdefgh", "abcdefgi", "abcdefgij", "abcdefghij"]
    number = next(d for d in range(10_000) if all(zlib.crc32(f"{d}:{w}".encode()) % 31 for w in chain))
    docs = [(number, " ".join([w] * 2 * 11**k)) for k, w in enumerate(["abcdefgh", "abcdefgi", "abcdefgij"])]
    got = {r[0]: r for r in found(spark, docs)}
    assert got["abcdefgh"][:3] == ("abcdefgh", "abcdefgi", "abcdefgij")
    assert got["abcdefgij"][1:3] == (None, "abcdefgij")


def test_a_half_that_all_words_share(spark):
    words = ["common" + a + b + c for a in "abcdef" for b in "abcde" for c in "xyz"]
    docs = [(k, " ".join(words)) for k in range(2)]
    for block_rows in (5, 40):
        assert found(spark, docs, block_rows=block_rows) == variants(docs)


def test_variants_of_empty_tables_and_other_columns(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, None), (None, None)]) == set()
    docs = [(1, "believe believe beleive believed believed")]
    more = spark.createDataFrame(docs, DOCS).select("*", *(F.lit(1).alias(c) for c in ("word", "n", "key", "run", "h", "block", "form", "root")))
    assert {tuple(r) for r in spelling.spelling_variants(more).collect()} == variants(docs)


def test_range_index_reports_rectangles():
    r = random.Random(4)
    words = sorted({"".join(r.choice("ab") for _ in range(9)) for _ in range(200)})
    index = spelling.RangeIndex(np.array([w.encode() for w in words], "S9"))
    backwards = sorted(w[::-1] for w in words)
    for _ in range(50):
        a, c = r.randrange(len(words)), r.randrange(len(words))
        b, d = r.randint(a, len(words)), r.randint(c, len(words))
        _, at = index.report(*(np.array([x]) for x in (a, b, c, d)))
        assert sorted(at) == [k for k in range(a, b) if words[k][::-1] in set(backwards[c:d])]
