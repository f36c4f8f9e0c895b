"""Toxicity by Levenshtein automata over a lexicon trie, with context windows (operator 5).

The lexicon is learned from labelled documents: words, and stems that many
toxic words begin with, that toxic documents have far more often than others.
A token is matched by running its Levenshtein automaton along the trie: the
automaton's states are carried down each branch and a branch is left as soon as
none of them can still accept.  Each match weighs its term's log odds, less for each
edit, and by a window of tokens around it: quotation marks and words of
reporting lower it, address and further matches raise it.  A logistic model over
few sums of those weights gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scoped, text_or_empty

#: Labelled rows that the model is fitted on, at most; those with the least hashes.
FIT_ROWS = 60_000
#: Log odds of a term, and its likelihood ratio against the base rate (twice the logarithm), at least; stems need STEM_RATIO.
MIN_LOG_ODDS = 2.5
MIN_RATIO = 25.0
STEM_RATIO = 40.0
#: A word with a stem of the lexicon needs less evidence of its own.
STEMMED_RATIO = 8.0
STEM_LENGTHS = (4, 5, 6, 7)
STEM_ENDINGS = 4
#: Tokens on either side of a match that count as its context.
WINDOW = 6
CACHE_TOKENS = 300_000
THRESHOLD = 0.7

# Words that report speech, and words that address someone.
REPORTING = frozenset(
    "said says say called calls quote quoted quoting cited cites word words term terms phrase reported reports alleged allegedly claims claimed wrote writes according definition means meaning"
    " sagte sagt nannte zitat zitierte zitiert wort wörter begriff berichtete berichtet angeblich behauptet schrieb laut bedeutet bedeutung"
    " dit disait appelé appelle citation cite cité mot mots terme rapporte rapporté prétend écrit selon définition signifie"
    " dijo dice llamó llama cita citó palabra palabras término informó presunto presuntamente afirma escribió según definición significa".split()
)
ADDRESS = frozenset("you your you're youre yourself u ur du dich dir dein deine ihr euch tu toi ton ta vous votre tú ti tu usted ustedes vosotros".split())
QUOTES = frozenset("\"'“”‘’«»„")

_token = re.compile(r"[^\W\d_][\w'’]*|[\"“”«»„]")
_stretched = re.compile(r"(.)\1{2,}")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Trie:
    """The lexicon; walk() intersects it with a token's Levenshtein automaton."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.root: dict = {"most": 0}
        pieces: dict[int, dict[str, list[tuple[int, int, int, int]]]] = {}
        for table, kind in ((terms, "$$"), (stems, "%%")):
            for term, weight in table.items():
                k, node = edits_allowed(term) if kind == "$$" else 0, self.root  # a stem stands for many words as it is
                node["most"] = max(node["most"], k)
                for ch in term:
                    node = node.setdefault(ch, {"most": 0})
                    node["most"] = max(node["most"], k)
                node[kind] = (weight, k)
                longest = len(term) + k if kind == "$$" else 1 << 30
                size = len(term) // (k + 1)
                for j in range(k + 1):  # k edits leave one of k + 1 pieces untouched, moved by k places at most
                    piece = term[j * size : (j + 1) * size] if j < k else term[j * size :]
                    pieces.setdefault(len(piece), {}).setdefault(piece, []).append((j * size - k, j * size + k, len(term) - k, longest))
        self.pieces = [(n, max(x[1] for y in at.values() for x in y) + 1, at) for n, at in sorted(pieces.items())]

    def may_match(self, token: str) -> bool:
        """Whether some term's piece is where it has to be, and the length fits: true for all tokens that walk() accepts."""
        size = len(token)
        for n, places, at in self.pieces:
            for i in range(min(places, size - n + 1)):
                if (found := at.get(token[i : i + n])) and any(lo <= i <= hi and least <= size <= longest for lo, hi, least, longest in found):
                    return True
        return False

    def walk(self, token: str) -> tuple[float, bool] | None:
        """The best match: weight, halved for each edit, and whether it is without edits (of a term, or of a stem).

        The automaton's states after e edits are the bits of an integer, bit i for
        i characters of the token that are read.
        """
        best: tuple[float, bool] | None = None
        end, same = 1 << len(token), {}
        for i, c in enumerate(token):
            same[c] = same.get(c, 0) | 1 << i
        full = 2 * end - 1
        stack = [(self.root, 1, 3 & full, 7 & full)]
        while stack:
            node, r0, r1, r2 = stack.pop()
            for mark in ("$$", "%%"):
                if mark in node:
                    weight, allowed = node[mark]
                    accepting = end if mark == "$$" else full
                    d = 0 if r0 & accepting else 1 if r1 & accepting else 2 if r2 & accepting else 3
                    if d <= allowed and (best is None or weight * 0.5**d > best[0]):
                        best = (weight * 0.5**d, not d)
            for ch, below in node.items():
                if len(ch) == 1:
                    on, most = same.get(ch, 0), below["most"]
                    s0 = (r0 & on) << 1
                    s1 = s2 = 0
                    if most:
                        s1 = ((r1 & on) << 1 | r0 | (r0 | s0) << 1) & full
                        if most > 1:
                            s2 = ((r2 & on) << 1 | r1 | (r1 | s1) << 1) & full
                    if s0 or s1 or s2:
                        stack.append((below, s0, s1, s2))
        return best


class Matcher:
    """Matches of the tokens of texts, with a bounded cache over tokens."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], harmless: frozenset[str]):
        self.trie, self.harmless = Trie(terms, stems), harmless
        self.hits: dict[str, tuple[float, bool]] = {}
        self.seen: set[str] = set()

    def match(self, token: str) -> tuple[float, bool] | None:
        """The token's best match as it is written, or, stretched, with runs of a letter made short."""
        found = self.trie.walk(token) if self.trie.may_match(token) else None
        if found is None and _stretched.search(token):
            for run in (r"\1", r"\1\1"):
                short = _stretched.sub(run, token)
                if found := self.trie.walk(short) if self.trie.may_match(short) else None:
                    return found
        return None if found and token in self.harmless else found

    def features(self, text: str) -> list[float]:
        tokens = _token.findall(text.lower())
        words = set(tokens)
        if len(self.seen) > CACHE_TOKENS:
            self.seen, self.hits = set(), {}
        for t in words - self.seen:
            if found := self.match(t):
                self.hits[t] = found
        self.seen |= words
        total = edited = quoted = aimed = most = 0.0
        if not words.isdisjoint(self.hits):
            at = [i for i, t in enumerate(tokens) if t in self.hits]
            for k, i in enumerate(at):
                weight, exact = self.hits[tokens[i]]
                near = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
                said = any(t in REPORTING for t in near)
                marked = bool(QUOTES.intersection(tokens[max(0, i - 3) : i]) and QUOTES.intersection(tokens[i + 1 : i + 4]))
                factor = 0.5**said * 0.3**marked
                if any(t in ADDRESS for t in near) or k and i - at[k - 1] <= WINDOW or k + 1 < len(at) and at[k + 1] - i <= WINDOW:
                    aimed += weight * factor
                quoted += weight * (1 - factor)
                if not exact:
                    edited += weight * factor
                total += weight * factor
                most = max(most, weight * factor)
        return [math.log1p(total), math.log1p(edited), most, math.log1p(quoted), math.log1p(aimed), math.log1p(100 * total / max(1, len(tokens)))]


N_FEATURES = 6
#: Weights that the model has where the sample says nothing: what is quoted speaks against toxicity, what is aimed at someone or comes in numbers for it.
PRIOR = (0.5, 0.0, 0.3, -0.5, 0.3, 0.5)


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, toxic and text of at most fit_rows labelled documents outside the held-out fold."""
    mine = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    mine = mine.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = mine.orderBy(F.xxhash64("doc_id", F.lit(5))).limit(fit_rows)  # bounded, so it can be broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float], frozenset[str]]:
    """Terms and stems with their log odds, and words near a term that documents without toxicity have.

    Documents that share the least hash of their word triples count once: copies of one toxic
    document shall not make its other words look toxic.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}][\\p{L}\\p{N}'\\u2019]*"), F.lit(0))
    rows = sample.select("doc_id", "toxic", words.alias("all"))
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - 3)), lambda i: F.xxhash64(F.get("all", i), F.get("all", i + 1), F.get("all", i + 2)))
    rows = rows.select("doc_id", "toxic", F.array_distinct("all").alias("words"), F.when(F.size("all") > 2, F.array_min(triples)).otherwise(F.xxhash64("doc_id")).alias("least"))
    rows = rows.groupBy("toxic", "least").agg(F.min_by("words", "doc_id").alias("words"))
    rows = cut(rows)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic:
        return {}, {}, frozenset()
    toxic = F.sum("toxic").cast("long").alias("toxic")
    table = cut(rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(toxic, F.count("*").alias("all")).withColumn("clean", F.col("all") - F.col("toxic")))

    def odds(t: str, c: str) -> F.Column:
        return F.log(((F.col(t) + 0.5) / (n_toxic + 1.0)) / ((F.col(c) + 0.5) / (n_clean + 1.0)))

    def ratio(t: str, c: str) -> F.Column:
        n, p = F.col(t) + F.col(c), n_toxic / (n_toxic + n_clean)
        part = lambda k, share: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * share))).otherwise(0.0)
        return 2 * (part(t, p) + part(c, 1 - p)) if n_clean else F.lit(0.0)

    weighed = table.withColumn("odds", odds("toxic", "clean")).withColumn("ratio", ratio("toxic", "clean"))
    starts = table.select("toxic", "clean", "word", F.explode(F.array(*map(F.lit, STEM_LENGTHS))).alias("n")).where(F.length("word") > F.col("n"))
    stem = starts.groupBy(F.expr("substring(word, 1, n)").alias("stem")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("endings"))
    stem = stem.withColumn("odds", odds("toxic", "clean")).withColumn("ratio", ratio("toxic", "clean"))
    stem = stem.where((F.col("endings") >= STEM_ENDINGS) & (F.col("ratio") >= STEM_RATIO) & (F.col("clean") <= F.col("toxic")))
    stems: dict[str, float] = {}
    for r in sorted(stem.orderBy(F.col("ratio").desc(), "stem").collect(), key=lambda r: (-r["odds"], len(r["stem"]), r["stem"])):
        if not any(r["stem"][:k] in stems for k in STEM_LENGTHS if k < len(r["stem"])):
            stems[r["stem"]] = r["odds"]
    stemmed = F.lit(False)
    for n in STEM_LENGTHS:
        if own := [x for x in stems if len(x) == n]:
            stemmed = stemmed | F.substring("word", 1, n).isin(own)
    good = weighed.where((F.col("odds") >= MIN_LOG_ODDS) & (F.length("word") >= 2) & (F.col("clean") <= F.col("toxic") * 0.05))
    good = good.where((F.col("ratio") >= MIN_RATIO) | stemmed & (F.col("ratio") >= STEMMED_RATIO))
    terms = {r["word"]: r["odds"] for r in good.orderBy(F.col("ratio").desc(), "word").collect()}
    matcher = Matcher(terms, stems, frozenset())

    def near_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in b.column(0).to_pylist() if w not in terms and matcher.match(w)], pa.string())], ["word"])

    # clean words within two edits of a term or with a stem: some of the words of fit_rows documents at most
    harmless = frozenset(r["word"] for r in table.where("clean > 0 and toxic <= clean").select("word").mapInArrow(near_terms, "word string").collect())
    return terms, stems, harmless


def logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = PRIOR, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Weights, the constant last, by damped Newton steps with a ridge penalty on what lies off the prior weights."""
    x = np.c_[x, np.ones(len(x))]
    middle = np.r_[prior, 0.0]
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * (w - middle) @ penalty @ (w - middle)
    w, before = middle.copy(), loss(middle)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - penalty @ (w - middle)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, g)
        while (after := loss(w + step)) > before and np.abs(step).max() > 1e-9:
            step /= 2
        if after > before or np.abs(step).max() < 1e-8:
            break
        w, before = w + step, after
    return w


def featured(docs: DataFrame, matcher: Matcher, keep: list[str]) -> DataFrame:
    """The columns in keep, and __features (array of doubles) of the text."""
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [matcher.features(t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(f, pa.list_(pa.float64()))], [*keep, "__features"])

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema)
    return docs.select(*keep, text_or_empty().alias("__text")).mapInArrow(run, f"{kinds}, __features array<double>")


class ToxicityModel:
    def __init__(self, terms: dict[str, float], stems: dict[str, float], harmless: frozenset[str], weights: np.ndarray):
        self.terms, self.stems, self.harmless, self.weights = terms, stems, harmless, weights

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """keep and __score, 0 to 1; a null text is empty and scored like one."""
        rows = featured(docs, Matcher(self.terms, self.stems, self.harmless), keep)
        z = F.lit(float(self.weights[-1]))
        for k in range(N_FEATURES):
            z = z + F.col("__features")[k] * F.lit(float(self.weights[k]))
        return rows.select(*keep, (1 / (1 + F.exp(-z))).alias("__score"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learns the lexicon and the model from at most fit_rows labelled rows outside the held-out fold; without labels every text scores 0.5 x base."""
    with scoped(docs.sparkSession):
        return _fit(cut(fit_sample(docs, labels, fit_rows)))


def _fit(sample: DataFrame) -> ToxicityModel:
    apart = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0  # the lexicon has not seen these, as it has not seen what it will score
    terms, stems, harmless = learn_lexicon(sample.where(~apart))
    rows = featured(sample.where(apart), Matcher(terms, stems, harmless), ["toxic"]).collect() if terms or stems else []  # at most fit_rows rows of numbers
    if len({r["toxic"] for r in rows}) < 2:
        return ToxicityModel(terms, stems, harmless, np.r_[PRIOR, -4.0])
    x, y = np.array([r["__features"] for r in rows]), np.array([float(r["toxic"]) for r in rows])
    weights = logistic(x, y)
    return ToxicityModel(terms, stems, harmless, weights)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for every document.

    Null and empty texts have no match and get the least score; repeated rows
    are scored each; an empty table gives no rows; null ids are in no fold.
    """
    model = fit(docs, labels, fit_rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = model.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    return rows.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score is below threshold, columns as they are."""
    model = fit(docs, labels)
    rows = model.score(docs, docs.columns)
    return rows.where(F.col("__score") < threshold).select(*docs.columns)

