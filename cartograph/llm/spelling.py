"""Spelling variants: words one edit apart, found by two-dimensional range reporting (operator 13).

Two words are one edit apart at position i if they share the prefix before i and
the suffix after it.  Among the words of one length, a prefix is an interval of
their forward order and a suffix an interval of the order of their reversals; a
word is the point (place forward, place in reverse), and a wavelet tree over the
points reports those in both intervals.  Replacements are looked for among words
of the same length, insertions among those that are one longer; deletions are
insertions seen from the longer word.

An edit lies in the first or in the second half of the shorter word, so the two
words share the other half whole.  Words are dealt to blocks by a hash of each
half; a block has one index for each length and side.  A half that very many
words share is cut into parts: each word is stored in one part and asks all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scoped

#: Letters of a word, as a regular expression's class.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences that a word has at least.
LENGTH, SEEN = 7, 2
#: One in so many runs loses a code point.
SLIP = 31
#: A form occurs at least so many times as often as the word.
TIMES = 10
#: Rows of a block, about; rows of one half beyond which it is cut into parts.
BLOCK_ROWS = 25_000
#: A half counts as shared by very many from this share of all rows on, if that is more than a block: so there are no more such halves than this.
MOST_HALVES = 10_000
#: Rectangles that are searched at a time.
CHUNK = 1 << 18


class RangeIndex:
    """Words of one length as points, in a wavelet tree from forward place to reverse place."""

    def __init__(self, words: np.ndarray):
        """words: distinct, in order, none empty, an array of bytes strings of one length."""
        self.words = words
        self.letters = _letters(self.words)
        backwards = np.ascontiguousarray(self.letters[:, ::-1])
        self.from_reverse = np.argsort(_strings(backwards), kind="stable")
        self.backwards = backwards[self.from_reverse]
        left = np.empty(len(words), np.int64)
        left[self.from_reverse] = np.arange(len(words))
        self.bits = max(1, int(len(words) - 1).bit_length())
        self.zeros = []  # for each level: how many of the first k values have a 0 there
        for b in range(self.bits - 1, -1, -1):
            one = (left >> b) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            left = np.concatenate([left[~one], left[one]])

    def interval(self, keys: np.ndarray, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For rows of letters: the places whose words begin (reverse: end, keys being reversed) with them."""
        k = keys.shape[1]
        if not k:
            return np.zeros(len(keys), np.int64), np.full(len(keys), len(self.words), np.int64)
        own, asked = _strings((self.backwards if reverse else self.letters)[:, :k]), _strings(keys)
        return np.searchsorted(own, asked, "left"), np.searchsorted(own, asked, "right")

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rectangles of forward places low..high and reverse places least..upto (ends excluded): number of the rectangle, forward place of the word."""
        open_ = np.flatnonzero((low < high) & (least < upto))
        found: tuple[list, list] = ([], [])
        for at in range(0, len(open_), CHUNK):
            q = open_[at : at + CHUNK]
            a, b, base = low[q], high[q], np.zeros(len(q), np.int64)
            for level, zeros in enumerate(self.zeros):
                half = 1 << (self.bits - 1 - level)
                a0, b0 = zeros[a], zeros[b]
                q, a, b, base = np.concatenate([q, q]), np.concatenate([a0, zeros[-1] + a - a0]), np.concatenate([b0, zeros[-1] + b - b0]), np.concatenate([base, base + half])
                go = (a < b) & (base < upto[q]) & (base + half > least[q])
                q, a, b, base = q[go], a[go], b[go], base[go]
            found[0].append(q)
            found[1].append(self.from_reverse[base])
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in found)


def _letters(words: np.ndarray) -> np.ndarray:
    return words.view(np.uint8).reshape(len(words), -1)


def _strings(letters: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel()


def replaced(asked: np.ndarray, index: RangeIndex, positions: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (number of the asked word, place in the index): another word that differs in one of the positions alone."""
    letters = _letters(asked)
    for i in positions:
        q, at = index.report(*index.interval(letters[:, :i]), *index.interval(letters[:, :i:-1], reverse=True))
        other = index.words[at] != asked[q]
        yield q[other], at[other]


def inserted(asked: np.ndarray, index: RangeIndex, positions: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (number of the asked word, place in the index): a word with one more letter, at one of the positions; each pair once.

    A letter may be taken as inserted anywhere in a run of its like; the first place counts.
    """
    letters = _letters(asked)
    size = letters.shape[1]
    for i in positions:
        q, at = index.report(*index.interval(letters[:, :i]), *index.interval(letters[:, ::-1][:, : size - i], reverse=True))
        first = index.letters[at, i] != letters[q, i - 1] if i else np.ones(len(q), bool)
        yield q[first], at[first]


def near_in_block(words: list[bytes], n: np.ndarray, kind: np.ndarray, asks: np.ndarray, held: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
    """word, near words, occurrences of the best of these, the best: for each word with near ones in the block.

    kind is 4 * size + 2 * side + longer, size and side those of the shorter
    word; longer words are held, shorter ones ask, and are held as told.
    """
    names = sorted(set(words))
    place = {w: k for k, w in enumerate(names)}
    ids = np.array([place[w] for w in words], np.int64)
    often = np.zeros(len(names), np.int64)
    often[ids] = n
    of = lambda x, size: np.array([names[k] for k in x.tolist()], f"S{size}")
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(kind[asks]).tolist():
        size, half = k >> 2, (k >> 2) // 2
        asked = np.unique(ids[(kind == k) & asks])
        for own, search, end in ((np.unique(ids[(kind == k) & held]), replaced, size), (np.unique(ids[kind == k + 1]), inserted, size + 1)):
            if len(own):
                index = RangeIndex(of(own, end))
                for q, at in search(of(asked, size), index, range(half, end) if k & 2 else range(half)):
                    a.append(asked[q])
                    b.append(own[at])
                    if search is inserted:
                        a.append(own[at])
                        b.append(asked[q])
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((b, -often[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    return [names[k] for k in a[first]], np.diff(np.append(first, len(a))), often[b[first]], [names[k] for k in b[first]]


def words(docs: DataFrame, least: int = LENGTH, seen: int = SEEN) -> DataFrame:
    """word, n: the runs of letters of all texts, lower-cased in A-Z; one in SLIP by the hash of "<doc_id>:<run>" loses a code point."""
    # a run of fewer letters can't give a word, so the least length is part of the pattern
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.select("d", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def dealt(vocabulary: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """block, kind, word (in Latin-1), n, asks, held: for each word its two halves as the shorter and as the longer word."""
    size, text = F.length("word"), F.col("word")

    def role(longer: int, side: int) -> Column:
        shorter = size - longer
        half = F.floor(shorter / 2).cast("int")
        shared = F.substring(text, F.lit(1), half) if side else F.substring(text, half + longer + 1, size)
        return F.struct((4 * shorter + 2 * side + longer).alias("kind"), F.lit(longer == 1).alias("longer"), F.xxhash64(shorter, F.lit(side), shared).alias("key"))

    rows = vocabulary.select("word", "n", F.explode(F.array(*(role(longer, side) for longer in (0, 1) for side in (0, 1)))).alias("r")).select("word", "n", "r.*")
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows"))
    total = rows.agg(F.count("*")).first()[0]
    crowded = sizes.where(F.col("rows") > max(block_rows, total // MOST_HALVES)).select("key", F.ceil(F.col("rows") / block_rows).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(crowded), "key", "left")  # MOST_HALVES rows at most
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    rows = rows.withColumn("own", own).withColumn("part", F.explode(F.when(F.col("longer"), F.array(own)).otherwise(F.sequence(F.lit(0), parts - 1))))
    blocks = max(1, -(-total // block_rows))
    block = F.pmod(F.xxhash64("key", "part"), F.lit(blocks)).cast("int").alias("block")
    return rows.select(block, "kind", F.encode("word", "ISO-8859-1").alias("word"), "n", (~F.col("longer")).alias("asks"), (F.col("own") == F.col("part")).alias("held"))


def near_words(vocabulary: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """word, n_near, often, best: for each word with near ones their number, and the one of most occurrences (ties: the least)."""

    def search(block: pa.Table) -> pa.Table:
        word, near, often, best = near_in_block(block.column("word").to_pylist(), *(block.column(c).to_numpy() for c in ("n", "kind", "asks", "held")))
        text = lambda x: pa.array([w.decode("latin-1") for w in x], pa.string())
        return pa.table({"word": text(word), "near": pa.array(near, pa.int64()), "often": pa.array(often, pa.int64()), "best": text(best)})

    found = dealt(vocabulary, block_rows).groupBy("block").applyInArrow(search, "word string, near long, often long, best string")
    first = F.min(F.struct((-F.col("often")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("often"), "first.best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of a word lead to, by pointer doubling.

    A form occurs TIMES as often as its word, so ways have 19 steps at most and
    no cycles: five rounds at most.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        moved = cut(at.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the documents.

    A null text has no words, a null doc_id is written as nothing in the hash,
    repeated rows count as documents of their own, an empty table has no words;
    words of any length are taken whole; columns other than doc_id and text are
    ignored.
    """
    with scoped(docs.sparkSession):
        vocabulary = cut(words(docs), keep=True)
        near = near_words(vocabulary, block_rows)
        often = F.col("often") >= TIMES * F.col("n")
        out = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best")).alias("form"), F.when(often, F.col("often")).alias("form_n"))
        out = cut(out, keep=True)
        leads = cut(roots(out.where("form IS NOT NULL")), keep=True)
    return out.join(leads, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
