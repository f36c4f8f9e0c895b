"""Best-fit-decreasing packing of documents into token sequences (operator 3).

Best fit decreasing looks only at lengths, and a length is one of 1..capacity.
So the documents are counted by length (one aggregation, at most ``capacity``
rows), best fit decreasing runs over those counts on the driver with a segment
tree over remaining capacities, and each document reads its place from the
result by its rank among the documents of its length.  No document passes
through the driver and the plan is exactly the one that document-by-document
best fit decreasing would make.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

MAX_TOKENS = 4096
END_ID = 1
#: Rows of one length and bucket that are ranked together in one task.
RANK_ROWS = 20_000
#: Words whose ids a Python worker keeps, at most.
CACHE_WORDS = 600_000
#: A stored number of each piece, by which pieces are dealt over tasks.
DEAL = "__deal"

_coders: dict[str, "WordCoder"] = {}


class WordCoder:
    """Token ids of whole texts, by a cache of white-space-separated chunks.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its chunks.  A letter or digit before ASCII punctuation is a
    boundary too: the tokenizer's pattern has no apostrophe-free case that
    crosses it.  Chunks that are not in the cache go through the tokenizer
    together, as one string, and token offsets say which chunk owns an id.
    """

    _between = re.compile(r"(?<=[A-Za-z0-9À-ÖØ-öø-ÿ])(?=[.,;:!?&%*$#|])")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {"": b""}

    def _learn(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 4000):
            part = chunks[at : at + 4000]
            ends = np.cumsum([len(c) + 1 for c in part])
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(coded.ids, dtype="<u4")
            starts = np.array([o[0] for o in coded.offsets], dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
            cuts = np.searchsorted(starts, ends)
            raw, before = ids.tobytes(), 0
            for c, e in zip(part, (4 * cuts).tolist()):
                self.cache[c] = raw[before:e]
                before = e

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        parted = text if "<|" in text else self._between.sub(" ", text)  # special tokens hold letters and punctuation
        chunks = parted.replace("\n", " ").split(" ")
        if len(self.cache) > CACHE_WORDS:
            self.cache = {"": b""}
        cache = self.cache
        if missing := set(chunks).difference(cache):
            self._learn(list(missing))
        return b"".join(map(cache.__getitem__, chunks))


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, unsigned 32-bit little-endian).

    A document's ids are followed by end_id; only longer documents are cut.
    A null text counts as empty (one piece that is end_id alone); a null doc_id
    stays null; repeated rows are packed each; other columns are ignored.
    """
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * max_tokens
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = words.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(raw), width)):
                    ids = raw[at : at + width]
                    out.append((doc, piece, at // 4, len(ids) // 4, zlib.crc32(ids), ids if keep_ids else None))
            if out:
                doc, piece, start, length, crc, ids = zip(*out)
                arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.binary())] * keep_ids, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut_up, schema)


class CapacityTree:
    """Segment tree over remaining capacities 0..size; a leaf is on while a bin with that capacity is open."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.on = bytearray(2 * self.leaves)

    def set(self, capacity: int, on: bool) -> None:
        k = self.leaves + capacity
        self.on[k] = on
        while k > 1:
            k >>= 1
            self.on[k] = self.on[2 * k] | self.on[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity that is at least ``least``, in logarithmic time."""
        k = self.leaves + least
        if self.on[k]:
            return least
        while k > 1:
            if not k & 1 and self.on[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.on[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts of lengths: rows (length, first_rank, per_sequence, first_sequence, offset).

    The documents of a length, from first_rank on, go per_sequence each into the
    sequences from first_sequence on, beginning at offset.
    """
    tree, open_bins, plan, sequences = CapacityTree(capacity), {}, [], 0

    def leave(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            open_bins.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fit = tree.tightest(length)
            if fit is None:  # open new sequences for all that are left
                fit, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = open_bins[fit].pop()
                if not open_bins[fit]:
                    tree.set(fit, False)
            per = fit // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, per, first, capacity - fit))
                leave(fit - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:  # fewer than one sequence would take
                plan.append((length, rank, per, first + full, capacity - fit))
                leave(fit - left * length, first + full, 1)
                leave(fit, first + full + 1, n - full - 1)
                left = 0
            elif full < n:
                leave(fit, first + full, n - full)
    return plan


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds rank, from 0 among the pieces of a length, without a task that holds a whole length: counts by (length, bucket) give each bucket's first rank."""
    buckets = max(1, -(-total // RANK_ROWS))
    by = [DEAL] if DEAL in pieces.columns else [c for c in pieces.columns if c != "length"]  # not by the id: it may be null or repeated
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    w = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranks = dealt.withColumn("rank", F.row_number().over(w) - 1)
    if buckets == 1:
        return ranks.drop("bucket")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return ranks.join(firsts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first")).drop("bucket", "first")


def pack(pieces: DataFrame, capacity: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces (a table whose rows stay the same when read again).

    Empty tables give no rows.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = sorted(best_fit_plan(counts, capacity))
    length, rank, per, first, offset = (np.array(x, dtype=np.int64) for x in (zip(*plan) if plan else [()] * 5))
    keys = (length << 44) | rank  # 2^44 pieces of one length
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset", DEAL)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, (n << 44) | r, "right") - 1
            r = r - rank[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(first[k] + r // per[k]), pa.array(offset[k] + r % per[k] * n)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in pieces.select(*columns).dtypes)
    return ranked(pieces.drop("sequence_id", "offset"), sum(counts.values())).withColumn("rank", F.col("rank").cast("long")).mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Tokenises documents, cuts the longer ones and packs the pieces by best fit decreasing."""
    return pack(cut(token_pieces(docs, tokenizer_path, max_tokens, end_id).withColumn(DEAL, F.monotonically_increasing_id())), max_tokens)
