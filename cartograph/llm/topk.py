"""Exact top-k search by inner product over an impact-ordered index (operator 1).

Components are quantised to integers.  A block of vectors is indexed by
postings: for every dimension the vectors in the order of their value, so that
the postings of one value are a segment and those beyond a value a run of
segments.  A batch of queries takes segments score at a time: all with an impact
|query component * value| above a level for some query of the batch, then those
above half that level, and so on; a row of accumulators holds a vector's scores
for the whole batch.  After a level every vector's score lies within the bound of
what is left: over dimensions, the largest positive and the largest negative
impact that is still open there.  A query leaves the batch only when that proves
which vectors can be among the k best, those whose bound reaches a score that k
vectors are known to have, and they are few; then they are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 64
K = 20
QUERY_EVERY = 20
#: Vectors of an index block.
BLOCK_ROWS = 16_384
#: Queries that one task searches in a block, at most, and tasks that are wanted at least.
BLOCK_QUERIES, TASKS = 65_536, 64
#: Queries that one task searches at least, if there are so many.
FEW_QUERIES = 256
#: Queries of a batch, which takes postings together, at most.
BATCH = 512
#: A search stops at so many possible members, times k, or at this share of the block.
POSSIBLE, SHARE = 8, 32
#: The first level, as a fraction of the largest impact.
FIRST_LEVEL = 4
#: Segments of so many postings on average are added whole, shorter ones in runs of RUN.
SEGMENT, RUN = 16, 1_024


def _longest(x: np.ndarray) -> float:
    """No row of x is longer than this."""
    return 1.000001 * float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))


def _turned(acc: np.ndarray, step: int = 64) -> np.ndarray:
    """The accumulators by query; a few rows at a time, which stay in the processor's cache."""
    out = np.empty(acc.shape[::-1], acc.dtype)
    for a in range(0, len(acc), step):
        out[:, a : a + step] = acc[a : a + step].T
    return out


class ImpactIndex:
    """Postings of a block of integer vectors (rows of x), by dimension and value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.widest = np.abs(x).max(axis=0, initial=0)
        self.top = int(self.widest.max(initial=0))
        self.length = _longest(x)
        columns = np.ascontiguousarray(x.T.astype(np.int16 if self.top < 1 << 15 else np.int64))
        self.docs = np.argsort(columns, axis=1, kind="stable")
        self.values = np.take_along_axis(columns, self.docs, axis=1)
        # first[d, v + top]: where the postings of dimension d with values from v on begin
        self.first = np.stack([np.searchsorted(v, np.arange(-self.top, self.top + 2)) for v in self.values]) if (2 * self.top + 1) * SEGMENT <= len(x) else None
        self.real = x.astype(np.float64)

    def _beyond(self, used: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each used dimension: the end of the postings with values up to -least, and the beginning of those from least on."""
        if self.first is not None:
            at = np.minimum(least, self.top + 1)
            return self.first[used, np.maximum(self.top + 1 - at, 0)], self.first[used, self.top + at]
        return np.array([np.searchsorted(self.values[d], -v, "right") for d, v in zip(used, least)], np.int64), np.array([np.searchsorted(self.values[d], v) for d, v in zip(used, least)], np.int64)

    def _take(self, acc: np.ndarray, d: int, begin: int, end: int, c: np.ndarray) -> None:
        """Add the impacts of the postings from begin to end of dimension d, where the queries have the components c."""
        if begin >= end:
            return
        docs, values = self.docs[d], self.values[d]
        if self.first is None:
            for a in range(begin, end, RUN):
                b = min(a + RUN, end)
                acc[docs[a:b]] += np.multiply.outer(values[a:b].astype(c.dtype), c)  # a vector has one posting in a dimension
            return
        v = int(values[begin])
        edges = self.first[d, v + self.top : int(values[end - 1]) + self.top + 2].tolist()
        for a, b in zip(edges, edges[1:]):
            if a < b:
                sums = acc.take(docs[a:b], axis=0)
                sums += c * c.dtype.type(v)
                acc[docs[a:b]] = sums
            v += 1

    def _scores(self, rows: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
        """Exact scores of rows; no sum of products is beyond most."""
        return (self.real[rows] @ q).astype(np.int64) if most < 1 << 53 else self.x[rows] @ q

    def possible(self, q: np.ndarray, k: int, skip: list) -> list[np.ndarray]:
        """For each of a batch of queries (rows of q) the rows that can be among its k best: a proof, not an estimate."""
        n, found = len(self.x), [np.arange(len(self.x))] * len(q)
        if n <= POSSIBLE * k:
            return found
        most = self.length * _longest(q)  # by Cauchy and Schwarz, of scores, of single impacts and of any sum of a vector's
        kind = next(t for t in (np.int16, np.int32, np.int64) if most < np.iinfo(t).max)
        acc = np.zeros((n, len(q)), kind)
        weights = np.abs(q).max(axis=0, initial=0)  # the largest impact of a posting is its value times this
        used = np.flatnonzero(weights)
        size, weights, widest = np.abs(q[:, used]), weights[used], self.widest[used]
        left, right = np.zeros(len(used), np.int64), np.full(len(used), n, np.int64)  # postings between these are open
        asked, known = np.arange(len(q)), [-1 << 62] * len(q)  # queries without a proof; scores that k rows are known to have
        level = int((weights * widest).max(initial=0)) // FIRST_LEVEL
        while len(asked):
            least = level // weights
            low, high = self._beyond(used, least + 1)
            high = np.maximum(low, high)
            for d, a, b, e, f in zip(used.tolist(), left.tolist(), low.tolist(), high.tolist(), right.tolist()):
                c = q[asked, d].astype(kind)
                self._take(acc, d, a, b, c)
                self._take(acc, d, e, f, c)
            left, right = low, high
            rest = size[asked] @ np.minimum(least, widest)  # open values are at most least
            proven = np.zeros(len(asked), bool)
            for i, (query, row, r) in enumerate(zip(asked.tolist(), _turned(acc), rest.tolist())):
                own = skip[query]
                if own is not None:
                    row[own] = np.iinfo(kind).min
                if r and r > row.max():  # too much is left for a proof
                    continue
                members = np.flatnonzero(row >= known[query] - r)
                if len(members) > max(POSSIBLE * k, n // SHARE):
                    ahead = np.argpartition(row, n - 2 * k)[n - 2 * k :]
                    scores = self._scores(ahead[ahead != own], q[query], most)
                    known[query] = max(known[query], int(np.sort(scores)[-k]))
                    members = np.flatnonzero(row >= known[query] - r)
                if not r or len(members) <= max(POSSIBLE * k, n // SHARE):
                    found[query], proven[i] = members, True
            acc, asked, level = np.compress(~proven, acc, axis=1), asked[~proven], level // 2  # acc[:, ~proven] would lie in memory by queries
        return found

    def search(self, q: np.ndarray, k: int, skip: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (rows of q) rows and scores of the k best vectors but its row of skip, ties to the smaller id, then the earlier row."""
        found = []
        for a in range(0, len(q), BATCH):
            batch, own = q[a : a + BATCH], skip[a : a + BATCH]
            most = self.length * _longest(batch)
            for y, s, rows in zip(batch, own, self.possible(batch, k, own)):
                rows = rows[rows != s] if s is not None else rows
                scores = self._scores(rows, y, most)
                best = np.lexsort((rows, self.ids[rows], -scores))[:k]
                found.append((rows[best], scores[best]))
        return found


def exhaustive(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
    """As ImpactIndex.search, of one query, for components whose products don't fit 64 bits: whole numbers of any size, scores held to the limits of 64 bits."""
    rows = np.array([r for r in range(len(x)) if r != skip], np.int64)
    scores = np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(x[r], q)))) for r in rows], np.int64)
    best = np.array(sorted(range(len(rows)), key=lambda r: (-int(scores[r]), ids[rows[r]], rows[r])), np.int64)[:k]
    return rows[best], scores[best]


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); vectors that are null or hold a null or non-finite component are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).where(finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of equal length; shorter vectors count as ending in zeros."""
    lists = column.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(n), dims), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n.tolist()] or [np.zeros(0, int)])] = flat
    return out


def exact_top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row whose vec_id is divisible by query_every its k best other rows.

    Every query meets every block of vectors in one task; the k best of each
    block are merged by query.  Rows with the same vec_id are rows of their own,
    as candidates and as queries; rows without one are candidates, last among
    ties.  Components and scores are held to the limits of 64 bits; other columns
    are ignored; an empty table, or one row, gives no rows.
    """
    rows = cut(quantised(vectors, scale).withColumn("rid", F.monotonically_increasing_id()))
    asked = F.coalesce(F.col("vec_id") % query_every == 0, F.lit(False))
    largest = F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.greatest(x, F.bitwise_not(x)))), F.lit(0)))
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if(asked).alias("queries"), largest.alias("largest")).first()
    width = next(t for t, n in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 64)) if (sizes["largest"] or 0) < 1 << n)
    blocks = max(1, -(-sizes["rows"] // block_rows))
    parts = max(1, -(-sizes["queries"] // block_queries), min(-(-sizes["queries"] // FEW_QUERIES), -(-TASKS // blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("i")
    part = F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(parts)).cast("int").alias("j")
    narrow = rows.select("rid", "vec_id", F.col("v").cast(f"array<{width}>").alias("v"))  # one byte a component as a rule
    left = narrow.select("rid", "vec_id", "v", block, every(parts).alias("j"))
    right = narrow.where(asked).select("rid", "vec_id", "v", part, every(blocks).alias("i"))
    none = np.iinfo(np.int64).max  # where a row without an id stands among ties

    def search(docs: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(docs) and len(queries):
            dims = max(1, *(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (docs, queries)))
            x, q = _matrix(docs.column("v"), dims), _matrix(queries.column("v"), dims)
            rid, ids = docs.column("rid").to_numpy(), docs.column("vec_id").fill_null(none).to_numpy()
            top = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (x, q)]
            index = ImpactIndex(ids, x) if 2 * dims * max(top) ** 2 < 1 << 62 else None
            place = {r: n for n, r in enumerate(rid.tolist())}
            asked = queries.column("rid").to_pylist()
            skip = [place.get(query) for query in asked]
            found = index.search(q, k, skip) if index else (exhaustive(x, ids, y, k, own) for y, own in zip(q, skip))
            for query, (at, scores) in zip(asked, found):
                out[0].append(np.full(len(at), query, np.int64))
                out[1].append(at)
                out[2].append(scores)
        empty = np.zeros(0, np.int64)
        query, at, score = (np.concatenate([empty, *x]) for x in out)
        return pa.table({"query": query, "rid": docs.column("rid").take(pa.array(at)), "vec_id": docs.column("vec_id").take(pa.array(at)), "score": score})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(search, "query long, rid long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "rid")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = narrow.where(asked).select(F.col("rid").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(names, "query").select("query_id", "rank", "vec_id", "score")
