"""Histogram sort of documents into shards of near-equal bytes (operator 6).

The sort key is (hash of the text, doc_id, number of the row): equal texts lie together, and every row has a key of its own.  The
splitters between shards come from rounds of exact counting: each round adds up
the bytes below a set of probe keys in all partitions at once, keeps for each
splitter the interval that still holds its target, and lays new probes in it,
until the bytes below a probe are within the tolerance or the interval holds one
row.  A splitter inside a group of equal texts moves to the group's edge if that
is near, so that only groups which are large beside a shard are cut.  Then the rows are exchanged once, by slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

SHARDS = 24
#: Bytes by which a splitter may miss its target, as a share of a shard.
TOLERANCE = 0.0005
#: Probes for each open splitter and round.
PROBES = 32
#: Rows of a slice of a shard that one task orders.
SLICE_ROWS = 4_000_000
#: A splitter moves to the edge of a group of equal texts if that costs no more than this share of a shard.
GROUP_TOLERANCE = 0.01

#: Digits of a key, and its bits below the text's hash.
DIGITS, BELOW = 48, 128
_LOW, _HIGH = 0, 1 << 4 * DIGITS


def _text_key(key: int) -> str:
    return f"{key:0{DIGITS}x}"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key: hexadecimal digits that order rows by text hash, then doc_id (null first), then a number for the row; to be stored at once."""
    text = F.col("text").cast("string")
    flip = F.lit(-(1 << 63))
    hexed = lambda c: F.lower(F.lpad(F.hex(c.bitwiseXOR(flip)), 16, "0"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.concat(hexed(F.xxhash64(text_or_empty())), hexed(F.coalesce(F.col("doc_id").cast("long"), flip)), hexed(F.monotonically_increasing_id())).alias("key"),
    )


def _counted(rows: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """For each gap between probes that has rows: bytes, rows, least and greatest key.  Partial sums by task, then one small aggregation."""
    edges = np.array([_text_key(p).encode() for p in probes], dtype=f"S{DIGITS}")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            if not len(b):
                continue
            keys = np.array(b.column("key").to_pylist(), dtype=f"S{DIGITS}")
            size = b.column("size").to_numpy(zero_copy_only=False)
            gap = np.searchsorted(edges, keys, "right")
            order = np.lexsort((keys, gap))
            gap, keys, size = gap[order], keys[order], size[order]
            at = np.flatnonzero(np.r_[True, gap[1:] != gap[:-1]])
            for g, s, n, lo, hi in zip(gap[at].tolist(), np.add.reduceat(size, at).tolist(), np.diff(np.r_[at, len(gap)]).tolist(), keys[at].tolist(), keys[np.r_[at[1:], len(gap)] - 1].tolist()):
                x = total.setdefault(g, [0, 0, lo, hi])
                x[0], x[1], x[2], x[3] = x[0] + s, x[1] + n, min(x[2], lo), max(x[3], hi)
        if total:
            g, v = zip(*total.items())
            s, n, lo, hi = zip(*v)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array([x.decode() for x in lo]), pa.array([x.decode() for x in hi])], ["gap", "bytes", "n", "low", "high"])

    found = rows.select("key", "size").mapInArrow(add_up, "gap long, bytes long, n long, low string, high string")
    summed = found.groupBy("gap").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return {r["gap"]: (r["bytes"], r["n"], int(r["low"], 16), int(r["high"], 16)) for r in summed.collect()}  # at most one row a probe


def splitters(rows: DataFrame, shares: list[float], tolerances: list[float], probes_each: int = PROBES) -> list[int]:
    """Keys below which the given numbers of bytes lie, each within its tolerance or within one row.

    An open splitter has an interval [low, high] of keys that rows have, and the
    bytes below it.  A round lays probes evenly over all open intervals and
    counts exactly; intervals shrink to keys that occur, so a group of equal
    hashes costs one round and is then split by doc_id, one of equal ids by the rows' numbers.
    """
    first = _counted(rows, [])
    if not first:
        return [_HIGH] * len(shares)
    _, _, low, high = first[0]
    state = {k: (low, high, 0) for k in range(len(shares))}  # least and greatest key that it can lie between, bytes below low
    done: dict[int, int] = {}
    while state:
        probes: set[int] = set()
        for low, high, _ in set(state.values()):
            probes.add(low)
            probes.update(low + (high + 1 - low) * i // (probes_each + 1) for i in range(1, probes_each + 1))
            probes.add(high + 1)
        edges = sorted(probes)
        gaps = _counted(rows, edges)
        below = np.cumsum([gaps.get(g, (0,))[0] for g in range(len(edges))]).tolist()  # bytes below each edge
        for k in list(state):
            # the first gap whose end reaches the target
            lo, hi = 0, len(edges) - 1
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if below[mid] >= shares[k] else (mid + 1, hi)
            under = below[lo - 1] if lo else 0
            if abs(below[lo] - shares[k]) <= tolerances[k] or lo == 0:
                done[k] = edges[lo]
            elif abs(under - shares[k]) <= tolerances[k]:
                done[k] = edges[lo - 1]
            else:
                _, n, low, high = gaps[lo]
                if low == high:  # one key: the nearer side
                    done[k] = high + 1 if below[lo] - shares[k] <= shares[k] - under else low
                else:
                    state[k] = (low, high, under)
                    continue
            del state[k]
    return [done[k] for k in range(len(shares))]


def at_edges(rows: DataFrame, found: list[int], shares: list[float], most: float) -> list[int]:
    """The splitters, each moved to the nearer edge of the group of equal text hashes that it lies in, if that is off its share by ``most`` or less."""
    edges = sorted({edge for key in found if key < _HIGH for edge in (key >> BELOW << BELOW, ((key >> BELOW) + 1) << BELOW) if edge < _HIGH})
    if not edges:
        return found
    gaps = _counted(rows, edges)
    below = dict(zip(edges, np.cumsum([gaps.get(g, (0,))[0] for g in range(len(edges))]).tolist()))
    out = []
    for key, share in zip(found, shares):
        near = [(abs(below[e] - share), e) for e in (key >> BELOW << BELOW, ((key >> BELOW) + 1) << BELOW) if e in below]
        off, edge = min(near, default=(most + 1, key))
        out.append(edge if off <= most else key)
    return out


def histogram_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of near-equal bytes in key order, slots gapless from 0.

    Null texts have size 8; repeated rows and null ids are rows like others, so
    the law holds for any ids; equal texts lie in one shard but for groups that
    are large beside it; an empty table gives no rows; shards that no row falls
    into (fewer rows than shards) are empty.
    """
    rows = cut(keyed(docs))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    slices = max(1, -(-total["n"] // (shards * slice_rows)))
    each = total["b"] / (shards * slices)
    tight, loose = tolerance * each * slices, 0.25 * each
    at = range(1, shards * slices)
    found = splitters(rows, [k * each for k in at], [loose if k % slices else tight for k in at])
    cuts = at_edges(rows, found[slices - 1 :: slices], [k * each for k in at if k % slices == 0], GROUP_TOLERANCE * each * slices)
    bounds = [_LOW, *cuts, _HIGH]
    found = [cuts[k // slices - 1] if k % slices == 0 else min(max(key, bounds[k // slices]), bounds[k // slices + 1]) for k, key in zip(at, found)]
    edges = np.array([_text_key(min(key, _HIGH - 1)) for key in found], dtype=f"S{DIGITS}")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array(b.column("key").to_pylist(), dtype=f"S{DIGITS}")
            part = np.searchsorted(edges, keys, "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((part // slices).astype(np.int32)), pa.array(part.astype(np.int64))], ["doc_id", "size", "text_crc32", "key", "shard", "slice"])

    dealt = rows.mapInArrow(deal, "doc_id long, size long, text_crc32 long, key string, shard int, slice long")
    out = dealt.withColumn("slot", F.row_number().over(Window.partitionBy("slice").orderBy("key")).cast("long") - 1)
    if slices > 1:
        before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        firsts = dealt.groupBy("shard", "slice").count().select("slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
        out = out.join(firsts, "slice").withColumn("slot", F.col("slot") + F.col("first"))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
