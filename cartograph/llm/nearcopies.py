"""Near copies by exact similarity: the shares of five-word shingles of two texts decide, not their fingerprints.

Pairs are proposed by operator 7 (fingerprints within its bits) and by MinHash:
BANDS cells of ROWS minima each, which two sets of Jaccard similarity s share
with probability 1 - (1 - s**ROWS)**BANDS, over 0.99999 from 0.8 on.  (The grid of
fingerprints would need about 14 bits for that, where cells follow from so few
segments that their members, and with these the comparisons, grow with the
square of the input.)  Cells of the same members are searched once: breadth
first, every comparison an exact count of common shingles.  Texts with equal
sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, text_or_empty

SHINGLE = 5
#: Least similarity of a near copy, as a fraction.
LEAST = (4, 5)
ROWS, BANDS = 4, 24
#: Shingles whose minima are taken at a time.
CHUNK = 1 << 12
#: Shingles of a cell's members that one task searches together.
CELL_SHINGLES = 8_000_000

_random = np.random.default_rng(20_2611)
_XOR = _random.integers(0, 1 << 64, ROWS * BANDS, np.uint64)
_TIMES = _random.integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of the text's shingles, each once, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *simhash.shingle_hashes(text, SHINGLE)]))


def cells_of(members: np.ndarray) -> np.ndarray:
    """The BANDS cells of a set; none if it is empty."""
    if not len(members):
        return np.zeros(0, np.int64)
    least = np.min([((members[at : at + CHUNK, None] ^ _XOR) * _TIMES).min(axis=0) for at in range(0, len(members), CHUNK)], axis=0)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def near(common: np.ndarray, a: np.ndarray, b: int) -> np.ndarray:
    """Whether sets of sizes a and b with so many common members are near copies."""
    return LEAST[1] * common >= LEAST[0] * (a + b - common)


def connect(sets: list[np.ndarray], node: np.ndarray) -> tuple[list, list]:
    """Links that connect the near copies among sets (none empty): breadth first, each member found once."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return ([node[0]], [node[1]]) if near(n, len(sets[0]), len(sets[1])) else ([], [])
    size = np.array(list(map(len, sets)))
    at = np.r_[0, np.cumsum(size)]
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    left, a, b = np.arange(len(sets)), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            its = np.zeros(len(names), np.int64)
            its[code[at[x] : at[x + 1]]] = 1
            found = near(np.add.reduceat(its[code], at[:-1])[left], size[left], size[x])
            if found.any():
                queue.extend(left[found].tolist())
                a.extend([node[x]] * int(found.sum()))
                b.extend(node[left[found]].tolist())
                left = left[~found]
    return a, b


def signatures(rows: DataFrame) -> DataFrame:
    """__uid, doc_id, fp (operator 7's fingerprint), key (hash of the set), size and cells of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            key, size, cells = np.zeros(len(texts), np.uint64), [], []
            for k, t in enumerate(texts):
                members = shingle_set(t)
                key[k] = xxhash.xxh64_intdigest(members.tobytes(), 7)
                size.append(len(members))
                cells.append(cells_of(members))
            ends = np.r_[0, np.cumsum(list(map(len, cells)))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *cells])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp), pa.array(key.view(np.int64)), pa.array(size, pa.int64()), lists], ["__uid", "doc_id", "fp", "key", "size", "cells"])

    schema = "__uid long, doc_id long, fp long, key long, size long, cells array<long>"
    return rows.select("__uid", F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def sets_of(rows: DataFrame) -> DataFrame:
    """cell, node (the row's number) and its set as bytes, for each of a row's cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, text, cells in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                members = shingle_set(text.as_py()).tobytes()
                for at in range(0, len(cells), 500):
                    part = cells[at : at + 500]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([node] * len(part), pa.int64()), pa.array([members] * len(part), pa.binary())], ["cell", "node", "members"])

    return rows.select("__uid", text_or_empty().alias("text"), "cells").mapInArrow(run, "cell long, node long, members binary")


def proposed(nodes: DataFrame) -> DataFrame:
    """node, cell, shingles (of all the cell's members): cells of two members or more, one of those with the same members."""
    by_fp = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(by_fp, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    pairs = simhash.links(by_fp.select(F.col("least").alias("node"), "fp")).unionByName(same)
    ends = pairs.select(F.xxhash64("a", "b", F.lit("pair")).alias("cell"), F.explode(F.array("a", "b")).alias("node")).join(nodes.select("node", "size"), "node")
    cells = cut(nodes.select("node", "size", F.explode("cells").alias("cell")).unionByName(ends.select("node", "size", "cell")).where("size > 0"))
    known = cells.groupBy("cell").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("m"), F.sum("size").alias("shingles")).where("n > 1")
    once = known.groupBy("n", "x", "m").agg(F.min("cell").alias("cell"), F.first("shingles").alias("shingles"))
    return cells.join(once.select("cell", "shingles"), "cell").select("node", "cell", "shingles")


def links(members: DataFrame, rows: DataFrame, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """a, b: links that connect the near copies among each cell's members; crowded cells are split into chunks and searched by pairs of chunks."""
    n = F.ceil(2 * F.col("shingles") / cell_shingles).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), n).cast("int")
    by_chunk = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.xxhash64("cell", F.least(own, j), F.greatest(own, j)))
    dealt = members.select("node", F.when(F.col("shingles") > cell_shingles, by_chunk).otherwise(F.array("cell")).alias("cells"))
    dealt = dealt.groupBy(F.col("node").alias("__uid")).agg(F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells"))
    # texts go to their cells, then sets to the tasks, in the same way at every size
    sets = sets_of(rows.select("__uid", "text").join(dealt.hint("shuffle_hash"), "__uid"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, node, held = None, [], []

        def flush():
            a, b = connect(held, np.array(node)) if len(node) > 1 else ([], [])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for c, x, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if c != cell:
                    yield from flush()
                    cell, node, held = c, [], []
                node.append(x)
                held.append(np.frombuffer(m.as_py(), np.uint64))
        yield from flush()

    return sets.repartition("cell").sortWithinPartitions("cell").select("cell", "node", "members").mapInArrow(search, "a long, b long").distinct()


def firsts(rows: DataFrame) -> DataFrame:
    """__uid of the row that stays of each group of near copies: that of the smallest doc_id (null last).

    rows have stored numbers (common.numbered).  Groups are what links reach;
    texts without words are copies of each other.
    """
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "__uid")
    made = cut(signatures(rows)).groupBy("key").agg(F.min(place).alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("cells").alias("cells"))
    nodes = cut(made.withColumn("node", F.col("first.__uid")))
    members = cut(proposed(nodes))
    found = simhash.components(links(members, rows))
    groups = nodes.select("node", "first").join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("group"))
    return groups.agg(F.min("first").alias("first")).select("first.__uid")
