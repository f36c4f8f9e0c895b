"""SimHash near-duplicates by segment popcounts (operator 7).

A fingerprint's 32 two-bit segments are mapped to their popcounts.  The Manhattan
distance of two such vectors is at most the Hamming distance of the fingerprints,
so fingerprints at ``most`` or fewer differing bits lie within ``most`` of each
other in the popcount grid.  The segments form most + 2 groups (more for large
inputs, so that cells stay small); of those at least two have distance 0, so both
fingerprints share the grid cell that is made of the popcounts of some two groups
(or as many more as there are groups more).  Within a cell, the whole vectors'
Manhattan distance filters and the Hamming distance decides.

A cell gives links that connect what belongs together, fewer than it has
members, never all pairs: a breadth-first search takes its members off a
shrinking list.  Cells above ``cell_rows`` members are split into chunks and
searched by pairs of chunks, which finds the same components.  Equal
fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scoped, text_or_empty

SHINGLE = 4
BITS = 4
#: Members of a grid cell that one task searches together.
CELL_ROWS = 50_000
#: Crowded cells that are told to every task, at most; more are joined by hash, each dealt over SALTS tasks.
MOST_BROADCAST, SALTS = 10_000, 16
#: Numbers of fingerprints beyond which cells are made of one more group of segments: 16, 20, 24, 27 bits of popcounts.
FINER = (1 << 21, 1 << 26, 1 << 30)
#: Shingles whose bits are added up at a time.
CHUNK = 1 << 16

_ODD = np.uint64(0x5555555555555555)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of the text's shingles in order, CHUNK at a time; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words)) - 1
    starts, ends = starts[: len(words) - k].tolist(), ends[k:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], dtype="<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit k is set if it is set in over half of the hashes of the text's shingles."""
    total, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The popcounts of the 32 segments, two bits each."""
    return (fp & _ODD) + ((fp >> np.uint64(1)) & _ODD)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of popcount vectors: a field's difference is 1 where its low bits differ, 2 where only its high bits do."""
    x = a ^ b
    low = x & _ODD
    high = (x >> np.uint64(1)) & _ODD & ~low
    return np.bitwise_count(low) + 2 * np.bitwise_count(high)


def cell_masks(most: int = BITS, equal: int = 2) -> list[int]:
    """Masks over the popcount vector, one for each ``equal`` of the most + equal groups of segments."""
    edges = [32 * g // (most + equal) for g in range(most + equal + 1)]
    groups = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(some) for some in combinations(groups, equal)]


def connect(fp: np.ndarray, node: np.ndarray, most: int, sides: np.ndarray | None = None) -> tuple[list, list]:
    """Links (lesser node, other node) that connect the members within ``most`` bits: breadth first, each member found once."""
    pop, left, a, b = popcounts(fp), np.arange(len(fp)), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = manhattan(pop[left], pop[x]) <= most
            near[near] = np.bitwise_count(fp[left[near]] ^ fp[x]) <= most
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found.tolist())
                a.extend([node[x]] * len(found))
                b.extend(node[found].tolist())
    return a, b


def _small_links(cell: np.ndarray, fp: np.ndarray, node: np.ndarray, most: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within cells of at most ``span`` members: rows sorted by cell, compared with those 1, 2, ... further on."""
    pop, a, b = popcounts(fp), [], []
    for d in range(1, span):
        same = np.flatnonzero(cell[d:] == cell[:-d])
        if not len(same):
            break
        same = same[manhattan(pop[same], pop[same + d]) <= most]
        same = same[np.bitwise_count(fp[same] ^ fp[same + d]) <= most]
        a.append(node[same])
        b.append(node[same + d])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(nodes: DataFrame, most: int = BITS, cell_rows: int = CELL_ROWS, finer: tuple[int, ...] = FINER) -> DataFrame:
    """a, b: links between nodes (columns node, fp; fp distinct) that give the same components as all pairs within ``most`` bits."""
    n = nodes.count()
    masks = [int(np.uint64(m).astype(np.int64)) for m in cell_masks(most, 2 + sum(n > least for least in finer))]
    even, odd = F.col("fp").bitwiseAND(int(_ODD)), F.shiftrightunsigned("fp", 1).bitwiseAND(int(_ODD))
    pop = even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))  # their sum in each two bits, without carries that overflow
    cells = nodes.select("node", "fp", pop.alias("pop")).select("node", "fp", F.posexplode(F.array(*(F.xxhash64(F.lit(k), F.col("pop").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)))).alias("k", "cell"))
    cells = cells.select("node", "fp", "cell")
    crowded = cells.groupBy("cell").count().where(F.col("count") > cell_rows)
    crowded = cut(crowded.select("cell", F.ceil(2 * F.col("count") / cell_rows).cast("int").alias("chunks")))
    if not crowded.isEmpty():  # members of a crowded cell go to every pair of chunks that has theirs
        if crowded.count() <= MOST_BROADCAST:
            cells = cells.join(F.broadcast(crowded), "cell", "left")
        else:
            salted = crowded.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
            cells = cells.withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(2)), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["cell", "salt"], "left").drop("salt")
        n = F.col("chunks")
        own = F.pmod(F.xxhash64("fp", F.lit(1)), n).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.xxhash64("cell", F.least(own, j), F.greatest(own, j)))
        cells = cells.select("node", "fp", F.explode(F.when(n.isNull(), F.array("cell")).otherwise(pairs)).alias("cell"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(cell, fp, node):
            if len(cell) < 2:
                return None
            at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            n = np.diff(np.r_[at, len(cell)])
            small = np.repeat(n <= 16, n)
            a, b = _small_links(cell[small], fp[small], node[small], most, 16)
            big_a, big_b = [], []
            for s, m in zip(at[n > 16].tolist(), n[n > 16].tolist()):
                x, y = connect(fp[s : s + m], node[s : s + m], most)
                big_a += x
                big_b += y
            a, b = np.r_[a, np.array(big_a, np.int64)], np.r_[b, np.array(big_b, np.int64)]
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            cell, fp, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "node"))
            last = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if held and (last or held[0][0][0] != cell[0]):
                held.append((cell[:last], fp[:last].view(np.uint64), node[:last]))
                out = flush(*(np.concatenate(x) for x in zip(*held)))
                held = []
                if out is not None:
                    yield out
            elif not held and last:
                out = flush(cell[:last], fp[:last].view(np.uint64), node[:last])
                if out is not None:
                    yield out
            held.append((cell[last:], fp[last:].view(np.uint64), node[last:]))
        if held:
            out = flush(*(np.concatenate(x) for x in zip(*held)))
            if out is not None:
                yield out

    dealt = cells.repartition("cell").sortWithinPartitions("cell").select("cell", "fp", "node")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node that has a link: alternating large and small stars until nothing changes.

    Each round is one exchange by node with sums made before it; a hub's
    neighbours are only ever compared with its least neighbour.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = cut(after)
        # a forest of stars: no node is both a leaf and a centre, and every leaf has one centre
        state = after.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        if state["n"] == state["d"] and after.join(after.select(F.col("u").alias("c")), F.col("v") == F.col("c"), "left_semi").isEmpty():
            break
        edges = after
    leaves = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = BITS) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per document.

    component_id is the smallest doc_id that is reachable; rows that share a
    doc_id are linked by their texts only.  Texts without words
    have fingerprint zero, which links like any other; repeated rows come out as
    often as they are there; rows whose doc_id is null keep a null component
    unless they share a component with a numbered row; an empty table gives none.
    """
    with scoped(docs.sparkSession):
        fps = cut(fingerprints(docs, shingle), keep=True)
        nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
        found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), most))  # fingerprints are the nodes: ids may be null or repeated
        ids = cut(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
        ids = cut(ids.join(ids.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id"), keep=True)
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(ids, "fp").select("doc_id", text, "component_id")
