"""Compression of vectors to codes by Yinyang Lloyd (operator 11).

Components become integers, vectors are cut into equal parts, and each part
position has a codebook.  The entries of a codebook are clustered into groups
once.  A part keeps its entry and, for each group, one lower bound on the
distance to any other entry of that group.  In a round the bounds fall by the
farthest that an entry of the group has moved; the distance to the part's own
entry is computed, and only groups whose bound does not lie above it are
scanned.  Scans compare whole numbers, so that ties are told exactly; bounds are
rounded down and distances up, so that a group is passed over only on proof.

A round is one pass over a stored table of vectors and bounds that writes the
next one, with each partition's sums by entry among its rows.  The driver gets
the total sums: as many numbers as the codebooks have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scoped

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Groups of a codebook's entries.
GROUPS = 4
#: Relative slack of bounds, far more than double precision rounds.
SLACK = 1e-9
#: Labels with more than this share of the rows are heavy, so there are fewer of them than this.
HEAVY = 10_000
_MOST = (1 << 63) - 1


class Codebooks:
    """Entries of all parts (parts x entries x components), their groups, and how far they moved last."""

    def __init__(self, entries: list[list[list[int]]], groups: list[np.ndarray] | None = None, before: Codebooks | None = None):
        self.entries = [np.array(e, object) for e in entries]
        self.groups = [grouped(e) for e in self.entries] if groups is None else groups
        moved = [np.zeros(len(e)) if before is None else _root(((e - b) ** 2).sum(axis=1)) * (1 + SLACK) for e, b in zip(self.entries, before.entries if before else self.entries)]
        self.drift = [np.array([m[g == k].max(initial=0) for k in range(GROUPS)]) for m, g in zip(moved, self.groups)]
        self.widest = max((abs(int(x)) for e in self.entries for x in e.ravel()), default=0)

    def updated(self, sums: np.ndarray) -> Codebooks:
        """sums: parts x entries x (count, components).  Entries without parts stay."""
        new = [[[int(s) // int(t[0]) for s in t[1:]] if t[0] else list(e) for e, t in zip(entries, total)] for entries, total in zip(self.entries, sums)]
        return Codebooks(new, self.groups, self)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def grouped(entries: np.ndarray) -> np.ndarray:
    """A group's number for each entry: a few rounds of Lloyd over the entries."""
    x = entries.astype(np.float64)
    centres = x[:: max(1, -(-len(x) // GROUPS))][:GROUPS]
    group = np.zeros(len(x), int)
    for _ in range(5 if len(x) else 0):
        group = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[group == k].mean(axis=0) if (group == k).any() else c for k, c in enumerate(centres)])
    return group


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x[:, None] - entries) ** 2).sum(axis=2)


def nearest(x: np.ndarray, entries: np.ndarray, group: np.ndarray, drift: np.ndarray, own: np.ndarray | None, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entry of each row of x, its squared distance, the new lower bounds, and how many distances were computed.

    own and low: entries and bounds of the round before (None: every group is
    scanned).  The nearest entry wins, ties go to the lower index.
    """
    rows = np.arange(len(x))
    far = 1 << 200 if x.dtype == object else _MOST
    if own is None:
        own, low = np.zeros(len(x), np.int64), np.zeros((len(x), GROUPS))
    at = ((x - entries[own]) ** 2).sum(axis=1)
    low = low - drift
    open_ = low <= (_root(at) * (1 + SLACK))[:, None]
    best, entry, made = at.copy(), own.copy(), len(x)
    scans = []
    for g in range(GROUPS):
        members, r = np.flatnonzero(group == g), np.flatnonzero(open_[:, g])
        if not len(members) or not len(r):
            low[r, g] = np.inf
            continue
        d = _distances(x[r], entries[members])
        made += d.size
        d[members == own[r, None]] = far  # counted already
        k = np.arange(len(r))
        first = d.argmin(axis=1)
        least = d[k, first]
        d[k, first] = far
        scans.append((g, r, members[first], least, d.min(axis=1)))
        better = (least < best[r]) | (least == best[r]) & (members[first] < entry[r])
        best[r[better]], entry[r[better]] = least[better], members[first][better]
    for g, r, first, least, second in scans:
        low[r, g] = _root(np.where(entry[r] == first, second, least)) * (1 - SLACK)
    left = rows[entry != own]  # the entry that these had is another one of its group now
    low[left, group[own[left]]] = np.minimum(low[left, group[own[left]]], _root(at[left]) * (1 - SLACK))
    return entry, best, low, made


def assigned(x: np.ndarray, books: Codebooks, codes: np.ndarray | None, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes (rows x parts), errors (whole numbers), bounds (rows x parts x groups) and distances computed, for vectors of len(books.entries) equal parts."""
    parts = len(books.entries)
    widest = max(int(x.max(initial=0)), -int(x.min(initial=0)), books.widest)
    if (2 * widest) ** 2 * x.shape[1] >= 1 << 62:
        x = x.astype(object)  # whole numbers of any size
    pieces = x.reshape(len(x), parts, -1)
    found = [nearest(pieces[:, p], books.entries[p].astype(x.dtype), books.groups[p], books.drift[p], None if codes is None else codes[:, p].astype(np.int64), None if low is None else low[:, p].astype(np.float64)) for p in range(parts)]
    return np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found), np.stack([f[2] for f in found], axis=1), sum(f[3] for f in found)


def _sums(x: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """parts x entries x (count, components) of a batch, as whole numbers of any size."""
    rows, parts = codes.shape
    pieces = x.reshape(rows, parts, -1)
    out = np.zeros((parts, entries, pieces.shape[2] + 1), object)
    for p in range(parts):
        for e in np.unique(codes[:, p]):
            mine = pieces[codes[:, p] == e, p]
            out[p, e, 0] = len(mine)
            out[p, e, 1:] = mine.sum(axis=0, dtype=object if np.abs(mine).max(initial=0) >= 1 << 40 else np.int64)
    return out


def integers(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label, v: kept vectors as floor(scale * x); v is as narrow as its values allow."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.where(F.col("embedding").isNotNull()).where(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))
    largest = F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.greatest(x, F.bitwise_not(x)))), F.lit(0)))
    seen = rows.agg(F.max(F.size("v")).alias("dims"), largest.alias("largest")).first()
    dims = max(1, -(-(seen["dims"] or 0) // parts)) * parts
    width = next(t for t, n in (("smallint", 15), ("int", 31), ("bigint", 64)) if (seen["largest"] or 0) < 1 << n)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), dims - F.size("v")))
    return rows.withColumn("v", padded.cast(f"array<{width}>"))


def _pass(rows: DataFrame, books: Codebooks, last: bool) -> DataFrame:
    """rows with code, low and error by the codebooks; unless it is the last, one more row a partition, with the sums."""
    parts, entries = len(books.entries), max(map(len, books.entries), default=0)
    kind = rows.schema["v"].dataType.simpleString()
    names = ["vec_id", "label", "v", "code", "low", "error", "sums"]
    states = rows if "code" in rows.columns else rows.select("*", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("binary").alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, types = 0, None
        for b in batches:
            types = [*b.schema.types[:5], pa.int64(), pa.list_(pa.decimal128(38, 0))]
            n = b.num_rows
            if not n:
                continue
            x = b.column(2).flatten().to_numpy().astype(np.int64).reshape(n, -1)
            old = b.column(3).null_count == 0
            codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, parts) if old else None
            low = np.frombuffer(b"".join(b.column(4).to_pylist()), np.float32).reshape(n, parts, GROUPS) if old else None
            codes, error, low, _ = assigned(x, books, codes, low)
            if not last:
                total = total + _sums(x, codes, entries)
            low = np.nextafter(low.astype(np.float32), np.float32(-np.inf))  # rounded down
            packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (codes.astype(np.uint8), low)]
            errors = pa.array([min(_MOST, int(e)) for e in error] if error.dtype == object else error, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *packed, errors, pa.nulls(n, types[6])], names)
        if not isinstance(total, int):
            flat = [[Decimal(int(s)) for s in total.ravel()]]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:6]), pa.array(flat, types[6])], names)

    schema = f"vec_id long, label string, v {kind}, code binary, low binary, error long, sums array<decimal(38,0)>"
    return states.select(names[:5]).mapInArrow(run, schema)


def _total(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sums of all partitions."""
    out = np.zeros(int(np.prod(shape)), object)
    for pos, s in rows.where("sums IS NOT NULL").select(F.posexplode("sums").alias("pos", "s")).groupBy("pos").agg(F.sum("s")).collect():  # as many rows as the codebooks have numbers
        out[pos] = int(s)
    return out.reshape(shape)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows (label, error) with label_error.  Totals of heavy labels, fewer than HEAVY, go to every task; other labels have few rows each and are joined by hash."""
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    sums = cut(sums.select(F.col("label").alias("named"), F.least("s", F.lit(_MOST).cast("decimal(38,0)")).cast("long").alias("label_error"), "n"), keep=True)
    most = (sums.agg(F.sum("n")).first()[0] or 0) // HEAVY
    same = rows["label"].eqNullSafe(sums["named"])
    heavy = rows.join(F.broadcast(sums.where(F.col("n") > most)), same)
    light = rows.join(F.broadcast(sums.where(F.col("n") > most)), same, "left_anti").join(sums.where(F.col("n") <= most), same)
    return heavy.unionByName(light).drop("named", "n")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that is not null and holds no null or non-finite component.

    Codebooks start as the parts of the first vectors by vec_id (null last; ties
    by components), of fewer if there are fewer.  Shorter vectors, and those whose
    length the parts don't divide, count as ending in zeros.  Repeated rows are
    vectors of their own, null labels are one label, no rows give no rows.
    Components, errors and their sums are held to the limits of 64 bits; other
    columns are ignored.
    """
    with scoped(vectors.sparkSession):
        rows = cut(integers(vectors, scale, parts))
        first = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
        size = len(first[0]) // parts if first else 0
        books = Codebooks([[v[p * size : (p + 1) * size] for v in first] for p in range(parts)])
        for k in range(rounds):
            with scoped(vectors.sparkSession):  # the table before goes when the next one is there
                passed = cut(_pass(rows, books, False), keep=True)
            if first:
                books = books.updated(_total(passed, (parts, len(first), size + 1)))
            rows = passed.where("sums IS NULL").drop("error", "sums")
        done = cut(_pass(rows, books, True).select("vec_id", "label", "code", "error"), keep=True)
        out = with_label_errors(done)
        code = F.lower(F.hex("code"))
        return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
