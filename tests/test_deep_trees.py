"""Trees by pointer doubling against plain walks: inferred sequences through empty nodes, cycles, tables that go."""

import os
import random

import pytest

from cartograph import storage
from cartograph.operators import trees

NODES = "node_id long, parent_id long, child_order int, is_leaf boolean, name string, edge double, aa string"


def random_tree(r, n, share):
    parents = [None] + [r.choice([k - 1, r.randrange(k)]) for k in range(1, n)]
    inner = set(parents)
    word = lambda: "".join(r.choice("AAAC") for _ in range(6))
    return [(k, p, k, k not in inner, f"n{k}", 1.0, word() if r.random() < share else r.choice([None, ""])) for k, p in enumerate(parents)]


def inferred(rows):
    """By the walk: parents first, each empty inner node from the nearest sequences below and its parent."""
    by, kids = {r[0]: r for r in rows}, {}
    for r in rows:
        kids.setdefault(r[1], []).append(r[0])
    aa = {r[0]: r[6] or "" for r in rows}
    given = dict(aa)

    def below(k):
        return [s for c in kids.get(k, []) for s in ([given[c]] if given[c] else below(c))]

    out = {}
    for k in sorted(by):  # parents have smaller numbers
        p = by[k][1]
        if not aa[k] and not by[k][3] and p is not None and aa[p]:
            seqs = below(k)
            aa[k] = out[k] = "".join(seqs[0][i] if len({s[i] for s in seqs}) == 1 else aa[p][i] for i in range(6)) if seqs else aa[p]
    return out


@pytest.mark.parametrize("share", [0.05, 0.3, 0.7])
def test_inferred_sequences_through_empty_nodes(spark, share):
    r = random.Random(int(share * 100))
    rows = random_tree(r, 150, share)
    rows[0] = (*rows[0][:6], "CCCCCC" if share < 0.5 else None)
    got = {x.node_id: x.aa for x in trees.inferred_sequences(spark.createDataFrame(rows, NODES)).collect()}
    assert got == inferred(rows)


def test_no_sequences_and_no_nodes(spark):
    rows = [(0, None, 0, False, "r", 0.0, None), (1, 0, 0, True, "l", 1.0, None)]
    assert trees.inferred_sequences(spark.createDataFrame(rows, NODES)).count() == 0
    assert trees.inferred_sequences(spark.createDataFrame([], NODES)).count() == 0


def test_cycles_are_an_error(spark):
    rows = spark.createDataFrame([(1, 2, 0, False, "a", 1.0, None), (2, 1, 0, False, "b", 1.0, None)], NODES)
    for ask in (trees.walk, trees.measured, trees.inferred_sequences):
        with pytest.raises(ValueError, match="cycle"):
            storage_rounds = storage.MOST_ROUNDS
            storage.MOST_ROUNDS = trees.MOST_ROUNDS = 6
            try:
                ask(rows)
            finally:
                storage.MOST_ROUNDS = trees.MOST_ROUNDS = storage_rounds


def test_rounds_leave_one_table(spark):
    folder = storage.shared_dir(spark)
    before = set(os.listdir(folder.removeprefix("file:"))) if os.path.isdir(folder.removeprefix("file:")) else set()
    rows = spark.createDataFrame([(k, k - 1 if k else None, 0, k == 39, "x", 1.0, None) for k in range(40)], NODES)
    assert {x.node_id: x.depth for x in trees.walk(rows).collect()} == {k: k for k in range(40)}
    assert len(set(os.listdir(folder.removeprefix("file:"))) - before) == 1
