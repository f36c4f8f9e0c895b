"""Nearest leaves against a comparison of all."""

import random

import pytest
from test_homologous import rows_met

from cartograph.operators import sequences
from cartograph.operators.sequences import nearest, nearest_leaves

LEAVES = "seq_no long, aa string, cumulative double"


def wanted(queries, leaves):
    distance = lambda a, b: sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))
    out = {}
    for no, aa in queries:
        if aa:
            _, leaf, d = min((100.0 * distance(aa, x) - c, k, distance(aa, x)) for k, x, c in leaves if x)
            out[no] = (d, leaf)
    return out


def found(spark, queries, leaves):
    rows = nearest_leaves(spark.createDataFrame(queries, "seq_no long, aa string"), spark.createDataFrame(leaves, LEAVES)).collect()
    assert len(rows) == len({r.seq_no for r in rows})
    return {r.seq_no: (r.distance, r.leaf_no) for r in rows}


def changed(r, seq, n):
    seq = list(seq)
    for _ in range(n):
        seq[r.randrange(len(seq))] = r.choice("ACDEF")
    return "".join(seq)


def test_long_sequences_near_and_far(spark):
    r = random.Random(1)
    base = ["".join(r.choice("ACDEFGHIKL") for _ in range(3000)) for _ in range(3)]
    leaves = [(k, changed(r, base[k % 3], r.choice([0, 3, 40, 300])), r.random() * 3) for k in range(40)]
    leaves += [(90, leaves[0][1], 5.0), (91, leaves[0][1], 5.0), (92, leaves[1][1][:2900], 1.0), (93, "", 9.0), (94, None, 9.0)]
    queries = [(1000 + k, changed(r, base[k % 3], r.choice([0, 1, 20, 500, 2500]))) for k in range(20)]
    queries += [(2000, leaves[0][1]), (2001, leaves[0][1]), (2002, base[2] + "ACD"), (2003, "ACD"), (2004, ""), (2005, None), (2006, "W" * 50)]
    assert found(spark, queries, leaves) == wanted(queries, leaves)


def test_edges_that_outweigh_letters(spark):
    r = random.Random(2)
    leaves = [(k, "".join(r.choice("AC") for _ in range(r.choice([3, 20, 40]))), r.random() * 900) for k in range(60)]
    queries = [(100 + k, "".join(r.choice("AC") for _ in range(r.choice([1, 3, 21, 40, 60])))) for k in range(40)]
    assert found(spark, queries, leaves) == wanted(queries, leaves)


def test_no_leaves_and_no_queries(spark):
    assert found(spark, [(1, "AC")], []) == {}
    assert found(spark, [], [(1, "AC", 0.5)]) == {}


@pytest.mark.parametrize("most", [None, 2])
def test_equal_sequences_are_compared_once(spark, most):
    r = random.Random(3)
    texts = ["".join(r.choice("ACD") for _ in range(r.choice([11, 12]))) for _ in range(12)]
    queries = [(k, changed(r, texts[k % 4], k % 3)) for k in range(30)] + [(k % 7 + 30, texts[k % 4]) for k in range(300)]
    candidates = [(1000 + k, texts[k % 12]) for k in range(400)]
    distance = lambda a, b: sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))
    want = {}
    for no, aa in queries:
        d, k = min((distance(aa, x), k) for k, x in candidates)
        if most is None or (d <= most and len(aa) == len(dict(candidates)[k])):
            want[no] = min((d, k), want.get(no, (d, k)))
    found = nearest(spark.createDataFrame(queries, "seq_no int, aa string"), spark.createDataFrame(candidates, "seq_no int, aa string"), most)
    assert {r.query_no: (r.distance, r.seq_no) for r in found.collect()} == want
    assert rows_met(found) < 1000


def test_small_cells_and_batches(spark, monkeypatch):
    monkeypatch.setattr(sequences, "CELL_LETTERS", 1500)
    monkeypatch.setattr(sequences, "BATCH", 50)
    r = random.Random(4)
    base = ["".join(r.choice("ACDEFGHIKL") for _ in range(60)) for _ in range(4)]
    leaves = [(k, changed(r, base[k % 4], r.choice([0, 2, 9])), r.randrange(64) / 64) for k in range(150)] + [(200, "\u00c4\U0001f600 A", 0.5)]
    queries = [(1000 + k, changed(r, base[k % 4], r.choice([0, 1, 5, 60]))) for k in range(150)] + [(2000, "\u00c4\U0001f600 "), (2001, "A" * 90)]
    assert found(spark, queries, leaves) == wanted(queries, leaves)


def test_letters_met_grow_less_than_pairs(monkeypatch):
    """Relatives of a pivot: what is looked up is what differs from it, not all letters of all pairs."""
    r = random.Random(5)
    base = "".join(r.choice("ACDEFGHIKL") for _ in range(400))
    queries, leaves = ([changed(r, base, 4) for _ in range(200)] for _ in range(2))
    seen = []
    count = sequences.np.bincount
    monkeypatch.setattr(sequences.np, "bincount", lambda x, *more, **named: (seen.append(len(x)), count(x, *more, **named))[1])
    score, k, distance = sequences._best_of_cell(queries, leaves, sequences.np.zeros(200), base, 100.0)
    apart = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert [(x, y) for x, y in zip(distance, k)] == [min((apart(q, x), n) for n, x in enumerate(leaves)) for q in queries]
    assert sum(seen) < 200 * 200
