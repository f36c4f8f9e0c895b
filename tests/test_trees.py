"""Trees of any depth, against plain walks."""

import random

import pytest

from cartograph.operators import trees
from cartograph.sources.trees import newick_nodes

SCHEMA = "node_id long, parent_id long, child_order int, is_leaf boolean, name string, edge double"


def chain(n):
    """n inner nodes below each other, each with a leaf beside the next."""
    rows = [(0, None, 0, False, "", 0.0)]
    for k in range(1, n + 1):
        rows.append((k, -(k - 1) if k > 1 else 0, 0, True, f"L{k}", 0.5))
        rows.append((-k, -(k - 1) if k > 1 else 0, 1, k == n, f"I{k}", 1.0))
    return rows


def random_tree(seed, n=120):
    r = random.Random(seed)
    rows, kids = [(0, None, 0, False, "", 0.0)], {0: 0}
    for k in range(1, n):
        p = r.choice(list(kids))
        rows.append((k, p, kids[p], False, f"n{k}", float(r.randint(0, 9))))
        kids[p] += 1
        kids[k] = 0
    return [(*x[:3], kids[x[0]] == 0, *x[4:]) for x in rows]


def plain(rows):
    """By node: depth, cumulative, leaves, greatest leaf edge and cumulative, preorder and postorder place."""
    by, kids = {x[0]: x for x in rows}, {}
    for x in rows:
        kids.setdefault(x[1], []).append(x)
    out, pre, post = {}, 0, 0
    stack = [(kids[None][0], 0, 0.0, False)]
    while stack:
        x, depth, above, done = stack.pop()
        if done:
            d = out[x[0]]
            below = [out[y[0]] for y in kids.get(x[0], [])]
            own = [(1, x[5], d["cumulative"])] if x[3] else [(b["n"], b["edge"], b["far"]) for b in below if b["n"]]
            d["n"] = sum(o[0] for o in own)
            d["edge"], d["far"] = (max(o[1] for o in own), max(o[2] for o in own)) if own else (None, None)
            d["post"], post = post, post + 1
            continue
        out[x[0]] = {"depth": depth, "cumulative": above + x[5], "pre": pre}
        pre += 1
        stack.append((x, depth, above, True))
        for y in sorted(kids.get(x[0], []), key=lambda y: -y[2]):
            stack.append((y, depth + 1, above + x[5], False))
    assert set(out) == set(by)
    return out


@pytest.mark.parametrize("rows", [chain(1000), random_tree(1), random_tree(2), [(0, None, 0, True, "one", 2.0)]], ids=["deep", "random", "random2", "one"])
def test_walks(spark, rows):
    nodes, want = spark.createDataFrame(rows, SCHEMA), plain(rows)
    assert {x.node_id: (x.depth, x.cumulative) for x in trees.cumulative(nodes).collect()} == {k: (v["depth"], v["cumulative"]) for k, v in want.items()}
    assert {x.node_id: (x.n_leaves, x.max_edge, x.max_cumulative) for x in trees.subtree_counts(nodes).collect()} == {k: (v["n"], v["edge"], v["far"]) for k, v in want.items() if v["n"]}
    assert {x.node_id: x.place for x in trees.preorder(nodes).collect()} == {k: v["pre"] for k, v in want.items()}
    assert {x.node_id: x.place for x in trees.postorder(nodes).collect()} == {k: v["post"] for k, v in want.items()}
    text = trees.newick(nodes)
    assert len(newick_nodes(text)) == len(rows) and text.count("(") == text.count(")") == sum(1 for x in rows if any(y[1] == x[0] for y in rows[:2000]) or (not x[3]))
    assert [x.depth for x in trees.at_level(nodes).where("place = 1").orderBy("depth").collect()] == list(range(1 + max(v["depth"] for v in want.values())))


def test_remove_leaves_of_a_deep_tree(spark):
    nodes = spark.createDataFrame(chain(300), SCHEMA)
    got = {x.node_id: (x.parent_id, x.edge) for x in trees.remove_leaves(nodes, nodes.where("is_leaf and node_id not in (100, 200, -300)")).collect()}
    assert got == {0: (None, 0.0), -99: (0, 99.0), 100: (-99, 0.5), -199: (-99, 100.0), 200: (-199, 0.5), -300: (-199, 101.0)}
    assert {x.node_id for x in trees.remove_leaves(nodes, nodes.where("is_leaf")).collect()} == {0}


def test_consensus_and_ladder_of_a_deep_tree(spark):
    rows = chain(40)
    nodes = spark.createDataFrame([(*x, "AC" if x[0] % 2 else "AG") for x in rows], SCHEMA + ", aa string")
    got = {(x.node_id, x.pos, x.letter): x.n for x in trees.consensus_counts(nodes).collect()}
    assert got[(0, 1, "A")] == 41 and got[(0, 2, "C")] == 20 and got[(0, 2, "G")] == 21 and (40, 1, "A") not in got
    order = {x.node_id: x.child_order for x in trees.ladderized(nodes).collect()}
    assert order[1] == 0 and order[-1] == 1


def test_split_into_parts(spark):
    rows = random_tree(3)
    nodes, want = spark.createDataFrame(rows, SCHEMA), plain(rows)
    parts = {x.node_id: x.part for x in trees.split(nodes, 9).collect()}
    parent = {x[0]: x[1] for x in rows}
    for k in parent:
        way = [k]
        while parent[way[-1]] is not None:
            way.append(parent[way[-1]])
        tops = [x for x in way if want[x]["n"] <= 9]
        assert parts.get(k) == (tops[-1] if tops else None)


def test_text_art(spark):
    nodes = spark.createDataFrame([(0, None, 0, False, "", 0.0), (1, 0, 0, True, "A", 3.0), (2, 0, 1, True, "B", 1.0)], SCHEMA)
    assert [x.line for x in trees.text_art(nodes).orderBy("place").collect()] == ["+-", "  +--- A", "  +- B"]
