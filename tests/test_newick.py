"""A large tree's text read by many tasks against the token reader, and written in order."""

import json
import random

import pytest

from cartograph.sources import newick
from cartograph.sources.trees import json_nodes, newick_nodes


def random_text(r, n, quoted=0.2):
    """A tree of about n leaves, with names that hold marks."""
    name = lambda: r.choice(["", "x", f"n{r.randrange(1000)}", "A/Town/1/2020"]) if r.random() > quoted else "'" + r.choice(["a, b", "(c)", "d''e, ''f", ",", "; :", ",,,'',("]) + "'"
    edge = lambda: r.choice(["", f":{r.random():.4f}", ": 1e-3", ":0"])
    leaf = lambda: (name() or "leaf") + edge()
    items = [leaf() for _ in range(n)]
    while len(items) > 1:
        k, at = r.randint(1, 5), r.randrange(len(items))
        part = items[at : at + k]
        items[at : at + k] = [r.choice(["(", " (\n"]) + r.choice([",", ", ", " ,\n"]).join(part) + ")" + name() + edge()]
    return (items[0] if items[0].strip().startswith("(") else f"({items[0]})") + ";\n"


def read(spark, path, block):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        return newick.read_newick(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def rows(found):
    return sorted((r.node_id, r.parent_id, r.child_order, r.is_leaf, r.name, r.edge) for r in found)


def tokens(text):
    return sorted((i, p, k, leaf, name.replace("''", "'"), e) for i, p, k, leaf, name, e in newick_nodes(text))


@pytest.mark.parametrize("n,block", [(1, "1g"), (40, "64"), (600, "700"), (600, "1g")])
def test_equal_to_the_token_reader(spark, tmp_path, n, block):
    text = random_text(random.Random(n), n)
    (tmp_path / "t.nwk").write_text(text)
    assert rows(read(spark, tmp_path / "t.nwk", block)) == tokens(text)


def test_several_files_and_text_after_the_end(spark, tmp_path):
    texts = {f"{k}.nwk": random_text(random.Random(k), 30) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text + "(more,(after));")
    found = read(spark, tmp_path, "200")
    for name, text in texts.items():
        assert rows(r for r in found if r.tree_id.endswith(name)) == tokens(text)


@pytest.mark.parametrize("text", ["((a,b);", "(a,b));", "(a,(b,c)", "(a b,c);", "(a,b(c));"])
def test_wrong_texts_are_errors(spark, tmp_path, text):
    (tmp_path / "t.nwk").write_text(text)
    with pytest.raises(ValueError):
        read(spark, tmp_path / "t.nwk", "1g")


def test_a_chain_of_many_nodes(spark, tmp_path):
    n = 20_000
    text = "(" * n + "leaf" + "".join(f")n{k}:0.5" for k in range(n)) + ";"
    (tmp_path / "t.nwk").write_text(text)
    assert rows(read(spark, tmp_path / "t.nwk", "1g")) == tokens(text)


def test_leaves_without_name(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("(,(:0.5,));")
    assert [(r[0], r[1], r[5]) for r in rows(read(spark, tmp_path / "t.nwk", "1g"))] == [(-1, 0, 0.0), (0, None, 0.0), (1, 0, 0.0), (2, -1, 0.5), (3, -1, 0.0)]


def test_written_in_order_and_read_again(spark, tmp_path):
    text = random_text(random.Random(7), 300)
    (tmp_path / "t.nwk").write_text(text)
    nodes = spark.createDataFrame(read(spark, tmp_path / "t.nwk", "900")).drop("tree_id").repartition(5)
    newick.write_newick(nodes, f"{tmp_path}/out")
    parts = sorted((tmp_path / "out").glob("part-*"))
    whole = "".join(p.read_text() for p in parts)
    (tmp_path / "again.nwk").write_text(whole)
    near = lambda found: [(*r[:5], round(r[5], 8)) for r in found]
    assert near(tokens(whole)) == near(tokens(text)) == near(rows(read(spark, tmp_path / "again.nwk", "500")))
    assert near(rows(newick.read_newick(spark, f"{tmp_path}/out", joined=True).collect())) == near(tokens(text))
    newick.write_json(nodes, f"{tmp_path}/json")
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*"))))
    kids = lambda found: sorted((x[3], x[4], round(x[5], 8)) for x in found)
    assert kids(json_nodes(doc)) == kids(tokens(text))


def test_inner_nodes_without_children(spark, tmp_path):
    text = "((( )y)z,()x:0.5,(\n)'a, b',(:0)w,(,)v)r;\n"
    (tmp_path / "t.nwk").write_text(text)
    nodes = spark.createDataFrame(read(spark, tmp_path / "t.nwk", "1g")).drop("tree_id")
    want = [(-6, 0, 4, False, "v", 0.0), (-5, 0, 3, False, "w", 0.0), (-4, 0, 2, False, "a, b", 0.0), (-3, 0, 1, False, "x", 0.5), (-2, -1, 0, False, "y", 0.0), (-1, 0, 0, False, "z", 0.0), (0, None, 0, False, "r", 0.0)]
    want += [(1, -5, 0, True, "", 0.0), (2, -6, 0, True, "", 0.0), (3, -6, 1, True, "", 0.0)]
    assert rows(nodes.collect()) == want
    newick.write_newick(nodes.repartition(3), f"{tmp_path}/out")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert "".join(whole.split("\n")) == "((()y)z,()x:0.5,()'a, b',(:0)w,(:0,:0)v)r;"
    assert rows(newick.read_newick(spark, f"{tmp_path}/out", joined=True).collect()) == want


@pytest.mark.parametrize("is_leaf,text", [(True, "a;"), (False, "()a;")])
def test_a_node_alone(spark, tmp_path, is_leaf, text):
    newick.write_newick(spark.createDataFrame([(1, None, 0, is_leaf, "a", 0.0)], "node_id long, parent_id long, child_order int, is_leaf boolean, name string, edge double"), f"{tmp_path}/out")
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).replace("\n", "") == text
    assert [(r.is_leaf, r.name) for r in newick.read_newick(spark, f"{tmp_path}/out", joined=True).collect()] == [(is_leaf, "a")]
