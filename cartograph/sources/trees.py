"""Trees: Newick text and JSON to node tables, and back; ancestral states."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S

VERSION = "phylogenetic-tree-v3"
_nodes = "tree_id string, node_id long, parent_id long, child_order int, is_leaf boolean, name string, edge double, aa string, nuc string, date string"


def newick_nodes(text: str) -> list[tuple]:
    """(node_id, parent_id, child_order, is_leaf, name, edge): leaves count from 1 up, inner nodes from 0 down; no recursion, so depth has no limit."""
    tokens = re.finditer(r"\s*(?:([(),;])|('(?:[^']|'')*'|[^(),:;\s]+)?(?::\s*([-+0-9.eE]+))?)", text)
    out: list[dict] = []
    leaves, inner, stack, last = 0, 0, [], None

    def node(leaf: bool, parent: dict | None) -> dict:
        nonlocal leaves, inner
        if leaf:
            leaves += 1
        made = {"id": leaves if leaf else -inner, "parent": parent["id"] if parent else None, "order": parent["n"] if parent else 0, "leaf": leaf, "name": "", "edge": 0.0, "n": 0}
        inner += not leaf
        if parent:
            parent["n"] += 1
        out.append(made)
        return made

    for m in tokens:
        if m[1] == "(":
            stack.append(node(False, stack[-1] if stack else None))
            last = None
        elif m[1] == ",":
            last = None
        elif m[1] == ")":
            if not stack:
                raise ValueError("a parenthesis closes that was not opened")
            last = stack.pop()
        elif m[1] == ";":
            break
        elif m[2] or m[3]:
            if last is None:
                last = node(True, stack[-1] if stack else None)
            last["name"], last["edge"] = (m[2] or "").strip("'"), float(m[3] or 0)
    if stack:
        raise ValueError("a parenthesis is not closed")
    return [(x["id"], x["parent"], x["order"], x["leaf"], x["name"], x["edge"]) for x in out]


def json_nodes(doc: dict) -> list[tuple]:
    """Like newick_nodes, with aa, nuc and date."""
    if doc.get("  version") != VERSION:
        raise ValueError(f"version of a tree: {doc.get('  version')}")
    out, leaves, inner = [], 0, 0
    todo = [(doc["tree"], None, 0)]
    while todo:
        x, parent, order = todo.pop()
        leaf = not x.get("t")
        if leaf:
            leaves += 1
        own = leaves if leaf else -inner
        inner += not leaf
        out.append((own, parent, order, leaf, x.get("n", ""), float(x.get("l", 0)), x.get("a"), x.get("N"), x.get("d")))
        todo += [(c, own, k) for k, c in reversed(list(enumerate(x.get("t", []))))]
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Node tables of tree files, the form known by the first character; one tree is parsed by one task."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("tree_id"), "value")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for tree, text in zip(pdf["tree_id"], pdf["value"]):
                rows = json_nodes(json.loads(text)) if text.lstrip().startswith("{") else [(*x, None, None, None) for x in newick_nodes(text)]
                out = pd.DataFrame(rows, columns=["node_id", "parent_id", "child_order", "is_leaf", "name", "edge", "aa", "nuc", "date"])
                yield out.assign(tree_id=tree, parent_id=out["parent_id"].astype("Int64"), child_order=out["child_order"].astype("int32"))[[c.split()[0] for c in _nodes.split(", ")]]

    return files.mapInPandas(parse, _nodes)


def to_json(nodes: DataFrame) -> str:
    """The JSON form of one tree."""
    rows = sorted(nodes.collect(), key=lambda r: (r["parent_id"] is not None, r["child_order"]))  # one tree
    made = {r["node_id"]: {k: v for k, v in (("n", r["name"]), ("l", r["edge"])) if v} for r in rows}
    for r in rows:
        if r["parent_id"] is not None:
            made[r["parent_id"]].setdefault("t", []).append(made[r["node_id"]])
    return json.dumps({"  version": VERSION, "tree": next(made[r["node_id"]] for r in rows if r["parent_id"] is None)})


def read_ancestral_states(spark: SparkSession, path: str) -> DataFrame:
    """name, nuc, aa of inner nodes."""
    rows = spark.read.option("sep", "\t").schema("name string, nuc string").csv(path)
    return rows.withColumn("aa", S.translate(F.col("nuc")))
