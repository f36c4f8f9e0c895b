"""Rooted ordered trees as tables: node_id, parent_id, child_order, is_leaf, name, edge.

What concerns the way to the root, or all that is below a node, is found by
pointer doubling: after round k a node knows its ancestor 2^k steps up, the sums
of the steps to it, and the sums of what lies fewer than 2^k steps below.  A tree
of any depth takes as many rounds as its depth has binary digits; a round joins
the nodes with themselves and is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import MOST_ROUNDS, discard, settled, stored


def way_sums(nodes: DataFrame, **values: Column) -> DataFrame:
    """node_id and, for each value, its sum over the node and all nodes above it."""

    def step(state: DataFrame) -> DataFrame:
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), *(F.col(k).alias(f"_{k}") for k in values))
        sums = [F.when(F.col("up").isNotNull(), F.col(k) + F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in values]
        return state.join(above, "up", "left").select("node_id", F.col("_up").alias("up"), *sums)

    return settled(nodes.select("node_id", F.col("parent_id").alias("up"), *(v.alias(k) for k, v in values.items())), step, "up is not null").select("node_id", *values)


def walk(nodes: DataFrame) -> DataFrame:
    """node_id, depth, cumulative (edges from the root)."""
    return way_sums(nodes, depth=F.when(F.col("parent_id").isNull(), 0).otherwise(1), cumulative=F.col("edge"))


def below(nodes: DataFrame, rows: DataFrame, keys: tuple[str, ...], **merged: Column) -> DataFrame:
    """node_id, the keys and merged columns: rows gathered over each node and all nodes below it.

    merged: aggregates that give a column of rows its own name back, such as
    n=F.sum("n"); they must not depend on how rows are put together.
    """
    up = stored(nodes.select("node_id", F.col("parent_id").alias("up")))
    sums = stored(rows.select("node_id", *keys, *merged))
    for _ in range(MOST_ROUNDS):
        if up.where("up is not null").isEmpty():
            discard(up)
            return sums
        lifted = sums.join(up.where("up is not null"), "node_id").select(F.col("up").alias("node_id"), *keys, *merged)
        more = stored(sums.unionByName(lifted).groupBy("node_id", *keys).agg(*(c.alias(k) for k, c in merged.items())))
        on = stored(up.join(up.select(F.col("node_id").alias("up"), F.col("up").alias("_up")), "up", "left").select("node_id", F.col("_up").alias("up")))
        discard(sums, up)
        sums, up = more, on
    raise ValueError(f"not settled after {MOST_ROUNDS} rounds: the parents form a cycle")


def below_sums(nodes: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """node_id, the keys and n: rows (node_id, keys, n) summed over each node and all nodes below it."""
    return below(nodes, rows, keys, n=F.sum("n"))


def measured(nodes: DataFrame) -> DataFrame:
    """node_id, depth, cumulative, n_nodes and n_leaves at and below, max_edge (of a leaf at or below), far (the longest way down to a leaf, without the node's own edge; null if it has none)."""
    leaf = F.col("is_leaf")
    state = nodes.select(
        "node_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.col("edge").alias("cumulative"),
        F.lit(1).cast("long").alias("n_nodes"), leaf.cast("long").alias("n_leaves"), F.when(leaf, F.col("edge")).alias("max_edge"), F.when(leaf, F.lit(0.0)).alias("far"),
    )

    def step(state: DataFrame) -> DataFrame:
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("cumulative").alias("_cumulative"))
        below = state.where("up is not null").groupBy(F.col("up").alias("node_id")).agg(F.sum("n_nodes").alias("_nodes"), F.sum("n_leaves").alias("_leaves"), F.max("max_edge").alias("_edge"), F.max(F.col("cumulative") + F.col("far")).alias("_far"))
        return state.join(above, "up", "left").join(below, "node_id", "left").select(
            "node_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("cumulative") + F.coalesce("_cumulative", F.lit(0.0))).alias("cumulative"),
            (F.col("n_nodes") + F.coalesce("_nodes", F.lit(0))).alias("n_nodes"), (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"), F.greatest("max_edge", "_edge").alias("max_edge"), F.greatest("far", "_far").alias("far"),
        )

    return settled(state, step, "up is not null").drop("up")


def cumulative(nodes: DataFrame) -> DataFrame:
    return nodes.join(walk(nodes), "node_id")


def subtree_counts(nodes: DataFrame) -> DataFrame:
    """Of nodes with leaves: number of leaves, greatest leaf edge and greatest cumulative edge, at the node or below."""
    rows = measured(nodes).where("n_leaves > 0")
    return rows.select("node_id", "n_leaves", "max_edge", (F.col("cumulative") + F.col("far")).alias("max_cumulative"))


def ladderized(nodes: DataFrame) -> DataFrame:
    """Children of each node by number of leaves, then greatest edge, then id."""
    counts = subtree_counts(nodes).select("node_id", "n_leaves", "max_edge")
    w = Window.partitionBy("parent_id").orderBy("n_leaves", "max_edge", "node_id")
    return nodes.join(counts, "node_id").withColumn("child_order", F.row_number().over(w) - 1).drop("n_leaves", "max_edge")


def numbered(nodes: DataFrame) -> DataFrame:
    """node_id, depth, n_nodes (at and below), place: parents before children, children in order.

    A place is the sum, on the way from the root, of one for the step and the
    sizes of the earlier siblings' subtrees; no task orders the whole tree.
    """
    sizes = stored(measured(nodes).select("node_id", "depth", "n_nodes"))
    earlier = Window.partitionBy("parent_id").orderBy("child_order", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.join(sizes, "node_id").select("node_id", "parent_id", F.when(F.col("parent_id").isNull(), 0).otherwise(1 + F.coalesce(F.sum("n_nodes").over(earlier), F.lit(0))).alias("step"))
    return way_sums(rows, place=F.col("step")).join(sizes, "node_id")


def preorder(nodes: DataFrame) -> DataFrame:
    """node_id, place: parents before children, children in order."""
    return numbered(nodes).select("node_id", "place")


def postorder(nodes: DataFrame) -> DataFrame:
    """node_id, place: children in order, before their parents."""
    return numbered(nodes).select("node_id", (F.col("place") - F.col("depth") + F.col("n_nodes") - 1).alias("place"))


def at_level(nodes: DataFrame) -> DataFrame:
    """node_id, depth, place: level by level from the root, each in the order of the tree."""
    return numbered(nodes).select("node_id", "depth", F.row_number().over(Window.partitionBy("depth").orderBy("place")).alias("place"))


def split(nodes: DataFrame, most: int) -> DataFrame:
    """node_id, part: the tree in parts of at most ``most`` leaves; a part is named by its top node.

    Tops are the highest nodes with no more leaves than that; what is above them has no part.
    """
    sizes = stored(nodes.select("node_id", "parent_id").join(measured(nodes).select("node_id", "n_leaves"), "node_id"))
    small = F.col("n_leaves") <= most
    above = sizes.select(F.col("node_id").alias("parent_id"), small.alias("above"))
    tops = sizes.join(above, "parent_id", "left").where(small & ~F.coalesce("above", F.lit(False)))
    # every node below a top has its number: numbers add up on the way, and only tops have one
    marks = sizes.join(tops.select("node_id", F.lit(1).alias("top")), "node_id", "left").select("node_id", "parent_id", F.when(F.col("top") == 1, F.col("node_id")).alias("mark"))
    found = way_sums(marks, part=F.coalesce("mark", F.lit(0)), n=F.col("mark").isNotNull().cast("int"))
    return found.where("n > 0").select("node_id", "part")


def children(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"), F.min_by("node_id", "child_order").alias("first_child"), F.min_by("node_id", F.when(F.col("is_leaf"), F.col("child_order"))).alias("first_leaf"))


def single_child_nodes(nodes: DataFrame) -> DataFrame:
    """Inner nodes with fewer than two leaves below."""
    return subtree_counts(nodes).join(nodes.where("not is_leaf").select("node_id"), "node_id", "left_semi").where("n_leaves < 2").select("node_id")


def remove_leaves(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """The tree without the given leaves: inner nodes without leaves go, those with one child give it their edge.

    A node stays if it is a leaf that stays, the root, or has leaves below two of
    its children.  Pointers of all nodes then jump over what goes, adding edges,
    until every one is at a node that stays.
    """
    stay = nodes.where("is_leaf").join(gone.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(1).alias("n"))
    alive = stored(below_sums(nodes, stay).select("node_id"))
    branches = nodes.join(alive, "node_id", "left_semi").where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    kept = stored(stay.select("node_id").unionByName(branches.where("n > 1").select("node_id")).unionByName(nodes.where("parent_id is null").select("node_id")).distinct().withColumn("kept", F.lit(True)))
    at = kept.select(F.col("node_id").alias("up"), "kept")

    def step(state: DataFrame) -> DataFrame:
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("edge").alias("_edge"), F.col("kept").alias("_kept"))
        on = F.col("up").isNotNull() & F.col("kept").isNull()
        pick = lambda new, old: F.when(on, new).otherwise(old)
        return state.join(above, "up", "left").select("node_id", pick(F.col("_up"), F.col("up")).alias("up"), pick(F.col("edge") + F.col("_edge"), F.col("edge")).alias("edge"), pick(F.col("_kept"), F.col("kept")).alias("kept"))

    state = settled(nodes.select("node_id", F.col("parent_id").alias("up"), "edge").join(at, "up", "left"), step, "up is not null and kept is null")
    found = state.join(kept.select("node_id"), "node_id", "left_semi").select("node_id", F.col("up").alias("parent_id"), "edge")
    return found.join(nodes.select("node_id", "child_order", "is_leaf", "name"), "node_id").select("node_id", "parent_id", "child_order", "is_leaf", "name", "edge")


def old_isolated_leaves(nodes: DataFrame, date: str, important: list[str], least_children: int = 2) -> DataFrame:
    """Leaves before a date that can go so that each parent keeps at least ``least_children``; important names stay."""
    counts = children(nodes).select(F.col("node_id").alias("parent_id"), "n_children")
    old = nodes.where(F.col("is_leaf") & (F.col("date") < date) & ~F.col("name").isin(important)).join(counts, "parent_id")
    w = Window.partitionBy("parent_id").orderBy("date", "child_order")
    return old.withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("n_children") - least_children).select("node_id")


def attach(nodes: DataFrame, subtree: DataFrame, at: int) -> DataFrame:
    """A subtree's nodes with new numbers, hung below a node."""
    low = nodes.agg(F.min("node_id").alias("low"), F.max("node_id").alias("high"))
    moved = subtree.crossJoin(F.broadcast(low))  # one row
    fresh = lambda c: F.when(F.col(c) > 0, F.col(c) + F.col("high")).otherwise(F.col(c) + F.col("low") - 1)
    moved = moved.select(fresh("node_id").alias("node_id"), F.when(F.col("parent_id").isNull(), F.lit(at)).otherwise(fresh("parent_id")).alias("parent_id"), "child_order", "is_leaf", "name", "edge")
    return nodes.select("node_id", "parent_id", "child_order", "is_leaf", "name", "edge").unionByName(moved)


def with_sequences(nodes: DataFrame, seqs: DataFrame, *columns: str) -> DataFrame:
    """Leaves with the sequences of their name; others keep nulls."""
    return nodes.join(seqs.select("name", *columns).withColumn("found", F.lit(True)), "name", "left")


def add_equal_sequences(nodes: DataFrame, seqs: DataFrame) -> DataFrame:
    """parent_id, name: leaves to add for sequences with the hash of a leaf's, beside it."""
    leaves = nodes.where("is_leaf").join(seqs.select("name", "hash"), "name").select("parent_id", "hash", F.col("name").alias("leaf"))
    return leaves.join(seqs.select("name", "hash"), "hash").join(nodes.where("is_leaf").select("name"), "name", "left_anti").select("parent_id", "name").distinct()


def transitions(nodes: DataFrame, column: str = "aa") -> DataFrame:
    """node_id, label: letters that change from a parent to its child, such as A193T.  Each pair of sequences is compared in its row."""
    seq = nodes.select("node_id", "parent_id", F.col(column).alias("seq"))
    pairs = seq.join(seq.select(F.col("node_id").alias("parent_id"), F.col("seq").alias("before")), "parent_id")
    n = F.least(F.length("seq"), F.length("before"))
    x, y = F.split("before", ""), F.split("seq", "")
    labels = F.filter(F.transform(F.slice(F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), 1, n), lambda s, i: F.when(s["p"] != s["q"], F.concat(s["p"], (i + 1).cast("string"), s["q"]))), lambda t: t.isNotNull())
    return pairs.select("node_id", F.explode(labels).alias("label"))


def flips(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that change a position which their parent changed too."""
    pos = F.regexp_extract("label", "[0-9]+", 0)
    per = labels.groupBy("node_id").agg(F.collect_set(pos).alias("positions"))
    both = nodes.select("node_id", "parent_id").join(per, "node_id").join(per.select(F.col("node_id").alias("parent_id"), F.col("positions").alias("before")), "parent_id")
    return both.where(F.arrays_overlap("positions", "before")).select("node_id", F.array_join(F.array_sort(F.array_intersect("positions", "before")), ",").alias("positions"))


def consensus_counts(nodes: DataFrame, column: str = "aa") -> DataFrame:
    """Of inner nodes, how often each letter stands at each position of the leaves below."""
    leaves = nodes.where("is_leaf").select("node_id", F.col(column).alias("seq")).where("seq is not null")
    each = leaves.select("node_id", F.posexplode(F.split("seq", "")).alias("p", "letter")).where("letter <> ''")
    sums = below_sums(nodes, each.select("node_id", (F.col("p") + 1).alias("pos"), "letter", F.lit(1).alias("n")), "pos", "letter")
    return sums.join(nodes.where("not is_leaf").select("node_id"), "node_id", "left_semi")


def newick(nodes: DataFrame) -> str:
    """One tree as Newick text: its parts in the order of a walk round the tree, then one string."""
    label = F.concat(F.coalesce("name", F.lit("")), F.when(F.col("edge") != 0, F.concat(F.lit(":"), F.regexp_replace(F.format_string("%.10f", "edge"), "\\.?0+$", ""))).otherwise(""))
    eldest = Window.partitionBy("parent_id").orderBy("child_order", "node_id")
    rows = nodes.withColumn("later", F.col("parent_id").isNotNull() & (F.row_number().over(eldest) > 1)).join(numbered(nodes), "node_id")
    inner, come = F.col("n_nodes") > 1, 2 * F.col("place") - F.col("depth")
    first = F.struct(come.alias("at"), F.concat(F.when(F.col("later"), ",").otherwise(""), F.when(inner, "(").otherwise("")).alias("text"))
    last = F.struct((come + 2 * F.col("n_nodes") - 1).alias("at"), F.concat(F.when(inner, ")").otherwise(""), label).alias("text"))
    parts = rows.select(F.explode(F.array(first, last)).alias("x")).where("x.text <> ''")
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "")).first()[0] + ";"


def text_art(nodes: DataFrame, step: float = 1.0) -> DataFrame:
    """place, line: a tree for the terminal, one line a node, indented by depth, with edges as dashes (step: of one unit)."""
    dash = F.repeat(F.lit("-"), F.greatest(F.lit(1), F.round(F.col("edge") * step)).cast("int"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.lit("+"), dash, F.lit(" "), F.coalesce("name", F.lit("")))
    return nodes.join(numbered(nodes), "node_id").select("place", F.rtrim(line).alias("line"))


def clade_keys(nodes: DataFrame) -> DataFrame:
    """node_id, n_leaves and a key of the set of leaf names at or below each node: the sum of their hashes."""
    leaf = nodes.where("is_leaf").select("node_id", F.explode(F.array(F.struct(F.lit("n").alias("what"), F.lit(1).cast("decimal(38,0)").alias("n")), F.struct(F.lit("key").alias("what"), F.xxhash64("name").cast("decimal(38,0)").alias("n")))).alias("x")).select("node_id", "x.what", "x.n")
    sums = below_sums(nodes, leaf, "what")
    of = lambda what: F.max(F.when(F.col("what") == what, F.col("n")))
    return sums.groupBy("node_id").agg(of("n").cast("long").alias("n_leaves"), of("key").alias("key"))


def ancestral_states(nodes: DataFrame, other: DataFrame, states: DataFrame) -> DataFrame:
    """node_id, state: states of another tree's inner nodes (name, state), for the inner nodes that have the same leaves below."""
    mine = nodes.where("not is_leaf").select("node_id").join(clade_keys(nodes), "node_id")
    theirs = other.where("not is_leaf").select("node_id", "name").join(clade_keys(other), "node_id").select("name", "n_leaves", "key")
    return mine.join(theirs, ["n_leaves", "key"]).join(states.select("name", "state"), "name").select("node_id", "state")


def fixed_names(leaves: DataFrame, seqs: DataFrame) -> DataFrame:
    """Adds fixed: the seq_id of the sequence (seq_id, hash) that a leaf's name is, or whose hash its last eight characters are."""
    ids = seqs.select(F.col("seq_id").alias("name"), F.col("seq_id").alias("by_id")).distinct()
    hashes = seqs.groupBy(F.col("hash").alias("h")).agg(F.min("seq_id").alias("by_hash"))
    return leaves.withColumn("h", F.right("name", F.lit(8))).join(ids, "name", "left").join(hashes, "h", "left").withColumn("fixed", F.coalesce("by_id", "by_hash")).drop("h", "by_id", "by_hash")


def inferred_sequences(nodes: DataFrame, column: str = "aa") -> DataFrame:
    """node_id and a sequence for inner nodes without one, filled from the root down.

    A position takes the letter that the nearest sequences below share, looked
    for through nodes without one; elsewhere, and where there are none below, the
    letter of the parent, which may have been filled itself.  Nodes below an empty
    root stay empty down to the next sequence.

    Both directions are pointer doubling over the empty nodes alone, so they stop
    at nodes with a sequence: upwards the least and the greatest letter of a
    position are merged, downwards the first known letter on the way counts.
    """
    seq = F.col(column)
    there = nodes.where(seq.isNotNull() & (seq != "")).select("node_id", "parent_id", seq.alias("seq"))
    empty = nodes.where(~F.col("is_leaf") & (seq.isNull() | (seq == ""))).select("node_id", "parent_id")
    above = empty.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("open"))
    chains = stored(empty.join(above, "parent_id", "left").select("node_id", F.col("parent_id").alias("anchor"), F.when(F.col("open"), F.col("parent_id")).alias("parent_id")))
    kids = there.select(F.col("parent_id").alias("node_id"), "seq").join(chains.select("node_id"), "node_id", "left_semi").distinct()
    each = kids.select("node_id", F.posexplode(F.split("seq", "")).alias("p", "letter")).where("letter <> ''")
    extremes = each.groupBy("node_id", "p").agg(F.min("letter").alias("least"), F.max("letter").alias("most"))
    shared = below(chains, extremes, ("p",), least=F.min("least"), most=F.max("most"))
    known = shared.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("p", F.when(F.col("least") == F.col("most"), F.col("least")).alias("letter")))).alias("known"))

    def filled(own: str, over: str) -> Column:
        both = F.transform(own, lambda x, k: F.coalesce(x, F.get(F.col(over), k)))
        return F.when(F.col(own).isNull(), F.col(over)).when(F.col(over).isNull(), F.col(own)).otherwise(both)

    anchors = there.select(F.col("node_id").alias("anchor"), F.split("seq", "").alias("over"))
    state = chains.join(known.select("node_id", F.transform("known", lambda x: x["letter"]).alias("letters")), "node_id", "left").join(anchors, "anchor", "left")
    state = state.select("node_id", F.col("parent_id").alias("up"), filled("letters", "over").alias("letters"), F.col("over").isNotNull().alias("anchored"))

    def step(state: DataFrame) -> DataFrame:
        over = state.select(F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("letters").alias("over"), F.col("anchored").alias("_anchored"))
        return state.join(over, "up", "left").select("node_id", F.col("_up").alias("up"), filled("letters", "over").alias("letters"), F.coalesce("_anchored", "anchored").alias("anchored"))

    return settled(state, step, "up is not null").where("anchored").select("node_id", F.array_join(F.transform("letters", lambda x: F.coalesce(x, F.lit(""))), "").alias(column))
