"""Large trees: one Newick text read by many tasks, and trees written in order without one row or one task for the whole.

Reading takes the text between two commas as a record, so that Spark splits the
file by byte ranges.  A record is one leaf with the parentheses that open before
it and close after it:

    ((name:0.1   name:0.2)   'a name':1)label:0.5);

A node that opens and closes with nothing inside is an inner node without
children; its record has no leaf.

Where a record stands follows from sums over what comes before it: of quotes
(an odd number of them: the comma belongs to a name), of leaves, of opened nodes,
of depth.  Sums go in two levels, over the blocks of the file and within a block,
so no task sees more than a block.  The parent of a node is the last node that
was opened one level higher; it is looked for within the block, else it is the
last one of the blocks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.trees import numbered
from ..storage import discard, stored

#: A name: quoted (a quote inside is doubled), or without marks and white space.
NAME = r"'[^']*+(?:''[^']*+)*+'|[^():;,'\s]*"
EDGE = r"[-+0-9.eE]+"
VERSION = "phylogenetic-tree-v3"


def _before(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """rows with, for each value, its sum over the earlier rows of the same keys in the order of block and pos."""
    within = Window.partitionBy(*keys, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "block").agg(*(F.sum(v).alias(f"_{k}") for k, v in values.items()))
    blocks = blocks.select(*keys, "block", *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in values))
    rows = rows.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(k) for k, v in values.items())).join(blocks, [*keys, "block"])
    return rows.select(*(c for c in rows.columns if c not in values and not c.startswith("_")), *((F.col(k) + F.col(f"_{k}")).cast("long").alias(k) for k in values))


def _last(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """rows with the last non-null value of the same keys, up to the row, in the order of block and pos."""
    within = Window.partitionBy(*keys, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("pos"))).alias("_v"))
    blocks = blocks.withColumn("_v", F.last("_v", ignorenulls=True).over(earlier))
    rows = rows.withColumn("_w", F.last(value, ignorenulls=True).over(within)).join(blocks, [*keys, "block"])
    return rows.withColumn(out, F.coalesce("_w", "_v")).drop("_w", "_v")


def _records(spark: SparkSession, path: str, joined: bool) -> DataFrame:
    """tree_id, block, pos, value: the text between commas that don't stand in quotes."""
    raw = spark.read.option("lineSep", ",").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit("'"), F.lit("")))
    tree = F.lit(path) if joined else F.col("_metadata.file_path")
    rows = raw.select(tree.alias("tree_id"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"), F.monotonically_increasing_id().alias("pos"), "value", quotes.alias("quotes"))
    rows = stored(rows)  # places are told once
    inside = _before(rows, ["tree_id"], odd=F.col("quotes"), count=F.lit(1)).withColumn("odd", F.col("odd") % 2)
    # where a file begins within a text, its first record goes on with the last one of the file before
    starts = rows.where("block.start = 0").groupBy("tree_id", F.col("block.file").alias("file")).agg(F.min("pos").alias("pos"))
    inside = inside.join(starts.withColumn("starts", F.lit(True)), (inside.tree_id == starts.tree_id) & (inside.block.file == starts.file) & (inside.pos == starts.pos), "left").select(inside["*"], (F.coalesce("starts", F.lit(False)) & (F.col("count") > 0)).alias("glued"))
    begins = (F.col("odd") == 0) & ~F.col("glued")
    # the record before the next beginning is whole if it is one itself and nothing is glued to it
    at = F.when(begins, F.struct("block", "pos"))
    parts = _last(inside.withColumn("at", at), ["tree_id"], "at", "first")
    several = parts.where(~begins).select("tree_id", "first").distinct()
    whole = parts.join(several, ["tree_id", "first"], "left_anti").select("tree_id", "block", "pos", "value")
    order = F.array_sort(F.collect_list(F.struct("block", "pos", F.concat(F.when(begins | F.col("glued"), "").otherwise(","), "value").alias("value"))))
    glued = parts.join(several, ["tree_id", "first"]).groupBy("tree_id", "first").agg(order.alias("x")).select("tree_id", "first.block", "first.pos", F.array_join(F.transform("x", lambda p: p["value"]), "").alias("value"))
    return whole.unionByName(glued)


def _items(records: DataFrame) -> DataFrame:
    """Adds opens (parentheses that open), read (names and edges of the leaf and of the nodes that close), n_leaves (1; 0 if nothing stands between an opening and its closing), over (the tree ends here)."""
    label = rf"\s*({NAME})\s*(?::\s*({EDGE}))?\s*"
    opens = F.length(F.regexp_replace(F.regexp_extract("value", r"^[\s(]*", 0), r"\s", ""))
    rest = F.regexp_replace(F.col("value"), r"^[\s(]*", "")
    # up to a semicolon that doesn't stand in quotes
    body = F.when(F.contains("rest", F.lit(";")), F.regexp_extract("rest", r"^[^';]*+(?:'[^']*+'[^';]*+)*+", 0)).otherwise(F.col("rest"))
    name = lambda s: F.when(F.startswith(s, F.lit("'")), F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.lit("''"), F.lit("'"))).otherwise(s)
    part = lambda s, k: F.regexp_extract(s, rf"\){label}", k)
    read = F.transform("labels", lambda s: F.struct(name(part(s, 1)).alias("name"), F.coalesce(part(s, 2).try_cast("double"), F.lit(0.0)).alias("edge")))
    rows = records.select("tree_id", "block", "pos", opens.cast("long").alias("opens"), rest.alias("rest")).withColumn("body", body)
    # the leaf is read as if it closed something too; a pattern for the whole record would recurse for each node
    rows = rows.withColumn("labels", F.regexp_extract_all(F.concat(F.lit(")"), "body"), F.lit(rf"\){label}"), F.lit(0)))
    lone = (F.col("opens") > 0) & (F.size("labels") > 1) & (F.regexp_replace(F.col("labels")[0], r"\s", "") == ")")
    over, bad = F.length("body") < F.length("rest"), F.array_join("labels", "") != F.concat(F.lit(")"), "body")
    return rows.select("tree_id", "block", "pos", "opens", read.alias("read"), (~lone).cast("int").alias("n_leaves"), over.alias("over"), bad.alias("bad"))


def read_newick(spark: SparkSession, path: str, joined: bool = False) -> DataFrame:
    """tree_id, node_id, parent_id, child_order, is_leaf, name, edge of one Newick text a file, each read by all tasks.

    joined: the files of a folder, by name, are one text, as write_newick() leaves it.

    Leaves count from 1 up, inner nodes from 0 down, in the order of the text.
    What follows the first semicolon is left out; a leaf without name and edge is
    a leaf, but () an inner node without children.  Parentheses that don't match, and marks where a name should be, are
    errors.
    """
    items = stored(_items(_records(spark, path, joined)))
    ends = items.where("over").groupBy("tree_id").agg(F.min(F.struct("block", "pos")).alias("last"))
    items = items.join(ends, "tree_id", "left").where(F.col("last").isNull() | (F.struct("block", "pos") <= F.col("last"))).drop("last")
    n_closes = F.size("read") - 1
    items = stored(_before(items, ["tree_id"], leaf_no=F.col("n_leaves"), opened=F.col("opens"), depth=F.col("opens") - n_closes))
    after = F.col("depth") + F.col("opens") - n_closes
    wrong = items.groupBy("tree_id").agg(F.min(after).alias("least"), F.sum(F.col("opens") - n_closes).alias("rest"), F.max("bad").alias("bad")).where("bad or least < 0 or rest <> 0").first()
    if wrong:
        raise ValueError(f"{wrong['tree_id']}: " + ("a mark stands where a name should be" if wrong["bad"] else "a parenthesis closes that was not opened" if wrong["least"] < 0 else "a parenthesis is not closed"))

    # what happens at each level, in order: asking for the parent, opening, closing
    event = lambda phase, level, own=None, ask=None, label=None: F.struct(F.lit(phase).alias("phase"), level.cast("long").alias("level"), (own if own is not None else F.lit(None)).cast("long").alias("own"), (ask if ask is not None else F.lit(None)).cast("long").alias("ask"), (label if label is not None else F.lit(None)).cast("struct<name: string, edge: double>").alias("label"))
    inner = lambda k: -(F.col("opened") + k)  # noqa: E731  the k-th node that a record opens, from 0
    first = F.when(F.col("opens") > 0, inner(F.lit(0))).otherwise(F.col("leaf_no") + 1)
    asks = F.array(event(0, F.col("depth"), ask=first))
    opening = F.when(F.col("opens") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("opens") - 1), lambda k: event(1, F.col("depth") + k + 1, own=inner(k)))).otherwise(F.array().cast("array<struct<phase: int, level: bigint, own: bigint, ask: bigint, label: struct<name: string, edge: double>>>"))
    closing = F.transform(F.slice("read", 2, F.size("read")), lambda s, k: event(2, F.col("depth") + F.col("opens") - k, label=s))
    events = items.select("tree_id", "block", "pos", F.explode(F.concat(asks, opening, closing)).alias("e")).select("tree_id", "block", F.struct("pos", "e.phase").alias("pos"), "e.level", "e.own", "e.ask", "e.label")
    matched = stored(_last(events, ["tree_id", "level"], "own", "at"))

    leaves = items.where("n_leaves > 0").select("tree_id", "block", "pos", (F.col("leaf_no") + 1).alias("node_id"), F.col("read")[0].alias("label"), F.when(F.col("opens") > 0, inner(F.col("opens") - 1)).alias("parent"))
    opened = items.where("opens > 0").select("tree_id", "block", "pos", "opened", F.explode(F.sequence(F.lit(0).cast("long"), F.col("opens") - 1)).alias("k")).select("tree_id", "block", "pos", inner(F.col("k")).alias("node_id"), F.when(F.col("k") > 0, inner(F.col("k") - 1)).alias("parent"))
    labels = matched.where("label is not null").select("tree_id", F.col("at").alias("node_id"), "label")
    found = matched.where("ask is not null").select("tree_id", F.col("ask").alias("node_id"), "at")
    nodes = leaves.withColumn("is_leaf", F.lit(True)).unionByName(opened.join(labels, ["tree_id", "node_id"]).withColumn("is_leaf", F.lit(False)))
    nodes = nodes.join(found, ["tree_id", "node_id"], "left").select("tree_id", "block", F.struct("pos", F.abs("node_id")).alias("pos"), "node_id", F.coalesce("parent", "at").alias("parent_id"), "is_leaf", "label.name", "label.edge")
    nodes = _child_order(stored(nodes))
    return nodes.select("tree_id", "node_id", "parent_id", "child_order", "is_leaf", "name", "edge")


def _child_order(nodes: DataFrame) -> DataFrame:
    """With child_order: the place among the children of the parent.  A root is the first of none."""
    rooted = _before(nodes.where("parent_id is not null"), ["tree_id", "parent_id"], child_order=F.lit(1))
    return rooted.withColumn("child_order", F.col("child_order").cast("int")).unionByName(nodes.where("parent_id is null").withColumn("child_order", F.lit(0)))


def _written(nodes: DataFrame, path: str, opened: Column, closed: Column, leaf: Column, head: str, tail: str) -> None:
    """Text files whose concatenation is the document: every piece has its rank on the walk round the tree, ranks are dealt to tasks by ranges.

    Lines end after each piece, which both forms allow between pieces.
    """
    eldest = Window.partitionBy("parent_id").orderBy("child_order", "node_id")
    rows = nodes.withColumn("later", F.col("parent_id").isNotNull() & (F.row_number().over(eldest) > 1)).join(numbered(nodes), "node_id")
    inner, come = ~F.col("is_leaf") | (F.col("n_nodes") > 1), 2 * F.col("place") - F.col("depth")
    comma = F.when(F.col("later"), ",").otherwise("")
    first = F.struct(come.alias("at"), F.concat(F.when(F.col("parent_id").isNull(), head).otherwise(""), comma, F.when(inner, opened).otherwise(leaf), F.when(F.col("parent_id").isNull() & ~inner, tail).otherwise("")).alias("text"))
    last = F.struct((come + 2 * F.col("n_nodes") - 1).alias("at"), F.concat(closed, F.when(F.col("parent_id").isNull(), tail).otherwise("")).alias("text"))
    pieces = rows.select(F.explode(F.when(inner, F.array(first, last)).otherwise(F.array(first))).alias("x")).select("x.at", "x.text")
    kept = stored(pieces)  # ranges are drawn from a table, not from the work above
    kept.repartitionByRange("at").sortWithinPartitions("at").select("text").write.text(path)
    discard(kept)


def write_newick(nodes: DataFrame, path: str) -> None:
    """One tree (node_id, parent_id, child_order, is_leaf, name, edge) as a folder of text files that make one Newick text.  Names with marks or white space are quoted; an inner node without children has nothing between its parentheses."""
    name = F.coalesce("name", F.lit(""))
    quoted = F.when(name.rlike(r"[():;,'\s]"), F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(name)
    label = F.concat(quoted, F.when(F.col("edge") != 0, F.concat(F.lit(":"), F.regexp_replace(F.format_string("%.10f", "edge"), r"\.?0+$", ""))).otherwise(""))
    # a leaf without name and edge gets one, so that it isn't taken for nothing between parentheses
    _written(nodes, path, F.lit("("), F.concat(F.lit(")"), label), F.when(label == "", ":0").otherwise(label), "", ";")


def write_json(nodes: DataFrame, path: str) -> None:
    """One tree as a folder of text files that make one JSON document."""
    fields = F.to_json(F.struct(F.when(F.col("name") != "", F.col("name")).alias("n"), F.when(F.col("edge") != 0, F.col("edge")).alias("l")))
    opened = F.concat(F.rtrim(F.regexp_replace(fields, r"\}$", "")), F.when(fields != "{}", ",").otherwise(""), F.lit('"t":['))
    _written(nodes, path, opened, F.lit("]}"), fields, f'{{"  version":"{VERSION}","tree":', "}")
