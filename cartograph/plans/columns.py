"""Registered queries on column functions and small operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions import sequence as S
from ..functions import titer as T
from ..operators import locations, lookups, semantic, titers, trees
from ..operators.sequences import Selected
from .fixtures import view, with_views
from .formats import derived
from .sequences import CLOSURE, EGG, SUB, WALK, antigens, seqs

QUERIES, SQL = {}, {}


def query(name, sql, *views):
    def add(f):
        QUERIES[name] = f
        SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


PARTS = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'A(H3N2)' END AS subtype, CASE WHEN c_custkey % 3 = 0 THEN 'SWINE' ELSE '' END AS host, upper(n_name) AS location, CAST(c_custkey AS STRING) AS isolation, CAST(1990 + c_custkey % 30 AS STRING) AS year, CASE WHEN c_custkey % 5 = 0 THEN 'NYMC-7' ELSE '' END AS reassortant, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE '' END AS extra, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"
_slashed = "concat_ws('/', nullif(subtype, ''), nullif(host, ''), location, isolation, year)"


def parts(spark, d):
    return derived(spark, PARTS, customer=table(spark, d, "customer"), nation=table(spark, d, "nation"), region=table(spark, d, "region"))


@query("n5_rendered_names", f"SELECT c_custkey, concat_ws(' ', {_slashed}, nullif(reassortant, ''), nullif(extra, '')) AS name FROM ({PARTS}) t")
def n5(spark, d):
    return parts(spark, d).select("c_custkey", names.rendered(*map(F.col, ("subtype", "host", "location", "isolation", "year", "reassortant", "extra"))).alias("name"))


@query("n6_abbreviated_names", f"""SELECT c_custkey, concat_ws('/', CASE WHEN region = 'AMERICA' THEN 'XY' WHEN contains(location, ' ') THEN concat(substr(location, 1, 1), substr(split_part(location, ' ', 2), 1, 1)) ELSE concat(substr(location, 1, 1), lower(substr(location, 2, 1))) END, isolation, right(year, 2)) AS name
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('NEW ', location) ELSE location END AS location, isolation, year, region FROM ({PARTS}) p) t""")
def n6(spark, d):
    """Places of two words for every second customer; a region plays the country whose places have codes."""
    rows = parts(spark, d).withColumn("location", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("NEW "), "location")).otherwise(F.col("location")))
    place = names.location_abbreviation(F.col("location"), F.when(F.col("region") == "AMERICA", "UNITED STATES OF AMERICA").otherwise(F.col("region")), F.lit("XY"))
    return rows.select("c_custkey", names.abbreviated(place, F.col("isolation"), F.col("year")).alias("name"))


@query("n7_reassortant_and_rest", f"SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('NYMC-', isolation) WHEN 2 THEN concat('NIB-', isolation) ELSE concat('IVR-', isolation) END AS reassortant, concat('A/', location, '/1/', year) AS rest FROM ({PARTS}) t")
def n7(spark, d):
    """Three spellings of names with the customer's number, and names without."""
    k = F.col("c_custkey") % 4
    plain = F.concat(F.lit("A/"), "location", F.lit("/1/"), "year")
    made = F.when(k == 1, F.concat(F.lit(" NYMC X-"), "isolation")).when(k == 2, F.concat(F.lit(" NIBRG "), "isolation")).when(k == 3, F.concat(F.lit(" IVR-"), "isolation")).otherwise("")
    found = names.reassortant_and_rest(F.concat(plain, made))
    return parts(spark, d).select("c_custkey", found["reassortant"].alias("reassortant"), F.trim(found["rest"]).alias("rest"))


@query("n11_subtype_prefix", f"SELECT c_custkey, concat_ws('/', 'A(H3N2)', nullif(host, ''), location, isolation, year) AS name FROM ({PARTS}) t")
def n11(spark, d):
    """Three of four names have the prefix already."""
    name = F.concat_ws("/", *(F.nullif(F.col(c), F.lit("")) for c in ("subtype", "host", "location", "isolation", "year")))
    return parts(spark, d).select("c_custkey", names.with_subtype_prefix(name, F.lit("A(H3N2)")).alias("name"))


query("f6_masters_only", " SELECT seq_no FROM seqs WHERE seq_no % 3 <> 1", "seqs")(lambda spark, d: Selected(seqs(spark, d).withColumn("nuc", F.when(F.col("seq_no") % 3 == 1, "").otherwise(F.lower("aa")))).masters_only().df.select("seq_no"))
query("sq13_positions", "SELECT p_partkey, p_partkey * 3 + 1 AS nuc, CAST(floor(p_partkey / 3) AS BIGINT) + 1 AS aa FROM part")(lambda spark, d: table(spark, d, "part").select("p_partkey", S.aa_to_nuc(F.col("p_partkey") + 1).alias("nuc"), S.nuc_to_aa(F.col("p_partkey") + 1).alias("aa")))


@query("t11_titers_as_written", """ SELECT antigen_no, serum_no, layer_no, CASE (antigen_no + serum_no + layer_no) % 7 WHEN 4 THEN '*' WHEN 5 THEN CAST(v + 1 AS STRING) WHEN 3 THEN CAST(v AS STRING) WHEN 6 THEN '*' WHEN 1 THEN concat('<', CAST(v AS STRING)) ELSE titer END AS titer FROM titer_layers""", "titer_layers")
def t11(spark, d):
    """Titers with blanks, full-width signs, pairs, fractions, words."""
    k, v = (F.col("antigen_no") + F.col("serum_no") + F.col("layer_no")) % 7, F.col("v").cast("string")
    text = F.when(k == 1, F.concat(F.lit("＜ "), v)).when(k == 2, F.concat(F.lit("  "), "titer", F.lit(" "))).when(k == 3, F.concat(v, F.lit("/"), (F.col("v") * 2).cast("string"))).when(k == 4, "nd").when(k == 5, F.concat(v, F.lit(".7"))).when(k == 6, F.concat(F.lit("about "), v)).otherwise(F.col("titer"))
    return view(spark, d, "titer_layers").select("antigen_no", "serum_no", "layer_no", T.checked(text).alias("titer"))


query("layers_removed", " SELECT antigen_no, serum_no, CAST(dense_rank() OVER (ORDER BY layer_no) - 1 AS INT) AS layer_no, titer FROM titer_layers WHERE layer_no NOT IN (1, 3)", "titer_layers")(lambda spark, d: titers.remove_layers(view(spark, d, "titer_layers"), [1, 3]).select("antigen_no", "serum_no", "layer_no", "titer"))


@query("j14_equal_sequences_beside_leaves", """+ l AS (SELECT node_id, parent_id, hash FROM deep_nodes JOIN seqs ON seq_no = node_id WHERE is_leaf)
SELECT DISTINCT l.parent_id, concat('n', CAST(s.seq_no AS STRING)) AS name FROM l JOIN seqs s ON s.hash = l.hash WHERE s.seq_no NOT IN (SELECT node_id FROM l)""", "deep_nodes", "seqs")
def j14(spark, d):
    """Sequences of inner nodes that are those of a leaf."""
    return trees.add_equal_sequences(view(spark, d, "deep_nodes"), seqs(spark, d).select(F.concat(F.lit("n"), F.col("seq_no").cast("string")).alias("name"), "hash"))


@query("l3_unknown_locations", "SELECT concat('place ', CAST(c_nationkey % 7 AS STRING)) AS location, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1")
def l3(spark, d):
    """A third of the customers live nowhere that is known."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("place "), (F.col("c_nationkey") % 7).cast("string"))).otherwise(F.col("n_name")).alias("location"))
    dim = table(spark, d, "nation").select(F.col("n_name").alias("location"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.col("n_name").alias("country"), F.lit("").alias("continent"))
    none = spark.createDataFrame([], "alias string, name string")
    return locations.unknown(locations.resolve(rows, dim.select(F.col("location").alias("name"), "location"), none, dim))


@query("sm1_attributes_of_charts", f""" SELECT antigen_no, CASE WHEN reassortant <> '' THEN 'r' WHEN {EGG.format(p='passage')} THEN 'e' ELSE 'c' END AS p, CASE WHEN antigen_no % 4 = 1 THEN concat('C', CAST(antigen_no % 9 AS STRING)) END AS c, CASE WHEN antigen_no % 10 = 2 THEN '1' END AS r, CASE WHEN antigen_no % 3 <> 0 THEN concat('CONTINENT ', CAST(antigen_no % 5 AS STRING)) END AS continent, CASE WHEN antigen_no % 3 = 1 THEN concat('COUNTRY ', CAST(antigen_no % 50 AS STRING)) END AS country FROM antigens""", "antigens")
def sm1(spark, d):
    """Passage, clades, references and places as attributes; a third of the antigens have no place, a third no country."""
    from ..operators import matching

    a = antigens(spark, d)
    clades = a.where("antigen_no % 4 = 1").select("antigen_no", F.concat(F.lit("C"), (F.col("antigen_no") % 9).cast("string")).alias("clades"))
    text = lambda name, by: F.concat(F.lit(name + " "), (F.col("antigen_no") % by).cast("string"))
    places = a.where("antigen_no % 3 <> 0").select("antigen_no", text("CONTINENT", 5).alias("continent"), F.when(F.col("antigen_no") % 3 == 1, text("COUNTRY", 50)).otherwise("").alias("country"))
    out = semantic.populated(a, matching.is_egg(F.col("passage")), "2020-01-01", clades, a.where("antigen_no % 10 = 2"), places)
    return out.select("antigen_no", *(F.col("semantic")[k].alias(v) for k, v in (("p", "p"), ("C", "c"), ("R", "r"), ("C9", "continent"), ("c9", "country"))))


@query("tree_split", f"+{WALK.removeprefix('RECURSIVE ')},{CLOSURE}{SUB}, t AS (SELECT n.node_id FROM nodes n JOIN sc USING (node_id) LEFT JOIN sc up ON up.node_id = n.parent_id WHERE sc.n_leaves <= 70 AND (up.n_leaves IS NULL OR up.n_leaves > 70)) SELECT c.node_id, t.node_id AS part FROM c JOIN t ON t.node_id = c.ancestor", "nodes")
def split(spark, d):
    return trees.split(view(spark, d, "nodes"), 70)


SQL["tree_split"] = SQL["tree_split"].replace("WITH nodes", "WITH RECURSIVE nodes", 1)

query("o10_letter_histogram", "WITH x AS (SELECT unnest(string_split(p_name, '')) AS letter FROM part), n AS (SELECT letter, count(*) AS n FROM x WHERE letter <> '' GROUP BY 1) SELECT letter, n, round(n / sum(n) OVER (), 9) AS share FROM n")(lambda spark, d: lookups.letters_of(table(spark, d, "part"), "p_name").withColumn("share", F.round("share", 9)))
