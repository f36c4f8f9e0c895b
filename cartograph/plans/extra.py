"""Further registered queries on maps, sequence ends and trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import maps, sequences, titers, trees
from .charts import HOME, homologous, layout, merged
from .fixtures import SERA_FROM, view, with_views
from .sequences import LETTERS, NSEQ, leafseqs, seqs

QUERIES, SQL = {}, {}


def query(name, sql, *views):
    def add(f):
        QUERIES[name] = f
        SQL[name] = with_views(sql, *views)
        return f

    return add


CIRCLE = HOME + """,
hm AS (SELECT serum_no, arg_min(boundary, antigen_no) AS boundary, any_value(column_basis) AS column_basis
  FROM (SELECT serum_no, antigen_no, column_basis, least(column_basis, log2(v / 10.0) + CASE WHEN p = '>' THEN 1 ELSE 0 END) - 2 AS boundary FROM home JOIN bases USING (serum_no) WHERE titer <> '*') t WHERE boundary >= 1 GROUP BY 1),
ce AS (SELECT avg(x) AS cx, avg(y) AS cy FROM layout WHERE point_no - 1000000 IN (SELECT serum_no FROM m)),
vo AS (SELECT antigen_no, count(*) FILTER (CASE WHEN p = '' THEN least(column_basis, log2(v / 10.0)) >= boundary ELSE least(column_basis, log2(v / 10.0) + CASE WHEN p = '>' THEN 1 ELSE 0 END) > boundary END) AS yes FROM m JOIN hm USING (serum_no) WHERE titer <> '*' GROUP BY 1),
ag AS (SELECT coalesce(yes, 0) AS yes, (SELECT count(*) FROM hm) - coalesce(yes, 0) AS no, sqrt(pow(x - (SELECT cx FROM ce), 2) + pow(y - (SELECT cy FROM ce), 2)) AS dist FROM layout LEFT JOIN vo ON antigen_no = point_no WHERE point_no < 1000000),
ds AS (SELECT yes > no AS prot, dist FROM ag WHERE yes <> no {cond}),
ca AS (SELECT coalesce((dist + lag(dist) OVER (ORDER BY dist)) / 2, dist) AS r FROM ds),
ct AS (SELECT count(*) AS n, count(*) FILTER (prot) AS n_protected FROM ds),
su AS (SELECT r, (SELECT count(*) FROM ds WHERE prot AND dist > r) + (SELECT count(*) FROM ds WHERE NOT prot AND dist <= r) AS wrong FROM ca)
SELECT round(cx, 6) AS x, round(cy, 6) AS y, n, n_protected, CASE WHEN n_protected > 0 AND n_protected < n THEN (SELECT round(avg(r), 5) FROM su WHERE wrong = (SELECT min(wrong) FROM su)) END AS radius FROM ce, ct"""


def several(spark, d, conservative):
    m = merged(spark, d)
    sera = m.select("serum_no").distinct()
    out = maps.circle_for_several_sera(homologous(m), m, titers.raw_column_bases(m), layout(spark, d), sera, SERA_FROM, conservative=conservative)
    return out.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n", "n_protected", F.round("radius", 5).alias("radius"))


query("ci3_circle_for_several_sera", CIRCLE.format(cond=""), "titer_layers", "layout")(lambda spark, d: several(spark, d, False))
query("ci3_circle_conservative", CIRCLE.format(cond="AND (yes = 0 OR no = 0)"), "titer_layers", "layout")(lambda spark, d: several(spark, d, True))


@query("pr3_summary", """+ ds AS (SELECT a.point_no AS no, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM layout a JOIN layout b ON b.point_no = a.point_no + 30 WHERE a.point_no < 1000000)
SELECT count(*) AS n, round(avg(d), 6) AS mean, round(sqrt(avg(d * d)), 6) AS rms, round(max(d), 6) AS longest, (SELECT min(no) FROM ds WHERE d = (SELECT max(d) FROM ds)) AS longest_no FROM ds""", "layout")
def pr3(spark, d):
    """Antigens against the points 30 places on, not moved."""
    lay = layout(spark, d)
    common = lay.where("point_no < 1000000").select(F.col("point_no").alias("primary_no"), (F.col("point_no") + 30).alias("secondary_no"))
    out = maps.procrustes_summary(maps.procrustes_distances(lay, lay, common, [1.0, 0.0, 0.0, 1.0], [0.0, 0.0]))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "rms", "longest")), "longest_no")


VARIANT = "CASE seq_no % 5 WHEN 0 THEN substr(aa, 1, 30) WHEN 1 THEN concat(aa, 'WWWW') WHEN 2 THEN concat(aa, substr(aa, 30, 3)) WHEN 3 THEN concat(substr(aa, 1, 29), 'WWW') ELSE concat(substr(aa, 1, 29), 'WWWWW') END"
UNLIKE = "(" + " + ".join(f"CASE WHEN substr({{a}}, {k}, 1) <> substr({{b}}, {k}, 1) THEN 1 ELSE 0 END" for k in (1, 2, 3)) + ") > 1"
TAIL, PLACE = UNLIKE.format(a="right(v, 3)", b="right(aa, 3)"), UNLIKE.format(a="substr(v, length(aa) - 2, 3)", b="right(aa, 3)")


@query("sq9_ending", f"""+ vs AS (SELECT seq_no, aa, {VARIANT} AS v FROM seqs)
SELECT seq_no, CASE WHEN length(v) > length(aa) AND {TAIL} AND NOT {PLACE} THEN substr(v, 1, length(aa)) ELSE v END AS aa,
CASE WHEN length(v) < length(aa) THEN 's' WHEN length(v) > length(aa) THEN CASE WHEN NOT {TAIL} THEN 'l' WHEN NOT {PLACE} THEN '' ELSE 'lE' END WHEN {TAIL} THEN 'E' ELSE '' END AS issues FROM vs""", "seqs")
def sq9(spark, d):
    """Each sequence is the master of a variant of itself."""
    rows = seqs(spark, d).select("seq_no", "aa", F.expr(VARIANT).alias("v"))
    return rows.select("seq_no", S.checked_ending(F.col("v"), F.col("aa")).alias("e")).select("seq_no", "e.aa", "e.issues")


NAMED = "CASE seq_no % 3 WHEN 0 THEN concat(name, '_', CAST(seq_no AS STRING)) WHEN 1 THEN concat('old_', substr(hash, 1, 8)) ELSE 'unknown name' END"


@query("j15_fixed_names", f"""+ ss AS (SELECT seq_no, {NAMED} AS leaf, concat(name, '_', CAST(seq_no AS STRING)) AS seq_id, substr(hash, 1, 8) AS h FROM seqs),
hh AS (SELECT h, min(seq_id) AS seq_id FROM ss GROUP BY 1)
SELECT ss.seq_no, ss.leaf AS name, CASE seq_no % 3 WHEN 0 THEN ss.seq_id WHEN 1 THEN hh.seq_id END AS fixed FROM ss LEFT JOIN hh ON hh.h = right(ss.leaf, 8) AND seq_no % 3 = 1""", "seqs")
def j15(spark, d):
    """A third of the leaves have names of sequences, a third end in a hash, the others are unknown."""
    s = seqs(spark, d)
    known = s.select(F.concat_ws("_", "name", F.col("seq_no").cast("string")).alias("seq_id"), F.substring("hash", 1, 8).alias("hash"))
    return trees.fixed_names(s.select("seq_no", F.expr(NAMED).alias("name")), known)


@query("u10_old_isolated_leaves", """+ dn AS (SELECT *, CASE WHEN is_leaf THEN concat('20', CAST(10 + node_id % 12 AS STRING), '-01-01') END AS date FROM nodes),
cn AS (SELECT parent_id, count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1),
od AS (SELECT dn.node_id, n, row_number() OVER (PARTITION BY dn.parent_id ORDER BY date, child_order) AS k FROM dn JOIN cn ON cn.parent_id = dn.parent_id WHERE is_leaf AND date < '2016-01-01' AND name <> 'Customer#000000001')
SELECT node_id FROM od WHERE k <= n - 2""", "nodes")
def u10(spark, d):
    dated = view(spark, d, "nodes").withColumn("date", F.when(F.col("is_leaf"), F.concat(F.lit("20"), (10 + F.col("node_id") % 12).cast("string"), F.lit("-01-01"))))
    return trees.old_isolated_leaves(dated, "2016-01-01", ["Customer#000000001"])


@query("u11_on_one_side", """ SELECT 'first' AS side, CAST(seq_no AS BIGINT) AS no FROM seqs WHERE seq_no NOT IN (SELECT node_id FROM nodes WHERE is_leaf)
UNION ALL SELECT 'second', node_id FROM nodes WHERE is_leaf AND node_id NOT IN (SELECT seq_no FROM seqs)""", "nodes", "seqs")
def u11(spark, d):
    return sequences.on_one_side(seqs(spark, d).select(F.col("seq_no").cast("long").alias("no")), view(spark, d, "nodes").where("is_leaf").select(F.col("node_id").alias("no")), "no")


query("a27_longest_sequence", " SELECT max(length(aa)) AS longest, count(*) FILTER (length(aa) = 32) AS whole FROM seqs", "seqs")(lambda spark, d: seqs(spark, d).agg(F.max(F.length("aa")).alias("longest"), F.count_if(F.length("aa") == 32).alias("whole")))
query("a21_difference_positions", LETTERS.replace("FROM seqs)", "FROM seqs WHERE seq_no < 3)") + " SELECT pos, count(DISTINCT letter) AS letters FROM lc GROUP BY 1 HAVING count(DISTINCT letter) > 1", "seqs")(lambda spark, d: sequences.diverse_positions(sequences.letter_counts(seqs(spark, d).where("seq_no < 3"))))
