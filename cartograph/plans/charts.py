"""Registered queries on titer tables and maps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import titer as T
from ..operators import maps, titers
from .fixtures import SERA_FROM, layout_number, view, with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, *views: str):
    """Registers a query under a name, and its SQL with the inputs that it uses."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql, *views)
        return f

    return add


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def layers(spark, d):
    return view(spark, d, "titer_layers")


def merged(spark, d):
    return titers.merge_layers(layers(spark, d)).select("antigen_no", "serum_no", "titer")


def homologous(m: DataFrame) -> DataFrame:
    return m.where((F.col("antigen_no") % 30 == F.col("serum_no") % 30) & (F.floor(F.col("antigen_no") / 120) == F.floor(F.col("serum_no") / 30))).select("antigen_no", "serum_no")


# ---- SQL blocks
MERGE = """
ml AS (SELECT antigen_no, serum_no, pfx, v, log2(v / 10.0) + CASE pfx WHEN '<' THEN -1 WHEN '>' THEN 1 ELSE 0 END AS lt,
    max(CASE WHEN pfx = '' THEN v END) OVER c AS most, min(CASE WHEN pfx = '' THEN v END) OVER c AS least
  FROM titer_layers WINDOW c AS (PARTITION BY antigen_no, serum_no)),
ma AS (SELECT antigen_no, serum_no, count(*) FILTER (pfx = '<') AS nl, count(*) FILTER (pfx = '>') AS nm, count(*) FILTER (pfx = '') AS nr,
    min(v) FILTER (pfx = '<') AS minl, max(v) FILTER (pfx = '>') AS maxm, max(most) AS most, min(least) AS least, stddev_pop(lt) AS sd, avg(lt) AS mean,
    min(v) FILTER (pfx = '<' AND v > most) AS above, max(v) FILTER (pfx = '>' AND v < least) AS below
  FROM ml GROUP BY 1, 2),
merged_all AS (SELECT antigen_no, serum_no,
    CASE WHEN nl > 0 AND nm > 0 THEN '*' WHEN nr = 0 AND nl > 0 THEN concat('<', CAST(minl AS STRING)) WHEN nr = 0 THEN {only_more}
      WHEN sd > 1 + 1e-9 THEN '*' WHEN nl = 0 AND nm = 0 THEN CAST(CAST(round(pow(2, mean) * 10) AS BIGINT) AS STRING)
      WHEN nl > 0 THEN concat('<', CAST(coalesce(above, 2 * most) AS STRING)) ELSE concat('>', CAST(coalesce(below, least // 2) AS STRING)) END AS titer,
    CASE WHEN nl > 0 AND nm > 0 THEN 'less_than_and_more_than' WHEN nr = 0 AND nl > 0 THEN 'less_than_only' WHEN nr = 0 THEN 'more_than_only_{mode}'
      WHEN sd > 1 + 1e-9 THEN 'sd_too_big' WHEN nl = 0 AND nm = 0 THEN 'regular_only' WHEN nl > 0 THEN 'less_than_and_regular' ELSE 'more_than_and_regular' END AS reason
  FROM ma)"""
MERGED = "+" + MERGE.format(only_more="'*'", mode="to_dont_care")
PARTS = MERGED + """,
m AS (SELECT antigen_no, serum_no, titer, CASE WHEN titer SIMILAR TO '[<>~*].*' THEN substr(titer, 1, 1) ELSE '' END AS p,
    TRY_CAST(regexp_replace(titer, '[^0-9]', '', 'g') AS INT) AS v FROM merged_all),
bases AS (SELECT serum_no, greatest(0.0, max(CASE WHEN p IN ('*', '~') THEN -1.0 ELSE log2(v / 10.0) + CASE WHEN p = '>' THEN 1 ELSE 0 END END)) AS column_basis FROM m GROUP BY 1),
edges AS (SELECT antigen_no AS p1, serum_no + 1000000 AS p2, CASE p WHEN '' THEN 'regular' ELSE 'less_than' END AS kind, greatest(0.0, column_basis - log2(v / 10.0)) AS distance
  FROM m JOIN bases USING (serum_no) WHERE p IN ('', '<'))"""
EDGES = PARTS + """,
md AS (SELECT e.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS map_distance
  FROM edges e JOIN layout a ON a.point_no = p1 JOIN layout b ON b.point_no = p2),
co AS (SELECT *, CASE kind WHEN 'regular' THEN pow(distance - map_distance, 2)
    ELSE pow(distance - map_distance + 1, 2) / (1 + exp(-10 * (distance - map_distance + 1))) END AS contribution FROM md)"""
L, ML = ("titer_layers",), ("titer_layers", "layout")


@query("a1_merge_layers", MERGED + " SELECT * FROM merged_all", *L)
def a1(spark, d):
    return titers.merge_layers(layers(spark, d))


@query("a2_merge_adjust_to_next", "+" + MERGE.format(only_more="concat('>', CAST(maxm AS STRING))", mode="adjust_to_next") + " SELECT * FROM merged_all", *L)
def a2(spark, d):
    return titers.merge_layers(layers(spark, d), "adjust_to_next")


@query("a2_forced_bases", "+" + MERGE.format(only_more="concat('>', CAST(maxm AS STRING))", mode="adjust_to_next") + """
SELECT serum_no, round(greatest(0.0, max(CASE WHEN titer = '*' THEN -1.0 ELSE log2(CAST(regexp_replace(titer, '[<>]', '') AS INT) / 10.0) + CASE WHEN titer LIKE '>%' THEN 1 ELSE 0 END END)), 6) AS forced
FROM merged_all WHERE EXISTS (SELECT 1 FROM titer_layers WHERE pfx = '>') GROUP BY 1""", *L)
def a2_bases(spark, d):
    return rounded(titers.merge_with_bases(layers(spark, d))[1], "forced")


@query("a3_merge_report", MERGED + " SELECT reason, count(*) AS cells FROM merged_all GROUP BY 1", *L)
def a3(spark, d):
    return titers.merge_layers(layers(spark, d)).groupBy("reason").agg(F.count("*").alias("cells"))


@query("a4_column_bases", PARTS + " SELECT serum_no, round(column_basis, 6) AS column_basis FROM bases", *L)
def a4(spark, d):
    return rounded(titers.raw_column_bases(merged(spark, d)), "column_basis")


@query("a5_minimum_column_bases", PARTS + " SELECT serum_no, round(greatest(CASE WHEN serum_no % 7 = 0 THEN 9.0 ELSE column_basis END, 4.0), 6) AS column_basis FROM bases", *L)
def a5(spark, d):
    m = merged(spark, d)
    forced = m.select("serum_no").distinct().where("serum_no % 7 = 0").withColumn("forced", F.lit(9.0))
    return rounded(titers.column_bases(m, 4.0, forced), "column_basis")


@query("a6_percent_there", PARTS + " SELECT count(*) FILTER (titer <> '*') AS there, round(count(*) FILTER (titer <> '*') * 100.0 / (count(DISTINCT antigen_no) * count(DISTINCT serum_no)), 6) AS percent FROM m", *L)
def a6(spark, d):
    m = merged(spark, d)
    n = m.agg(F.count_distinct("antigen_no").alias("a"), F.count_distinct("serum_no").alias("s")).first()
    return titers.percent_there(m, n["a"], n["s"])


for _by in ("antigen_no", "serum_no"):
    query(f"a7_titrations_{_by[:-3]}", PARTS + f" SELECT {_by}, count(*) AS titrations FROM m WHERE titer <> '*' GROUP BY 1", *L)(lambda spark, d, by=_by: titers.titrations(merged(spark, d), by))
    query(f"a9_layers_of_{_by[:-3]}", f" SELECT {_by}, string_agg(CAST(layer_no AS STRING), ',' ORDER BY layer_no) AS layers, count(*) AS n_layers FROM (SELECT DISTINCT {_by}, layer_no FROM titer_layers) t GROUP BY 1", *L)(lambda spark, d, by=_by: titers.layers_of(layers(spark, d), by))
    query(f"a10_in_several_layers_{_by[:-3]}", f" SELECT {_by} FROM titer_layers GROUP BY 1 HAVING count(DISTINCT layer_no) > 1", *L)(lambda spark, d, by=_by: titers.layers_of(layers(spark, d), by).where("n_layers > 1").select(by))


@query("a8_max_table_distance", PARTS + " SELECT round(max(distance), 6) AS max_distance FROM edges", *L)
def a8(spark, d):
    m = merged(spark, d)
    return rounded(titers.max_table_distance(m, titers.raw_column_bases(m), SERA_FROM), "max_distance")


@query("a9_members_of_layer", " SELECT layer_no, count(DISTINCT antigen_no) AS antigens, count(DISTINCT serum_no) AS sera FROM titer_layers GROUP BY 1", *L)
def a9(spark, d):
    return titers.members_of_layer(layers(spark, d))


@query("a11_has_more_than", " SELECT layer_no, bool_or(pfx = '>') AS has_more_than FROM titer_layers GROUP BY 1", *L)
def a11(spark, d):
    return titers.has_more_than(layers(spark, d))


@query("a12_too_few_titers", PARTS + """, r AS (SELECT antigen_no AS point_no FROM m WHERE p = '' UNION ALL SELECT serum_no + 1000000 FROM m WHERE p = '')
SELECT point_no, n AS n_regular FROM (SELECT l.point_no, count(r.point_no) AS n FROM layout l LEFT JOIN r ON r.point_no = l.point_no GROUP BY 1) t WHERE n < 20""", *ML)
def a12(spark, d):
    return titers.too_few_titers(merged(spark, d), view(spark, d, "layout"), SERA_FROM, 20)


@query("a13_titrated_with", PARTS + " SELECT DISTINCT serum_no + 1000000 AS point_no FROM m WHERE titer <> '*' AND antigen_no = 7", *L)
def a13(spark, d):
    return titers.titrated_with(merged(spark, d), 7, SERA_FROM)


@query("a32_merge_duplicates", """+ titer_layers2 AS (SELECT antigen_no % 40 AS antigen_no, serum_no, pfx, v FROM titer_layers),
fl AS (SELECT antigen_no, serum_no, CASE WHEN v < 40 THEN '<' ELSE pfx END AS pfx, CASE WHEN v < 40 THEN 40 ELSE v END AS v FROM titer_layers2),
""" + MERGE.format(only_more="'*'", mode="to_dont_care").replace("FROM titer_layers", "FROM fl") + " SELECT * FROM merged_all", *L)
def a32(spark, d):
    return titers.merge_duplicates(layers(spark, d).withColumn("antigen_no", F.col("antigen_no") % 40), "<40")


@query("a31_drop_share", "+" + MERGED.removeprefix("+") + """, x AS (SELECT antigen_no, serum_no, titer, row_number() OVER (ORDER BY titer = '*', substr(md5(concat('1:', CAST(antigen_no AS STRING), ':', CAST(serum_no AS STRING))), 1, 15), antigen_no, serum_no) AS k,
  count(*) FILTER (titer <> '*') OVER () AS n FROM merged_all)
SELECT antigen_no, serum_no, CASE WHEN k <= floor(n * 0.25 + 0.5) THEN '*' ELSE titer END AS titer FROM x""", *L)
def a31(spark, d):
    return titers.drop_share(merged(spark, d), 0.25, 1)


@query("o9_ranked_titers", PARTS + """ SELECT antigen_no, serum_no, titer, row_number() OVER (PARTITION BY serum_no ORDER BY CASE p WHEN '*' THEN -1 WHEN '<' THEN v - 1 WHEN '>' THEN v + 1 ELSE v END, antigen_no) AS place FROM m""", *L)
def o9(spark, d):
    return titers.ranked_cells(merged(spark, d))


@query("t_scalars", """ SELECT DISTINCT titer, CASE pfx WHEN '<' THEN 'less_than' WHEN '>' THEN 'more_than' ELSE 'regular' END AS kind, round(log2(v / 10.0), 6) AS logged,
 round(log2(v / 10.0) + CASE pfx WHEN '<' THEN -1 WHEN '>' THEN 1 ELSE 0 END, 6) AS thresholded, round(log2(v / 10.0) + CASE pfx WHEN '>' THEN 1 ELSE 0 END, 6) AS for_bases,
 CASE pfx WHEN '<' THEN v // 2 WHEN '>' THEN v * 2 ELSE v END AS value_thresholded, concat(pfx, CAST(CAST(round(v * 1.5) AS BIGINT) AS STRING)) AS multiplied, CAST(v AS STRING) AS back FROM titer_layers""", *L)
def t_scalars(spark, d):
    t = F.col("titer")
    return layers(spark, d).select("titer").distinct().select("titer", T.kind(t).alias("kind"), F.round(T.logged(t), 6).alias("logged"), F.round(T.logged_with_thresholded(t), 6).alias("thresholded"), F.round(T.logged_for_column_bases(t), 6).alias("for_bases"), T.value_with_thresholded(t).alias("value_thresholded"), T.multiplied_by(t, 1.5).alias("multiplied"), T.from_logged(T.logged(t)).alias("back"))


@query("t9_multiply_and_dont_care", PARTS + " SELECT antigen_no, serum_no, CASE WHEN antigen_no = 5 AND titer <> '*' THEN concat(p, CAST(v * 2 AS STRING)) ELSE titer END AS titer FROM m WHERE serum_no <> 3", *L)
def t9(spark, d):
    return titers.multiply(merged(spark, d), 2.0, F.col("antigen_no") == 5).where("serum_no <> 3").select("antigen_no", "serum_no", "titer")


@query("t10_set_titers", PARTS + """, ch AS (SELECT antigen_no, serum_no, CASE WHEN antigen_no % 2 = 0 THEN '640' ELSE '*' END AS titer FROM m WHERE serum_no = 4)
SELECT m.antigen_no, m.serum_no, coalesce(ch.titer, m.titer) AS titer FROM m LEFT JOIN ch ON ch.antigen_no = m.antigen_no AND ch.serum_no = m.serum_no WHERE coalesce(ch.titer, m.titer) <> '*'""", *L)
def t10(spark, d):
    m = merged(spark, d)
    changes = m.where("serum_no = 4").select("antigen_no", "serum_no", F.when(F.col("antigen_no") % 2 == 0, "640").otherwise("*").alias("titer"))
    return titers.set_titers(m, changes)


@query("u3_remove_members", PARTS + """, r AS (SELECT * FROM m WHERE antigen_no % 3 <> 0 AND serum_no % 4 <> 1)
SELECT CAST(dense_rank() OVER (ORDER BY antigen_no) - 1 AS INT) AS antigen_no, CAST(dense_rank() OVER (ORDER BY serum_no) - 1 AS INT) AS serum_no, titer FROM r""", *L)
def u3(spark, d):
    m = merged(spark, d)
    gone = lambda c, e: m.select(c).distinct().where(e)
    return titers.remove_members(m, gone("antigen_no", "antigen_no % 3 = 0"), gone("serum_no", "serum_no % 4 = 1")).select("antigen_no", "serum_no", "titer")


def edges(spark, d):
    m = merged(spark, d)
    return titers.table_distances(m, titers.raw_column_bases(m), SERA_FROM)


def layout(spark, d):
    return view(spark, d, "layout")


@query("st1_table_distances", PARTS + " SELECT p1, p2, kind, round(distance, 6) AS distance FROM edges", *L)
def st1(spark, d):
    return rounded(edges(spark, d), "distance")


@query("st1_with_avidity_and_disconnected", PARTS + """, e AS (SELECT p1, p2, kind, greatest(0.0, column_basis - log2(v / 10.0) - CASE WHEN antigen_no % 10 = 0 THEN 1.0 ELSE 0.0 END) AS distance FROM (SELECT *, antigen_no AS p1, serum_no + 1000000 AS p2, CASE p WHEN '' THEN 'regular' ELSE 'less_than' END AS kind FROM m JOIN bases USING (serum_no) WHERE p IN ('', '<')) t)
SELECT p1, p2, kind, round(distance, 6) AS distance FROM e WHERE p1 % 15 <> 1""", *L)
def st1b(spark, d):
    m = merged(spark, d)
    points = layout(spark, d).select("point_no")
    avidity = points.where("point_no < 1000000 and point_no % 10 = 0").withColumn("logged_adjust", F.lit(1.0))
    return rounded(titers.table_distances(m, titers.raw_column_bases(m), SERA_FROM, avidity, points.where("point_no < 1000000 and point_no % 15 = 1")), "distance").select("p1", "p2", "kind", "distance")


@query("st2_map_distances", EDGES + " SELECT p1, p2, round(map_distance, 6) AS map_distance FROM md", *ML)
def st2(spark, d):
    return rounded(maps.with_map_distances(edges(spark, d), layout(spark, d)).select("p1", "p2", "map_distance"), "map_distance")


@query("st3_stress", EDGES + " SELECT round(sum(contribution), 4) AS stress FROM co", *ML)
def st3(spark, d):
    return rounded(maps.stress(edges(spark, d), layout(spark, d)), "stress", places=4)


@query("st4_point_contributions", EDGES + " SELECT point_no, round(sum(contribution), 5) AS contribution FROM (SELECT p1 AS point_no, contribution FROM co UNION ALL SELECT p2, contribution FROM co) t GROUP BY 1", *ML)
def st4(spark, d):
    return rounded(maps.point_contributions(edges(spark, d), layout(spark, d)), "contribution", places=5)


@query("st5_gradient", EDGES + """, g AS (SELECT *, CASE WHEN map_distance = 0 THEN 1e-5 ELSE map_distance END AS mm FROM md),
g2 AS (SELECT *, distance - mm AS dd, distance - mm + 1 AS low, 1 / (1 + exp(-10 * (distance - mm + 1))) AS s FROM g),
g3 AS (SELECT *, -(CASE kind WHEN 'regular' THEN 2 * dd ELSE 2 * low * s + low * low * s * (1 - s) * 10 END) / mm AS f FROM g2),
g4 AS (SELECT p1 AS point_no, f * (ax - bx) AS dx, f * (ay - by_) AS dy FROM g3 UNION ALL SELECT p2, -f * (ax - bx), -f * (ay - by_) FROM g3)
SELECT point_no, round(sum(CASE WHEN point_no % 9 = 0 THEN 0 ELSE dx END), 5) + 0.0 AS dx, round(sum(CASE WHEN point_no % 9 = 0 THEN 0 ELSE dy END), 5) + 0.0 AS dy FROM g4 GROUP BY 1""", *ML)
def st5(spark, d):
    lay = layout(spark, d)
    g = rounded(maps.gradient(edges(spark, d), lay, lay.where("point_no % 9 = 0")), "dx", "dy", places=5)
    return g.select("point_no", (F.col("dx") + 0.0).alias("dx"), (F.col("dy") + 0.0).alias("dy"))


@query("st7_error_lines", EDGES + """ SELECT p1, p2, round(CASE kind WHEN 'regular' THEN distance - map_distance ELSE (distance - map_distance + 1) * sqrt(1 / (1 + exp(-10 * (distance - map_distance + 1)))) END, 6) + 0.0 AS error FROM md""", *ML)
def st7(spark, d):
    return rounded(maps.error_lines(edges(spark, d), layout(spark, d)), "error").withColumn("error", F.col("error") + 0.0)


@query("a29_layout_bounds", " SELECT min(x) AS min_x, max(x) AS max_x, round(avg(x), 6) AS mean_x, min(y) AS min_y, max(y) AS max_y, round(avg(y), 6) AS mean_y, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM layout", "layout")
def a29(spark, d):
    return rounded(maps.bounds(layout(spark, d)), "mean_x", "mean_y")


@query("a29_extreme_points", " SELECT arg_min(point_no, x * 100000000 + point_no) AS min_x_point, arg_max(point_no, x * 100000000 + point_no) AS max_x_point, arg_min(point_no, y * 100000000 + point_no) AS min_y_point, arg_max(point_no, y * 100000000 + point_no) AS max_y_point FROM layout", "layout")
def a29b(spark, d):
    return maps.extreme_points(layout(spark, d))


@query("a30_area_intersection", """ SELECT greatest(0.0, least(a.mx, b.mx) - greatest(a.nx, b.nx)) * greatest(0.0, least(a.my, b.my) - greatest(a.ny, b.ny)) AS area
FROM (SELECT min(x) AS nx, max(x) AS mx, min(y) AS ny, max(y) AS my FROM layout WHERE point_no < 1000000) a, (SELECT min(x) AS nx, max(x) AS mx, min(y) AS ny, max(y) AS my FROM layout WHERE point_no >= 1000000) b""", "layout")
def a30(spark, d):
    lay = layout(spark, d)
    return maps.intersection_area(lay.where("point_no < 1000000"), lay.where("point_no >= 1000000"))


@query("la1_transform", " SELECT point_no, round(0.6 * x - 0.8 * y + 2, 6) AS x, round(0.8 * x + 0.6 * y - 1, 6) AS y FROM layout", "layout")
def la1(spark, d):
    return rounded(maps.transform(layout(spark, d), [0.6, 0.8, -0.8, 0.6], [2.0, -1.0]), "x", "y")


@query("la5_all_pairs", " SELECT a.point_no AS p1, b.point_no AS p2, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS map_distance FROM chart_layout a JOIN chart_layout b ON a.point_no < b.point_no", "chart_layout")
def la5(spark, d):
    return rounded(maps.all_pairs(view(spark, d, "chart_layout")), "map_distance")


@query("pr1_procrustes", " SELECT point_no AS primary_no, point_no AS secondary_no, 0.0 AS distance FROM layout", "layout")
def pr1(spark, d):
    """A rotated, flipped and moved copy comes back onto the original."""
    lay = view(spark, d, "layout_apart")
    moved = maps.transform(lay, maps.multiply(maps.rotation(0.7), maps.flip(1.0, 2.0)), [5.0, -3.0])
    common = lay.select(F.col("point_no").alias("primary_no"), F.col("point_no").alias("secondary_no"))
    matrix, translation, _, _ = maps.procrustes(lay, moved, common)
    found = maps.procrustes_distances(lay, moved, common, matrix, translation)
    return found.select(layout_number("primary_no").alias("primary_no"), layout_number("secondary_no").alias("secondary_no"), F.abs(F.round("distance", 5)).alias("distance"))


HOME = EDGES + ", home AS (SELECT antigen_no, serum_no, titer, p, v FROM m WHERE antigen_no % 30 = serum_no % 30 AND antigen_no // 120 = serum_no // 30)"


@query("ci1_theoretical_circles", HOME + """, each_ AS (SELECT serum_no, antigen_no, 2 + column_basis - log2(v / 10.0) AS radius FROM home JOIN bases USING (serum_no) WHERE p = '')
SELECT serum_no, antigen_no, round(radius, 6) AS radius, round(greatest(2.0, min(radius) OVER (PARTITION BY serum_no)), 6) AS serum_radius FROM each_""", *ML)
def ci1(spark, d):
    m = merged(spark, d)
    return rounded(maps.theoretical_circles(homologous(m), m, titers.raw_column_bases(m)), "radius", "serum_radius").select("serum_no", "antigen_no", "radius", "serum_radius")


@query("ci2_empirical_circles", HOME + """, hb AS (SELECT home.*, column_basis, least(column_basis, CASE WHEN p IN ('*', '~') THEN -1.0 ELSE log2(v / 10.0) + CASE WHEN p = '>' THEN 1 ELSE 0 END END) - 2 AS boundary FROM home JOIN bases USING (serum_no)),
st AS (SELECT hb.*, CASE WHEN p <> '' THEN 'non_regular_homologous' WHEN boundary < 1 THEN 'titer_too_low' ELSE 'good' END AS status FROM hb),
nr AS (SELECT g.serum_no, g.antigen_no AS home, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist,
   CASE WHEN t.p = '' THEN least(g.column_basis, log2(t.v / 10.0)) >= g.boundary ELSE least(g.column_basis, log2(t.v / 10.0)) > g.boundary END AS prot
  FROM st g JOIN m t ON t.serum_no = g.serum_no JOIN layout a ON a.point_no = t.antigen_no JOIN layout b ON b.point_no = t.serum_no + 1000000 WHERE g.status = 'good' AND t.titer <> '*'),
ca AS (SELECT serum_no, home, coalesce((dist + lag(dist) OVER (PARTITION BY serum_no, home ORDER BY dist)) / 2, dist) AS r FROM nr),
su AS (SELECT ca.serum_no, ca.home, ca.r, count(*) FILTER (prot AND dist > r) + count(*) FILTER (NOT prot AND dist <= r) AS wrong FROM (SELECT DISTINCT * FROM ca) ca JOIN nr ON nr.serum_no = ca.serum_no AND nr.home = ca.home GROUP BY 1, 2, 3),
be AS (SELECT su.*, min(wrong) OVER (PARTITION BY serum_no, home) AS least_ FROM su),
ra AS (SELECT c.serum_no, c.home, avg(c.r) AS radius FROM ca c JOIN be ON be.serum_no = c.serum_no AND be.home = c.home AND be.r = c.r WHERE wrong = least_ GROUP BY 1, 2)
SELECT st.serum_no, st.antigen_no, status, round(radius, 5) AS radius FROM st LEFT JOIN ra ON ra.serum_no = st.serum_no AND ra.home = st.antigen_no""", *ML)
def ci2(spark, d):
    m = merged(spark, d)
    return rounded(maps.empirical_circles(homologous(m), m, titers.raw_column_bases(m), layout(spark, d), SERA_FROM), "radius", places=5)


@query("ci4_serum_coverage", HOME + """ SELECT h.serum_no, h.antigen_no AS home, m.antigen_no, log2(m.v / 10.0) + CASE m.p WHEN '<' THEN -1 WHEN '>' THEN 1 ELSE 0 END >= log2(h.v / 10.0) - 2 AS within FROM home h JOIN m ON m.serum_no = h.serum_no WHERE h.p = '' AND m.titer <> '*'""", *ML)
def ci4(spark, d):
    m = merged(spark, d)
    return maps.serum_coverage(homologous(m), m)
