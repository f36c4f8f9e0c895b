"""Registered queries on optimisation, parsers, semantic rules and event windows, with SQL where it can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import dates, names, passages
from ..operators import locations, lookups, maps, matching, optimise, projections, semantic, titers
from ..streaming import events as stream
from .charts import MERGED, layout
from .fixtures import N_ANTIGENS, N_SERA, view, with_views
from .sequences import antigens, seqs

QUERIES, SQL = {}, {}


def query(name, sql=None, *views):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def edges(spark, d):
    """Distances of one chart."""
    m = titers.merge_layers(view(spark, d, "chart_layers")).select("antigen_no", "serum_no", "titer")
    return titers.table_distances(m, titers.raw_column_bases(m), N_ANTIGENS)


def points(spark, d) -> np.ndarray:
    """The fixed layout as an array; not all points need be there."""
    out = np.full((N_ANTIGENS + N_SERA, 2), np.nan)
    for r in view(spark, d, "chart_layout").collect():  # one chart's points
        out[r.point_no] = (r.x, r.y)
    return out


@query("relax_many_starts")
def relax(spark, d):
    """A hundred maps from random starts."""
    return optimise.relax(spark, edges(spark, d), N_ANTIGENS + N_SERA, 100, precision="rough").groupBy("start").agg(F.round(F.first("stress"), 3).alias("stress"), F.count("coord").alias("points"))


@query("relax_annealed")
def relax_annealed(spark, d):
    """From five dimensions down to two."""
    return optimise.relax(spark, edges(spark, d), N_ANTIGENS + N_SERA, 2, annealing_from=5, precision="rough").groupBy("start").agg(F.round(F.first("stress"), 3).alias("stress"))


@query("relax_incremental")
def relax_incremental(spark, d):
    known = points(spark, d)
    known[::9] = np.nan
    return optimise.relax_incremental(spark, edges(spark, d), known, 4, freeze=True, fine=2).groupBy("start").agg(F.round(F.first("stress"), 3).alias("stress"))


@query("gt1_grid_test")
def grid(spark, d):
    return optimise.grid_test(spark, edges(spark, d), points(spark, d))


@query("gt2_untrapped")
def untrapped(spark, d):
    """Rounds of the loop over trapped points, from the layout as it is."""
    return projections.untrapped(spark, edges(spark, d), points(spark, d))[2].withColumn("stress", F.round("stress", 3))


@query("av1_avidity_test")
def avidity(spark, d):
    return optimise.avidity_test(spark, edges(spark, d), np.nan_to_num(points(spark, d)), list(range(N_ANTIGENS)))


@query("av1_best_adjust")
def best_adjust(spark, d):
    return optimise.best_avidity(avidity(spark, d))


@query("st3_stress_of_relaxed", "SELECT 0.0 AS difference")
def relaxed_stress(spark, d):
    """The kernel's stress against the relational one on the map it found: the difference is 0."""
    best = optimise.best(optimise.relax(spark, edges(spark, d), N_ANTIGENS + N_SERA, 2, precision="rough"), 1)
    lay = best.where("coord is not null").select("point_no", F.col("coord")[0].alias("x"), F.col("coord")[1].alias("y"))
    return maps.stress(edges(spark, d), lay).crossJoin(best.select(F.col("stress").alias("found")).limit(1)).select(F.abs(F.round(F.col("stress") - F.col("found"), 4)).alias("difference"))  # one row each


A = ("antigens",)
PLACE = "split_part(name, '/', 2)"
query("n1_virus_names", f" SELECT seq_no, name, 'A' AS subtype, '' AS host, CASE {PLACE} WHEN 'EN' THEN 'ENGLAND' WHEN 'FR' THEN 'FRANCE' ELSE {PLACE} END AS location, split_part(name, '/', 3) AS isolation, split_part(name, '/', 4) AS year, '' AS reassortant, '' AS extra, CASE {PLACE} WHEN 'EN' THEN 'UNITED KINGDOM' WHEN 'FR' THEN 'FRANCE' ELSE '' END AS country, CASE WHEN {PLACE} IN ('EN', 'FR') THEN '' ELSE 'unrecognized_location' END AS issue FROM seqs", "seqs")(lambda spark, d: names.parse_names(seqs(spark, d).select("seq_no", "name"), spark.createDataFrame([("EN", "ENGLAND", "UNITED KINGDOM"), ("FR", "FRANCE", "FRANCE")], "name string, location string, country string"), this_year=2026))
query("n8_passages", """ SELECT antigen_no, CASE WHEN passage LIKE 'E%' THEN 'egg' ELSE 'cell' END AS kind, CASE WHEN passage LIKE '%0' THEN passage ELSE passage END AS text FROM antigens""", *A)(lambda spark, d: antigens(spark, d).withColumn("p", passages.parsed(F.col("passage"))).select("antigen_no", passages.kind(F.col("p")).alias("kind"), F.col("p.text").alias("text")))
query("d1_dates", " SELECT antigen_no, date FROM antigens", *A)(lambda spark, d: antigens(spark, d).select("antigen_no", dates.parse_date(F.concat_ws("/", F.substring("date", 9, 2), F.substring("date", 6, 2), F.substring("date", 1, 4))).alias("date")))
query("d3_older_than", " SELECT antigen_no, date < '2015-03-01' AS older FROM antigens", *A)(lambda spark, d: antigens(spark, d).select("antigen_no", dates.older_than(F.col("date"), "2015-09-17", 6).alias("older")))
query("t1_calendar_series", " SELECT CAST(b AS DATE) AS begin, CAST(b + INTERVAL 1 MONTH AS DATE) AS \"end\" FROM range(DATE '2019-05-01', DATE '2021-02-10', INTERVAL 1 MONTH) t(b)")(lambda spark, d: dates.series(spark, "2019-05-17", "2021-02-10"))
query("t1_weeks", " SELECT CAST(b AS DATE) AS begin, CAST(b + INTERVAL 7 DAY AS DATE) AS \"end\" FROM range(DATE '2021-01-04', DATE '2021-03-01', INTERVAL 7 DAY) t(b)")(lambda spark, d: dates.series(spark, "2021-01-06", "2021-03-01", "week"))
query("t1_counts_by_month", "+ m AS (SELECT CAST(date_trunc('month', CAST(isolation_date AS DATE)) AS DATE) AS begin, count(*) AS n FROM seqs GROUP BY 1) SELECT begin, n, lag(n) OVER (ORDER BY begin) AS before FROM m", "seqs")(lambda spark, d: dates.by_period(seqs(spark, d), "isolation_date"))
query("n15_lineage", " SELECT antigen_no, CASE lineage WHEN 'V' THEN 'V' WHEN 'Y' THEN 'Y' ELSE '' END AS lineage FROM antigens", *A)(lambda spark, d: antigens(spark, d).select("antigen_no", names.lineage(F.when(F.col("lineage") == "V", "Victoria").when(F.col("lineage") == "Y", "yamagata").otherwise("")).alias("lineage")))


def places(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    r = spark.read.parquet(f"{d}/region.parquet")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("location"), (F.col("n_nationkey") * 1.5).alias("latitude"), (F.col("n_nationkey") * 2.5).alias("longitude"), F.col("n_name").alias("country"), F.col("r_name").alias("continent"))


@query("j18_locations", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE n_name END AS place, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE r_name END AS continent
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def j18(spark, d):
    """Half of the names are aliases, a fifth are unknown."""
    c = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "nowhere").when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("old "), "n_name")).otherwise(F.lower("n_name")).alias("location"))
    dim = places(spark, d)
    named = dim.select(F.col("location").alias("name"), "location")
    return locations.resolve(rows, named, dim.select(F.concat(F.lit("old "), "location").alias("alias"), F.col("location").alias("name")), dim).select("c_custkey", "place", "continent")


query("j19_locations_like", "SELECT n_name AS location FROM nation WHERE n_name LIKE '%1%'")(lambda spark, d: locations.like(places(spark, d), "%1%").select("location"))
query("j19_locations_near", "SELECT n_name AS location FROM nation WHERE abs(n_nationkey * 1.5 - 7.5) <= 1.6 AND abs(n_nationkey * 2.5 - 12.5) <= 1.6")(lambda spark, d: locations.near(places(spark, d), 7.5, 12.5, 1.6).select("location"))
query("l1_abbreviations", "SELECT n_name AS location, CASE WHEN n_name LIKE '% %' THEN concat(substr(n_name, 1, 1), substr(split_part(n_name, ' ', 2), 1, 1)) ELSE concat(substr(n_name, 1, 1), lower(substr(n_name, 2, 1))) END AS short FROM nation")(lambda spark, d: places(spark, d).select("location", names.location_abbreviation(F.col("location"), F.col("country"), F.lit(None).cast("string")).alias("short")))


# ---- semantic attributes and rules
def attributed(spark, d):
    a = antigens(spark, d).withColumn("semantic", F.create_map().cast("map<string,string>"))
    a = semantic.with_attribute(a, "p", semantic.passage_type(F.col("reassortant"), matching.is_egg(F.col("passage"))))
    a = semantic.with_attribute(a, "age", semantic.age_mark(F.col("date"), "2016-06-20"))
    return semantic.with_attribute(a, "R", F.when(F.col("antigen_no") % 4 == 0, "1"))


P = "CASE WHEN reassortant <> '' THEN 'r' WHEN passage LIKE 'E%' THEN 'e' ELSE 'c' END"
AGE = "CASE WHEN date < '2015-06-01' THEN '12' WHEN date < '2015-12-01' THEN '6' END"
query("sm_attributes", f" SELECT antigen_no, {P} AS p, {AGE} AS age, CASE WHEN antigen_no % 4 = 0 THEN '1' END AS r FROM antigens", *A)(lambda spark, d: attributed(spark, d).select("antigen_no", F.col("semantic")["p"].alias("p"), F.col("semantic")["age"].alias("age"), F.col("semantic")["R"].alias("r")))
query("f24_selector", f" SELECT antigen_no FROM antigens WHERE {P} = 'e' AND {AGE} IS NULL AND date >= '2016-01-01' AND date < '2019-01-01'", *A)(lambda spark, d: attributed(spark, d).where(semantic.selector({"p": "e", "age": False, "!D": ("2016-01-01", "2019-01-01")})).select("antigen_no"))
RULES = [{"set": {"fill": "grey", "size": 1}, "title": "all"}, {"select": {"p": "e"}, "set": {"fill": "red"}, "title": "egg"}, {"select": {"R": True}, "set": {"outline": "black", "size": 3}, "title": "reference", "priority": 1}, {"select": {"age": "12"}, "set": {"fill": "pale", "size": 2}, "title": "old"}]
query("w10_styles", f" SELECT antigen_no, CASE WHEN {AGE} = '12' THEN 'pale' WHEN {P} = 'e' THEN 'red' ELSE 'grey' END AS fill, CASE WHEN antigen_no % 4 = 0 THEN 'black' END AS outline, CASE WHEN antigen_no % 4 = 0 THEN '3' WHEN {AGE} = '12' THEN '2' ELSE '1' END AS size FROM antigens", *A)(lambda spark, d: semantic.styled(attributed(spark, d), RULES).select("antigen_no", "fill", "outline", "size"))
query("sm10_legend", f" SELECT 0 AS place, 'all' AS title, count(*) AS n FROM antigens UNION ALL SELECT 1, 'egg', count(*) FROM antigens WHERE {P} = 'e' UNION ALL SELECT 2, 'reference', count(*) FROM antigens WHERE antigen_no % 4 = 0 UNION ALL SELECT 3, 'old', count(*) FROM antigens WHERE {AGE} = '12'", *A)(lambda spark, d: semantic.legend(attributed(spark, d), RULES))
query("sm8_vaccines", f" SELECT antigen_no, surrogate, row_number() OVER (PARTITION BY name, {P} ORDER BY antigen_no % 3 DESC, antigen_no) - 1 AS choice FROM antigens JOIN (SELECT min(p_name) AS name, true AS surrogate FROM part UNION ALL SELECT max(p_name), false FROM part) w USING (name)", *A)(lambda spark, d: semantic.vaccines(attributed(spark, d).withColumn("passage_type", F.col("semantic")["p"]).withColumn("n_layers", F.col("antigen_no") % 3), spark.read.parquet(f"{d}/part.parquet").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b")).select(F.explode(F.array(F.struct(F.col("a").alias("name"), F.lit(True).alias("surrogate")), F.struct(F.col("b").alias("name"), F.lit(False).alias("surrogate")))).alias("s")).select("s.*")).select("antigen_no", "surrogate", "choice"))
query("j25_user_over_collected", " SELECT antigen_no, CASE WHEN antigen_no % 10 = 0 THEN concat('user ', CAST(antigen_no AS STRING)) ELSE name END AS name, antigen_no % 10 = 0 AS from_user FROM antigens", *A)(lambda spark, d: semantic.user_over_collected(antigens(spark, d).where("antigen_no % 10 = 0").select("antigen_no", F.concat(F.lit("user "), F.col("antigen_no").cast("string")).alias("name")), antigens(spark, d).select("antigen_no", "name"), "antigen_no").select("antigen_no", "name", "from_user"))
query("sm12_data_fix", " SELECT antigen_no, regexp_replace(regexp_replace(passage, '^SIAT', 'S', 'g'), '0$', '?', 'g') AS passage FROM antigens", *A)(lambda spark, d: antigens(spark, d).select("antigen_no", semantic.fixed_by_rules(F.col("passage"), [("^SIAT", "S"), ("0$", "?")]).alias("passage")))


# ---- event windows, as batches of the streaming forms
def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


query("stream_tumbling_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(lambda spark, d: stream.tumbling_counts(events(spark, d)).select(F.col("begin").cast("timestamp").alias("begin"), "event_type", "n", F.round("total", 4).alias("total")))
query("stream_sessions", """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS begin, count(*) AS n FROM s GROUP BY user_id, k""")(lambda spark, d: stream.sessions(events(spark, d)).select("user_id", F.col("begin").cast("timestamp").alias("begin"), "n"))
query("stream_first_events", "SELECT event_id FROM events GROUP BY 1")(lambda spark, d: stream.first_events(events(spark, d)).select("event_id"))
query("stream_sliding_counts", "SELECT CAST(b AS TIMESTAMP) AS begin, count(*) AS n FROM (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS b FROM events, (VALUES (0), (1)) v(k)) t GROUP BY 1")(lambda spark, d: stream.sliding_counts(events(spark, d)).select(F.col("begin").cast("timestamp").alias("begin"), "n"))
query("js1_event_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.absent') IS NULL AS lacks FROM events")(lambda spark, d: events(spark, d).select("event_id", F.try_parse_json("props").alias("v")).select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.absent", "string").isNull().alias("lacks")))
query("mg2_mid_points", " SELECT a.point_no, round((a.x + b.x) / 2, 6) AS x, round((a.y + b.y) / 2, 6) AS y FROM layout a JOIN layout b ON b.point_no = a.point_no + 30 WHERE a.point_no < 1000000", "layout")(lambda spark, d: layout(spark, d).where("point_no < 1000000").join(layout(spark, d).select((F.col("point_no") - 30).alias("point_no"), F.col("x").alias("x2"), F.col("y").alias("y2")), "point_no").select("point_no", F.round((F.col("x") + F.col("x2")) / 2, 6).alias("x"), F.round((F.col("y") + F.col("y2")) / 2, 6).alias("y")))
query("o5_by_layers", " SELECT antigen_no, count(DISTINCT layer_no) AS n, max(layer_no) AS last FROM titer_layers GROUP BY 1", "titer_layers")(lambda spark, d: titers.by_layers(view(spark, d, "titer_layers")))
query("u7_union_of_disconnected", " SELECT DISTINCT point_no FROM layout WHERE point_no % 7 = 0 OR point_no % 11 = 0", "layout")(lambda spark, d: lookups.united_points(layout(spark, d).where("point_no % 7 = 0"), layout(spark, d).where("point_no % 11 = 0")))
query("sk3_table", MERGED + " SELECT antigen_no, " + ", ".join(f"max(CASE WHEN serum_no % {N_SERA} = {k} THEN titer END) AS \"{k}\"" for k in range(N_SERA)) + " FROM merged_all GROUP BY 1", "titer_layers")(lambda spark, d: titers.wide(titers.merge_layers(view(spark, d, "titer_layers")).withColumn("serum_no", F.col("serum_no") % N_SERA), list(range(N_SERA))))  # the sera of each antigen's chart
