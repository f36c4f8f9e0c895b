"""Registered queries on alignment, lookups, merged projections and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import alignment, lookups, maps, matching, projections
from .charts import merged
from .fixtures import SERA_FROM, layout_number, view, with_views
from .sequences import EGG, antigens, common_sql, sera, seqs

QUERIES, SQL = {}, {}


def query(name, sql=None, *views):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


# ---- alignment: each sequence gets the motif of a rule in its place, every fifth one without its middle letter
RULES = alignment.MOTIFS


def _sample(pattern: str) -> str:
    return pattern.replace("[^Q]", "A").replace("[^S]", "A")


def _heads() -> list[tuple[int, int, str, bool]]:
    """For each rule its number, letters before the motif, motif with what its first condition wants, whether it stands at the end."""
    out = []
    for k, (_, limit, motifs, shift, conditions) in enumerate(RULES):
        motif = motifs[k % len(motifs)]
        if conditions and limit != "end":
            offset, pattern = conditions[-1]
            motif = motif.ljust(offset, "G")[:offset] + _sample(pattern)
        out.append((k, max(0, -shift) if limit != "end" else 0, motif, limit == "end"))
    return out


HEADS = "(VALUES " + ", ".join(f"({k}, {lead}, '{text}', {str(end).lower()})" for k, lead, text, end in _heads()) + ") AS h(k, lead, motif, at_end)"
RAW = f"""SELECT seq_no, k, CASE WHEN at_end THEN concat(repeat('G', CAST(540 + seq_no % 15 AS INT)), motif) WHEN seq_no % 5 = 4 THEN concat(repeat('G', CAST(lead AS INT)), substr(motif, 1, 1), 'P', substr(motif, 3), aa)
 ELSE concat(repeat('G', CAST(greatest(0, lead - seq_no % 3) AS INT)), motif, aa) END AS aa FROM seqs JOIN {HEADS} ON k = seq_no % {len(RULES)}"""


def raw(spark, d):
    return spark.sql(RAW.replace("FROM seqs ", "FROM {seqs} "), seqs=seqs(spark, d))


def _rule_sql(k: int) -> tuple[str, str, str, str]:
    """Condition, subtype, shift and motif of a rule in SQL."""
    subtype, limit, motifs, shift, conditions = RULES[k]
    if limit == "end":
        cond = f"aa LIKE '%{motifs[0]}'"
        for offset, pattern in conditions:
            cond += f" AND (length(aa) < {-offset} OR substr(aa, length(aa) - {-offset} + 1, {len(pattern)}) = '{pattern}')"
        return cond, subtype, f"length(aa) - {-shift}", motifs[0]
    at = "coalesce(" + ", ".join(f"nullif(strpos(substr(aa, 1, {limit}), '{m}'), 0)" for m in motifs) + ")"
    cond = f"{at} IS NOT NULL"
    if conditions:
        cond += " AND (" + " OR ".join(f"regexp_matches(substr(aa, {at} + {o}, 20), '^{p}')" for o, p in conditions) + ")"
    return cond, subtype, f"{at} - 1 + {shift}", motifs[0]


FOUND = "CASE " + " ".join("WHEN {0} THEN {{{{'subtype': '{1}', 'shift': {2}, 'motif': '{3}'}}}}".format(*_rule_sql(k)) for k in range(len(RULES))) + " END"
FOUND = FOUND.replace("{{", "{").replace("}}", "}")
ALIGNED = f"""+ raw AS ({RAW}), fo AS (SELECT seq_no, k, aa, {FOUND} AS f FROM raw)"""


@query("sq4_alignment", ALIGNED + """ SELECT seq_no, f.subtype AS detected, CAST(f.shift AS INT) AS shift, CASE WHEN f IS NULL THEN 'A' WHEN f.shift < 0 THEN 'x' ELSE '' END AS issue,
 CASE WHEN f.shift < 0 THEN concat(repeat('X', CAST(-f.shift AS INT)), aa) WHEN f.shift >= 0 THEN substr(aa, CAST(f.shift AS INT) + 1) ELSE aa END AS aa FROM fo""", "seqs")
def sq4(spark, d):
    return alignment.aligned(raw(spark, d)).select("seq_no", "detected", "shift", "issue", "aa")


PROVIDED = "CASE seq_no % 4 WHEN 0 THEN '' WHEN 1 THEN 'A(H0)' WHEN 2 THEN 'A(H3N2)' ELSE 'B' END"
MASTER = "CASE seq_no % 3 WHEN 0 THEN 'A(H3)' WHEN 1 THEN 'B' ELSE 'A(H1)' END"
DETECTED = "CASE seq_no % 5 WHEN 0 THEN 'A(H3)' WHEN 1 THEN 'B' WHEN 2 THEN 'A(H1)' WHEN 3 THEN 'A(H7)' END"
H = "CASE WHEN {0} LIKE 'B%' THEN 'B' ELSE regexp_extract({0}, 'H[0-9]+') END"


@query("sq6_reconciled_subtypes", f"""+ p AS (SELECT seq_no, {PROVIDED} AS pr, {DETECTED} AS de, {MASTER} AS ma, seq_no % 200 AS di FROM seqs),
q AS (SELECT *, pr <> '' AND {H.format('pr')} <> 'H0' AS known, {H.format('pr')} <> {H.format('de')} AS other, di < 100 AND {H.format('ma')} = {H.format('de')} AS sure FROM p)
SELECT seq_no, CASE WHEN de IS NULL THEN pr WHEN NOT known THEN de WHEN other AND sure THEN de ELSE pr END AS subtype, coalesce(known AND other AND NOT sure, false) AS mismatch FROM q""", "seqs")
def sq6(spark, d):
    rows = seqs(spark, d).select("seq_no", F.expr(PROVIDED).alias("pr"), F.expr(DETECTED).alias("de"), F.expr(MASTER).alias("ma"), (F.col("seq_no") % 200).alias("di"))
    return rows.select("seq_no", alignment.reconciled(F.col("pr"), F.col("de"), F.col("ma"), F.col("di")).alias("r")).select("seq_no", "r.subtype", "r.mismatch")


GAPPED = "concat(repeat(aa, 5), substr(aa, 1, 1 + CASE seq_no % 6 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 3 END), CASE seq_no % 6 WHEN 1 THEN '-' WHEN 2 THEN '--' WHEN 3 THEN '---' WHEN 4 THEN '--' WHEN 5 THEN '-' ELSE '' END, aa)"


@query("sq8_lineages_of_gaps", """ SELECT seq_no, CASE WHEN told <> '' THEN told ELSE was END AS lineage, told <> '' AND was <> '' AND told <> was AS lineage_mismatch FROM (SELECT seq_no,
 CASE WHEN seq_no % 7 = 0 THEN '' ELSE CASE seq_no % 6 WHEN 1 THEN 'YAMAGATA' WHEN 2 THEN 'VICTORIA' WHEN 3 THEN 'VICTORIA' WHEN 4 THEN 'YAMAGATA' ELSE '' END END AS told,
 CASE seq_no % 3 WHEN 0 THEN '' WHEN 1 THEN 'VICTORIA' ELSE 'YAMAGATA' END AS was FROM seqs) t""", "seqs")
def sq8(spark, d):
    rows = seqs(spark, d).select("seq_no", F.expr(GAPPED).alias("aa"), F.expr("CASE WHEN seq_no % 7 = 0 THEN 'A(H3)' ELSE 'B' END").alias("subtype"), F.expr("CASE seq_no % 3 WHEN 0 THEN '' WHEN 1 THEN 'VICTORIA' ELSE 'YAMAGATA' END").alias("lineage"))
    return alignment.with_lineage(rows).select("seq_no", "lineage", "lineage_mismatch")


# ---- lookups
query("j1_find_by_name_and_hash", " SELECT seq_no FROM seqs WHERE (name, hash) IN (SELECT name, hash FROM seqs WHERE seq_no % 30 = 1)", "seqs")(lambda spark, d: lookups.find_sequences(seqs(spark, d), seqs(spark, d).where("seq_no % 30 = 1"), "name", "hash").select("seq_no"))
query("j1_find_by_hash", " SELECT seq_no FROM seqs WHERE hash IN (SELECT hash FROM seqs WHERE seq_no % 30 = 1)", "seqs")(lambda spark, d: lookups.find_sequences(seqs(spark, d), seqs(spark, d).where("seq_no % 30 = 1"), "hash").select("seq_no"))
HOMOLOGOUS = """+ p AS (SELECT serum_no, antigen_no, s.passage AS sp, a.passage AS ap, CASE WHEN CASE WHEN s.annotations LIKE 'CONC%' THEN '' ELSE s.annotations END = a.annotations THEN 1 ELSE 2 END AS tier
  FROM sera s JOIN antigens a ON a.name = s.name AND a.reassortant = s.reassortant AND """ + EGG.format(p="a.passage") + " = " + EGG.format(p="s.passage") + """),
b AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY serum_no) AS best FROM p) t WHERE tier = best),
k AS (SELECT *, sp = ap AS same, count(*) OVER (PARTITION BY serum_no) AS n, row_number() OVER (PARTITION BY serum_no ORDER BY CASE WHEN sp = ap THEN 1 ELSE 0 END DESC, antigen_no) AS k FROM b) SELECT serum_no, antigen_no FROM k WHERE """
for _mode, _cond in (("all", "true"), ("strict", "same AND k = 1"), ("relaxed", "k = 1"), ("relaxed_strict", "k = 1 AND (same OR n = 1)")):
    query(f"j11_homologous_{_mode}", HOMOLOGOUS + _cond, "antigens", "sera")(lambda spark, d, m=_mode: lookups.homologous(antigens(spark, d), sera(spark, d), m))
KIND = f"CASE WHEN reassortant <> '' THEN 'reassortant' WHEN {EGG.format(p='passage')} THEN 'egg' ELSE 'cell' END"


def described(spark, d):
    return lookups.described(antigens(spark, d), view(spark, d, "titer_layers"))


DESCRIBED = f"""+ ly AS (SELECT antigen_no, count(DISTINCT layer_no) AS n FROM titer_layers GROUP BY 1),
de AS (SELECT a.*, coalesce(n, 0) AS n_layers, {KIND} AS passage_kind, annotations LIKE '%DISTINCT%' AS dis FROM antigens a LEFT JOIN ly ON ly.antigen_no = a.antigen_no)"""
query("f16_described_antigens", DESCRIBED + " SELECT antigen_no, CAST(n_layers AS INT) AS n_layers, passage_kind, dis AS \"distinct\" FROM de", "antigens", "titer_layers")(lambda spark, d: described(spark, d).select("antigen_no", "n_layers", "passage_kind", "distinct"))
query("f15_select_antigens", DESCRIBED + " SELECT antigen_no FROM de WHERE n_layers > 1 AND passage_kind = 'egg' AND NOT dis", "antigens", "titer_layers")(lambda spark, d: lookups.select_antigens(described(spark, d), "n_layers > 1 and passage_kind = 'egg' and not distinct").select("antigen_no"))
query("j27_by_name_and_passage", DESCRIBED + """, wa AS (SELECT row_number() OVER (ORDER BY name) AS place, name, CASE WHEN ascii(right(name, 1)) % 2 = 0 THEN 'egg' END AS passage FROM (SELECT DISTINCT name FROM antigens) n)
SELECT place, de.name, passage_kind, antigen_no, CAST(n_layers AS INT) AS n_layers, row_number() OVER (PARTITION BY place, passage_kind ORDER BY n_layers DESC, antigen_no) - 1 AS choice FROM de JOIN wa ON wa.name = de.name AND (passage IS NULL OR wa.passage = passage_kind) WHERE NOT dis""".replace("(passage IS NULL OR", "(wa.passage IS NULL OR"), "antigens", "titer_layers")(
    lambda spark, d: lookups.by_name_and_passage(described(spark, d), spark.sql("SELECT row_number() OVER (ORDER BY name) AS place, name, CASE WHEN ascii(right(name, 1)) % 2 = 0 THEN 'egg' END AS passage FROM (SELECT DISTINCT name FROM {a}) n", a=antigens(spark, d)))
)
query("u4_insert_antigens", " SELECT CASE WHEN antigen_no >= 10 THEN antigen_no + 2 ELSE antigen_no END AS antigen_no, name FROM antigens UNION ALL SELECT 10, 'NEW A' UNION ALL SELECT 11, 'NEW B'", "antigens")(
    lambda spark, d: lookups.inserted(antigens(spark, d).select("antigen_no", "name"), spark.createDataFrame([(0, "NEW A"), (1, "NEW B")], "antigen_no int, name string"), 10)
)
query("u5_keep_only", common_sql("antigens", "antigen_no", levels=("ignored",)) + " SELECT primary_no AS antigen_no FROM found", "antigens")(
    lambda spark, d: lookups.keep_only(matching.common(antigens(spark, d, 1), antigens(spark, d, 2), "antigen_no", level="ignored"), antigens(spark, d, 1), antigens(spark, d, 2))[0].select("antigen_no")
)
query("o8_homologous_first", HOMOLOGOUS.replace(" SELECT serum_no, antigen_no FROM k WHERE ", ", m AS (SELECT antigen_no, min(serum_no) AS s FROM b GROUP BY 1)") + " SELECT a.antigen_no, row_number() OVER (ORDER BY s NULLS LAST, date, a.antigen_no) - 1 AS place FROM antigens a LEFT JOIN m ON m.antigen_no = a.antigen_no", "antigens", "sera")(
    lambda spark, d: lookups.homologous_first(antigens(spark, d), lookups.first_homologous_serum(antigens(spark, d), sera(spark, d)), "date")
)
query("sm13_detected_references", " SELECT antigen_no FROM antigens WHERE upper(name) IN (SELECT upper(name) FROM sera)", "antigens", "sera")(lambda spark, d: lookups.detected_references(antigens(spark, d), sera(spark, d)).select("antigen_no"))
query("n13_formatted", " SELECT antigen_no, trim(regexp_replace(concat(CASE WHEN name <> '' THEN name ELSE '' END, ' [', passage, '] ', replace(date, '-', ''), '/', substr(lineage, 1, 1)), ' +', ' ', 'g')) AS text FROM antigens", "antigens")(
    lambda spark, d: antigens(spark, d).select("antigen_no", lookups.formatted("{name} [{passage}] {date_brief}/{lineage_letter}").alias("text"))
)
query("a24_letters", " SELECT letter, n, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM (SELECT letter, count(*) AS n FROM (SELECT unnest(string_split(aa, '')) AS letter FROM seqs) t WHERE letter <> '' GROUP BY 1) u", "seqs")(lambda spark, d: lookups.letters_of(seqs(spark, d), "aa"))
query("a34_message_counts", " SELECT issues AS type, count(*) AS n, string_agg(DISTINCT country, ', ' ORDER BY country) AS \"values\" FROM seqs WHERE issues <> '' GROUP BY 1", "seqs")(lambda spark, d: lookups.message_counts(seqs(spark, d).where("issues <> ''").select(F.col("issues").alias("type"), F.col("country").alias("value"))))
ASSAYS = "CASE CAST(n_nationkey AS INT) % 5 WHEN 0 THEN 'HI' WHEN 1 THEN 'HINT' WHEN 2 THEN 'FOCUS REDUCTION' WHEN 3 THEN 'PLAQUE REDUCTION NEUTRALISATION' END"
query("info_assays", f"SELECT n_nationkey, CASE WHEN a IS NULL OR a = 'HI' THEN 'hi' WHEN a = 'HINT' THEN 'hint' ELSE 'neut' END AS hi_or_neut, CASE WHEN a IS NULL OR a = 'HI' THEN '' WHEN a = 'HINT' THEN 'HINT' ELSE 'Neut' END AS no_hi, CASE a WHEN 'FOCUS REDUCTION' THEN 'FRA' WHEN 'PLAQUE REDUCTION NEUTRALISATION' THEN 'PRN' ELSE coalesce(a, '') END AS brief FROM (SELECT n_nationkey, {ASSAYS} AS a FROM nation) t")(
    lambda spark, d: spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.expr(ASSAYS).alias("a")).select("n_nationkey", lookups.assay(F.col("a"), "hi_or_neut").alias("hi_or_neut"), lookups.assay(F.col("a"), "no_HI").alias("no_hi"), lookups.assay(F.col("a"), "brief").alias("brief"))
)
query("n16_database_subtypes", "SELECT n_nationkey, CASE CAST(n_nationkey AS INT) % 4 WHEN 0 THEN 'A(H3N2)' WHEN 1 THEN 'A(H3)' WHEN 2 THEN 'B' ELSE '' END AS subtype FROM nation")(
    lambda spark, d: spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", lookups.database_subtype(F.expr("CASE CAST(n_nationkey AS INT) % 4 WHEN 0 THEN 'A / H3N2' WHEN 1 THEN 'a / h3n0' WHEN 2 THEN 'B' ELSE 'C' END")).alias("subtype"))
)
query("clades_of_subtype", "SELECT clade, pos FROM (VALUES ('1A', 'A(H3)', 5), ('1B', 'A(H3N2)', 7), ('V1A', 'B', 9)) t(clade, subtype, pos) WHERE subtype LIKE 'A(H3%'")(
    lambda spark, d: lookups.clades_of(spark.createDataFrame([("1A", "A(H3)", 5, ["x"]), ("1B", "A(H3N2)", 7, []), ("V1A", "B", 9, ["x"])], "clade string, subtype string, pos int, sets array<string>"), "A(H3N2)").select("clade", "pos")
)


# ---- merged projections: the secondary is a turned copy of a part of the layout
def turned(spark, d, name="layout"):
    lay = view(spark, d, name)
    return lay, maps.transform(lay.where(layout_number("point_no") % 3 != 0), maps.rotation(0.5), [3.0, -2.0])


def overlay(spark, d, keep):
    lay, other = turned(spark, d, "layout_apart")
    out = projections.overlaid(lay.where(layout_number("point_no") % 3 != 1), other, keep)
    return out.select(layout_number("point_no").alias("point_no"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "origin")


OVERLAY = " SELECT point_no, round(x, 4) AS x, round(y, 4) AS y, CASE point_no % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'common' END AS origin FROM layout"
query("mg2_overlay_type3", OVERLAY, "layout")(lambda spark, d: overlay(spark, d, "middle"))
query("mg2_overlay_type5", OVERLAY, "layout")(lambda spark, d: overlay(spark, d, "primary"))
query("mg2_incremental_type2", " SELECT point_no, x, y FROM layout WHERE point_no % 3 <> 1", "layout")(lambda spark, d: projections.merged_projection(spark, 2, turned(spark, d)[0].where("point_no % 3 <> 1"), None, None, 0))


@query("pr2_oriented_to_master", " SELECT point_no, round(x, 4) AS x, round(y, 4) AS y FROM layout WHERE point_no % 3 <> 0", "layout")
def pr2(spark, d):
    lay, other = turned(spark, d)
    out = projections.oriented(other, lay, other.select(F.col("point_no").alias("primary_no"), F.col("point_no").alias("secondary_no")))
    return out.select("point_no", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("st3_with_moved_point", """+ e AS (SELECT antigen_no AS p1, serum_no + 1000000 AS p2 FROM titer_layers GROUP BY 1, 2), l AS (SELECT point_no, CASE WHEN point_no = 7 THEN 1.5 ELSE x END AS x, CASE WHEN point_no = 7 THEN 2.5 ELSE y END AS y FROM layout)
SELECT round(sum(pow(3 - sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 2)), 3) AS stress FROM e JOIN l a ON a.point_no = p1 JOIN l b ON b.point_no = p2""", "titer_layers", "layout")
def moved(spark, d):
    e = merged(spark, d).select(F.col("antigen_no").alias("p1"), (F.col("serum_no") + SERA_FROM).alias("p2"), F.lit("regular").alias("kind"), F.lit(3.0).alias("distance"))
    return projections.moved_stress(e, view(spark, d, "layout"), 7, [1.5, 2.5]).select(F.round("stress", 3).alias("stress"))


@query("n10_abbreviated_types", "SELECT n_nationkey, CASE CAST(n_nationkey AS INT) % 3 WHEN 0 THEN 'H3' WHEN 1 THEN 'B' ELSE 'H1' END AS h, CASE CAST(n_nationkey AS INT) % 3 WHEN 0 THEN 'H3N2' WHEN 1 THEN 'B' ELSE 'H1N1' END AS hn FROM nation")
def types(spark, d):
    t = F.expr("CASE CAST(n_nationkey AS INT) % 3 WHEN 0 THEN 'A(H3N2)' WHEN 1 THEN 'B' ELSE 'A(H1N1)' END")
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", names.h_or_b(t).alias("h"), names.hn_or_b(t).alias("hn"))
