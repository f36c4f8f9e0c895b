"""Registered queries on file formats: derived tables are written to the shared folder as documents and read by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources import charts, sequences, tables, trees
from ..storage import shared_dir
from .fixtures import view, with_views

QUERIES, SQL = {}, {}


def query(name, sql, *views):
    def add(f):
        QUERIES[name] = f
        SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def folder(spark, what):
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def derived(spark, sql, **frames):
    """Rows of a text that the oracle runs too, over the given tables."""
    for k in frames:
        sql = sql.replace(f"FROM {k}", f"FROM {{{k}}}").replace(f"JOIN {k}", f"JOIN {{{k}}}")
    return spark.sql(sql, **frames)


@query("sk6_fasta_written_and_read", " SELECT concat('s', CAST(seq_no AS STRING)) AS header, aa AS sequence FROM long_seqs", "long_seqs")
def fasta(spark, d):
    at = folder(spark, "fasta")
    sequences.write_fasta(view(spark, d, "long_seqs"), at, F.concat(F.lit("s"), F.col("seq_no").cast("string")))
    return sequences.read_fasta(spark, at).select("header", "sequence")


@query("sk6_fasta_cut_and_padded", " SELECT concat('s', CAST(seq_no AS STRING)) AS header, CASE WHEN seq_no % 2 = 0 THEN substr(aa, 1, 100) ELSE rpad(substr(aa, 1, 90), 100, 'X') END AS sequence FROM long_seqs", "long_seqs")
def padded(spark, d):
    at = folder(spark, "fasta")
    rows = view(spark, d, "long_seqs").withColumn("aa", F.when(F.col("seq_no") % 2 == 0, F.col("aa")).otherwise(F.substring("aa", 1, 90)))
    sequences.write_fasta(rows, at, F.concat(F.lit("s"), F.col("seq_no").cast("string")), wrap=33, width=100, pad="X")
    return sequences.read_fasta(spark, at).select("header", "sequence")


#: Headers of three forms: eighteen named fields, seven fields, a name alone.
HEADERS = """SELECT seq_no, CASE seq_no % 3
  WHEN 0 THEN concat(name, '_|_a=EPI', CAST(seq_no AS STRING), '_|_b=A / H3N2_|_c=', passage, '_|_d=_|_e=', isolation_date, '_|_f=x_|_g=x_|_h=x_|_i=', CAST(seq_no AS STRING), '_|_j=Lab ', country, '_|_k=_|_l=HA_|_m=4_|_n=_|_o=_|_p=_|_x=')
  WHEN 1 THEN concat(name, ' | ', isolation_date, ' | ', passage, ' | x | Lab ', country, ' | B / H0N0 | 4')
  ELSE concat(name, '_EGG') END AS header FROM seqs"""


@query("sc10_header_forms", """ SELECT seq_no, name, CASE WHEN seq_no % 3 = 2 THEN '' ELSE isolation_date END AS date, CASE WHEN seq_no % 3 = 2 THEN 'EGG' ELSE passage END AS passage, CASE WHEN seq_no % 3 = 2 THEN '' ELSE concat('Lab ', country) END AS lab,
  CASE WHEN seq_no % 3 = 0 THEN CAST(seq_no AS STRING) ELSE '' END AS lab_id, CASE seq_no % 3 WHEN 0 THEN 'A(H3N2)' WHEN 1 THEN 'B' ELSE '' END AS type_subtype FROM seqs""", "seqs")
def headers(spark, d):
    rows = sequences.parse_headers(derived(spark, HEADERS, seqs=view(spark, d, "seqs")))
    return rows.select("seq_no", "name", "date", "passage", "lab", "lab_id", "type_subtype")


@query("sc11_sequences_with_metadata", " SELECT concat('AB', lpad(CAST(seq_no AS STRING), 8, '0')) AS accession, name, isolation_date AS date, country, aa AS sequence FROM seqs WHERE seq_no % 3 <> 0", "seqs")
def ncbi(spark, d):
    """Two thirds of the metadata are of the segment that is read."""
    s = view(spark, d, "seqs").withColumn("accession", F.concat(F.lit("AB"), F.lpad(F.col("seq_no").cast("string"), 8, "0")))
    at = folder(spark, "genomes")
    sequences.write_fasta(s, f"{at}/fasta", F.concat(F.lit("gb|"), "accession", F.lit(".1| a sequence")))
    text = {"host": "Human", "subtype": "H3N2", "length": "32", "age": "", "gender": "", "completeness": "c"}
    columns = {"segment": F.when(F.col("seq_no") % 3 == 0, "6").otherwise("4"), "date": F.col("isolation_date"), "virus_name": F.concat(F.lit("Influenza A virus ("), "name", F.lit(")")), **{k: F.lit(v) for k, v in text.items()}}
    s.select(*((columns.get(c, F.col(c)) if c in columns else F.col(c)).alias(c) for c in sequences.NCBI)).write.option("sep", "\t").csv(f"{at}/metadata")
    return sequences.read_ncbi(spark, f"{at}/fasta", f"{at}/metadata").select("accession", "name", "date", "country", "sequence")


@query("sc12_sequence_database", " SELECT concat('T', CAST(CAST(floor(seq_no / 500) AS BIGINT) AS STRING)) AS subtype, name, country, lineage, isolation_date, aa, hash, reassortant, CASE WHEN issues = '' THEN passage ELSE '' END AS passage, issues FROM seqs", "seqs")
def seqdb(spark, d):
    """A document for every five hundred sequences."""
    s = view(spark, d, "seqs").withColumn("subtype", F.concat(F.lit("T"), F.floor(F.col("seq_no") / 500).cast("string")))
    listed = lambda c: F.when(c != "", F.concat(F.lit('["'), c, F.lit('"]'))).otherwise("[]")
    entry = F.concat(
        F.lit('{"N":"'), "name", F.lit('","d":["'), "isolation_date", F.lit('"],"c":"'), "country", F.lit('","l":"'), "lineage", F.lit('","s":[{"a":"'), "aa", F.lit('","n":"ACGT","H":"'), "hash",
        F.lit('","r":'), listed(F.col("reassortant")), F.lit(',"p":'), F.when(F.col("issues") == "", listed(F.col("passage"))).otherwise("[]"), F.lit(',"i":"'), "issues", F.lit('"}]}'),
    )
    docs = s.groupBy("subtype").agg(F.concat(F.lit(f'{{"  version":"{sequences.SEQDB_VERSION}","subtype":"'), F.first("subtype"), F.lit('","size":0,"data":['), F.array_join(F.collect_list(entry), ","), F.lit("]}")).alias("value"))
    at = folder(spark, "seqdb")
    docs.repartition("subtype").write.partitionBy("subtype").text(at)  # a file each
    rows = sequences.read_seqdb(spark, f"{at}/*/*.txt")
    return rows.select("subtype", "name", "country", "lineage", "isolation_date", "aa", "hash", "reassortant", F.array_join("passages", ",").alias("passage"), "issues")


@query("sc13_clade_rules", """SELECT n_name AS subtype_key, c_name AS clade, pos, letter, eq FROM customer JOIN nation ON n_nationkey = c_nationkey,
  (SELECT 1 AS k UNION ALL SELECT 2) t, LATERAL (SELECT CASE k WHEN 1 THEN CAST(1 + c_custkey % 300 AS INT) ELSE CAST(301 + c_custkey % 200 AS INT) END AS pos, CASE k WHEN 1 THEN 'K' ELSE 'S' END AS letter, k = 1 AS eq) x""")
def rules(spark, d):
    """A document with the rules of every customer, by nation."""
    c = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey") == F.col("c_nationkey"))
    aa = F.concat((1 + F.col("c_custkey") % 300).cast("string"), F.lit("K !"), (301 + F.col("c_custkey") % 200).cast("string"), F.lit("S"))
    docs = c.groupBy("n_name").agg(F.collect_list(F.struct(F.col("c_name").alias("N"), aa.alias("aa"))).alias("rules"))
    at = folder(spark, "clades")
    docs.select(F.to_json(F.create_map("n_name", "rules")).alias("value"), "n_name").repartition("n_name").write.partitionBy("n_name").text(at)
    return sequences.read_clade_rules(spark, f"{at}/*/*.txt").where("kind = 'aa'").select("subtype_key", "clade", "pos", "letter", "eq")


@query("sc18_ancestral_states", "+ cd AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(S.CODONS.items())) + """) t(codon, letter)),
n AS (SELECT seq_no, translate(aa, 'ACDEFGHIKLMNPQRS', 'ACGTACGTACGTACGN') AS nuc FROM long_seqs),
e AS (SELECT seq_no, i, replace(substr(nuc, 3 * CAST(i AS INT) + 1, 3), 'T', 'U') AS codon FROM (SELECT *, unnest(range(0, length(nuc) // 3)) AS i FROM n) t)
SELECT concat('Node', CAST(seq_no AS STRING)) AS name, string_agg(coalesce(letter, 'X'), '' ORDER BY i) AS aa FROM e LEFT JOIN cd USING (codon) GROUP BY 1""", "long_seqs")
def ancestral(spark, d):
    at = folder(spark, "states")
    view(spark, d, "long_seqs").select(F.concat(F.lit("Node"), F.col("seq_no").cast("string")), F.translate("aa", "ACDEFGHIKLMNPQRS", "ACGTACGTACGTACGN")).write.option("sep", "\t").csv(at)
    return trees.read_ancestral_states(spark, at).select("name", "aa")


SHEET = "SELECT c_custkey, concat(c_name, ', \"', CAST(c_nationkey AS STRING), '\"') AS a, concat('x', CAST(c_custkey AS STRING)) AS b, CAST(c_nationkey AS STRING) AS c FROM customer"


@query("sc19_csv_sheet_compressed", f"SELECT 0 AS col, a AS text FROM ({SHEET}) t UNION ALL SELECT 1, b FROM ({SHEET}) t UNION ALL SELECT 2, c FROM ({SHEET}) t")
def sheet(spark, d):
    """Cells with commas and quotes, in compressed files."""
    at = folder(spark, "sheet")
    derived(spark, SHEET, customer=spark.read.parquet(f"{d}/customer.parquet")).select("a", "b", "c").write.option("compression", "gzip").csv(at)
    return tables.read_csv_sheet(spark, f"{at}/*.gz").select("col", "text")


CDC = """SELECT 'H3' AS test_subtype, 'HI' AS test_protocol, concat('2020-', CAST(1 + layer_no AS STRING)) AS test_date, concat('A/', lpad(CAST(antigen_no AS STRING), 6, '0')) AS ag_strain_name, 'E1' AS ag_passage, lpad(CAST(antigen_no AS STRING), 6, '0') AS ag_cdc_id,
  CASE WHEN antigen_no % 10 = 3 THEN 'Y' ELSE 'N' END AS ag_do_not_report, concat('S/', lpad(CAST(serum_no AS STRING), 6, '0')) AS sr_strain_name, CASE WHEN serum_no % 7 = 2 THEN 'pool 1' ELSE lpad(CAST(serum_no AS STRING), 6, '0') END AS sr_lot, 'MDCK1' AS sr_passage, '0' AS sr_do_not_report, titer AS titer_value FROM titer_layers"""


@query("sc26_titers_one_a_row", f"""+ r AS (SELECT *, concat_ws(':', test_subtype, test_protocol, test_date) AS "table" FROM ({CDC}) t WHERE ag_do_not_report = 'N'),
n AS (SELECT *, dense_rank() OVER (PARTITION BY "table" ORDER BY ag_strain_name) - 1 AS antigen_no, dense_rank() OVER (PARTITION BY "table" ORDER BY sr_strain_name) - 1 AS serum_no FROM r)
SELECT "table", CAST(antigen_no AS INT) AS antigen_no, CAST(serum_no AS INT) AS serum_no, titer_value AS titer FROM n WHERE sr_lot NOT LIKE '%pool%'""", "titer_layers")
def cdc(spark, d):
    """All titers of all layers, some not to be reported, some of pools."""
    at = folder(spark, "titers")
    derived(spark, CDC, titer_layers=view(spark, d, "titer_layers")).write.option("sep", "\t").option("header", True).csv(at)
    return tables.read_cdc(spark, at).select("table", "antigen_no", "serum_no", "titer")


def chart_document(spark, d):
    """The chart of all titers as a document, read again."""
    cells = view(spark, d, "chart_layers")
    a = spark.range(120).select(F.col("id").cast("int").alias("antigen_no"), F.concat(F.lit("A/X/"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 3 == 0, "E1").otherwise("").alias("passage"))
    s = spark.range(30).select(F.col("id").cast("int").alias("serum_no"), F.concat(F.lit("B/Y/"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("id"), F.col("id").cast("string")).alias("serum_id"))
    at = folder(spark, "chart")
    charts.to_json(a, s, cells.select("layer_no", "antigen_no", "serum_no", "titer"), {"v": "influenza", "l": "LAB", "D": "20200101"}).write.text(at)
    return charts.read(spark, f"{at}/*.txt")


query("sc4_chart_layers", " SELECT layer_no, antigen_no, serum_no, titer FROM chart_layers WHERE titer <> '*'", "chart_layers")(lambda spark, d: charts.layers(chart_document(spark, d)).select("layer_no", "antigen_no", "serum_no", "titer"))


@query("sc3_chart_members", """ SELECT 'antigen' AS kind, CAST(k AS INT) AS no, concat('A/X/', CAST(k AS STRING)) AS name, CASE WHEN k % 3 = 0 THEN 'E1' ELSE '' END AS text, (SELECT count(*) FROM chart_layers WHERE antigen_no = k) AS n FROM range(120) a(k)
UNION ALL SELECT 'serum', CAST(k AS INT), concat('B/Y/', CAST(k AS STRING)), concat('id', CAST(k AS STRING)), (SELECT count(*) FROM chart_layers WHERE serum_no = k) FROM range(30) s(k)""", "chart_layers")
def members(spark, d):
    """Antigens and sera of the document, with how many titers they have in its layers."""
    doc = chart_document(spark, d)
    cells = charts.layers(doc)
    per = lambda no: cells.groupBy(no).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).alias("n")
    a = charts.antigens(doc).join(per("antigen_no"), "antigen_no", "left").select(F.lit("antigen").alias("kind"), F.col("antigen_no").alias("no"), "name", F.col("passage").alias("text"), n)
    s = charts.sera(doc).join(per("serum_no"), "serum_no", "left").select(F.lit("serum").alias("kind"), F.col("serum_no").alias("no"), "name", F.col("serum_id").alias("text"), n)
    return a.unionByName(s)


#: A sheet for each chart of the titer table: serum names above, names, dates and passages of antigens at the left, * where there is no titer.
GRID = """SELECT chart_no, antigen_no, serum_no, min(titer) AS titer, CAST(dense_rank() OVER (PARTITION BY chart_no ORDER BY antigen_no) + 1 AS INT) AS row, CAST(serum_no % 30 + 3 AS INT) AS col
FROM (SELECT CAST(floor(antigen_no / 120) AS INT) AS chart_no, antigen_no, serum_no, titer FROM titer_layers WHERE layer_no = 0) t GROUP BY 1, 2, 3"""


def grid(spark, d):
    """file, sheet, row, col, text."""
    cells = derived(spark, GRID, titer_layers=view(spark, d, "titer_layers"))
    place = [F.lit("f").alias("file"), F.col("chart_no").cast("string").alias("sheet")]
    rows = cells.select("chart_no", "antigen_no", "row").distinct()
    every = rows.select("chart_no", "row", F.explode(F.sequence(F.lit(3), F.lit(32))).alias("col")).join(cells.select("chart_no", "row", "col", "titer"), ["chart_no", "row", "col"], "left")
    left = F.array(*(F.struct(F.lit(k).alias("col"), x.alias("text")) for k, x in enumerate((F.concat(F.lit("A/TOWN/"), F.col("antigen_no").cast("string"), F.lit("/2020")), F.lit("2020-03-04"), F.lit("MDCK1")))))
    above = rows.select("chart_no").distinct().select(*place, F.explode(F.sequence(F.lit(0), F.lit(29))).alias("s"))
    out = every.select(*place, "row", "col", F.coalesce("titer", F.lit("*")).alias("text"))
    out = out.unionByName(rows.select(*place, "row", F.explode(left).alias("x")).select("file", "sheet", "row", "x.col", "x.text"))
    return out.unionByName(above.select("file", "sheet", F.lit(1).alias("row"), (F.col("s") + 3).alias("col"), F.concat(F.lit("A/CITY/"), F.col("s").cast("string"), F.lit("/2019")).alias("text")))


@query("sc22_titer_block", f"+ g AS ({GRID}) SELECT CAST(chart_no AS STRING) AS sheet, 2 AS first_row, max(row) AS last_row, 3 AS first_col, 32 AS last_col FROM g GROUP BY 1", "titer_layers")
def block(spark, d):
    return tables.titer_block(grid(spark, d)).select("sheet", "first_row", "last_row", "first_col", "last_col")


query("sc23_label_columns", f"+ g AS (SELECT DISTINCT CAST(chart_no AS STRING) AS sheet FROM ({GRID}) t) SELECT sheet, kind, col FROM g, (VALUES ('name', 0), ('date', 1), ('passage', 2)) v(kind, col)", "titer_layers")(lambda spark, d: tables.label_columns(grid(spark, d), tables.titer_block(grid(spark, d))).select("sheet", "kind", "col"))
query("sc24_cells_above_cells", f"+ g AS ({GRID}) SELECT CAST(chart_no AS STRING) AS sheet, row, col, titer AS text FROM g JOIN (SELECT chart_no, max(row) AS last FROM g GROUP BY 1) m USING (chart_no) WHERE titer LIKE '<%' AND row < last AND (chart_no, row + 1, col) NOT IN (SELECT chart_no, row, col FROM g)", "titer_layers")(lambda spark, d: tables.find_cells(grid(spark, d), "^<", "^\\*$").select("sheet", "row", "col", "text"))


@query("sc22_sheet_titers", f"+ g AS ({GRID}) SELECT CAST(chart_no AS STRING) AS sheet, row - 2 AS antigen_no, col - 3 AS serum_no, titer FROM g WHERE titer <> '*'", "titer_layers")
def sheet_titers(spark, d):
    return tables.sheet_chart(grid(spark, d))[2].select("sheet", "antigen_no", "serum_no", "titer")


@query("sc25_org_tables", f"+ g AS ({GRID}) SELECT chart_no, row - 2 AS antigen_no, col - 3 AS serum_no, titer FROM g WHERE titer <> '*'", "titer_layers")
def org(spark, d):
    """Each chart as an org table, and from there again."""
    cells = grid(spark, d)
    line = lambda xs: F.concat(F.lit("| "), F.array_join(xs, " | "), F.lit(" |"))
    per = cells.groupBy(F.col("sheet").alias("chart"), "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("t"))  # a line's 33 cells
    none = F.array_repeat(F.lit(""), 3)
    text = F.when(F.col("row") == 1, line(F.concat(F.array(F.lit("name")), none, "t"))).otherwise(line(F.concat(F.array(F.lit("")), "t")))
    head = line(F.concat(F.array(*map(F.lit, ("", "name", "date", "passage"))), F.array_repeat(F.lit(""), 30)))
    docs = per.groupBy("chart").agg(F.concat(F.lit("- Lab: X\n\n"), head, F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", text.alias("text")))), lambda x: x["text"]), "\n")).alias("value"))  # a chart's 121 lines
    at = folder(spark, "org")
    docs.repartition("chart").write.partitionBy("chart").text(at)
    _, found = tables.read_org(spark, f"{at}/*/*.txt")
    titers = tables.org_chart(found)[2]
    return titers.select(F.regexp_extract("file", "chart=([0-9]+)", 1).cast("int").alias("chart_no"), "antigen_no", "serum_no", "titer")
