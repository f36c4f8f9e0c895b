"""Sequence files: FASTA in its dialects, metadata tables, the sequence database, clade rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keys_by_case

# The versions that documents carry.
SEQDB_VERSION = "sequence-database-v4"
CLADES_VERSION = "clades-v2"

# What the letters of the long header fields mean.
FIELDS = {"a": "isolate_id", "b": "type_subtype", "c": "passage", "d": "lineage", "e": "date", "f": "submitter", "g": "sample_by_id", "h": "sample_id", "i": "lab_id", "j": "lab", "k": "submission_date", "l": "segment", "m": "segment_number", "n": "identifier", "o": "dna_accession", "p": "dna_insdc", "x": "exclude"}
# The columns of genome set metadata.
NCBI = ["accession", "host", "segment", "subtype", "country", "date", "length", "virus_name", "age", "gender", "completeness"]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, header, sequence (upper case, without blanks); a header may go on in a line with / | or _."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("file", F.input_file_name())
    lines = F.filter(F.split(F.regexp_replace("value", "^\\s*>", ""), "\\r?\\n"), lambda x: F.trim(x) != "")
    rows = raw.select("file", lines.alias("l")).where(F.size("l") > 0)
    more = (F.size("l") > 2) & F.get("l", F.lit(1)).rlike("[/|_]")
    header = F.when(more, F.concat_ws(" ", F.get("l", F.lit(0)), F.get("l", F.lit(1)))).otherwise(F.get("l", F.lit(0)))
    body = F.when(more, F.slice("l", 3, 1_000_000)).otherwise(F.slice("l", 2, 1_000_000))
    return rows.select("file", F.trim(header).alias("header"), F.upper(F.regexp_replace(F.array_join(body, ""), "\\s", "")).alias("sequence"))


def preprocessed(rows: DataFrame, hooks: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """rows (column file) with each hook applied to those whose file matches its pattern; the first pattern counts, others stay as they are."""
    out, rest = None, F.lit(True)
    for pattern, hook in hooks.items():
        hit = F.col("file").rlike(pattern)
        part = hook(rows.where(rest & hit)).select(*rows.columns)
        out, rest = part if out is None else out.unionByName(part), rest & ~hit
    return rows if out is None else out.unionByName(rows.where(rest))


def parse_headers(rows: DataFrame) -> DataFrame:
    """Adds name, date, passage, lab, lab_id, type_subtype, lineage, excluded: fields joined by _|_, by " | ", or a name alone."""
    h = F.col("header")
    long = F.split(h, "_\\|_")
    pairs = F.map_from_entries(F.transform(F.filter(F.slice(long, 2, 40), lambda x: x.rlike("^[a-z]=")), lambda x: F.struct(F.substring(x, 1, 1).alias("k"), F.substring(x, 3, 10_000).alias("v"))))
    seven = F.transform(F.split(h, " \\| "), lambda x: F.trim(x))
    niid = F.regexp_extract(h, "_(E|EGG|CELL|SIAT|MDCK|OR)$", 1)
    form = F.when((F.size(long) >= 18), "long").when(F.size(seven) == 7, "seven").otherwise("plain")
    df = rows.withColumn("form", form).withColumn("_m", F.when(F.size(long) > 1, pairs)).withColumn("_s", seven)
    get = lambda letter, k, plain: F.coalesce(F.when(F.col("form") == "long", F.col("_m")[letter]).when(F.col("form") == "seven", F.get("_s", F.lit(k)) if k is not None else F.lit("")).otherwise(plain), F.lit(""))
    plain = F.when(niid != "", F.regexp_replace(h, "_(E|EGG|CELL|SIAT|MDCK|OR)$", "")).otherwise(h)
    name = F.when(F.col("form") == "long", F.get(long, F.lit(0))).when(F.col("form") == "seven", F.get("_s", F.lit(0))).otherwise(plain)
    empty = F.lit("")
    out = df.withColumn("name", F.trim(name)).withColumn("date", get("e", 1, empty)).withColumn("passage", get("c", 2, niid)).withColumn("lab", get("j", 4, empty)).withColumn("lab_id", get("i", None, empty))
    out = out.withColumn("type_subtype", type_subtype(get("b", 5, empty))).withColumn("lineage", get("d", None, empty)).withColumn("excluded", get("x", None, empty))
    return out.drop("_m", "_s")


def type_subtype(text: Column) -> Column:
    """A / H3N2 and H3N2 are A(H3N2); B / H0N0 and B are B."""
    t = F.upper(F.regexp_replace(text, "\\s", ""))
    return F.when(t.startswith("B"), "B").when(t.rlike("H\\d"), F.concat(F.lit("A("), F.regexp_extract(t, "H\\d+(?:N\\d+)?", 0), F.lit(")"))).otherwise(t)


def read_ncbi(spark: SparkSession, fasta: str, metadata: str, segment: str = "4") -> DataFrame:
    """Sequences of a segment with their metadata, by accession (the last field of the header before a blank)."""
    meta = spark.read.option("sep", "\t").schema(", ".join(f"{c} string" for c in NCBI)).csv(metadata).where(F.col("segment") == segment)
    acc = F.regexp_extract("header", "([A-Za-z_]+\\d+)(?:\\.\\d+)?(?:[|\\s]|$)", 1)
    return read_fasta(spark, fasta).withColumn("accession", acc).join(meta, "accession").withColumn("name", F.regexp_extract("virus_name", "\\(([^()]*(?:\\([^()]*\\))?[^()]*)\\)", 1))


def write_fasta(df: DataFrame, path: str, header: Column, column: str = "aa", wrap: int | None = 80, width: int | None = None, pad: str | None = None) -> None:
    """Text files of records; cut to a width, short ones padded."""
    seq = F.col(column)
    if width:
        seq = F.substring(seq, 1, width)
        seq = F.rpad(seq, width, pad) if pad else seq
    if wrap:
        seq = F.regexp_replace(F.regexp_replace(seq, f"(.{{{wrap}}})", "$1\n"), "\n$", "")
    df.select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value")).write.mode("overwrite").text(path)


@keys_by_case
def read_seqdb(spark: SparkSession, path: str) -> DataFrame:
    """One row a sequence of the database's JSON files, with its entry's fields and is_master."""
    seq = "a:string, n:string, I:array<struct<p:int,s:string>>, H:string, r:array<string>, A:array<string>, p:array<string>, i:string, l:map<string,array<string>>"
    schema = f"`  version` string, subtype string, size int, data array<struct<N:string, d:array<string>, C:string, c:string, l:string, h:string, s:array<struct<{seq}>>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    data = F.when(F.col("`  version`") != SEQDB_VERSION, F.raise_error(F.lit("version of a sequence database"))).otherwise(F.col("data"))
    rows = docs.select("subtype", F.explode(data).alias("e")).select("subtype", "e", F.posexplode("e.s").alias("seq_no", "s"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "subtype", F.col("e.N").alias("name"), "seq_no", text("e.C").alias("continent"), text("e.c").alias("country"), text("e.h").alias("host"), text("e.l").alias("lineage"),
        F.coalesce("e.d", F.array()).alias("dates"), F.coalesce(F.element_at("e.d", -1), F.lit("")).alias("isolation_date"), text("s.a").alias("aa"), text("s.n").alias("nuc"), text("s.H").alias("hash"), (text("s.n") != "").alias("is_master"),
        F.array_join(F.coalesce("s.r", F.array()), " ").alias("reassortant"), F.coalesce("s.p", F.array()).alias("passages"), text("s.i").alias("issues"), F.col("s.l").alias("lab_ids"),
    )


def by_lab_id(seqs: DataFrame, lab: str, lab_id: str) -> DataFrame:
    return seqs.where(F.array_contains(F.col("lab_ids")[lab], lab_id))


def read_clade_rules(spark: SparkSession, path: str) -> DataFrame:
    """subtype_key, clade, set, kind (aa, nuc), pos, letter, eq, from the rules document; texts and keys beginning with ? are comments."""
    text = spark.read.option("wholetext", True).text(path)
    top = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("subtype_key", "rules")).where(~F.col("subtype_key").rlike("^[ ?_]"))
    each = top.select("subtype_key", F.explode(F.from_json("rules", "array<string>")).alias("rule"))
    fields = each.select("subtype_key", F.from_json("rule", "N string, aa string, nuc string, set string").alias("r")).where("r.N is not null")
    parts = fields.select("subtype_key", F.col("r.N").alias("clade"), F.coalesce("r.set", F.lit("")).alias("set"), F.explode(F.array(F.struct(F.lit("aa").alias("kind"), F.col("r.aa").alias("text")), F.struct(F.lit("nuc").alias("kind"), F.col("r.nuc").alias("text")))).alias("x"))
    one = parts.select("subtype_key", "clade", "set", "x.kind", F.explode(F.split("x.text", "\\s+")).alias("p")).where("p <> ''")
    pattern = "^(!?)(\\d+)([A-Z-])$"
    return one.select("subtype_key", "clade", "set", "kind", F.regexp_extract("p", pattern, 2).cast("int").alias("pos"), F.regexp_extract("p", pattern, 3).alias("letter"), (F.regexp_extract("p", pattern, 1) == "").alias("eq"))
