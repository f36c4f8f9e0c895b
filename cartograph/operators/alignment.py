"""Alignment of translated sequences by motifs, reconciliation of subtypes, lineages from gaps.

A rule looks for the first of its motifs in the beginning of a sequence; where it
is found, conditions on what follows decide, and the place of the motif with the
rule's shift says how many letters come before the mature protein.  Rules are
tried in order.  All of it is one expression over the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import sequence as S

# Subtype, letters that are searched, motifs, shift from the motif's beginning, conditions (offset from the motif and pattern, any of them).
# A rule that searches the "end" wants the motif at the sequence's end; its shift is from there.
Rule = tuple[str, int | str, list[str], int, list[tuple[int, str]]]
MOTIFS: list[Rule] = [
    ("A(H3)", 30, ["MKTIIALSNILCLVFA"], 17, [(16, "[^Q]Q")]),
    ("A(H3)", 20, ["MKTII"], 16, [(16, "Q"), (15, "A")]),
    ("A(H1)", 20, ["MKV", "MKA", "MEA", "MEV"], 17, [(17, "DTLC"), (17, "DTIC")]),
    ("B", 20, ["MKAIIVLLM"], 15, []),
    ("B", 100, ["CTDL"], -59, []),
    ("B", 100, ["NSPHVV"], -10, []),
    ("B", 150, ["EHIRL"], -114, []),
    ("B", 250, ["CPNATS"], -142, []),
    ("B", 250, ["PNATSK"], -143, []),
    ("B", 150, ["NVTNG"], -144, []),
    ("A(H2)", 20, ["MTIT", "MAII", "MTII"], 15, [(14, "GDQIC")]),
    ("A(H4)", 20, ["MLS"], 16, [(16, "Q"), (16, "SQNY")]),
    ("A(H5)", 20, ["MEKIV", "MERIV", "MKKIV"], 16, []),
    ("A(H6)", 20, ["MIAIIV", "MIAIII"], 16, []),
    ("A(H7)", 20, ["MNIQ", "MNNQ", "MNTQ"], 18, [(17, "[^S]DKIC")]),
    ("A(H8)", 20, ["MEKFIA"], 17, [(17, "D")]),
    ("A(H9)", 20, ["MET", "MEIIS", "MEV"], 18, [(17, "ADKIC")]),
    ("A(H10)", 20, ["MYK"], 17, []),
    ("A(H11)", 20, ["MK", "MEKTLL"], 16, [(16, "DEIC")]),
    ("A(H12)", 20, ["MEKFIIL"], 17, [(15, "AYDKIC")]),
    ("A(H13)", 20, ["MDI", "MAL", "MEV"], 18, [(17, "ADRIC")]),
    ("A(H14)", 20, ["MIA"], 17, [(14, "AYSQITN")]),
    ("A(H16)", 20, ["MMVK", "MMIK"], 19, [(19, "DKIC")]),
    ("A(H17)", 20, ["MEL"], 18, [(17, "GDRICI")]),
    ("A(H4)", 100, ["QNYT"], 0, [(11, "GHHA")]),
    ("A(H11)", 50, ["DEICIGYL"], 0, []),
    ("A(H15)", 100, ["KSDKICLGHHA"], 2, []),
    ("A(H3)", 150, ["CTLID", "CTLMDALL", "CTLVD"], -63, []),
    ("A(H3)", 100, ["PNGTIVKTI"], -20, []),
    ("A(H3)", 200, ["DKLYIWG"], -174, []),
    ("A(H3)", 150, ["SNCYPYDV"], -94, []),
    ("A(H1)", 50, ["VLEKN"], -18, []),
    ("A(H1)", 150, ["SSWSYI", "ESWSYI"], -73, []),
    ("A(H1)", 150, ["FERFEI"], -110, []),
    ("A(H1)", 200, ["IWLVKKG"], -148, []),
    ("A(H1)", 200, ["SSVSSF"], -105, []),
    ("A(H5)", 100, ["GVKPLIL", "GVRPLIL"], -45, []),
    ("A(H5)", 100, ["GWLLGNPMCDE"], -58, []),
    ("A(H5)", 150, ["NHFE"], -108, []),
    ("A(H6)", 100, ["QKEER"], -35, []),
    ("A(H6)", 150, ["EELKA"], -98, []),
    ("A(H7)", 100, ["GQCGL"], -51, []),
    ("A(H8)", 200, ["FYRSINWL"], -141, []),
    ("A(H9)", 50, ["QSTN"], -7, []),
    ("A(H9)", 150, ["CDLLLGG", "CDLLLEG"], -66, []),
    ("A(H9)", 150, ["LEELRS"], -97, []),
    ("A(H9)", 150, ["SARSYQ"], -106, []),
    ("A(H9)", 150, ["SSYQRIQ"], -108, []),
    ("A(H10)", 50, ["NGTIVKTLTNE"], -11, []),
    ("A(H10)", 150, ["QKIMESG"], -99, []),
    ("A(H11)", 100, ["SSVEL"], -27, []),
    ("A(H13)", 50, ["VGYLSTN"], -4, []),
    ("A(H16)", 70, ["DTLTENGVP", "DTLIENGVP"], -16, []),
    ("A(H1)", "end", ["LQCRICI"], -549, [(-549, "DT")]),
    ("A(H3)", "end", ["IRCNICI"], -550, []),
    ("B", "end", ["SCSICL"], -570, []),
]

# What a single gap in an aligned sequence of type B says of its lineage: first position, letters, lineage.
B_GAPS = [(163, 1, "YAMAGATA"), (162, 2, "VICTORIA"), (162, 3, "VICTORIA"), (163, 2, "YAMAGATA")]
#: Letters by which a sequence may differ from a master that confirms its subtype.
NEAR_MASTER = 100


def _found(seq: Column, rule: Rule) -> Column:
    """Struct subtype, shift, motif where the rule holds, else null."""
    subtype, limit, motifs, shift, conditions = rule
    if limit == "end":
        size = F.length(seq)
        begin = size + shift
        right = seq.endswith(motifs[0])
        for offset, pattern in conditions:
            right = right & ((size < -offset) | F.substring(seq, size + offset + 1, F.lit(len(pattern))).eqNullSafe(F.lit(pattern)))
        return F.when(right, F.struct(F.lit(subtype).alias("subtype"), begin.cast("int").alias("shift"), F.lit(motifs[0]).alias("motif")))
    head = F.substring(seq, 1, limit)
    at = F.coalesce(*(F.nullif(F.instr(head, m), F.lit(0)) for m in motifs))
    holds = at.isNotNull()
    if conditions:
        some = F.lit(False)
        for offset, pattern in conditions:
            some = some | F.substring(seq, at + offset, F.lit(20)).rlike("^" + pattern)
        holds = holds & some
    return F.when(holds, F.struct(F.lit(subtype).alias("subtype"), (at - 1 + shift).cast("int").alias("shift"), F.lit(motifs[0]).alias("motif")))


def detected(seq: Column, table: list[Rule] = MOTIFS) -> Column:
    """Struct subtype, shift, motif by the first rule that holds; null if none does."""
    return F.coalesce(*(_found(seq, r) for r in table))


def aligned(rows: DataFrame, column: str = "aa", table: str = MOTIFS) -> DataFrame:
    """Adds detected (subtype), shift and issue, and cuts the column to the mature protein.

    A negative shift, where the beginning is missing, is filled with X (issue x);
    sequences that no rule finds stay as they are (issue A).
    """
    rows = rows.withColumn("_d", detected(F.col(column), table))
    shift = F.col("_d.shift")
    cut = F.when(shift < 0, F.concat(F.repeat(F.lit("X"), -shift), column)).when(shift >= 0, F.substring(F.col(column), shift + 1, F.length(column))).otherwise(F.col(column))
    issue = F.when(F.col("_d").isNull(), "A").when(shift < 0, "x").otherwise("")
    return rows.withColumns({"detected": F.col("_d.subtype"), "shift": shift, "issue": issue, column: cut}).drop("_d")


def reconciled(provided: Column, found: Column, master: Column, distance: Column, near: int = NEAR_MASTER) -> Column:
    """Struct subtype, mismatch: of a provided and a detected subtype, with the closest master's and how far that is.

    A missing or unknown (H0) one gives way to the detected; else, where they
    differ, the detected one counts only if a near master has it.
    """
    none = provided.isNull() | (provided == "")
    known = ~none & (names.h_or_b(provided) != "H0")
    differ = known & (names.h_or_b(provided) != names.h_or_b(found))
    confirmed = (distance < near) & (names.h_or_b(master) == names.h_or_b(found))
    subtype = F.when(found.isNull(), provided).when(~known, found).when(differ & confirmed, found).otherwise(provided)
    return F.struct(subtype.alias("subtype"), F.coalesce(differ & ~confirmed, F.lit(False)).alias("mismatch"))


def gaps(seq: Column) -> Column:
    """Runs of gaps in an aligned sequence: array of struct pos (from 1), n."""
    runs = F.regexp_extract_all(seq, F.lit("[^-]*-+"), F.lit(0))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<pos:int,n:int>>").alias("found"))

    def step(s: Column, run: Column) -> Column:
        n = F.length(run) - F.length(F.rtrim(run, F.lit("-")))
        end = s["end"] + F.length(run)
        return F.struct(end.alias("end"), F.concat(s["found"], F.array(F.struct((end - n + 1).alias("pos"), n.alias("n")))).alias("found"))

    return F.aggregate(runs, start, step, lambda s: s["found"])


def lineage_of_gaps(subtype: Column, seq: Column) -> Column:
    """The lineage that a single gap of a sequence of type B tells; empty if it tells none."""
    found = gaps(seq)
    out = F
    for pos, n, lineage in B_GAPS:
        out = out.when((subtype == "B") & (F.size(found) == 1) & (F.get(found, F.lit(0))["pos"] == pos) & (F.get(found, F.lit(0))["n"] == n), lineage)
    return out.otherwise("")


def with_lineage(rows: DataFrame, column: str = "aa") -> DataFrame:
    """lineage as gaps tell it, else as it was, and lineage_mismatch where both differ."""
    told = lineage_of_gaps(F.col("subtype"), F.col(column))
    was = F.coalesce(F.col("lineage"), F.lit(""))
    return rows.withColumns({"lineage_mismatch": (told != "") & (was != "") & (told != was), "lineage": F.when(told != "", told).otherwise(was)})


def master_for(masters: DataFrame, subtype: str) -> DataFrame:
    """The master sequence of a subtype, or of its H part."""
    wanted = masters.withColumn("_rank", F.when(F.col("subtype") == subtype, 0).when(names.h_or_b(F.col("subtype")) == names.h_or_b(F.lit(subtype)), 1))
    return wanted.where("_rank is not null").orderBy("_rank", "subtype").limit(1).drop("_rank")


def checked(rows: DataFrame, masters: DataFrame, column: str = "aa") -> DataFrame:
    """Adds ending issues against the master of each row's subtype (columns subtype and aa of masters; a dimension)."""
    m = masters.select(F.col("subtype").alias("_s"), F.col("aa").alias("_master"))
    joined = rows.join(m, F.col("subtype") == F.col("_s"), "left")
    ending = S.checked_ending(F.col(column), F.col("_master"))
    return joined.withColumns({column: F.when(F.col("_master").isNotNull(), ending["aa"]).otherwise(F.col(column)), "ending": F.when(F.col("_master").isNotNull(), ending["issues"]).otherwise("")}).drop("_s", "_master")
