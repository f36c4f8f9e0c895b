"""Titer sheets of single laboratories, as cells (file, sheet, row, col, text) to antigens, sera and titers.

Each laboratory is a set of rules over the same steps: cells are made plain, the
block of titers is found, rows beside it give antigens, and the rows above it (or,
for some, a list below it that is linked by index letters) give sera.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import titer as T
from .tables import COLUMNS, SHEET, label_columns, titer_block


@dataclass(frozen=True)
class Rules:
    """What is particular to a laboratory's sheets."""

    #: Replacements of titers: pattern, replacement, in order.
    titers: tuple[tuple[str, str], ...] = ()
    month_first: bool = False
    #: Sera are listed below the titers and linked by an index.
    sera_below: bool = False
    #: The index of a column and that of a list are compared by their first letter only.
    index_by_letter: bool = False
    #: Rows with an antigen name like this are no antigens, sera with a name like this no sera.
    control_antigen: str = "(?i)control ag"
    control_serum: str = "(?i)pool|control|normal|human|\\bWHO\\b"
    #: Serum names stand in two rows.
    name_in_two_rows: bool = False
    #: Bare < and > are replaced by what the footnote says that the serum id refers to.
    footnotes: bool = False
    #: Cells of a date or lab id column that are the column's title.
    titles: str = "(?!)"
    #: Rows with such a cell beside the titers hold serum ids, no titers.
    serum_ids_beside: str = "(?!)"
    lab_id: str = COLUMNS["lab_id"]
    #: What tells the laboratory in the first rows of a sheet.
    sniff: str = "(?!)"
    #: Virus names in this laboratory's own form: pattern, replacement.
    names: tuple[tuple[str, str], ...] = field(default=())


# Fixed values of the laboratories.
LABS = {
    "CDC": Rules(titers=(("^5$", "<10"),), month_first=True, sera_below=True, index_by_letter=True, lab_id="^(?:CDC)?[0-9]{7,10}$", sniff="(?i)\\bCDC\\b|REFERENCE FERRET ANTISERA"),
    "CNIC": Rules(titers=(("^5$", "<10"),), month_first=True, sera_below=True, sniff="(?i)\\bCNIC\\b|CHINESE NATIONAL", names=(("(?i)^B[VY]/", "B/"),)),
    "CRICK": Rules(titers=(("^ND$", "*"),), name_in_two_rows=True, footnotes=True, sniff="(?i)\\bCRICK\\b"),
    "NIID": Rules(titers=(("\\uFF1C", "<"),), sniff="(?i)\\bNIID\\b"),
    "VIDRL": Rules(titles="(?i)^(?:sample )?date|^(?:lab|vidrl) ?(?:id|no)", serum_ids_beside="^[A-Z]?[0-9]{3,5}-?[0-9]+D$", lab_id="^(?:SL|VW)?[0-9]{6,10}$", sniff="(?i)\\bVIDRL\\b"),
}


def laboratory(cells: DataFrame, first_rows: int = 6) -> DataFrame:
    """file, sheet, lab: by what the first rows of a sheet say; the first laboratory in the table counts, empty if none does."""
    found = F.coalesce(*(F.when(F.bool_or(F.col("text").rlike(r.sniff)), lab) for lab, r in LABS.items()), F.lit(""))
    return cells.where(F.col("row") < first_rows).groupBy(*SHEET).agg(found.alias("lab"))


def plain_cells(cells: DataFrame, rules: Rules) -> DataFrame:
    """Cells without blanks around, titers in plain form; titles in data columns are left out."""
    text = F.trim(F.col("text"))
    for pattern, new in rules.names:
        text = F.regexp_replace(text, pattern, new)
    bare = F.regexp_replace(text, "\\s+", "")
    titer = bare
    for pattern, new in rules.titers:
        titer = F.regexp_replace(titer, pattern, new)
    changed = bare.rlike("^[<>~\\uFF1C]?[0-9.]+$|^(?:ND|NT|\\*|[<>])$")
    return cells.withColumn("text", F.when(changed, F.regexp_replace(titer, "\\.0+$", "")).otherwise(text)).where(~F.col("text").rlike(rules.titles))


def block_of(cells: DataFrame, rules: Rules) -> DataFrame:
    """The block of titers: of rows with a virus name, without those that hold serum ids beside it."""
    rows = lambda pattern: cells.where(F.col("text").rlike(pattern)).select(*SHEET, "row").distinct()
    return titer_block(cells.join(rows(COLUMNS["name"]), [*SHEET, "row"], "left_semi").join(rows(rules.serum_ids_beside), [*SHEET, "row"], "left_anti"))


def _numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """by (a row or column of a sheet) with numbers from 0."""
    return rows.select(*SHEET, by).distinct().withColumn(name, F.row_number().over(Window.partitionBy(*SHEET).orderBy(by)) - 1)


def antigens_of(cells: DataFrame, block: DataFrame, rules: Rules) -> DataFrame:
    """file, sheet, row, antigen_no, name, date, passage, lab_id of the rows of titers; controls are left out."""
    rows = cells.join(block, SHEET).where("row between first_row and last_row")
    beside = rows.where("not (col between first_col and last_col)")
    own = COLUMNS | {"lab_id": rules.lab_id}
    labels = label_columns(cells, block) if rules.lab_id == COLUMNS["lab_id"] else _labels(beside, own)
    fields = beside.join(labels, [*SHEET, "col"]).groupBy(*SHEET, "row").agg(*(F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k) for k in own))
    fields = fields.where(F.col("name").isNotNull() & ~F.col("name").rlike(rules.control_antigen))
    date = F.coalesce(dates.parse_date(F.col("date"), rules.month_first), F.lit(""))
    made = fields.select(*SHEET, "row", F.upper("name").alias("name"), date.alias("date"), F.upper(F.coalesce("passage", F.lit(""))).alias("passage"), F.coalesce("lab_id", F.lit("")).alias("lab_id"))
    return made.join(_numbered(fields, "row", "antigen_no"), [*SHEET, "row"])


def _labels(beside: DataFrame, patterns: dict[str, str]) -> DataFrame:
    each = beside.groupBy(*SHEET, "col").agg(*(F.count_if(F.col("text").rlike(p)).alias(k) for k, p in patterns.items()))
    long = each.select(*SHEET, "col", F.explode(F.create_map(*(x for k in patterns for x in (F.lit(k), F.col(k))))).alias("kind", "n")).where("n > 0")
    return long.groupBy(*SHEET, "kind").agg(F.max_by("col", F.struct("n", -F.col("col"))).alias("col"))


def sera_above(cells: DataFrame, block: DataFrame, rules: Rules) -> DataFrame:
    """file, sheet, col, name, passage, serum_id, note (the footnote that an id refers to) from the rows above the titers."""
    above = cells.join(block, SHEET).where("row < first_row and col between first_col and last_col")
    if rules.name_in_two_rows:  # a subtype or place over a number or the rest
        first = "^(?:[AB]/)?[A-Za-z][A-Za-z .'-]+$"
        pairs = above.select(*SHEET, "col", "row", "text").join(above.select(*SHEET, "col", (F.col("row") - 1).alias("row"), F.col("text").alias("under")), [*SHEET, "col", "row"])
        named = pairs.where(F.col("text").rlike(first) & F.col("under").rlike("^[A-Za-z0-9.-]+(?:/[0-9A-Za-z.-]+)*/?[0-9]{2,4}$"))
        names = named.groupBy(*SHEET, "col").agg(F.min_by(F.upper(F.concat_ws("/", "text", "under")), "row").alias("name"), F.min(F.col("row") + 1).alias("_last"))
    else:
        names = above.where(F.col("text").rlike(COLUMNS["name"])).groupBy(*SHEET, "col").agg(F.max_by(F.upper("text"), "row").alias("name"), F.max("row").alias("_last"))
    rest = above.join(names.select(*SHEET, "col", "_last"), [*SHEET, "col"])
    passage = F.col("text").rlike(COLUMNS["passage"])
    found = rest.where("row > _last").groupBy(*SHEET, "col").agg(F.max_by(F.when(passage, F.upper("text")), F.when(passage, F.col("row"))).alias("passage"), F.max_by(F.when(~passage, F.col("text")), F.when(~passage, F.col("row"))).alias("id"))
    note = F.regexp_extract("id", "\\^([0-9a-z]+)$", 1) if rules.footnotes else F.lit("")
    out = names.drop("_last").join(found, [*SHEET, "col"], "left").withColumn("id", F.coalesce("id", F.lit("")))
    serum_id = F.regexp_replace(F.upper(F.regexp_replace("id", "\\^[0-9a-z]+$", "")), "\\s+", "") if rules.footnotes else F.col("id")
    return out.select(*SHEET, "col", "name", F.coalesce("passage", F.lit("")).alias("passage"), serum_id.alias("serum_id"), note.alias("note"))


def sera_below(cells: DataFrame, block: DataFrame, rules: Rules) -> DataFrame:
    """As sera_above, from a list under the titers: an index in the row over the titers names the list's line; the columns of the list have titles."""
    here = cells.join(block, SHEET)
    index_row = here.where("row < first_row and col between first_col and last_col").where(F.length("text") <= 3).groupBy(*SHEET).agg(F.max("row").alias("index_row"))
    indexes = here.join(index_row, SHEET).where("row = index_row and col between first_col and last_col").select(*SHEET, "col", F.col("text").alias("index"))
    lists = here.where("row > last_row").select(*SHEET, "row", F.col("col").alias("c"), "text")
    names = lists.where(F.col("text").rlike(COLUMNS["name"])).groupBy(*SHEET, "row").agg(F.min_by(F.struct("c", "text"), "c").alias("n"))
    titles = lists.join(names.groupBy(*SHEET).agg(F.min("row").alias("first_line")), SHEET).where("row < first_line")
    kind = F.when(F.col("text").rlike("(?i)^lot|serum id|^id"), "serum_id").when(F.col("text").rlike("(?i)passage"), "passage").when(F.col("text").rlike("(?i)species"), "species").when(F.col("text").rlike("(?i)boosted"), "boosted").when(F.col("text").rlike("(?i)conc"), "conc")
    titles = titles.withColumn("kind", kind).where("kind is not null").groupBy(*SHEET, "kind").agg(F.min("c").alias("c"))
    values = lists.join(titles, [*SHEET, "c"]).groupBy(*SHEET, "row").agg(*(F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k) for k in ("serum_id", "passage", "species", "boosted", "conc")))
    line = names.join(lists.select(*SHEET, "row", F.col("c").alias("_ic"), F.col("text").alias("line_index")), [*SHEET, "row"]).where("_ic = n.c - 1").join(values, [*SHEET, "row"], "left")
    short = (lambda c: F.substring(c, 1, 1)) if rules.index_by_letter else F.col
    both = indexes.withColumn("_i", short("index")).join(line.withColumn("_i", short("line_index")), [*SHEET, "_i"])
    blank = lambda c: F.coalesce(c, F.lit(""))
    return both.select(*SHEET, "col", F.upper("n.text").alias("name"), F.upper(blank("passage")).alias("passage"), blank("serum_id").alias("serum_id"), F.lit("").alias("note"), blank("species").alias("species"), blank("boosted").alias("boosted"), blank("conc").alias("conc"))


def footnotes_of(cells: DataFrame, block: DataFrame) -> DataFrame:
    """file, sheet, note, less: what bare < stand for, from cells under the titers such as "1 < = <40" or "1 < = <40; 2 < = <20"."""
    under = cells.join(block, SHEET).where("row > last_row").select(*SHEET, F.explode(F.split("text", "[;,]")).alias("part"))
    rule = "^\\s*([0-9a-z]+)?\\s*<\\s*=\\s*(<\\s*[0-9]+)\\s*$"
    return under.where(F.col("part").rlike(rule)).select(*SHEET, F.regexp_extract("part", rule, 1).alias("note"), F.regexp_replace(F.regexp_extract("part", rule, 2), "\\s", "").alias("less"))


def niid_serum(text: Column) -> Column:
    """Struct name, passage, serum_id of a serum's cell such as "A/KYOTO/1/2019 CELL No.3": the passage may be part of the id."""
    t = F.regexp_replace(F.upper(text), "\\s+", " ")
    rule = "^(.*?) *(?:(EGG|CELL|HCK|MDCK|SIAT) *)?(?:NO\\.? *|(#))([0-9A-Z.-]+)$"
    kind, mark, number = F.regexp_extract(t, rule, 2), F.regexp_extract(t, rule, 3), F.regexp_extract(t, rule, 4)
    serum_id = F.concat_ws(" ", F.nullif(kind, F.lit("")), F.concat(F.when(mark == "#", "#").otherwise("NO."), number))
    return F.when(t.rlike(rule), F.struct(F.trim(F.regexp_extract(t, rule, 1)).alias("name"), kind.alias("passage"), serum_id.alias("serum_id"))).otherwise(F.struct(t.alias("name"), F.lit("").alias("passage"), F.lit("").alias("serum_id")))


def full_serum_names(sera: DataFrame, antigens: DataFrame) -> DataFrame:
    """Short serum names such as TAS503 become the name of an antigen of that place and number; others stay."""
    short = "^([A-Z]{2,5})([0-9]+)$"
    a = antigens.select(*SHEET, F.upper(F.element_at(F.split("name", "/"), -3)).alias("_place"), F.element_at(F.split("name", "/"), -2).alias("_no"), F.col("name").alias("_full"))
    s = sera.withColumns({"_p": F.regexp_extract("name", short, 1), "_no": F.regexp_extract("name", short, 2)})
    hits = s.join(a, [*SHEET, "_no"]).where((F.col("_p") != "") & F.expr("startswith(_place, _p)")).groupBy(*SHEET, "col").agg(F.min("_full").alias("_full"))
    return s.join(hits, [*SHEET, "col"], "left").withColumn("name", F.coalesce("_full", "name")).drop("_p", "_no", "_full")


def paired_titers(titers: DataFrame) -> DataFrame:
    """Titers of neighbouring columns (two-fold, read) as a/b under the first one's column; columns: file, sheet, row, col, first_col, text."""
    pair = ((F.col("col") - F.col("first_col")) / 2).cast("int")
    both = titers.withColumn("_pair", pair).groupBy(*SHEET, "row", "_pair", "first_col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), "/").alias("text"))
    return both.select(*SHEET, "row", (F.col("first_col") + 2 * F.col("_pair")).alias("col"), "text")


def sheet_tables(cells: DataFrame, lab: str, paired: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Antigens, sera and titers of one laboratory's sheets; control antigens and sera are left out, sera numbered by column."""
    rules = LABS[lab]
    cells = plain_cells(cells, rules)
    block = block_of(cells, rules)
    antigens = antigens_of(cells, block, rules)
    if rules.sera_below:
        sera = sera_below(cells, block, rules)
    elif lab == "NIID":
        above = cells.join(block, SHEET).where("row < first_row and col between first_col and last_col").where(F.col("text").contains("/"))
        parts = above.groupBy(*SHEET, "col").agg(F.max_by(niid_serum(F.col("text")), "row").alias("s"))
        sera = parts.select(*SHEET, "col", "s.name", "s.passage", "s.serum_id", F.lit("").alias("note"))
    elif lab == "VIDRL":
        short = cells.withColumn("text", F.when(F.col("text").rlike("^[A-Z]{2,5}[0-9]+$") & ~F.col("text").rlike(COLUMNS["passage"]), F.concat(F.lit("A/"), "text", F.lit("/0/00"))).otherwise(F.col("text")))
        sera = sera_above(short, block, rules)
        sera = full_serum_names(sera.withColumn("name", F.regexp_replace("name", "^A/([A-Z]{2,5}[0-9]+)/0/00$", "$1")), antigens)
    else:
        sera = sera_above(cells, block, rules)
    sera = sera.where(~F.col("name").rlike(rules.control_serum) & ~F.upper("serum_id").contains("POOL"))
    sera = sera.join(_numbered(sera, "col", "serum_no"), [*SHEET, "col"])
    inside = cells.join(block, SHEET).where("row between first_row and last_row and col between first_col and last_col")
    values = paired_titers(inside) if paired else inside.select(*SHEET, "row", "col", "text")
    titers = values.join(antigens.select(*SHEET, "row", "antigen_no"), [*SHEET, "row"]).join(sera.select(*SHEET, "col", "serum_no", "note"), [*SHEET, "col"])
    if rules.footnotes:
        titers = titers.join(footnotes_of(cells, block), [*SHEET, "note"], "left").withColumn("text", F.when(F.col("text") == "<", F.coalesce("less", F.lit("<"))).otherwise(F.col("text")))
    checked = F.col("text") if paired else T.checked(F.col("text"))
    return antigens.drop("row"), sera.drop("col", "note"), titers.select(*SHEET, "antigen_no", "serum_no", checked.alias("titer")).where("titer <> '*'")
