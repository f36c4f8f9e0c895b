"""Virus names as columns: reassortant, subtype, host, location, isolation, year and what is left over.

Everything is expressions over the text and lookups in a location table; the
year that counts as the present one is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of reassortants and how they are spelled before their number (upper case; blanks, dashes and underscores between parts don't matter).
MAKERS = {
    "NYMC": ["NYMC X", "NYMC BX", "NYMC", "BX", "X"],
    "NIB": ["NIBSC", "NIBRG", "NIB"],
    "RG": ["PR8 IDCDC RG", "IDCDC RG", "IBCDC RG", "RG"],
    "CBER": ["CBER"],
    "BVR": ["BVR"],
    "IVR": ["IVR"],
    "CVR": ["CVR"],
    "CNIC": ["CNIC"],
    "SAN": ["SAN"],
}
# Names without a number of their own, and those that only count where the name says that it is a reassortant's.
UNNUMBERED = {"PR8": ["PR8 HY", "PR8"]}
DECLARED = {"CL": ["CL"], "CDC": ["CDC"]}
DECLARED_UNNUMBERED = {"BS": ["BS"]}
# Words that are hosts even where a location has the same name.
HOSTS = [
    "BARNACLE GOOSE", "BROILER CHICKEN", "BLUE WINGED TEAL", "CAMEL", "CHICK", "CHICKEN", "COCKATOO", "COMMON BUZZARD", "COMMON KESTREL", "COMMON TEAL", "CROW", "DOMESTIC GOOSE",
    "DUCK", "EGRET", "EMU", "EQ", "EQUINE", "EURASIAN TEAL", "EURASIAN WIGEON", "EUROPEAN HERRING GULL", "FANCY CHICKEN", "FOX", "FOWL", "GADWALL", "GRAY HERON", "GRAYLAG GOOSE",
    "HARBOUR SEAL", "MALLARD", "MALLARD DUCK", "MINK", "OSTRICH", "PAVO", "PINTAIL DUCK", "QUAIL", "ROOK", "SHEARWATER", "SHOVELER", "STARLING", "SWINE", "TURKEY", "WDK", "WHITE-TAILED EAGLE",
]
EARLIEST = 1900


def tidy(name: Column) -> Column:
    """Upper case, single blanks, none around slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.upper(name)), "\\s+", " "), " ?/ ?", "/")


def _spelled(spellings: list[str], number: str) -> str:
    """A pattern of any of the spellings, not inside a word, with a number after it."""
    each = ["[ _-]*".join(x.split()) for x in spellings]
    # a single letter is too common to stand for a name after a slash or a parenthesis
    long, single = [x for x in each if len(x) > 1], [x for x in each if len(x) == 1]
    out = [f"(?<![A-Z0-9])(?:{'|'.join(long)}){number}"] if long else []
    return "|".join(out + [f"(?:(?<![A-Z0-9/(])|(?<=SORTANT/)|(?<=\\(A/)){x}{number}" for x in single])


_NUMBER = "[ -]?[0-9][A-Z0-9-]*(?![A-Z0-9])"
_DOTTED = "[ -]*[0-9A-Z.]*[0-9][0-9A-Z.]*(?![A-Z0-9])"
_MADE = "^[AB][^/]*/RE[A-Z]*SORTANT/|^HIGH ?GROWTH RE[A-Z]*SORTANT "
_NAMED = [(called, _spelled(x, _DOTTED if called == "RG" else _NUMBER), "") for called, x in MAKERS.items()]
_NAMED += [("IGYRP", _spelled(["IGYRP"], "[0-9]+(?:[.]C[0-9]+)?"), ""), ("REASSORTANT", "(?<![A-Z0-9])REASSORTANT-[^ ]+", "")]
_PLAIN = [(called, _spelled(x, "(?![A-Z0-9])"), called) for called, x in UNNUMBERED.items()]
_ONLY_MADE = [(called, _spelled(x, "[ -]*[0-9]+"), "") for called, x in DECLARED.items()] + [(called, _spelled(x, "(?![A-Z0-9])"), called) for called, x in DECLARED_UNNUMBERED.items()]


def _canonical(found: Column, named: list[tuple[str, str, str]]) -> Column:
    """What a spelling with its number is called."""
    out = F
    for called, pattern, whole in named:
        if whole:
            out = out.when(found.rlike(f"^(?:{pattern})$"), whole)
        elif called in ("IGYRP", "REASSORTANT", "CDC"):
            out = out.when(found.rlike(f"^(?:{called})"), F.regexp_replace(found, "^CDC[ -]+", "CDC"))
        else:
            spelled = "|".join(sorted(("[ _-]*".join(x.split()) for x in ({**MAKERS, **DECLARED})[called]), key=len, reverse=True))
            out = out.when(found.rlike(f"^(?:{spelled})[ -]*[0-9A-Z.]*[0-9]"), F.concat(F.lit(called + "-"), F.regexp_replace(found, f"^(?:{spelled})[ -]*", "")))
    return out.otherwise(found)


def reassortant_and_rest(name: Column) -> Column:
    """Struct reassortant, rest: the first reassortant that is named, and the text without it.

    Where the name declares a reassortant, all that it names count, in their
    order, and the crosses between them are left out.
    """
    once = "|".join(p for _, p, _ in _NAMED + _PLAIN)
    every = "|".join(p for _, p, _ in _NAMED + _ONLY_MADE + _PLAIN)
    made, text = name.rlike(_MADE), F.trim(F.regexp_replace(name, "^HIGH ?GROWTH RE[A-Z]*SORTANT ", ""))
    first = _canonical(F.regexp_extract(text, once, 0), _NAMED + _PLAIN)
    all_ = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"({every})"), F.lit(1)), lambda x: _canonical(x, _NAMED + _ONLY_MADE + _PLAIN)), " ")
    bare = F.regexp_replace(F.regexp_replace(text, "^[AB][^/]*/RE[A-Z]*SORTANT/", ""), every, " ")
    uncrossed = F.regexp_replace(F.regexp_replace(bare, "\\( *(?:A/)? *X ", "("), " X *(?=\\)|$)", " ")
    single = F.regexp_replace(text, f"^(.*?)[_]?(?:{once})", "$1 ")
    found = F.struct(all_.alias("reassortant"), uncrossed.alias("rest"))
    return F.when(made & text.rlike(every), found).when(text.rlike(once), F.struct(first.alias("reassortant"), single.alias("rest"))).otherwise(F.struct(F.lit("").alias("reassortant"), name.alias("rest")))


def fixed_year(year: Column, this_year: int) -> Column:
    """Four digits, of two digits in this century if not after this year; of a date its year; null if it is none."""
    n = F.substring(year, 1, 4).cast("int")
    long = F.when((n >= EARLIEST) & (n <= this_year), n.cast("string"))
    two = F.when(year.cast("int") <= this_year - 2000, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    return F.when(year.rlike("^\\d{4}(-\\d{2}-\\d{2})?$"), long).when(year.rlike("^\\d{2}$"), two)


def parse_names(rows: DataFrame, locations: DataFrame, column: str = "name", this_year: int = 2030) -> DataFrame:
    """Adds subtype, host, location, isolation, year, reassortant, extra, country and issue.

    locations: name, location, country — all spellings of the places that are
    known; a dimension table, looked up by equality for the first part, the
    second, and both together.
    """
    keep = rows.columns
    df = rows.withColumn("_r", reassortant_and_rest(tidy(F.col(column)))).withColumn("_t", F.trim(F.regexp_replace(F.translate("_r.rest", "()[]", "    "), " +", " ")))
    # brackets of the subtype were blanked: A H3N2 / X and AH3N2/X are A(H3N2)/X
    df = df.withColumn("_t", F.regexp_replace(F.regexp_replace("_t", "^(A) ?(H\\d+(?:N\\d+)?) ?/", "$1($2)/"), "/ +", "/"))
    df = df.withColumn("_f", F.transform(F.split("_t", "/"), lambda x: F.trim(x))).withColumn("_n", F.size("_f"))
    typed = F.get("_f", F.lit(0)).rlike("^(A(\\(H\\d+(N\\d+)?\\))?|B)$")
    df = df.withColumn("_typed", typed & (F.col("_n") > 2)).withColumn("subtype", F.when(F.col("_typed"), F.get("_f", F.lit(0))).otherwise(""))
    df = df.withColumn("_p", F.when(F.col("_typed"), F.slice("_f", 2, 10)).otherwise(F.col("_f"))).withColumn("_n", F.size("_p"))
    last = F.element_at("_p", -1)
    tail = "^(\\d{4}-\\d{2}-\\d{2}|\\d{4}|\\d{2})(?: +(.*))?$"
    df = df.withColumn("_year", F.regexp_extract(last, tail, 1)).withColumn("_shaped", (F.col("_n") > 2) & last.rlike(tail))
    df = df.withColumn("_a", F.get("_p", F.lit(0))).withColumn("_b", F.get("_p", F.lit(1)))
    known = locations.select(F.upper("name").alias("_name"), F.upper("location").alias("_loc"), F.col("country").alias("_country"))
    for key, text in (("1", F.col("_a")), ("2", F.when(F.col("_n") > 3, F.col("_b"))), ("12", F.when(F.col("_n") > 3, F.concat_ws(" ", "_a", "_b")))):
        part = known.select(F.col("_name").alias(f"_k{key}"), F.col("_loc").alias(f"_l{key}"), F.col("_country").alias(f"_c{key}"))
        df = df.withColumn(f"_q{key}", text).join(part, F.col(f"_q{key}") == F.col(f"_k{key}"), "left")
    four = F.col("_n") > 3
    host_first = four & ((F.col("_l1").isNull() & F.col("_l2").isNotNull()) | F.translate("_a", "_", " ").isin(HOSTS) & (F.col("_l2").isNotNull() | F.col("_l12").isNull()))
    double = four & ~host_first & F.col("_l12").isNotNull()
    case = F.when(~F.col("_shaped"), "none").when(host_first, "host").when(double, "double").when(four & F.col("_l1").isNotNull(), "joined").when(four, "unknown").otherwise("plain")
    df = df.withColumn("_case", case)
    pick = lambda **by: F.coalesce(*(F.when(F.col("_case") == k, v) for k, v in by.items()), F.lit(""))
    zeros = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    c, d = F.get("_p", F.lit(2)), F.get("_p", F.lit(1))
    df = df.withColumn("host", pick(host=F.col("_a")))
    df = df.withColumn("location", pick(host=F.coalesce("_l2", "_b"), double=F.col("_l12"), joined=F.col("_l1"), unknown=F.concat_ws("/", "_a", "_b"), plain=F.coalesce("_l1", "_a")))
    df = df.withColumn("isolation", pick(host=zeros(c), double=zeros(c), joined=F.concat_ws("-", d, c), unknown=zeros(c), plain=zeros(d)))
    year = fixed_year(F.col("_year"), this_year)
    df = df.withColumn("year", F.when(F.col("_case") == "none", "").otherwise(F.coalesce(year, F.col("_year"))))
    over = F.when(F.col("_case") == "none", F.when(F.col("_r.reassortant") != "", F.col("_t"))).otherwise(F.regexp_extract(last, tail, 2))
    df = df.withColumn("extra", F.coalesce(F.trim(over), F.lit(""))).withColumn("reassortant", F.col("_r.reassortant"))
    df = df.withColumn("country", F.coalesce(pick(host=F.col("_c2"), double=F.col("_c12"), joined=F.col("_c1"), plain=F.col("_c1")), F.lit("")))
    lost = F.when((F.col("_case") == "none") & (F.col("reassortant") == ""), "unhandled").when((F.col("_case") != "none") & year.isNull(), "invalid_year").when((F.col("_case") == "unknown") | (F.col("_case") == "plain") & F.col("_l1").isNull() | (F.col("_case") == "host") & F.col("_l2").isNull(), "unrecognized_location").otherwise("")
    return df.withColumn("issue", lost).select(*(x for x in keep if x not in ("reassortant", "country", "location", "year", "extra")), "subtype", "host", "location", "isolation", "year", "reassortant", "extra", "country", "issue")


def rendered(subtype: Column, host: Column, location: Column, isolation: Column, year: Column, reassortant: Column, extra: Column) -> Column:
    name = F.concat_ws("/", *(F.when(x != "", x) for x in (subtype, host, location, isolation, year)))
    return F.concat_ws(" ", *(F.when(x != "", x) for x in (name, reassortant, extra)))


def abbreviated(abbreviation: Column, isolation: Column, year: Column) -> Column:
    """Location as abbreviated, isolation and the last two digits of the year."""
    return F.concat_ws("/", abbreviation, isolation, F.substring(year, -2, 2))


def location_abbreviation(location: Column, country: Column, cdc: Column) -> Column:
    """Of places in the USA the given code; of several words their initials; else the first two letters."""
    words = F.filter(F.split(location, " "), lambda x: x != "")
    return F.when((country == "UNITED STATES OF AMERICA") & cdc.isNotNull(), cdc).when(F.size(words) > 1, F.array_join(F.transform(words, lambda x: F.substring(x, 1, 1)), "")).otherwise(F.concat(F.upper(F.substring(location, 1, 1)), F.lower(F.substring(location, 2, 1))))


def h_or_b(type_subtype: Column) -> Column:
    """B, or the H part: H3 of A(H3N2)."""
    return F.when(type_subtype.startswith("B"), "B").otherwise(F.regexp_extract(type_subtype, "H\\d+", 0))


def hn_or_b(type_subtype: Column) -> Column:
    return F.when(type_subtype.startswith("B"), "B").otherwise(F.regexp_extract(type_subtype, "H\\d+(?:N\\d+)?", 0))


def lineage(text: Column) -> Column:
    t = F.upper(text)
    return F.when(t.startswith("V"), "V").when(t.startswith("Y"), "Y").otherwise(t)


def with_subtype_prefix(name: Column, subtype: Column) -> Column:
    return F.when(name.rlike("^(A(\\(H\\d+(N\\d+)?\\))?|B)/"), name).otherwise(F.concat_ws("/", subtype, name))
