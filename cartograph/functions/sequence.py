"""Column functions on sequences; positions count from 1."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASES = "UCAG"
# The standard genetic code, codons in the order UCAG by first, second and third base.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)} | {"UAR": "*", "URA": "*"}


def letter(seq: Column, pos: int | Column) -> Column:
    """The letter at a position, a blank past the end."""
    found = F.substring(seq, pos, 1)
    return F.when(found == "", " ").otherwise(found)


def matches(seq: Column, predicate: str) -> Column:
    """All of the positions of a predicate such as "156K !145K"."""
    out = F.lit(True)
    for part in predicate.split():
        m = re.fullmatch(r"(!?)(\d+)([A-Z-])", part)
        if not m:
            raise ValueError(f"not a position and letter: {part!r}")
        at = letter(seq, int(m[2])) == m[3]
        out = out & (~at if m[1] else at)
    return out


def has_letter(seq: Column, pos: int, letters: str) -> Column:
    return F.instr(F.lit(letters), F.substring(seq, pos, 1)) > 0


def translate(nuc: Column, offset: int = 0) -> Column:
    """Amino acids of the codons from an offset on; T counts as U, codons that are not in the code are X."""
    n = F.floor((F.length(nuc) - offset) / 3).cast("int")
    code = F.create_map(*(F.lit(x) for kv in sorted(CODONS.items()) for x in kv))
    rna = F.translate(F.upper(nuc), "T", "U")
    codons = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(code[F.substring(rna, i * 3 + offset + 1, F.lit(3))], F.lit("X")))
    return F.when(n < 1, "").otherwise(F.array_join(codons, ""))


def longest_frame(nuc: Column, least: int = 200) -> Column:
    """offset and aa of the reading frame whose longest part between stops is longest, if that has ``least`` letters."""
    frames = F.array(*(F.struct(F.array_max(F.transform(F.split(translate(nuc, k), "\\*"), lambda x: F.length(x))).alias("n"), F.lit(-k).alias("minus"), translate(nuc, k).alias("aa")) for k in range(3)))
    best = F.array_max(frames)
    part = lambda s: F.array_max(F.transform(F.split(s, "\\*"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return F.when(best["n"] >= least, F.struct((-best["minus"]).alias("offset"), part(best["aa"]).alias("aa")))


def trim_absent(aa: Column) -> Column:
    """Without X and - at both ends; kept if there is nothing else."""
    out = F.regexp_replace(aa, "^[X-]+|[X-]+$", "")
    return F.when(out == "", aa).otherwise(out)


def hamming(a: Column, b: Column, shortest: bool = False) -> Column:
    """Positions with different letters; what one has more counts too, unless shortest."""
    x, y = F.split(a, ""), F.split(b, "")
    n = F.least(F.length(a), F.length(b))
    differs = F.size(F.filter(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p != q), lambda d: d))
    differs = F.when(n == 0, 0).otherwise(differs)
    return differs if shortest else differs + F.abs(F.length(a) - F.length(b))


def count_letter(seq: Column, ch: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(ch), F.lit("")))


def quality_issues(aa: Column, nuc: Column) -> Column:
    """Letters of the issues that a sequence shows by itself: X too many unknowns, D too many deletions, x unknowns at its beginning, t not translated."""
    return F.concat(F.when(F.coalesce(F.length(aa), F.lit(0)) == 0, "t").otherwise(""), F.when(aa.startswith("X"), "x").otherwise(""), F.when(count_letter(aa, "X") > 10, "X").otherwise(""), F.when(count_letter(aa, "-") > 6, "D").otherwise(""))


def seq_id(*parts: Column) -> Column:
    """An identifier of name parts: brackets, quotes and such go, blanks become _."""
    text = F.concat_ws("_", *(F.when(p != "", p) for p in parts))
    text = F.translate(text, "()[]:';!#*@$", "")
    text = F.translate(F.translate(text, "?", "X"), ",+", "//")
    return F.regexp_replace(F.translate(text, " &=", "___"), "_+", "_")


def aa_to_nuc(pos: Column) -> Column:
    """First nucleotide of an amino acid."""
    return (pos - 1) * 3 + 1


def nuc_to_aa(pos: Column) -> Column:
    return F.floor((pos - 1) / 3) + 1


def checked_ending(aa: Column, master: Column, size: int = 3) -> Column:
    """aa and issues: the end of a sequence against its master's.

    Shorter ones are too short (s); longer ones that end like the master have
    insertions (l), those that have its end at its place are cut there, others
    have garbage at the end (lE), as have those of equal length with another end (E).
    """
    n, m = F.length(aa), F.length(master)
    end = F.right(master, F.lit(size))
    alike = hamming(F.right(aa, F.lit(size)), end) <= 1
    at_place = hamming(F.substring(aa, m - size + 1, F.lit(size)), end) <= 1
    longer = F.when(alike, "l").when(at_place, "").otherwise("lE")
    issues = F.when(n < m, "s").when(n > m, longer).when(~alike, "E").otherwise("")
    return F.struct(F.when((n > m) & ~alike & at_place, F.left(aa, m)).otherwise(aa).alias("aa"), issues.alias("issues"))
