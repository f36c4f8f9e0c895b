"""The older chart format, S-expressions, as a Python data source: ``spark.read.format("lispmds")`` and its writer.

A file is a chart; the reader makes a partition for each file and leaves out the
files that a filter on chart_id excludes.  The option ``table`` says what is
read: antigens, sera, titers, layouts or projections (of all charts, keyed by chart_id).  The writer
takes one row a chart (WRITTEN) and moves its files into place at the commit.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMAS = {
    "antigens": "chart_id string, antigen_no int, name string, reassortant string, passage string, annotations string, reference boolean",
    "sera": "chart_id string, serum_no int, name string, reassortant string, annotations string, serum_id string",
    "titers": "chart_id string, antigen_no int, serum_no int, titer string",
    "layouts": "chart_id string, projection_no int, point_no int, coord array<double>",
    "projections": "chart_id string, projection_no int, stress double, column_bases array<double>",
}
_antigen = "name: string, reassortant: string, passage: string, annotations: array<string>, reference: boolean"
_serum = "name: string, reassortant: string, annotations: array<string>, serum_id: string"
#: A chart as the writer takes it: titers by antigen, layouts and stresses of projections by point (null: disconnected).
WRITTEN = f"chart_id string, name string, antigens array<struct<{_antigen}>>, sera array<struct<{_serum}>>, titers array<array<string>>, layouts array<array<array<double>>>, stresses array<double>"

# Fixed values of the format: how characters of names are written, what ends an encoded name, what stands before its parts.
WRITTEN_AS = {" ": "_", "(": "", ")": "", ",": ".."}
AS_HEX = "%:$?\"'`;[]{}#|"
AS_HEX_IN_TABLE_NAMES = "/~"
SIGNATURES = ("!b", "@b", "/a", "@a")
STRAIN, TABLE = "!b", "@b"
HEAD = "MAKE-MASTER-MDS-WINDOW"

_TOKEN = re.compile(r";[^\n]*|\s+|['`]|(?P<open>\()|(?P<close>\))|\"(?P<string>[^\"]*)\"|(?P<atom>(?:\\.|\|[^|]*\||[^\s()'\"`,\\|])+)", re.S)
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eEdD][-+]?\d+)?")


class Symbol(str):
    """A symbol; keywords begin with a colon."""


def parsed(text: str) -> list:
    """The list that the text holds: lists, numbers, texts and symbols (nil: an empty list).  No recursion, so depth has no limit."""
    top: list = []
    stack, at = [top], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m["open"]:
            stack.append([])
            stack[-2].append(stack[-1])
        elif m["close"]:
            if len(stack) == 1:
                raise ValueError("a parenthesis closes that was not opened")
            stack.pop()
        elif m["string"] is not None:
            stack[-1].append(m["string"])
        elif m["atom"]:
            atom = m["atom"]
            if _NUMBER.fullmatch(atom):
                stack[-1].append(float(re.sub("[dD]", "e", atom)))
            else:
                stack[-1].append([] if atom.lower() == "nil" else Symbol(re.sub(r"\|([^|]*)\||\\(.)", lambda x: x[1] or x[2] or "", atom)))
    if len(stack) > 1:
        raise ValueError("a parenthesis is not closed")
    return top[0] if top else []


def encoded(name: str, signature: str = "") -> str:
    """A name as a symbol; signed if anything had to be changed and a signature is given."""
    hexed = AS_HEX + (AS_HEX_IN_TABLE_NAMES if signature == TABLE else "")
    out = "".join(WRITTEN_AS.get(c, f"%{ord(c):02X}" if c in hexed else c) for c in name)
    return out + signature if out != name else out


def decoded(name: str) -> str:
    """The name that a signed symbol stands for; others are names themselves.  What encoding drops is gone, but A(H3N2) is known."""
    if name[-2:].lower() not in SIGNATURES:
        return name

    def back(m: re.Match) -> str:
        x = m[0]
        return f"A({m[1]})" if m[1] else "," if x == ".." else " " if x == "_" else chr(int(x[1:], 16))

    return re.sub(r"\.\.|_|%[0-9A-Fa-f]{2}|(?:^|(?<=[_ ]))A(H[0-9]+N[0-9]+)", back, name[:-2])


def parts_of(symbol: str) -> dict[str, list[str]]:
    """The parts of an antigen's or serum's name: "" the name, r reassortant, p passage, a annotations, i serum id."""
    if symbol[-2:].lower() not in SIGNATURES:
        return {"": [symbol]}
    mark = " ([rpai])" + ("" if symbol[-1].lower() == "a" else "!")
    first, *rest = re.split(mark, decoded(symbol), flags=re.I)
    out = {"": [first]}
    for kind, value in zip(rest[::2], rest[1::2]):
        value = re.sub(r"(.+ )([12][90]\d\d-[0-2]\d-[0-3]\d)", r"\1(\2)", value) if kind in "pP" and re.fullmatch(r".+ [12][90]\d\d-[0-2]\d-[0-3]\d", value) else value
        out.setdefault(kind.lower(), []).append(value)
    return out


def _symbol(name: str, parts: list[tuple[str, str | None]]) -> str:
    out = encoded(name) + "".join(f"_{kind}!{encoded(value)}" for kind, value in parts if value)
    return out if out == name else out + STRAIN


def antigen_symbol(a) -> str:
    return _symbol(a["name"] or "", [("r", a["reassortant"]), ("p", a["passage"]), *(("a", x) for x in a["annotations"] or [])])


def serum_symbol(s) -> str:
    return _symbol(s["name"] or "", [("r", s["reassortant"]), *(("a", x) for x in s["annotations"] or []), ("i", s["serum_id"])])


class Chart:
    """The tables of one document."""

    def __init__(self, text: str):
        doc = parsed(text)
        if not doc or str(doc[0]).upper() != HEAD or len(doc) < 2 or not isinstance(doc[1], list) or len(doc[1]) < 4:
            raise ValueError(f"({HEAD} (HI-IN antigens sera titers ... expected")
        self.table = doc[1]
        self.keys = {str(k).upper(): v for k, v in zip(doc[2:], doc[3:]) if isinstance(k, Symbol) and k.startswith(":")}
        if not self.table[1] or not self.table[2]:
            raise ValueError("no antigens or no sera")

    def antigens(self) -> Iterator[tuple]:
        reference = set(map(str, self.keys.get(":REFERENCE-ANTIGENS") or []))
        for k, symbol in enumerate(self.table[1]):
            p = parts_of(str(symbol))
            yield k, p[""][0], *(p.get(x, [""])[-1] for x in "rp"), " ".join(p.get("a", [])), str(symbol) in reference

    def sera(self) -> Iterator[tuple]:
        for k, symbol in enumerate(self.table[2]):
            p = parts_of(str(symbol))
            yield k, p[""][0], p.get("r", [""])[-1], " ".join(p.get("a", [])), p.get("i", [""])[-1]

    def titers(self) -> Iterator[tuple]:
        """Numbers are logarithms of tenths."""
        of = lambda x: str(math.floor(2.0**x * 10 + 0.5))
        for a, row in enumerate(self.table[3]):
            for s, x in enumerate(row):
                if isinstance(x, float) or x[0] != "*":
                    yield a, s, of(x) if isinstance(x, float) else x[0] + of(float(x[1:]))

    def _runs(self) -> Iterator[tuple[list, list]]:
        if start := self.keys.get(":STARTING-COORDSS"):
            yield start, []
        for run in self.keys.get(":BATCH-RUNS") or []:
            yield run[0], run[1:]

    def layouts(self) -> Iterator[tuple]:
        points = len(self.table[1]) + len(self.table[2])
        for n, (layout, _) in enumerate(self._runs()):
            for k, coord in enumerate(layout[:points]):
                yield n, k, [float(x) for x in coord] if coord and all(isinstance(x, float) for x in coord) else None

    def projections(self) -> Iterator[tuple]:
        antigens, points = len(self.table[1]), len(self.table[1]) + len(self.table[2])
        for n, (layout, rest) in enumerate(self._runs()):
            bases = layout[points][0][1][antigens:points] if len(layout) > points and layout[points] and isinstance(layout[points][0], list) and len(layout[points][0]) > 1 else None
            yield n, rest[0] if rest and isinstance(rest[0], float) else None, bases


def rendered(chart) -> str:
    """The document of one row of WRITTEN."""
    value = lambda x: "*" if not x or x == "*" else (x[0] if x[0] in "<>" else "") + f"{math.log2(float(x.lstrip('<>')) / 10):.12g}"
    atom = lambda s: s if _TOKEN.fullmatch(s) and s.lower() != "nil" and not _NUMBER.fullmatch(s) and s[0] not in ";'`(\"" else f"|{s}|"
    coord = lambda c: f"({' '.join(repr(float(x)) for x in c)})" if c else "(NIL)"
    antigens = [antigen_symbol(a) for a in chart["antigens"]]
    runs = [f"(({' '.join(map(coord, layout))}) {s if s is not None else 'NIL'})" for layout, s in zip(chart["layouts"] or [], chart["stresses"] or [])]
    return "\n".join([
        ";; MDS configuration file (version 0.6).",
        f"({HEAD}",
        f"  (HI-IN '({' '.join(map(atom, antigens))})",
        f"    '({' '.join(atom(serum_symbol(s)) for s in chart['sera'])})",
        f"    '({chr(10).join('(' + ' '.join(map(value, row)) + ')' for row in chart['titers'])})",
        f"    '{atom(encoded(chart['name'] or 'table', TABLE))})",
        f"  :BATCH-RUNS '({' '.join(runs)})",
        f"  :REFERENCE-ANTIGENS '({' '.join(atom(s) for a, s in zip(chart['antigens'], antigens) if a['reference'])}))",
        "",
    ])


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path is on, and the path there."""
    path = re.sub("^file:/(?!/)", "file:///", path)
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, at = _system(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return fs, [at]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return fs, sorted(x.path for x in found if x.type == pafs.FileType.File and not re.search(r"/[._][^/]*(?:/|$)", x.path[len(at) :]))


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table, self.only = path, table, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equalities on chart_id choose files; they are checked again by none, the others by Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("chart_id",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = ids if self.only is None else self.only & ids
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path)[1] if self.only is None or p in self.only]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None or not partition.path:
            return
        fs, _ = _files(self.path)
        with fs.open_input_stream(partition.path) as f:
            text = f.read().decode()
        for row in getattr(Chart(text), self.table)():
            yield partition.path, *row


class _Message(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _at(self) -> tuple[pafs.FileSystem, str]:
        fs, at = _system(self.path)
        return fs, at.rstrip("/")

    def write(self, iterator: Iterator) -> _Message:
        """Charts go to a folder of this job, each attempt's under names of its own."""
        fs, at = self._at()
        fs.create_dir(f"{at}/_{self.job}")
        files = []
        for row in iterator:
            name = re.sub(r"[^A-Za-z0-9._-]+", "-", row["chart_id"].rsplit("/", 1)[-1]).removesuffix(".save") + ".save"
            made = f"{at}/_{self.job}/{uuid.uuid4().hex}"
            with fs.open_output_stream(made) as f:
                f.write(rendered(row).encode())
            files.append((made, f"{at}/{name}"))
        return _Message(files)

    def commit(self, messages: list[_Message | None]) -> None:
        fs, at = self._at()
        files = [f for m in messages if m for f in m.files]
        if len({to for _, to in files}) < len(files):
            raise ValueError("two charts have the same file name")
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(at)):
                if x.path.endswith(".save"):
                    fs.delete_file(x.path)
        for made, to in files:
            fs.move(made, to)
        fs.delete_dir(f"{at}/_{self.job}")

    def abort(self, messages: list[_Message | None]) -> None:
        fs, at = self._at()
        if fs.get_file_info(f"{at}/_{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/_{self.job}")


class LispmdsSource(DataSource):
    """Options: path, and for reading table (antigens, sera, titers, layouts or projections)."""

    @classmethod
    def name(cls) -> str:
        return "lispmds"

    def schema(self) -> str:
        table = self.options.get("table", "titers")
        if table not in SCHEMAS:
            raise ValueError(f"table is one of {', '.join(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("table", "titers"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; filters reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LispmdsSource)
