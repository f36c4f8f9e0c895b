"""Personal data: patterns propose, checksums confirm, context words adjust (operator 8).

The base spans are taken by fixed rules.  Beyond them the method proposes
international account numbers (confirmed by mod 97), national telephone numbers
without a country code, international ones that other digits follow, social
security numbers, IPv6 and MAC addresses, and
access tokens (confirmed by their mix of characters); each has a prior score
that confirmation and context words around it raise or lower, and is kept from
THRESHOLD on; words inside of base spans, such as an address's, are no context.  All of it is linear in the text: patterns begin at the edge of a
run of their characters and don't give back what they took.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "national_phone", "ssn", "ipv6", "mac", "secret", "international_phone")
BASE = 4
THRESHOLD = 0.6
CONTEXT = 40

# The base patterns, and the proposals of the method with their prior scores.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_AFTER = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PROPOSED = {
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0.3),
    "national_phone": (re.compile(r"(?<![\w+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])"), 0.4),
    "international_phone": (re.compile(r"(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"), 0.7),
    "ssn": (re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])"), 0.4),
    "ipv6": (re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])"), 0.8),
    "mac": (re.compile(r"(?<![\w:-])(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}(?![\w:-])"), 0.7),
    "secret": (re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,128}+(?![A-Za-z0-9_-])"), 0.3),
}
RAISES = {
    "iban": ("iban", "account", "konto", "bank", "transfer", "compte", "cuenta", "payment"),
    "national_phone": ("phone", "tel", "call", "mobile", "cell", "fax", "contact", "whatsapp", "telefon", "teléfono", "téléphone"),
    "international_phone": ("phone", "tel", "call", "mobile", "cell", "fax", "contact", "whatsapp", "telefon", "teléfono", "téléphone"),
    "ssn": ("ssn", "social", "security", "tax", "taxpayer", "identity"),
    "ipv6": ("ip", "address", "host", "server", "ipv6"),
    "mac": ("mac", "device", "address", "hardware"),
    "secret": ("token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "credentials"),
}
LOWERS = ("order", "invoice", "version", "isbn", "issn", "part", "sku", "serial", "example", "page", "article", "item", "ref")


class Span(NamedTuple):
    start: int
    kind: str
    end: int


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += 2 * int(d) - 9 * (int(d) > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of international account numbers: letters are 10 to 35, the first four characters go last."""
    text = re.sub(r"[ -]", "", account)
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def random_looking(token: str) -> bool:
    """Whether letters and digits are mixed as in a generated token: both, ten different characters or more, several changes between the two."""
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    return any(c.isalpha() for c in token) and len(set(token)) >= 10 and changes >= 5


def emails(text: str) -> list[Span]:
    """Leftmost matches: the local part is the run before an @, back to the last match at most."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in EMAIL_LOCAL:
            begin -= 1
        m = EMAIL_AFTER.match(text, at + 1) if begin < at else None
        if m:
            out.append(Span(begin, "email", m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x) < 4 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            out.append(Span(m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40 and 14 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(d):
            out.append(Span(m.start(), "card", m.end()))
    if "+" in text:
        out += [Span(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def added_spans(text: str, base: list[Span], threshold: float = THRESHOLD) -> list[Span]:
    """What the method adds where no base span lies: prior, checksum and context words make the score."""
    out: list[Span] = []
    taken: list[list[int]] = []  # stretches of the base spans, apart from each other
    for b in base:
        if taken and b.start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b.end)
        else:
            taken.append([b.start, b.end])
    begins = [x[0] for x in taken]
    around = text  # what context words are read from
    if taken:
        ends = [0, *(x[1] for x in taken)]
        around = "".join(text[a:b] + " " * (x[1] - b) for a, b, x in zip(ends, begins, taken)) + text[ends[-1] :]
    for kind, (pattern, prior) in PROPOSED.items():
        for m in pattern.finditer(text):
            before = bisect_right(begins, m.end() - 1)
            if before and taken[before - 1][1] > m.start() or kind == "secret" and not random_looking(m[0]):
                continue
            score = prior
            if kind == "iban":
                if not mod97(m[0]):
                    continue
                score += 0.6
            words = re.findall(r"[^\W\d_]+", around[max(0, m.start() - CONTEXT) : m.start()].lower() + " " + around[m.end() : m.end() + CONTEXT].lower())
            score += 0.35 * any(w in RAISES[kind] for w in words) - 0.3 * any(w in LOWERS for w in words)
            if score >= threshold:
                out.append(Span(m.start(), kind, m.end()))
    return out


_any = re.compile(r"[0-9@]|[0-9a-fA-F]:")


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by start and then kind; positions are code points."""
    if not _any.search(text):
        return [], []
    order = KINDS.index
    base = sorted(base_spans(text), key=lambda s: (s.start, order(s.kind)))
    return base, sorted(base + added_spans(text, base), key=lambda s: (s.start, order(s.kind)))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans (kind:start:end, end exclusive) of every text.

    Null and empty texts have no spans; repeated rows are searched each; other
    columns are ignored; an empty table gives no rows.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in range(BASE)]
            digests, texts = [], []
            for t in b.column(1):
                base, all_ = spans_of(t.as_py())
                for k in range(BASE):
                    counts[k].append(sum(s.kind == KINDS[k] for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                texts.append(listed(all_))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap the first."""
    if not text:
        return text
    out, at = [], 0
    for s in spans_of(text)[1]:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
            at = s.end
    return "".join(out) + text[at:]
