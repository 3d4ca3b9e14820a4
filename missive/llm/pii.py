"""Personal data with offset-preserving deobfuscation.

The plain detectors run on the text as it is. Where a text shows signs of
disguise, transducers rewrite it piece by piece and note for each piece where it
stood: homoglyphs become the ASCII characters that they imitate, characters without
width go, letters that stand for digits and runs of spelled digits become digits,
and "[at]" or "name at host dot net" becomes "@" and ".". The same detectors run on
the rewritten text; a span found there is mapped back to the source characters of
its pieces and added if it is clear of the plain spans or holds more than those that
it overlaps. Plain spans always stay.

Spans count code points, ends exclusive. Null text is empty and has none.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can begin at the start of a run of digits only, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """Whether digits without leading zeros are 255 at most."""
    return len(digits) <= 3 and int(digits or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, found from each "@":
    the local part is the whole run of its characters before it, as no match can
    begin to the left of that run or run past another "@"."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            out.append((start, free))
        at = text.find("@", max(at + 1, free))
    return out


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain detectors' spans, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(p.lstrip("0")) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


# ------------------------------------------------------------- transducers

#: Letters of other scripts that look like ASCII letters: fixed values.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ⅼ": "l", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "−": "-",
}


@cache
def _homoglyphs() -> dict[int, str]:
    """Lookalikes, decimal digits of every script, other spaces, and compatibility
    forms of ASCII characters (full-width, mathematical, circled ...)."""
    out = {ord(k): v for k, v in _LOOKALIKES.items()}
    for point in (*range(0xA0, 0x3100), *range(0xFE50, 0xFFF0), *range(0x1D400, 0x1D800)):
        char = chr(point)
        if unicodedata.category(char) == "Nd":
            out.setdefault(point, str(unicodedata.digit(char)))
        elif unicodedata.category(char) == "Zs":
            out.setdefault(point, " ")
        else:
            simple = unicodedata.normalize("NFKD", char)
            if len(simple) == 1 and "!" <= simple <= "~" and simple != char:
                out.setdefault(point, simple)
    return out


#: Characters that take no room: soft hyphen, joiners, direction marks, byte order mark.
_WIDTHLESS = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]+")


@cache
def _imitators() -> np.ndarray:
    """1 for homoglyphs, 2 for characters without width, by code point."""
    out = np.zeros(max(0xFEFF, *_homoglyphs()) + 2, np.uint8)
    out[list(_homoglyphs())] = 1
    out[[p for p in range(0xAD, 0xFF00) if _WIDTHLESS.match(chr(p))]] = 2
    return out


def _imitates(text: str) -> tuple[bool, bool]:
    """Whether a text has homoglyphs, and characters without width."""
    if text.isascii():
        return False, False
    table = _imitators()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = table[np.minimum(points, len(table) - 1)]
    return bool((found == 1).any()), bool((found == 2).any())


#: Spelled digits in the languages of the corpus: fixed values.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
#: Three spelled digits or more in a row; digits in figures may stand among them.
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s-]+)?(?:{_WORD})(?:[\s,.-]{{1,2}}(?:{_WORD}|[0-9]+|point|dot)(?!\w)){{2,}}", re.I)
_PART = re.compile(rf"(?P<word>{_WORD})(?!\w)|(?P<figure>[0-9]+)|(?P<plus>plus)|(?P<dot>point|dot)|(?P<gap>[\s,.-]+)", re.I)
#: A bracketed "at" or "dot" is a disguise wherever it stands between names.
_BRACKETED = re.compile(r"(?:(?<!\s)\s+)?[\[({<]\s*(at|@|dot|\.|point|punkt|punto|arobase)\s*[\])}>]\s*", re.I)
#: A bare "at" is one only as in: name at host dot net.
_BARE = re.compile(r"(?<![\w.%+-])([A-Za-z0-9._%+-]+(?:\s+dot\s+[A-Za-z0-9_%+-]+){0,9})(\s+at\s+|\s*@\s*)([A-Za-z0-9-]+)((?:\s+dot\s+[A-Za-z0-9-]+)+)(?![\w-])", re.I)
_BARE_DOT = re.compile(r"\s+dot\s+", re.I)
#: With real dots in the host, the name must look like one: a digit or a mark in it.
_SPACED = re.compile(r"(?<![\w.%+-])(?=[A-Za-z_%+-]*[0-9._%+])[A-Za-z0-9._%+-]*[A-Za-z0-9](\s+at\s+)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@]))", re.I)
_PARTED = re.compile(r"(?<=[A-Za-z0-9])(\s+@\s*|@\s+)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@]))")
#: Letters among digits that stand for 0 and 1; most of the run must be figures.
_LETTERED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OoIl](?:[\x20.()-]{0,2}[0-9OoIl]){7,}(?![A-Za-z0-9])")
_STANDS_FOR = {"O": "0", "o": "0", "I": "1", "l": "1"}
_LETTERED_HINT = re.compile(r"[0-9][\x20.()-]{0,2}[OoIl]|[OoIl][\x20.()-]{0,2}[0-9]")
#: "@" with dots spaced or bracketed after it.
_SIGNS = re.compile(r"[\[({<]\s*(?:at|@|dot|\.|point|punkt|punto|arobase)\s*[\])}>]|\sdot\s", re.I)
_DIGIT_SET = frozenset(_DIGIT_WORDS)


class Rewritten:
    """A text made of pieces of a source: copied runs and replacements, each with its source span."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.text = "".join(p for p, _, _ in pieces)
        self.at, self.source = [], []
        n = 0
        for piece, a, b in pieces:
            if piece:
                self.at.append(n)
                self.source.append((a, b, len(piece)))
                n += len(piece)

    def _piece(self, i: int) -> tuple[int, int, int, int]:
        k = bisect_right(self.at, i) - 1
        return (self.at[k], *self.source[k])

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of [start, end): copied characters map one to one, a replacement to all that it replaced."""
        n, a, b, size = self._piece(start)
        first = a + start - n if b - a == size else a
        n, a, b, size = self._piece(end - 1)
        return first, a + end - n if b - a == size else b


def _replaced(text: str, edits: list[tuple[int, int, str]]) -> Rewritten:
    pieces, at = [], 0
    for a, b, new in sorted(edits):
        if a < at:
            continue
        pieces += [(text[at:a], at, a), (new, a, b)]
        at = b
    return Rewritten([*pieces, (text[at:], at, len(text))])


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED.finditer(text):
        at = run.start()
        while at < run.end() and (m := _PART.match(text, at, run.end())):
            kind = m.lastgroup
            new = {"word": lambda: _DIGIT_WORDS[m[0].lower()], "figure": lambda: m[0], "plus": lambda: "+", "dot": lambda: ".", "gap": lambda: ""}[kind]()  # noqa: B023
            edits.append((m.start(), m.end(), new))
            at = m.end()
    return edits


def _signs(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _BRACKETED.finditer(text):
        edits.append((m.start(), m.end(), "@" if m[1].lower() in ("at", "@", "arobase") else "."))
    for m in _BARE.finditer(text):
        edits.append((m.start(2), m.end(2), "@"))
        edits += [(d.start(), d.end(), ".") for k in (1, 4) for d in _BARE_DOT.finditer(text, m.start(k), m.end(k))]
    edits += [(m.start(1), m.end(1), "@") for r in (_SPACED, _PARTED) for m in r.finditer(text)]
    return edits


def _lettered(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _LETTERED.finditer(text):
        if 3 * len(_DIGIT.findall(run[0])) >= 2 * len(re.findall(r"[0-9OoIl]", run[0])):
            edits += [(run.start() + i, run.start() + i + 1, _STANDS_FOR[c]) for i, c in enumerate(run[0]) if c in _STANDS_FOR]
    return edits


def _widthless(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "") for m in _WIDTHLESS.finditer(text)]


def _hints(text: str) -> tuple[bool, bool, bool]:
    """Whether a text may hold lettered digits, spelled digits, and disguised signs;
    most texts hold none."""
    low = text.lower()
    loose = low
    for c in "-,.":
        loose = loose.replace(c, " ")
    spelled = not _DIGIT_SET.isdisjoint(loose.split())
    lettered = bool(_DIGIT.search(text) and _LETTERED_HINT.search(text))
    signs = ("dot" in low or any(c in low for c in "[({<") or " @" in low or "@ " in low) and bool(_SIGNS.search(text))
    return lettered, spelled, signs or " at " in low and "." in low and bool(_SPACED.search(text)) or " @" in low or "@ " in low


def disguised(text: str) -> list[tuple[int, int, int]]:
    """Spans of the rewritten text, by their source characters; plain ones among them."""
    imitated, widthless = _imitates(text)
    maps: list[Rewritten] = []
    changed = imitated
    if imitated:
        text = text.translate(_homoglyphs())  # one for one: offsets stay
    if widthless:
        maps.append(_replaced(text, _widthless(text)))
        text = maps[-1].text
    for hinted, transducer in zip(_hints(text), (_lettered, _spelled, _signs), strict=True):
        if hinted and (edits := transducer(text)):
            maps.append(_replaced(text, edits))
            text = maps[-1].text
    if not changed and not maps:
        return []
    out = []
    for start, kind, end in plain(text):
        for step in reversed(maps):
            start, end = step.back(start, end)
        out.append((start, kind, end))
    return out


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(plain spans, all spans), each (start, kind number, end) by start, then kind."""
    text = text or ""
    base = plain(text)
    # spans of one kind are in order and apart, and so are the added ones
    kinds = [[(a, b) for a, kind, b in base if kind == k] for k in range(len(KINDS))]
    taken: list[tuple[int, int]] = []
    added: list[tuple[int, int, int]] = []
    for start, kind, end in sorted(disguised(text), key=lambda s: (s[0] - s[2], s)):
        over = [span for own in kinds for span in _meeting(own, start, end)]
        if all(start <= a and b <= end and (start, end) != (a, b) for a, b in over) and not _meeting(taken, start, end):
            added.append((start, kind, end))
            insort(taken, (start, end))
    return base, sorted(base + added) if added else base


def _meeting(apart: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Those of spans in order and apart that overlap [start, end)."""
    first = bisect_right(apart, start, key=lambda s: s[1])
    return apart[first : bisect_left(apart, end, key=lambda s: s[0])]


def _listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [spans(t) for t in batch.column("text").to_pylist()]
        counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
        base = [hashlib.sha256(_listed(b).encode()).hexdigest() for b, _ in found]
        columns = [batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([_listed(a) for _, a in found], pa.string()), pa.array([len(a) - len(b) for b, a in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): n_email, n_ip, n_card, n_phone
    (plain spans), base_sha256 (of the list of plain spans), spans (all spans as
    kind:start:end) and n_added (spans that deobfuscation added). Null and empty
    texts have no spans; repeated rows are searched each."""
    common.prepare(docs.sparkSession)
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, ddl)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for start, kind, end in spans(text)[1]:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
            at = end
    return "".join([*out, text[at:]])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
