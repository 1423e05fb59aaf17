"""Catalogue descriptions read line by line: a table function that yields a row for each work of a lot.

A description goes through states: who made it, that person's life, titles (a line that ends with a semicolon), the body
of the last title, and where the lot has been.  Each line is handed to the state in force, which keeps it, passes it on
or gives way to the next state; what a line doesn't say stays null.
"""

from __future__ import annotations

import gc
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from lotwise.functions.parse import LAST_BRACKET, SEVERAL
from lotwise.functions.text import EDITION_FORMS, NUMBERED

#: How the hand that made a work is qualified, by the words that say so.
HANDS = (("attributed to", "attributed"), ("circle of", "circle"), ("studio of", "studio"), ("follower of", "follower"), ("manner of", "manner"), ("after", "after"))
#: Letters after a name that are no part of it.
HONOURS = {"ra", "rba", "rsa", "rws", "obe", "cbe", "mbe", "kbe", "arca", "pra"}
SEATS = ("gallery", "galerie", "collection of", "estate of")
MARKS = ("signed", "inscribed", "numbered", "stamped", "monogram", "dated")
EDITION_WORDS = ("edition", "proof", "a/p", "h.c.", "hc", "hors commerce", "épreuve")
SCHEMA = (
    "work int, artist string, hand string, others array<string>, nationality string, life string, title string, year string, medium string, support string, sizes array<struct<kind string, width double, height double>>, "
    "edition string, edition_size int, signed boolean, inscriptions string, printer string, publisher string, entries array<string>, framed boolean, provenance string, several string, leaks array<string>"
)

_BREAK, _TAG = re.compile(r"<br\s*/?>|</p>", re.I), re.compile(r"<[^>]*>")
#: Where somebody is from and two years, or one after "b." or a comma; "Bridge 1920" may be a title.
_LIFE = re.compile(r"^([^\W\d][^\d,]*?)(?:,?\s+(b\.?\s*\d{4}|\d{4}\s*[-–]\s*\d{4})|,\s*(\d{4}))(?!\d)")
_DATED = re.compile(r",\s*((?:c\.?\s*|circa\s+)?\d{4}(?:\s*[-–]\s*\d{2,4})?)$")
_YEAR = re.compile(r"\b(?:1[5-9]|20)\d{2}\b")
_NUMBERED_WORK = re.compile(r"^(?:\(?[ivx]+\)|\(?[a-z0-9]\))\s+", re.I)
_SIZE = re.compile(r"(?:\b(image|plate|sheet|overall|framed?)\s*:?\s*)?(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*(mm|cm|in)\b", re.I)
_ENTRY = re.compile(r"^([^\W\d][^\d;()\[\]]*?)\s+(\d+[a-z]*)$", re.I)
_BRACKETS = re.compile(r"[\[(]([^()\[\]]*)[\])]")
_COPY, _EDITIONS = re.compile(NUMBERED), tuple(map(re.compile, EDITION_FORMS))
_WORD, _NAME, _ON = re.compile(r"[^\W_]+"), re.compile(r"[^\W\d_]+"), re.compile(r"\s+on\s+", re.I)
_CM = {"mm": 0.1, "cm": 1.0, "in": 2.54}


def lines_of(text: str) -> list[Line]:
    """Lines of a description, tags out and entities decoded, named or numeric, white space as single blanks."""
    return [x for line in _BREAK.sub("\n", text).split("\n") if (x := _line(line))]


def _has(text: str, *phrases: str) -> bool:
    """Whether a phrase stands in a text as whole words; most that don't aren't there at all, which is told at less cost."""
    low = text.lower()
    for p in phrases:
        if p.lower() in low and _whole(p).search(text):
            return True
    return False


@lru_cache(4_096)
def _whole(phrase: str) -> re.Pattern:
    return re.compile(rf"(?<!\w){re.escape(phrase)}(?!\w)", re.I)


#: Lines come back lot after lot, so what is told of a line by itself is kept for those met last.
_LINES = 65_536


def _trimmed(line: str) -> str:
    return line.rstrip(" ,;")


#: Words that the forms of an edition begin with, and of each wording for several works its longest: no text has one without it.
_FORMS = tuple(re.compile(rf"(?i)\b(?:{w})") for w in (r"numbered|no[.]", "edition", "one"))
_MARKING = {max(p.split(), key=len) for _, phrases, _ in SEVERAL for p in phrases}


#: What a line may say, as bits; a bit from ``FORM`` on for each form of an edition's number that it may hold.
SEVERAL_WORD, TRAILING, FRAMED, BRACKET, SIGNED, MARKED, EDITION, FORM = (1 << k for k in range(8))


@dataclass(slots=True)
class Line:
    """A line, and what it says by itself."""

    text: str
    low: str
    trimmed: str
    ends: bool
    provenance: bool
    flags: int
    sizes: tuple[tuple, ...]
    printer: str | None
    publisher: str | None


@lru_cache(_LINES)
def _line(raw: str) -> Line | None:
    text = " ".join(html.unescape(_TAG.sub("", raw)).split())
    if not text:
        return None
    low = text.lower()
    after = lambda opening: _trimmed(text[len(opening) :]).strip() if low.startswith(opening) else None
    trailing = text.endswith(")") and (m := re.search(LAST_BRACKET, text)) and int(m[1]) >= 2
    said = (not _MARKING.isdisjoint(_WORD.findall(low)), trailing, _has(text, "(framed)"), "(" in text or "[" in text, _has(text, "signed"), _has(text, *MARKS), _has(text, *EDITION_WORDS), *(p.search(text) for p in _FORMS))
    flags = sum(1 << k for k, x in enumerate(said) if x)
    return Line(text, low, _trimmed(text), text.endswith(";"), low.startswith("provenance"), flags, _sizes_of(text), after("printed by"), after("published by"))


def edition_of(told: str, flags: int) -> int | None:
    """The number of an edition, by its surest form; ``flags`` tell which forms' first words its lines have."""
    for k, pattern in enumerate((_COPY, *_EDITIONS)):
        if flags & (FORM << k) and (m := pattern.search(told)) and (k or not m[3] or (m[1] and len(m[3]) == 1)):
            return int(m[1 if k else 2].replace(",", ""))
    return None


def several_of(lines: list[Line], flags: int) -> str | None:
    """By which wording a description says that it has several works."""
    if flags & SEVERAL_WORD:
        key = f" {' '.join(w for x in lines for w in _WORD.findall(x.low))} "
        for name, phrases, more in SEVERAL:
            if any(f" {p} " in key and (not more or not key.endswith(f" {p} ")) for p in phrases):
                return name
    return "trailing (n)" if flags & TRAILING else None


def entries_of(text: str) -> list[str]:
    """Catalogue entries in brackets, several of them parted by semicolons."""
    items = (item.strip() for inside in _BRACKETS.findall(text) for item in inside.split(";"))
    return list(dict.fromkeys(f"{m[1]} {m[2]}" for item in items if (m := _ENTRY.match(item)) and m[1][0].isupper() and len(m[1].split()) <= 4))


def _sizes_of(line: str) -> tuple[tuple, ...]:
    return tuple(((m[1] or "unknown").lower(), round(float(m[2]) * _CM[m[4].lower()], 2), round(float(m[3]) * _CM[m[4].lower()], 2)) for m in _SIZE.finditer(line))


@lru_cache(_LINES)
def _maker(line: str) -> tuple[str | None, str, list[str], tuple[tuple[str, str, str], ...]]:
    """Who made a work, by what hand, who else, and the names that would tell it: how they are called, as they are and in small letters."""
    hand = "certain"
    for words, name in HANDS:
        if _has(line.lower(), words):
            hand = name
            line = re.sub(rf"(?<!\w){words}(?!\w)", "", line, count=1, flags=re.I)
            break
    names = [n for x in line.split(",") if (n := x.strip())]
    split = [[w for w in _NAME.findall(n) if w.lower() not in HONOURS] for n in names]
    told = [("surname", n[-1]) for n in split if n] + [("forename", w) for w in dict.fromkeys(w for n in split for w in n[:-1])]
    return names[0] if names else None, hand, names[1:], tuple((f"{kind} {w}", w, w.lower()) for kind, w in told if len(w) > 2)


@lru_cache(_LINES)
def _born(line: str) -> tuple[str, str] | None:
    m = _LIFE.match(line)
    return (m[1].strip(), "".join((m[2] or m[3]).split())) if m else None


@lru_cache(_LINES)
def _titled(line: str) -> tuple[str | None, str | None, list[str]]:
    """Title, year and entries of the line that a work begins with."""
    title, year = _NUMBERED_WORK.sub("", _trimmed(line)), None
    entries, dated = entries_of(title), _DATED.search(title)
    if dated:
        year, title = " ".join(dated[1].split()), title[: dated.start()]
    elif years := _YEAR.findall(title):
        year = years[0]
    return _trimmed(title) or None, year, entries


@lru_cache(_LINES)
def _parted(first: str) -> tuple[str | None, str | None]:
    """Medium and support."""
    medium, _, support = _ON.sub("\x00", first, count=1).partition("\x00")
    return medium or None, support or None


@lru_cache(_LINES)
def _seated(provenance: str) -> bool:
    return _has(provenance, *SEATS)


@dataclass(slots=True)
class Work:
    title: str | None = None
    year: str | None = None
    entries: list[str] = field(default_factory=list)
    body: list[Line] = field(default_factory=list)


class Description:
    """The states that lines go through."""

    def __init__(self, text: str):
        self.lines = lines_of(text)
        self.artist, self.hand, self.others, self.names, self.nationality, self.life = None, "certain", [], (), None, None
        self.works: list[Work] = []
        self.provenance: list[str] = []
        ends, self.flags = True in [x.ends for x in self.lines[1:]], 0  # a title ends with a semicolon, where any does
        state = self.maker
        for line in self.lines:
            self.flags |= line.flags
            state = state(line, ends)

    def maker(self, line: Line, ends: bool):
        self.artist, self.hand, self.others, self.names = _maker(line.text)
        return self.birth

    def birth(self, line: Line, ends: bool):
        if not line.ends and (born := _born(line.text)):
            self.nationality, self.life = born
            return self.before_title
        return self.before_title(line, ends)

    def before_title(self, line: Line, ends: bool):
        if line.provenance:
            return self.history
        if ends and not line.ends:
            return self.before_title  # a heading, such as "Two works"
        return self.begin(line)

    def begin(self, line: Line):
        self.works.append(Work(*_titled(line.text)))
        return self.body

    def body(self, line: Line, ends: bool):
        if line.provenance:
            return self.history
        if ends and line.ends:
            return self.begin(line)
        self.works[-1].body.append(line)
        return self.body

    def history(self, line: Line, ends: bool):
        self.provenance.append(line.text)
        return self.history

    def leaks(self, told: str, printer: str | None, publisher: str | None, entries: list[str], provenance: str | None) -> list[str]:
        """What in the body or provenance would tell who made the work."""
        shown = f"{told}\n{provenance or ''}"
        low = shown.lower()
        out = [said for said, name, small in self.names if small in low and _whole(name).search(shown)]
        out += [f"entry {e}" for e in entries] + ([f"printer {printer}"] if printer else []) + ([f"publisher {publisher}"] if publisher else [])
        return out + (["provenance names a seat"] if provenance and _seated(provenance) else [])

    def rows(self) -> Iterator[tuple]:
        provenance = " ".join(self.provenance) or None
        several, framed = several_of(self.lines, self.flags), self.flags & FRAMED > 0
        for number, work in enumerate(self.works or [Work()], 1):
            body = work.body
            medium, support = _parted(body[0].trimmed) if body and body[0].trimmed else (None, None)
            told, entries = "\n".join([x.text for x in body]), work.entries
            edition, printer, publisher, flags, sizes, marks = None, None, None, 0, [], []
            for x in body:
                said = x.flags
                flags |= said
                if x.sizes:
                    sizes += x.sizes
                if said & MARKED:
                    marks.append(x.trimmed)
                if said & EDITION and edition is None:
                    edition = x.trimmed
                if printer is None:
                    printer = x.printer
                if publisher is None:
                    publisher = x.publisher
            if flags & BRACKET:
                entries = list(dict.fromkeys([*entries, *entries_of(told)]))
            printer, publisher = printer or None, publisher or None
            yield (
                number, self.artist, self.hand, self.others, self.nationality, self.life, work.title, work.year, medium, support, sizes, edition, edition_of(told, flags), flags & SIGNED > 0,
                "; ".join(marks) or None, printer, publisher, entries, framed, provenance, several, self.leaks(told, printer, publisher, entries, provenance),
            )


class _Works:
    def eval(self, text: str | None) -> Iterator[tuple]:
        if text and (read := Description(text)).lines:
            yield from read.rows()


#: A row per work of a description, numbered from 1; none for a null or blank one.  Arrow would make a frame of every lot's few rows, which takes ten times as long.
catalogue_works = udtf(_Works, returnType=SCHEMA, useArrow=False)


def register(spark: SparkSession) -> None:
    """``catalogue_works(text)`` for SQL: ``SELECT .. FROM lots, LATERAL catalogue_works(body)``."""
    spark.udtf.register("catalogue_works", catalogue_works)


_ARROW = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def described(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The other columns of ``df`` with ``columns`` and ``width`` and ``height``, those of the first size, of every work that ``text`` describes: ``catalogue_works`` by batches of descriptions."""
    fields = T.StructType.fromDDL(SCHEMA).fields
    names = [f.name for f in fields]
    places, kinds, sizes = [names.index(c) for c in columns], [_ARROW[f.dataType.simpleString()] for c in columns for f in fields if f.name == c], names.index("sizes")
    kept = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Works().eval
        for b in batches:
            of, rows = [], []
            gc.disable()  # a batch's rows are many small lists without cycles
            for i, t in enumerate(b.column(text).to_pylist()):
                for r in read(t):
                    of.append(i)
                    rows.append(r)
            gc.enable()
            said = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            first = [s[0] if s else (None, None, None) for s in said[sizes]]
            at = pa.array(of, pa.int64())
            arrays = [*(b.column(f.name).take(at) for f in kept), *(pa.array(said[k], kind) for k, kind in zip(places, kinds, strict=True)), *(pa.array([s[k] for s in first], pa.float64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in kept), *columns, "width", "height"])

    told = [next(f for f in fields if f.name == c) for c in columns]
    return df.mapInArrow(run, T.StructType([*kept, *told, *(T.StructField(c, T.DoubleType()) for c in ("width", "height"))]))
