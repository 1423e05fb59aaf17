"""Patterns of catalogue wording and what is read with them; all are common to Java's and RE2's expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.text import spaced, title_key

#: A bracket at the end that holds a catalogue's name and a number.
CITED = r"\s*\(([A-Za-z][A-Za-z .&-]*?)\s+(\d+[a-z]*)\)\s*$"
#: Pieces of a title: a bracket, or text up to the next comma, semicolon or bracket; a piece keeps the comma before it.
PIECE = r"[,;]?(?:\s*\([^()]*\)|\s*\[[^\[\]]*\]|[^,;()\[\]]+)|[,;()\[\]]"
#: What the key of a piece is if it is a year, a catalogue's name and a number, or a series.
KEY_YEAR = "^(?:c |ca |circa )?(?:1[5-9]|20)[0-9]{2}$"
KEY_ENTRY = "^[a-z][a-z ]* [0-9]+[a-z]*$"
KEY_SERIES = "^(?:from|plate|portfolio) .+$"
#: Single words: a year with or without "c.", a word that says about, a number before a title, a number of a catalogue.
WORD_YEAR, WORD_ABOUT = "^(?:c[.]|ca[.])?(?:1[5-9]|20)[0-9]{2}[.]?$", "^(?:c|c[.]|ca|ca[.]|circa)$"
WORD_NUMBER = "^(?:[0-9]{1,3}[.)]|[a-z]{0,2}[0-9]+[.-][0-9]+[a-z]?[.]?)$"
#: Articles of catalogue languages, the elided one too.
ARTICLES = ("the", "a", "an", "le", "la", "les", "l", "un", "une", "il", "lo", "gli", "el", "los", "las", "der", "die", "das")
ARTICLE = "^(?:" + "|".join(ARTICLES) + ") "
QUOTES = "[\"\u2018\u2019\u201c\u201d]"
MIXED = r"^\s*(?:(\d+)\s+)?(\d+)\s*/\s*([1-9]\d*)\s*$"
ROMAN = r"^[IVXLCDM]+$"
#: Catalogue names, folded, and the name they go by.
PREFIXES = (("brand", "BR"), ("brandno", "BR"))
#: What lots of several works are called by, as phrases of a key, and whether a word has to follow; the first that fits.
SEVERAL = (
    ("a pair", ("a pair",), False), *((f"{n} works", (f"{n} works", f"{word} works"), False) for n, word in ((2, "two"), (3, "three"), (4, "four"))),
    ("a set of", ("a set of",), True), ("a group of", ("a group of",), True), ("together with", ("together with",), False), ("and another", ("and another",), False), ("portfolio of", ("portfolio of",), True),
    ("complete set", ("the complete set", "the complete portfolio", "the complete suite"), False),
)
LAST_BRACKET = r"\(([0-9]{1,2})\)\s*$"
CONDITION = (("fine", r"(?i)\bfine condition\b"), ("good", r"(?i)\bgood condition\b"), ("marked", r"(?i)\b(?:foxing|tear|stained)\b"))
DEFECTS = (("foxing", r"(?i)\bfox(?:ed|ing)\b"), ("staining", r"(?i)\bstain(?:ed|ing)?\b"), ("tear", r"(?i)\btears?\b"))
PAPERS = (("arches", r"(?i)\barches\b"), ("laid", r"(?i)\blaid\b"), ("wove", r"(?i)\bwove\b"))


def made_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is long to compute and is named several times in it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bare_title(c: Column, series: bool = False) -> Column:
    """A title without what catalogues hang on to it.

    It is cut into pieces.  Entries of catalogues go wherever they stand; from the end years, and series if asked for,
    go until a piece says something else.  Of what is left a year goes from the last words, a number from the first
    and, with ``series``, all from the word "from" on.  A piece that is all there is stays.
    """
    pieces = F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))
    entry = lambda p: F.ltrim(p).startswith("(") & title_key(p).rlike(KEY_ENTRY)

    def says(p: Column) -> Column:
        hung = lambda key: (key == "") | key.rlike(KEY_YEAR) | (F.ltrim(p).startswith("(") & key.rlike(KEY_ENTRY))
        return ~made_once(title_key(p), lambda key: hung(key) | key.rlike(KEY_SERIES) if series else hung(key))

    last = F.array_max(F.transform(pieces, lambda p, i: F.when(says(p), i + 1).otherwise(0)))
    left = F.array_join(F.filter(F.slice(pieces, F.lit(1), F.coalesce(last, F.lit(0))), lambda p: ~entry(p)), "")
    words = F.filter(F.split(left, r"\s+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        at = lambda i: F.lower(F.coalesce(F.try_element_at(w, F.lit(i)), F.lit("")))
        n = F.size(w)
        dated = at(-1).rlike(WORD_YEAR)
        end = n - F.when(dated & at(-2).rlike(WORD_ABOUT), 2).when(dated, 1).otherwise(0)
        start = F.when((n > 1) & at(1).rlike(WORD_NUMBER), 2).otherwise(1)
        if series:
            place = F.array_position(F.transform(w, lambda x: F.lower(x)), F.lit("from")).cast("int")
            end = F.when(place > start, F.least(end, place - 1)).otherwise(end)
        return F.array_join(F.slice(w, start, F.greatest(end - start + 1, F.lit(0))), " ")

    found = made_once(words, cut)
    return F.rtrim(F.regexp_replace(F.coalesce(F.nullif(found, F.lit("")), F.trim(c)), r"[\s,;:]+$", ""))


def bare_title_sql(c: str, key: str, series: bool = False) -> str:
    """The same for DuckDB; ``key`` is the SQL of a title key with a place for its argument."""
    pieces = f"regexp_extract_all({c}, '{PIECE}')"
    entry = lambda p: f"(starts_with(ltrim({p}), '(') AND regexp_matches({key.format(p)}, '{KEY_ENTRY}'))"
    hung = lambda p: f"({key.format(p)} = '' OR regexp_matches({key.format(p)}, '{KEY_YEAR}') OR {entry(p)}" + (f" OR regexp_matches({key.format(p)}, '{KEY_SERIES}'))" if series else ")")
    last = f"coalesce(list_max(list_transform({pieces}, lambda p, i: CASE WHEN {hung('p')} THEN 0 ELSE i END)), 0)"
    words = f"list_filter(regexp_split_to_array(array_to_string(list_filter(list_slice({pieces}, 1, {last}), lambda p: NOT {entry('p')}), ''), '\\s+'), lambda w: w <> '')"
    at = lambda i: f"lower(coalesce(w[{i}], ''))"
    start = f"(CASE WHEN len(w) > 1 AND regexp_matches({at(1)}, '{WORD_NUMBER}') THEN 2 ELSE 1 END)"
    end = f"(len(w) - CASE WHEN regexp_matches({at(-1)}, '{WORD_YEAR}') THEN CASE WHEN regexp_matches({at(-2)}, '{WORD_ABOUT}') THEN 2 ELSE 1 END ELSE 0 END)"
    if series:
        place = "coalesce(list_position(list_transform(w, lambda x: lower(x)), 'from'), 0)"
        end = f"(CASE WHEN {place} > {start} THEN least({end}, {place} - 1) ELSE {end} END)"
    cut = f"list_transform([{words}], lambda w: array_to_string(list_slice(w, {start}, {end}), ' '))[1]"
    return f"rtrim(regexp_replace(coalesce(nullif({cut}, ''), trim({c})), '[\\s,;:]+$', ''))"


def identity_key(c: Column) -> Column:
    return title_key(bare_title(c))


def without_article(key: Column) -> Column:
    """A title key without the article it begins with, unless nothing else is there."""
    return F.regexp_replace(key, ARTICLE, "")


def embedding_title(c: Column) -> Column:
    """A bare title without its series and quotation marks, in lower case, for an encoder."""
    return F.lower(spaced(F.regexp_replace(bare_title(c, series=True), QUOTES, "")))


def several_works(c: Column) -> Column:
    """By which wording a lot is said to hold several works; null if by none."""
    last = F.when(F.regexp_extract(c, LAST_BRACKET, 1).try_cast("int") >= 2, "trailing (n)")

    def named(key: Column) -> Column:
        out = last
        for name, phrases, more in reversed(SEVERAL):
            found = F.lit(False)
            for phrase in phrases:
                found = found | (key.rlike(f" {phrase} .") if more else key.contains(f" {phrase} "))
            out = F.when(found, name).otherwise(out)
        return out

    return made_once(F.concat(F.lit(" "), title_key(c), F.lit(" ")), named)


def several_works_sql(c: str, key: str) -> str:
    """The same for DuckDB."""
    def test(phrase: str, more: bool) -> str:
        return f"regexp_matches(k, ' {phrase} .')" if more else f"contains(k, ' {phrase} ')"

    tests = " ".join(f"WHEN {' OR '.join(test(p, more) for p in phrases)} THEN '{name}'" for name, phrases, more in SEVERAL)
    return f"list_transform([' ' || {key.format(c)} || ' '], lambda k: CASE {tests} WHEN TRY_CAST(nullif(regexp_extract({c}, '{LAST_BRACKET}', 1), '') AS INTEGER) >= 2 THEN 'trailing (n)' END)[1]"


def mixed_fraction(c: Column) -> Column:
    """ "12 3/8", "3/8" or "12.5" as a number."""
    part = lambda k: F.nullif(F.regexp_extract(c, MIXED, k), F.lit("")).cast("double")
    return F.when(c.rlike(MIXED), F.coalesce(part(1), F.lit(0.0)) + part(2) / part(3)).otherwise(c.try_cast("double"))


def roman(c: Column) -> Column:
    """A Roman numeral as an integer: a sign before a greater one counts down; null for anything else."""
    worth = F.create_map(*(F.lit(x) for kv in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in kv))
    signs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: worth[F.substr(c, i, F.lit(1))])
    total = F.aggregate(F.reverse(signs), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, v: F.struct((a["sum"] + F.when(v < a["last"], -v).otherwise(v)).alias("sum"), v.alias("last")), lambda a: a["sum"])
    return F.when(c.rlike(ROMAN), total)


def _object(text: str | None) -> str | None:
    start = (text or "").find("{")
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : i + 1]
        start = text.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def first_object(c: pd.Series) -> pd.Series:
    """The first balanced JSON object; braces within strings don't count."""
    return c.map(_object)
