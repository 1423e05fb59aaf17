"""Text of catalogues: folding, titles, citations, editions, dimensions, media and addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what they fold to, one for one.
FOLD_FROM = "àáâãäåāçćčèéêëēęìíîïīñńòóôõöøōùúûüūýÿðđłšśžźżřť"
FOLD_TO = "aaaaaaaccceeeeeeiiiiinnooooooouuuuuyyddlsszzzrt"
#: Letters that fold to two.
FOLD_PAIRS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"))
#: Combining marks, which fold to nothing.
MARKS = "[\u0300-\u036f]"


def fold(c: Column) -> Column:
    """Lower case without accents, composed or not."""
    return F.regexp_replace(reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), FOLD_PAIRS, F.translate(F.lower(c), FOLD_FROM, FOLD_TO)), MARKS, "")


def fold_sql(c: str) -> str:
    """The same for DuckDB, from the same table."""
    found = f"translate(lower({c}), '{FOLD_FROM}', '{FOLD_TO}')"
    for a, b in FOLD_PAIRS:
        found = f"replace({found}, '{a}', '{b}')"
    return f"regexp_replace({found}, '{MARKS}', '', 'g')"


def spaced(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_key(c: Column) -> Column:
    """Folded letters and digits, all else as single blanks."""
    return spaced(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Distinct words of a title key, sorted."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(title_key(c), " "), "")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets of words; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column, least: int = 2) -> Column:
    """Share of the smaller set's words in the other; 0 if that set has fewer than ``least``."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small < least, 0.0).otherwise(F.size(F.array_intersect(a, b)) / small)


def first_match(c: Column, classes: list[tuple[str, str]], other: str | None = None) -> Column:
    """Name of the first pattern that matches."""
    out = F.lit(other).cast("string")
    for name, pattern in reversed(classes):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def all_matches(c: Column, classes: list[tuple[str, str]]) -> Column:
    """Names of all patterns that match, sorted."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c.rlike(p), n) for n, p in classes))))


def number(c: Column) -> Column:
    """Digits with thousands separators as an integer, null if none."""
    return F.when(c != "", F.replace(c, F.lit(","), F.lit("")).try_cast("int"))


_COUNT = "([0-9]+(?:,[0-9]{3})*)"
#: A copy's number over the edition: the quotation mark before it, the edition, and a unit or inch mark after it, which makes it a measure.
NUMBERED = "(?i)\\b(?:numbered|no[.])(?:\\s*in pencil)?\\s*([\"'\u2018\u2019\u201c\u201d]?)[0-9]+\\s*/\\s*" + _COUNT + "\\s*(mm\\b|cm\\b|[\"\u201d]?)"
#: Other forms, the surer first.
EDITION_FORMS = (r"(?i)\bedition\s+of\s+" + _COUNT, r"(?i)\bone\s+of\s+" + _COUNT)


def edition_size(c: Column) -> Column:
    """From "numbered n/N", else "edition of N", else "one of N".

    "n/N" alone is most often a fraction of an inch and is no edition, nor is one with a unit or an inch mark after it,
    unless that closes a quotation.
    """
    tail, opened = F.regexp_extract(c, NUMBERED, 3), F.regexp_extract(c, NUMBERED, 1) != ""
    copy = (tail == "") | (opened & (F.length(tail) == 1))
    return F.coalesce(F.when(copy, number(F.regexp_extract(c, NUMBERED, 2))), *(number(F.regexp_extract(c, p, 1)) for p in EDITION_FORMS))


def edition_size_sql(c: str) -> str:
    """The same for DuckDB."""
    part = lambda p, k: f"regexp_extract({c}, '{p.replace(chr(39), chr(39) * 2)}', {k})"
    count = lambda p, k: f"CAST(replace(nullif({part(p, k)}, ''), ',', '') AS INTEGER)"
    copy = f"({part(NUMBERED, 3)} = '' OR ({part(NUMBERED, 1)} <> '' AND length({part(NUMBERED, 3)}) = 1))"
    return f"coalesce(CASE WHEN {copy} THEN {count(NUMBERED, 2)} END, {', '.join(count(p, 1) for p in EDITION_FORMS)})"


def dimensions(c: Column) -> Column:
    """(width, height) in cm of "W x H unit"; null outside 1 to 400 cm."""
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*(mm|cm|in)\b"
    unit = F.lower(F.regexp_extract(c, pattern, 3))
    times = F.when(unit == "mm", 0.1).when(unit == "in", 2.54).when(unit == "cm", 1.0)
    side = lambda k: F.round(F.regexp_extract(c, pattern, k).try_cast("double") * times, 2)
    fits = side(1).between(1, 400) & side(2).between(1, 400)
    return F.when(fits, F.struct(side(1).alias("width"), side(2).alias("height")))


def year_range(c: Column) -> Column:
    """(first, last, precision) of a dated phrase: a range, a decade, about a year (five years either way) or a year."""
    span = r"\b(1[4-9]\d\d|20\d\d)\s*[-–]\s*(1[4-9]\d\d|20\d\d|\d\d)\b"
    lo, hi = F.regexp_extract(c, span, 1), F.regexp_extract(c, span, 2)
    hi = F.when(F.length(hi) == 2, F.concat(F.substring(lo, 1, 2), hi)).otherwise(hi)
    decade = F.regexp_extract(c, r"\b(1[4-9]\d|20\d)0s\b", 1)
    about = F.regexp_extract(c, r"(?i)\b(?:c\.|ca\.?|circa)\s*(1[4-9]\d\d|20\d\d)\b", 1)
    plain = F.regexp_extract(c, r"\b(1[4-9]\d\d|20\d\d)\b", 1)
    years = lambda a, b, p: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"), F.lit(p).alias("precision"))
    return (
        F.when(lo != "", years(lo, hi, "range")).when(decade != "", years(F.concat(decade, F.lit("0")), F.concat(decade, F.lit("9")), "decade"))
        .when(about != "", years(about.try_cast("int") - 5, about.try_cast("int") + 5, "circa")).when(plain != "", years(plain, plain, "year"))
    )


def person_key(c: Column) -> Column:
    """A name's words, "Surname, First" turned round, titles and life dates left out, sorted."""
    turned = F.regexp_replace(c, r"^([^,]+),\s*(.+)$", "$2 $1")
    bare = F.regexp_replace(turned, r"\([^)]*\)|\b\d{4}\b", " ")
    honours = F.array(*(F.lit(w) for w in ("sir", "dame", "lord", "lady", "dr", "prof")))
    return F.array_join(F.array_sort(F.array_except(F.array_remove(F.split(title_key(bare), " "), ""), honours)), " ")


def url_key(c: Column) -> Column:
    """Host without www and path without a final slash, lower case; query and fragment don't count."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"[?#].*$", ""), r"^[a-z]+://(www\.)?", "")
    return F.regexp_replace(bare, "/$", "")


def without_tags(c: Column) -> Column:
    """HTML as text: scripts and styles out, tags as blanks, the named entities decoded, the ampersand last."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return spaced(bare)


def citations(c: Column) -> Column:
    """(prefix, number) pairs of a bracketed list such as "(Bloch 12; Baer 34a)"; one item out of form voids the list."""
    inside = F.regexp_extract(c, r"\(([^()]*\d[^()]*)\)\s*$", 1)
    items = F.transform(F.split(inside, r"\s*;\s*"), lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z .&-]*?)\s+(\d+[a-z]*)$", 1)).alias("prefix"), F.regexp_extract(x, r"^([A-Za-z][A-Za-z .&-]*?)\s+(\d+[a-z]*)$", 2).alias("number")))
    return F.when((inside != "") & F.forall(items, lambda i: i["number"] != ""), items)
