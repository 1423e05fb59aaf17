"""Descriptions of catalogues, field by field."""

import pytest

from lotwise.functions import catalogue
from lotwise.functions.catalogue import Description

FIELDS = [f.split(" ")[0] for f in "work artist hand others nationality life title year medium support sizes edition edition_size signed inscriptions printer publisher entries framed provenance several leaks".split(" ")]


def read(text):
    return [dict(zip(FIELDS, r, strict=True)) for r in Description(text).rows()]


WHOLE = """<p>After Ana Maria Vel&#225;zquez OBE, Joan Smith,<br>Spanish/French, 1881 &ndash; 1973,<br/><br>
The Red Bridge [Mourlot 12; Baer 34a], c. 1968;<br>colour etching on BFK Rives wove,<br>signed and numbered '12/50' in pencil (there was an edition of 500),<br>
printed by Atelier Joan, Paris,<br>published by M&amp;N Editions,<br>image: 22 x 32cm, sheet: 300 x 400 mm,<br>(framed)<br>Provenance<br>Estate of Vel&aacute;zquez;<br>Private collection</p>"""


def test_a_whole_description():
    (got,) = read(WHOLE)
    assert got == {
        "work": 1, "artist": "Ana Maria Velázquez OBE", "hand": "after", "others": ["Joan Smith"], "nationality": "Spanish/French", "life": "1881–1973", "title": "The Red Bridge [Mourlot 12; Baer 34a]", "year": "c. 1968",
        "medium": "colour etching", "support": "BFK Rives wove", "sizes": [("image", 22.0, 32.0), ("sheet", 30.0, 40.0)], "edition": "signed and numbered '12/50' in pencil (there was an edition of 500)", "edition_size": 50, "signed": True,
        "inscriptions": "signed and numbered '12/50' in pencil (there was an edition of 500)", "printer": "Atelier Joan, Paris", "publisher": "M&N Editions", "entries": ["Mourlot 12", "Baer 34a"], "framed": True, "provenance": "Estate of Velázquez; Private collection", "several": None,
        "leaks": got["leaks"],
    }
    assert {"surname Velázquez", "forename Joan", "entry Baer 34a", "printer Atelier Joan, Paris", "publisher M&N Editions", "provenance names a seat"} <= set(got["leaks"])


def test_several_works_are_several_rows():
    got = read("Jo Smith<br>British b.1965<br>Two works:<br>(i) Kiss, 1960;<br>etching,<br>edition of 20<br>(ii) Ring;<br>lithograph on wove,<br>unsigned<br>Provenance<br>the artist")
    assert [(r["work"], r["artist"], r["title"], r["year"], r["medium"], r["support"], r["edition_size"], r["several"], r["life"]) for r in got] == [(1, "Jo Smith", "Kiss", "1960", "etching", None, 20, "2 works", "b.1965"), (2, "Jo Smith", "Ring", None, "lithograph", "wove", None, "2 works", "b.1965")]
    assert not got[1]["signed"] and got[1]["provenance"] == "the artist"


@pytest.mark.parametrize(("line", "hand", "artist"), [("Jo Smith,", "certain", "Jo Smith"), ("Attributed to Jo Smith", "attributed", "Jo Smith"), ("CIRCLE OF Jo Smith", "circle", "Jo Smith"), ("Studio of Jo", "studio", "Jo"), ("Follower of Jo", "follower", "Jo"), ("Manner of Jo", "manner", "Jo"), ("Jo Smith, after", "after", "Jo Smith"), ("Jo Rafter", "certain", "Jo Rafter")])
def test_hands(line, hand, artist):
    (got,) = read(line)
    assert (got["hand"], got["artist"], got["title"]) == (hand, artist, None)


@pytest.mark.parametrize(
    ("text", "field", "want"),
    [
        ("A<br>Kiss 1920<br>etching", "title", "Kiss 1920"), ("A<br>Kiss 1920<br>etching", "year", "1920"), ("A<br>British, 1900<br>Kiss<br>etching", "title", "Kiss"), ("A<br>Kiss, 1960-65;<br>x", "year", "1960-65"), ("A<br>Provenance<br>x", "provenance", "x"), ("A<br>Kiss;<br>x<br>an artist's proof,", "edition", "an artist's proof"),
        ("A<br>Kiss;<br>x<br>one of 30,", "edition_size", 30), ("A<br>Kiss;<br>25 x 30 in", "sizes", [("unknown", 63.5, 76.2)]), ("A<br>Kiss;<br>x<br>stamped verso,<br>dated 1960", "inscriptions", "stamped verso; dated 1960"), ("A<br>Kiss;<br>x<br>views (12)", "several", "trailing (n)"), ("A<br>Kiss;<br>unsigned", "signed", False),
        ("A<br>Kiss;<br>x<br>Provenance<br>Galerie Z", "leaks", ["provenance names a seat"]), ("Laurence Lowry RBA RA<br>Kiss;<br>by Lowry", "leaks", ["surname Lowry"]), ("A<br>Kiss (state);<br>x", "entries", []), ("A<br>&#8220;Kiss&#x201D; &amp;amp;;<br>x", "title", "“Kiss” &amp"),
    ],
)
def test_fields(text, field, want):
    assert read(text)[0][field] == want


def test_blank_descriptions_and_the_table_function(spark):
    rows = spark.createDataFrame([(1, WHOLE), (2, None), (3, "  <br> "), (4, "Jo<br>Kiss;<br>x<br>Ring;<br>y"), (5, "a\n" * 20_000)], "lot int, body string")
    catalogue.register(spark)
    rows.createOrReplaceTempView("described_lots")
    got = spark.sql("SELECT lot, w.* FROM described_lots, LATERAL catalogue_works(body) w").collect()
    assert sorted((r.lot, r.work, r.title) for r in got if r.lot < 5) == [(1, 1, "The Red Bridge [Mourlot 12; Baer 34a]"), (4, 1, "Kiss"), (4, 2, "Ring")]
    assert sum(r.lot == 5 for r in got) == 1 and not any(r.lot in (2,) for r in got)
