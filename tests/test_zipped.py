"""Triples inside ZIP archives: ranges, deflated members, escapes, lines that are none."""

import zipfile

import pytest

from lotwise.sources import zipped

LINES = [
    ("<http://a/1> <http://p/name> \"Anna \\\"the\\\" \\u00c9\\U0001F600\\n\" .", ("http://a/1", "http://p/name", 'Anna "the" É😀\n', True, None)),
    ("<http://a/1> <http://p/knows> <http://a/2> .", ("http://a/1", "http://p/knows", "http://a/2", False, None)),
    ('_:b1 <http://p/born> "1900"^^<http://t/year> . # remark', ("_:b1", "http://p/born", "1900", True, "http://t/year")),
    ('<http://a/2> <http://p/name> "nom"@fr-CA .\r', ("http://a/2", "http://p/name", "nom", True, "fr-CA")),
    ('<http://a/2> <http://p/note> "" .', ("http://a/2", "http://p/note", "", True, None)),
]
NONE = ["", "# remark", "<http://a> <http://b> .", '<http://a> <http://b> "open .', "junk"]
TEXT = "\n".join([line for line, _ in LINES] + NONE + [LINES[0][0]])
WANT = sorted(str(row) for _, row in [*LINES, LINES[0]])


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("kind", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_give_every_line_once(spark, tmp_path, kind, split):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", kind) as z:
        z.writestr("dir/one.nt", TEXT)
        z.writestr("two.nt", TEXT + "\n")
        z.writestr("empty.nt", "")
    if split > 1 or kind == zipfile.ZIP_DEFLATED:
        assert rows(zipped.read(spark, str(tmp_path / "a.zip"), split=split)) == sorted(WANT * 2)
    spans = zipped.spans_of(str(tmp_path), split)
    assert len(spans) == (2 if kind == zipfile.ZIP_DEFLATED else sum(-(-n // split) for n in (len(TEXT.encode()), len(TEXT.encode()) + 1)))
    reader = zipped.TripleReader(str(tmp_path), split, False)
    got = [tuple(r.values()) for s in spans for b in reader.read(s) for r in b.to_pylist()]
    assert sorted(map(str, got)) == sorted(WANT * 2)


def test_lines_longer_than_what_is_read_at_once(tmp_path, monkeypatch):
    monkeypatch.setattr(zipped, "PIECE", 5)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.nt", TEXT)
    reader = zipped.TripleReader(f"file://{tmp_path}", 11, False)
    assert sorted(str(tuple(r.values())) for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()) == WANT


def test_strict_reading_and_missing_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.nt", TEXT)
    with pytest.raises(Exception, match="not a triple"):
        zipped.read(spark, str(tmp_path), strict=True).count()
    with pytest.raises(Exception, match="gone"):
        zipped.read(spark, str(tmp_path / "gone")).count()


@pytest.mark.parametrize("stored", [True, False])
def test_round_trip_over_several_archives(spark, tmp_path, stored):
    said = [(f"http://a/{i}", "http://p/x", text, True, tag) for i, text in enumerate(["", 'q"\\\\n', "line\nend\r", "é😀\t", "\\u0041"]) for tag in (None, "en", "http://t/y")] + [("_:b", "http://p/y", "_:c", False, None)]
    df = spark.createDataFrame(said, zipped.SCHEMA).repartition(3)
    path = str(tmp_path / "out")
    zipped.write(df, path, split=40, stored=stored)
    (tmp_path / "out" / "part-lost.zip").write_bytes(b"of a task that never finished")
    assert rows(zipped.read(spark, path, split=25, strict=True)) == sorted(str(r) for r in said)
    zipped.write(df.limit(0), str(tmp_path / "none"))
    assert zipped.read(spark, str(tmp_path / "none")).count() == 0
