"""Operators on small tables with nulls, ties and empty inputs."""

import pytest
from pyspark.sql import functions as F

from lotwise.functions import numbers, strings, text
from lotwise.operators import changes, estimates, graph, joins, ranking
from lotwise.sources import tables
from lotwise.streaming import events as feeds


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, text_value, column):
    return spark.createDataFrame([(text_value,)], "c string").select(column(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("Édition  Crème, Nº 2", "edition creme n 2"), ("Straße", "strasse"), ("Łódź e\u0301tude č", "lodz etude c"), ("", ""), (None, None)])
def test_title_key(spark, given, want):
    assert one(spark, given, text.title_key) == want


@pytest.mark.parametrize(("given", "want"), [("from the edition of 1,500", 1500), ("numbered 12/75", 75), ("12/75", None), ("no. 7/40, aside from an unsigned edition of 300", 40), ("one of 30 proofs", 30), ("14 3/16 in", None), ("signed", None), (None, None)])
def test_edition_size(spark, given, want):
    assert one(spark, given, text.edition_size) == want


@pytest.mark.parametrize(("given", "want"), [("292 x 346 mm", (29.2, 34.6)), ("10x20in", (25.4, 50.8)), ("5000 x 2 cm", None), ("none", None)])
def test_dimensions(spark, given, want):
    got = one(spark, given, text.dimensions)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("given", "want"), [("1960-65", (1960, 1965, "range")), ("the 1950s", (1950, 1959, "decade")), ("circa 1900", (1895, 1905, "circa")), ("dated 1971", (1971, 1971, "year")), ("undated", None)])
def test_year_range(spark, given, want):
    got = one(spark, given, text.year_range)
    assert (tuple(got) if got else None) == want


def test_person_key_turns_names_round(spark):
    assert one(spark, "Hockney, David (b. 1937)", text.person_key) == one(spark, "Sir David Hockney", text.person_key) == "david hockney"


def test_citations_void_on_one_bad_item(spark):
    assert [tuple(x) for x in one(spark, "Title (Bloch 12; Baer 34a)", text.citations)] == [("bloch", "12"), ("baer", "34a")]
    assert one(spark, "Title (Bloch 12; see text 5 b)", text.citations) is None


def test_two_figures(spark):
    got = spark.createDataFrame([(1234.0,), (0.0,), (None,)], "v double").select(numbers.two_figures(F.col("v")), numbers.two_figures(F.col("v"), True)).collect()
    assert [tuple(r) for r in got] == [(1200.0, 1300.0), (None, None), (None, None)]


def test_edit_distances():
    assert strings.typo_distance("abc", "acb") == 1 and strings.typo_distance("", "ab") == 2 and strings.typo_distance("ca", "abc") == 3
    assert strings.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and strings.jaro_winkler("", "a") == 0


def test_asof_strict_and_not(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2), (None, 2)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 0, "y")], "k string, s int, v string")
    assert values(joins.asof(left, right, ["k"], "t", "s", ["v"])) == values(spark.createDataFrame([("a", 1, "y"), ("a", 2, "x"), ("a", 3, "x"), ("b", 2, None), (None, 2, None)], "k string, t int, v string"))
    assert ("a", 2, "y") in values(joins.asof(left, right, ["k"], "t", "s", ["v"], strict=True))
    assert values(joins.asof(left.limit(0), right, ["k"], "t", "s", ["v"])) == []


def test_cascade_fills_from_later_tiers(spark):
    own, near = (spark.createDataFrame(r, "g int, w int") for r in ([(1, 7)], [(1, 7), (1, 5), (1, 6), (2, 9)]))
    assert values(ranking.cascade([own, near], ["g"], ["w"], [F.col("w")], 2).select("g", "w", "tier")) == [(1, 5, 1), (1, 7, 0), (2, 9, 1)]


def test_upsert_keeps_values_that_later_rows_lack(spark):
    old = spark.createDataFrame([(1, 1, "a", "f"), (2, 1, "b", "g")], "k int, v int, x string, y string")
    new = spark.createDataFrame([(1, 2, None, "h"), (3, 2, "c", None)], "k int, v int, x string, y string")
    assert values(changes.upsert(old, new, ["k"], "v", ("y",)).select("k", "v", "x", "y")) == [(1, 2, "a", "f"), (2, 1, "b", "g"), (3, 2, "c", None)]


def test_survivors_follow_chains(spark):
    merges = spark.createDataFrame([(i, i + 1) for i in range(9)], "old int, survivor int")
    assert {r.survivor for r in changes.final_survivor(merges).collect()} == {9}


def test_components_of_a_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    got = {r.node: r.component for r in graph.least_reachable(chain).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == 30
    assert graph.least_reachable(chain.limit(0)).count() == 0


def test_auc_counts_ties_a_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "s double, y int")
    assert estimates.ranked_area(df, "s", "y").first().auc == pytest.approx(0.875)


def test_triples_and_rates(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<s> <p> <o> .\n<s> <q> "a \\"b\\""@en .\n# note\n')
    assert values(tables.triples(spark, str(tmp_path / "a.nt"))) == [("s", "p", "o", False), ("s", "q", 'a \\"b\\"', True)]
    (tmp_path / "r.json").write_text('{"2024-01-02": {"USD": 1.25, "EUR": 1.1}}')
    assert [(str(a), b, c) for a, b, c in values(tables.rates(spark, str(tmp_path / "r.json")))] == [("2024-01-02", "EUR", 1.1), ("2024-01-02", "USD", 1.25)]


def test_csv_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lot,price\n1,2.5\nx,3\n")
    good, bad = tables.csv(spark, str(tmp_path / "a.csv"), "lot int, price double")
    assert values(good) == [(1, 2.5)] and len(bad.collect()) == 1


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartitionByRange(3, "ts").write.mode("overwrite").parquet(path)
    return path


def finished(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_windows_equal_batch_once_closed(spark, arrivals):
    batch = feeds.windows(feeds.timed(spark.read.parquet(arrivals)), "1 day")
    got = finished(feeds.windows(feeds.feed(spark, arrivals, 3), "1 day"), "append", "tumbled")
    assert got.count() > 0 and got.join(batch, ["start", "end", "event_type", "n", "total"], "left_anti").count() == 0


def test_stream_state_equals_batch(spark, arrivals):
    got = finished(feeds.last_status(feeds.feed(spark, arrivals)), "update", "states")
    last = got.groupBy("user_id").agg(F.max_by("event_type", "n").alias("event_type"), F.max("n").alias("n"))
    want = spark.read.parquet(arrivals).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("n"))
    assert values(last) == values(want)


def test_incremental_load_goes_on_where_it_stopped(spark, arrivals, tmp_path):
    seen = []
    for _ in range(2):
        feeds.incremental(feeds.feed(spark, arrivals), str(tmp_path / "mark"), lambda df, _: seen.append(df.count()))
    assert sum(seen) == spark.read.parquet(arrivals).count()


@pytest.mark.parametrize(
    ("given", "bare", "without_series"),
    [
        ("4. THE KISS", "THE KISS", "THE KISS"), ("Kiss (Bloch 12), from the Blue Series", "Kiss , from the Blue Series", "Kiss"), ("Kiss, circa 1950", "Kiss", "Kiss"), ("Kiss [c. 1998]", "Kiss", "Kiss"), ("Kiss 1998", "Kiss", "Kiss"), ("1998", "1998", "1998"),
        ("l'Atelier (Baer 34a) rouge", "l'Atelier rouge", "l'Atelier rouge"), ("Letter from London", "Letter from London", "Letter"), ("from the Blue Series", "from the Blue Series", "from the Blue Series"), ("(Untitled)", "(Untitled)", "(Untitled)"), ("Kiss (state), (1961)", "Kiss (state)", "Kiss (state)"), ("", "", ""), (None, None, None),
    ],
)
def test_bare_title(spark, given, bare, without_series):
    import duckdb

    from lotwise.functions import parse
    from lotwise.plans.textual import KEYED

    assert (one(spark, given, parse.bare_title), one(spark, given, lambda c: parse.bare_title(c, series=True))) == (bare, without_series)
    sql = [parse.bare_title_sql("c", KEYED, series) for series in (False, True)]
    assert duckdb.execute(f"SELECT {', '.join(sql)} FROM (SELECT CAST(? AS VARCHAR) AS c)", [given]).fetchone() == (bare, without_series)


def test_titles_for_an_encoder_and_articles(spark):
    from lotwise.functions import parse

    assert one(spark, "“The Kiss”, plate 3, 1960", parse.embedding_title) == "the kiss"
    assert [one(spark, t, parse.without_article) for t in ("the kiss", "l atelier", "les", "lattice")] == ["kiss", "atelier", "les", "lattice"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("A pair of etchings", "a pair"), ("Two works, framed", "2 works"), ("3 works", "3 works"), ("Four  Works", "4 works"), ("a set of six", "a set of"), ("a set of", None), ("A group of prints", "a group of"), ("Kiss; together with a poster", "together with"),
        ("Kiss and another", "and another"), ("portfolio of ten", "portfolio of"), ("The complete suite", "complete set"), ("Views (12)", "trailing (n)"), ("Views (1)", None), ("Kiss", None), ("repair", None), (None, None),
    ],
)
def test_several_works(spark, given, want):
    import duckdb

    from lotwise.functions import parse
    from lotwise.plans.textual import KEYED

    assert one(spark, given, parse.several_works) == want
    assert duckdb.execute(f"SELECT {parse.several_works_sql('c', KEYED)} FROM (SELECT CAST(? AS VARCHAR) AS c)", [given]).fetchone()[0] == want


@pytest.mark.parametrize(("given", "want"), [("numbered '12/50' (also an unsigned edition of 500)", 50), ("no. 12/50 mm", None), ('numbered 3/8" wide, edition of 20', 20), ("numbered in pencil 3 / 1,200.", 1200), ("numbered 12/50 in pencil (there was an edition of 500)", 50), ("expedition of 12", None)])
def test_edition_size_by_context(spark, given, want):
    import duckdb

    assert one(spark, given, text.edition_size) == want
    assert duckdb.execute(f"SELECT {text.edition_size_sql('c')} FROM (SELECT ? AS c)", [given]).fetchone()[0] == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('{"artist": "A", "price": {"low": 1, "high": "x"}, "comparables": [1, 2.5]}', (1, "A", None, None, 1.0, None, None, [(1.0, None), (2.5, None)], None)),
        ('{"schema": {"version": 2}, "attribution": {"artist": {"name": "A"}, "hand": "after"}, "estimate": [1, 2], "comps": [{"price": 3, "tier": 1}]}', (2, "A", "after", None, 1.0, 2.0, None, [(3.0, 1)], None)),
        ('{"schema": {"version": 9}, "artist": "A"}', (9, None, None, None, None, None, None, None, "version 9")), ("{", (None, None, None, None, None, None, None, None, "not JSON")), (None, (None, None, None, None, None, None, None, None, "no report")), ("[]", (1, None, None, None, None, None, None, None, None)),
    ],
)
def test_reports_of_any_version(spark, given, want):
    from lotwise.functions import reports

    r = one(spark, given, reports.read)
    assert (r.version, r.artist, r.hand, r.title, r.low, r.high, r.currency, [tuple(c) for c in r.comps] if r.comps is not None else None, r.unread) == want
