"""What a query makes on the way grows no faster than its input: tables repeated with shifted keys."""

import pytest
from pyspark.sql import functions as F
from test_queries import QUERIES, SF

KEYS = {"part": ["p_partkey"], "supplier": ["s_suppkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey"]}
TIMES, SHIFT = 3, 360_360
PAIR = {"linkage_weights": ["work_a", "work_b"]}


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The small fixture ``TIMES`` over."""
    folder = tmp_path_factory.mktemp("repeated")
    for name, keys in KEYS.items():
        rows = spark.read.parquet(f"{SF}/{name}.parquet").crossJoin(spark.range(TIMES).select(F.col("id").alias("_i")))
        rows.withColumns({k: F.col(k) + F.col("_i") * SHIFT for k in keys}).drop("_i").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_misspelt_titles_of_many_artists_are_looked_for_once(spark, repeated, monkeypatch):
    from lotwise.operators import joins

    own, asked = joins.within_one_edit, []
    monkeypatch.setattr(joins, "within_one_edit", lambda left, *more: asked.append(left.count()) or own(left, *more))
    once, more = (QUERIES["work_identity"](spark, folder) for folder in (SF, repeated))
    assert asked[1] == asked[0]
    assert more.count() == TIMES * once.count() and more.where("basis = 'typo_title'").count() == TIMES * once.where("basis = 'typo_title'").count() > 0


def test_descriptions_of_one_file_are_read_by_many_tasks(spark):
    assert QUERIES["catalogue_works"](spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(("block", "wide"), [(4, 3), (4_096, 4_096)])
def test_similar_nodes_in_cells(spark, monkeypatch, block, wide):
    from lotwise.operators import graph

    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "WIDE", wide)
    sets = {n: {f"f{(n % 20) * p % 31}" for p in range(1, 3 + n % 5)} for n in range(60)}  # copies, small sets, ties
    edges = spark.createDataFrame([(n, f) for n, s in sets.items() for f in s] + [(1, None)], "n long, f string")
    sizes = {n: len(s) + (n == 1) for n, s in sets.items()}
    want = []
    for a in sets:
        near = sorted((-(both / (sizes[a] + sizes[b] - both)), b) for b in sets if b != a and sizes[a] >= 3 <= sizes[b] and (both := len(sets[a] & sets[b])))
        want += [(a, b, i, round(-s, 9)) for i, (s, b) in enumerate(near[:5], 1)]
    found = graph.similar_nodes(edges, "n", "f", 3, 5)
    assert want and sorted((r.a, r.b, r["rank"], round(r.similarity, 9)) for r in found.collect()) == sorted(want)


def test_copies_are_compared_once(spark, repeated):
    """Copies of works don't add to what is compared, and classes stand for the same pairs and clusters."""
    from lotwise.operators import joins, linkage
    from lotwise.plans import identity
    from lotwise.sources.tables import works

    once, more = (linkage.class_links(works(spark, folder), "work", identity.SAME, identity.RULES, identity.GIVEN, 0.0)[0].where("a <> b").count() for folder in (SF, repeated))
    assert once == more > 0
    pairs, members = identity.judged(spark, repeated)
    made = joins.expanded(pairs, members).select("a", "b", "verdict", "confidence")
    assert made.count() == made.select("a", "b").distinct().count() and not made.where("a >= b").count()
    assert made.count() > pairs.count()


def test_classes_in_chunks(spark, monkeypatch):
    from lotwise.operators import joins

    monkeypatch.setattr(joins, "CHUNK", 2)
    values = {n: n % 3 if n % 4 else None for n in range(20)}
    reps, members = joins.classes(spark.createDataFrame(list(values.items()), "k long, v int"), "k", ["v"])
    assert {(r.k, r._copies) for r in reps.collect()} == {(min(k for k, x in values.items() if x == v), sum(x == v for x in values.values())) for v in values.values()}
    rep = {k: min(j for j, x in values.items() if x == v) for k, v in values.items()}
    both = spark.createDataFrame([(0, 0), (1, 2)], "a long, b long")
    want = {(a, b) for a in values for b in values if a < b and ({rep[a], rep[b]} in ({0}, {1, 2}))}
    assert {(r.a, r.b) for r in joins.expanded(both, members).collect()} == want
    assert {(r.a, r.b) for r in joins.expanded(both, members, True).collect()} == {(a, b) for a, b in want if (rep[a], rep[b]) != (2, 1)}


@pytest.mark.parametrize("name", ["tolerance_join", "labelled_pairs", "linkage_weights"])
def test_pairs_of_copies_are_made_last(spark, repeated, monkeypatch, name):
    import duckdb

    from lotwise.operators import joins
    from test_queries import SQL

    own, made = joins.expanded, []
    monkeypatch.setattr(joins, "expanded", lambda pairs, *more, **named: made.append(pairs.count()) or own(pairs, *more, **named))
    QUERIES[name](spark, SF)
    found = QUERIES[name](spark, repeated).select(*PAIR.get(name, "a b".split()))
    assert 0 < made[0] <= made[1] <= made[0] + spark.read.parquet(f"{SF}/part.parquet").count()  # a class with itself counts once
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{repeated}/part.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(db.execute(f"SELECT {", ".join(PAIR.get(name, "a b".split()))} FROM ({SQL[name]})").fetchall())


def test_copies_that_catalogues_number_apart_are_compared_once(spark, tmp_path, monkeypatch):
    """Entries follow keys, so copies have other numbers; verdicts are put in where copies are made into pairs, and clusters agree."""
    import duckdb

    from lotwise.operators import joins
    from test_queries import SQL

    part = spark.read.parquet(f"{SF}/part.parquet")
    rows = part.crossJoin(spark.range(TIMES).select(F.col("id").alias("_i")))
    rows.withColumn("p_partkey", F.col("p_partkey") + F.col("_i") * 20_000).drop("_i").write.parquet(f"{tmp_path}/part.parquet")
    own, made = joins.expanded, []
    monkeypatch.setattr(joins, "expanded", lambda pairs, *more, **named: made.append(pairs.count()) or own(pairs, *more, **named))
    QUERIES["pair_verdicts"](spark, SF)
    found = {n: QUERIES[n](spark, str(tmp_path)).drop("confidence") for n in ("pair_verdicts", "held_clusters")}
    assert 0 < made[0] <= made[1] <= made[0] + part.count()  # a class with itself counts once
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for n, df in found.items():
        want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[n]})").fetchall()
        assert want and sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_prices_blend_what_an_artist_sold_without_pairs_of_lots(spark, monkeypatch):
    """No row for each probe and lot is made but for the probes that arrays can't take."""
    from lotwise.plans import market

    own, asked = market.comparables, []
    monkeypatch.setattr(market, "comparables", lambda spark, folder, only=None: asked.append(only) or own(spark, folder, only))
    assert QUERIES["blended_prices"](spark, SF).count() > 0
    assert len(asked) == 1 and asked[0] is not None and asked[0].count() == 0


def test_titles_meet_names_once_for_all_artists(spark, repeated, monkeypatch):
    from lotwise.plans import catalogue

    own, met = catalogue.handed, []
    monkeypatch.setattr(catalogue, "handed", lambda texts: met.append(texts.count()) or own(texts))
    once, more = (QUERIES["title_ranking"](spark, folder).count() for folder in (SF, repeated))
    assert more == TIMES * once > 0 and met[:2] == met[2:] and len(met) == 4


def test_misspelt_titles_are_read_once_each(spark, monkeypatch):
    from lotwise.plans import catalogue

    read = []
    monkeypatch.setattr(catalogue, "distinct_titles", lambda *a, f=catalogue.distinct_titles: read.append(f(*a)) or read[-1])
    assert QUERIES["misspelt_titles"](spark, SF).count() > 0
    assert len(read) == 1 and read[0].count() == read[0].distinct().count()


@pytest.mark.parametrize("name", ["stored_calibration", "evidence_bundles", "witness_weights", "witness_calibration"])
def test_priced_lots_are_made_once(spark, monkeypatch, name):
    from lotwise.plans import valuation

    own, made = valuation.priced, []
    monkeypatch.setattr(valuation, "priced", lambda *a: made.append(1) or own(*a))
    QUERIES[name](spark, SF)
    assert len(made) == 1


def test_rests_of_texts_are_made_by_many_tasks(spark):
    """Texts without up to three letters are a row each, made in parallel; nested arrays made again for each use took a minute of one task."""
    import random
    import time

    from lotwise.functions.strings import typo_distance
    from lotwise.operators import joins

    rng = random.Random(1)
    texts = ["", "a", "aa", "aab", "ab", "ba", "é\U0001f600b", *("".join(rng.choice("abc ") for _ in range(rng.randrange(4, 16))) for _ in range(120))]
    texts = sorted(set(texts))
    began = time.time()
    found = {(r.a, r.b) for r in joins.within_edits(spark.createDataFrame([(t,) for t in [*texts, *texts, None]], "t string"), "t", 3).collect()}
    assert time.time() - began < 30
    near = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if typo_distance(a, b) <= 3}
    assert near and near <= found and all(a < b for a, b in found)


def test_a_works_lots_are_dealt_by_their_number(spark, monkeypatch):
    """More lots are more tasks, not larger ones."""
    from lotwise.operators import ranking

    monkeypatch.setattr(ranking, "HELD", 200)
    found = QUERIES["work_prior"](spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(found) == 30 and max(r["count"] for r in found) < 400


def test_evidence_is_told_without_windows_that_grow(spark, monkeypatch):
    """Lots are dealt by their number before works' latest sales are found, and an artist's lots are read once for all counts."""
    from lotwise.operators import ranking

    monkeypatch.setattr(ranking, "HELD", 200)
    own, dealt = ranking.dealt, []
    monkeypatch.setattr(ranking, "dealt", lambda *a: dealt.append(own(*a)) or dealt[-1])
    found = QUERIES["evidence_tier"](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey").distinct().count()
    assert len(dealt) == 1 and dealt[0].rdd.getNumPartitions() == 30


def test_boosted_prices_are_joined_once(spark, monkeypatch):
    """What trees are fitted to is made before the fits, not again in each pass of each."""
    from lotwise.operators import learn

    monkeypatch.setattr(learn, "boosted", lambda df, *_: df)
    assert "Join" not in QUERIES["boosted_prices"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
