"""Search, near-duplicates, repeats, shards and the pipeline against brute force."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import queries, shards, simhash, suffixes, topk
from lotwise.llm.components import components

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score int")


def test_search_agrees_with_sql(spark):
    got = queries.op1_topk(spark, SF).toPandas().sort_values(["query_id", "rank"])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.OP1_SQL).df().sort_values(["query_id", "rank"])
    assert got[want.columns].to_numpy().tolist() == want.to_numpy().tolist()


def test_search_with_ties_nulls_and_many_cells(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 5) / 8], 1, 1) for i in range(90)] + [(200, None, 1, 1), (201, [1.0, None], 1, 1), (202, [float("nan")], 1, 1), (203, [float("inf")], 1, 1), (204, [], 1, 1), (None, [1.0], 1, 1), (205, [1.0] * 9, 1, 1)]
    data = topk.quantised(vectors(spark, rows))
    whole = {r.vec_id: r.weights for r in data.where("vec_id is not null").collect()}
    assert set(range(200, 204)).isdisjoint(whole)
    got = topk.search(data, data.where("vec_id % 10 = 0"), 5, block=16, batch=2).collect()
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for q in (i for i in whole if i % 10 == 0):
        want = sorted(((-score(whole[q], w), i) for i, w in whole.items() if i != q))[:5]
        assert [(r.rank, r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    assert topk.search(data.limit(0), data, 5).count() == 0 and topk.search(data, data.limit(0), 5).count() == 0


def test_search_with_repeated_ids(spark):
    rows = [(0, [10])] * 6 + [(i, [w]) for i, w in enumerate([90, 80, 70, 60, 50, 40, 30], 1)] + [(3, [75])]
    data = spark.createDataFrame(rows, "vec_id long, weights array<long>")
    got = topk.search(data, data.where("vec_id = 0"), 5, block=4).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 900), (2, 2, 800), (3, 3, 750), (4, 3, 700), (5, 4, 600)]
    both = topk.search(data, data.where("vec_id = 3"), 2, block=4, batch=1).collect()  # two queries of one id
    assert Counter((r.rank, r.vec_id, r.score) for r in both) == Counter([(1, 1, 6750), (2, 2, 6000), (1, 1, 6300), (2, 2, 5600)])


def plain_print(text, words):
    import re

    import xxhash

    found = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    runs = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict, bits: int) -> dict:
    label = {i: i for i in prints}
    ids = sorted(prints)
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and (prints[i] ^ prints[j]).bit_count() <= bits:
                    label[i], changed = label[j], True
    return label


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    prints = {}
    for i in range(160):
        p = base[i % 12]
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            p ^= 1 << int(b)
        prints[i] = p
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "node long, p0 long")
    want = brute_components(prints, 4)
    small = simhash.BLOCK
    for block in (small, 20):  # the second compares large groups in blocks
        simhash.BLOCK = block
        got = {r.node: r.label for r in components(simhash.links(nodes, ["p0"], 4)).collect()}
        assert {i: got.get(i, i) for i in prints} == want
    simhash.BLOCK = small


def test_chain_of_components(spark):
    got = {r.node: r.label for r in components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 41


def test_near_duplicates_with_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, 1), (3, text + " x", 1), (None, text, 1), (7, "", 1), (8, None, 1), (9, "One  two", 1), (10, "one two", 1), (10, "one two", 1), (11, "long " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p0 int")
    got = simhash.near_duplicates(docs, words=4, bits=4).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r.doc_id or -1, r.p0)), sorted(rows, key=lambda r: (r[0] or -1,)), strict=True):
        assert r.p0 % 2**64 == plain_print(t or "", 4), i
    by = {r.doc_id: r.component_id for r in got}
    assert by[7] == by[8] == 7 and by[9] == by[10] == 9 and by[11] == 11 and by[5] == by[None]
    alone = simhash.near_duplicates(docs.where("doc_id is null"), words=4).first()
    assert alone.component_id is None
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect())[10] <= 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def jaccard_components(sets: dict, least: float) -> dict:
    label, ids, changed = {i: i for i in sets}, sorted(sets), True
    near = {i: [j for j in ids if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9] for i in ids}
    while changed:
        changed = False
        for i in ids:
            low = min(label[j] for j in near[i])
            label[i], changed = low, changed or low < label[i]
    return label


def test_one_of_each_by_brute_force(spark):
    rng, texts = np.random.default_rng(11), {}
    line = [f"c{i}" for i in range(60)]  # a passage that many texts share

    def put(words):
        texts[len(texts)] = " ".join(words)

    for g in range(60):  # pairs at similarities of 0.60 to 0.99: k words changed, five shingles each
        base = [f"g{g}w{i}" for i in range(300)]
        put(base)
        other = base.copy()
        for i in range(1 + g % 15):
            other[20 * i + 7] += "x"
        put(other)
        put(line + [f"g{g}v{i}" for i in range(50)])
    hot = [f"h{i}" for i in range(200)]  # a large group of near copies
    for g in range(80):
        own = hot.copy()
        for i in rng.choice(200, int(rng.integers(0, 5)), replace=False):
            own[i] += f"y{g}"
        put(own)
    for t in ("", " \n", "One  two", "one two", texts[0].replace(" ", "  "), texts[0].upper()):
        texts[len(texts)] = t
    sets = {i: frozenset(simhash.shingles(t, 5)) for i, t in texts.items()}
    want = jaccard_components(sets, 0.8)
    level = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 180, 3)]
    assert sum(0.8 <= x <= 0.95 for x in level) >= 20 and sum(x < 0.8 for x in level) >= 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(want.values()))


def test_rows_of_one_id_stay_apart(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in "abc"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2])], "doc_id long, text string")
    assert Counter(r.doc_id for r in simhash.one_of_each(docs).collect()) == {1: 2, 2: 1}
    found = simhash.near_duplicates(docs).collect()
    assert len({r.component for r in found}) == 3 and {r.component_id for r in found} == {1, 2}
    with pytest.raises(TypeError):
        simhash.near_duplicates(docs.selectExpr("concat('x', doc_id) AS doc_id", "text"))


def test_sieve_loses_no_id(spark):
    from lotwise.llm import common

    ids = spark.range(-3_000, 3_000, 3)
    held = common.sieve(ids)
    own, others = np.arange(-3_000, 3_000, 3), np.arange(10**6, 10**6 + 20_000)
    assert common.passes(held, own).all() and common.passes(held, others).mean() < 0.01
    common.SIEVE_BITS, before = 1, common.SIEVE_BITS
    assert common.sieve(ids) is None and common.passes(None, others).all()
    common.SIEVE_BITS = before


def test_thresholds_reach_every_link():
    costs = [np.array([0.0, 1, 5, 30]), np.array([0.0, 2, 3, 50]), np.array([0.0, 4, 8, 9])]
    from itertools import product

    for total in range(1, 7):
        cost, ts = simhash.allocate(costs, total)
        assert sum(t + 1 for t in ts) == total
        assert cost == min(sum(c[e] for c, e in zip(costs, es, strict=True)) for es in product(range(4), repeat=3) if sum(es) == total)


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_repeats_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdé \n")
    make = lambda n: "".join(rng.choice(letters, n))
    passages = [make(int(n)) for n in (205, 300, 420, 199, 90)]
    texts = [make(int(rng.integers(0, 600))) + passages[rng.integers(0, 5)][int(rng.integers(0, 9)) :] + make(int(rng.integers(0, 300))) + passages[rng.integers(0, 5)] for _ in range(60)]
    texts += [texts[0], texts[0], "", None, "z" * 900, "ab" * 450, make(100), "é" * 350, passages[2] * 3]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 int").repartition(5)
    got = suffixes.repeats(docs, 200, ("doc_id", "k1")).collect()
    want = plain_repeats(texts, 200)
    assert len(got) == len(rows)
    for r in got:
        data, spans = (texts[r.k1] or "").encode(), [tuple(s) for s in r.spans]
        assert spans == want[r.k1], r.k1
        at, kept = 0, b""
        for a, b in spans:
            kept, at = kept + data[at:a], b
        assert bytes(r.kept) == kept + data[at:]
    whole = suffixes.repeats(docs, 200, ("k1",), whole_characters=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in whole)


def test_repeats_of_long_texts_and_none(spark):
    base = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 700_000))
    docs = spark.createDataFrame([(1, base), (2, base[300_000:300_500])], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffixes.repeats(docs).collect()}
    assert got == {1: [(300_000, 300_500)], 2: [(0, 500)]}
    assert suffixes.repeats(docs.limit(0)).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 4, 300) for _ in range(3)]
    got = suffixes.multikey_order(keys)
    assert [tuple(k[i] for k in keys) for i in got] == sorted(zip(*(k.tolist() for k in keys), strict=True))


def test_store_compacts_and_keeps_every_row(spark, tmp_path):
    docs = spark.createDataFrame([(i % 50, None if i % 9 == 0 else "x" * (i % 40), i) for i in range(400)] + [(None, "y", 0)], "doc_id long, text string, arrival_no int")
    store = shards.shard(docs, str(tmp_path / "s"), arrivals=6, target=2_000, fan=3, smallest=1_500)
    assert Counter(map(tuple, store.read().select("doc_id", "text", "arrival_no").collect())) == Counter(map(tuple, docs.collect()))
    live = store.manifest()
    assert live.agg(F.sum("rows")).first()[0] == 401
    assert live.groupBy("tier").agg(F.count_distinct("run").alias("n")).where("n >= 3").count() == 0
    assert store.read(1).count() <= 401
    with pytest.raises(shards.Conflict):
        store.commit(live, store.version())
    store.vacuum()
    assert store.read().count() == 401
    empty = shards.shard(docs.limit(0), str(tmp_path / "e"), arrivals=2)
    assert empty.read().count() == 0


def plain_tiers(sizes, fan, smallest):
    """Sizes of runs after each arrival, merged tier by tier from the smallest."""
    import math

    tier = lambda n: 0 if n <= smallest else math.ceil(math.log(n / smallest, fan) - 1e-9)
    runs = []
    for size in sizes:
        runs.append(size)
        while True:
            full = sorted(t for t, n in Counter(map(tier, runs)).items() if n >= fan)
            if not full:
                break
            runs = [r for r in runs if tier(r) != full[0]] + [sum(r for r in runs if tier(r) == full[0])]
    return sorted(runs)


def test_runs_are_those_of_plain_compaction(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (7 * i % 90), 777) for i in range(600)], "doc_id long, text string, arrival int")
    store = shards.shard(docs, str(tmp_path / "s"), arrivals=8, target=700, fan=3, smallest=400, versions=1)
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    sizes = [r.n for r in docs.groupBy(turn.alias("t")).agg(F.sum(F.octet_length("text")).alias("n")).orderBy("t").collect()]
    live = store.manifest()
    assert sorted(r.n for r in live.groupBy("run").agg(F.sum("bytes").alias("n")).collect()) == plain_tiers(sizes, 3, 400)
    assert live.select("tier").distinct().count() >= 2 and {r.arrival for r in store.read().collect()} == {777}
    assert set(store._names("data")) == {r.run for r in live.collect()}
    with pytest.raises(ValueError):
        shards.shard(docs.withColumn("shard", F.lit(1)), str(tmp_path / "t"))


def test_one_of_two_writers_wins_and_vacuum_spares_the_other(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    one = shards.ShardStore(spark, str(tmp_path / "s"))
    two = shards.ShardStore(spark, str(tmp_path / "s"))
    one.append(rows(1))
    first, lost = one.manifest, []

    def late(version=None):  # another writer commits after this one has read the version
        if not lost:
            lost.append(two.append(rows(99), "other"))
        return first(version)

    one.manifest = late
    with pytest.raises(shards.Conflict):
        one.append(rows(7), "mine")
    one.manifest = first
    two.vacuum()
    assert "mine" in two._names("data")  # not committed yet, so not deleted
    one.adopt("mine")
    assert sorted(r.doc_id for r in one.read().collect()) == [1, 7, 99]
    rows(5).write.parquet(str(tmp_path / "s/data/stray"))
    rows(6).write.mode("append").parquet(str(tmp_path / "s/data/mine"))  # a stray file in a run isn't read
    assert sorted(r.doc_id for r in two.read().collect()) == [1, 7, 99]
    two.vacuum(orphans=-1)
    assert "stray" not in two._names("data") and two.read().count() == 3


def test_pipeline_stages(spark):
    import corpus_pipeline

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert got.doc_id.is_unique and got.round_trip.all() and 0.6 * rows.count() < len(got) < rows.count()
    toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").toPandas().doc_id
    assert got.doc_id.isin(toxic).sum() <= 0.25 * len(toxic)
    copies = rows.groupBy("text").agg(F.collect_list("doc_id").alias("ids")).where("size(ids) > 1").collect()
    kept = set(got.doc_id)
    assert all(len(kept & set(r.ids)) <= 1 for r in copies)
    assert got.ids_sha256[0] == hashlib.sha256(bytes(got.ids[0])).hexdigest()


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, _node long, rate double, ids string, kept_0 int, _row long, score double"
    more = ("en", "s", 9, 1, 0.5, "x", 3, 4, 0.1)
    texts = [(1, "plain words about a quiet day"), (1, "plain words about a quiet day"), (2, None), (3, ""), (None, "other words of no harm at all"), (4, "a long tale goes on " * 4_000), (5, "Ünï 漢字 ½")]
    docs = spark.createDataFrame([(*t, *more) for t in texts], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            got = stage(spark, rows, sf)
            assert tuple(got.columns) == corpus_pipeline.COLUMNS, name
            left = [(r.doc_id, r.text) for r in got.collect()]
            if name != "suffixes":
                assert not set(left) - set(texts), name
            if rows is docs:
                ids = {i for i, _ in left}
                assert {None, 4, 5} <= ids if name != "suffixes" else {None, 5} <= ids, name
                if name == "simhash":  # copies are one, and so are texts without words
                    assert Counter(left)[texts[0]] == 1 and len(ids & {2, 3}) == 1
    coded = corpus_pipeline.encode(spark, docs, sf)
    assert coded.count() == len(texts) and coded.where("NOT round_trip").count() == 0
    assert corpus_pipeline.encode(spark, docs.limit(0), sf).count() == 0


def test_kept_columns_with_names_of_the_operators(spark):
    from lotwise.llm import bpe, hashed, mixing, quality, recurrent, toxicity

    names = ["ids", "decoded", "p0", "component", "component_id", "node", "score", "predicted", "n_tokens", "keep", "expected_grade", "spans", "kept", "rate", "_tokens", "kept_rate", "text2"]
    rows = [(i, f"the cat sat on the mat number {i % 3} " * 8, *(f"{c}{i}" for c in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    vocabulary = bpe.Vocabulary(queries.vocabulary_path())
    keep = ("doc_id", *names)
    grades = spark.createDataFrame([(i, i % 3) for i in range(6)], "doc_id long, label int")
    toxic = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, label int")
    counts = recurrent.word_counts(docs)
    v = recurrent.vocabulary(counts, words=4, counted=6)
    weights = recurrent.parameters(v, 8)
    mixture = mixing.mix(docs, mixing.fit(docs, toxic.selectExpr("doc_id", "if(label = 1, 'a', 'b') AS domain"), ["a", "b"]), {"a": 1, "b": 1}, keep, strict=False).rated
    made = {
        "encode": (bpe.encode(docs, vocabulary, keep=keep), {"ids"}), "round trip": (bpe.round_trip(docs, vocabulary, keep=keep), {"ids", "decoded"}), "decode": (bpe.decode(docs.withColumn("ids", F.lit(None).cast("binary")).withColumn("decoded", F.concat(F.lit("decoded"), "doc_id")), vocabulary, keep=tuple(c for c in keep if c != "ids")), {"decoded"}),
        "near": (simhash.near_duplicates(docs, keep=keep), {"p0", "component", "component_id", "node"}), "likelihoods": (recurrent.likelihoods(docs, v, weights, counts, keep), {"score", "n_tokens"}), "quality": (quality.score(docs, quality.fit(docs, grades, 3), 2, keep=keep), {"keep", "expected_grade"}),
        "toxicity": (toxicity.score(docs, toxicity.fit(docs, toxic), keep=keep), {"score", "predicted"}), "suffixes": (suffixes.repeats(docs, 200, keep), {"spans", "kept"}), "mixture": (mixture, {"rate", "_tokens"}),
    }
    for name, (found, clash) in made.items():
        kept = [c for c in keep if c != "doc_id" and (name != "decode" or c != "ids")]
        called = {c: ("kept_kept_" if c == "rate" and name == "mixture" else "kept_") + c if c in clash else c for c in kept}
        got = {r.doc_id: [r[called[c]] for c in kept] for r in found.select("doc_id", *called.values()).collect()}
        assert got == {i: [f"{c}{i}" for c in kept] for i in range(6)}, name
    assert hashed.AT not in docs.columns


def test_goals_out_of_reach_raise(spark):
    from lotwise.llm import mixing

    members = spark.createDataFrame([(i, 10, [0.5, 0.5]) for i in range(20)], "doc_id long, _tokens long, _posterior array<double>")
    with pytest.raises(RuntimeError):
        mixing.rates(members, [0.9, 0.1])
    with pytest.warns(UserWarning):
        assert mixing.rates(members, [0.9, 0.1], strict=False).rated.where("rate >= 0").count() == 20


def test_rates_are_those_of_projected_gradient_steps_on_rates(spark):
    """Steps on the rates themselves, one number a document: gradient of the errors by inverse curvature, what falls below 0 cut off."""
    from lotwise.llm import mixing

    rng = np.random.default_rng(11)
    p, n = rng.dirichlet([0.4, 0.4, 0.4], 200), rng.integers(1, 500, 200).astype(float)
    members = spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(200)], "doc_id long, _tokens long, _posterior array<double>")
    mixture = mixing.rates(members, [0.05, 0.15, 0.8])
    goal, raw = np.array(mixture.goal), np.ones(200)
    for _ in range(400):
        rate = np.maximum(0, raw)
        curve = (p * (n * (raw > 0))[:, None]).T @ p
        raw = raw - 0.5 * p @ np.linalg.solve(curve + 1e-9 * np.eye(3), p.T @ (n * rate) - goal)
    got = mixture.rated.orderBy("doc_id").toPandas().rate.to_numpy()
    assert (rate == 0).any() and np.allclose(p.T @ (n * rate), goal, rtol=1e-6) and np.allclose(got, rate, atol=2e-3)
