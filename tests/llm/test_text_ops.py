"""BPE, fingerprints, classifiers and the language model against libraries, brute force and held-out labels."""

import hashlib
import math
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotwise.llm import bpe, hashed, mixing, piecewise, quality, recurrent, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY, LIBRARY = bpe.Vocabulary(PATH), Tokenizer.from_file(PATH)
PIECES = bpe.Pieces(VOCABULARY)
SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, label string, ids string, k1 long"
ODD = [(1, "one  two", "x", "y", 3), (1, "one  two", "x", "y", 3), (2, None, None, None, None), (None, "", "x", "y", 3), (3, "Ünïcode — 漢字 ½ <|endoftext|>!" * 50, "x", "y", 3), (4, "long word " * 60_000, "x", "y", 3)]


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",), max_codepoint=0x2FFF), st.sampled_from(" '\nst9_²\x1c\xa0")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_librarys(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = list(array("I", bpe.encode_text(text, PIECES, VOCABULARY.special)))
    assert got == want
    assert b"".join(map(VOCABULARY.pieces.__getitem__, got)).decode("utf-8", "replace") == LIBRARY.decode(want, skip_special_tokens=False)


def test_merges_of_a_long_piece():
    text = "ab" * 3_000 + "x" * 3_000
    assert list(array("I", bpe.encode_text(text, PIECES, VOCABULARY.special))) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOC)
    back = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded) for r in back.collect()) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in ODD)
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (0 if x == y else 2)))
    return row[-1]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_length_gives_the_edit_distance(a, b):
    assert len(a) + len(b) - 2 * piecewise.common_length(a, b) == brute_distance(a, b)


def test_fingerprint_of_a_text_doesnt_depend_on_its_batch():
    texts = [t.encode() for t in ("", "a", "some text that repeats " * 40, "é" * 500)]
    assert piecewise.fingerprints(texts) == [piecewise.fingerprints([t])[0] for t in texts]
    assert all(len(s) <= 64 for f in piecewise.fingerprints(texts) for s in f.split(":")[1:])


def test_next_documents_by_brute_force(spark):
    rows = [*ODD, (9, "nine " * 300, None, None, None), (8, "eight " * 300, None, None, None)]
    got = piecewise.compare_with_next(spark.createDataFrame(rows, DOC)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [r[1] or "" for r in order]
    want = Counter((r[0], piecewise.edited(t, n), piecewise.fingerprints([t.encode()])[0]) for r, t, n in zip(order, texts, texts[1:] + texts[:1], strict=True))
    assert Counter((r.doc_id, r.edited_text, r.fingerprint) for r in got) == want
    one = piecewise.compare_with_next(spark.createDataFrame(rows[:1], DOC)).first()
    assert one.near_next == 1.0
    assert piecewise.compare_with_next(spark.createDataFrame([], DOC)).count() == 0


def test_edited_texts_stay_alike_and_others_dont(spark):
    got = piecewise.compare_with_next(spark.read.parquet(f"{SF}/documents.parquet")).where("n_chars > 200").toPandas()
    assert (got.near_edited > 0.4).mean() > 0.97 and (got.near_next < 0.3).mean() > 0.97
    assert piecewise.with_fingerprints(spark.createDataFrame(ODD, DOC)).columns == [*DOC.replace(",", "").split()[::2], "fingerprint"]


def area(score, truth):
    ranks = score.rank()
    n = truth.sum()
    return (ranks[truth].sum() - n * (n + 1) / 2) / n / (~truth).sum()


def test_toxicity_on_held_out_documents(spark):
    from lotwise.llm.queries import op9_toxicity

    sf = "/root/testdata/sf0.1"
    got = op9_toxicity(spark, sf).where("held_out").toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert area(got.score, got.toxic == 1) > 0.93
    assert ((got.predicted == 1) & (got.toxic == 0)).sum() <= 0.01 * len(got)


def toy(spark):
    bad, good = "you idiot", "a fine day"
    rows = [(i, f"{bad if i % 2 else good} with {'women' if i % 4 == 1 else 'bread'} {i % 7}") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, label int")


def test_swapping_groups_hardly_moves_the_score(spark):
    docs, labels = toy(spark)
    ask = spark.createDataFrame([(0, "we met women at the market"), (1, "we met men at the market"), (2, "idiot"), (3, None)], "doc_id long, text string")
    swing = {}
    for penalty in (0.0, 4.0):
        got = {r.doc_id: r.score for r in toxicity.score(ask, toxicity.fit(docs, labels, penalty=penalty)).collect()}
        swing[penalty] = abs(got[0] - got[1])
        assert got[2] > 0.5 > got[3]
    assert swing[4.0] < swing[0.0] / 2
    assert toxicity.swapped("Women, and men!") == "men, and christians!"


def test_fits_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOC)
    none = spark.createDataFrame([(1, None)], "doc_id long, label int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).where("score is null").count() == 0
    assert quality.score(docs, quality.fit(docs, none, 3), 2).where("tail_probability <> 0.5").count() == 0
    mixed = mixing.mix(docs, mixing.fit(docs, none.selectExpr("doc_id", "'a' AS domain").limit(0), ["a", "b"]), {"a": 1, "b": 1})
    assert mixed.rated.count() == len(ODD)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_gradient_of_the_ordinal_fit(spark):
    docs, _ = toy(spark)
    ratings = spark.createDataFrame([(i, 2 if i % 2 == 0 else i % 3 % 2) for i in range(200)], "doc_id long, label int")
    model = quality.fit(docs, ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score(docs, model, 2).join(ratings, "doc_id").groupBy("label").agg(F.avg("expected_grade").alias("g")).toPandas().set_index("label").g
    assert got[2] > 1.8 and got[0] < 1 and got[1] < 1.2


def test_quality_on_held_out_documents(spark):
    from lotwise.llm.queries import op8_quality

    got = op8_quality(spark, SF).where("held_out").toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert area(got.expected_grade, got.quality == 1) > 0.95


def test_rates_meet_their_goals(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    rows = [(i, int(rng.integers(0, 900)), [float(x) for x in p[i]]) for i in range(500)]
    members = spark.createDataFrame(rows, "doc_id long, _tokens long, _posterior array<double>")
    mixture = mixing.rates(members, [0.6, 0.3, 0.1])
    rated, got, goal = mixture.rated, mixture.got, mixture.goal
    assert mixture.settled
    assert np.allclose(got, goal, rtol=1e-3) and np.isclose(goal[0] / goal[2], 6)
    frame = rated.toPandas()
    assert (frame.rate >= 0).all()
    assert np.allclose((np.stack(frame._posterior) * (frame._tokens * frame.rate).to_numpy()[:, None]).sum(0), goal, rtol=1e-3)


def small_vocabulary(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat. " * 5 + f"Word{i}") for i in range(60)], "doc_id long, text string")
    return docs, recurrent.word_counts(docs)


def test_probabilities_sum_to_one(spark):
    _, counts = small_vocabulary(spark)
    v = recurrent.vocabulary(counts, words=4, counted=6)
    network = recurrent.Network(v, recurrent.parameters(v, 8))
    states = np.random.default_rng(1).standard_normal((1, 8)).astype(np.float32)
    targets = np.arange(v.words + recurrent.SHAPES)
    assert np.exp(network.outputs(np.repeat(states, len(targets), axis=0), targets)).sum() == pytest.approx(1, abs=1e-4)
    # within a shape: all counted words without weights and one share for any other word
    for k in range(recurrent.SHAPES):
        own = [r.n + 0.5 for r in counts.collect() if r["shape"] == k and v.code.get(r.word, 99) >= v.words]
        assert math.log10(sum(own) + 0.5) == pytest.approx(v.tail_total[k], abs=1e-9)


def test_backpropagation_against_differences(spark):
    _, counts = small_vocabulary(spark)
    v = recurrent.vocabulary(counts, words=4, counted=6)
    p = {k: x.astype(np.float64) for k, x in recurrent.parameters(v, 3).items()}
    coder = recurrent.Coder(v.code)
    lanes = recurrent._lanes(["the cat sat Word1", "on the"], coder, v)
    found = {}

    class Watched(recurrent.Network):
        def _move(self, name, g, rows=None):
            found[name] = (g.copy(), rows)

    network = Watched(v, p)
    n = int((lanes.document >= 0).sum())
    network.learn(lanes)
    for name, at in (("state", (1, 4)), ("to_class", (2, 1)), ("input", (v.words + recurrent.SHAPES, 5)), ("to_word", (0, 1, 0))):
        loss = []
        for shift in (1e-3, -1e-3):
            q = {k: x.copy() for k, x in p.items()}
            q[name][at] += shift
            loss.append(-recurrent.Network(v, q).score(lanes).sum())
        want = (loss[0] - loss[1]) / 2e-3 / math.sqrt(n)
        g, rows = found[name]
        got = g[np.flatnonzero(rows == at[0])[0], at[1]] if rows is not None else g[at]
        assert got == pytest.approx(want, rel=2e-2, abs=2e-4), name


def test_model_beats_counts_on_held_out_documents(spark):
    from lotwise.llm.queries import op3_language_model

    got = op3_language_model(spark, SF).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.15 * held.n_tokens.sum()
    assert got.n_tokens.gt(0).all() and got.n_known.le(got.n_tokens).all()


def test_base_score_by_brute_force_and_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(["A b", "a  c", "", None, "d é x", "b"] * 3)] + [(None, "q", "x", "y", 1), (5, "dup", None, None, None), (5, "dup", None, None, None)], DOC)
    got = recurrent.score_held_out(docs).collect()
    rows = [(r.doc_id, recurrent.words_of(r.text or "") + [""]) for r in docs.collect()]
    import zlib

    train = Counter(w for i, ws in rows for w in ws if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1)
    n, v = sum(train.values()), len(train)
    want = sorted(round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6) for _, ws in rows)
    assert sorted(round(r.base_score, 6) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert recurrent.score_held_out(docs.limit(0)).count() == 0


def test_digest_of_ids(spark):
    from lotwise.llm.queries import op2_bpe

    got = {r.doc_id: r for r in op2_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_features_are_bounded():
    assert all(0 <= c < 1 << hashed.BITS for c in hashed.Features(True)("Some TEXT!! 12 ### " * 9)) and hashed.Features(True)("") == {hashed.column("=empty")}


def test_every_training_document_shapes_the_weights(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "START_DOCS", 0)
    docs = spark.createDataFrame([(i, f"the cat sat on the mat {'and ran ' * (i % 5)}") for i in range(12)], "doc_id long, text string").repartition(1).cache()
    v = recurrent.vocabulary(recurrent.word_counts(docs), words=4, counted=6)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(10_000))
    late = [r.doc_id for r in docs.where(chance >= 1_500).orderBy(chance).collect()]
    whole = recurrent.fit(docs, v)["to_class"]
    for left_out in (late[0], late[-1]):
        assert not np.array_equal(whole, recurrent.fit(docs.where(F.col("doc_id") != left_out), v)["to_class"])


def test_learnt_words_grow_with_the_counts(spark):
    counts = spark.range(2_600).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(0).alias("shape"), F.when(F.col("id") < 2_500, 1_000).otherwise(1).cast("long").alias("n"))
    assert recurrent.vocabulary(counts).words == 2_500


def test_rates_by_dense_projected_gradient(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    n = rng.integers(1, 500, 200).astype(float)
    members = spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(200)], "doc_id long, _tokens long, _posterior array<double>")
    mixture = mixing.rates(members, [0.05, 0.15, 0.8])
    got = mixture.rated.orderBy("doc_id").toPandas().rate.to_numpy()
    assert mixture.settled and (got == 0).any()  # some rates are cut off
    rate, goal = np.ones(200), np.array(mixture.goal)
    a = p * n[:, None]
    price = np.zeros(3)
    step = 1 / np.linalg.eigvalsh(p.T @ a).max()
    for _ in range(200_000):  # plain gradient steps on the prices of the least change
        rate = np.maximum(0, 1 - p @ price)
        price += step * (a.T @ rate - goal)
    assert np.allclose(a.T @ rate, goal, rtol=1e-6) and np.allclose(got, rate, atol=2e-3)


def test_draws_meet_the_goals_and_absent_domains_ask_for_nothing(spark):
    rows = [(i, 10, [1.0, 0.0, 0.0] if i % 4 else [0.0, 1.0, 0.0]) for i in range(20_000)]
    members = spark.createDataFrame(rows, "doc_id long, _tokens long, _posterior array<double>")
    mixture = mixing.rates(members, [0.9, 0.1, 0.5])
    drawn = mixture.rated.withColumn("copies", mixing.draws(F.col("rate"), "doc_id")).groupBy(F.col("_posterior")[1].alias("junk")).agg(F.sum(F.col("copies") * F.col("_tokens")).alias("n"))
    totals = {r.junk: r.n for r in drawn.collect()}
    assert mixture.settled and mixture.goal[2] == 0
    assert totals[0.0] == pytest.approx(mixture.goal[0], rel=0.03) and totals[1.0] == pytest.approx(mixture.goal[1], rel=0.06)
    whole = mixing.rates(members, [0.9, 0.1, 0.0], whole=[0])
    assert whole.goal[0] == 150_000 and whole.rated.where("_posterior[0] = 1 AND rate < 1 - 1e-9").count() == 0


def test_conflicting_labels_count_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 1), (None, 1), (2, None)], "doc_id long, label int")
    got = hashed.labelled_rows(hashed.with_features(docs, True), labels)
    assert sorted((r.doc_id, r.label) for r in got.collect()) == [(1, 0), (2, 1)]


def dense(docs, features, columns):
    """0/1 matrix of the documents' selected columns, made one by one."""
    out = np.zeros((len(docs), len(columns)))
    for i, t in enumerate(docs):
        own = features(t)
        out[i] = [c in own for c in columns]
    return out


def descend(gradient, v, step, times):
    for _ in range(times):
        v = v - step * gradient(v)
    return v


def test_toxicity_weights_by_dense_descent(spark):
    docs, labels = toy(spark)
    model = toxicity.fit(docs, labels, penalty=1.0, ridge=20.0)
    texts, y = [r.text for r in docs.orderBy("doc_id").collect()], np.arange(200) % 2
    words = hashed.Features(False)
    x, x2 = dense(texts, words, model.columns), dense([toxicity.swapped(t) for t in texts], words, model.columns)

    def gradient(v):
        w, b = v[:-1], v[-1]
        s, gap = x @ w + b, (x2 - x) @ w
        off = 1 / (1 + np.exp(-s)) - y
        return np.append(x.T @ off / 200 + 2 * (x2 - x).T @ gap / 200 + 20.0 / 200 * w, off.mean() + 0.05 / (1 + np.exp(-b)))

    v = descend(gradient, np.zeros(len(model.columns) + 1), 0.3, 20_000)
    want = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
    got = [r.score for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    assert np.allclose(got, want, atol=5e-3)


def test_ordinal_weights_by_dense_descent(spark):
    docs, _ = toy(spark)
    grade = np.array([2 if i % 2 == 0 else i % 3 % 2 for i in range(200)])
    model = quality.fit(docs, spark.createDataFrame([(i, int(g)) for i, g in enumerate(grade)], "doc_id long, label int"), 3, ridge=20.0)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    x, m = dense(texts, hashed.Features(True), model.columns), len(model.columns)

    def loss(v):
        above = 1 / (1 + np.exp(v[m:] - (x @ v[:m])[:, None]))
        p = np.column_stack([1 - above[:, 0], above[:, 0] - above[:, 1], above[:, 1]])
        return -np.log(p[np.arange(200), grade]).mean() + 20.0 / 400 * v[:m] @ v[:m]

    def gradient(v):
        steps = np.eye(len(v)) * 1e-5
        return np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in steps])

    own = np.concatenate([model.weights, model.thresholds])
    best = descend(gradient, np.concatenate([np.zeros(m), [-0.5, 0.5]]), 0.5, 1_500)
    assert loss(own) == pytest.approx(loss(best), abs=1e-3) and np.abs(gradient(own)).max() < 2e-3
    tail = 1 / (1 + np.exp(best[m + 1] - x @ best[:m]))
    got = [r.tail_probability for r in quality.score(docs, model, 2).orderBy("doc_id").collect()]
    assert np.allclose(got, tail, atol=2e-2)


def test_scores_of_an_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "good day", 7, 8), (2, None, 7, 8)], "doc_id long, text string, raw int, tokens int")
    labels = spark.createDataFrame([(1, 2)], "doc_id long, label int")
    kept = quality.score(docs, quality.fit(docs, labels, 3), 2, keep=("doc_id", "raw", "tokens"))
    assert kept.columns[:3] == ["doc_id", "raw", "tokens"] and {r.raw for r in kept.collect()} == {7}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels, 3), 2).count() == 0
    model = mixing.fit(docs.limit(0), labels.selectExpr("doc_id", "'a' AS domain"), ["a", "b"])
    both = mixing.mix(docs, model, {"a": 1, "b": 1}, ("doc_id", "raw", "tokens"))
    assert {r.tokens for r in both.rated.collect()} == {8}
    assert mixing.mix(docs.limit(0), model, {"a": 1, "b": 1}).rated.count() == 0


def test_both_ways_at_once_give_what_each_way_gives(spark):
    docs = spark.createDataFrame(ODD, DOC)
    one = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY, keep=("doc_id", "ids"))
    both = bpe.round_trip(docs, VOCABULARY)
    seen = lambda df: Counter((r.doc_id, bytes(r.ids), r.decoded) for r in df.collect())
    assert seen(one) == seen(both)


def plain_fingerprint(text: bytes) -> str:
    """Boundaries byte by byte, as the format states them."""
    import zlib

    hashes = []
    for i in range(len(text)):
        h = 0
        for lag in range(7):
            if i - lag >= 0:
                h += text[i - lag] * pow(0x01000193, lag + 1, 1 << 32)
        h &= 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x9E3779B1 & 0xFFFFFFFF
        hashes.append(h ^ h >> 13)

    def signature(block):
        out, start = "", 0
        for end in [i + 1 for i, h in enumerate(hashes) if h % block == 0] + [len(text)]:
            if end > start:
                out += piecewise.ALPHABET[zlib.crc32(text[start:end]) & 63]
            start = end
        return out

    block = 3
    while sum(h % block == 0 for h in hashes) >= 64:
        block *= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def plain_likeness(f: str, g: str) -> float:
    def alike(a, b):
        if a == b:
            return 1.0
        run = min(5, len(a), len(b))
        if not run or not any(a[i : i + run] in b for i in range(len(a) - run + 1)):
            return 0.0
        return 1 - brute_distance(a, b) / (len(a) + len(b))

    if f == g:
        return 1.0
    (m, a1, a2), (n, b1, b2) = f.split(":"), g.split(":")
    if m == n:
        return max(alike(a1, b1), alike(a2, b2) if min(len(a2), len(b2)) >= 5 else 0.0)
    return alike(a2, b1) if 2 * int(m) == int(n) else alike(a1, b2) if int(m) == 2 * int(n) else 0.0


@given(st.lists(st.one_of(st.binary(max_size=400), st.text("ab c", max_size=200).map(str.encode)), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_fingerprints_byte_by_byte(texts):
    texts = [*texts, texts[0] + b"more", texts[0] * 3]
    got = piecewise.fingerprints(texts)
    assert got == [plain_fingerprint(t) for t in texts]
    for g in got:
        assert piecewise.likeness(got[0], g) == pytest.approx(plain_likeness(got[0], g))


def test_scores_by_a_plain_forward_pass(spark):
    docs, counts = small_vocabulary(spark)
    v = recurrent.vocabulary(counts, words=4, counted=6)
    p = recurrent.parameters(v, 5, seed=9)
    texts = ["the cat sat on Word1", "", "mat. the the Odd7"]
    coder = recurrent.Coder(v.code)
    got = recurrent.Network(v, {k: x.copy() for k, x in p.items()}).score(recurrent._lanes(texts, coder, v))
    sig = lambda x: 1 / (1 + math.exp(-x))
    u = 5
    for text, score in zip(texts, got, strict=True):
        h, before, total = [0.0] * u, v.words + recurrent.SHAPES, 0.0
        for w in [*recurrent.words_of(text), recurrent.END]:
            x = p["input"][before]
            a = [sum(h[i] * p["state"][i, j] for i in range(u)) for j in range(3 * u)]
            z, r = [sig(x[j] + a[j]) for j in range(u)], [sig(x[u + j] + a[u + j]) for j in range(u)]
            new = [math.tanh(x[2 * u + j] + r[j] * a[2 * u + j]) for j in range(u)]
            h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(u)]
            code = v.code.get(w)
            own = code is not None and code < v.words
            target = code if own else v.words + recurrent.shape(w)
            cls = int(v.word_class[code]) if own else len(v.members) + recurrent.shape(w)
            logits = [sum(h[i] * p["to_class"][i, c] for i in range(u)) + p["class_bias"][c] for c in range(v.classes)]
            total += logits[cls] - math.log(sum(map(math.exp, logits)))
            if own and len(v.members[cls]) > 1:
                inner = [sum(h[i] * p["to_word"][cls, i, s] for i in range(u)) + p["word_bias"][cls, s] for s in range(len(v.members[cls]))]
                total += inner[int(v.slot[code])] - math.log(sum(map(math.exp, inner)))
            before = target
        assert score == pytest.approx(total, abs=2e-3)
