"""The registered queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import documents, training_row, written

#: Where the public vocabulary files lie; None asks the ``public_tokenizers`` package.
VOCABULARY: str | None = None


def vocabulary_path() -> str:
    import public_tokenizers

    return VOCABULARY or public_tokenizers.path("byte_bpe_50k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of largest integer inner product for each fiftieth vector."""
    from lotwise.llm.topk import quantised, search

    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.w::DOUBLE[], v.w::DOUBLE[])::BIGINT AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    from lotwise.llm.bpe import Vocabulary, round_trip

    both = round_trip(documents(spark, sf_dir).select("doc_id", "text"), Vocabulary(vocabulary_path()))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document by a recurrent model learnt from four fifths of them, and by word counts."""
    from lotwise.llm.recurrent import score_held_out

    return score_held_out(documents(spark, sf_dir))


def op4_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited form."""
    from lotwise.llm.piecewise import compare_with_next

    same = {c: F.col(c) for c in ("fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    return compare_with_next(documents(spark, sf_dir), {"doc_id": F.col("doc_id"), "n_chars": F.col("n_chars"), "edited_sha256": F.sha2(F.col("edited_text").cast("binary"), 256)} | same)


#: Domains by the labels of quality and toxicity, with their share of tokens in the mixture.
DOMAIN_WEIGHTS = {"sound": 0.93, "sound_toxic": 0.02, "junk": 0.04, "junk_toxic": 0.01}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    name = F.concat(F.when(F.col("quality") == 1, "sound").otherwise("junk"), F.when(F.col("toxic") == 1, "_toxic").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", name.alias("domain"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for every document, such that expected tokens by domain have the target shares."""
    from lotwise.llm import hashed, mixing

    docs = written(hashed.with_features(documents(spark, sf_dir), True), "features")
    model = mixing.fit(docs, domain_labels(spark, sf_dir), list(DOMAIN_WEIGHTS))
    mixed = mixing.mix(docs, model, DOMAIN_WEIGHTS).rated
    return mixed.select("doc_id", F.col(hashed.TOKENS).alias("tokens"), *(F.col("_posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAIN_WEIGHTS)), "rate", mixing.draws(F.col("rate"), "doc_id").alias("copies"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, linked at four or fewer differing bits of four-word shingles."""
    from lotwise.llm.simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("p0"), 16, "0")).alias("fingerprint"), "component_id")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 200-byte string found elsewhere, and a digest of the rest."""
    from lotwise.llm.suffixes import repeats

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = repeats(documents(spark, sf_dir), 200)
    return found.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document: 0 for junk, 1 for sound but toxic text, 2 for sound text; kept if likely 2."""
    from lotwise.llm import hashed, quality

    docs = written(hashed.with_features(documents(spark, sf_dir), True), "features")
    sound, toxic = F.col("quality") == 1, F.col("toxic") == 1
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.when(sound & ~toxic, 2).when(sound, 1).when(~sound, 0).alias("label"))
    learnt = quality.fit(docs, ratings.where(training_row(F.col("doc_id"), 5, 0)), 3)
    scored = quality.score(docs, learnt, 2)
    return scored.select("doc_id", training_row(F.col("doc_id"), 5, 0, True).alias("held_out"), "expected_grade", "tail_probability", "keep")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learnt from four fifths of the labels."""
    from lotwise.llm import toxicity

    docs = written(toxicity.featured(documents(spark, sf_dir)), "features")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    learnt = toxicity.fit(docs, labels.where(training_row(F.col("doc_id"), 5, 0)))
    scored = toxicity.score(docs, learnt)
    return scored.select("doc_id", training_row(F.col("doc_id"), 5, 0, True).alias("held_out"), "score", "predicted")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended as eight arrivals and compacted by size; the shard that ends up holding each."""
    from lotwise.llm.common import new_path
    from lotwise.llm.shards import shard

    store = shard(documents(spark, sf_dir), new_path(spark, "shards"), versions=1)
    return store.read().select("doc_id", F.col("_arrival").alias("arrival"), F.element_at(F.split("shard", "/"), -2).alias("run"), F.element_at(F.split("shard", "/"), -1).alias("shard"), F.lit(store.version()).alias("version"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's words are from those of the other sources of its language, and the words that set it apart."""
    from lotwise.llm.divergence import audit

    return audit(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT id, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
      FROM (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
every AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n
          FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + v) AS p FROM every JOIN v USING (lang)),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM every GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + v) AS q FROM whole JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
                    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
         ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term))
WHERE part = 'pair' OR rank <= 200
"""


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters of documents remove in each of their 120 orders, by language."""
    from lotwise.llm.interaction import audit

    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Every order applied to the counts of documents by part and filters failed, without subsets or grouping sets.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS fails, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
      FROM d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((labels.toxic = 1)::INT) AS toxic FROM labels GROUP BY ALL) l USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, k, substr(o, k, 1) AS x, 1 << (ascii(substr(o, k, 1)) - 65) AS bit,
            list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(o, i, 1)) - 65)))::INT AS before0 FROM orders, (SELECT unnest(range(1, 6)) AS k)),
told AS (SELECT part, o, k, x,
           sum(CASE WHEN fails & (coalesce(before0, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN fails & coalesce(before0, 0) = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN fails & coalesce(before0, 0) <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN fails & coalesce(before0, 0) = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN fails & coalesce(before0, 0) = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
         FROM cells, steps GROUP BY ALL)
SELECT part, o AS filter_order, k::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM told
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives that hold equal payloads once, and what reading them back tells."""
    from lotwise.llm.common import new_path
    from lotwise.llm.warc import archive, records, resolved

    path = new_path(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = resolved(records(spark, path, payload=False))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("of_page").cast("long").alias("refers_to"))


OP13_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(h, 1 + 5 * k, 5))::INTEGER) AS fives FROM h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((fives[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_topk": op1_topk, "op2_bpe": op2_bpe, "op3_language_model": op3_language_model, "op4_piecewise": op4_piecewise, "op5_mixing": op5_mixing, "op6_simhash": op6_simhash, "op7_suffixes": op7_suffixes, "op8_quality": op8_quality, "op9_toxicity": op9_toxicity, "op10_shards": op10_shards, "op11_divergence": op11_divergence, "op12_interaction": op12_interaction, "op13_warc": op13_warc}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op11_divergence": OP11_SQL, "op12_interaction": OP12_SQL, "op13_warc": OP13_SQL}
