"""Source divergence, filter interaction and WARC archives against plain passes over small tables."""

import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from lotwise.llm import divergence, interaction, queries, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, rank int, part string, value string"
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, "p", "v") for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_interaction", "op13_warc"])
def test_audits_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    plain = lambda f: Counter(tuple("" if v != v else str(v) for v in r) for r in f[columns].astype("object").fillna("").itertuples(index=False, name=None))
    assert sorted(got.columns) == columns and len(got) and plain(got) == plain(want)


def plain_divergence(rows, least, top):
    found, out = defaultdict(Counter), []
    in_docs = defaultdict(Counter)
    groups = sorted({(lang or "", source or "") for _, _, lang, source in rows})
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))
        found[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    for lang in sorted({g[0] for g in groups}):
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        mine = [g for g in groups if g[0] == lang]
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        p = {g: shares(found[g]) for g in mine}
        q = shares(sum((found[g] for g in mine), Counter()))
        for g in mine:
            pairs = sorted((-sum((p[g][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o[1]) for o in mine if o != g)
            terms = sorted((-((p[g][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if found[g][t] and p[g][t] > q[t])[:top]
            out += [(*g, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)] + [(*g, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms, 1)]
    return out


ODD = [
    (1, "The cat, the Cat; Äpfel äpfel naïve", "en", "a"), (2, "the dog-cat x1y the\x00cat", "en", "b"), (3, "THE end of the cat x y", "en", None), (4, None, "en", "d"), (4, "the cat x", "en", "a"), (4, "the cat x", "en", "a"),
    (5, "seul", "fr", "a"), (6, "rien de commun", "fr", "b"), (7, "", None, "a"), (None, "wort wort", None, None), (8, "wort", "", "z"), (9, "wort mehr", "", "z"), (10, "𝔘nicode 𝔘nicode é", "xx", "only"), (11, "the cat", "en", ""), (12, "cat " * 5000 + "the", "en", "long"),
]


@pytest.mark.parametrize("few", [1000, 0])
def test_divergence_by_a_plain_pass(spark, few):
    got = [tuple(r) for r in divergence.audit(docs_of(spark, ODD), least=3, top=2, few_groups=few).collect()]
    assert sorted(got) == sorted(plain_divergence(ODD, 3, 2)) and any(r[2] == "term" for r in got)
    assert divergence.audit(docs_of(spark, ODD).limit(0)).count() == 0


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F

    n = 50_000_000_000
    got = spark.createDataFrame([(n, 3 * n, 7)], "n long, total long, size long").select(divergence.share(F.col("n"), F.col("total"), F.col("size"))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (3 * n + 7)


def plain_interaction(rows, labels):
    least, texts, good, toxic = {}, defaultdict(list), set(), set()
    for i, text, lang, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, quality, bad in labels:
        good |= {i} if quality == 1 else set()
        toxic |= {i} if bad == 1 else set()
    for i, text, lang, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        texts[lang or ""].append(({k for k, v in fails.items() if v}, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part, found in texts.items():
        told, share = [], Counter()
        for order in permutations("ABCDE"):
            left = found
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                share[f] += len(gone)
                fails = sum(f in r[0] for r in found)
                told.append((part, "".join(order), k, len(left), len(gone), fails - len(gone), sum(r[0] == {f} for r in found), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*r[:-1], share[r[-1]]) for r in told]
    return out


def test_interaction_by_a_plain_pass(spark):
    long = " ".join(f"word{k}" for k in range(250))
    rows = [
        (1, long, "en", "a"), (2, long, "en", "b"), (2, long, "en", "b"), (3, long, "fr", "a"), (4, long + " #", "en", "a"), (5, "SHOUT " * 300, "en", "a"), (6, None, "en", "a"), (7, "", None, "a"), (8, "short", "", "a"),
        (None, long, "en", "a"), (None, "nameless", "en", "a"), (9, "nameless", "en", "a"), (9, "nameless", "en", "a"), (10, "x " * 40000, "de", "a"), (11, "a\x0bb\x0cc\xa0d e A", "de", "a"), (12, "é" * 33 + "A", "de", "a"), (13, "é" * 32 + "A", "de", "a"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, None, 1), (5, 0, 1), (9, 1, 0), (None, 1, 1), (77, 1, 1)]
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r) for r in interaction.audit(docs_of(spark, rows), marks).collect()]
    assert sorted(got) == sorted(plain_interaction(rows, labels))
    assert interaction.audit(docs_of(spark, rows).limit(0), marks).count() == 0
    unmarked = [tuple(r) for r in interaction.audit(docs_of(spark, rows), marks.limit(0)).collect()]
    assert sorted(unmarked) == sorted(plain_interaction(rows, []))


def b32(text: str) -> str:
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


PAGES = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "same"), (3, "http://a/3", "other\r\n\r\nWARC/1.1\r\n\r\n"), (4, None, None), (5, "http://a/5", ""), (None, "http://a/n", "same"), (None, None, "alone"),
    (6, "http://a/6\r\nX: y", "é𝔘" * 400_000), (7, "http://a/7", "twice"), (7, "http://a/7", "twice"), (7, "http://a/7b", "twice"), (8, "http://a/8", "twice"), (10, "http://a/10", "top"), (10, "http://a/10", "top"),
]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "x", 7) for r in rows], "page_id long, url string, html string, digest string, record_type string, copies int")


@pytest.mark.parametrize("least", [0, 4, 6])
def test_archives_hold_equal_payloads_once(spark, tmp_path, least):
    path = f"{tmp_path}/warc"
    warc.archive(pages_of(spark, PAGES), path, least=least, date="2024-01-02T03:04:05Z", per_file=4)
    found = warc.records(spark, path)
    got = [r.asDict() for r in warc.resolved(found).collect()]
    assert Counter((r["page_id"], r["digest"], bytes(r["payload"]).decode(), r["payload_bytes"]) for r in got) == Counter((None if i is None else str(i), b32(t or ""), t or "", len((t or "").encode())) for i, _, t in PAGES)
    own, groups = {r["record_id"]: r for r in got}, defaultdict(list)
    assert len(own) == len(got) and {r["date"] for r in got} == {"2024-01-02T03:04:05Z"}
    for r in got:
        groups[r["digest"]].append(r)
    for group in groups.values():
        first = [r for r in group if r["record_type"] == "response"]
        if group[0]["payload_bytes"] < least:
            assert len(first) == len(group)
            continue
        assert len(first) == 1 and int(first[0]["page_id"] or -1) == max(int(r["page_id"] or -1) for r in group)
        assert all(r["refers_to"] == first[0]["record_id"] and r["of_page"] == first[0]["page_id"] for r in group if r["record_type"] == "revisit")
    held = [r for r in found.collect() if r.record_type == "revisit"]
    assert all(r.payload is None and r.payload_bytes is None for r in held)
    assert {r["uri"] for r in got if r["page_id"] == "6"} == {"http://a/6%0D%0AX: y"}


def test_archives_of_no_pages(spark, tmp_path):
    warc.archive(pages_of(spark, PAGES).limit(0), f"{tmp_path}/none")
    assert warc.resolved(warc.records(spark, f"{tmp_path}/none")).count() == 0


def test_foreign_and_damaged_archives(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nhello"
    record = lambda kind, extra, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    http = "Content-Type: application/http; msgtype=response\r\n"
    made = [record("warcinfo", "", b"software: y"), record("response", "WARC-Record-ID: <r1>\r\n" + http, body), record("revisit", f"WARC-Record-ID: <r2>\r\nWARC-Refers-To: <r1>\r\nWARC-Payload-Digest: sha1:{b32('hello')}\r\n" + http, body[:-5]), record("revisit", "WARC-Record-ID: <r3>\r\nWARC-Refers-To: <gone>\r\n" + http, body[:-5])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))  # a gzip member a record
    rows = {r.record_id: r for r in warc.resolved(warc.records(spark, f"{tmp_path}/in")).collect()}
    assert bytes(rows["<r2>"].payload) == b"hello" and rows["<r2>"].payload_bytes == 5 and rows["<r3>"].payload is None and rows[None].record_type == "warcinfo" and len(rows) == 4
    (tmp_path / "in" / "members.warc.gz").unlink()
    (tmp_path / "in" / "plain.warc").write_bytes(b"".join(made))
    assert warc.records(spark, f"{tmp_path}/in", payload=False).where("record_id = '<r1>' AND payload IS NULL AND payload_bytes = 5").count() == 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc").write_bytes(record("response", f"WARC-Payload-Digest: sha1:{b32('other')}\r\n" + http, body))
    with pytest.raises(Exception, match="its header says"):
        warc.records(spark, f"{tmp_path}/bad").count()
