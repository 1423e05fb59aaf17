"""Context-triggered piecewise hashing: document fingerprints that stay alike under edits.

A rolling hash over seven bytes ends a chunk wherever it meets a multiple of the block size, so a chunk depends on its
own bytes only and an edit changes the chunks it touches.  A fingerprint is ``block:signature:signature`` with one
character a chunk, the second signature at twice the block size; fingerprints compare at a block size both have.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import nonempty, schema_of, texts_of, written

WINDOW, LEAST_BLOCK, LONGEST, SHARED = 7, 3, 64, 5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte, the hash of the seven bytes that end there (zeros before the start), as unsigned 32-bit."""
    x = data.astype(np.uint32)
    h = np.zeros(len(x), np.uint32)
    mix = np.uint32(0x9E3779B1)
    for lag in range(min(WINDOW, len(x))):
        h[lag:] += x[: len(x) - lag] * np.uint32(pow(0x01000193, lag + 1, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= mix
    h ^= h >> np.uint32(13)
    return h


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of whole texts; the empty text has the block size 3 and two empty signatures."""
    gap = b"\0" * WINDOW
    joined = np.frombuffer(gap.join(texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + WINDOW for t in texts)])
    h = rolling(joined)
    places = np.flatnonzero(h % np.uint32(LEAST_BLOCK) == 0)
    doubles = h[places] // np.uint32(LEAST_BLOCK)
    edges = np.searchsorted(places, np.stack([starts[:-1], starts[:-1] + [len(t) for t in texts]]))
    out = []
    for t, start, lo, hi in zip(texts, starts[:-1].tolist(), *edges.tolist(), strict=True):
        ends, level, k = places[lo:hi] + 1 - start, doubles[lo:hi], 0
        while len(ends) >= LONGEST:
            k += 1
            keep = level & np.uint32((1 << k) - 1) == 0
            ends, level = ends[keep], level[keep]
        second = ends[level & np.uint32((2 << k) - 1) == 0]
        out.append(f"{LEAST_BLOCK << k}:{signature(t, ends.tolist())}:{signature(t, second.tolist())}")
    return out


def signature(text: bytes, ends: list[int]) -> str:
    """A character for each chunk; what follows the last boundary is a chunk too."""
    start, out = 0, []
    for end in ends if not text or ends and ends[-1] == len(text) else [*ends, len(text)]:
        out.append(ALPHABET[zlib.crc32(text[start:end]) & 63])
        start = end
    return "".join(out)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits at a time."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for c in b:
        u = state & masks.get(c, 0)
        state = (state + u | state - u) & full
    return len(a) - state.bit_count()


def alike(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) of two signatures over their joint length.

    Signatures that share no run of five characters (or all of a shorter one) are alike by chance only: 0.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(SHARED, len(a), len(b))
    if {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2.0 * common_length(a, b) / (len(a) + len(b))


def likeness(f: str, g: str) -> float:
    """0 to 1: the best agreement of two fingerprints at a block size that both have; equal ones give 1."""
    if f == g:
        return 1.0
    (m, a1, a2), (n, b1, b2) = f.split(":"), g.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(alike(a1, b1), alike(a2, b2) if a2 and b2 and min(len(a2), len(b2)) >= SHARED else 0.0)
    return alike(a2, b1) if 2 * m == n else alike(a1, b2) if m == 2 * n else 0.0


def with_fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``fingerprint`` of each whole text (null: of the empty text); a narrow pass.

    Columns of ``df`` named ``fingerprint`` give way to the new one.  Equal texts have equal fingerprints.
    """
    kept = [c for c in df.columns if c != "fingerprint"]
    schema = schema_of(df, *kept, extra="fingerprint string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            prints = fingerprints([t.encode() for t in texts_of(b, text)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(prints, pa.string())], [*kept, "fingerprint"])

    return df.select(*kept).mapInArrow(run, schema)


def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``other``, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


_NEIGHBOURS = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PENDING = "part int, edge string, text string, print string"


def _compared(ids: list, texts: list[str], prints: list[str], following: list[str], next_prints: list[str]) -> dict:
    changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    new = fingerprints([t.encode() for t in changed])
    return {
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array(map(len, texts), pa.int64()), "edited_text": pa.array(changed, pa.string()), "fingerprint": pa.array(prints, pa.string()), "edited_fingerprint": pa.array(new, pa.string()),
        "near_edited": pa.array(map(likeness, prints, new), pa.float64()), "near_next": pa.array(map(likeness, prints, next_prints), pa.float64()),
    }


def compare_with_next(df: DataFrame, outputs: dict | None = None) -> DataFrame:
    """Fingerprint each document, an edited form of it and compare it with the next one in descending ``doc_id``.

    The edited form takes its last third from the next document; after the last comes the first.  Columns: those of
    ``doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next``; ``outputs`` may name
    expressions over these to be returned in place of ``edited_text`` and the rest (as the query's digests).

    Documents are dealt out by ranges of the id, the only shuffle of texts, and each range is read in order once.  The
    last document of a range meets the first of the next range in a second step over two documents a range.  Null ids
    come last, ties in the order of the texts' hashes; a lone document is its own successor; null texts are empty.
    """
    spark = df.sparkSession
    outputs = outputs or {c: F.col(c) for c in _NEIGHBOURS.replace(",", "").split()[::2]}
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]  # what ranges are drawn from reaches the driver, so no text
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the id, text and fingerprint of the row before, which waits for its successor
        part = 0
        for b in nonempty(batches):
            ids, texts = b.column("doc_id").to_pylist(), texts_of(b, "text")
            prints = fingerprints([t.encode() for t in texts])
            if held is None:
                part = b.column("part")[0].as_py()
                yield _edge(part, "first", ids[0], texts[0], prints[0])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            held = ids[-1], texts[-1], prints[-1]
            if len(ids) > 1:
                yield _rows(_compared(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]))
        if held is not None:
            yield _edge(part, "last", *held)

    schema = f"{_NEIGHBOURS}, {_PENDING}"
    found = in_order.mapInArrow(run, schema)
    done = F.col("edge").isNull()
    passed = written(found.select("part", "edge", F.when(~done, F.col("doc_id")).alias("edge_id"), "text", "print", *(F.when(done, x).alias(c) for c, x in outputs.items())), "piecewise")
    edges = passed.where(F.col("edge").isNotNull()).select("part", "edge", "edge_id", "text", "print")
    numbers = sorted(r.part for r in edges.where("edge = 'first'").select("part").collect())  # one a range
    pairs = spark.createDataFrame([(p, q) for p, q in zip(numbers, numbers[1:] + numbers[:1], strict=True)], "part int, next_part int")
    last, first = edges.where("edge = 'last'"), edges.where("edge = 'first'")
    met = last.join(pairs, "part").join(first.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("print").alias("next_print")), "next_part")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            c = b.to_pydict()
            yield pa.RecordBatch.from_pydict(_compared(c["edge_id"], c["text"], c["print"], c["next_text"], c["next_print"]))

    final = met.select("edge_id", "text", "print", "next_text", "next_print").mapInArrow(meet, _NEIGHBOURS)
    return passed.where(F.col("edge").isNull()).select(*outputs).unionByName(final.select(*(x.alias(c) for c, x in outputs.items())))


def _rows(columns: dict) -> pa.RecordBatch:
    n = len(columns["doc_id"])
    return pa.RecordBatch.from_pydict(columns | {"part": pa.nulls(n, pa.int32()), "edge": pa.nulls(n, pa.string()), "text": pa.nulls(n, pa.string()), "print": pa.nulls(n, pa.string())})


def _edge(part: int, edge: str, doc_id, text: str, mark: str) -> pa.RecordBatch:
    empty = {"doc_id": pa.array([doc_id], pa.int64()), "n_chars": pa.nulls(1, pa.int64()), "edited_text": pa.nulls(1, pa.string()), "fingerprint": pa.nulls(1, pa.string()), "edited_fingerprint": pa.nulls(1, pa.string()), "near_edited": pa.nulls(1, pa.float64()), "near_next": pa.nulls(1, pa.float64())}
    return pa.RecordBatch.from_pydict(empty | {"part": pa.array([part], pa.int32()), "edge": pa.array([edge]), "text": pa.array([text]), "print": pa.array([mark])})
