"""Removal of byte strings that repeat, by range-partitioned sorting of suffixes.

A window of ``length`` bytes is represented by the suffix at its minimiser, the place in the window whose ``GRAM`` bytes
hash lowest.  Equal windows have equal minimisers at equal offsets, so only suffixes that agree need be compared, and
windows next to one another share a suffix.  Suffixes are sorted by their leading eight bytes as they stand, then by tokens
that hash further bytes: those that all the windows of a suffix contain (the core), then all the bytes its windows cover
(the content), by another hash function.  Sampled splitters range-partition them by these tokens; each bucket is sorted by
multikey quicksort and neighbours are compared, as are the edges of buckets with the splitters next to them.  Suffixes of equal content repeat in whole.  Those that share the core
only are cut into suffixes of fewer windows, twice, until each holds one window, whose core is its content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm.common import byte_buffer, kept_apart, nonempty

GRAM = 40
#: Bytes of a suffix that are its first token.
LEADING = 8
#: Bytes hashed at a time, whatever the lengths of texts.
PIECE = 1 << 18
#: Windows of a suffix: all that share the minimiser, then so many, then one.
NARROWER = 14
#: Bytes of text to a bucket at most, so that buckets grow in number, not in size.
BUCKET = 64 << 20
#: Documents from which splitters are drawn; they steer balance, never results.
SAMPLED = 512

#: Multipliers of the two hash functions of byte ranges.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
U = np.uint64

SUFFIX, WITNESS, SPAN = 0, 1, 2


@lru_cache(maxsize=4)
def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse for i < n, modulo 2 ** 64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def mixed(x: np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = x ^ U(salt) if isinstance(salt, int) else x ^ salt
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Hasher:
    """Hashes of byte ranges of a piece, from sums of its prefixes."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.up, down = powers(PIECE + 1024, BASES[which])
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * down[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[start]

    def grams(self, n: int) -> np.ndarray:
        last = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:last]) * self.up[:last])


def minimiser_runs(piece: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first and last window of every run of valid windows that share a minimiser (places in the piece)."""
    at = np.flatnonzero(valid)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    span = length - GRAM + 1
    place = (1 << 19) - 1
    low = Hasher(piece).grams(GRAM) & U(~place & (1 << 64) - 1)
    low |= np.arange(len(low), dtype=U)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    best = (low[at] & U(place)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)]))
    return best[new], at[new], at[np.append(new[1:], len(at)) - 1]


def pieces(n: int) -> range:
    return range(0, n, PIECE)


def all_suffixes(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """(document, minimiser, least and greatest offset of a window before it) of all windows, a row each suffix."""
    out = []
    for p in pieces(len(data)):
        piece = data[p : p + PIECE + length - 1]
        edge = np.zeros(PIECE + 1, np.int64)
        lo, hi = np.clip(offsets[:-1] - p, 0, PIECE), np.clip(offsets[1:] - length + 1 - p, 0, PIECE)
        some = hi > lo
        np.add.at(edge, lo[some], 1)
        np.add.at(edge, hi[some], -1)
        m, a, b = minimiser_runs(piece, np.cumsum(edge[:-1]) > 0, length)
        doc = np.searchsorted(offsets, a + p, "right") - 1
        out.append(np.stack([doc, m + p - offsets[doc], m - b, m - a]))
    return np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)


def narrower(suffixes: np.ndarray, width: int) -> np.ndarray:
    """Each suffix cut where the offset is a multiple of ``width``."""
    doc, m, lo, hi = suffixes
    first = lo // width
    times = hi // width - first + 1
    row = np.repeat(np.arange(len(doc)), times)
    k = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return np.stack([doc[row], m[row], np.maximum(lo[row], k * width), np.minimum(hi[row], (k + 1) * width - 1)])


def tokens(data: np.ndarray, offsets: np.ndarray, suffixes: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading bytes, core and content of every suffix as signed numbers; the first in the order of the bytes."""
    doc, m, lo, hi = suffixes
    lead, core, content = np.zeros(len(doc), U), np.zeros(len(doc), U), np.zeros(len(doc), U)
    at = m + offsets[doc]
    for i in range(LEADING):
        lead = lead << U(8) | data[at + i].astype(U)
    group = lo // width * width
    turn = np.argsort((at - hi) // PIECE, kind="stable")
    cuts = np.searchsorted(((at - hi) // PIECE)[turn], np.arange(len(data) // PIECE + 2))
    for k, p in enumerate(pieces(len(data))):
        own = turn[cuts[k] : cuts[k + 1]]
        if len(own):
            h, h2, place = (*(Hasher(data[p : p + PIECE + 2 * length], k) for k in (0, 1)), at[own] - p)
            g = group[own]
            core[own] = mixed(h.ranges(place - g, place - g - width + 1 + length), (g + 1).astype(U) << U(20) | U(width))
            content[own] = mixed(h2.ranges(place - hi[own], place - lo[own] + length), (lo[own] << 10 | hi[own]).astype(U) << U(20) | U(width))
    return (lead ^ U(1 << 63)).view(np.int64), core.view(np.int64), content.view(np.int64)


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by the first token, then, only where that ties, by the next, and so on."""
    order = np.argsort(keys[0], kind="quicksort")
    tied = np.zeros(max(0, len(order) - 1), bool) if len(order) < 2 else keys[0][order[1:]] == keys[0][order[:-1]]
    for key in keys[1:]:
        inside = np.concatenate([tied, [False]]) | np.concatenate([[False], tied])
        at = np.flatnonzero(inside)
        if not len(at):
            break
        run = np.cumsum(np.concatenate([[True], ~tied]))[at]
        order[at] = order[at][np.lexsort((key[order[at]], run))]
        tied &= key[order[1:]] == key[order[:-1]]
    return order


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = np.cumsum(np.concatenate([[0], np.where(doc[1:] != doc[:-1], end.max() + 2, 0)]))
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]]))
    return doc[new], start[new], (reach - shift)[np.append(new[1:], len(doc)) - 1]


_ROWS = "bucket int, kind int, lead long, core long, content long, k1 long, k2 long, at long"


def _batch(bucket, kind, lead, core, content, k1, k2, at) -> pa.RecordBatch:
    n = len(k1)
    one = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), n).astype(t))
    return pa.RecordBatch.from_arrays([one(bucket, np.int32), one(kind, np.int32), *(one(x, np.int64) for x in (lead, core, content, k1, k2, at))], ["bucket", "kind", "lead", "core", "content", "k1", "k2", "at"])


def bucket_of(keys: tuple[np.ndarray, ...], splitters: np.ndarray) -> np.ndarray:
    """How many splitters are at most (lead, core, content)."""
    lead, core, content = keys
    lo, hi = np.searchsorted(splitters[0], lead, "left"), np.searchsorted(splitters[0], lead, "right")
    tied = np.flatnonzero(hi > lo)
    if len(tied):  # rows that lead like a splitter: by their further tokens
        x, y, at = core[tied], content[tied], lead[tied]
        for j in range(int(lo[tied].min()), int(hi[tied].max())):
            c, d = splitters[1][j], splitters[2][j]
            lo[tied] += (at == splitters[0][j]) & ((x > c) | ((x == c) & (y >= d)))
    return lo


def asked(suffixes: np.ndarray, keys: tuple[np.ndarray, ...], k1: np.ndarray, k2: np.ndarray, length: int, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows to be sorted.  What repeats within the batch is settled here and leaves one witness for other batches."""
    doc, m, lo, hi = suffixes
    order = multikey_order(list(keys))
    same = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    again, before = np.concatenate([same, [False]])[: len(order)], np.concatenate([[False], same])[: len(order)]
    single, first, all_of = order[~again & ~before], order[again & ~before], order[again | before]
    d, s, e = merged(doc[all_of], (m - hi)[all_of], (m - lo)[all_of] + length)
    buckets = len(splitters[0]) + 1
    if len(d):
        yield _batch(np.arange(len(d)) % buckets, SPAN, 0, s, e, k1[d], k2[d], 0)
    for rows, kind in ((single, SUFFIX), (first, WITNESS)):
        if len(rows):
            own = tuple(k[rows] for k in keys)
            yield _batch(bucket_of(own, splitters), kind, *own, k1[doc[rows]], k2[doc[rows]], (m << 20 | lo << 10 | hi)[rows])


def answered(batches: Iterator[pa.RecordBatch], length: int, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of a sorted bucket: the spans of suffixes whose content repeats, and suffixes of which only the core does."""
    held, edges = [], set()
    for b in nonempty(batches):
        c = [b.column(i).to_numpy() for i in range(8)]
        span = c[1] == SPAN
        if span.any():
            yield _batch(0, SPAN, *(x[span] for x in c[2:7]), 0)
        held.append([x[~span] for x in c])
        if len(held[-1][0]):
            k = int(held[-1][0][0])
            edges |= set(splitters[1][max(0, k - 2) : k + 2].tolist())
    if not held:
        return
    _, kind, lead, core, content, k1, k2, at = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = multikey_order([lead, core, content])
    kind, lead, core, content, k1, k2, at = (x[order] for x in (kind, lead, core, content, k1, k2, at))
    alike = (lead[1:] == lead[:-1]) & (core[1:] == core[:-1])
    both = alike & (content[1:] == content[:-1])
    m, lo, hi = at >> 20, at >> 10 & 1023, at & 1023
    whole = (kind == SUFFIX) & (np.concatenate([both, [False]])[: len(core)] | np.concatenate([[False], both])[: len(core)])
    if whole.any():
        yield _batch(0, SPAN, 0, (m - hi)[whole], (m - lo)[whole] + length, k1[whole], k2[whole], 0)
    # one row of each content goes on if its core has other contents; also of those that repeat, since others may hold parts of them
    first = np.concatenate([[True], ~both])[: len(core)]
    group = np.cumsum(np.concatenate([[True], ~alike])[: len(core)]) - 1
    part = first & ((np.bincount(group, first)[group] > 1) | np.isin(core, list(edges)))
    if part.any():
        yield _batch(0, SUFFIX, lead[part], core[part], content[part], k1[part], k2[part], at[part])


def splitters_of(texts: DataFrame, buckets: int, length: int) -> list[np.ndarray]:
    """Splitters (lead, core, content) for each step: quantiles of the tokens in a bounded sample of documents.

    From the second step on, where only suffixes that share a core are left, half of them are those of repeated cores.
    The sample's texts are cut before they are sorted; splitters steer balance, never results.
    """
    drawn_from = texts.select(F.substring("text", 1, 50_000).alias("text"), F.xxhash64("text", F.rand(7)).alias("h"))
    rows = drawn_from.orderBy("h").limit(SAMPLED).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            data, offsets = byte_buffer(b, "text")
            found = all_suffixes(data, offsets, length)
            for step, width in enumerate(_widths(length)):
                found = narrower(found, width)
                keys = tokens(data, offsets, found, width, length)
                order = multikey_order(list(keys))
                keys = [k[order] for k in keys]
                same = keys[1][1:] == keys[1][:-1]
                again = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(order) else order
                for rows in (np.arange(len(order)), again) if step else (np.arange(len(order)),):
                    at = rows[np.unique(np.linspace(0, max(0, len(rows) - 1), min(len(rows), 4_096)).astype(np.int64))]
                    yield pa.RecordBatch.from_pydict({"step": pa.array(np.full(len(at), step), pa.int32()), "lead": pa.array(keys[0][at]), "core": pa.array(keys[1][at]), "content": pa.array(keys[2][at])})

    got = rows.coalesce(1).mapInArrow(run, "step int, lead long, core long, content long").toPandas()
    out = []
    for step in range(len(_widths(length))):
        x = got[got.step == step].sort_values(["lead", "core", "content"])
        at = np.linspace(0, len(x), buckets + 1).astype(int)[1:-1] if len(x) else []
        cuts = sorted({(int(a), int(b), int(c)) for a, b, c in zip(x.lead.iloc[at], x.core.iloc[at], x.content.iloc[at], strict=True)})
        out.append(np.array(cuts, np.int64).reshape(-1, 3).T)
    return out


def _widths(length: int) -> tuple[int, int, int]:
    return length - GRAM + 1, NARROWER, 1


def _flattened(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, kind, x and y of the list column ``found``."""
    lists = b.column("found")
    rows = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    return rows, *(flat.field(i).to_numpy() for i in range(3))


def _at_characters(data: bytes, base: int, start: int, end: int, last: int) -> tuple[int, int]:
    """The range cut back to where characters begin."""
    while start < end and data[base + start] & 0xC0 == 0x80:
        start += 1
    while start < end and base + end < last and data[base + end] & 0xC0 == 0x80:
        end -= 1
    return start, end


@kept_apart(r"spans|kept")
def repeats(docs: DataFrame, length: int = 200, keep: tuple[str, ...] = ("doc_id",), whole_characters: bool = False) -> DataFrame:
    """``keep``, ``text``, ``spans`` and ``kept``: where bytes lie in a repeated string of ``length`` bytes, and the rest.

    ``spans`` are the maximal runs of such bytes as (start, end); ``kept`` is the text's UTF-8 without them.  A string
    repeats if it starts anywhere else in any document, the same one included; no match crosses documents and all are
    judged on the texts as given.  Null texts are empty; shorter texts keep all; repeated rows, null ids and ids that
    occur more than once are documents like any other.  With ``whole_characters`` a run loses the bytes at its ends that
    are parts of a character, so that what is kept is UTF-8.  ``length`` must be over ``GRAM`` and at most 700.

    One shuffle carries suffixes (about one in 80 bytes), one the texts; what repeats within a task's batch is settled
    before, so no group of copies is collected.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    first = F.coalesce(F.xxhash64("doc_id"), F.lit(0)) if "doc_id" in docs.columns else F.lit(0)
    names = [c for c in keep if c != "text"]
    columns = [*(f"kept_{i}" for i in range(len(names))), "text"]
    table = docs.select(*(F.col(c).alias(k) for c, k in zip(names, columns, strict=False)), text.alias("text"), first.alias("k1"), F.xxhash64(text).alias("k2"))
    splitters = splitters_of(table, buckets, length)
    widths = _widths(length)
    held = spark.sparkContext.broadcast(splitters)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            data, offsets = byte_buffer(b, "text")
            found = all_suffixes(data, offsets, length)
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            yield from asked(found, tokens(data, offsets, found, widths[0], length), k1, k2, length, held.value[0])

    def answer(step: int) -> Callable:
        return lambda batches: answered(batches, length, held.value[step])

    def narrow(step: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in nonempty(batches):
                data, offsets = byte_buffer(b, "text")
                row, kind, x, y = _flattened(b)
                k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
                span = kind == SPAN
                d, s, e = merged(row[span], x[span], y[span])
                if len(d):
                    yield _batch(np.arange(len(d)) % (len(held.value[step][0]) + 1), SPAN, 0, s, e, k1[d], k2[d], 0)
                at = y[~span]
                found = narrower(np.stack([row[~span], at >> 20, at >> 10 & 1023, at & 1023]), widths[step])
                yield from asked(found, tokens(data, offsets, found, widths[step], length), k1, k2, length, held.value[step])

        return run

    def by_document(rows: DataFrame) -> DataFrame:
        x = F.when(F.col("kind") == SPAN, F.col("core")).otherwise(0)
        y = F.when(F.col("kind") == SPAN, F.col("content")).otherwise(F.col("at"))
        return rows.groupBy("k1", "k2").agg(F.collect_list(F.struct(F.col("kind").alias("kind"), x.alias("x"), y.alias("y"))).alias("found"))

    def sort(rows: DataFrame, step: int) -> DataFrame:
        return by_document(rows.repartitionById(len(splitters[step][0]) + 1, F.col("bucket")).mapInArrow(answer(step), _ROWS))

    found = sort(table.mapInArrow(begin, _ROWS), 0)
    for step in (1, 2):
        found = sort(table.join(found, ["k1", "k2"]).mapInArrow(narrow(step), _ROWS), step)
    spans = T.ArrayType(T.StructType.fromDDL("start long, end long"))
    schema = T.StructType([table.schema[c] for c in columns] + [T.StructField("spans", spans), T.StructField("kept", T.BinaryType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            data, offsets = byte_buffer(b, "text")
            whole = data.tobytes()
            row, kind, x, y = _flattened(b)
            span = kind == SPAN
            d, s, e = merged(row[span], x[span], y[span])
            cuts = np.searchsorted(d, np.arange(b.num_rows + 1))
            kept, lists = [], []
            for i in range(b.num_rows):
                own = list(zip(s[cuts[i] : cuts[i + 1]].tolist(), e[cuts[i] : cuts[i + 1]].tolist(), strict=True))
                at, base, parts = 0, int(offsets[i]), []
                if whole_characters:
                    own = [x for start, end in own if (x := _at_characters(whole, base, start, end, int(offsets[i + 1])))[1] > x[0]]
                for start, end in own:
                    parts.append(whole[base + at : base + start])
                    at = end
                kept.append(b"".join([*parts, whole[base + at : int(offsets[i + 1])]]))
                lists.append([{"start": start, "end": end} for start, end in own])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(lists, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))), pa.array(kept, pa.binary())], [*columns, "spans", "kept"])

    none = F.array().cast("array<struct<kind:int,x:bigint,y:bigint>>")
    return table.join(found, ["k1", "k2"], "left").withColumn("found", F.coalesce("found", none)).mapInArrow(finish, schema).select(*(F.col(k).alias(c) for c, k in zip(names, columns, strict=False)), "text", "spans", "kept")
