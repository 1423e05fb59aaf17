"""Hashed text features and sparse linear fits, shared by the classifiers.

A text's features are its distinct words (runs of letters, lower-cased) and, where asked for, its make-up: the shares of
kinds of bytes and of single symbols, and how many of its tokens and lines are distinct.  Each is hashed into a fixed
number of columns, so a model is bounded whatever the vocabulary.  Feature statistics are summed over all labelled rows on
the executors; only a bounded sample of rows, reduced to the selected columns, reaches the driver for the fit.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import Remembered, list_array, nonempty, schema_of, slices, texts_of, written

BITS = 18
#: At most so many labelled rows are used to fit weights; feature statistics use all of them.
FIT_ROWS = 20_000
#: A column counts if its rate differs between the classes by so many standard errors.
LEAST_Z = 3.0
#: Tokens whose columns a worker remembers.
REMEMBERED = 200_000
#: Columns that :func:`with_features` adds.
AT, SECOND, TOKENS = "_features", "_swapped", "_tokens"

WORD = re.compile(r"[^\W\d_]+")
#: Kind of each byte: white space, line end, small letter, capital, digit, beyond ASCII, other.
_KIND = np.array([1 if b == 10 else 0 if b in b" \t\r" else 2 if 97 <= b <= 122 else 3 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 5 if b > 127 else 6 for b in range(256)])


def column(name: str) -> int:
    return zlib.crc32(name.encode()) & (1 << BITS) - 1


def columns_of_token(token: str) -> tuple[int, ...]:
    """Columns of the words in a token, most often one that a single mark may follow."""
    word = token if token.isalpha() else token[:-1]
    return (column(word),) if word.isalpha() and token[-1:].isascii() else tuple(map(column, WORD.findall(token)))


def make_up(text: str, tokens: int, distinct: int) -> list[str]:
    """Names of the make-up features of a text of so many tokens, of which so many are distinct."""
    if not tokens:
        return ["=empty"]
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    total, kinds = counts.sum(), np.bincount(_KIND, counts, 7)
    found = [f"=kind{k}={round(2 * math.log2(n / total))}" for k, n in enumerate(kinds.tolist()) if n]
    found += [f"=byte{b}={round(math.log2(counts[b] / total))}" for b in np.flatnonzero((_KIND == 6) & (100 * counts >= total)).tolist()]
    lines = text.split("\n")
    found.append(f"=distinct={round(8 * distinct / tokens)}")
    found.append(f"=lines={round(8 * len(set(lines)) / len(lines))}")
    found.append(f"=length={round(math.log2(tokens))}")
    return found


class Features:
    """Hashed columns of texts: a set with one entry for each distinct word or make-up feature."""

    def __init__(self, made_up: bool):
        self.made_up, self.of_token, self.columns = made_up, Remembered(columns_of_token, REMEMBERED), Remembered(column, 10_000)
        self.tokens = 0

    def __call__(self, text: str) -> set[int]:
        tokens = text.lower().split()
        distinct, self.tokens = set(tokens), len(tokens)
        found = set(chain.from_iterable(map(self.of_token.__getitem__, distinct)))
        if self.made_up:
            found.update(map(self.columns.__getitem__, make_up(text, len(tokens), len(distinct))))
        return found


def with_features(docs: DataFrame, made_up: bool, keep: tuple[str, ...] = ("doc_id",), other: Callable[[str], str] | None = None, marks: frozenset[int] = frozenset()) -> DataFrame:
    """``keep``, the text's distinct columns, those of ``other(text)`` where it may differ, and its number of tokens.

    ``other`` is asked only for texts with a column among ``marks``.  Null texts are empty.
    """
    schema = schema_of(docs, *keep, extra=f"{AT} array<int>, {SECOND} array<int>, {TOKENS} long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(made_up)
        for b in slices(batches):
            at, sizes, second, tokens = [], [], [], []
            for text in texts_of(b, "text"):
                own = features(text)
                at.extend(own)
                sizes.append(len(own))
                tokens.append(features.tokens)
                second.append(list(features(o)) if other and not marks.isdisjoint(own) and (o := other(text)) != text else None)
            more = [list_array(np.array(at, np.int32), sizes), pa.array(second, pa.list_(pa.int32())), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *more], schema.names)

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def labelled_rows(featured: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, at, second, label`` for each labelled row of a table made by :func:`with_features`.

    Only columns are shuffled, no texts, and labels are never broadcast, for they grow with the documents; the result is
    a written table.  Rows without a label, or with a null id, take no part.  A label given more than once for an id
    counts once; of labels that differ the least counts.
    """
    one = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("label").cast("int")).alias("label"))
    rows = featured.select("doc_id", F.col(AT).alias("at"), F.col(SECOND).alias("second"))
    return written(rows.join(one.hint("merge"), "doc_id"), "labelled")


def flattened(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a list column and the row of each."""
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())


def class_counts(labelled: DataFrame, classes: int) -> DataFrame:
    """``feature, n0, n1, ...``: rows of each class that have the feature, over all labelled rows."""
    names = [f"n{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(classes << BITS, np.int64)
        for b in nonempty(batches):
            at, row = flattened(b, "at")
            counts += np.bincount((b.column("label").to_numpy()[row] << BITS) + at, minlength=len(counts))
        counts = counts.reshape(classes, 1 << BITS)
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({"feature": pa.array(seen, pa.int32())} | {n: pa.array(counts[k, seen]) for k, n in enumerate(names)})

    rows = labelled.select("at", "label").mapInArrow(run, "feature int, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("feature").agg(*(F.sum(n).alias(n) for n in names))


def telling(labelled: DataFrame, classes: int, keep: set[int] = frozenset()) -> np.ndarray:
    """Sorted columns whose rate differs between a class and the rest by ``LEAST_Z`` standard errors, and ``keep``.

    There are at most ``2**BITS`` of them.
    """
    totals = np.zeros(classes)
    for r in labelled.groupBy("label").count().collect():
        totals[r.label] = r["count"]
    found = class_counts(labelled, classes).toArrow().to_pandas()
    if not len(found) or totals.sum() == 0:
        return np.array(sorted(keep), np.int64)
    n = found[[f"n{k}" for k in range(classes)]].to_numpy(float)
    z = np.zeros(len(found))
    for k in range(classes):
        m, rest = totals[k], totals.sum() - totals[k]
        if m and rest:
            share = (n.sum(1) + 1) / (totals.sum() + 2)
            gap = n[:, k] / m - (n.sum(1) - n[:, k]) / rest
            z = np.maximum(z, np.abs(gap) / np.sqrt(share * (1 - share) * (1 / m + 1 / rest)))
    return np.array(sorted(set(found.feature[(z >= LEAST_Z) & (n.sum(1) >= 3)].tolist()) | keep), np.int64)


class Rows:
    """Sparse rows over the selected columns, kept by row and by column."""

    def __init__(self, lists: list[np.ndarray], width: int):
        self.width, self.n = width, len(lists)
        self.at = np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
        row = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in lists]) if lists else np.zeros(0, np.int32)
        order = np.argsort(self.at, kind="stable")
        self.row_of = row[order]
        self.rows = self._starts(np.bincount(row, minlength=self.n))
        self.columns = self._starts(np.bincount(self.at, minlength=width))

    @staticmethod
    def _starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(sizes)
        return some, (np.cumsum(sizes) - sizes)[some]

    @staticmethod
    def _sums(v: np.ndarray, groups: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        out = np.zeros((n, *v.shape[1:]))
        if len(groups[0]):
            out[groups[0]] = np.add.reduceat(v, groups[1], axis=0)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w[self.at], self.rows, self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return self._sums(v[self.row_of], self.columns, self.width)


def fit_rows(labelled: DataFrame, selected: np.ndarray, rows: int = FIT_ROWS) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Columns (as places in ``selected``), label and columns of the other text of at most ``rows`` labelled rows.

    The rows of smallest hash are taken, so the choice doesn't depend on their order.
    """
    held = labelled.sparkSession.sparkContext.broadcast(selected)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1)
        place[held.value] = np.arange(len(held.value))
        for b in nonempty(batches):
            whole = b.set_column(b.schema.get_field_index("second"), "second", pc.coalesce(b.column("second"), b.column("at")))
            found = []
            for c in ("at", "second"):
                at, row = flattened(whole, c)
                here = place[at] >= 0
                found.append(list_array(place[at][here].astype(np.int32), np.bincount(row[here], minlength=b.num_rows)))
            yield pa.RecordBatch.from_arrays([b.column("h"), *found, b.column("label")], ["h", "at", "second", "label"])

    last = labelled.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return [], np.zeros(0, np.int64), []
    kept = labelled.select(F.xxhash64("doc_id").alias("h"), "at", "second", "label").where(F.col("h") <= last)
    table = kept.mapInArrow(run, "h long, at array<int>, second array<int>, label int").orderBy("h", "label", "at").limit(rows).toArrow()
    lists = [[np.array(x, np.int64) for x in table.column(c).to_pylist()] for c in ("at", "second")]
    return lists[0], table.column("label").to_numpy().astype(np.int64), lists[1]


def minimise(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 150, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    x, (f, g) = start, objective(start)
    ss: list[np.ndarray] = []
    ys: list[np.ndarray] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in zip(reversed(ss), reversed(ys), strict=True):
            alphas.append(s @ q / (s @ y))
            q -= alphas[-1] * y
        q *= ss[-1] @ ys[-1] / (ys[-1] @ ys[-1]) if ss else 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(zip(ss, ys, strict=True), reversed(alphas), strict=True):
            q += (a - y @ q / (s @ y)) * s
        step, slope = 1.0, g @ q
        while step > 1e-8:
            new = x - step * q
            f2, g2 = objective(new)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            ss, ys = [*ss, s][-memory:], [*ys, y][-memory:]
        done = abs(f - f2) < 1e-7 * max(1.0, abs(f))
        x, f, g = new, f2, g2
        if done:
            break
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def linear_scores(df: DataFrame, selected: np.ndarray, weights: np.ndarray, offsets: np.ndarray, made_up: bool, keep: tuple[str, ...], raw: str = "_raw") -> DataFrame:
    """``keep`` and ``raw``, an array with each output's weighted sum over the text's features plus its offset.

    A table made by :func:`with_features` is scored by its columns, any other by its texts.
    """
    held = df.sparkSession.sparkContext.broadcast((selected, weights, offsets))
    ready = AT in df.columns
    schema = schema_of(df, *keep, extra=f"`{raw}` array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, w, b0 = held.value
        place = np.full(1 << BITS, len(columns))
        place[columns] = np.arange(len(columns))
        w = np.concatenate([w, np.zeros((1, len(b0)))])
        features = Features(made_up)
        for b in slices(batches):
            if ready:
                at, row = flattened(b, AT)
            else:
                sets = list(map(features, texts_of(b, "text")))
                at = np.fromiter(chain.from_iterable(sets), np.int64)
                row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
            at = place[at]
            sums = np.stack([np.bincount(row, w[at, k], b.num_rows) for k in range(len(b0))], axis=1) + b0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), list_array(sums.ravel(), np.full(b.num_rows, len(b0)))], [*keep, raw])

    return df.select(*dict.fromkeys((*keep, AT if ready else "text"))).mapInArrow(run, schema)
