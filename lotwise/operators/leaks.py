"""Runs of words that documents share with listed passages."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _rolled(words: list[str], known: dict[str, int], n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; words that no listed run has are 0 in it."""
    own = np.fromiter((known.get(w, 0) for w in words), np.uint64, len(words))
    total = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * _ODD + own[k : k + len(total)]
    return total


def counted(docs: DataFrame, listed: list[Row], n: int) -> DataFrame:
    """``item_id, doc_id, shared``: distinct runs of ``n`` words of a document's ``words`` (parted by blanks) that a listed passage has.

    ``listed`` has (item_id, gram), runs joined by blanks.  A narrow pass: hashes find runs that may be listed, which are
    then looked up as they are; a null text has no words.
    """
    items = defaultdict(list)
    for r in listed:
        items[r.gram].append(r.item_id)
    known = {w: k for k, w in enumerate(sorted({w for g in items for w in g.split(" ")}), 1)}
    hashes = np.unique(np.concatenate([_rolled(g.split(" "), known, n) for g in items])) if items else np.zeros(0, np.uint64)
    held = docs.sparkSession.sparkContext.broadcast((dict(items), known, hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_gram, of_word, marks = held.value
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("words").to_pylist(), strict=True):
                words = (text or "").split(" ")
                if len(words) < n or not len(marks):
                    continue
                found = _rolled(words, of_word, n)
                at = np.searchsorted(marks, found)
                hit = np.flatnonzero(marks[np.minimum(at, len(marks) - 1)] == found)
                runs = {" ".join(words[i : i + n]) for i in hit.tolist()}
                out += [(item, doc, k) for item, k in Counter(i for g in runs for i in of_gram.get(g, ())).items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["item_id", "doc_id", "shared"])

    return docs.select("doc_id", "words").mapInArrow(run, "item_id long, doc_id long, shared long")
