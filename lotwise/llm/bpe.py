"""Byte-level BPE encoding and decoding.

A word's merges come from a segment tree over the ranks of its adjacent pairs: the root names the leftmost pair of
lowest rank, a merge changes three leaves, and each change walks up a logarithmic path.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lotwise.llm.common import Remembered, kept_apart, rebuild, schema_of, slices, texts_of

#: The split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A worker remembers the ids of this many distinct pieces, then starts anew.
REMEMBERED = 200_000

NONE, FAN = 1 << 62, 16


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in plain}
    return table | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in table)}


class Vocabulary:
    """Merges, pieces and special tokens of a ``tokenizers`` file; plain data, so that it can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        back = {c: b for b, c in byte_alphabet().items()}
        self.pieces = {i: bytes(back[c] for c in w) for w, i in ids.items() if all(c in back for c in w)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = [ids[c] for _, c in sorted(byte_alphabet().items())]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])


def merge_word(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids of one word: merge the leftmost lowest-ranked pair until no pair can be merged.

    The tree has up to ``FAN`` children a node; a leaf holds rank and place of the pair that begins there, so the least
    key at the root is the lowest rank and, among equal ranks, the leftmost place.
    """
    n = len(symbols)
    keys = [got[0] << 32 | i if (got := merges.get((symbols[i], symbols[i + 1]))) else NONE for i in range(n - 1)]
    tree = [keys]
    while len(tree[-1]) > FAN:
        low = tree[-1]
        tree.append([min(low[k : k + FAN]) for k in range(0, len(low), FAN)])
    top, above = tree[-1], tree[1:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while top and (least := min(top)) != NONE:
        i = least & 0xFFFFFFFF
        j = after[i]
        symbols[i] = merges[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k = after[i] = after[j]
        changed = [i]
        if k < n:
            before[k] = i
            got = merges.get((symbols[i], symbols[k]))
            keys[i] = got[0] << 32 | i if got else NONE
            keys[j] = NONE
            changed.append(j)
        else:
            keys[i] = NONE
        h = before[i]
        if h >= 0:
            got = merges.get((symbols[h], symbols[i]))
            keys[h] = got[0] << 32 | h if got else NONE
            changed.append(h)
        if above:
            for c in changed:
                low = keys
                for level in above:
                    c //= FAN
                    least = min(low[c * FAN : c * FAN + FAN])
                    if level[c] == least:
                        break
                    level[c] = least
                    low = level
    return [s for s in symbols if s >= 0]


class Pieces(Remembered):
    """Packed ids by piece of text; those of short pieces are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(lambda piece: array("I", merge_word([vocabulary.byte_ids[b] for b in piece.encode()], vocabulary.merges)).tobytes(), REMEMBERED)


#: Texts of nothing but these characters split alike with the standard library's faster engine: its ``\w`` and ``\s``
#: differ from letters, numbers and white space only elsewhere.
OTHER = re.compile("[^\t-\r -\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]")
PLAIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ANY = regex.compile(SPLIT)


def split(text: str) -> list[str]:
    """The pieces of a text, between which no merge takes place."""
    return (ANY if OTHER.search(text) else PLAIN).findall(text)


@lru_cache(maxsize=4)
def _marks(special: tuple[str, ...]):
    return regex.compile("(" + "|".join(map(regex.escape, special)) + ")")


def encode_text(text: str, pieces: Pieces, special: dict[str, int]) -> bytes:
    """Ids of a whole text, each as four bytes, lowest first."""
    if not any(map(text.__contains__, special)):
        return b"".join(map(pieces.__getitem__, split(text)))
    marks = _marks(tuple(sorted(special, key=len, reverse=True)))
    return b"".join(array("I", [special[p]]).tobytes() if p in special else b"".join(map(pieces.__getitem__, split(p))) for p in marks.split(text))


@kept_apart(r"ids")
def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids``: the ids of each whole text as packed little-endian unsigned 32-bit integers.

    A null or empty text has no ids.  Every row is encoded by itself in a narrow pass, so ties, repeated rows and very
    long texts need nothing special; an empty table gives an empty one; other columns are not read.
    """
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, special = Pieces(held.value), held.value.special
        for b in slices(batches):
            yield rebuild(b, list(keep), {"ids": pa.array(map(encode_text, texts_of(b, text), repeat(pieces), repeat(special)), pa.binary())})

    return df.select(*dict.fromkeys((*keep, text))).mapInArrow(run, schema_of(df, *keep, extra="ids binary"))


def decode_ids(ids: bytes | None, pieces: dict[int, bytes]) -> str:
    """The text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(pieces.__getitem__, array("I", ids or b""))).decode("utf-8", "replace")


@kept_apart(r"ids|decoded")
def round_trip(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids`` and ``decoded``, as :func:`encode` and then :func:`decode` give them.

    Both ways share one pass and one vocabulary a worker, so ids don't travel between workers.
    """
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, v = Pieces(held.value), held.value
        for b in slices(batches):
            ids = [encode_text(t, pieces, v.special) for t in texts_of(b, text)]
            back = pa.array((decode_ids(x, v.pieces) for x in ids), pa.string())
            yield rebuild(b, list(keep), {"ids": pa.array(ids, pa.binary()), "decoded": back})

    return df.select(*dict.fromkeys((*keep, text))).mapInArrow(run, schema_of(df, *keep, extra="ids binary, decoded string"))


@kept_apart(r"decoded")
def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``decoded``: the text of packed ids; bytes that aren't UTF-8 become U+FFFD, null ids an empty text."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = (decode_ids(x, held.value.pieces) for x in b.column(ids).to_pylist())
            yield rebuild(b, list(keep), {"decoded": pa.array(texts, pa.string())})

    return df.select(*dict.fromkeys((*keep, ids))).mapInArrow(run, schema_of(df, *keep, extra="decoded string"))
