"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import inspect
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.operators.durable import checkpoint_dir

#: Tables that :func:`written` has made and nothing has deleted.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests, a laptop) a temporary folder stands in.
    """
    return (spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor costs nothing but the task that was running, since the files outlive it.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared file system."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(spark: SparkSession, frame: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`written` once a later table has replaced it."""
    delete(spark, *{f.rsplit("/", 1)[0] for f in frame.inputFiles()})


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` makes within are deleted at the end, when what was made of them has been written."""
    mark = len(_made)
    yield
    delete(spark, *_made[mark:])
    del _made[mark:]


#: A sieve has at most so many bits (64 MB); for more ids there is none.
SIEVE_BITS = 1 << 29


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Four bits of a sieve for each id."""
    x = ids.view(np.uint64)
    a = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    b = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    a, b = a ^ (a >> np.uint64(33)), b ^ (b >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(4, dtype=np.uint64) * b[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def sieve(ids: DataFrame):
    """A broadcast bit map that lets all of ``ids`` (one long column) through and hardly any other, for :func:`passes`.

    It takes 16 to 32 bits an id and is bounded by ``SIEVE_BITS``; for more ids it is None, which lets all through.
    Bit maps of tasks are united by block on the executors.
    """
    spark, name = ids.sparkSession, ids.columns[0]
    bits = 1 << max(16, (16 * ids.count()).bit_length())
    if bits > SIEVE_BITS:
        return None
    step = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in nonempty(batches):
            at = _places(b.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used = [k for k in range(0, len(own), step) if own[k : k + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([own[k : k + step].tobytes() for k in used], pa.binary())], ["block", "bits"])

    def unite(key: tuple, rows: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows.column("bits").to_pylist()])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([both.tobytes()], pa.binary())})

    whole = np.zeros(bits // 8, np.uint8)
    for r in ids.select(name).where(F.col(name).isNotNull()).mapInArrow(run, "block int, bits binary").groupBy("block").applyInArrow(unite, "block int, bits binary").collect():
        whole[r.block : r.block + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(whole)


def passes(held, ids: np.ndarray) -> np.ndarray:
    """Which ids a sieve lets through; all, if there is none."""
    if held is None:
        return np.ones(len(ids), bool)
    at = _places(ids, 8 * len(held.value))
    return (held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def training_row(column, folds: int, held: int, holds: bool = False):
    """Whether crc32 of the id as text, modulo ``folds``, differs from ``held`` (equals it, for ``holds``)."""
    kept = F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds
    return kept == held if holds else kept != held


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column as Python strings, null as empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to Python, not to the corpus.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    """Runs of anything but blanks, tabs and line ends, A to Z in lower case."""
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return _WORD.findall(low) if _ODD_SPACE.search(low) else low.split()


def schema_of(df: DataFrame, *columns: str, extra: str = "") -> T.StructType:
    """Fields of ``df`` named in ``columns`` followed by those of the DDL string ``extra``."""
    fields = [df.schema[c] for c in columns]
    return T.StructType(fields + (T.StructType.fromDDL(extra).fields if extra else []))


def kept_apart(own: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For an operator whose first argument is a table and that has ``keep``: kept columns with names that it gives itself come back as ``kept_<name>``.

    ``own`` is a pattern of the operator's own names, those of columns on the way included.
    """
    mine = re.compile(own)

    def around(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)
        table = next(iter(signature.parameters))

        @wraps(operator)
        def run(*args, **kwargs) -> DataFrame:
            call = signature.bind(*args, **kwargs)
            call.apply_defaults()
            df, names = call.arguments[table], []
            for c in call.arguments["keep"]:
                name = c
                while mine.fullmatch(name) or (name != c and name in df.columns):
                    name = f"kept_{name}"
                df = df.withColumnRenamed(c, name) if name != c else df
                names.append(name)
            call.arguments.update({table: df, "keep": tuple(names)})
            return operator(*call.args, **call.kwargs)

        return run

    return around


def rebuild(batch: pa.RecordBatch, columns: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of ``batch`` and the new ones."""
    return pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + list(more.values()), [*columns, *more])


def byte_buffer(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a whole string column and the row offsets into them; null counts as empty."""
    col = batch.column(name)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def nonempty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that have rows."""
    return (b for b in batches if b.num_rows)


#: Rows of texts that a Python worker turns into objects at a time.
SLICE = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that what is made of a part is small whatever the batch."""
    return (b.slice(lo, rows) for b in batches for lo in range(0, b.num_rows, rows))


class Remembered(dict):
    """A function of short strings with its results, of which a bounded number is kept."""

    def __init__(self, function, room: int):
        super().__init__()
        self.function, self.room = function, room

    def __missing__(self, key: str):
        value = self.function(key)
        if len(self) >= self.room:
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


def list_array(flat: np.ndarray, sizes) -> pa.ListArray:
    """Lists of the given sizes, laid end to end in ``flat``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
