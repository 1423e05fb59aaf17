"""Pages of an ordered table, and writes in chunks that can be tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The first ``size`` rows in ``order`` that come after the key ``after``; keys must tell rows apart and hold no nulls.

    Rows before the page are filtered out, not counted past, so a late page costs no more than the first.
    """
    if after is not None:
        beyond = F.lit(False)
        for i in range(len(order) - 1, -1, -1):
            beyond = (F.col(order[i]) > F.lit(after[i])) | ((F.col(order[i]) == F.lit(after[i])) & beyond)
        df = df.where(beyond)
    return df.orderBy(*order).limit(size)


def in_chunks(df: DataFrame, key: str, chunks: int, write: Callable[[DataFrame, int], None], tries: int = 3) -> list[int]:
    """Write ``df`` in chunks by the hash of ``key``; each is tried up to ``tries`` times and the chunks that failed come back.

    ``write`` must be idempotent by chunk, as a keyed upsert or a write to a folder of the chunk's own is.
    """
    failed = []
    for k in range(chunks):
        part = df.where(F.pmod(F.coalesce(F.xxhash64(key), F.lit(0)), F.lit(chunks)) == k)
        for attempt in range(tries):
            try:
                write(part, k)
                break
            except Exception:
                if attempt == tries - 1:
                    failed.append(k)
    return failed
