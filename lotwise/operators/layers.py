"""Derived layers: snapshots that are applied, verified and rolled back, rows tagged by run, and guards on queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.operators.changes import assertions


class Snapshots:
    """A table kept as whole versions under a folder; the newest of numbered pointers names the one in force.

    A change is written beside the version in force, checked there, and taken over only if it breaks no rule, so a failed
    change leaves nothing to undo; :meth:`roll_back` goes back to the version that the one in force was made from, and
    further back each time.  A pointer is made in one step that fails if its number is taken, so of two writers one wins.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        log = self._path(f"{self.path}/log")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(log) if s.getPath().getName().isdigit()) if self._fs.exists(log) else []

    def _pointer(self, number: int) -> tuple[str, int | None]:
        """The version that a pointer names, and the number of the pointer that it was made from."""
        version, _, parent = self.spark.read.text(f"{self.path}/log/{number:08d}").first()[0].partition(" ")
        return version, int(parent) if parent else None

    def _point(self, version: str, parent: int | None, after: int | None = None) -> None:
        """The next pointer after ``after`` (the newest, if not given); FileExistsError if another writer made it first."""
        number = 1 + (max(self._numbers(), default=-1) if after is None else after)
        try:
            out = self._fs.create(self._path(f"{self.path}/log/{number:08d}"), False)
        except Exception as e:
            if self._fs.exists(self._path(f"{self.path}/log/{number:08d}")):
                raise FileExistsError(f"another change of {self.path} came first") from e
            raise
        out.writeBytes(f"{version} {'' if parent is None else parent}".strip() + "\n")
        out.close()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._pointer(self._numbers()[-1])[0]}")

    def write(self, df: DataFrame) -> str:
        version, held = uuid.uuid4().hex, self._numbers()
        df.write.parquet(f"{self.path}/{version}")
        self._point(version, held[-1] if held else None, held[-1] if held else -1)
        return version

    def apply(self, change: Callable[[DataFrame], DataFrame], rules: dict[str, Column]) -> dict[str, int]:
        """Broken rules of the changed table, by name; the change is in force only if there are none.

        Raises FileExistsError if the table was changed meanwhile.
        """
        version, held = uuid.uuid4().hex, self._numbers()[-1]
        change(self.read()).write.parquet(f"{self.path}/{version}")
        broken = {r.rule: r.violations for r in assertions(self.spark.read.parquet(f"{self.path}/{version}"), rules).collect() if r.violations}
        if not broken:
            self._point(version, held, held)
        return broken

    def roll_back(self) -> None:
        """Put the version that the one in force was made from back in force."""
        held = self._numbers()[-1]
        parent = self._pointer(held)[1]
        if parent is None:
            raise ValueError("there is no earlier version")
        version, before = self._pointer(parent)
        self._point(version, before, held)


def tagged(df: DataFrame, run: str) -> DataFrame:
    """Rows of a derived layer with the run that made them."""
    return df.withColumn("run", F.lit(run))


def current(layer: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """The rows of each key's newest run; those of earlier runs are superseded."""
    newest = F.max(run).over(Window.partitionBy(*keys))
    return layer.withColumn("_newest", newest).where(F.col(run) == F.col("_newest")).drop("_newest")


def without_run(layer: DataFrame, run: str) -> DataFrame:
    """The layer as if a run had never been."""
    return layer.where(F.col("run") != run)


def constrained(params: dict, narrowing: set[str]) -> dict:
    """The parameters that are given; ValueError unless one of ``narrowing`` is among them, so no query reads everything by mistake."""
    given = {k: v for k, v in params.items() if v is not None}
    if not narrowing & set(given):
        raise ValueError(f"give one of {sorted(narrowing)}")
    return given
