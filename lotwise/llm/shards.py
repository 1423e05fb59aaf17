"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards; runs of similar size are merged into files of a target size; a versioned
manifest, committed atomically, names the shards that make up the data.  All data moves through DataFrame reads and writes.

Layout of a store::

    data/<run>/part-*.parquet         shards, never changed
    manifests/list-<id>/*.parquet     live shards: run, name, tier, bytes, rows
    manifests/v00000001               one line that names the list of that version; there when committed
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "run string, name string, tier int, bytes long, rows long"
#: Column that :func:`shard` adds: the number of a row's arrival.
ARRIVAL = "_arrival"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """A table kept as immutable shards under ``path``.

    ``target`` is the size in bytes of text that merged files aim at, ``fan`` how many runs of a tier are merged and
    ``smallest`` the size up to which a run is of tier 0; tier k holds runs up to ``smallest * fan ** k``.
    """

    def __init__(self, spark: SparkSession, path: str, target: int = 256 << 20, fan: int = 4, smallest: int = 16 << 20, text: str = "text"):
        self.spark, self.path, self.target, self.fan, self.smallest, self.text = spark, path.rstrip("/"), target, fan, smallest, text
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        top = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        return sorted(int(n[1:]) for n in self._names("manifests") if n.startswith("v") and n[1:].isdigit())

    def version(self) -> int:
        """The newest committed version; 0 for none."""
        return max(self.versions(), default=0)

    def _list_of(self, version: int) -> str:
        return self.spark.read.text(f"{self.path}/manifests/v{version:08d}").first()[0]

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version, the newest by default; none for version 0."""
        v = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self._list_of(v)}") if v else self.spark.createDataFrame([], MANIFEST)

    def commit(self, shards: DataFrame, version: int) -> None:
        """Publish ``shards`` as ``version``, which succeeds for one writer only.

        The list and the line that names it are written aside first; publishing is one step that fails if the version is
        there: a hard link on a local disk, a rename without overwriting on other file systems.
        """
        name = f"list-{uuid.uuid4().hex}"
        shards.coalesce(1 + self.spark.sparkContext.defaultParallelism // 8).write.parquet(f"{self.path}/manifests/{name}")
        jvm, aside, final = self.spark._jvm, self._path(f"{self.path}/manifests/.{name}"), self._path(f"{self.path}/manifests/v{version:08d}")
        out = self._fs.create(aside, True)
        out.writeBytes(f"{name}\n")
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                local = lambda p: jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri())
                jvm.java.nio.file.Files.createLink(local(final), local(aside))
            else:
                files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
                files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(final), options)
        except Exception as e:
            if not self._fs.exists(final):
                raise
            self._fs.delete(self._path(f"{self.path}/manifests/{name}"), True)
            raise Conflict(f"version {version} is taken") from e
        finally:
            self._fs.delete(aside, False)

    def tier(self, size: int) -> int:
        return 0 if size <= self.smallest else math.ceil(math.log(size / self.smallest, self.fan) - 1e-9)

    def _describe(self, run: str) -> DataFrame:
        """The shards of a run, from the files themselves."""
        size = F.coalesce(F.octet_length(self.text), F.lit(0)).cast("long")
        rows = self.spark.read.parquet(f"{self.path}/data/{run}").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), size.alias("b"))
        found = rows.groupBy("name").agg(F.sum("b").alias("bytes"), F.count("*").alias("rows"))
        return found.select(F.lit(run).alias("run"), "name", "bytes", "rows")

    def _with_tier(self, shards: DataFrame) -> DataFrame:
        """A run's tier follows from its size; runs are few, shards may be many."""
        sizes = {r.run: self.tier(r.n) for r in shards.groupBy("run").agg(F.sum("bytes").alias("n")).collect()}
        tiers = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)) if sizes else F.create_map().cast("map<string,int>")
        return shards.select("run", "name", tiers[F.col("run")].cast("int").alias("tier"), "bytes", "rows")

    def append(self, rows: DataFrame, run: str | None = None) -> int:
        """Write an arrival as a run of small shards and commit it; the new version.  An arrival without rows adds none.

        A failed or lost writer leaves files that no manifest names.
        """
        run = run or f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{run}")
        return self.adopt(run)

    def adopt(self, run: str) -> int:
        """Commit a run whose shards lie in ``data/<run>``; the new version.  Raises Conflict if another writer was first."""
        version = self.version()
        self.commit(self.manifest(version).unionByName(self._with_tier(self._describe(run))), version + 1)
        return version + 1

    def compact(self) -> int:
        """Merge tiers that hold ``fan`` runs or more until there are none; the version then current."""
        while True:
            version = self.version()
            live = self.manifest(version)
            tiers = {r.tier: (r.runs, r.n) for r in live.groupBy("tier").agg(F.count_distinct("run").alias("runs"), F.sum("bytes").alias("n")).collect()}
            full = sorted(t for t, (runs, _) in tiers.items() if runs >= self.fan)
            if not full:
                return version
            runs = [r.run for r in live.where(F.col("tier") == full[0]).select("run").distinct().collect()]
            merged, size = f"run-{uuid.uuid4().hex}", tiers[full[0]][1]
            self._merge(runs, merged, size)
            self.commit(live.where(~F.col("run").isin(runs)).unionByName(self._with_tier(self._describe(merged))), version + 1)

    def _merge(self, runs: list[str], merged: str, size: int) -> None:
        """One run of files of about the target size, made of whole input splits, so without a shuffle."""
        files = max(1, math.ceil(size / self.target))
        self._rows(self.manifest().where(F.col("run").isin(runs))).coalesce(files).write.parquet(f"{self.path}/data/{merged}")

    def _rows(self, shards: DataFrame) -> DataFrame:
        """The rows of the shards that a manifest names, and of no other files."""
        paths = [f"{self.path}/data/{r.run}/{r.name}" for r in shards.select("run", F.col("name").alias("name")).collect()]
        return self.spark.read.schema(self._schema()).parquet(*sorted(paths)) if paths else self.spark.createDataFrame([], self._schema())

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, each with its shard's ``shard`` path; none, in the columns of the first arrival, where no run has rows."""
        rows = self._rows(self.manifest(version))
        return rows.withColumn("shard", F.col("_metadata.file_path")) if rows.inputFiles() else rows.withColumn("shard", F.lit(None).cast("string"))

    def _schema(self) -> T.StructType:
        """Columns of the rows, from any run that was written, rows or not."""
        written = sorted(self._names("data"))
        if not written:
            raise FileNotFoundError(f"{self.path} has no arrival")
        return self.spark.read.parquet(f"{self.path}/data/{written[0]}").schema

    def vacuum(self, keep: int = 1, orphans: float | None = None) -> None:
        """Delete versions but the ``keep`` newest, and runs that only deleted versions named.

        A run that no version names may belong to a writer that hasn't committed yet, so it stays, unless ``orphans``
        gives an age in seconds beyond which such runs are leftovers.
        """
        every = self.versions()
        old, kept = every[:-keep], every[-keep:]
        runs_of = lambda vs: {r.run for v in vs for r in self.manifest(v).select("run").distinct().collect()}
        live, named = runs_of(kept), runs_of(old)
        for run in (named - live) & set(self._names("data")):
            self._fs.delete(self._path(f"{self.path}/data/{run}"), True)
        for v in old:
            name = self._list_of(v)
            self._fs.delete(self._path(f"{self.path}/manifests/v{v:08d}"), False)
            self._fs.delete(self._path(f"{self.path}/manifests/{name}"), True)
        if orphans is not None and kept:
            now = self.spark._jvm.java.lang.System.currentTimeMillis()
            for s in self._fs.listStatus(self._path(f"{self.path}/data")):
                if s.getPath().getName() not in live | named and now - s.getModificationTime() > 1_000 * orphans:
                    self._fs.delete(s.getPath(), True)


def shard(docs: DataFrame, path: str, arrivals: int = 8, target: int = 256 << 20, fan: int = 4, smallest: int = 16 << 20, versions: int | None = None) -> ShardStore:
    """Append ``docs`` to a store at ``path`` as so many arrivals, by the hash of ``doc_id``, compacting as tiers fill.

    One scan writes the arrivals' shards, which are then committed one by one; of older versions all
    are kept, or the newest ``versions``.  Every row is kept once, repeated rows and null ids or texts too; a table without rows gives a store of empty runs.  Columns
    are kept as they are; ``_arrival`` and, on reading, ``shard`` are added and may not be among them.
    """
    clash = {ARRIVAL, "shard"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the store's own")
    spark, mark = docs.sparkSession, uuid.uuid4().hex[:8]
    store = ShardStore(spark, path, target, fan, smallest)
    turn = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), F.lit(0)).cast("int")
    staged = docs.withColumn(ARRIVAL, turn)
    staged.withColumn("_part", F.col(ARRIVAL)).write.partitionBy("_part").parquet(f"{store.path}/arriving-{mark}")
    for k in range(arrivals):
        run, source = f"arrival-{k:04d}-{mark}", store._path(f"{store.path}/arriving-{mark}/_part={k}")
        if store._fs.exists(source):
            store._fs.mkdirs(store._path(f"{store.path}/data"))
            store._fs.rename(source, store._path(f"{store.path}/data/{run}"))
            store.adopt(run)
        elif not store.versions():
            store.append(staged.limit(0), run)
        store.compact()
        if versions:
            store.vacuum(versions)
    store._fs.delete(store._path(f"{store.path}/arriving-{mark}"), True)
    return store
